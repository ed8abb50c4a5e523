"""All queries of the library and their DuckDB oracles, by name.

The filings that the operators were made for are stood in for by the tables at hand: parts are filings with titles,
order lines their documents and facts, orders dated versions, documents text chunks, pages filings in HTML.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import normalize as N
from lodestone.functions import text as T
from lodestone.operators import answers, calculation, chunking, history, invariants, quality, search, sections, tables
from lodestone.plans import question
from lodestone.sources import files, markup
from lodestone.tables import table

#: Key of the query that ``entry`` runs.
FLAGSHIP = "q01_metadata_search_topk"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# ---- search ---------------------------------------------------------------------------------------------------------

PART = search.FilingColumns(key="p_partkey", title="p_name", category="p_type", subtype="p_brand")
TITLES = search.MetadataCondition(title_terms=("red", "small widget"), limit=20)
_TITLE_SCORE = """(CASE WHEN lower(p_name) = 'red' THEN 3.0 WHEN instr(lower(p_name), 'red') = 1 THEN 2.0 WHEN instr(lower(p_name), 'red') > 0 THEN 1.0 ELSE 0.0 END
  + CASE WHEN lower(p_name) = 'small widget' THEN 3.0 WHEN instr(lower(p_name), 'small widget') = 1 THEN 2.0 WHEN instr(lower(p_name), 'small widget') > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE"""
_TITLE_FILTER = "(instr(lower(p_name), 'red') > 0 OR instr(lower(p_name), 'small widget') > 0)"


@query(f"""SELECT p_partkey, p_name, title_score, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS document_count
FROM (SELECT p_partkey, p_name, p_size, {_TITLE_SCORE} AS title_score FROM part WHERE {_TITLE_FILTER} ORDER BY title_score DESC, p_size DESC, p_partkey LIMIT 20)""")
def q01_metadata_search_topk(spark: SparkSession, d: str) -> DataFrame:
    out = search.metadata_search(table(spark, d, "part"), table(spark, d, "lineitem").select("l_partkey"), "l_partkey", PART, TITLES, (F.col("p_size").desc(), F.col("p_partkey")))
    return out.select("p_partkey", "p_name", "title_score", "document_count")


@query(f"SELECT count(*) AS candidate_count, least(count(*), 20) AS returned, count(*) > 20 AS truncated FROM part WHERE {_TITLE_FILTER}")
def q02_metadata_candidate_count_truncated(spark: SparkSession, d: str) -> DataFrame:
    return search.candidate_summary(search.metadata_candidates(table(spark, d, "part"), PART, TITLES), TITLES.limit)


@query(f"""SELECT p_partkey, title_score FROM (SELECT p_partkey, p_size, {_TITLE_SCORE} AS title_score FROM part WHERE p_type IN (SELECT min(p_type) FROM part)
ORDER BY title_score DESC, p_size DESC, p_partkey LIMIT 50)""")
def q03_title_as_filter_vs_ranking(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    kind = parts.agg(F.min("p_type")).first()[0]
    cond = search.MetadataCondition(title_terms=TITLES.title_terms, categories=(kind,), limit=50)
    out = search.metadata_candidates(parts, PART, cond).withColumn("title_score", search.title_score("p_name", cond.title_terms))
    return out.orderBy(F.desc("title_score"), F.desc("p_size"), "p_partkey").limit(cond.limit).select("p_partkey", "title_score")


ORDERS = search.FilingColumns(key="o_orderkey", title="o_orderpriority", filed_on="o_orderdate", correction="is_correction")


def _filings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("is_correction", F.col("o_orderstatus") == "P")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS filed_on FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1995-06-30'")
def q04_asof_upper_bound(spark: SparkSession, d: str) -> DataFrame:
    cond = search.MetadataCondition(date_from=date(1995, 1, 1), date_to=date(1996, 1, 1), as_of=date(1995, 6, 30))
    return search.metadata_candidates(_filings(spark, d), ORDERS, cond).select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("filed_on"))


@query("""SELECT 'ALL' AS filter, count(*) AS n FROM orders UNION ALL SELECT 'CORRECTION_ONLY', count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders
UNION ALL SELECT 'ORIGINAL_ONLY', count(*) FILTER (WHERE o_orderstatus <> 'P') FROM orders""")
def q05_correction_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    tests = {f: search.metadata_predicate(ORDERS, search.MetadataCondition(correction=f)) for f in ("ALL", "CORRECTION_ONLY", "ORIGINAL_ONLY")}
    counts = _filings(spark, d).agg(*[F.count_if(t).alias(f) for f, t in tests.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f).alias("n")) for f in tests])).alias("x")).select("x.*")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS corrections,
count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q06_scope_stats(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    tests = {"completed": F.col("l_linestatus") == "F", "corrections": F.col("o_orderstatus") == "P", "returned": F.col("l_returnflag") == "R"}
    return search.scope_stats(lines, table(spark, d, "orders"), "o_orderkey", tests)


CHUNK = search.ChunkColumns(report="lang", section="source", body="text", search="search_text")
WORDS = search.ChunkCondition(keywords=("then", "the and", "pour", "en"), section_hints=("src1", "src7"), fact_hints=frozenset({"then"}), top_k=20)


def _chunk_sql(where: str = "") -> str:
    def has(column: str, term: str) -> str:
        return f"instr(lower({column}), '{term}') > 0"

    def when(test: str, value: str) -> str:
        return f"CASE WHEN {test} THEN {value} ELSE 0.0 END"

    ks, hs = WORDS.keywords, WORDS.section_hints
    parts = {
        "report_name_score": " + ".join(when(has("lang", k), "0.25") for k in ks),
        "body_score": " + ".join(f"CASE WHEN {has('text', k)} THEN 1.0 WHEN {has('search_text', k)} THEN 0.5 ELSE 0.0 END" for k in ks),
        "phrase_bonus": " + ".join(when(has("text", k), "0.5") for k in ks if " " in k),
        "fact_hint_bonus": " + ".join(when(has("search_text", k), "0.75") for k in ks if k in WORDS.fact_hints),
        "section_path_score": " + ".join(when(has("source", h), "1.5") for h in hs),
    }
    found = " OR ".join([*(has("search_text", k) for k in ks), *(has("source", h) for h in hs)])
    return f"""SELECT doc_id, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in parts.items())}, ({" + ".join(f"({v})" for v in parts.values())})::DOUBLE AS final_score
FROM (SELECT *, '[' || source || ']' || chr(10) || text AS search_text FROM documents) WHERE {found}"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("search_text", T.search_text(F.col("source"), F.array().cast("array<string>"), F.col("text")))


@query(f"{_chunk_sql()} ORDER BY final_score DESC, doc_id LIMIT 20")
def q07_chunk_search_scored(spark: SparkSession, d: str) -> DataFrame:
    parts = ["report_name_score", "body_score", "phrase_bonus", "fact_hint_bonus", "section_path_score", "final_score"]
    return search.chunk_search(_chunks(spark, d), CHUNK, WORDS, (F.col("doc_id"),)).select("doc_id", *parts)


@query("""SELECT doc_id, array_to_string(list_filter(['worthless', 'idiot', 'token', 'src3'], lambda t: instr(lower(text || chr(10) || source), t) > 0), ',') AS terms FROM documents""")
def q08_matched_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(search.matched_terms(("text", "source"), ("worthless", "idiot", "token", "src3")), ",").alias("terms"))


@query("""SELECT l_orderkey AS o_orderkey, string_agg(l_partkey::VARCHAR, ' | ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS labels, count(*)::INT AS n_sources
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) GROUP BY l_orderkey""")
def q09_chunk_sources_collected(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey").join(hits, "o_orderkey", "left_semi")
    return search.ordered_sources(hits, lines, "o_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "l_suppkey"], [])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def q10_missing_keys_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return search.missing_keys(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey")


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F'
AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'))""")
def q11_verified_semijoin_chain(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    facts = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1")).alias("verified"), F.array("o_orderkey").alias("evidence_ids"))
    proof = lines.select(F.col("l_orderkey").alias("evidence_id"), F.col("l_partkey").alias("document_id"), (F.col("l_linestatus") == "F").alias("verified"))
    _, _, kept = answers.verified_chain(facts, proof, table(spark, d, "part").select(F.col("p_partkey").alias("document_id")))
    return kept.withColumnRenamed("document_id", "p_partkey")


# ---- stored state and expectations ----------------------------------------------------------------------------------


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN a.o_orderkey IS NULL THEN 'created' WHEN b.o_orderkey IS NULL THEN 'missing'
WHEN a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus THEN 'unchanged' ELSE 'updated' END AS action
FROM (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) a FULL JOIN (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus
FROM orders WHERE o_orderkey % 11 <> 0) b ON a.o_orderkey = b.o_orderkey) GROUP BY action""")
def q12_upsert_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    stored = rows.where("o_orderkey % 10 <> 0")
    incoming = rows.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")))
    return quality.upsert_actions(stored, incoming, "o_orderkey").groupBy("action").agg(F.count("*").alias("n"))


@query("""SELECT 'nations' AS metric, count(*) AS actual, 25::BIGINT AS expected, count(*) = 25 AS ok FROM nation UNION ALL SELECT 'regions', count(DISTINCT n_regionkey), 5, count(DISTINCT n_regionkey) = 5 FROM nation
UNION ALL SELECT 'named', count(*) FILTER (WHERE length(trim(n_name)) > 0), 25, count(*) FILTER (WHERE length(trim(n_name)) > 0) = 25 FROM nation""")
def q13_reconciliation_expectations(spark: SparkSession, d: str) -> DataFrame:
    measured = table(spark, d, "nation").agg(F.count("*").alias("nations"), F.countDistinct("n_regionkey").alias("regions"), F.count_if(quality.not_blank("n_name")).alias("named"))
    return quality.reconciled(measured, {"nations": 25, "regions": 5, "named": 25})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q13b_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT 'price' AS rule, count(*) FILTER (WHERE NOT o_totalprice > 0) AS n FROM orders UNION ALL
SELECT 'priority', count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z]')) FROM orders UNION ALL SELECT 'status', count(*) FILTER (WHERE NOT o_orderstatus IN ('F', 'O')) FROM orders""")
def q13c_violations(spark: SparkSession, d: str) -> DataFrame:
    checks = {"price": F.col("o_totalprice") > 0, "priority": F.col("o_orderpriority").rlike("^[1-5]-[A-Z]"), "status": F.col("o_orderstatus").isin("F", "O")}
    return quality.violations(table(spark, d, "orders"), checks)


@query("""SELECT count(*) AS n, (sum(o_totalprice::DECIMAL(18,2)) * 100)::BIGINT AS total_cents FROM (SELECT o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
UNION ALL SELECT o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderstatus = 'F')""")
def q13d_replace_by_document(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    theirs = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    marked = orders.join(theirs, "o_custkey", "left_semi")
    # every customer that has any order of theirs is replaced, those without a fresh one by nothing
    left = quality.replaced(orders, marked.where("o_orderstatus = 'F'"), "o_custkey", marked)
    return left.agg(F.count("*").alias("n"), (F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * 100).cast("long").alias("total_cents"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def q13e_keep_first_by_priority(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return quality.keep_first(orders, "o_custkey", [F.col("o_orderstatus") != "F", -F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS sum_l_linenumber FROM lineitem GROUP BY l_linestatus")
def q13f_batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    return quality.rollup(table(spark, d, "lineitem"), "l_linestatus", ["l_linenumber"])


# ---- text -----------------------------------------------------------------------------------------------------------

_PARAGRAPH = r"""array_to_string(list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
lambda x: trim(regexp_replace(x, '[\p{Zs}\t\f\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"""


@query(f"SELECT doc_id, {_PARAGRAPH} AS body FROM documents")
def q14_paragraph_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.paragraph(F.col("text")).alias("body"))


@query(f"SELECT doc_id, '[' || source || ']' || chr(10) || '소제목: ' || lang || chr(10) || {_PARAGRAPH} AS search_text FROM documents WHERE trim({_PARAGRAPH}) <> ''")
def q15_search_text_build(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("body", T.paragraph(F.col("text"))).where("trim(body) <> ''")
    return docs.select("doc_id", T.search_text(F.col("source"), F.array("lang", F.lit(" ")), F.col("body")).alias("search_text"))


@query()
def q16_sentence_pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_chunks(table(spark, d, "documents").select("doc_id", T.paragraph(F.col("text")).alias("text")))


@query()
def q16b_block_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.text_chunks(_blocks(spark, d).select("doc_id", "sequence_no", "block_type", "text")).drop("headings")


@query("""SELECT event_id, (sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM (SELECT *,
CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS b FROM events)""")
def q17_segment_ids(spark: SparkSession, d: str) -> DataFrame:
    order = ["ts", "event_id"]
    return history.segments(table(spark, d, "events"), "user_id", order, history.changed("event_type", "user_id", order)).select("event_id", "segment")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)::INT AS sequence_no FROM customer")
def q17b_renumbered(spark: SparkSession, d: str) -> DataFrame:
    return history.renumbered(table(spark, d, "customer"), "c_nationkey", ["c_acctbal", "c_custkey"]).select("c_custkey", "sequence_no")


@query("""WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier), p AS (SELECT id, title AS path, 1 AS level FROM nodes WHERE parent IS NULL
UNION ALL SELECT nodes.id, p.path || ' > ' || nodes.title, level + 1 FROM nodes JOIN p ON nodes.parent = p.id) SELECT id, path, level FROM p""")
def q18_section_path_recursive(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), "s_name")
    return sections.paths(region.union(nation).union(supplier)).select("id", "path", "level")


# ---- filings in HTML ------------------------------------------------------------------------------------------------

TAGS = ("p", "h1", "a", "ul", "li", "nav", "script", "style", "footer")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("source"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return markup.blocks(_pages(spark, d), "html")


@query("SELECT page_id AS doc_id, " + ", ".join(rf"len(regexp_extract_all(lower(html), '<{t}[\s>/]')) AS n_{t}" for t in TAGS) + " FROM pages")
def q19_html_tag_profile(spark: SparkSession, d: str) -> DataFrame:
    return markup.html_profile(_pages(spark, d), TAGS)


@query("""SELECT doc_id, (i - 1)::INT AS position, hrefs[i] AS href FROM (SELECT page_id AS doc_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS hrefs FROM pages), unnest(range(1, len(hrefs) + 1)) AS u(i)""")
def q20_html_links(spark: SparkSession, d: str) -> DataFrame:
    return markup.html_links(_pages(spark, d))


@query()
def q21_html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).drop("error")


@query("""SELECT page_id AS doc_id, len(regexp_extract_all(lower(html), '<h[1-6][\\s>/]'))::BIGINT AS headings, len(list_filter(regexp_extract_all(html, '<h1>(.*?)</h1>', 1), x -> trim(x) <> ''))::BIGINT AS parsed,
(length(html) - length(replace(html, '<p>', ''))) // 3 AS paragraphs FROM pages""".replace("x -> ", "lambda x: "))
def q22_profile_vs_parse_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Headings and paragraphs that open in the source, and headings that the parser found."""
    pages = _pages(spark, d)
    count = lambda pattern: F.regexp_count(F.lower("source"), F.lit(pattern)).cast("long")
    counted = pages.select("doc_id", count(r"<h[1-6][\s>/]").alias("headings"), count(r"<p[\s>/]").alias("paragraphs"))
    parsed = markup.tree_metrics(_blocks(spark, d)).select("doc_id", "n_heading")
    return counted.join(parsed, "doc_id", "left").select("doc_id", "headings", F.coalesce("n_heading", F.lit(0)).alias("parsed"), "paragraphs")


# ---- tables of filings, made of orders ------------------------------------------------------------------------------

def _cell(text: Column | str, rows: int = 1, columns: int = 1, kind: str = "DATA") -> Column:
    text = F.lit(text) if isinstance(text, str) else text.cast("string")
    return F.struct(F.lit(kind).alias("type"), F.lit(rows).alias("rowSpan"), F.lit(columns).alias("colSpan"), text.alias("text"))


def _table(*rows: tuple[Column, ...]) -> Column:
    return F.struct(F.array(*[F.struct(F.array(*cells).alias("cells")) for cells in rows]).alias("rows"))


def _head(text: str, rows: int = 1, columns: int = 1) -> Column:
    return _cell(text, rows, columns, "HEADER")


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """A table for each order: a cell over two rows, one over two columns with a table inside, a text of two lines."""
    k, inner = F.col("o_orderkey"), F.array(_table((_cell(F.col("o_orderpriority")),)))
    wide = F.struct(F.lit("DATA").alias("type"), F.lit(1).alias("rowSpan"), F.lit(2).alias("colSpan"), F.col("o_orderstatus").alias("text"), inner.alias("nestedTables"))
    plain = _cell(F.col("o_custkey"), rows=2)
    first = F.struct(*[plain[c].alias(c) for c in ("type", "rowSpan", "colSpan", "text")], F.slice(inner, 1, 0).alias("nestedTables"))
    second = F.struct(F.array(_cell(F.year("o_orderdate")), _cell(F.concat(F.lit("d\n"), k.cast("string")))).alias("cells"))
    rows = [F.to_json(F.struct(F.array(first, wide).alias("cells"))), F.to_json(second)]
    return table(spark, d, "orders").select(k.alias("table_id"), F.concat(F.lit('{"rows":['), rows[0], F.lit(","), rows[1], F.lit("]}")).alias("table_json"))


@query("""SELECT o_orderkey AS table_id, x.path, x.r::INT AS row_index, x.c::INT AS column_index, x.t AS text, x.o AS is_origin, x.n AS continues FROM orders, unnest([
{'path': '', 'r': 0, 'c': 0, 't': o_custkey::VARCHAR, 'o': true, 'n': false}, {'path': '', 'r': 0, 'c': 1, 't': o_orderstatus, 'o': true, 'n': false}, {'path': '', 'r': 0, 'c': 2, 't': '', 'o': false, 'n': false},
{'path': '', 'r': 1, 'c': 0, 't': o_custkey::VARCHAR, 'o': false, 'n': true}, {'path': '', 'r': 1, 'c': 1, 't': year(o_orderdate)::VARCHAR, 'o': true, 'n': false},
{'path': '', 'r': 1, 'c': 2, 't': 'd' || chr(10) || o_orderkey, 'o': true, 'n': false}, {'path': 'rows[0].cells[1].nestedTables[0].', 'r': 0, 'c': 0, 't': o_orderpriority, 'o': true, 'n': false}]) AS u(x)""")
def q23_grid_expand(spark: SparkSession, d: str) -> DataFrame:
    return tables.grid(_grids(spark, d)).select("table_id", "path", "row_index", "column_index", "text", "is_origin", "continues")


@query("""SELECT o_orderkey AS table_id, '' AS path, 1 AS sequence_no, o_custkey || ' | ' || o_orderstatus || chr(10) || o_custkey || ' | ' || year(o_orderdate) || ' | d / ' || o_orderkey AS body, 0 AS first_row, 1 AS last_row FROM orders
UNION ALL SELECT o_orderkey, 'rows[0].cells[1].nestedTables[0].', 1, o_orderpriority, 0, 0 FROM orders""")
def q24_table_chunks(spark: SparkSession, d: str) -> DataFrame:
    return tables.table_chunks(tables.grid_rows(_grids(spark, d)))


@query("""SELECT o_orderkey AS table_id, x.k AS fact_key, x.v AS raw_value, x.u AS unit, x.r::INT AS row_index FROM orders, unnest([
{'k': 'facility.type', 'v': '신설', 'u': NULL, 'r': 0}, {'k': 'facility.amount', 'v': trunc(o_totalprice)::BIGINT::VARCHAR, 'u': '원', 'r': 1}, {'k': 'facility.equity_amount', 'v': o_custkey::VARCHAR, 'u': '백만원', 'r': 2},
{'k': 'facility.equity_ratio', 'v': (o_orderkey % 90) || '.5', 'u': '%', 'r': 3}, {'k': 'facility.purpose', 'v': o_orderpriority, 'u': NULL, 'r': 4}, {'k': 'facility.start_date', 'v': strftime(o_orderdate, '%Y-%m-%d'), 'u': NULL, 'r': 5},
{'k': 'facility.end_date', 'v': strftime(o_orderdate + INTERVAL 30 DAY, '%Y.%m.%d'), 'u': NULL, 'r': 6}, {'k': 'facility.decision_date', 'v': strftime(o_orderdate, '%Y%m%d'), 'u': NULL, 'r': 7}]) AS u(x)
WHERE NOT (o_orderkey % 5 = 0 AND x.r = 2)""")
def q25_evidence_extract(spark: SparkSession, d: str) -> DataFrame:
    """Labels over several rows and columns; every fifth order leaves the value of its equity empty."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    made = _table(
        (_head("1. 투자구분", columns=2), _cell("신설")),
        (_head("2. 투자내역", rows=3), _head("투자금액(원)"), _cell(F.col("o_totalprice").cast("long"))),
        (_head("자기자본(백만원)"), _cell(F.when(k % 5 == 0, " ").otherwise(F.col("o_custkey").cast("string")))),
        (_head("자기자본대비(%)"), _cell(F.concat((k % 90).cast("string"), F.lit(".5")))),
        (_head("3. 투자목적", columns=2), _cell(F.col("o_orderpriority"))),
        (_head("4. 투자기간", rows=2), _head("시작일"), _cell(F.date_format(day, "yyyy-MM-dd"))),
        (_head("종료일"), _cell(F.date_format(F.date_add(day, 30), "yyyy.MM.dd"))),
        (_head("5. 이사회결의일(결정일)", columns=2), _cell(F.date_format(day, "yyyyMMdd"))),
    )
    grids = tables.grid_rows(table(spark, d, "orders").select(k.alias("table_id"), F.to_json(made).alias("table_json")))
    return tables.evidence(grids).select("table_id", "fact_key", "raw_value", "unit", "row_index")


@query("""SELECT o_orderkey AS table_id, 'amount' AS item, o_custkey::VARCHAR AS before, trunc(o_totalprice)::BIGINT::VARCHAR AS after FROM orders UNION ALL
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'end_date' END, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') FROM orders""")
def q26_correction_diff(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of an amount and, but for every third order, of an end date alone; rows before the header are none."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    item = F.when(k % 3 == 0, "4. 투자기간 - 시작일, 종료일").otherwise("4. 투자기간 - 종료일")
    made = _table(
        (_cell("2. 투자금액"), _cell("1"), _cell("2")),
        (_head("정정항목"), _head("정정전"), _head("정정후")),
        (_cell("2. 투자내역 - 투자금액(원)"), _cell(F.col("o_custkey")), _cell(F.col("o_totalprice").cast("long"))),
        (_cell(item), _cell(F.date_format(day, "yyyy-MM-dd")), _cell(F.date_format(F.date_add(day, 30), "yyyy-MM-dd"))),
    )
    grids = tables.grid_rows(table(spark, d, "orders").select(k.alias("table_id"), F.to_json(made).alias("table_json")))
    return tables.corrections(grids).select("table_id", N.correction_item(F.col("item")).alias("item"), "before", "after")


# ---- typed values ---------------------------------------------------------------------------------------------------

def _told(spark: SparkSession, d: str, *texts: Column | str | None) -> DataFrame:
    """o_orderkey and raw: one of the texts for each order, in turn."""
    k = F.col("o_orderkey")
    raw = F.lit(None).cast("string")
    for n, text in enumerate(texts):
        raw = F.when(k % len(texts) == n, F.lit(text) if text is None or isinstance(text, str) else text).otherwise(raw)
    return table(spark, d, "orders").select("*", raw.alias("raw"))


@query("""SELECT o_orderkey, CASE k WHEN 3 THEN 'AMBIGUOUS' WHEN 5 THEN 'AMBIGUOUS' WHEN 6 THEN 'UNMAPPED' WHEN 7 THEN 'MISSING' WHEN 8 THEN 'UNMAPPED' WHEN 10 THEN 'MISSING' ELSE 'MAPPED' END AS status,
CASE k WHEN 0 THEN n * 1000 WHEN 1 THEN n * 1000000 WHEN 2 THEN n * 100000000 + 50000000 WHEN 4 THEN n * 1000 WHEN 9 THEN -n END::VARCHAR AS value FROM (SELECT o_orderkey, o_orderkey % 11 AS k, o_custkey + 1 AS n FROM orders)""")
def q27_krw_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_custkey") + 1
    text = n.cast("string")
    said = (F.concat(F.format_number(n * 1000, 0), F.lit("원")), F.concat(text, F.lit(" 백만원")), F.concat(text, F.lit(".5억원")), text, text, F.concat(text, F.lit("백만원")), F.concat(F.lit("약 "), text, F.lit("원")), "  ", text, F.concat(F.lit("-"), text), None)
    unit = F.element_at(F.create_map(*[F.lit(x) for k, u in ((2, "억원"), (4, "천원"), (5, "억원"), (7, "원"), (8, "달러"), (9, "원")) for x in (k, u)]), (F.col("o_orderkey") % 11).cast("int"))
    return _told(spark, d, *said).select("o_orderkey", N.krw_amount(F.col("raw"), unit).alias("x")).select("o_orderkey", "x.status", "x.value")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (4, 5) THEN 'UNMAPPED' WHEN o_orderkey % 8 = 6 THEN 'MISSING' ELSE 'MAPPED' END AS status,
CASE WHEN o_orderkey % 8 NOT IN (4, 5, 6) THEN strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders""")
def q28_date_normalize(spark: SparkSession, d: str) -> DataFrame:
    said = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "yyyy.M.d", "yyyy년 M월 d일", "yyyyMMdd", "yyyy-02-30")]
    rows = _told(spark, d, *said, "soon", "", F.date_format("o_orderdate", "yyyy.MM.dd."))
    return rows.select("o_orderkey", N.iso_date(F.col("raw")).alias("x")).select("o_orderkey", "x.status", "x.value")


_KINDS = ("신설", "증설", "개보수", "교체", "이전", "기타", "없음", "")


@query("""WITH w AS (SELECT o_orderkey, ['NEW_CONSTRUCTION', 'EXPANSION', 'RENOVATION', 'REPLACEMENT', 'RELOCATION', 'OTHER', NULL, NULL] AS c, o_orderkey % 8 + 1 AS i, (o_orderkey // 8) % 8 + 1 AS j FROM orders),
f AS (SELECT *, len(list_distinct([c[i], c[j]])) AS n FROM w) SELECT o_orderkey, CASE WHEN i = 8 AND j = 8 THEN 'MISSING' WHEN n = 0 THEN 'UNMAPPED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MAPPED' END AS status,
CASE WHEN n = 1 THEN coalesce(c[i], c[j]) END AS value FROM f""")
def q29_type_code(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    words = F.array(*map(F.lit, _KINDS))
    raw = F.concat_ws(" ", F.element_at(words, (k % 8 + 1).cast("int")), F.element_at(words, (F.floor(k / 8) % 8 + 1).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", N.facility_type(raw).alias("x")).select("o_orderkey", "x.status", "x.value")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN 'AMBIGUOUS' WHEN 4 THEN 'UNMAPPED' WHEN 5 THEN 'MISSING' ELSE 'MAPPED' END AS status,
CASE o_orderkey % 6 WHEN 0 THEN o_custkey || '.90' WHEN 1 THEN '1' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '.5' WHEN 2 THEN o_custkey::VARCHAR END AS value FROM orders""")
def q29b_ratio_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_custkey").cast("string")
    thousand = F.concat(F.lit("1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(".5"))
    unit = F.element_at(F.create_map(*[F.lit(x) for k, u in ((1, "%"), (2, "퍼센트"), (3, "배"), (4, "%")) for x in (k, u)]), (F.col("o_orderkey") % 6).cast("int"))
    rows = _told(spark, d, F.concat(n, F.lit(".90%")), thousand, n, n, "x", "")
    return rows.select("o_orderkey", N.ratio(F.col("raw"), unit).alias("x")).select("o_orderkey", "x.status", "x.value")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN (o_custkey + 1) * 1000 END::VARCHAR AS foreign_value, CASE WHEN o_orderkey % 3 = 0 THEN '1' || (o_orderkey % 900 + 100) || '.5' END AS fx_rate FROM orders""")
def q29c_foreign_amount_note(spark: SparkSession, d: str) -> DataFrame:
    """Notes of two bullets: with amount and rate, without rate, and with an amount that isn't the investment's."""
    dollars = F.format_number((F.col("o_custkey") + 1) * 1000, 0)
    amount = F.concat(F.lit("- 기타 사항 USD 5\n- 투자금액은 USD "), dollars)
    rate = F.concat(F.lit(" 이며 환율 1,"), (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit(".5 KRW/USD 를 적용"))
    rows = _told(spark, d, F.concat(amount, rate), amount, F.concat(F.lit("- 차입금은 USD "), dollars))
    return rows.select("o_orderkey", N.foreign_amount(F.col("raw")).alias("x")).select("o_orderkey", "x.foreign_value", "x.fx_rate")


# ---- calculations over facts ----------------------------------------------------------------------------------------

_KEYS = ("amount", "equity", "ratio", "start", "end", "foreign", "rate")
_UNITS = ("KRW", "KRW", "PERCENT", "ISO_DATE", "ISO_DATE", "USD", "KRW_PER_USD")
FACTS_SQL = """facts AS (SELECT l_orderkey AS filing, ['amount', 'equity', 'ratio', 'start', 'end', 'foreign', 'rate'][l_linenumber] AS fact_key,
CASE l_linenumber WHEN 1 THEN floor(l_extendedprice)::BIGINT::VARCHAR WHEN 2 THEN floor(l_extendedprice * 2)::BIGINT::VARCHAR WHEN 3 THEN l_quantity::INT::VARCHAR
WHEN 4 THEN l_shipdate::DATE::VARCHAR WHEN 5 THEN l_shipdate::DATE::VARCHAR WHEN 6 THEN l_quantity::INT::VARCHAR ELSE floor(l_extendedprice / 100)::BIGINT::VARCHAR END AS raw_value,
['KRW', 'KRW', 'PERCENT', 'ISO_DATE', 'ISO_DATE', 'USD', 'KRW_PER_USD'][l_linenumber] AS unit, l_tax < 0.075 AS verified FROM lineitem WHERE l_linenumber <= 7)"""


def facts_of(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as facts: the line's number says which."""
    n, q, p = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string"), F.col("l_extendedprice")
    raw = (
        F.when(n == 1, F.floor(p).cast("string")).when(n == 2, F.floor(p * 2).cast("string")).when(n.isin(3, 6), q)
        .when(n.isin(4, 5), F.col("l_shipdate").cast("date").cast("string")).otherwise(F.floor(p / 100).cast("string"))
    )
    none = F.lit(None).cast("date")
    pick = [F.get(F.array(*map(F.lit, values)), n - 1) for values in (_KEYS, _UNITS)]
    return table(spark, d, "lineitem").where("l_linenumber <= 7").select(F.col("l_orderkey").alias("filing"), pick[0].alias("fact_key"), raw.alias("raw_value"), pick[1].alias("unit"), (F.col("l_tax") < 0.075).alias("verified"), none.alias("period_start"), none.alias("period_end"))


def _paired_sql(keys: tuple[str, ...], filing: str = "filing") -> str:
    columns = ", ".join(f"""max(raw_value) FILTER (WHERE fact_key = '{k}') AS v_{k}, count(*) FILTER (WHERE fact_key = '{k}') AS {k}_n, coalesce(bool_and(verified) FILTER (WHERE fact_key = '{k}'), false) AS {k}_ok""" for k in keys)
    wanted = ", ".join(f"'{k}'" for k in keys)
    return f"{FACTS_SQL}, p AS (SELECT {filing} AS filing, {columns} FROM facts WHERE fact_key IN ({wanted}) GROUP BY 1)"


def _guard_sql(*keys: str) -> str:
    return f"""CASE WHEN {" OR ".join(f"{k}_n > 1" for k in keys)} THEN 'duplicate fact' WHEN {" OR ".join(f"{k}_n = 0" for k in keys)} THEN 'missing fact'
WHEN {" OR ".join(f"NOT {k}_ok" for k in keys)} THEN 'unverified fact' END"""


@query(f"""WITH {_paired_sql(("amount", "equity", "ratio"))}, g AS (SELECT *, {_guard_sql("amount", "equity")} AS reason, ratio_n = 1 AND ratio_ok AS usable,
v_amount::HUGEINT AS a, v_equity::HUGEINT AS b FROM p), r AS (SELECT *, CASE WHEN reason IS NULL THEN (2 * a * (CASE WHEN usable THEN 100 ELSE 1000 END) + b) // (2 * b) END AS x FROM g)
SELECT filing, CASE WHEN reason IS NOT NULL THEN 'NOT_CALCULABLE' WHEN NOT usable THEN 'NOT_COMPARABLE' WHEN x = v_ratio::HUGEINT THEN 'MATCH' ELSE 'MISMATCH' END AS verdict,
CASE WHEN usable THEN x::VARCHAR ELSE (x // 10)::VARCHAR || '.' || (x % 10)::VARCHAR END AS display, reason FROM r""")
def q30_fact_ratio_verdict(spark: SparkSession, d: str) -> DataFrame:
    return calculation.ratio(facts_of(spark, d), "filing", "amount", "equity", "ratio")


@query(f"""WITH {_paired_sql(("foreign", "rate", "amount"))}, g AS (SELECT *, {_guard_sql("foreign", "rate", "amount")} AS reason FROM p), r AS (SELECT *,
CASE WHEN reason IS NULL THEN v_foreign::HUGEINT * v_rate::HUGEINT END AS x FROM g)
SELECT filing, CASE WHEN reason IS NOT NULL THEN 'NOT_CALCULABLE' WHEN x = v_amount::HUGEINT THEN 'MATCH' ELSE 'MISMATCH' END AS verdict, x::VARCHAR AS product, reason FROM r""")
def q31_fact_product_check(spark: SparkSession, d: str) -> DataFrame:
    return calculation.product(facts_of(spark, d), "filing", "foreign", "rate", "amount").withColumn("product", F.col("product").cast("string"))


@query(f"""WITH {_paired_sql(("amount", "equity", "start", "end"), "filing * 3 + CASE WHEN filing % 9 = 0 THEN 0 WHEN fact_key IN ('amount', 'equity') THEN 1 ELSE 2 END")}, g AS (SELECT *, amount_n > 0 OR equity_n > 0 AS m, start_n > 0 OR end_n > 0 AS t FROM p),
r AS (SELECT *, CASE WHEN m AND t THEN 'both kinds' WHEN m THEN ({_guard_sql("amount", "equity")}) ELSE ({_guard_sql("start", "end")}) END AS reason FROM g)
SELECT filing, CASE WHEN reason IS NULL THEN 'NOT_COMPARABLE' ELSE 'NOT_CALCULABLE' END AS verdict, CASE WHEN reason IS NULL AND m THEN (v_equity::BIGINT - v_amount::BIGINT)::VARCHAR END AS amount_change,
CASE WHEN reason IS NULL AND t THEN (v_end::DATE - v_start::DATE)::VARCHAR END AS days_change, reason FROM r""")
def q32_difference_delay(spark: SparkSession, d: str) -> DataFrame:
    # every fact stays: money and dates of an order are filings of their own, or one of both kinds
    money = F.col("fact_key").isin("amount", "equity")
    case = F.when(F.col("filing") % 9 == 0, 0).when(money, 1).otherwise(2)
    facts = facts_of(spark, d).withColumn("filing", F.col("filing") * 3 + case)
    out = calculation.difference(facts, "filing", ("amount", "equity"), ("start", "end"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("amount_change", "days_change")})


@query(f"""WITH {_paired_sql(("start", "end"))}, g AS (SELECT *, coalesce({_guard_sql("start", "end")}, CASE WHEN v_end::DATE < v_start::DATE THEN 'end before start' END) AS reason FROM p)
SELECT filing, CASE WHEN reason IS NULL THEN 'NOT_COMPARABLE' ELSE 'NOT_CALCULABLE' END AS verdict, CASE WHEN reason IS NULL THEN (v_end::DATE - v_start::DATE + 1)::VARCHAR END AS days, reason FROM g""")
def q33_duration_days(spark: SparkSession, d: str) -> DataFrame:
    return calculation.duration(facts_of(spark, d), "filing", "start", "end").withColumn("days", F.col("days").cast("string"))


@query("SELECT o_custkey, round((max(o_totalprice) - min(o_totalprice)) / min(o_totalprice) * 100, 4) AS change_rate FROM orders GROUP BY o_custkey")
def q34_change_rate(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    return ends.select("o_custkey", F.round(calculation.change_rate(F.col("a"), F.col("b")), 4).alias("change_rate"))


@query(f"""WITH {FACTS_SQL}, s AS (SELECT filing, bool_and(verified) AS ok, sum(raw_value::BIGINT) AS t, count(*) AS n FROM facts WHERE fact_key = 'amount' GROUP BY filing)
SELECT filing, CASE WHEN ok THEN t::VARCHAR END AS total, CASE WHEN ok THEN ((200 * t + n) // (2 * n))::VARCHAR END AS average_cents, CASE WHEN ok THEN 'NOT_COMPARABLE' ELSE 'NOT_CALCULABLE' END AS verdict FROM s""")
def q35_sum_average(spark: SparkSession, d: str) -> DataFrame:
    out = calculation.same_basis_totals(facts_of(spark, d), "filing", "amount", "KRW")
    return out.select("filing", F.col("total").cast("string").alias("total"), (F.col("average") * 100).cast("long").cast("string").alias("average_cents"), "verdict")


@query("SELECT p_partkey, round(p_size * 1000000.0 / 1000.0, 2)::DOUBLE AS in_thousands FROM part")
def q36_unit_convert(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(calculation.converted(F.col("p_size").cast("double"), F.lit("백만원"), F.lit("천원")), 2).alias("in_thousands"))


@query("SELECT o_custkey, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 6)::DOUBLE AS dilution FROM orders GROUP BY o_custkey")
def q37_share_dilution(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "O").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return n.select("o_custkey", F.round(calculation.dilution(F.col("a").cast("double"), F.col("b").cast("double")), 6).alias("dilution"))


# ---- versions over time ---------------------------------------------------------------------------------------------


@query("""SELECT q.event_id, arg_max(v.value, (v.ts, v.event_id)) AS value_as_of FROM (SELECT * FROM events WHERE event_type = 'purchase') q
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = q.user_id AND v.ts <= q.ts GROUP BY q.event_id""")
def q38_as_of_selection(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = history.as_of_join(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), "user_id", "ts", "ts", "event_id", "value")
    return out.select("event_id", "value_as_of")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate <= DATE '1997-01-01') WHERE r = 1""")
def q39_latest_as_of(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_as_of(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", F.lit(date(1997, 1, 1))).select("o_custkey", "o_orderkey")


@query("""SELECT event_id, row_number() OVER w::INT AS version, lag(value) OVER w AS previous, epoch_us(lead(ts) OVER w)::VARCHAR AS valid_to_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q40_full_history(spark: SparkSession, d: str) -> DataFrame:
    out = history.full_history(table(spark, d, "events"), "user_id", "ts", "event_id", "value")
    return out.select("event_id", "version", "previous", F.unix_micros(F.col("valid_to").cast("timestamp")).cast("string").alias("valid_to_us"))


# ---- answers --------------------------------------------------------------------------------------------------------

REQUIRED = ("amount", "equity", "start")
_OUTCOME_SQL = f"""{FACTS_SQL}, c AS (SELECT filing, count(DISTINCT fact_key) FILTER (WHERE verified AND fact_key IN ('amount', 'equity', 'start')) AS n FROM facts GROUP BY filing)"""


@query(f"WITH {_OUTCOME_SQL} SELECT filing, n::INT AS n_present, CASE n WHEN 0 THEN 'UNANSWERABLE' WHEN 3 THEN 'COMPLETED' ELSE 'PARTIAL' END AS outcome FROM c")
def q41_answer_outcome(spark: SparkSession, d: str) -> DataFrame:
    return answers.outcomes(facts_of(spark, d), "filing", REQUIRED)


@query("""SELECT 'fact-filing' AS relation, count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS n FROM lineitem
UNION ALL SELECT 'filing-company', count(DISTINCT o_custkey) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) FROM orders""")
def q42_reference_integrity(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    a = answers.dangling(table(spark, d, "lineitem"), "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey", "fact-filing")
    return a.union(answers.dangling(orders, "o_custkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey", "filing-company"))


@query("""SELECT conv_id, turn, array_to_string(list_filter(['the', 'guarantee', 'pour la'], lambda p: instr(lower(text), p) > 0), '|') AS phrases FROM conversations
WHERE instr(lower(text), 'the') > 0 OR instr(lower(text), 'guarantee') > 0 OR instr(lower(text), 'pour la') > 0""")
def q43_forbidden_phrases(spark: SparkSession, d: str) -> DataFrame:
    out = answers.forbidden(table(spark, d, "conversations"), "text", ("the", "guarantee", "pour la"))
    return out.select("conv_id", "turn", F.array_join("phrases", "|").alias("phrases"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 80 AS a, o_orderkey % 10 AS b FROM orders) SELECT id, 'ratio' AS kind, (a + 1)::VARCHAR AS value FROM o WHERE b < 5
UNION ALL SELECT id, 'date', '2024-01-03' FROM o WHERE id % 4 = 0""")
def q44_answer_number_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Answers name a ratio as disclosed and one rounded up, which holds from .5 on; every fourth another date."""
    k = F.col("o_orderkey")
    own = F.concat((k % 80).cast("string"), F.lit("."), (k % 10).cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.concat(F.lit("The ratio is "), own, F.lit("% and not "), (k % 80 + 1).cast("string"), F.lit("%, as of "), day, F.when(k % 4 == 0, " or 2024.01.03.").otherwise("."))
    rows = table(spark, d, "orders").select(k.alias("id"), said.alias("text"), own.alias("ratio"), day.alias("day"))
    known = rows.select("id", F.explode(F.array(F.struct(F.lit("ratio").alias("kind"), F.col("ratio").alias("value")), F.struct(F.lit("date").alias("kind"), F.col("day").alias("value")))).alias("x")).select("id", "x.kind", "x.value")
    return answers.unsupported_mentions(rows.select("id", "text"), "id", "text", known)


@query(f"WITH {_OUTCOME_SQL} SELECT count(*) AS n_filings, count(*) FILTER (WHERE n = 3) AS n_ready, count(*) = count(*) FILTER (WHERE n = 3) AS ready FROM c")
def q46_readiness(spark: SparkSession, d: str) -> DataFrame:
    return answers.readiness(facts_of(spark, d), "filing", REQUIRED)


@query(f"""SELECT string_agg(format('[{{}}] receipt_no={{}} | report_name={{}}' || chr(10) || '{{}}', n, p_partkey, p_name, p_type), chr(10) ORDER BY n) AS retrieved_contexts, count(*) AS n_contexts
FROM (SELECT *, row_number() OVER (ORDER BY title_score DESC, p_size DESC, p_partkey) AS n FROM (SELECT *, {_TITLE_SCORE} AS title_score FROM part WHERE {_TITLE_FILTER}) ORDER BY n LIMIT 20)""")
def q49_response_text(spark: SparkSession, d: str) -> DataFrame:
    """The contexts of a ranked search, numbered in its order."""
    order = (F.col("p_size").desc(), F.col("p_partkey"))
    hits = search.metadata_search(table(spark, d, "part"), table(spark, d, "lineitem").select("l_partkey"), "l_partkey", PART, TITLES, order)
    numbered = hits.withColumn("n", F.row_number().over(Window.orderBy(F.col("title_score").desc(), *order)))  # at most 20 rows
    return answers.response(numbered, "n", "p_partkey", "p_name", "p_type")


@query(f"""WITH {FACTS_SQL} SELECT filing, count(*) AS n_facts FROM facts WHERE verified AND fact_key IN ('amount', 'equity', 'start')
AND filing IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= DATE '1996-06-30' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) GROUP BY filing""")
def q45_plan_execution(spark: SparkSession, d: str) -> DataFrame:
    """A plan of a search and a lookup bound to it, compiled into one lineage."""

    def find(given: dict, _: dict[str, DataFrame]) -> DataFrame:
        cond = search.MetadataCondition(as_of=date.fromisoformat(given["asOf"]), limit=given["limit"])
        rows = search.metadata_candidates(_filings(spark, d), ORDERS, cond)
        return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(cond.limit).select(F.col("o_orderkey").alias("filing"))

    def look_up(given: dict, before: dict[str, DataFrame]) -> DataFrame:
        facts = facts_of(spark, d).where(F.col("verified") & F.col("fact_key").isin(*given["factKeys"]))
        return facts.join(before[given["disclosureIdsFrom"]], "filing", "left_semi")

    steps = (question.Step("s1", question.SEARCH, {"asOf": "1996-06-30", "limit": 50}), question.Step("s2", question.LOOKUP, {"disclosureIdsFrom": "s1", "factKeys": ["amount"]}))
    plan = question.with_required_facts(question.Plan(steps), REQUIRED)
    frames, _ = question.compiled(plan, {question.SEARCH: find, question.LOOKUP: look_up})
    return frames["s2"].groupBy("filing").agg(F.count("*").alias("n_facts"))


# ---- windows over events, as the streams have them ------------------------------------------------------------------


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def q47_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming import events

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.windowed(rows).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("""SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
def q48_session_windows(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming import events

    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(rows).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT page_id, CASE WHEN host = 'dart' THEN 'MAIN' ELSE 'UNKNOWN' END AS role, 'HTML' AS content_format, sha256(html) AS sha256 FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'dart' ELSE '' END AS host FROM pages)")
def q50_file_description(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lpad(F.col("page_id").cast("string"), 14, "0"), F.lit(".html"))).otherwise("x.html")
    raw = table(spark, d, "pages").select("page_id", F.concat(F.lit("/in/"), name).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return files.described(raw).select("page_id", "role", "content_format", "sha256")


# ---- further operators ----------------------------------------------------------------------------------------------


@query("""SELECT user_id, string_agg(event_type || '=' || n, ', ' ORDER BY event_type) AS summary FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def q51_counts_as_text(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # as many entries as there are event types
    return counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")).select("user_id", quality.sorted_pairs(F.col("m")).alias("summary"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'DART' WHEN o_orderkey % 5 = 1 THEN 'KRX' END AS system, CASE WHEN o_orderkey % 5 < 2 THEN lpad(o_orderkey::VARCHAR, 14, '2') END AS number FROM orders""")
def q52_link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Links to two systems, one with too short a number, one with two numbers, and none."""
    own = F.lpad(F.col("o_orderkey").cast("string"), 14, "2")
    dart = F.concat(F.lit("http://dart.fss.or.kr/x?rcpNo="), own)
    rows = _told(spark, d, dart, F.concat(F.lit("https://kind.krx.co.kr/a?acptNo="), own, F.lit("&x=1#y")), "http://dart.fss.or.kr/x?rcpNo=1", F.concat(dart, F.lit("&rcpNo=30240101000001")), None)
    return rows.select("o_orderkey", markup.link_target(F.col("raw")).alias("t")).select("o_orderkey", "t.system", "t.number")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN a * 1000000000000 + b * 100000000 WHEN 1 THEN a * 10000 + b WHEN 2 THEN b * 100000000 END::VARCHAR AS value FROM (SELECT o_orderkey, o_orderkey % 90 + 1 AS a, o_custkey % 9000 + 1000 AS b FROM orders)""")
def q53_korean_money(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.col("o_orderkey") % 90 + 1).cast("string"), F.format_number(F.col("o_custkey") % 9000 + 1000, 0)
    rows = _told(spark, d, F.concat(a, F.lit("조 "), b, F.lit("억 원")), F.concat(a, F.lit("만 "), b, F.lit(" 원")), F.concat(b, F.lit("억원")), "없음")
    return rows.select("o_orderkey", N.korean_money(F.col("raw")).cast("string").alias("value"))


@query("""SELECT name, count(p_partkey) AS n, CASE count(p_partkey) WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status
FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'no such name') LEFT JOIN part ON p_name = name GROUP BY name""")
def q54_company_resolution(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    asked = parts.select(F.col("p_name").alias("name")).union(spark.createDataFrame([("no such name",)], "name string")).distinct()
    return question.resolved_company(parts, "p_name", asked)


@query(f"""WITH {FACTS_SQL}, c AS (SELECT filing, list(DISTINCT raw_value ORDER BY raw_value) AS v, fact_key FROM facts WHERE verified GROUP BY filing, fact_key)
SELECT filing, fact_key, array_to_string(v, chr(10)) AS texts, len(v) > 1 AS ambiguous FROM c""")
def q55_facts_by_key(spark: SparkSession, d: str) -> DataFrame:
    grouped = facts_of(spark, d).where("verified").groupBy("filing", "fact_key").agg(F.array_sort(F.collect_set("raw_value")).alias("v"))
    return grouped.select("filing", "fact_key", F.array_join("v", "\n").alias("texts"), (F.size("v") > 1).alias("ambiguous"))


@query(f"""WITH {FACTS_SQL}, k AS (SELECT * FROM (VALUES ('amount'), ('equity'), ('ratio')) AS t(fact_key)), f AS (SELECT DISTINCT filing FROM facts)
SELECT filing, fact_key FROM f, k WHERE NOT EXISTS (SELECT 1 FROM facts x WHERE x.filing = f.filing AND x.fact_key = k.fact_key AND x.verified)""")
def q56_missing_core_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = facts_of(spark, d)
    wanted = facts.select("filing").distinct().select("filing", F.explode(F.array(*map(F.lit, ("amount", "equity", "ratio")))).alias("fact_key"))
    return wanted.join(facts.where("verified").select("filing", "fact_key"), ["filing", "fact_key"], "left_anti")


@query(f"""WITH h AS ({_chunk_sql()}) SELECT 'finite_score' AS rule, count(*) FILTER (WHERE doc_id % 7 = 2 AND doc_id % 10 <> 3) AS n FROM h
UNION ALL SELECT 'score_is_its_parts', count(*) FILTER (WHERE doc_id % 7 = 2 OR doc_id % 10 = 3) FROM h UNION ALL SELECT 'all', count(*) FROM h""")
def q57_hit_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Hits, of which some have a score beside their parts and some none that is finite; all counts them."""
    parts = list(search.chunk_scores(CHUNK, WORDS))[:-1]
    hits = _chunks(spark, d).where(search.chunk_predicate(CHUNK, WORDS)).withColumns(search.chunk_scores(CHUNK, WORDS))
    wrong = F.when(F.col("doc_id") % 10 == 3, F.col("final_score") + 1).when(F.col("doc_id") % 7 == 2, float("nan")).otherwise(F.col("final_score"))
    return quality.violations(hits.withColumn("final_score", wrong), invariants.hit_rules(parts) | {"all": F.lit(False)})


@query(f"""WITH {FACTS_SQL} SELECT 'fact_key' AS rule, count(*) AS n FROM facts WHERE NOT regexp_matches('f.' || fact_key, '^[a-z][a-z0-9_]*(\\.[a-z][a-z0-9_]*)+$')
UNION ALL SELECT 'receipt_no', count(*) FILTER (WHERE filing % 5 = 0) FROM facts UNION ALL SELECT 'verified_has_evidence', count(*) FILTER (WHERE verified AND filing % 7 = 0) FROM facts""")
def q58_fact_invariants(spark: SparkSession, d: str) -> DataFrame:
    made = facts_of(spark, d).select(
        F.when(F.col("unit").isin("KRW", "PERCENT", "USD", "KRW_PER_USD"), "DECIMAL").otherwise("DATE").alias("value_type"), F.lit("AVAILABLE").alias("availability"), "raw_value", F.col("unit").alias("raw_unit"),
        F.col("raw_value").try_cast("decimal(20,2)").alias("decimal_value"), F.when(F.col("unit") == "ISO_DATE", F.try_to_date("raw_value")).alias("date_value"), F.lit(None).cast("string").alias("text_value"), "unit",
        F.when(F.col("unit") == "KRW", "KRW").alias("currency"), F.lit("RAW").alias("method"), F.lit(None).cast("string").alias("policy_version"), F.when(F.col("verified"), "VERIFIED").otherwise("UNVALIDATED").alias("status"),
        F.when(F.col("filing") % 7 != 0, F.array(F.lit("e"))).alias("evidence_ids"), "period_start", "period_end", F.concat(F.lit("f."), "fact_key").alias("fact_key"),
        F.when(F.col("filing") % 5 != 0, F.lpad(F.col("filing").cast("string"), 14, "0")).otherwise("short").alias("receipt_no"),
    )
    rules = invariants.fact_rules()
    return quality.violations(made, {k: rules[k] for k in ("fact_key", "receipt_no", "verified_has_evidence")})


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) >= 20 AND len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) = 1))
>= 0.35 * len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) OR instr(text, chr(65533)) > 0 AS suspicious FROM documents""")
def q59_suspicious_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.suspicious(F.col("text")).alias("suspicious"))


@query("SELECT event_id FROM events")
def q60_stream_without_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as a stream, drained through a deduplication into a table of the session's folder."""
    import uuid

    from lodestone.shared import remove, shared_folder
    from lodestone.streaming import events

    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a glob of one name, as a stream takes a plain path for a folder, and a table may be one file
    rows = events.source(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)
    # a batch that is done again after a failure replaces itself
    events.drained(events.deduplicated(rows, "event_id", late=None), f"{out}/state", lambda df, n: df.select("event_id").write.mode("overwrite").parquet(f"{out}/rows/batch={n}"))
    remove(spark, f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("event_id")


import lodestone.catalog_filings  # noqa: E402, F401  registers the queries of whole filings
