"""Ranked search over filings and over their text chunks: literal containment, additive scores, total orders."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(column: str, term: str) -> Column:
    """Literal, case-folded containment."""
    return F.instr(F.lower(F.col(column)), term.lower()) > 0


def title_score(column: str, terms: tuple[str, ...]) -> Column:
    """3 for an equal title, 2 for a prefix, 1 for containment, summed over the terms."""
    low = F.lower(F.col(column))

    def one(term: str) -> Column:
        at = F.instr(low, term.lower())
        return F.when(low == term.lower(), 3.0).when(at == 1, 2.0).when(at > 0, 1.0).otherwise(0.0)

    return reduce(add, map(one, terms), F.lit(0.0))


@dataclass(frozen=True)
class MetadataCondition:
    """What to look for among filings; empty sets don't restrict."""

    title_terms: tuple[str, ...] = ()
    company_ids: tuple[int, ...] = ()
    source_groups: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    subtypes: tuple[str, ...] = ()
    date_from: date | None = None
    date_to: date | None = None
    as_of: date | None = None
    correction: str = "ALL"  #: or ORIGINAL_ONLY, CORRECTION_ONLY
    limit: int = 20

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 50:
            raise ValueError("limit lies between 1 and 50")
        if self.correction not in ("ALL", "ORIGINAL_ONLY", "CORRECTION_ONLY"):
            raise ValueError(f"unknown correction filter {self.correction}")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")
        if self.date_from and self.as_of and self.date_from > self.as_of:
            raise ValueError("date_from is after as_of")

    @property
    def effective_to(self) -> date | None:
        """The earlier of date_to and as_of, of those that are given."""
        return min((d for d in (self.date_to, self.as_of) if d), default=None)


@dataclass(frozen=True)
class FilingColumns:
    """Names of a filings table's columns; None where it has none."""

    key: str
    title: str
    category: str | None = None
    subtype: str | None = None
    group: str | None = None
    company: str | None = None
    filed_on: str | None = None
    correction: str | None = None


def metadata_predicate(c: FilingColumns, cond: MetadataCondition) -> Column:
    parts = [F.col(name).isin(*values) for name, values in ((c.company, cond.company_ids), (c.group, cond.source_groups), (c.category, cond.categories), (c.subtype, cond.subtypes)) if name and values]
    if c.filed_on and cond.date_from:
        parts.append(F.col(c.filed_on) >= F.lit(cond.date_from))
    if c.filed_on and cond.effective_to:
        parts.append(F.col(c.filed_on) <= F.lit(cond.effective_to))
    if c.correction and cond.correction != "ALL":
        parts.append(F.col(c.correction) == F.lit(cond.correction == "CORRECTION_ONLY"))
    # titles restrict only where nothing structured does; otherwise they rank
    if cond.title_terms and not (cond.source_groups or cond.categories or cond.subtypes):
        parts.append(reduce(or_, [contains(c.title, t) for t in cond.title_terms]))
    return reduce(and_, parts, F.lit(True))


def metadata_candidates(filings: DataFrame, c: FilingColumns, cond: MetadataCondition) -> DataFrame:
    return filings.where(metadata_predicate(c, cond))


def metadata_search(filings: DataFrame, documents: DataFrame, document_key: str, c: FilingColumns, cond: MetadataCondition, order: tuple[Column, ...]) -> DataFrame:
    """The best filings with their score and number of documents.

    The limit comes first, so the documents are counted for as many filings as it has, and they alone are looked up.
    """
    hits = metadata_candidates(filings, c, cond).withColumn("title_score", title_score(c.title, cond.title_terms))
    hits = hits.orderBy(F.col("title_score").desc(), *order).limit(cond.limit)
    # at most 50 rows by the condition's own check
    counts = documents.join(F.broadcast(hits.select(F.col(c.key).alias("_key"))), F.col(document_key) == F.col("_key")).groupBy("_key").agg(F.count("*").alias("document_count"))
    return hits.join(counts, hits[c.key] == counts["_key"], "left").drop("_key").withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def candidate_summary(candidates: DataFrame, limit: int) -> DataFrame:
    """candidate_count before the limit, returned and truncated."""
    return candidates.agg(F.count("*").alias("candidate_count")).select("candidate_count", F.least("candidate_count", F.lit(limit)).alias("returned"), (F.col("candidate_count") > limit).alias("truncated"))


@dataclass(frozen=True)
class ChunkCondition:
    keywords: tuple[str, ...] = ()
    section_hints: tuple[str, ...] = ()
    fact_hints: frozenset[str] = field(default_factory=frozenset)
    chunk_types: tuple[str, ...] = ("TEXT", "TABLE")
    top_k: int = 10
    neighbor_radius: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 20:
            raise ValueError("top_k lies between 1 and 20")
        if self.neighbor_radius != 0:
            raise ValueError("only a neighbor radius of 0 is served")
        if not set(self.chunk_types) <= {"TEXT", "TABLE"}:
            raise ValueError("chunks are TEXT or TABLE")


@dataclass(frozen=True)
class ChunkColumns:
    report: str
    section: str
    body: str
    search: str
    kind: str | None = None
    status: str | None = None


def chunk_predicate(c: ChunkColumns, cond: ChunkCondition) -> Column:
    """Any keyword in the search text or any hint in the section path; nothing without either."""
    signals = [contains(c.search, k) for k in cond.keywords] + [contains(c.section, h) for h in cond.section_hints]
    found = reduce(or_, signals, F.lit(False))
    if c.status:
        found = found & (F.col(c.status) == "COMPLETED")
    return found & F.col(c.kind).isin(*cond.chunk_types) if c.kind else found


def chunk_scores(c: ChunkColumns, cond: ChunkCondition) -> dict[str, Column]:
    """All parts of the score; every addend is a multiple of 0.25, so sums are exact in any order."""

    def total(values: list[Column]) -> Column:
        return reduce(add, values, F.lit(0.0))

    def when(test: Column, value: float) -> Column:
        return F.when(test, value).otherwise(0.0)

    ks = cond.keywords
    parts = {
        "report_name_score": total([when(contains(c.report, k), 0.25) for k in ks]),
        "body_score": total([F.when(contains(c.body, k), 1.0).when(contains(c.search, k), 0.5).otherwise(0.0) for k in ks]),
        "phrase_bonus": total([when(contains(c.body, k), 0.5) for k in ks if " " in k]),
        "fact_hint_bonus": total([when(contains(c.search, k), 0.75) for k in ks if k in cond.fact_hints]),
        "section_path_score": total([when(contains(c.section, h), 1.5) for h in cond.section_hints]),
        "correction_weight": F.lit(0.0),
    }
    return parts | {"final_score": reduce(add, parts.values())}


def chunk_search(chunks: DataFrame, c: ChunkColumns, cond: ChunkCondition, order: tuple[Column, ...]) -> DataFrame:
    """The best chunks with the parts of their scores; an empty result without any signal."""
    scored = chunks.where(chunk_predicate(c, cond)).withColumns(chunk_scores(c, cond))
    return scored.orderBy(F.col("final_score").desc(), *order).limit(cond.top_k)


class ScopeError(ValueError):
    """Names filings or documents that were asked for and aren't there."""


@dataclass(frozen=True)
class ChunkScope:
    """Where to look for chunks; empty sets don't restrict."""

    provider: str = "CONTEST"
    disclosure_ids: tuple[int, ...] = ()
    document_ids: tuple[int, ...] = ()


def missing_scope(scope: ChunkScope, documents: DataFrame, disclosures: DataFrame) -> DataFrame:
    """kind and id of what the scope names but the provider doesn't have; documents must belong to the filings named."""
    spark = documents.sparkSession

    def asked(ids: tuple[int, ...], kind: str) -> DataFrame:
        return spark.createDataFrame([(i, kind) for i in ids], "id long, kind string")

    own = disclosures.where(F.col("provider") == scope.provider)
    if scope.disclosure_ids:
        own = own.where(F.col("disclosure_id").isin(*scope.disclosure_ids))
    gone = asked(scope.disclosure_ids, "DISCLOSURE").join(own.select(F.col("disclosure_id").alias("id")), "id", "left_anti")
    within = documents.join(own.select("disclosure_id"), "disclosure_id", "left_semi")
    return gone.union(asked(scope.document_ids, "DOCUMENT").join(within.select(F.col("document_id").alias("id")), "id", "left_anti"))


def checked(scope: ChunkScope, documents: DataFrame, disclosures: DataFrame) -> ChunkScope:
    """The scope, or a ScopeError; as many rows come to the driver as the scope names."""
    if scope.disclosure_ids or scope.document_ids:
        gone = sorted(f"{r['kind']} {r['id']}" for r in missing_scope(scope, documents, disclosures).collect())
        if gone:
            raise ScopeError("not found: " + ", ".join(gone))
    return scope


def scoped_chunks(chunks: DataFrame, documents: DataFrame, disclosures: DataFrame, scope: ChunkScope) -> DataFrame:
    """Chunks with their document and filing (document_id, disclosure_id, company_id, provider), within the scope."""
    filings = disclosures.where(F.col("provider") == scope.provider)
    if scope.disclosure_ids:
        filings = filings.where(F.col("disclosure_id").isin(*scope.disclosure_ids))
    if scope.document_ids:
        documents = documents.where(F.col("document_id").isin(*scope.document_ids))
    return chunks.join(documents, "document_id").join(filings, "disclosure_id")


def scoped_search(chunks: DataFrame, documents: DataFrame, disclosures: DataFrame, companies: DataFrame, c: ChunkColumns, cond: ChunkCondition, order: tuple[Column, ...], scope: ChunkScope | None = None) -> tuple[DataFrame, DataFrame]:
    """The best chunks with their company, and the one-row summary of all candidates.

    Companies are looked up for the hits alone, so neither the count nor the ranking reads them.
    """
    found = scoped_chunks(chunks, documents, disclosures, checked(scope or ChunkScope(), documents, disclosures))
    hits = chunk_search(found, c, cond, order)
    summary = candidate_summary(found.where(chunk_predicate(c, cond)), cond.top_k)
    return hits.join(companies, "company_id"), summary


def matched_terms(columns: tuple[str, ...], terms: tuple[str, ...]) -> Column:
    """Those terms that stand in any of the columns, in the order given."""
    text = F.lower(F.concat_ws("\n", *columns))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.instr(text, F.lower(t)) > 0)


def missing_keys(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct keys of rows that known doesn't have."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def scope_stats(documents: DataFrame, filings: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """One row: total and a filtered count for each test, over documents with their filing."""
    return documents.join(filings, key).agg(F.count("*").alias("total"), *[F.count_if(test).alias(name) for name, test in tests.items()])


def ordered_sources(parents: DataFrame, children: DataFrame, key: str, label: str, order: list[str], payload: list[str]) -> DataFrame:
    """Each parent's children gathered in order, as an ordered text of labels and a count. A parent has few children."""
    made = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *payload))).alias("_c"))
    made = made.select(key, F.array_join(F.transform("_c", lambda x: x[label].cast("string")), " | ").alias("labels"), F.size("_c").alias("n_sources"))
    return parents.join(made, key)
