"""References of answers: claims, calculations, facts, evidence and documents as one graph whose edges are checked together.

All frames have ``answer``, so many answers are checked at once, and ``position``, the order in which an answer has its rows:

* documents: document_id
* evidence: evidence_id, document_id, status
* facts: fact_id, status, evidence_ids
* calculations: operation, fact_ids
* claims: kind, operation, fact_ids, evidence_ids

What is there and every reference to it become rows of one table, which meet in one window by answer, kind and id. Frames that are
dealt by answer already stay where they are; others are dealt by that whole key, so a hot answer is spread and nothing is gathered
by answer. What is gathered is the evidence of facts of one id. A null or blank id names nothing, and is a problem where it is the
own one; null lists are empty ones. Only status VERIFIED is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order in which checks come; the first problem of an answer is the one of the first check, in the order of its rows.
CHECKS = ("document", "evidence", "fact", "evidence-document", "fact-evidence", "calculation-fact", "claim-fact", "claim-evidence", "claim-proof", "claim-calculation")


#: What can be named. The own problems of a document, evidence or fact are those of the check of that number.
KINDS = ("document", "evidence", "fact", "calculation")
#: Problems that are said once, however often they are found.
_ONCE = ("REPEATED_ID", "MISSING_PROOF")


def _step(name: str) -> Column:
    return F.lit(CHECKS.index(name)).cast("tinyint")


def _listed(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _verified() -> Column:
    return F.coalesce(F.col("status") == "VERIFIED", F.lit(False))


def _row(kind: str, own: Column, step: Column, verified: Column, more: Column) -> Column:
    fields = {"kind": F.lit(KINDS.index(kind)).cast("tinyint"), "id": own.cast("string"), "step": step.cast("tinyint"), "verified": verified.cast("boolean"), "more": more.cast("array<string>")}
    return F.struct(*[x.alias(name) for name, x in fields.items()])


def _thing(kind: str, own: Column, verified: Column, more: Column | None = None) -> Column:
    """Something that can be named; a fact with its evidence."""
    return _row(kind, own, F.lit(None), verified, F.lit(None) if more is None else more)


def _edge(relation: str, target: Column, more: Column | None = None) -> Column:
    """What names a thing, as the check of that name sees it."""
    return _row(relation.split("-")[1], target, _step(relation), F.lit(None), F.lit(None) if more is None else more)


def _edges(relation: str, column: str) -> Column:
    return F.transform(_listed(column), lambda x: _edge(relation, x))


def _computed() -> Column:
    """The operation and the facts of a calculation, whatever their order, as one text; null without an operation."""
    facts = F.array_sort(F.array_distinct(_listed("fact_ids")))
    parts = F.transform(F.concat(F.array("operation"), facts), lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.when(F.col("operation").isNotNull(), F.array_join(parts, ""))


def graph(documents: DataFrame, evidence: DataFrame, facts: DataFrame, calculations: DataFrame, claims: DataFrame) -> DataFrame:
    """answer, position, kind, id, step, verified, more: things (no step) and edges (the step of their check), each frame read once.

    kind and id are the own ones of a thing, and those of what an edge names; more is the evidence of a fact, and the operation that
    a claim of a calculation asks for.
    """
    asked = F.when(F.col("kind") == "CALCULATION", F.array(_edge("claim-calculation", _computed(), F.array("operation"))))
    rows = (
        (documents, F.array(_thing("document", F.col("document_id"), F.lit(True)))),
        (evidence, F.array(_thing("evidence", F.col("evidence_id"), _verified()), _edge("evidence-document", F.col("document_id")))),
        (facts, F.concat(F.array(_thing("fact", F.col("fact_id"), _verified(), _listed("evidence_ids"))), _edges("fact-evidence", "evidence_ids"))),
        (calculations, F.concat(F.array(_thing("calculation", _computed(), F.lit(True))), _edges("calculation-fact", "fact_ids"))),
        (claims, F.concat(_edges("claim-fact", "fact_ids"), _edges("claim-evidence", "evidence_ids"), F.coalesce(asked, F.slice(F.array(_edge("claim-calculation", F.lit(None))), 1, 0)))),
    )
    first, *others = [_in_rows(frame.select("answer", "position", made.alias("made")), "made").where("kind is not null") for frame, made in rows]
    for more in others:
        first = first.union(more)
    return first


def _in_rows(rows: DataFrame, column: str) -> DataFrame:
    """rows with the fields of an array in place of it; from a column that is made before, as what is made inside inline isn't compiled, and
    outer, as else its size is asked for by making it twice. An empty array is a row of nulls."""
    return rows.select(*[c for c in rows.columns if c != column], F.inline_outer(column))


def _said(step: Column, position: Column, own: Column, problem: Column, given: bool = False) -> Column:
    return F.struct(step.alias("step"), position.alias("position"), own.alias("id"), problem.alias("problem"), F.lit(given).alias("given"))


def _found(rows: DataFrame) -> DataFrame:
    """answer, step, position, id, problem, given: problems of things and edges, proof that claims lack unless it is given elsewhere, and what is given."""
    by_name = Window.partitionBy("answer", "kind", "id")
    is_thing = F.col("step").isNull()
    # the position where an id stands last, and whether all of that id are verified
    met = rows.select("*", F.count(F.when(is_thing, 1)).over(by_name).alias("n"), F.min("verified").over(by_name).alias("sound"), F.max(F.when(is_thing, F.col("position"))).over(by_name).alias("last"),
                      F.collect_set(F.when(is_thing, F.col("more"))).over(by_name).alias("proof"))
    position, own, kind, step = (F.col(c) for c in ("position", "id", "kind", "step"))
    known = (F.col("n") > 0) & own.isNotNull() & F.col("answer").isNotNull()
    named = F.element_at(F.array(*[F.lit(k.upper()) for k in KINDS]), kind + 1)
    strict = step.isin(*[CHECKS.index(x) for x in ("fact-evidence", "calculation-fact", "claim-fact")])
    wrong = F.when(step == _step("claim-calculation"), F.when(~known | (F.col("n") != 1), "NO_SINGLE_CALCULATION")).when(~known, F.concat(F.lit("UNKNOWN_"), named))
    wrong = F.when(~is_thing, wrong.when(strict & ~F.col("sound"), F.concat(F.lit("UNVERIFIED_"), named)))
    itself = F.when(F.coalesce(F.trim(own) == "", F.lit(True)), "BLANK_ID").when(F.col("n") > 1, "REPEATED_ID")
    wrong = F.when(is_thing & (kind != KINDS.index("calculation")), itself).otherwise(wrong)
    unsound = F.when(is_thing & (kind == KINDS.index("fact")), F.when(~F.col("verified"), "UNVERIFIED_FACT").when(F.size("more") == 0, "FACT_WITHOUT_EVIDENCE"))
    proof, asks, gives = _step("claim-proof"), (step == _step("claim-fact")) & known, (step == _step("claim-evidence")) & own.isNotNull() & F.col("answer").isNotNull() & position.isNotNull()
    met = met.withColumns({"wrong": wrong, "unsound": unsound, "asks": asks, "gives": gives}).where("wrong is not null or unsound is not null or asks or gives")

    about = F.when(step == _step("claim-calculation"), F.get("more", F.lit(0))).otherwise(own)
    place = F.when(F.col("wrong") == "REPEATED_ID", F.col("last")).otherwise(position)
    said = F.array(
        _said(F.coalesce(step, kind), place, about, F.col("wrong")),
        F.when(F.col("unsound").isNotNull(), _said(_step("fact-evidence"), position, own, F.col("unsound"))).when(F.col("gives"), _said(proof, position, own, F.lit("MISSING_PROOF"), True)),
    )
    missing = F.transform(F.flatten("proof"), lambda x: _said(proof, position, x, F.lit("MISSING_PROOF")))
    return _in_rows(met.select("answer", F.when(F.col("asks"), F.concat(said, missing)).otherwise(said).alias("said")), "said").where("problem is not null")


def problems(documents: DataFrame, evidence: DataFrame, facts: DataFrame, calculations: DataFrame, claims: DataFrame) -> DataFrame:
    """answer, check, position, id, problem: all that is wrong with the references of all answers."""
    found = _found(graph(documents, evidence, facts, calculations, claims))
    counted = found.groupBy("answer", "step", "position", "id", "problem").agg(F.count("*").alias("n"), F.max("given").alias("given")).where("not given")
    times = F.when(F.col("problem").isin(*_ONCE), F.lit(1).cast("long")).otherwise(F.col("n"))
    out = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    names = F.array(*map(F.lit, CHECKS))
    return out.select("answer", F.element_at(names, F.col("step") + 1).alias("check"), "position", "id", "problem")


def first_problems(found: DataFrame) -> DataFrame:
    """One row for each answer with problems: the one that comes first."""
    step = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check"))
    first = F.min(F.struct(step.alias("step"), "position", "id", "problem", "check"))
    return found.groupBy("answer").agg(first.alias("f")).select("answer", "f.check", "f.position", "f.id", "f.problem")


def kept_first(rows: DataFrame, kind: str) -> DataFrame:
    """Of rows that share an answer and an id the one of least position; rows without an id are left out."""
    key = f"{kind}_id"
    names = [c for c in rows.columns if c not in ("answer", key)]
    first = F.min_by(F.struct(*names), "position")
    return rows.where(F.trim(F.col(key).cast("string")) != "").groupBy("answer", key).agg(first.alias("f")).select("answer", key, "f.*").select(*rows.columns)


def used_documents(documents: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """The documents whose evidence some claim of their answer names."""
    named = claims.select("answer", F.explode(_listed("evidence_ids")).alias("evidence_id")).distinct()
    proof = evidence.join(named, ["answer", "evidence_id"], "left_semi").select("answer", "document_id").distinct()
    return documents.join(proof, ["answer", "document_id"], "left_semi").select(*documents.columns)
