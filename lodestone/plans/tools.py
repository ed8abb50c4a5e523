"""The tools of a question plan over tables of filings, facts and chunks, for ``question.compiled``.

Each is a function of a step's input and of the frames before it; nothing runs before an action.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import history, search
from lodestone.plans import question

#: Kinds of blocks that a plan asks for, as kinds of chunks.
CHUNK_KINDS = {"TABLE": "TABLE", "TABLE_ROW": "TABLE", "TABLE_CELL": "TABLE"} | dict.fromkeys(("TEXT", "TITLE", "HEADING", "SECTION", "PARAGRAPH"), "TEXT")


def search_filings(filings: DataFrame, c: search.FilingColumns, order: tuple[Column, ...]) -> Callable:
    """SEARCH_DISCLOSURES: filing, the keys of the best filings."""

    def run(given: dict, _: dict[str, DataFrame]) -> DataFrame:
        as_of = given.get("asOf")
        cond = search.MetadataCondition(title_terms=tuple(given.get("titleTerms", ())), categories=tuple(given.get("categories", ())), as_of=date.fromisoformat(as_of) if as_of else None, limit=given.get("limit", 20))
        hits = search.metadata_candidates(filings, c, cond).withColumn("_score", search.title_score(c.title, cond.title_terms))
        return hits.orderBy(F.col("_score").desc(), *order).limit(cond.limit).select(F.col(c.key).alias("filing"))

    return run


def look_up_facts(facts: DataFrame) -> Callable:
    """LOOKUP_FACTS: verified facts of the filings found, of the keys asked for; all keys where none is."""

    def run(given: dict, before: dict[str, DataFrame]) -> DataFrame:
        kept = facts.where("verified")
        if keys := given.get("factKeys"):
            kept = kept.where(F.col("fact_key").isin(*keys))
        return kept.join(before[given["disclosureIdsFrom"]].select("filing").distinct(), "filing", "left_semi") if "disclosureIdsFrom" in given else kept

    return run


def search_evidence(chunks: DataFrame, c: search.ChunkColumns, key: str, order: tuple[Column, ...]) -> Callable:
    """SEARCH_EVIDENCE: the best chunks of the filings found; none where no filing was."""

    def run(given: dict, before: dict[str, DataFrame]) -> DataFrame:
        kinds = {CHUNK_KINDS[k] for k in given.get("blockTypes", CHUNK_KINDS) if k in CHUNK_KINDS}
        words, facts, hints, _ = question.resolved_terms(given.get("concepts", []), given.get("factKeys", []), given.get("keywords", ()))
        cond = search.ChunkCondition(keywords=words, section_hints=hints, fact_hints=facts, chunk_types=tuple(sorted(kinds)), top_k=given.get("topK", 10))
        own = chunks.join(before[given["disclosureIdsFrom"]].select(F.col("filing").alias(key)).distinct(), key, "left_semi")
        return search.chunk_search(own, c, cond, order)

    return run


def resolve_history(versions: DataFrame, key: str, effective: str, tie: str) -> Callable:
    """RESOLVE_DISCLOSURE_HISTORY: each key's version as of a day, of those keys that the step before found."""

    def run(given: dict, before: dict[str, DataFrame]) -> DataFrame:
        rows = versions
        if source := given.get("disclosureIdsFrom"):
            rows = rows.join(before[source].select(F.col("filing").alias(key)).distinct(), key, "left_semi")
        return history.latest_as_of(rows, key, effective, tie, F.lit(date.fromisoformat(given["asOf"])))

    return run
