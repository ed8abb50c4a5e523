"""Checks of answers against verified facts: references, outcome, forbidden phrases and mentioned values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.normalize import mentions

COMPLETED, PARTIAL, UNANSWERABLE = "COMPLETED", "PARTIAL", "UNANSWERABLE"


def verified_chain(facts: DataFrame, evidence: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified facts, the verified evidence that they name, and the documents that this names."""
    kept = facts.where("verified")
    proof = evidence.where("verified").join(kept.select(F.explode("evidence_ids").alias("evidence_id")).distinct(), "evidence_id", "left_semi")
    return kept, proof, documents.join(proof.select("document_id").distinct(), "document_id", "left_semi")


def dangling(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """relation and n: keys of child that parent doesn't have."""
    keys = child.select(F.col(child_key).alias("k")).where("k is not null").distinct()
    return keys.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(relation).alias("relation"), "n")


def outcomes(facts: DataFrame, filing: str, required: tuple[str, ...], verdicts: DataFrame | None = None) -> DataFrame:
    """outcome of each filing: none of the required keys, some of them or no calculation, or all."""
    present = [F.bool_or((F.col("fact_key") == k) & F.col("verified")).cast("int").alias(f"_{n}") for n, k in enumerate(required)]
    found = facts.groupBy(filing).agg(*present)
    total = sum((F.col(f"_{n}") for n in range(1, len(required))), F.col("_0"))
    out = found.select(filing, total.alias("n_present"))
    if verdicts is not None:
        out = out.join(verdicts.select(filing, "verdict"), filing, "left")
    broken = F.lit(False) if verdicts is None else F.coalesce(F.col("verdict") == "NOT_CALCULABLE", F.lit(False))
    outcome = F.when(F.col("n_present") == 0, UNANSWERABLE).when((F.col("n_present") < len(required)) | broken, PARTIAL).otherwise(COMPLETED)
    return out.select(filing, "n_present", outcome.alias("outcome"))


def claims(facts: DataFrame, filing: str, verdicts: DataFrame) -> DataFrame:
    """One claim a verified fact, and one a calculation that has a value."""
    own = facts.where("verified").select(filing, F.lit("FACT").alias("kind"), F.col("fact_key").alias("subject"), F.col("raw_value").alias("value"))
    made = verdicts.where("verdict <> 'NOT_CALCULABLE'").select(filing, F.lit("CALCULATION"), F.lit("ratio"), F.col("display"))
    return own.union(made)


def forbidden(answers: DataFrame, text: str, phrases: tuple[str, ...]) -> DataFrame:
    """answers with those phrases that their text holds, letter case aside; only such answers."""
    low = F.lower(F.col(text))
    found = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.instr(low, F.lower(p)) > 0)
    return answers.withColumn("phrases", found).where(F.size("phrases") > 0)


def unsupported_mentions(answers: DataFrame, key: str, text: str, allowed: DataFrame) -> DataFrame:
    """key, kind, value of each ratio and date in an answer that isn't among the values allowed for it.

    A ratio is also allowed if an allowed value, rounded to the mention's own decimals, equals it.
    """
    from lodestone.operators.calculation import decimals, rounded

    said = answers.select(key, F.explode(mentions(F.col(text))).alias("m")).select(key, "m.kind", "m.value").distinct()
    known = allowed.select(key, F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    near = rounded(F.col("_value").try_cast("decimal(28,6)"), F.least(decimals(F.col("value")), F.lit(6)))
    same = (F.col("value") == F.col("_value")) | (F.col("kind") == "ratio") & (near == F.col("value"))
    return said.join(known, (said[key] == known[key]) & (F.col("kind") == F.col("_kind")) & same, "left_anti")


def readiness(facts: DataFrame, filing: str, required: tuple[str, ...]) -> DataFrame:
    """One row: filings, those that have every required verified fact, and whether all have."""
    per = outcomes(facts, filing, required)
    return per.agg(F.count("*").alias("n_filings"), F.count_if(F.col("outcome") == COMPLETED).alias("n_ready")).withColumn("ready", F.col("n_filings") == F.col("n_ready"))


def response(hits: DataFrame, number: str, receipt: str, title: str, body: str) -> DataFrame:
    """The retrieved contexts of an answer in one text, in order; as many rows as a search returns."""
    from lodestone.functions.text import formatted_citation

    line = formatted_citation(F.col(number), F.col(receipt).cast("string"), F.col(title), F.col(body))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), line.alias("t")))), lambda x: x["t"]), "\n").alias("retrieved_contexts"), F.count("*").alias("n_contexts"))
