"""Sources and sinks of filings: company master, manifest, raw files, reports and idempotent tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

COMPANY_SCHEMA = (
    "corp_code string, stock_code string, corp_name string, listed_name string, corp_eng_name string, market string, industry string, sector_no string, sector string, "
    "listing_date string, fiscal_month string, market_cap string, n_periodic string, n_major string, n_exchange string, n_holding string, note string"
)

MANIFEST_SCHEMA = (
    "doc_id string, corp_code string, corp_name string, listed_name string, stock_code string, industry string, sector string, doc_group string, doc_subtype string, report_nm string, "
    "is_correction boolean, rcept_no string, rcept_dt string, flr_nm string, base_year int, base_month int, file_path string, file_format string, n_files int"
)

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def companies(spark: SparkSession, path: str) -> DataFrame:
    """The company master from CSV, codes as text, numbers typed; a row that can't be typed has a non-null problem."""
    names = [c.split()[0] for c in COMPANY_SCHEMA.split(", ")]
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = [n for n in names if n not in raw.columns and n != "note"]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    if "note" not in raw.columns:
        raw = raw.withColumn("note", F.lit(None).cast("string"))
    numbers = {n: "int" for n in ("sector_no", "n_periodic", "n_major", "n_exchange", "n_holding")} | {"market_cap": "long"}
    typed = [F.regexp_replace("fiscal_month", "월$", "").try_cast("int").alias(n) if n == "fiscal_month" else F.try_to_date(F.col(n)).alias(n) if n == "listing_date" else F.col(n).try_cast(numbers[n]).alias(n) if n in numbers else F.col(n) for n in names]
    return raw.select(*typed).withColumn("problem", company_problem())


def company_problem() -> Column:
    """The first rule that a company breaks, or null."""
    rules = {
        "corp_code": F.col("corp_code").rlike("^[0-9]{8}$"),
        "stock_code": F.col("stock_code").rlike("^[0-9]{6}$"),
        "market": F.col("market").isin("KOSPI", "KOSDAQ"),
        "sector_no": F.col("sector_no").between(1, 20),
        "fiscal_month": F.col("fiscal_month").between(1, 12),
        "corp_name": F.length(F.btrim("corp_name")) > 0,
        "market_cap": F.col("market_cap") >= 0,
    }
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])


def duplicate_codes(rows: DataFrame, *keys: str) -> DataFrame:
    """key, value and n of codes or numbers that more than one row has, for each of the keys on its own."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    pairs = rows.select(F.explode(each).alias("x")).select("x.*").where("value is not null")
    return pairs.groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1")


def read_table(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table over JDBC; with a partition (column, low, high, number) it is read by as many tasks, in ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition:
        column, low, high, number = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", number)
    return reader.load()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Filings from JSON lines, with the date typed and the first broken rule of each as problem."""
    rows = spark.read.schema(MANIFEST_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("rcept_dt", F.try_to_date("rcept_dt", "yyyyMMdd")).withColumn("problem", manifest_problem())


def manifest_problem() -> Column:
    periodic = F.col("doc_group") == "periodic"
    rules = {
        "doc_id": F.col("doc_id") == F.concat_ws("_", "doc_group", "rcept_no"),
        "doc_group": F.col("doc_group").isin("periodic", "major", "exchange", "holding"),
        "rcept_no": F.col("rcept_no").rlike("^[0-9]{14}$"),
        "rcept_dt": F.col("rcept_dt").isNotNull(),
        "base_period": F.when(periodic, F.col("base_year").isNotNull() & F.col("base_month").isin(3, 6, 9, 12)).otherwise(F.col("base_year").isNull() & F.col("base_month").isNull()),
        "file_path": ~F.col("file_path").startswith("/") & ~F.col("file_path").rlike(r"(^|/)\.\.(/|$)"),
        "n_files": F.col("n_files") >= 1,
    }
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with size, digest, extension, role and sniffed format; contents stay until they are dropped."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def described(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    out = files.withColumn("file_name", name).withColumn("extension", F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))
    return out.withColumns({"sha256": F.sha2("content", 256), "size": F.length("content"), "role": document_role(F.col("file_name")), "content_format": content_format(F.col("content"))})


def content_format(content: Column) -> Column:
    """PDF by its magic bytes, otherwise by the first element behind an optional byte order mark; UNKNOWN for the rest."""
    head = F.decode(F.substring(content, F.lit(1), F.lit(4096)), "ISO-8859-1")
    root = F.lower(F.regexp_extract(head, r"^(?:ï»¿)?\s*(?:<\?[^>]*\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([A-Za-z][A-Za-z0-9-]*)", 1))
    return F.when(head.startswith("%PDF-"), "PDF").when(root == "html", "HTML").when(root == "document", "DART_XML").otherwise("UNKNOWN")


def document_role(file_name: Column) -> Column:
    return (
        F.when(file_name.rlike(r"^[0-9]{14}\.[A-Za-z0-9]+$"), "MAIN")
        .when(file_name.rlike(r"^[0-9]{14}_viewer\.html$"), "VIEWER")
        .when(file_name.rlike(r"^[0-9]{14}_.*\.xml$"), "ATTACHMENT")
        .otherwise("UNKNOWN")
    )


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Canonical composition, which no built-in function has."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """source: the text by strict UTF-8, else strict CP949; status FAILED and error where neither reads or nothing is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.path, batch.content, strict=True):
                text, error = None, "empty source"
                for encoding in ("utf-8-sig", "cp949"):
                    try:
                        text = bytes(raw).decode(encoding)
                        break
                    except UnicodeDecodeError as e:
                        error = str(e)[:2000]
                ok = bool(text and text.strip())
                rows.append((path, text if ok else None, "COMPLETED" if ok else "FAILED", None if ok else error))
            yield pd.DataFrame(rows, columns=["path", "source", "status", "error"])

    return files.select("path", F.col(content).alias("content")).mapInPandas(run, "path string, source string, status string, error string")


def pages_as_sections(pages: DataFrame, most_pages: int = 2000, most_characters: int = 500_000) -> DataFrame:
    """One section a page of extracted text (doc_id, page_no, text), with limits and a test for broken extraction."""
    from lodestone.functions.text import paragraph, suspicious

    text = paragraph(F.coalesce("text", F.lit("")))
    ok = (F.col("page_no") <= most_pages) & (F.length(F.coalesce("text", F.lit(""))) <= most_characters)
    return pages.select("doc_id", F.col("page_no").alias("sequence_no"), text.alias("text"), suspicious(F.coalesce("text", F.lit(""))).alias("suspicious"), F.when(ok, "COMPLETED").otherwise("FAILED").alias("status"))


def write_report(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_replacing(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that rows have, and no other; running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed rows, and failed ones with their shortened error."""
    return rows.where("status = 'COMPLETED'"), rows.where("status = 'FAILED'").withColumn("error", F.substring("error", 1, 2000))
