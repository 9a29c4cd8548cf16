"""Sinks that never overwrite their input and leave no half-written result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str, form: str = "json", inputs: tuple[str, ...] = ()) -> None:
    """Writes to a path that must not exist, nor be one of the inputs; the commit protocol makes it whole or absent."""
    if any(path.rstrip("/") == p.rstrip("/") for p in inputs):
        raise ValueError(f"{path} is an input")
    df.write.mode("errorifexists").format(form).save(path)


def append_checked(df: DataFrame, path: str, existing: DataFrame, problems) -> None:
    """Appends rows to a table only if the whole of both has no problems; problems: DataFrame -> DataFrame of them."""
    bad = problems(existing.unionByName(df)).limit(20).collect()
    if bad:
        raise ValueError(f"nothing is written: {[r.asDict() for r in bad]}")
    df.write.mode("append").parquet(path)


def by_content(df: DataFrame, content: str) -> DataFrame:
    """(sha256, content) with each content once, as it is stored by digest."""
    return df.select(F.sha2(F.col(content), 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"])


def output_manifest(spark, path: str) -> DataFrame:
    """(file, sha256, bytes) of written files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def status_rollup(reports: DataFrame, file: str, status: str) -> DataFrame:
    """(status, n_files) over the reports of many files."""
    return reports.select(file, status).distinct().groupBy(status).agg(F.count("*").alias("n_files"))


def value_hash(df: DataFrame) -> int:
    """A digest of a table's rows that doesn't depend on their order."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    got = df.agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("a"), F.sum(F.pmod(F.xxhash64(row, F.lit(7)), F.lit(1 << 31))).alias("b")).first()
    return hash((got["n"], got["a"], got["b"]))


def markdown(rows: list[dict]) -> str:
    """A few rows as a Markdown table."""
    if not rows:
        return ""
    head = list(rows[0])
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(str(r[h]) for h in head) + " |" for r in rows)])
