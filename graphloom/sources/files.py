"""File sources and the session catalog."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import SAFE_TABLE_PATTERN
from . import fs

# File extension -> reader format.
FORMATS = {
    ".parquet": "parquet", ".pq": "parquet",
    ".csv": "csv", ".tsv": "csv",
    ".json": "json", ".jsonl": "json", ".ndjson": "json",
}
TEXT_EXTS = (".txt", ".md", ".markdown")


def detect_format(path: str, default: str = "parquet") -> str:
    """Extension -> format; a ``?query`` suffix is stripped and the name
    lower-cased first; unknown -> parquet."""
    p = path.split("?", 1)[0].lower().rstrip("/")
    for ext, fmt in FORMATS.items():
        if p.endswith(ext):
            return fmt
    return default


def resolve(path: str, data_dir: str | None = None, spark: SparkSession | None = None) -> str:
    """A bare name resolves against a data directory and gets ``.parquet``.

    What is there is asked of the session's file system (``spark``), so names
    on shared storage resolve as well; the data directory may be any URI."""
    if data_dir and not os.path.isabs(path) and "://" not in path:
        path = os.path.join(data_dir, path)
    base = path.split("?", 1)[0]
    if "." in os.path.basename(base.rstrip("/")):
        return base
    spark = spark or SparkSession.getActiveSession()
    there = (lambda p: fs.exists(spark, p)) if spark is not None else os.path.exists
    return base + ".parquet" if not there(base) and there(base + ".parquet") else base


def scan(spark: SparkSession, path: str, fmt: str | None = None,
         data_dir: str | None = None) -> DataFrame:
    """A1/A2: scan Parquet, CSV/TSV or JSON/JSONL/NDJSON as a relation.

    CSV and JSON schemas are inferred (one sampling pass); production jobs
    should pass a schema to skip it.
    """
    path = resolve(path, data_dir, spark)
    fmt = fmt or detect_format(path)
    r = spark.read
    if fmt == "csv":
        sep = "\t" if path.lower().endswith(".tsv") else ","
        return r.option("header", True).option("inferSchema", True).option("sep", sep).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.format(fmt).load(path)


def register_tables(spark: SparkSession, tables: dict, data_dir: str | None = None) -> None:
    """A3: register ``name -> path`` so SQL can name it.

    Unqualified names become temp views; ``schema.table`` names become a
    database plus a view over the files (temp views reject multi-part names).
    """
    for name, path in tables.items():
        if not re.match(SAFE_TABLE_PATTERN, name):
            raise ValueError(f"invalid table name: {name!r}")
        df = scan(spark, path, data_dir=data_dir)
        if "." in name:
            db, tbl = name.rsplit(".", 1)
            fmt = detect_format(resolve(path, data_dir, spark))
            # The database directory goes under the shared checkpoint folder,
            # never into the driver's working directory.
            from ..session import ensure_checkpoint_dir
            loc = os.path.join(ensure_checkpoint_dir(spark), "catalog", f"{db}.db").replace("'", "\\'")
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}` LOCATION '{loc}'")
            if fmt == "parquet":
                p = resolve(path, data_dir, spark).replace("`", "``")
                spark.sql(f"CREATE OR REPLACE VIEW `{db}`.`{tbl}` AS SELECT * FROM parquet.`{p}`")
            else:
                p = resolve(path, data_dir, spark).replace("'", "\\'")
                opts = "header 'true', inferSchema 'true'" if fmt == "csv" else "multiLine 'false'"
                spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{tbl}`")
                spark.sql(f"CREATE TABLE `{db}`.`{tbl}` USING {fmt} OPTIONS (path '{p}', {opts})")
        else:
            df.createOrReplaceTempView(name)


def table_name_for(path: str) -> str:
    """Table name from a file stem: non ``[A-Za-z0-9_]`` -> '_'; a leading
    digit gets a ``t_`` prefix."""
    stem = os.path.basename(path.split("?", 1)[0].rstrip("/"))
    stem = stem.split(".", 1)[0] if "." in stem else stem
    name = re.sub(r"[^A-Za-z0-9_]", "_", stem)
    if name[:1].isdigit():
        name = "t_" + name
    return name


def load_table(spark: SparkSession, path: str, table: str | None = None, fmt: str | None = None,
               root: str | None = None) -> DataFrame:
    """A4: import a file into a named table; re-import APPENDS.

    The table is a Parquet directory under ``root`` (shared storage), so the
    append is a distributed write; returns the table as now stored.
    """
    name = table or table_name_for(path)
    df = scan(spark, path, fmt=fmt)
    if root is None:
        df.write.mode("append").saveAsTable(name)
        return spark.table(name)
    out = os.path.join(root, name)
    df.write.mode("append").parquet(out)
    return spark.read.parquet(out)


def preview_tables(spark: SparkSession, sources: dict, n: int = 25) -> DataFrame:
    """A5: first ``n`` rows of each existing source ordered by its first
    column (deterministic); missing sources are skipped. Columns tbl, key."""
    out = None
    for name, path in sources.items():
        p = resolve(path, spark=spark)
        if not fs.exists(spark, p):
            continue
        df = scan(spark, p)
        k = df.columns[0]
        part = (df.select(F.col(f"`{k}`")).orderBy(F.col(f"`{k}`")).limit(n)
                .select(F.lit(name).alias("tbl"), F.col(f"`{k}`").cast("string").alias("key")))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "tbl string, key string")
    return out


def read_columns(df: DataFrame, key: str = "NODE", columns: list | None = None) -> DataFrame:
    """Key + named columns for EVERY row; the key is de-duplicated from
    the list; an empty list is an error; odd names are quoted."""
    if not columns:
        raise ValueError("columns must be a non-empty list")
    cols = [c for c in dict.fromkeys(columns) if c != key]
    return df.select(F.col(f"`{key}`"), *[F.col("`" + c.replace("`", "``") + "`") for c in cols])


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """A10: ``.txt/.md/.markdown`` files -> (doc_uri, text) decoded as UTF-8
    with replacement; other extensions raise (checked on the listing)."""
    raw = spark.read.format("binaryFile").load(path)
    low = F.lower(F.col("path"))
    ok = low.endswith(TEXT_EXTS[0]) | low.endswith(TEXT_EXTS[1]) | low.endswith(TEXT_EXTS[2])
    bad = raw.filter(~ok).select("path").take(1)
    if bad:
        ext = bad[0]["path"].rsplit(".", 1)[-1].lower()
        raise ValueError(f"unsupported file type: {ext}")
    # UTF-8 with replacement: invalid byte sequences become U+FFFD.
    return raw.select(F.col("path").alias("doc_uri"),
                      F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
