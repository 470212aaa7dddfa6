"""A corpus cleaning pipeline made of the numbered operators.

``STAGES`` lists (name, function) pairs; each function takes
``(spark, docs, sf_dir)``, and all but the last return the columns of
``documents``. Every stage keeps the columns that it finds and adds none, so
names cannot clash; an empty table passes through empty. ``run`` writes every stage's rows as Parquet in the shared
folder of ``spark.checkpoint.dir`` and reads them back as the next stage's
``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, langid, ngram_join, secrets
from graphloom.llm.queries import VOCABULARY
from graphloom.llm.shared import documents, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts, texts without
    a letter, and texts that no language scores 0.4 on (operator 2, trained on
    the labelled rows of the stage's input)."""
    return langid.keep_identified(docs, langid.fit(docs), min_score=0.4)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: sets of five-word
    shingles with a similarity of 0.8 or more are linked (operator 1). The
    smallest id stays, one of repeated rows; documents without words (null or
    empty texts) are linked with nothing and all stay."""
    return ngram_join.one_per_component(docs, percent=80, k=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item's words go (operator 6);
    null and wordless texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, all documents stay (operator 5); a
    null text stays null."""
    out = secrets.redact(docs)
    changed = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.contains("text", F.lit("[SECRET]")), changed).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the hash of the text that
    they decode to (operator 10); a null or empty text has no ids, repeated rows
    keep their rows. Of the input's columns only doc_id is returned."""
    return bpe.encode_documents(docs, VOCABULARY).select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_decontamination),
          ("secret scans", secret_scan), ("BPE encoding and decoding", bpe_encoding)]

#: Language identification and tokenization cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
