"""Operator 3 (native): quality rules by a hashed n-gram log-likelihood ratio.

Every text's words and word pairs are hashed into buckets. Two multinomials
over the buckets are estimated: the raw corpus (all documents) and the trusted
target (the labelled good documents). A document's ratio is the mean over its
features of log(target / raw); it is kept when the base rules hold and the
ratio reaches the threshold. The number of buckets follows the target (see
``bucket_count``). DataFrame functions only; the texts are never shuffled: the
counts are partial sums per bucket, and the ratios a table (bucket, weight)
joined to the features in the second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BUCKETS = 1 << 14  # at least
PER_BUCKET = 8  # features of the target
BROADCAST_BUCKETS = 1 << 21
TRUSTED = 10_000
SMOOTHING = 0.5
THRESHOLD = -0.1

# The white space that parts words, the symbols, the limits of the base rules.
SPACE = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOL_PATTERN = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words_of(text: Column) -> Column:
    """Words of a text: runs without space and \\x09-\\x0D."""
    body = F.btrim(text, F.lit(SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_PATTERN))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """Hash of every pair of neighbouring words."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.xxhash64(a, b))


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(feature, F.lit(buckets)).cast("int")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_t`` (null as empty), ``_w`` (words), ``_h`` (their hashes)
    and ``_p`` (of the pairs). One column a step: later steps read each of
    them several times, and would otherwise compute it as often."""
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    d = d.withColumn("_w", words_of(F.col("_t")))
    d = d.withColumn("_h", _word_hashes(F.col("_w")))
    return d.withColumn("_p", _pairs(F.col("_h")))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED, id_col: str = "doc_id") -> DataFrame:
    """The trusted target: of the documents labelled good and not toxic, the
    ``limit`` with the smallest id hashes (the bound of the sample)."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("_trusted")).filter("_trusted is not null").distinct()
    return good.orderBy(F.xxhash64("_trusted"), "_trusted").limit(limit)


def bucket_count(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
    """The largest power of two that leaves each bucket ``PER_BUCKET`` features
    of the target, at least ``BUCKETS``. With fewer buckets each pools more
    unrelated features and all ratios shrink towards 0; with more, the target's
    shares are mostly smoothing and good documents outside it are turned away."""
    n = F.size(words_of(F.col(text_col).cast("string")))
    target = docs.join(F.broadcast(trusted), F.col(id_col) == F.col("_trusted")).agg(F.sum(F.when(n > 0, 2 * n.cast("long") - 1)))
    return max(BUCKETS, 1 << max(1, (target.first()[0] or 0) // PER_BUCKET).bit_length() - 1)


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text",
           smoothing: float = SMOOTHING) -> DataFrame:
    """``_b`` and ``_weight``, the log ratio, of each of the ``buckets`` that
    has a feature; zeros when no trusted document has a word."""
    d = _hashed(docs, id_col, text_col).join(F.broadcast(trusted), F.col("_id") == F.col("_trusted"), "left")
    seen = (d.select(F.col("_trusted").isNotNull().cast("long").alias("good"), F.explode(F.concat("_h", "_p")).alias("f"))
            .groupBy(bucket(F.col("f"), buckets).alias("_b")).agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")))
    seen = written(seen, "quality")
    total = seen.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    share = lambda name: F.log((F.col(name) + F.lit(smoothing)) / F.lit((total[name] or 0) + smoothing * buckets))
    return seen.select("_b", (share("good") - share("raw") if total["good"] else F.lit(0.0)).alias("_weight"))


def _placed(tri: Column) -> Column:
    """Windows as (hash, place) in order of hash; null if none occurs twice."""
    return F.when(F.size(F.array_distinct(tri)) < F.size(tri), F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _repeated_words(placed: Column) -> Column:
    """Words inside windows that occur at least twice."""
    n = F.size(placed)
    twins = F.zip_with(F.slice(placed, 1, n - 1), F.slice(placed, 2, n - 1),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["sum"] + 3 - F.greatest(F.lit(0), acc["end"] - i)).alias("sum"))
    return F.aggregate(at, zero, step, lambda acc: acc["sum"])


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None,
          smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, ratio (mean log ratio, 0 without words), base_failed, kept.

    A null text is empty and fails the base rules; repeated rows are judged
    and counted each; other columns are not read; an empty table gives no rows."""
    buckets = buckets or bucket_count(docs, trusted, id_col, text_col)
    weights = ratios(docs, trusted, buckets, id_col, text_col, smoothing)
    if buckets <= BROADCAST_BUCKETS:
        weights = F.broadcast(weights)
    d = _hashed(docs, id_col, text_col)
    n3 = F.greatest(F.size("_h") - 2, F.lit(0))
    d = d.withColumn("_tri", F.zip_with(F.slice("_p", 1, n3), F.slice("_h", 3, n3), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("_placed", _placed(F.col("_tri")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_lines", lines).withColumn("_f", F.concat("_h", "_p"))
    d = d.select(
        "_id", F.xxhash64("_t").alias("_text"), F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOL_PATTERN)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_placed").isNull(), F.lit(0)).otherwise(_repeated_words(F.col("_placed"))).cast("long").alias("n_repeat_words"), "_f")
    # A row's features are summed where they are made; equal rows become one group and are dealt out again by their number.
    own = [c for c in d.columns if c != "_f"]
    d = d.select(*own, F.explode_outer("_f").alias("_f")).withColumn("_b", bucket(F.col("_f"), buckets))
    d = d.join(weights, "_b", "left").groupBy(*own).agg(F.avg("_weight").alias("_mean"), F.count(F.lit(1)).alias("_rows"))
    times = F.expr("cast(_rows div greatest(2 * n_words - 1, 1) as int)")
    d = d.withColumn("_", F.explode(F.array_repeat(F.lit(0), times)))
    d = d.select(F.col("_id").alias(id_col), *own[2:], F.coalesce("_mean", F.lit(0.0)).alias("ratio"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
