"""Operator 7: token ids in binary files with a shared zstandard dictionary.

A store is a folder in any file system that Spark writes to:

* ``meta``: one row with the dictionary (trained on a bounded sample of
  serialised id arrays), its SHA-256, its bytes (0: none could be trained),
  the id width and the end id.
* ``data``: one row per block. A block's ``payload`` is the concatenation of
  its documents' zstandard frames, each compressed on its own with the shared
  dictionary; ``index`` has every document's offset, length and ids; the
  dictionary's SHA-256 stands beside every block. Files hold consecutive
  ranges of document ids, blocks and documents ascend in them.
* ``index``: one row per document (id, file, block, offset, length, n_tokens,
  start), for reading single documents without their neighbours.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import bounded_batches

BLOCK_BYTES = 1 << 20
_ENTRY = "struct<doc_id:{id},offset:int,length:int,n_tokens:long,start:long>"


class LibraryEncoder(bpe.Encoder):
    """Encodes each distinct piece with the tokenizers library itself."""

    cache = 1_000_000

    def __init__(self, path: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def _encode_pieces(self, raw, starts, ends):
        out, size = [], np.zeros(len(starts), np.int64)
        for i in range(0, len(starts), 8192):  # an encoding holds much more than its ids
            part = self.library.encode_batch_fast(
                [raw[s:e].tobytes().decode() for s, e in zip(starts[i:i + 8192], ends[i:i + 8192], strict=True)], add_special_tokens=False)
            ids = [x.ids for x in part]
            size[i:i + 8192] = [len(x) for x in ids]
            out.append(np.array([t for x in ids for t in x], np.int32))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.r_[0, np.cumsum(size)]


@functools.lru_cache(maxsize=2)
def _library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _train(docs: DataFrame, vocab_path: str, end_id: int, sample_docs: int, sample_bytes: int, dict_bytes: int) -> bytes:
    """A dictionary from the documents with the smallest hashes: at most
    ``sample_docs`` of them, while their texts sum to ``sample_bytes``. Of a
    long one the first ``sample_bytes`` / 64 characters are taken, so that
    none fills the sample. A small sample gives a smaller dictionary."""
    share = min(1.0, 2 * sample_docs / max(1, docs.count()))
    near = docs.filter((F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30)) & F.col("text").isNotNull()).orderBy("_h").limit(sample_docs)
    near = near.withColumn("text", F.substring("text", 1, max(1, sample_bytes // 64)))
    rows = near.withColumn("b", F.sum(F.octet_length("text")).over(Window.orderBy("_h", "text"))).filter(F.col("b") <= sample_bytes)
    texts = [r["text"] for r in rows.select("text").collect()]
    encoder = _library_encoder(vocab_path)
    ids, border = bpe.with_special(encoder, pa.array(texts, pa.string()))
    kind = _width(encoder.v.size)
    samples = [np.r_[ids[a:b], end_id].astype(kind).tobytes() for a, b in zip(border[:-1], border[1:], strict=True)]
    for size in (dict_bytes, dict_bytes // 4, dict_bytes // 16, dict_bytes // 64):
        try:
            return zstandard.train_dictionary(size, samples, level=3).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few samples for this size
            pass
    return b""  # frames then stand alone


def write_tokens(docs: DataFrame, path: str, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
                 files: int | None = None, sample_docs: int = 2000, sample_bytes: int = 4 << 20, dict_bytes: int = 64 << 10) -> None:
    """Encode every whole text, append ``end_id`` and write a store to ``path``.

    Documents are in ascending id order (null ids first, ties by text hash);
    a null text has the end id only; repeated rows are stored each; other
    columns are not read. A range of ids is one task, streamed block by block."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col, id_col).alias("_h"))
    id_type = dict(src.dtypes)["doc_id"]
    dictionary = _train(src, vocab_path, end_id, sample_docs, sample_bytes, dict_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, first = TaskContext.get().partitionId(), 0, 0, 0
        encoder = _library_encoder(vocab_path)
        kind = _width(encoder.v.size)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        names, frames, counts, size = [], [], [], 0

        def shape():
            length = np.array([len(f) for f in frames], np.int64)
            n = np.array(counts, np.int64)
            entry = pa.StructArray.from_arrays(
                [pa.concat_arrays(names), pa.array((np.cumsum(length) - length).astype(np.int32)), pa.array(length.astype(np.int32)),
                 pa.array(n), pa.array(first + np.cumsum(n) - n)], names=["doc_id", "offset", "length", "n_tokens", "start"])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([digest]),
                 pa.array([b"".join(frames)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(entry)], pa.int32()), entry)],
                names=["shard", "block", "n_tokens", "dict_sha256", "payload", "index"])

        for part, ids, border in bpe.encoded_slices(batches, encoder):
            for i in range(part.num_rows):
                own = np.r_[ids[border[i]:border[i + 1]], end_id].astype(kind)
                frames.append(packer.compress(own.tobytes()))
                names.append(part.column(0).slice(i, 1))
                counts.append(len(own))
                start += len(own)
                size += len(frames[-1])
                if size >= BLOCK_BYTES:
                    yield shape()
                    names, frames, counts, size, block, first = [], [], [], 0, block + 1, start
        if frames:
            yield shape()

    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry = _ENTRY.format(id=id_type)
    blocks = (src.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
              .mapInArrow(run, f"shard int, block int, n_tokens long, dict_sha256 string, payload binary, index array<{entry}>"))
    blocks.write.parquet(f"{path}/data")
    spark.createDataFrame([(bytearray(dictionary), digest, len(dictionary), end_id, bpe.vocabulary(vocab_path).size)],
                          "dictionary binary, dict_sha256 string, dict_bytes int, end_id int, vocab_size int").write.parquet(f"{path}/meta")
    data = spark.read.parquet(f"{path}/data").select("shard", "block", "index")
    (data.join(F.broadcast(_file_starts(spark, path)), "shard")
     .select("shard", "block", "file_start", F.explode("index").alias("e"))
     .select("e.doc_id", "shard", "block", "e.offset", "e.length", "e.n_tokens", (F.col("file_start") + F.col("e.start")).alias("start"))
     .write.parquet(f"{path}/index"))


def _file_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each file: a running sum over one row per file."""
    per = spark.read.parquet(f"{path}/data").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def _meta(spark: SparkSession, path: str) -> tuple[bytes, str, str]:
    row = spark.read.parquet(f"{path}/meta").first()
    return bytes(row["dictionary"]), row["dict_sha256"], _width(row["vocab_size"])


def _open(dictionary: bytes, digest: str):
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the store's dictionary does not have its hash")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_tokens(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """All documents of a store: doc_id, start (ids before it), n_tokens and
    ``ids``, or with ``digests`` instead ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers)."""
    bounded_batches(spark)
    dictionary, digest, kind = _meta(spark, path)
    data = spark.read.parquet(f"{path}/data")
    entry = data.schema["index"].dataType.elementType
    id_type = entry["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _open(dictionary, digest)
        for batch in batches:
            for b in range(batch.num_rows):
                if batch.column(0)[b].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                payload, index = batch.column(1)[b].as_buffer(), batch.column(2)[b].values
                base = batch.column(3)[b].as_py()
                off, size, n, start = (index.field(k).to_numpy() for k in (1, 2, 3, 4))
                raw = [unpack.decompress(payload.slice(int(o), int(s))) for o, s in zip(off, size, strict=True)]
                ids = [np.frombuffer(x, kind) for x in raw]
                if [len(x) for x in ids] != n.tolist():
                    raise ValueError("a document's ids are not as many as its index says")
                if digests:
                    last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                else:
                    border = np.r_[0, np.cumsum(n)].astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(border), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([index.field(0), pa.array(base + start), pa.array(n), last],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    last = "ids_crc32 long" if digests else "ids array<int>"
    return (data.join(F.broadcast(_file_starts(spark, path)), "shard").select("dict_sha256", "payload", "index", "file_start")
            .mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, {last}"))


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The ids of single documents (``wanted`` has a column doc_id): the
    index names their frames, only their blocks are opened."""
    bounded_batches(spark)
    dictionary, digest, kind = _meta(spark, path)
    found = spark.read.parquet(f"{path}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    blocks = spark.read.parquet(f"{path}/data").select("shard", "block", "payload")
    id_type = dict(found.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _open(dictionary, digest)
        for batch in batches:
            ids = [np.frombuffer(unpack.decompress(f.as_buffer()), kind).astype(np.int32) for f in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "start", "n_tokens", "ids"])

    frame = F.expr("substring(payload, offset + 1, length)")
    return (found.join(blocks, ["shard", "block"]).select("doc_id", "start", "n_tokens", frame.alias("frame"))
            .mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids array<int>"))


__all__ = ["LibraryEncoder", "write_tokens", "read_tokens", "read_documents"]
