"""Operator 9: shards on a consistent-hash ring with bounded loads.

The ring has ``CELLS`` equal cells; every shard owns virtual nodes on it, and
a cell belongs to the next virtual node clockwise. Rows fall into cells by
the hash of their id and text. No shard takes more than ``1 + spare`` times
the mean load: a cell whose shard is full goes on clockwise to the next
shard with room, so balance is guaranteed and few cells move when a
shard is added.

Only the load of each cell is gathered (a bounded table); the rows are
placed by a join with the cells' shards. A cell that would fill a good
part of a shard (one key may hold a third of all rows) is split evenly by a
row number first.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

CELLS = 1 << 16
VIRTUAL_NODES = 64
SPARE = 0.002
SPLIT = 256  # parts of a crowded cell


def ring(shards: int, cells: int = CELLS, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
    return sorted((at(s, v) * cells >> 64, s) for s in range(shards) for v in range(virtual_nodes))


def place(loads: list[tuple[int, int, int]], shards: int, cells: int = CELLS, virtual_nodes: int = VIRTUAL_NODES,
          spare: float = SPARE) -> dict[tuple[int, int], int]:
    """Shard of each (cell, part): the first shard clockwise with room,
    heavier ones first; the least loaded one when none has room."""
    nodes = ring(shards, cells, virtual_nodes)
    room = math.ceil(sum(x[2] for x in loads) / shards * (1 + spare))
    filled, out = [0] * shards, {}
    # Clockwise order of shards from each virtual node on.
    walks: dict[int, list[int]] = {}

    def walk(i: int) -> list[int]:
        if i not in walks:
            walks[i] = list(dict.fromkeys(s for _, s in nodes[i:] + nodes[:i]))
        return walks[i]

    import bisect
    starts = [c for c, _ in nodes]
    for cell, part, size in sorted(loads, key=lambda x: (-x[2], x[0], x[1])):
        order = walk(bisect.bisect_left(starts, cell) % len(nodes))
        shard = next((s for s in order if filled[s] + size <= room), None)
        if shard is None:
            shard = min(order, key=lambda s: filled[s])
        filled[shard] += size
        out[cell, part] = shard
    return out


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, cells: int, virtual_nodes: int, spare: float, carry: bool):
    """(rows with their cell and part, where each (cell, part) goes). With
    ``carry`` the rows hold the whole documents (``doc``)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(id_col, body).alias("h"),
                       F.monotonically_increasing_id().alias("n"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []))
    rows = written(rows.withColumn("cell", F.shiftrightunsigned("h", 64 - int(math.log2(cells))).cast("int")), "rows")
    # A bounded table: at most ``cells`` rows.
    by_cell = {r["cell"]: (r["b"], r["c"]) for r in rows.groupBy("cell").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).collect()}
    total = sum(b for b, _ in by_cell.values())
    crowded = sorted(c for c, (b, n) in by_cell.items() if n > SPLIT and b * shards > total * spare * 4)
    part = F.when(F.col("cell").isin(crowded), F.pmod(F.xxhash64("n"), F.lit(SPLIT)).cast("int")).otherwise(F.lit(0)) if crowded else F.lit(0)
    rows = rows.withColumn("part", part)
    loads = [(c, 0, b) for c, (b, _) in by_cell.items()]
    counts = {(c, 0): n for c, (_, n) in by_cell.items()}
    if crowded:  # at most a few hundred cells can be crowded, in ``SPLIT`` parts each
        split = rows.filter(F.col("cell").isin(crowded)).groupBy("cell", "part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).collect()
        loads = [x for x in loads if x[0] not in set(crowded)] + [(r["cell"], r["part"], r["b"]) for r in split]
        counts |= {(r["cell"], r["part"]): r["c"] for r in split}
    shard_of = place(loads, shards, cells, virtual_nodes, spare)
    first, table = [0] * shards, []
    for (cell, p), s in sorted(shard_of.items()):
        table.append((cell, p, s, first[s]))
        first[s] += counts[cell, p]
    return rows, spark.createDataFrame(table, "cell int, part int, shard int, first long")


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS,
               virtual_nodes: int = VIRTUAL_NODES, spare: float = SPARE) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes of the text plus 1; a
    null text has none), text_crc32, shard and slot (gapless from 0 in each
    shard). Repeated rows are placed each; other columns are not read; an
    empty table gives no rows."""
    rows, placed = _placed(docs, shards, id_col, text_col, cells, virtual_nodes, spare, carry=False)
    order = Window.partitionBy("cell", "part").orderBy("h", "doc_id", "text_crc32", "n")
    return (rows.withColumn("i", F.row_number().over(order) - 1).join(F.broadcast(placed), ["cell", "part"])
            .select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("i")).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents to ``path`` as Parquet, a folder ``shard=k`` per shard.

    Every row goes where its own cell and part go, so equal rows spread as the
    plan spreads them and the folders are as even as the plan. A column named
    ``shard`` gives way to the folder's; null texts and ids are rows like
    others; an empty table writes no folder."""
    rows, placed = _placed(docs.drop("shard"), shards, id_col, text_col, CELLS, VIRTUAL_NODES, SPARE, carry=True)
    rows.join(F.broadcast(placed), ["cell", "part"]).select("doc.*", "shard").write.partitionBy("shard").parquet(path)
