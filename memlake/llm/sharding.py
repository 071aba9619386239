"""Histogram sort into shards of nearly equal bytes, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours and stay in one shard
but for a group that a boundary must cut. Splitters are found by counting, exactly and over all
partitions, the bytes and rows between candidate boundaries: first 256 equal steps of the hash (65,536
with over 128 shuffle partitions P); then each cell that holds a wanted boundary, or over 1 / (2 P) of
all rows (1 / 64 at most), is probed again with equal
steps between its own lowest and highest key, by hash until a cell is one hash value, by doc_id
then, and by the row's place in the input for rows that repeat. Probing ends when each splitter is
within tolerance of its target. The driver sees a number of cell counts that P bounds, whatever the
input: at most 2 P cells are probed at a level, into 256 each. Then the rows are exchanged once, to their cell; a row's slot is the number of rows in its
shard's earlier cells plus its place in its own.

Law ``bytes``: a splitter misses its target by the tolerance or half a row at most.

Cases: null text has size 1 and the CRC of no bytes; repeated rows each get a slot of their own; a
null doc_id sorts as -1; an empty table gives no rows; of other columns those in ``keep`` pass
through ``shard`` inside the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import Stash

SHARDS = 8
#: Share of a shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.002
#: Cells that one cell is probed into; rows are dealt to cells of 1 / COARSE of all rows at most.
STEPS, COARSE = 256, 64
#: What rows are ordered by.
KEYS = ("h", "id", "tie")


class Cells:
    """A tree of cells over the order of rows. A cell's name is its path, two hex digits a level, so
    that names sort as their rows do."""

    def __init__(self, levels: int = 1) -> None:
        self.levels = levels  # of equal steps of the hash
        self.probed: dict[str, tuple[str, int, float]] = {}  # cell: key, lowest value, step

    def name(self) -> Column:
        """The leaf of a row."""
        # The signed hash's upper bits, as an offset from the lowest.
        bits = 8 * self.levels
        path = F.format_string(f"%0{2 * self.levels}x", (F.shiftright("h", 64 - bits) + (1 << (bits - 1))).cast("int"))
        levels: dict[int, list[str]] = {}
        for cell in self.probed:
            levels.setdefault(len(cell), []).append(cell)
        for _, cells in sorted(levels.items()):
            own, value = path, None
            for cell in cells:
                key, low, step = self.probed[cell]
                child = F.floor((F.col(key).cast("double") - F.lit(float(low))) / F.lit(step)) if key != "h" else F.floor((F.col(key) - F.lit(low)) / F.lit(step))
                child = F.concat(own, F.format_string("%02x", F.least(F.greatest(child, F.lit(0)), F.lit(STEPS - 1)).cast("int")))
                value = F.when(own == cell, child) if value is None else value.when(own == cell, child)
            path = value.otherwise(own)
        return path

    def probe(self, cell: str, counts: dict) -> bool:
        """Cut a cell into steps of the first key in which its rows differ; False if none does."""
        for key in KEYS:
            low, high = counts[f"low_{key}"], counts[f"high_{key}"]
            if float(high) - float(low) >= 1 and (key == "h" or float(high) != float(low)):
                self.probed[cell] = key, low, (high - low + 1) / STEPS
                return True
        return False


def histogram(rows: DataFrame, cells: Cells) -> list[dict]:
    """Exact bytes and rows of each non-empty leaf, in order, and the range of its keys."""
    stats = [F.sum("size").alias("bytes"), F.count("*").alias("rows"), *[f(k).alias(f"{n}_{k}") for k in KEYS for f, n in ((F.min, "low"), (F.max, "high"))]]
    return sorted((r.asDict() for r in rows.groupBy(cells.name().alias("cell")).agg(*stats).collect()), key=lambda r: r["cell"])


def plan(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[Cells, list[tuple[str, int, int]]]:
    """Cells fine enough for every splitter; for each leaf its shard and the rows of that shard before it."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells, stuck = Cells(1 if partitions <= 128 else 2), set()
    while True:
        leaves = histogram(rows, cells)
        total, n = sum(x["bytes"] for x in leaves), sum(x["rows"] for x in leaves)
        todo = {x["cell"] for x in leaves if x["rows"] > max(n / max(COARSE, 2 * partitions), 1)}
        cuts, below = [], 0
        for x in leaves:
            above = below + x["bytes"]
            while len(cuts) < shards - 1 and (target := total * (len(cuts) + 1) / shards) <= above:
                near = min(target - below, above - target)
                if near > tolerance * total / shards and x["rows"] > 1:
                    todo.add(x["cell"])
                cuts.append((x["cell"], above - target <= target - below))  # cut behind or before this leaf
            below = above
        fresh = [x for x in leaves if x["cell"] in todo - stuck]
        stuck |= {x["cell"] for x in fresh if not cells.probe(x["cell"], x)}
        if not any(x["cell"] in cells.probed for x in fresh):
            break
    out, shard, before = [], 0, 0
    for x in leaves:
        passed = sum(x["cell"] > c or (x["cell"] == c and not behind) for c, behind in cuts)
        if passed != shard:
            shard, before = passed, 0
        out.append((x["cell"], shard, before))
        before += x["rows"]
    return cells, out


def shard(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shards: int = SHARDS, stash: Stash | None = None) -> DataFrame:
    """Each row's kept columns (struct ``row``), size, text_crc32, shard and slot."""
    spark = docs.sparkSession
    stash = stash or Stash(spark)
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(F.struct(*keep).alias("row"), F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("id"), F.monotonically_increasing_id().alias("tie"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stash.put("rows", rows)
    cells, leaves = plan(rows, shards)
    table = spark.createDataFrame(leaves, "cell string, shard int, before long")
    place = F.row_number().over(Window.partitionBy("cell").orderBy(*KEYS))
    return rows.withColumn("cell", cells.name()).withColumn("place", place).join(F.broadcast(table), "cell").select("row", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))


def shard_digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard(docs).select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
