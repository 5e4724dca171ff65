"""Sharding by best-fit-decreasing bin packing of groups of equal texts."""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleave.llm.common import pick
from cleave.operators.skew import skew_join
from cleave.session import settle


class _Node:
    __slots__ = ("height", "key", "left", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.height = key, None, None, 1


def _height(n: _Node | None) -> int:
    return n.height if n else 0


def _turn(n: _Node, right: bool) -> _Node:
    if right:
        top = n.left
        n.left, top.right = top.right, n
    else:
        top = n.right
        n.right, top.left = top.left, n
    for x in (n, top):
        x.height = 1 + max(_height(x.left), _height(x.right))
    return top


def _level(n: _Node) -> _Node:
    n.height = 1 + max(_height(n.left), _height(n.right))
    lean = _height(n.left) - _height(n.right)
    if lean > 1:
        if _height(n.left.left) < _height(n.left.right):
            n.left = _turn(n.left, right=False)
        return _turn(n, right=True)
    if lean < -1:
        if _height(n.right.right) < _height(n.right.left):
            n.right = _turn(n.right, right=True)
        return _turn(n, right=False)
    return n


class CapacityTree:
    """Height-balanced search tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return _level(n)

        self.root = put(self.root)

    def drop(self, key: tuple[int, int]) -> None:
        def cut_out(n: _Node, key: tuple[int, int]) -> _Node | None:
            if key < n.key:
                n.left = cut_out(n.left, key)
            elif key > n.key:
                n.right = cut_out(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                least = n.right
                while least.left:
                    least = least.left
                n.key = least.key
                n.right = cut_out(n.right, least.key)
            return _level(n)

        self.root = cut_out(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least remaining capacity that takes `size`; of equal ones the lowest bin."""
        n, best = self.root, None
        while n:
            if n.key >= (size, -1):
                best, n = n.key, n.left
            else:
                n = n.right
        return best

    def roomiest(self) -> tuple[int, int]:
        n = self.root
        while n.right:
            n = n.right
        return n.key


def best_fit_decreasing(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int]:
    """The bin of each item, items taken by falling size (ties in their order).

    With `bins` None, a bin is opened whenever no open one has room, which keeps their number low; an item beyond
    `capacity` is alone. With `bins` given, that many are open from the start, and what fits nowhere goes to the bin with
    the most room.
    """
    sizes = list(sizes)
    tree, out, opened = CapacityTree(), [0] * len(sizes), bins or 0
    for b in range(opened):
        tree.add((capacity, b))
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found is None and bins is None:
            found, opened = (max(capacity, sizes[i]), opened), opened + 1
        else:
            found = found or tree.roomiest()
            tree.drop(found)
        out[i] = found[1]
        tree.add((found[0] - sizes[i], found[1]))
    return out


#: A shard's capacity over the size below which groups are bundled: a bundle is at most 1/256 of a shard.
GRAIN = 256
#: Small groups are dealt to this many runs at most before bundling.
MOST_RUNS = 1 << 16
#: Rows that are numbered, and small groups that are bundled, in one task at a time, about.
RUN_ROWS = 20_000


def _bundles(f: pd.DataFrame, unit: int) -> pd.DataFrame:
    """The groups of a run with the bundle that best-fit-decreasing packing puts them in."""
    f = f.sort_values(["bytes", "group_id"], ascending=[False, True], ignore_index=True)
    f["part"] = best_fit_decreasing(f["bytes"].tolist(), unit)
    return f


def shard(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_id: rows in shards of near equal bytes (law `bytes`).

    Equal texts are one group and share a shard. A group larger than a whole shard can't, as sizes would differ: it is
    dealt by row into up to 1024 parts, each packed on its own. Groups of at least 1/256 of a shard are packed one by one, by
    falling size into the fullest shard that still takes them; smaller ones are first packed in the same way into bundles of that
    size, run by run. So the driver packs at most a few items for each 1/256 of a shard, and one for each run, however large the table is.

    Null text: no bytes, size 8, crc 0, and one group of its own with empty texts. Texts of any length count whole. Repeated rows and null
    ids: each row has its slot. An empty table gives an empty result. Columns beyond id and text are not read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(
        pick(df, id_col, text_col).toDF("doc_id", "text").select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("group_id"),
        ),
        200_000,
    ).withColumn("place", F.monotonically_increasing_id())
    groups = settle(rows.groupBy("group_id").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.sum("size").alias("bytes")), 200_000)
    n_groups, total, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    capacity = max(1, ceil(total / n_shards))
    unit = max(1, capacity // GRAIN)
    runs = min(MOST_RUNS, max(1, ceil(n_groups / RUN_ROWS)))

    # What is packed: cells of oversize groups, large groups, bundles of small ones. All have a bounded number.
    over, large, small = F.col("bytes") > capacity, F.col("bytes") >= unit, F.col("bytes") < unit
    by_run = groups.where(small).select("group_id", "bytes", F.pmod(F.xxhash64("group_id"), F.lit(runs)).alias("run"))
    bundled = settle(by_run.groupBy("run").applyInPandas(lambda f: _bundles(f, unit), "group_id binary, bytes bigint, run bigint, part bigint"), 200_000)
    wide = groups.where(over).select("group_id", F.lit(True).alias("dealt"))
    cell = F.pmod(F.xxhash64(F.lit(7), "place"), F.lit(4 * GRAIN))
    cells = rows.join(F.broadcast(wide), "group_id").groupBy("group_id", cell.alias("part")).agg(F.sum("size").alias("bytes"))  # at most n_shards groups
    none, no_group = F.lit(-1).cast("bigint"), F.lit(None).cast("binary")
    items = (
        cells.select("group_id", none.alias("run"), F.col("part").cast("bigint").alias("part"), "bytes")
        .unionByName(groups.where(large & ~over).select("group_id", none.alias("run"), none.alias("part"), "bytes"))
        .unionByName(bundled.groupBy("run", "part").agg(F.sum("bytes").alias("bytes")).select(no_group.alias("group_id"), "run", "part", "bytes"))
    )
    found = sorted(items.collect(), key=lambda r: (-r["bytes"], bytes(r["group_id"] or b""), r["run"], r["part"]))
    bins = best_fit_decreasing([r["bytes"] for r in found], capacity, n_shards)
    placed = spark.createDataFrame([(r["group_id"], r["run"], r["part"], b) for r, b in zip(found, bins, strict=True)], "group_id binary, run bigint, part bigint, shard int")

    by_bundle = bundled.join(placed.where("run >= 0").drop("group_id"), ["run", "part"]).select("group_id", "shard")
    by_group = placed.where("run < 0 AND part < 0").select("group_id", "shard")
    whole = by_bundle.unionByName(by_group)
    by_cell = placed.where("run < 0 AND part >= 0").select("group_id", F.col("part").alias("cell"), F.col("shard").alias("cell_shard"))
    spread = [r["group_id"] for r in by_cell.select("group_id").distinct().collect()]
    home = rows.withColumn("cell", F.when(F.col("group_id").isin(spread), cell) if spread else F.lit(None).cast("bigint"))
    home = home.join(F.broadcast(by_cell), ["group_id", "cell"], "left")  # at most n_shards groups of 1024 cells
    home = skew_join(home, whole, "group_id", how="left", place=F.col("place"), sizes=groups.select("group_id", F.col("n").alias("__n")))

    pieces = max(16, ceil(n_rows / (n_shards * RUN_ROWS)))
    home = settle(home.select("doc_id", "size", "text_crc32", "group_id", "place", F.coalesce("shard", "cell_shard").alias("shard"), F.pmod(F.xxhash64("place"), F.lit(pieces)).alias("piece")), 200_000)
    counts = home.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy(F.col("doc_id").asc_nulls_last(), "group_id", "place")
    numbered = home.withColumn("at", F.row_number().over(within)).join(starts, ["shard", "piece"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.hex("group_id").alias("group_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
