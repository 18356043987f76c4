"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Every input partition is a block.  Its rows are put into a random order where they lie, the number of
rows each block sends to each shard is drawn exactly (rows of the matrix sum to the blocks, columns to
the shard sizes), the rows are exchanged, and each shard is put into a random order again.  The result
is distributed like one uniform permutation of all rows cut into shards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm.common import saved, unclash

#: Most blocks; more input partitions than this are merged (without a shuffle) so that the matrix stays small.
MAX_BLOCKS = 1 << 16
#: Rows that one task orders at the second permutation.
ROWS_PER_BIN = 100_000
_LIBRARY_LIMIT = 1_000_000_000
_LOCAL = (1 << 33) - 1


def key_seeds(seed: int) -> tuple[int, int]:
    """Seeds of the two random keys: a stream starts at its seed plus the number of the block, so they lie further apart."""
    return 4 * MAX_BLOCKS * seed, 4 * MAX_BLOCKS * seed + 2 * MAX_BLOCKS


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One draw; beyond the library's range by inversion outwards from the mode."""
    if good + bad < _LIBRARY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    low, high = max(0, sample - bad), min(sample, good)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    centre = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample))
    left, up, down, p_up, p_down = rng.random() - centre, mode, mode, centre, centre
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each block to each shard, drawn as a uniform permutation would send them."""
    rng = np.random.default_rng(seed)
    room = list(shards)
    matrix = []
    for rows in blocks:
        total, left, line = sum(room), rows, []
        for space in room:
            total -= space
            taken = hypergeometric(rng, space, total, left)
            line.append(taken)
            left -= taken
        room = [space - taken for space, taken in zip(room, line, strict=True)]
        matrix.append(line)
    return matrix


def shuffle_into_shards(
    frame: DataFrame, shards: int, seed: int = 11, rows_per_bin: int = ROWS_PER_BIN
) -> DataFrame:
    """Every row with its ``shard`` (sizes at most one apart) and gapless ``slot`` in it.

    Rows are never looked into, so nulls, long texts and repeated rows are placed like any other row; an
    empty frame gives an empty result.  Input columns called ``shard`` or ``slot`` are replaced.
    The rows are written once to the checkpoint folder, where the two random keys and the blocks become
    fixed: a task that runs again places its rows as before.  The driver holds one count per block and
    the matrix (at most MAX_BLOCKS x shards numbers).
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = frame.sparkSession
    first, second = key_seeds(seed)
    blocks = saved(
        unclash(frame, ["shard", "slot"])
        .coalesce(MAX_BLOCKS)
        .select(F.struct("*").alias("row"), F.rand(first).alias("first"), F.rand(second).alias("second"))
        .sortWithinPartitions("first")
        .withColumn("at", F.monotonically_increasing_id())
    )
    block, rank = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(_LOCAL)
    sizes = sorted((r[0], r[1]) for r in blocks.groupBy(block.alias("block")).count().collect())
    total = sum(size for _, size in sizes)
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([size for _, size in sizes], goal, seed)
    ends = spark.createDataFrame(
        [(number, np.cumsum(line).tolist()) for (number, _), line in zip(sizes, matrix, strict=True)],
        "block long, ends array<long>",
    )
    bins = max(1, math.ceil(total / shards / rows_per_bin))
    sent = (
        blocks.withColumns({"block": block, "rank": rank})
        .join(F.broadcast(ends), "block")
        .select(
            "row",
            "second",
            "at",
            F.size(F.filter("ends", lambda end: end <= F.col("rank"))).alias("shard"),
            F.floor(F.col("second") * bins).cast("int").alias("bin"),
        )
    )
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "bin").count().select(
        "shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "bin").orderBy("second", "at")
    return (
        sent.withColumn("nth", F.row_number().over(inside))
        .join(offsets, ["shard", "bin"])
        .select("row.*", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
    )
