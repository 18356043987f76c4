import zlib
from collections import Counter
from itertools import permutations

import numpy as np

from pyspark.sql import functions as F

from ebbtide.llm.jobs import JOBS
from ebbtide.llm.shards import communication_matrix, hypergeometric, key_seeds, shuffle_into_shards
from tests.llm.helpers import FOLDER, awkward, needs_tables, table


def gapless(rows, shards):
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    sizes = [len(v) for v in slots.values()]
    return max(sizes) - min(sizes) <= 1 and all(v == list(range(len(v))) for v in slots.values())


@needs_tables
def test_all_documents_once_with_exact_sizes(spark):
    rows = JOBS["op6_shard"](spark, FOLDER).collect()
    assert gapless(rows, 40) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    expected = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in table("documents", "doc_id, text")}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == expected and len(rows) == len(expected)


def test_awkward_rows_and_names(spark):
    frame = awkward(spark)
    out = shuffle_into_shards(frame, 3, rows_per_bin=2)
    rows = out.collect()
    assert gapless(rows, 3) and len(rows) == frame.count()
    assert out.columns == [c for c in frame.columns if c != "SHARD"] + ["shard", "slot"]
    assert Counter(map(str, (r.asDict() | {"shard": 0, "slot": 0} for r in rows)))
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, frame.select("doc_id", "text").collect()))
    assert shuffle_into_shards(frame.limit(0), 3).count() == 0
    assert gapless(shuffle_into_shards(frame, 40).collect(), 40)


def test_matrix_sums():
    blocks, shards = [5, 0, 17, 100], [31, 31, 30, 30]
    matrix = communication_matrix(blocks, shards, 3)
    assert [sum(line) for line in matrix] == blocks and [sum(c) for c in zip(*matrix, strict=True)] == shards


def test_every_place_is_equally_likely(spark):
    frame = spark.range(0, 8, 1, 2)
    seen = Counter()
    for seed in range(24):
        for r in shuffle_into_shards(frame, 4, seed=1000 * seed, rows_per_bin=1).collect():
            seen[r.id, r.shard, r.slot] += 1
    expected = 24 / 8
    chi = sum((seen[i, s, k] - expected) ** 2 / expected for i in range(8) for s in range(4) for k in range(2))
    assert chi < 95  # 49 degrees of freedom: 95 is beyond the 99.99th percentile


def test_blocks_are_independent(spark):
    """Neither place of a row says anything about the places of the row as far down in the next block."""
    n = 20_000
    out = shuffle_into_shards(spark.range(0, 3 * n, 1, 3), 2, seed=5, rows_per_bin=1_000).toPandas().sort_values("id")
    slot, shard = (out[c].to_numpy().reshape(3, n).astype(float) for c in ("slot", "shard"))
    for a in range(3):
        for b in range(3):
            if a != b:
                pairs = [(slot[a], shard[b]), (slot[a], slot[b]), (shard[a], shard[b])]
                assert all(abs(np.corrcoef(x, y)[0, 1]) < 0.035 for x, y in pairs)


def test_every_order_of_two_blocks_is_equally_likely(spark):
    """Keys of many seeds in one job, placed by the matrix as the operator places them: all 24 orders of four rows."""
    seeds = range(480)
    keys = [F.rand(k) for s in seeds for k in key_seeds(s)]
    rows = [list(r) for r in spark.range(0, 4, 1, 2).select(*keys).collect()]
    seen = Counter()
    for at, seed in enumerate(seeds):
        matrix = communication_matrix([2, 2], [2, 2], seed)
        shards = {0: [], 1: []}
        for block in (0, 1):
            mine = sorted((rows[2 * block + k][2 * at], 2 * block + k) for k in (0, 1))
            for place, (_, row) in enumerate(mine):
                shards[0 if place < matrix[block][0] else 1].append((rows[row][2 * at + 1], row))
        seen[tuple(row for s in (0, 1) for _, row in sorted(shards[s]))] += 1
    chi = sum((seen[order] - 20) ** 2 / 20 for order in permutations(range(4)))
    assert chi < 55  # 23 degrees of freedom: 55 is beyond the 99.98th percentile


def test_inversion_beyond_the_library(monkeypatch):
    rng = np.random.default_rng(5)
    own = [hypergeometric(rng, 40_000_000_000, 60_000_000_000, 1000) for _ in range(3000)]
    assert abs(np.mean(own) - 400) < 2 and abs(np.var(own) - 240) < 25
    monkeypatch.setattr("ebbtide.llm.shards._LIBRARY_LIMIT", 0)
    small = Counter(hypergeometric(rng, 4, 5, 3) for _ in range(4000))
    assert all(abs(small[k] / 4000 - p / 84) < 0.04 for k, p in enumerate((10, 40, 30, 4)))
