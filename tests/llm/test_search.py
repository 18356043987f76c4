import math
import re
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm.jobs import JOBS
from ebbtide.llm.search import Heap, Shard, make_shard, search, search_shard, terms_of
from tests.llm.helpers import FOLDER, awkward, needs_tables, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, most=50):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    number, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, bag in bags:
            m = 50 + (50 * sum(bag.values()) * number) // total
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                for t in set(terms(text)) if t in bag
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@needs_tables
def test_whole_table_equals_plain_ranking(spark):
    assert got(JOBS["op11_search"](spark, FOLDER)) == plain(table("documents", "doc_id, text"), table("benchmark", "item_id, text"))


def corpus(rng, n, vocabulary=400):
    names = np.array([f"w{k}" for k in range(vocabulary)])
    p = 1 / np.arange(1, vocabulary + 1)
    return [(int(d), " ".join(rng.choice(names, int(rng.integers(0, 60)), p=p / p.sum()))) for d in rng.permutation(n)]


@pytest.mark.parametrize("shard_bytes, block, stride, item_bytes, most", [(3_000, 4, 16, 150, 5), (10**9, 128, 2_048, 10**9, 50), (20_000, 16, 64, 300, 1)])
def test_shards_blocks_and_strides_do_not_change_results(spark, shard_bytes, block, stride, item_bytes, most):
    rng = np.random.default_rng(block)
    docs, items = corpus(rng, 600), corpus(rng, 12)
    frames = [spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    found = got(search(*frames, most=most, shard_bytes=shard_bytes, block=block, stride=stride, item_bytes=item_bytes))
    assert found == plain(docs, items, most)


def test_blocks_are_skipped():
    """A rare term decides: of the frequent term's list most blocks stay packed, and the result is whole."""
    texts = [("common " * (1 + k % 5)) + ("rare rare" if k % 400 == 7 else "filler") for k in range(4_000)]
    vocabulary = {b"common": 0, b"rare": 1, b"filler": 2}
    codes = [np.array([vocabulary[t] for t in terms_of(t)], np.int64) for t in texts]
    shard = Shard(make_shard(list(range(4_000)), codes, list(vocabulary), 16), 4_000, sum(map(len, codes)), 16)
    heap = Heap(5)
    search_shard(shard, [b"common", b"rare"], np.array([5, 5_000]), heap, 256)
    assert len(heap.scores) == 5 and all(i % 400 == 7 for i in heap.ids)
    common = [b for b in shard.unpacked if b < shard.first_block[1]]
    # Seven stretches of 16 blocks until five documents are found, then one block per candidate.
    assert len(common) == 7 * 16 + 5 and shard.first_block[1] == 250


def test_awkward_rows(spark):
    frame = awkward(spark)
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    items = [(1, "SAME one TWO"), (1, "SAME one TWO"), (None, "no ñandú id é"), (3, None), (4, ""), (5, "x " * 5_000 + "long" * 5_000), (6, "　")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert got(search(frame, queries)) == plain(docs, items)
    assert search(frame.limit(0), queries).collect() == [] and search(frame, queries.limit(0)).collect() == []
    assert search(frame.where("text is null"), queries).collect() == []


def test_terms():
    text = "Don't 3.5 ÄÖ_x \x00a\x7fB ` é z"
    assert [t.decode() for t in terms_of(text)] == terms(text)
