import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ebbtide.llm.decontaminate import contaminated_windows, decontaminate, within_radius
from ebbtide.llm.jobs import JOBS
from tests.llm.helpers import FOLDER, awkward, needs_tables, table, words


def shingles(found, width):
    return Counter(tuple(found[k : k + width]) for k in range(len(found) - width + 1))


def brute(docs, items):
    """Every item-sized window at every start, against every item."""
    out = set()
    split = {i: words((t or "").lower()) for i, t in items}
    for d, text in docs:
        found = words((text or "").lower())
        for i, item in split.items():
            width = min(5, len(item))
            if not item:
                continue
            goal = shingles(item, width)
            for start in range(-len(item) + 1, len(found)):
                window = shingles(found[max(0, start) : start + len(item)], width)
                both = sum((goal & window).values())
                if both and both / sum((goal | window).values()) >= 0.8:
                    out.add((d, i))
    return out


@needs_tables
def test_whole_tables(spark):
    got = {(r.doc_id, r.item_id) for r in JOBS["op4_decontaminate"](spark, FOLDER).collect()}
    assert got and got == brute(table("documents", "doc_id, text"), table("benchmark", "item_id, text"))


def test_edited_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 30, 60])))) for k in range(12)]
    docs = []
    for d in range(60):
        passage = rng.choice(items)[1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 3])):
            k = rng.randrange(len(passage))
            passage[k : k + rng.choice([1, 1, 2])] = rng.choices(vocabulary, k=rng.choice([1, 1, 2]))
        edge = rng.choice([0, 0, 2])
        body = rng.choices(vocabulary, k=rng.choice([0, 20])) + passage[edge:] + rng.choices(vocabulary, k=rng.choice([0, 20]))
        docs.append((d, " ".join(body).upper().replace("W", rng.choice(["w", "W"]))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated_windows(frame, benchmark).collect()}
    assert len(got) > 20 and got == brute(docs, items)


def test_moved_blocks_and_repeats(spark):
    """Halves in the other order, moved sentences, items that repeat themselves, and passages that the text's ends cut."""
    rng = random.Random(14)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, rng.choices(vocabulary, k=rng.choice([12, 30, 60, 90]))) for k in range(10)]
    items += [(20, ["a", "b", "c"] * 15), (21, (rng.choices(vocabulary, k=12) * 4)[:45])]
    docs = []
    for d in range(90):
        passage = list(rng.choice(items)[1])
        kind = d % 6
        if kind == 0:
            half = rng.randrange(1, len(passage))
            passage = passage[half:] + passage[:half]
        elif kind == 1:
            a, b = sorted(rng.sample(range(len(passage) + 1), 2))
            cut = passage[a:b]
            del passage[a:b]
            at = rng.randrange(len(passage) + 1)
            passage[at:at] = cut
        elif kind == 2:
            passage = passage + passage[: rng.randrange(len(passage))]
        elif kind == 3:
            passage = passage[len(passage) // rng.choice([5, 8, 12]) :]
        elif kind == 4:
            passage = passage[: -max(1, len(passage) // rng.choice([5, 8, 12]))]
        else:
            at = rng.randrange(len(passage))
            passage[at:at] = rng.choices(vocabulary, k=rng.choice([1, 3]))
        front, back = (rng.choices(vocabulary, k=rng.choice([0, 0, 1, 25])) for _ in range(2))
        docs.append((d, " ".join(front + passage + back)))
    texts = [(k, " ".join(words_)) for k, words_ in items]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(texts, "item_id long, text string")
    rows = contaminated_windows(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, texts)
    assert sum(r.doc_id % 6 < 2 for r in rows) > 10


def test_awkward_rows(spark):
    frame = awkward(spark)
    benchmark = spark.createDataFrame(
        [(1, None), (2, ""), (3, " \n"), (4, "ONE two"), (5, "same same same same same same same same same"), (None, "no id here")],
        "item_id long, text string",
    )
    got = sorted(((r.doc_id or 0), (r.item_id or 0)) for r in contaminated_windows(frame, benchmark).collect())
    assert got == [(0, 0), (5, 4), (8, 5)]
    kept = decontaminate(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]
    assert decontaminate(frame, benchmark.limit(0)).count() == frame.count()
    assert decontaminate(frame.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("radius, blocks", [(19, 10), (3, 4), (7, 3)])
def test_blocks_find_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    left = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    right = []
    for base in left:
        for flips in (0, 1, radius - 1, radius, radius + 1):
            value = base
            for b in rng.sample(range(63), flips):
                value ^= 1 << b
            right.append(value)
    expected = {(a, b) for a in left for b in right if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    a = spark.createDataFrame([(v,) for v in left], "fingerprint long")
    b = spark.createDataFrame([(v,) for v in right], "other long")
    found = within_radius(a, b, radius, blocks, True).select("fingerprint", "other").collect()
    assert {tuple(r) for r in found} == expected
    assert len(found) == sum(right.count(b) for _, b in expected)


def test_shuffled_path_agrees(spark, monkeypatch):
    frame = spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(30)))], "doc_id long, text string")
    benchmark = frame.select(F.col("doc_id").alias("item_id"), "text")
    monkeypatch.setattr("ebbtide.llm.decontaminate.BROADCAST_ROWS", -1)
    assert decontaminate(frame, benchmark).count() == 0
