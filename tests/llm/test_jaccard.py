import random

import numpy as np
from pyspark.sql import functions as F

from ebbtide.llm import jaccard
from ebbtide.llm.jaccard import connect, document_components, one_of_each_group, shingle_sets
from ebbtide.llm.jobs import JOBS
from tests.llm.helpers import FOLDER, awkward, needs_tables, table, words


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_set(text, width=3):
    found = words(lowered(text))
    return {tuple(found[k : k + width]) for k in range(len(found) - width + 1)} or ({tuple(found)} if found else set())


def brute(docs, percent=90):
    sets = [(i, plain_set(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    where = {}
    for k, (_, s) in enumerate(sets):
        for token in s:
            where.setdefault(token, []).append(k)
    tested = set()
    for members in where.values():
        for x, a in enumerate(members):
            for b in members[x + 1 :]:
                if (a, b) not in tested:
                    tested.add((a, b))
                    both = len(sets[a][1] & sets[b][1])
                    if 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                        root[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            best[find(k)] = min(i, best.get(find(k), i))
    return sorted(((i is None, i or 0, len(s), best.get(find(k)) or 0) for k, (i, s) in enumerate(sets)))


def rows(frame):
    return sorted((r[0] is None, r[0] or 0, r.n_shingles, r.component_id or 0) for r in frame.collect())


@needs_tables
def test_whole_table(spark):
    expected = brute(table("documents", "doc_id, text"))
    assert any(c != i for _, i, _, c in expected)
    assert rows(JOBS["op3_ngram_jaccard"](spark, FOLDER)) == expected


def copies(seed, groups, members, common):
    """Groups of edited copies, in chains and stars, with passages that many unrelated documents share."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    passages = [rng.choices(vocabulary, k=60) for _ in range(2)]
    docs = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([5, 30, 90, 200])) + (rng.choice(passages) if rng.random() < common else [])
        line = [base]
        for _ in range(members):
            text = list(rng.choice(line))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choices(vocabulary, k=rng.choice([0, 1, 2]))
            line.append(text)
        docs += [" ".join(t) for t in line]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_groups_of_near_copies(spark):
    for seed, groups, members, common in ((1, 8, 6, 0.8), (2, 1, 40, 1.0)):
        docs = copies(seed, groups, members, common)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        expected = brute(docs)
        assert len({c for *_, c in expected}) < len(docs)
        assert rows(document_components(frame)) == expected


def test_awkward_rows(spark, monkeypatch):
    frame = awkward(spark)
    expected = brute([(r.doc_id, r.text) for r in frame.collect()])
    assert rows(document_components(frame)) == expected
    assert document_components(frame.limit(0)).count() == 0
    extra = spark.createDataFrame([(None, "a b c d e f"), (None, "A B C D E F"), (9, None), (9, None), (4, "two of id")], "doc_id long, text string")
    kept = one_of_each_group(frame.unionByName(extra, allowMissingColumns=True))
    assert kept.columns == frame.columns
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "")[:2] for r in kept.collect())
    assert found == [(False, k) for k in (1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 9)] + [(True, 0)] * 2
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    assert rows(document_components(extra)) == brute([(r.doc_id, r.text) for r in extra.collect()])


def test_one_row_of_each_group(spark):
    docs = copies(3, 8, 5, 0.5)
    kept = one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in brute(docs)})


def test_hashed_sets_have_the_size_of_plain_ones():
    texts = ["", None, "a", "a b", "b a", "a b a b a b", "A B\tc\nD", "ÀB c d", "a b c", "x a b"]
    sets = shingle_sets(texts, 3)
    for x, a in zip(texts, sets, strict=True):
        assert len(a) == len(plain_set(x)) and np.all(np.diff(a) > 0)
        for y, b in zip(texts, sets, strict=True):
            assert len(np.intersect1d(a, b)) == len(plain_set(x) & plain_set(y)), (x, y)


def test_connect_long_chains(spark):
    n = 60
    labels = spark.range(n).select(F.col("id").alias("class"), F.col("id").alias("component"))
    links = spark.createDataFrame([(k, k + 1) for k in range(0, n - 1) if k % 20 != 19], "a long, b long")
    found = {r["class"]: r.component for r in connect(labels, links).collect()}
    assert found == {k: k // 20 * 20 for k in range(n)}
