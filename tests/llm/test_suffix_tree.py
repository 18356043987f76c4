import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ebbtide.llm import suffix_tree
from ebbtide.llm.jobs import JOBS
from ebbtide.llm.suffix_tree import score_texts
from tests.llm.helpers import FOLDER, awkward, needs_tables, table


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute_base(docs, learn):
    counts = Counter(w for d, t in docs if learn(d) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    return total, {
        d: (
            len(tokens(t)),
            sum(counts[w] > 0 for w in tokens(t)),
            sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(t)),
        )
        for d, t in docs
    }


@needs_tables
def test_base_of_whole_table_and_gain_of_the_tree(spark):
    docs = table("documents", "doc_id, text")
    total, expected = brute_base(docs, lambda d: zlib.crc32(str(d).encode()) % 5 != 1)
    rows = JOBS["op10_lm_score"](spark, FOLDER).collect()
    assert len(rows) == len(docs) and {r.train_tokens for r in rows} == {total}
    for r in rows:
        assert (r.n_tokens, r.n_known) == expected[r.doc_id][:2]
        assert math.isclose(r.base_score, expected[r.doc_id][2], rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    tested = [r for r in rows if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


class PlainTree:
    """The same model with dictionaries over tuples of words."""

    def __init__(self, texts, depth, context_share, next_share, gain, smoothing):
        self.counts, self.totals = {}, Counter()
        self.words = Counter(w for t in texts for w in t)
        self.size, self.smoothing = sum(self.words.values()), smoothing
        least, rare = max(2, math.ceil(context_share * self.size)), max(2, math.ceil(next_share * self.size))
        for t in texts:
            for at in range(len(t)):
                for d in range(1, min(depth, at) + 1):
                    self.totals[tuple(t[at - d : at])] += 1
                    self.counts.setdefault(tuple(t[at - d : at]), Counter())[t[at]] += 1
        self.after = {
            s: {w: n for w, n in c.items() if n >= rare} for s, c in self.counts.items() if self.totals[s] >= least
        }
        self.kept = set()
        for s, after in self.after.items():
            total, left = self.totals[s], self.totals[s] - sum(after.values())
            bits = sum(n * math.log2(n / total / self.share(s[1:], w)) for w, n in after.items())
            if left:
                bits += left * math.log2(left / total / max(1e-300, 1 - sum(self.share(s[1:], w) for w in after)))
            if bits >= gain:
                self.kept |= {s[k:] for k in range(len(s))}

    def share(self, s, w):
        if not s:
            return (self.words[w] + 0.5) / (self.size + 0.5 * (len(self.words) + 1))
        after = self.after[s]
        left = self.totals[s] - sum(after.values()) + self.smoothing
        return (after.get(w, 0) + left * self.share(s[1:], w)) / (self.totals[s] + self.smoothing)

    def score(self, t, depth):
        total = 0.0
        for at, w in enumerate(t):
            s = next((tuple(t[at - d : at]) for d in range(min(depth, at), 0, -1) if tuple(t[at - d : at]) in self.kept), ())
            total += math.log10(self.share(s, w))
        return total


@pytest.mark.parametrize("depth, gain, context_share, next_share", [(1, 1, 0, 0), (2, 2, 0.005, 0.002), (3, 0.5, 0.002, 0), (3, 20, 0, 0)])
def test_tree_equals_plain_tree(spark, depth, gain, context_share, next_share):
    rng = np.random.default_rng(depth)
    docs = []
    for d in range(40):
        text = []
        for _ in range(int(rng.integers(0, 12))):
            text += ["to be or not", "the cat sat", "a b", str(rng.choice(list("abcxyz")))][int(rng.integers(0, 4))].split()
        docs.append((d, " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = PlainTree([tokens(t) for d, t in docs if d < 30], depth, context_share, next_share, gain, 1.5)
    options = dict(depth=depth, context_share=context_share, next_share=next_share, gain=gain, smoothing=1.5)
    for frequent in (10_000,) if depth != 2 else (10_000, len(plain.words)):
        got = {r.doc_id: r.score for r in score_texts(frame, "doc_id < 30", frequent=frequent, **options).collect()}
        for d, t in docs:
            assert math.isclose(got[d], plain.score(tokens(t), depth), rel_tol=1e-9, abs_tol=1e-9), d
    assert any(len(s) == depth for s in plain.kept) or gain == 20
    for s in plain.kept:
        everything = sum(plain.share(s, w) for w in plain.words)
        assert math.isclose(everything + (0.5 / (plain.size + 0.5 * (len(plain.words) + 1))) * math.prod(
            (plain.totals[s[k:]] - sum(plain.after[s[k:]].values()) + 1.5) / (plain.totals[s[k:]] + 1.5) for k in range(len(s))
        ), 1, rel_tol=1e-9)


def test_awkward_rows_and_rare_words(spark, monkeypatch):
    frame = awkward(spark)
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    total, expected = brute_base(docs, lambda d: d != 5)
    for frequent in (3, 100):
        out = score_texts(frame, "coalesce(doc_id != 5, true)", frequent=frequent)
        rows = out.collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert (r.n_tokens, r.n_known) == expected[r.doc_id][:2] and r.train_tokens == total
            assert math.isclose(r.base_score, expected[r.doc_id][2], rel_tol=1e-9) and r.score < 0
    none = score_texts(frame, "false").collect()
    assert len(none) == len(docs) and {r.n_known for r in none} == {0} and {r.base_score for r in none} == {0.0}
    assert score_texts(frame.limit(0), "true").count() == 0


@pytest.mark.parametrize("frequent", [3, 1_000])
def test_rare_contexts_and_words_stay_in_a_large_corpus(spark, frequent):
    docs = [(d, "filler " * 4_000) for d in range(80)]
    docs += [(100 + d, f"red{d % 30} fox{d % 30} ran{d % 30} home") for d in range(60)]
    docs += [(200 + d, f"red{d} fox{d} ran{d} off") for d in range(30)]
    plain = PlainTree([tokens(t) for d, t in docs if d < 200], 2, 0, 0, 2, 1.0)
    assert sum(plain.totals[s] == 2 for s in plain.kept) >= 90
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(frame, "doc_id < 200", gain=2, frequent=frequent).collect()}
    for d, t in docs:
        assert math.isclose(got[d], plain.score(tokens(t), 2), rel_tol=1e-9, abs_tol=1e-9), d


def test_what_was_seen_once_is_not_kept(spark, monkeypatch):
    """Runs of words that were seen once are no rows of any table; large ids beside NULL stay exact."""
    tables = []
    save = suffix_tree.saved_and_swept
    monkeypatch.setattr(suffix_tree, "saved_and_swept", lambda frame: tables.append(save(frame)) or tables[-1])
    monkeypatch.setattr(suffix_tree, "discard", lambda *frames: None)
    once = [(2**53 + 1 + d, " ".join(f"w{d}x{k}" for k in range(50))) for d in range(20)]
    docs = [*once, (None, "to be or not"), (7, "to be or not")]
    rows = score_texts(spark.createDataFrame(docs, "doc_id long, text string"), "true", gain=0, frequent=5).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(d or 0 for d, _ in docs)
    longer = [r for t in tables if "length" in t.columns for r in t.where("length > 0").collect()]
    assert sorted(r.length for r in longer) == [1] * 4 + [2] * 3 and {r.n for r in longer} == {2}
    plain = PlainTree([tokens(t) for _, t in docs], 2, 0, 0, 0, 1.0)
    for r in rows:
        text = dict(docs)[r.doc_id]
        assert math.isclose(r.score, plain.score(tokens(text), 2), rel_tol=1e-9)


def test_a_task_makes_objects_of_a_few_texts_at_a_time():
    """A batch of 50 MB and the counts of its runs take little beside it, and go out in small parts."""
    rng = np.random.default_rng(0)
    words = [f"{k:x}".rjust(32, "w") for k in range(50_000)]
    batch = pa.record_batch([pa.array([" ".join(words[k] for k in rng.integers(0, 50_000, 400)) for _ in range(4_000)])], ["text"])
    seen, largest, before = Counter(), 0, pa.total_allocated_bytes()
    tracemalloc.start()
    for _, keys, sizes in suffix_tree._blocks(iter([batch]), 2_000_000):
        for part in suffix_tree._counted(keys, sizes, [0, 1], None, 30):
            largest = max(largest, part.nbytes)
            for length, n in zip(part["length"].to_pylist(), part["n"].to_pylist(), strict=True):
                seen[length] += int(np.frombuffer(n, np.int64).sum())
    peak = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert seen == {0: 4_000 * 401, 1: 4_000 * 400}
    assert peak < 120e6 and largest < 5e6


def test_blocks_read_null_empty_and_long_texts():
    texts = ["A b", None, "", "c " * 2_000_000, "é B\x0b"]
    batch = pa.record_batch([pa.array([str(k) for k in range(5)]), pa.array(texts)], ["id", "text"])
    blocks = list(suffix_tree._blocks(iter([batch.slice(0, 0), batch, batch.slice(4)]), 3))
    assert [i for ids, _, _ in blocks for i in ids] == ["0", "1", "2", "3", "4", "4"]
    assert np.concatenate([n for _, _, n in blocks]).tolist() == [3, 1, 1, 2_000_001, 3, 3]
    assert np.array_equal(np.concatenate([k for _, k, _ in blocks])[[0, 1, 2]], suffix_tree.word_keys([b"a", b"b", b"x"])[[0, 1]].tolist() + [0])


def test_sorted_keys_are_found_in_unsigned_order():
    keys = np.array([1, 5, 2**63 - 1, -(2**63), -7, -1], np.int64)
    wanted = np.array([0, 1, 1, 6, -(2**63), -8, -7, -1, -1], np.int64)
    hit, place = suffix_tree._found(keys, wanted)
    assert hit.tolist() == [False, True, True, False, True, False, True, True, True] and place.tolist() == [0, 0, 3, 4, 5, 5]
    assert not suffix_tree._found(keys[:0], wanted)[0].any() and not suffix_tree._found(keys[:2], wanted)[0][3:].any()
    assert suffix_tree._found(keys, wanted[:0])[1].tolist() == []


def test_words_have_keys_of_their_own():
    words = [b"a", b"a\x00", b"a\x00b", b"\xff", "é".encode(), b"w" * 100_000, b"w" * 100_001]
    keys = suffix_tree.word_keys(iter(words * 2), 14)
    assert len(set(keys.tolist())) == 7 and keys[:7].tolist() == keys[7:].tolist() and suffix_tree.END_WORD not in keys
    assert len(suffix_tree.word_keys(iter([]), 0)) == 0
