"""Language-model scoring by a probabilistic suffix tree over words, beside a unigram baseline.

A context is a run of words.  It is a candidate if it was seen ``LEAST`` times, and its followers are the words
seen ``LEAST`` times after it (``context_share`` and ``next_share`` of all places, if a caller wants more).  A
candidate is kept if what follows it differs from what follows its own suffix by at least ``gain`` bits over all
its places (the divergence test); suffixes of kept contexts stay.  Every context predicts from its counts and
gives the rest of its mass to its suffix; the root is the baseline.  A word is scored in the longest kept suffix
of the words before it.

The logarithm of a word's share is a sum: the root's, and for every kept context of the words before it the share
it leaves to its suffix, corrected if the word is one of its followers.  So a text's score is the sum of one
table of entries over its runs of words.  Runs are counted length by length; a longer run is only counted if both
runs it is made of were seen often enough, so what was seen once is neither kept nor joined.  Counts, tree and
entries are Spark tables that grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import discard, saved_and_swept
from ebbtide.llm.symbols import CHUNK
from ebbtide.session import ship_package

#: Longest context in words, least shares of a context and of a word after it, least gain in bits, smoothing weight.
DEPTH, CONTEXT_SHARE, NEXT_SHARE, GAIN, SMOOTHING = 2, 0.0, 0.0, 32.0, 1.0
#: Least count of a context and of a word after it, whatever the shares.
LEAST = 2
#: Entries that every task holds, at most (24 bytes each); the rest are joined.
FREQUENT = 1_000_000
#: Tokens that a task counts, and that it scores, at a time, and bits of a filter of runs.
BLOCK, SCORED, BITS = 2_000_000, 500_000, 1 << 27
#: Bits of a key by which the runs of a block are counted part after part.
PART_BITS = 4
#: Key of the end of a text.
END_WORD = 0


def word_keys(words: Iterable[bytes], count: int = -1) -> np.ndarray:
    keys = pd.util.hash_array(np.fromiter(words, object, count), categorize=False).view(np.int64)
    keys[keys == END_WORD] = 1
    return keys


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ``wanted`` keys are there, and the places of those; both sides in the order of their unsigned values."""
    place = np.searchsorted(keys.view(np.uint64), wanted.view(np.uint64))
    hit = place < len(keys)
    hit[hit] = keys[place[hit]] == wanted[hit]
    return hit, place[hit]


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: what neighbours share is then easily compressed."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text with an end after them, and the number of tokens per text."""
    split = [t.split() for t in texts]
    lengths = np.array([len(w) + 1 for w in split], np.int64)
    keys = np.full(int(lengths.sum()), END_WORD, np.int64)
    body = np.ones(len(keys), bool)
    body[np.cumsum(lengths) - 1] = False
    keys[body] = word_keys(chain.from_iterable(split), len(keys) - len(lengths))
    return keys, lengths


def _joined(shorter: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Key of a run of words from that of the run without its first word and that of the run without its last."""
    mixed = shorter.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(factor)
    mixed += context.view(np.uint64)
    return mixed.view(np.int64)


def _runs(keys: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the runs of 1, 2 .. words that end at each token, and the token's place in its text.

    A run of ``d + 1`` words is there from place ``d`` on.
    """
    at = np.arange(len(keys), dtype=np.int32)
    at -= np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    runs = [keys]
    for _ in range(depth):
        longer = np.zeros(len(keys), np.int64)
        longer[1:] = _joined(runs[-1][1:], runs[-1][:-1])
        runs.append(longer)
    return runs, at


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the order of their unsigned values, a place of each, and how often each is there."""
    order = np.argsort(keys.view(np.uint64))
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)])
    return ordered[first].view(np.uint64), order[first], np.diff(np.r_[first, len(keys)])


def _put_together(parts: list[tuple[list, np.ndarray, np.ndarray]]) -> tuple[list, np.ndarray, np.ndarray]:
    ids, keys, lengths = zip(*parts, strict=True)
    parts.clear()
    return [i for some in ids for i in some], np.concatenate(keys), np.concatenate(lengths)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids (if there are any), tokens and lengths of the texts, some million tokens at a time.

    Texts and words become objects ``CHUNK`` bytes at a time; the others of a batch stay as they came.
    """
    parts: list[tuple[list, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("text").cast(pa.binary())
        ids = batch.column("id").to_pylist() if "id" in batch.schema.names else []
        bins = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // CHUNK
        edges = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(texts)]
        for low, high in zip(edges, edges[1:], strict=False):
            parts.append((ids[low:high], *_tokens([(t or b"").lower() for t in texts[low:high].to_pylist()])))
            if sum(len(keys) for _, keys, _ in parts) >= size:
                yield _put_together(parts)
    if parts:
        yield _put_together(parts)


def _shares(frame: DataFrame) -> int:
    """Equal ranges of keys that work is dealt out by."""
    return 3 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cuts(ordered: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares that keys in the order of their unsigned values lie in, and where each begins."""
    share = ((ordered.view(np.uint64) >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)
    which, cuts = np.unique(share.view(np.int64), return_index=True)
    return which, cuts


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the parts of ``values`` that begin at ``cuts``."""
    edges = (np.append(cuts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(edges), pa.py_buffer(values)])


def run_filter(keys: DataFrame) -> Broadcast:
    """A bitmap of bounded size that has the bit of each ``key``; other keys may share a bit."""
    place = F.col("key").bitwiseAND(F.lit(BITS - 1)) + 1
    found = (
        keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    bits = np.zeros(BITS // 8, np.uint8)
    for r in found.toLocalIterator():
        low = (r["bucket"] - 1) * 4096
        bits[low : low + 4096] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _may(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & (BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _counted(
    keys: np.ndarray, sizes: np.ndarray, lengths: Sequence[int], known: np.ndarray | None, shares: int
) -> Iterator[pa.RecordBatch]:
    """Distinct runs of a block as arrays per share, a part of all keys at a time."""
    runs, at = _runs(keys, sizes, max(lengths))
    for length in lengths:
        part = (runs[length].view(np.uint64) >> np.uint64(64 - PART_BITS)).astype(np.uint8)
        part[at < length] = 1 << PART_BITS
        for number in range(1 << PART_BITS):
            spot = np.flatnonzero(part == number)
            if length and known is not None:
                spot = spot[_may(known, runs[length - 1][spot])]
                spot = spot[_may(known, runs[length - 1][spot - 1])]
            found, first, n = _distinct(runs[length][spot])
            which, cuts = _cuts(found, shares)
            if not len(which):
                continue
            if length:
                context = _binaries(runs[length - 1][spot[first] - 1], cuts)
                shorter = _binaries(runs[length - 1][spot[first]], cuts)
            else:
                context, shorter = pa.array([b""] * len(cuts), pa.binary()), _binaries(found, cuts)
            yield pa.record_batch(
                [pa.array(np.full(len(which), length, np.int32)), pa.array(which), context, shorter, _binaries(n.astype(np.int64), cuts)],
                ["length", "share", "context", "shorter", "n"],
            )


def count_runs(texts: DataFrame, lengths: Sequence[int], known: Broadcast | None) -> DataFrame:
    """Runs of ``length + 1`` words of ``texts`` (``text``): ``length``, ``key``, ``context``, ``shorter``, ``n``.

    ``context`` is the run without its last word, ``shorter`` the one without its first.  Single words are all
    there, longer runs from a count of ``LEAST`` on; ``known`` is a filter of the runs that both must pass.
    Tasks count their own runs and send them as arrays, dealt out by ranges of keys.
    """
    shares = _shares(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, sizes in _blocks(batches, BLOCK):
            yield from _counted(keys, sizes, lengths, None if known is None else known.value, shares)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        length = int(part["length"].iloc[0])
        context, shorter, n = (np.concatenate([np.frombuffer(b, np.int64) for b in part[c]]) for c in ("context", "shorter", "n"))
        key = _joined(shorter, context) if length else shorter
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.add.reduceat(n[order], first)
        often = n >= (LEAST if length else 1)
        from_ = order[first[often]]
        ends = {"context": context[from_], "shorter": shorter[from_]} if length else {"context": 0, "shorter": 0}
        return pd.DataFrame({"length": length, "key": key[first[often]]} | ends | {"n": n[often]})

    dealt = texts.select("text").mapInArrow(count, "length int, share long, context binary, shorter binary, n binary")
    return dealt.groupBy("length", "share").applyInPandas(add, "length int, key long, context long, shorter long, n long")


def learn_level(runs: DataFrame, shorter: DataFrame, least: int, gain: float, smoothing: float) -> tuple[DataFrame, DataFrame]:
    """Followers of one length with ``lower``, their probability in the suffix, and the contexts with their counts.

    ``shorter`` has ``key``, ``context``, ``n`` and ``p``.  A word that follows a context often enough follows its
    suffix at least as often, so the joins find them all.  A context passes the divergence test or not.
    """
    lower = shorter.select(F.col("key").alias("shorter"), F.col("context").alias("suffix"), F.col("p").alias("lower"))
    level = saved_and_swept(runs.join(lower, "shorter").select("key", "context", "suffix", "n", "lower"))
    sums = level.groupBy("context").agg(
        F.max("suffix").alias("suffix"),
        F.sum("n").alias("often"),
        F.sum(F.col("n") * F.log2(F.col("n") / F.col("lower"))).alias("bits"),
        F.least(F.greatest(1 - F.sum("lower"), F.lit(1e-300)), F.lit(1.0)).alias("other"),
    )
    left, total = F.col("left"), F.col("total")
    tail = F.when(left > 0, left * F.log2(left / total / F.col("other"))).otherwise(0.0)
    contexts = (
        sums.join(shorter.select(F.col("key").alias("context"), F.col("n").alias("total")), "context")
        .where(total >= least)
        .withColumn("left", total - F.col("often"))
        .withColumn("passed", F.col("bits") - F.col("often") * F.log2("total") + tail >= gain)
        .select("context", "suffix", "total", "left", ((left + smoothing) / (total + smoothing)).alias("rest"), "passed")
    )
    return level.drop("suffix"), saved_and_swept(contexts)


def with_share(level: DataFrame, contexts: DataFrame, smoothing: float) -> DataFrame:
    """Followers of ``contexts`` with their probability ``p`` there."""
    share = (F.col("n") + (F.col("left") + smoothing) * F.col("lower")) / (F.col("total") + smoothing)
    return level.join(contexts.select("context", "total", "left", "rest"), "context").withColumn("p", share)


def learn_entries(
    texts: DataFrame, depth: int, context_share: float, next_share: float, gain: float, smoothing: float
) -> tuple[DataFrame, int, float]:
    """What the runs of a text add to its score, all tokens learnt from, and log10 of the share of an unknown word.

    Entries have ``key``, ``n`` (how often the run was seen), ``value`` and ``word`` (the value is the root's, beyond
    that of an unknown word); entries with the same key add up.
    """
    counted = saved_and_swept(count_runs(texts, [0, 1], None))
    words = saved_and_swept(counted.where("length = 0").select("key", "context", "n"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least, rare = (max(LEAST, int(np.ceil(share * total))) for share in (context_share, next_share))
    mass = total + 0.5 * (distinct + 1)
    shorter = words.withColumn("p", (F.col("n") + 0.5) / mass)
    unknown = float(np.log10(0.5 / mass))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for length in range(1, depth + 1):
        if length > 1:
            known = run_filter(shorter)
            counted = saved_and_swept(count_runs(texts, [length], known))
            known.destroy()
        runs = counted.where((F.col("length") == length) & (F.col("n") >= rare))
        levels.append(learn_level(runs, shorter, least, gain, smoothing))
        done = [counted] if length == 1 else [counted, shorter]
        if length < depth:
            shorter = saved_and_swept(with_share(*levels[-1], smoothing).select("key", "context", "n", "p"))
        discard(*done)
    entries = [words.select("key", "n", (F.log10((F.col("n") + 0.5) / mass) - unknown).alias("value"), F.lit(True).alias("word"))]
    above: DataFrame | None = None
    for level, contexts in reversed(levels):
        kept = contexts.where("passed")
        if above is not None:
            kept = contexts.join(above, "context", "left").where("passed OR above")
        above = kept.select(F.col("suffix").alias("context"), F.lit(True).alias("above")).distinct()
        value = F.log10(F.col("p") / F.col("lower") / F.col("rest"))
        entries.append(with_share(level, kept, smoothing).select("key", "n", value.alias("value"), F.lit(False).alias("word")))
        entries.append(
            kept.select(F.col("context").alias("key"), F.col("total").alias("n"), F.log10("rest").alias("value"), F.lit(False).alias("word"))
        )
    out = entries[0]
    for more in entries[1:]:
        out = out.unionByName(more)
    out = saved_and_swept(out)
    discard(words, *[table for level in levels for table in level])
    return out, total, unknown


def _summed(key: np.ndarray, value: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of entries in the order of their unsigned values, and their values: for the score, for the root."""
    order = np.argsort(key.view(np.uint64))
    ordered = key[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(key)])
    return ordered[first], np.stack([np.add.reduceat(w[order], first) for w in (value, np.where(word, value, 0.0))])


def _sums(owner: np.ndarray, place: np.ndarray, values: np.ndarray, rows: int) -> list[np.ndarray]:
    """Score, root's score and known words of each of ``rows`` from entries at ``place``."""
    root = values[1][place]  # a word learnt from has a larger share than an unknown one, so the root's value is above 0
    word = root > 0
    return [
        np.bincount(owner, values[0][place], rows),
        np.bincount(owner[word], root[word], rows),
        np.bincount(owner[word], minlength=rows).astype(float),
    ]


def _held(entries: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and values (score, base) of the runs seen at least so often that they are ``most`` at most, and that count."""
    sizes = entries.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    needed = next((k for k in range(1, 1001) if sum(r["rows"] for r in sizes if r["n"] >= k) <= most), 1 << 62)
    found = entries.where(F.col("n") >= needed).select("key", "value", "word").toArrow()
    return *_summed(*(found[c].to_numpy() for c in ("key", "value", "word"))), needed


def score_texts(
    frame: DataFrame,
    learn: str,
    key: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    context_share: float = CONTEXT_SHARE,
    next_share: float = NEXT_SHARE,
    gain: float = GAIN,
    smoothing: float = SMOOTHING,
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``frame``: ``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows where the SQL condition ``learn`` holds are learnt from.  Words are split at ASCII white space, A-Z lowered.
    A NULL text counts as empty: it has the end alone.  Rows are told apart by number, so repeated rows and
    NULL keys keep their own results; an empty frame gives an empty result; with nothing to learn from,
    every score is 0.  Other columns are not looked at.  Words and runs are told apart by 64-bit hashes.
    ``frequent`` is how many entries at most are sent to the tasks; it does not change results.
    """
    ship_package(frame.sparkSession)
    rows = frame.select(
        F.col(key).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.expr(learn), F.lit(False)).alias("learn")
    )
    entries, total, unknown = learn_entries(rows.where("learn").select("text"), depth, context_share, next_share, gain, smoothing)
    *held, needed = _held(entries, frequent)
    names, values = (frame.sparkSession.sparkContext.broadcast(x) for x in held)
    known, shares = run_filter(entries), _shares(frame)
    schema = "share long, block long, keys binary, owners binary, own binary, ids array<string>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the entries that are here; the other keys go to their shares, a text is its number in the block."""
        task = TaskContext.get().partitionId()
        for number, (ids, keys, lengths) in enumerate(_blocks(batches, SCORED)):
            runs, at = _runs(keys, lengths, depth)
            owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            spots = [np.flatnonzero((at >= length) & _may(known.value, run)) for length, run in enumerate(runs)]
            wanted = np.concatenate([run[spot] for run, spot in zip(runs, spots, strict=True)])
            whose = np.concatenate([owner[spot] for spot in spots])
            order = np.argsort(wanted.view(np.uint64))
            whose, wanted = whose[order], wanted[order]
            hit, place = _found(names.value, wanted)
            sums = _sums(whose[hit], place, values.value, len(lengths))
            whose, wanted = whose[~hit], wanted[~hit]
            which, cuts = _cuts(wanted, shares)
            cut = lambda x: [_packed(p) for p in np.split(x, cuts[1:])] if len(which) else []
            block = (task << 32) + number
            own = np.concatenate([lengths.astype(float), *sums]).tobytes()
            yield pa.RecordBatch.from_pylist([{"share": block % shares, "block": block, "keys": b"", "owners": b"", "own": own, "ids": ids}], kinds)
            asked = {"share": which, "block": np.full(len(which), block), "keys": cut(wanted), "owners": cut(whose)}
            yield pa.RecordBatch.from_pydict(asked | {"own": [None] * len(which), "ids": [None] * len(which)}, kinds)

    kinds = pa.schema(
        [("share", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("own", pa.binary()), ("ids", pa.list_(pa.string()))]
    )

    def answer(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keys, worth = _summed(*(found[c].to_numpy() for c in ("key", "value", "word")))
        out = []
        for r in asked.itertuples():
            if r.own is not None:
                out.append((r.block, b"", r.own, r.ids))
                continue
            hit, place = _found(keys, _unpacked(r.keys, np.int64))
            owners = _unpacked(r.owners, np.int32)[hit]
            texts = np.flatnonzero(np.bincount(owners))
            sums = np.stack(_sums(owners, place, worth, texts[-1] + 1 if len(texts) else 0))[:, texts]
            out.append((r.block, _packed(texts.astype(np.int32)), sums.tobytes(), None))
        return pd.DataFrame(out, columns=["block", "owners", "sums", "ids"])

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        own = part["ids"].notna()
        ids = part.loc[own, "ids"].iloc[0]
        n, *sums = np.frombuffer(part.loc[own, "sums"].iloc[0]).reshape(4, -1).copy()
        for owners, more in zip(part.loc[~own, "owners"], part.loc[~own, "sums"], strict=True):
            texts = _unpacked(owners, np.int32)  # each once
            for total_, added in zip(sums, np.frombuffer(more).reshape(3, -1), strict=True):
                total_[texts] += added
        score, base, words = sums
        found = {"n_tokens": n.astype(np.int64), "n_known": words.astype(np.int64)}
        return pd.DataFrame({"id": pd.Series(list(ids), dtype=object)} | found | {"base": base + n * unknown, "score": score + n * unknown})

    asked = rows.select("id", "text").mapInArrow(ask, schema)
    share = F.shiftright(F.shiftrightunsigned("key", 32) * shares, 32)
    rest = entries.where(F.col("n") < needed).select(share.alias("share"), "key", "value", "word")
    answers = asked.groupBy("share").cogroup(rest.groupBy("share")).applyInPandas(
        answer, "block long, owners binary, sums binary, ids array<string>"
    )
    both = answers.groupBy("block").applyInPandas(finish, "id string, n_tokens long, n_known long, base double, score double")
    return both.select(
        F.col("id").cast(frame.schema[key].dataType).alias(key),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
