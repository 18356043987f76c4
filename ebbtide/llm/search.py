"""Ranked lexical search over all documents with Block-Max MaxScore.

Documents are indexed in shards.  A shard holds, per term, its postings in blocks of 128 documents, packed at the
least width, and a directory with the last document, largest count and shortest text of every block.  A search
takes the terms of an item in the order of their largest possible score.  As long as the bounds of the first terms
together stay below the score of the last place, a document must hold one of the other, essential terms: these
lists alone are read for candidates.  The first lists are asked for a candidate only while its score and the maxima
of the blocks it falls into can still reach the last place; blocks that no candidate needs are never unpacked.
Every task keeps one heap per item over all its shards, and the heaps are merged by score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm.common import saved, saved_in_loop
from ebbtide.session import ship_package

#: Bytes of text in a shard (a longer text has its own), postings in a block, documents scored at a time.
SHARD_BYTES, BLOCK, STRIDE = 4_000_000, 128, 2_048
#: Bytes of item text searched for at a time: their terms go to every task.
ITEM_BYTES = 4_000_000
#: Heaps of an item are merged in so many groups before the last merge.
MERGE = 32
#: Bytes that belong to terms (A-Z lowered); all others separate.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_WIDTHS = (np.uint8, np.uint16, np.uint32)
INDEX = (
    "doc_ids array<long>, lengths binary, terms binary, sizes binary, last_doc binary, most binary, shortest binary, "
    "doc_width binary, count_width binary, postings binary"
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if isinstance(text, str) else []


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 at the least width that holds them all, which is the first byte."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.int64)


def _blocks(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First block of each list (and the end of the last), its postings per block, and where each block's begin."""
    counts = -(-sizes // block)
    first = np.concatenate([[0], np.cumsum(counts)])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    in_block = np.minimum(np.repeat(sizes, counts) - inside * block, block)
    return first, in_block, np.concatenate([[0], np.cumsum(in_block)])[:-1]


def _width(largest: np.ndarray) -> np.ndarray:
    return (largest > 0xFF).astype(np.uint8) + (largest > 0xFFFF)


def make_shard(doc_ids: list, codes: list[np.ndarray], vocabulary: list[bytes], block: int = BLOCK) -> dict:
    """Index of one shard: ``codes`` are the numbers of each document's terms in ``vocabulary``."""
    lengths = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes).astype(np.int64) if codes else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(codes), dtype=np.int64), lengths)
    pairs, counts = np.unique(flat * max(len(codes), 1) + owner, return_counts=True)
    term, doc = np.divmod(pairs, max(len(codes), 1))
    sizes = np.bincount(term, minlength=len(vocabulary))
    _, in_block, low = _blocks(sizes, block)
    gaps = np.diff(doc, prepend=0)
    gaps[low] = doc[low]  # the first document of a block is written whole

    def over_blocks(fold: np.ufunc, values: np.ndarray) -> np.ndarray:
        return fold.reduceat(values, low) if len(low) else low

    most = over_blocks(np.maximum, counts)
    doc_width, count_width = _width(over_blocks(np.maximum, gaps)), _width(most)
    packed = []
    for a, b, dw, cw in zip(low.tolist(), (low + in_block).tolist(), doc_width.tolist(), count_width.tolist(), strict=True):
        packed.append(gaps[a:b].astype(_WIDTHS[dw]).tobytes() + counts[a:b].astype(_WIDTHS[cw]).tobytes())
    return {
        "doc_ids": doc_ids,
        "lengths": _pack(lengths),
        "terms": b" ".join(vocabulary),
        "sizes": _pack(sizes),
        "last_doc": _pack(over_blocks(np.maximum, doc)),
        "most": _pack(most),
        "shortest": _pack(over_blocks(np.minimum, lengths[doc])),
        "doc_width": doc_width.tobytes(),
        "count_width": count_width.tobytes(),
        "postings": b"".join(packed),
    }


def build_index(frame: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """Shards of all documents with a term, one row each, written to the shared folder.

    A shard is a run of documents of one input partition, so nothing is shuffled.  Terms of any document, whatever
    is searched for later, are in it.
    """
    ship_package(frame.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        codes: list[np.ndarray] = []
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        held = 0
        for batch in batches:
            for doc_id, body in zip(batch["id"].astype("Int64"), batch["text"], strict=True):
                terms = terms_of(body)
                if not terms:
                    continue
                ids.append(None if doc_id is pd.NA else int(doc_id))
                codes.append(np.fromiter(map(numbers.__getitem__, terms), np.int32, len(terms)))
                held += len(body)
                if held >= shard_bytes:
                    yield pd.DataFrame([make_shard(ids, codes, list(numbers), block)])
                    ids, codes, numbers, held = [], [], defaultdict(count().__next__), 0
        if ids:
            yield pd.DataFrame([make_shard(ids, codes, list(numbers), block)])

    rows = frame.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return saved_in_loop(rows.mapInPandas(build, INDEX))


def _impact(counts: np.ndarray, measure: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1_000 * counts + 20 * measure)


class Shard:
    """A shard as a search reads it: block bounds for all lists, postings unpacked one block at a time."""

    def __init__(self, row: dict, documents: int, tokens: int, block: int = BLOCK):
        self.lengths = _unpack(row["lengths"])
        self.measure = 50 + (50 * self.lengths * documents) // tokens
        self.ids = pd.array(row["doc_ids"], dtype="Int64")
        self.number = {t: k for k, t in enumerate(row["terms"].split(b" "))}
        self.first_block, self.n_docs, _ = _blocks(_unpack(row["sizes"]), block)
        self.last_doc = _unpack(row["last_doc"])
        widths = [np.frombuffer(row[c], np.uint8) for c in ("doc_width", "count_width")]
        taken = self.n_docs * sum(np.array([np.dtype(t).itemsize for t in _WIDTHS])[w] for w in widths)
        self.place = np.concatenate([[0], np.cumsum(taken)])
        self.widths, self.postings = widths, row["postings"]
        shortest = 50 + (50 * _unpack(row["shortest"]) * documents) // tokens
        self.bound = _impact(_unpack(row["most"]), shortest)
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their scores before the weight of the term."""
        if b not in self.unpacked:
            n, at = int(self.n_docs[b]), int(self.place[b])
            dw, cw = _WIDTHS[self.widths[0][b]], _WIDTHS[self.widths[1][b]]
            docs = np.cumsum(np.frombuffer(self.postings, dw, n, at), dtype=np.int64)
            counts = np.frombuffer(self.postings, cw, n, at + n * np.dtype(dw).itemsize).astype(np.int64)
            self.unpacked[b] = docs, _impact(counts, self.measure[docs])
        return self.unpacked[b]


class Heap:
    """The best documents of an item so far: highest score first, then lowest id, ids that are NULL last."""

    def __init__(self, most: int):
        self.most, self.scores = most, np.empty(0, np.int64)
        self.ids, self.absent = np.empty(0, np.int64), np.empty(0, bool)

    @property
    def needed(self) -> int:
        """Least score that can still enter (an equal one may, by its id)."""
        return max(int(self.scores[-1]), 1) if len(self.scores) == self.most else 1

    def add(self, scores: np.ndarray, ids: pd.api.extensions.ExtensionArray) -> None:
        absent = np.asarray(ids.isna())
        scores = np.concatenate([self.scores, scores])
        plain = np.concatenate([self.ids, ids.fillna(0).to_numpy(np.int64)])
        absent = np.concatenate([self.absent, absent])
        best = np.lexsort((plain, absent, -scores))[: self.most]
        self.scores, self.ids, self.absent = scores[best], plain[best], absent[best]


def search_shard(shard: Shard, terms: list[bytes], weights: np.ndarray, heap: Heap, stride: int = STRIDE) -> None:
    """Block-Max MaxScore of one item over one shard."""
    found = [(shard.number[t], int(w)) for t, w in zip(terms, weights, strict=True) if w > 0 and t in shard.number]
    if not found:
        return
    spans = [(int(shard.first_block[c]), int(shard.first_block[c + 1])) for c, _ in found]
    largest = np.array([w * int(shard.bound[a:b].max()) for (_, w), (a, b) in zip(found, spans, strict=True)], np.int64)
    order = np.argsort(largest, kind="stable")
    weights = [found[i][1] for i in order]
    spans = [spans[i] for i in order]
    below = np.concatenate([[0], np.cumsum(largest[order])])  # below[k]: what the first k lists can give together
    ends = [shard.last_doc[a:b] for a, b in spans]
    for low in range(0, len(shard.lengths), stride):
        high = min(low + stride, len(shard.lengths))
        split = int(np.searchsorted(below, heap.needed, "left")) - 1  # lists 0 .. split - 1 are not essential
        if split == len(spans):
            return
        scores = np.zeros(high - low, np.int64)
        for k in range(split, len(spans)):
            (a, _), last = spans[k], ends[k]
            for b in range(int(np.searchsorted(last, low)), min(int(np.searchsorted(last, high - 1)) + 1, len(last))):
                docs, gains = shard.block(a + b)
                i, j = np.searchsorted(docs, (low, high))
                scores[docs[i:j] - low] += weights[k] * gains[i:j]
        here = np.flatnonzero((scores > 0) & (scores + below[split] >= heap.needed))
        if not len(here):
            continue
        scores, docs = scores[here], here + low
        if split:
            at = [np.searchsorted(ends[k], docs) for k in range(split)]
            most = np.zeros((split, len(docs)), np.int64)
            for k in range(split):
                held = at[k] < len(ends[k])
                most[k, held] = weights[k] * shard.bound[spans[k][0] + at[k][held]]
            rest = most.sum(axis=0)
            alive = scores + rest >= heap.needed
            for k in range(split - 1, -1, -1):
                for b in np.unique(at[k][alive & (most[k] > 0)]).tolist():
                    mine = np.flatnonzero(alive & (at[k] == b))
                    members, gains = shard.block(spans[k][0] + b)
                    spot = np.minimum(np.searchsorted(members, docs[mine]), len(members) - 1)
                    scores[mine] += np.where(members[spot] == docs[mine], weights[k] * gains[spot], 0)
                rest = rest - most[k]
                alive &= scores + rest >= heap.needed
            scores, docs = scores[alive], docs[alive]
        good = scores >= heap.needed
        if good.any():
            heap.add(scores[good], shard.ids[docs[good]])


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_dict("records")


def document_frequencies(index: DataFrame, terms: Broadcast) -> dict[bytes, int]:
    """In how many documents each of ``terms`` (of one block of items) is."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = terms.value
        for row in _rows(batches):
            sizes = _unpack(row["sizes"])
            found = [(wanted[t], sizes[k]) for k, t in enumerate(row["terms"].split(b" ")) if t in wanted]
            yield pd.DataFrame(found, columns=["term", "n"])

    counted = index.select("terms", "sizes").mapInPandas(look, "term long, n long").groupBy("term").agg(F.sum("n"))
    number = {r[0]: r[1] for r in counted.collect()}
    return {t: number.get(k, 0) for t, k in terms.value.items()}


def item_blocks(items: DataFrame, item_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items (``row``, ``text``) in blocks of bounded size."""
    block, held = [], 0
    for r in items.toLocalIterator():
        block.append((r["row"], r["text"]))
        held += len(r["text"]) + 100
        if held >= item_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _search_items(
    index: DataFrame, part: list[tuple[int, str]], documents: int, tokens: int, most: int, block: int, stride: int
) -> DataFrame:
    context = index.sparkSession.sparkContext
    queries = [(row, list(dict.fromkeys(terms_of(text)))) for row, text in part]
    terms = {t: k for k, t in enumerate(dict.fromkeys(t for _, ts in queries for t in ts))}
    frequencies = document_frequencies(index, context.broadcast(terms))
    weight = {t: int(np.floor(1000 * np.log((2 * documents + 2) / (2 * n + 1)))) for t, n in frequencies.items()}
    shared = context.broadcast([(row, ts, np.array([weight[t] for t in ts], np.int64)) for row, ts in queries])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps = [Heap(most) for _ in shared.value]
        for row in _rows(batches):
            shard = Shard(row, documents, tokens, block)
            for (_, ts, weights), heap in zip(shared.value, heaps, strict=True):
                search_shard(shard, ts, weights, heap, stride)
        for (item, _, _), heap in zip(shared.value, heaps, strict=True):
            if len(heap.scores):
                ids = pd.array(heap.ids, dtype="Int64")
                ids[heap.absent] = pd.NA
                yield pd.DataFrame({"row": item, "doc_id": ids, "score": heap.scores})

    return index.mapInPandas(search, "row long, doc_id long, score long")


def search(
    documents: DataFrame,
    items: DataFrame,
    most: int = 50,
    shard_bytes: int = SHARD_BYTES,
    block: int = BLOCK,
    stride: int = STRIDE,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The ``most`` best documents of every item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    ``documents`` needs ``doc_id`` (a whole number) and ``text``, ``items`` ``item_id`` and ``text``; other columns
    are not looked at.  Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered,
    of the whole text; NULL and empty texts have none and match nothing.  Equal scores go by ascending doc_id (NULL
    last); repeated documents each have their own place, repeated items their own results.  Empty tables give an
    empty result.  Scores are whole numbers and exact: bounds only skip what cannot reach the last place.

    Memory of a task: the shards of one batch and the heaps of one block of items.  The driver holds the terms of
    one block of items (``item_bytes``) and their frequencies, whatever the number of documents.
    """
    index = build_index(documents, shard_bytes=shard_bytes, block=block)
    totals = index.select(
        F.size("doc_ids").cast("long").alias("n"), "lengths"
    ).mapInPandas(_shard_totals, "n long, tokens long").agg(F.sum("n"), F.sum("tokens")).first()
    number, tokens = totals[0] or 0, totals[1] or 0
    numbered = saved(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    found = items.sparkSession.createDataFrame([], "row long, doc_id long, score long")
    if number:
        for part in item_blocks(numbered, item_bytes):
            found = found.unionAll(saved_in_loop(_search_items(index, part, number, tokens, most, block, stride)))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = Window.partitionBy("row", "group").orderBy(*best)
    last = Window.partitionBy("row").orderBy(*best)
    merged = (
        found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= most)
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= most)
    )
    return merged.join(numbered.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _shard_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for row in _rows(batches):
        yield pd.DataFrame({"n": [row["n"]], "tokens": [int(_unpack(row["lengths"]).sum())]})
