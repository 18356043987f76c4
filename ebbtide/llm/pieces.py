"""Encoding to sentence pieces and back, by vectorised merge rounds over the words of a batch.

The words of a batch lie in flat numpy arrays of symbols.  Each round finds, for all words at once, the
best pair by a segmented minimum of pair ranks, merges the leftmost such pair of every word and packs the
arrays; words without a pair leave.  A word is encoded once per batch and remembered up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import unclash
from ebbtide.session import ship_package

SPACE_MARK = "▁"
#: Words that a Python worker remembers, and characters it encodes at a time.
REMEMBERED, CHUNK = 300_000, 2_000_000
#: Longer words are merged with a heap: their rounds would cost the square of their length.
LONG = 1_500
_NONE = np.iinfo(np.int32).max
FIELDS = {
    "n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"
}


class PieceCodec:
    """Tables of a BPE model with byte fallback, a word-start mark and text taken as it is."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        if model.normalize("Ａ  b") != f"{SPACE_MARK}Ａ{SPACE_MARK * 2}b":
            raise ValueError("only models that leave the text as it is are supported")
        self.begin, self.end = model.bos_id(), model.eos_id()
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)])
        self.names = {p: i for i, p in enumerate(pieces) if not special[i]}
        bytes_of = {int(pieces[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_ids = np.array([bytes_of[b] for b in range(256)], np.int32)
        # Pieces never hold a mark after another character, so no merge crosses the start of a word.
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.names):
            raise ValueError("pieces that span words are not supported")
        scores = {i: model.get_score(i) for i in self.names.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Characters that are no piece on their own get numbers above the pieces.
        self.extra: dict[str, int] = {}
        self.extra_of: list[str] = []
        self.first_extra = size
        pairs = {}
        for piece, i in self.names.items():
            for cut in range(1, len(piece)):
                left, right = self._symbol(piece[:cut]), self._symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[scores[i]], i)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        at = np.argsort(keys)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)[at]
        self.keys, self.ranks, self.merged = keys[at], values[:, 0].copy(), values[:, 1].copy()
        shown = [p.replace(SPACE_MARK, " ").encode() for p in pieces]
        for i in range(size):
            if model.is_control(i):
                shown[i] = b""
            elif model.is_unknown(i):
                shown[i] = " ⁇ ".encode()
            elif model.is_byte(i):
                shown[i] = bytes([int(pieces[i][3:-1], 16)])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.concatenate([[0], np.cumsum(self.shown_size)[:-1]])
        self.opens = np.array([p.startswith(SPACE_MARK) for p in pieces])
        self.silent = np.array([model.is_control(i) for i in range(size)])
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        self._forget()

    def _symbol(self, text: str) -> int | None:
        found = self.names.get(text)
        if found is None and len(text) == 1:
            found = self.extra.get(text)
            if found is None:
                found = self.extra[text] = self.first_extra + len(self.extra_of)
                self.extra_of.append(text)
        return found

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return np.where(hit, self.ranks[at], _NONE).astype(np.int32), self.merged[at]

    def _rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and lengths of all words once no pair is left, in the order of the words."""
        done_words, done_sizes, done_symbols = [], [], []
        names = np.arange(len(lengths))
        rank, result = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], result[:-1] = self._rank(symbols[:-1], symbols[1:])
        rank[np.cumsum(lengths) - 1] = _NONE
        while len(names):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, starts)
            ended = best == _NONE
            if ended.any():
                out = np.repeat(ended, lengths)
                done_words.append(names[ended])
                done_sizes.append(lengths[ended])
                done_symbols.append(symbols[out])
                symbols, rank, result = symbols[~out], rank[~out], result[~out]
                names, lengths, best = names[~ended], lengths[~ended], best[~ended]
                if not len(names):
                    break
                starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(names)), lengths)
            hits = np.flatnonzero(rank == best[owner])
            first = np.ones(len(hits), bool)
            first[1:] = owner[hits[1:]] != owner[hits[:-1]]
            at = hits[first]  # leftmost best pair of every word
            symbols[at] = result[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, rank, result = symbols[keep], rank[keep], result[keep]
            at = at - np.arange(len(at))
            lengths = lengths - 1
            ends = np.cumsum(lengths) - 1
            last = at == ends
            rank[at[last]] = _NONE
            inner = at[~last]
            rank[inner], result[inner] = self._rank(symbols[inner], symbols[inner + 1])
            before = at[at > ends - lengths + 1] - 1
            rank[before], result[before] = self._rank(symbols[before], symbols[before + 1])
        order = np.argsort(np.concatenate(done_words))
        sizes = np.concatenate(done_sizes)
        flat = np.concatenate(done_symbols)
        return _gather(flat, np.cumsum(sizes) - sizes, sizes, order), sizes[order]

    def _heap(self, symbols: list[int]) -> list[int]:
        """The same merges for one long word, in time proportional to its length times a logarithm."""
        table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(symbols) and (found := table.get(symbols[left] << 32 | symbols[right])):
                heapq.heappush(heap, (found[0], left, symbols[left], symbols[right], found[1]))

        for k in range(len(symbols) - 1):
            offer(k)
        while heap:
            _, left, a, b, made = heapq.heappop(heap)
            right = after[left]
            if symbols[left] != a or right >= len(symbols) or symbols[right] != b:
                continue
            symbols[left], symbols[right] = made, -1
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [s for s in symbols if s >= 0]

    def _learn(self, words: list[str]) -> None:
        """Encode new words and remember them."""
        index = self.names
        spelled = [[index[c] if c in index else self._symbol(c) for c in word] for word in words]
        long = {k: self._heap(s) for k, s in enumerate(spelled) if len(s) > LONG}
        for k, found in long.items():
            spelled[k] = found
        short = [k for k in range(len(words)) if k not in long]
        if short:
            lengths = np.array([len(spelled[k]) for k in short])
            flat, sizes = self._rounds(np.array([s for k in short for s in spelled[k]], np.int32), lengths)
        else:
            flat, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for found in long.values():
            flat, sizes = np.concatenate([flat, np.array(found, np.int32)]), np.append(sizes, len(found))
        order = np.argsort(np.array([*short, *long], np.int64))
        flat = _gather(flat, np.cumsum(sizes) - sizes, sizes, order)
        flat, sizes = self._bytes(flat, sizes[order])
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def _bytes(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their bytes."""
        odd = np.flatnonzero(flat >= self.first_extra)
        if not len(odd):
            return flat, sizes
        spelled = [self.byte_ids[list(self.extra_of[s - self.first_extra].encode("utf-8", "replace"))] for s in flat[odd]]
        widths = np.ones(len(flat), np.int64)
        widths[odd] = [len(s) for s in spelled]
        out = np.repeat(flat, widths)
        starts = np.cumsum(widths) - widths
        for at, found in zip(starts[odd], spelled, strict=True):
            out[at : at + len(found)] = found
        return out, np.add.reduceat(widths, np.cumsum(sizes) - sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts with begin and end, and the number of ids of each."""
        if len(self.codes) > REMEMBERED:
            self._forget()
        codes, known, fresh = self.codes, len(self.codes), []
        marked = [SPACE_MARK + t.replace(" ", SPACE_MARK) if t else "" for t in texts]
        split = [_WORDS(t) for t in marked]
        for words in split:
            for word in words:
                if word not in codes:
                    codes[word] = known + len(fresh)
                    fresh.append(word)
        if fresh:
            self._learn(fresh)
        counts = np.array([len(w) for w in split], np.int64)
        tokens = np.fromiter((codes[w] for words in split for w in words), np.int64, int(counts.sum()))
        lengths = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts, out=lengths[1:])
        sizes = np.concatenate([[0], np.cumsum(self.size[tokens])])
        per_text = sizes[lengths[1:]] - sizes[lengths[:-1]]
        body = _gather(self.flat, self.at, self.size, tokens)
        out = np.empty(len(body) + 2 * len(texts), np.int32)
        ends = np.cumsum(per_text + 2)
        begins = ends - per_text - 2
        inside = np.ones(len(out), bool)
        inside[begins] = inside[ends - 1] = False
        out[begins], out[ends - 1] = self.begin, self.end
        out[inside] = body
        return out, per_text + 2

    def decode(self, ids: np.ndarray) -> str:
        """Text of one sequence: control pieces say nothing, one mark at the start is dropped."""
        heard = ids[~self.silent[ids]]
        raw = _gather(self.shown, self.shown_at, self.shown_size, heard).tobytes()
        if len(heard) and self.opens[heard[0]]:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:  # bytes that are no character give one replacement each
            return "".join(_careful(self, heard))


_WORDS = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+").findall


def _careful(codec: PieceCodec, ids: np.ndarray) -> Iterator[str]:
    run = bytearray()

    def flush() -> str:
        out, k = [], 0
        while k < len(run):
            for width in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[k : k + width]).decode("utf-8"))
                    k += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        run.clear()
        return "".join(out)

    for k, i in enumerate(ids):
        shown = codec.shown[codec.shown_at[i] : codec.shown_at[i] + codec.shown_size[i]].tobytes()
        if codec.is_byte[i]:
            run += shown
        else:
            yield flush() + shown.decode("utf-8")[int(k == 0 and codec.opens[i]) :]
    yield flush()


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``which`` of a flat array, one after another."""
    sizes = size[which]
    total = int(sizes.sum())
    steps = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[np.repeat(at[which], sizes) + steps]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _chunks(texts: pd.Series) -> Iterable[list[str]]:
    held, chars = [], 0
    for text in texts:
        held.append(text if isinstance(text, str) else "")
        chars += len(held[-1])
        if chars > CHUNK:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _encoder(path: str, fields: tuple[str, ...]):
    kind = ", ".join(f"{name} {FIELDS[name]}" for name in fields)

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = codec(path)
        for texts in batches:
            out: dict[str, list] = {name: [] for name in fields}
            for chunk in _chunks(texts):
                flat, sizes = tables.encode(chunk)
                ends = np.cumsum(sizes)
                for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
                    ids = flat[end - size : end]
                    if "n_tokens" in out:
                        out["n_tokens"].append(size)
                    if "ids" in out:
                        out["ids"].append(ids)
                    if "ids_sha256" in out:
                        out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    if "decoded" in out or "decoded_sha256" in out:
                        text = tables.decode(ids)
                        if "decoded" in out:
                            out["decoded"].append(text)
                        if "decoded_sha256" in out:
                            out["decoded_sha256"].append(hashlib.sha256(text.encode("utf-8")).hexdigest())
            yield pd.DataFrame(out, columns=list(fields))

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(encode, kind)


def encode_decode(
    frame: DataFrame, model: str, text: str | Column = "text", fields: tuple[str, ...] = ("n_tokens", "ids", "decoded")
) -> DataFrame:
    """Every row with the chosen ``FIELDS`` of its whole text, in the order given.

    A NULL or empty text has begin and end alone and decodes to nothing.  Rows are independent: repeated
    rows get equal results, an empty frame stays empty, and input columns with a chosen name are replaced.
    ``model`` is a path that every executor can open.  Memory per task: a bounded number of remembered
    words and of characters at a time, besides the longest text.
    """
    ship_package(frame.sparkSession)
    frame = frame.withColumn("_text", F.col(text) if isinstance(text, str) else text)
    kept = unclash(frame, fields)
    return kept.withColumn("_found", _encoder(model, fields)(F.col("_text"))).select(
        *[c for c in kept.columns if c != "_text"], "_found.*"
    )
