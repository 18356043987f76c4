"""Language identification by prediction by partial matching with frozen statistics.

Every language has a tree of byte contexts of up to three symbols.  A symbol is coded in the longest
context; one that was not seen there pays an escape and is coded in the next shorter context, without the
symbols the longer one has seen.  What a text costs in bits under each tree follows from its runs of four
symbols alone, so the costs of all runs are worked out once and summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import saved, unclash
from ebbtide.llm.symbols import alphabet, byte_counts, chunks, tally
from ebbtide.session import ship_package

#: Symbols told apart: all bytes.
ALPHABET = 256
UNKNOWN = "und"
#: A letter by its Unicode category (number forms and signs such as ² or ½ are none).
_LETTER = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class ContextTrees:
    """Costs in bits of a symbol for every language (columns)."""

    languages: list[str]
    symbols: np.ndarray  # symbol of each byte
    runs: np.ndarray  # runs of four seen in some language, ascending
    costs: np.ndarray  # their costs
    contexts: np.ndarray  # contexts of three seen in some language, ascending
    leave: np.ndarray  # by these: escape from it and size of what is left in the context of two
    fall: np.ndarray  # by these: escape from the context of two
    shorter: np.ndarray  # runs of three seen in some language, ascending
    inner: np.ndarray  # by these: cost in the context of two without its size, or that of lower orders
    seen: np.ndarray  # by these: whether the context of two has seen the symbol
    leave2: np.ndarray  # by context of two: as leave and fall for a context of three that was not seen
    fall2: np.ndarray
    leave1: np.ndarray  # by context of two: size of what is left in the context of one
    lower: np.ndarray  # by context of two, then by run of two (see _order1)
    fall1: np.ndarray
    have1: np.ndarray

    def of_runs(self, runs: np.ndarray) -> np.ndarray:
        """Costs of runs by way of escapes from the context of three."""
        size = int(self.symbols.max()) + 1
        before, last = runs // size, runs % size**3
        at, known = _find(self.contexts, before)
        leave = np.where(known, self.leave[at], self.leave2[before % size**2]) if len(self.leave) else self.leave2[before % size**2]
        fall = np.where(known, self.fall[at], self.fall2[before % size**2]) if len(self.fall) else self.fall2[before % size**2]
        at, known = _find(self.shorter, last)
        inner = _order1(last, size, self.leave1, self.fall1, self.have1, self.lower)
        if len(self.inner):
            inner = np.where(known, self.inner[at], inner)
            fall = np.where(known & self.seen[at], 0, fall)
        return leave + fall + inner


def _find(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted key, and as a column whether it is there."""
    if not len(ordered):
        return np.zeros(len(wanted), np.int64), np.zeros((len(wanted), 1), bool)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return at, (ordered[at] == wanted)[:, None]


def _log2(values: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(values, 1)).astype(np.float64)


def _order1(last: np.ndarray, size: int, leave1: np.ndarray, fall1: np.ndarray, have1: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Costs of runs of three in the context of one, reached from that of two, or in order 0."""
    context, pair = last // size, last % size**2
    return leave1[context] + np.where(have1[pair], 0, fall1[context]) + lower[pair]


def _spread(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values at the wanted keys (all keys are among them), 0 elsewhere."""
    out = np.zeros(len(wanted))
    out[np.searchsorted(wanted, keys)] = values
    return out


def grow_trees(counts: dict[str, tuple[np.ndarray, np.ndarray]], symbols: np.ndarray) -> ContextTrees:
    """Trees from counts of runs of four symbols (key, times) per language."""
    size = int(symbols.max()) + 1
    languages = sorted(counts)
    union = np.unique(np.concatenate([keys for keys, _ in counts.values()])) if counts else np.zeros(0, np.int64)
    contexts, shorter = np.unique(union // size), np.unique(union % size**3)

    def table(rows: int, kind: type = np.float32) -> np.ndarray:
        return np.zeros((rows, len(languages)), kind)

    leave, fall, inner, seen = table(len(contexts)), table(len(contexts)), table(len(shorter)), table(len(shorter), bool)
    leave2, fall2, leave1, fall1, lower, have1 = *(table(size**2) for _ in range(5)), table(size**2, bool)
    found = np.full((len(union), len(languages)), np.nan, np.float32)
    for column, language in enumerate(languages):
        keys, times = counts[language]
        run3, at3 = np.unique(keys % size**3, return_inverse=True)
        seen3 = np.bincount(at3, times)
        n3 = _spread(run3, seen3, shorter)  # symbol after a context of two
        n2 = np.bincount(run3 % size**2, seen3, size**2)  # after a context of one
        pairs = n2.reshape(size, size)
        n1 = pairs.sum(0)
        context3, of3 = np.unique(keys // size, return_inverse=True)
        total3, kinds3 = (_spread(context3, np.bincount(of3, w), contexts) for w in (times, np.ones(len(times))))
        total2, kinds2 = (np.bincount(run3 // size, w, size**2) for w in (seen3, np.ones(len(run3))))
        total1, kinds1 = pairs.sum(1), (pairs > 0).sum(1)
        total0, kinds0 = n1.sum(), (n1 > 0).sum()
        # Weight in the shorter context of the symbols that the longer one has seen.
        heavy3 = _spread(context3, np.bincount(of3, seen3[at3]), contexts)
        heavy2 = np.bincount(run3 // size, n2[run3 % size**2], size**2)
        heavy1 = ((pairs > 0) * n1).sum(1)
        # Order 0, reached from a context of one; unseen symbols are equally likely.
        left0, new0 = total0 - heavy1, kinds0 - kinds1
        cost0 = np.where(n1 > 0, -_log2(n1), _log2(np.full(size, size - kinds0)))[None, :] - np.where(
            n1[None, :] > 0, 0, _log2(new0)[:, None]
        )
        cost0 = cost0 + _log2(left0 + new0)[:, None]
        # Order 1, reached from a context of two.
        context1 = np.arange(size**2) % size
        left1, new1 = total1[context1] - heavy2, kinds1[context1] - kinds2
        leave1[:, column], fall1[:, column], have1[:, column] = _log2(left1 + new1), -_log2(new1), n2 > 0
        lower[:, column] = np.where(n2 > 0, -_log2(n2), cost0.ravel())
        # Order 2, reached from a context of three: its size depends on what that has seen.
        context2 = contexts % size**2
        left2, new2 = total2[context2] - heavy3, kinds2[context2] - kinds3
        leave[:, column] = np.where(total3 > 0, _log2(total3 + kinds3) - _log2(kinds3), 0) + _log2(left2 + new2)
        fall[:, column] = -_log2(new2)
        leave2[:, column], fall2[:, column] = _log2(total2 + kinds2), -_log2(kinds2)
        seen[:, column] = n3 > 0
        one = slice(column, column + 1)
        order1 = _order1(shorter, size, leave1[:, one], fall1[:, one], have1[:, one], lower[:, one])[:, 0]
        inner[:, column] = np.where(n3 > 0, -_log2(n3), order1)
        own = _log2(total3 + kinds3)[np.searchsorted(contexts, keys // size)]
        found[np.searchsorted(union, keys), column] = own - _log2(times)
    rest = (contexts, leave, fall, shorter, inner, seen, leave2, fall2, leave1, lower, fall1, have1)
    missing = ContextTrees(languages, symbols, union, found, *rest).of_runs(union) if len(union) else found
    return ContextTrees(languages, symbols, union, np.where(np.isnan(found), missing, found).astype(np.float32), *rest)


def _runs(texts: list[bytes], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of four symbols that end at each byte, and how many each text has; texts begin after three line feeds."""
    size = int(symbols.max()) + 1
    flat = symbols[np.frombuffer(b"".join(b"\n\n\n" + t for t in texts), np.uint8)]
    lengths = np.array([len(t) for t in texts])
    runs = flat.copy()
    for k in range(1, 4):
        runs[k:] += flat[:-k] * size**k
    inside = np.ones(len(flat), bool)
    starts = np.cumsum(lengths + 3) - lengths - 3
    for k in range(3):
        inside[starts + k] = False
    return runs[inside], lengths


def learn_languages(frame: DataFrame, text: str = "text", lang: str = "lang", size: int = ALPHABET, most: int | None = None) -> ContextTrees:
    """Trees of all languages in ``lang``, learnt from all whole texts; rows without text or language teach nothing.

    The driver gets the sums of all runs.  A caller may bound them by ``most``: then each language has an equal part
    of it, and its rarest runs beyond that are left out.
    """
    ship_package(frame.sparkSession)
    rows = frame.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND text != ''")
    symbols = alphabet(byte_counts(rows), size) if size < ALPHABET else np.arange(ALPHABET)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for part, texts in chunks(batches):
            runs, lengths = _runs(texts, symbols)
            owner = np.repeat(np.arange(len(texts)), lengths)
            codes, names = pd.factorize(part["lang"])
            for code, name in enumerate(names):
                mine = np.unique(runs[codes[owner] == code], return_counts=True)
                parts = held.setdefault(name, [])
                parts.append(mine)
                if len(parts) > 8:
                    held[name] = [tally(parts)]
        for name, parts in held.items():
            keys, times = tally(parts)
            yield pd.DataFrame({"lang": name, "run": keys, "n": times})

    summed = saved(rows.mapInPandas(count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")))
    kept = summed if most is None else _bounded(summed, most)
    found = kept.toPandas().sort_values(["lang", "run"])
    counts = {name: (g["run"].to_numpy(), g["n"].to_numpy()) for name, g in found.groupby("lang")}
    return grow_trees(counts, symbols)


def _bounded(summed: DataFrame, most: int) -> DataFrame:
    """The runs of each language that are seen so often that an equal part of ``most`` holds them."""
    sizes = summed.groupBy("lang", F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    part, rule = most // max(1, sizes["lang"].nunique()), F.lit(False)
    for name, own in sizes.groupby("lang"):
        least = next(k for k in range(64) if own.loc[own["power"] >= k, "n"].sum() <= part)
        rule = rule | ((F.col("lang") == name) & (F.col("n") >= 2**least))
    return summed.where(rule)


def predict_languages(frame: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (probability of that language among all, from the code lengths) and ``bits``.

    A text that is NULL or has no letter is ``und`` with score 0, as is every text if nothing was learnt.
    Equal costs go to the language first in the alphabet.  Rows are independent; an empty frame stays empty;
    input columns with an added name are replaced.
    """
    ship_package(frame.sparkSession)
    shared = frame.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model: ContextTrees = shared.value
        for batch in batches:
            out = []
            for part, texts in chunks(iter([batch.to_frame("text")])):
                runs, lengths = _runs(texts, model.symbols)
                at, there = _find(model.runs, runs)
                costs = model.costs[at] if len(model.costs) else np.zeros((len(runs), len(model.languages)), np.float32)
                lost = np.flatnonzero(~there[:, 0])
                if len(lost) and len(model.languages):
                    costs[lost] = model.of_runs(runs[lost])
                sums = np.zeros((len(runs) + 1, len(model.languages)))
                np.cumsum(costs, axis=0, out=sums[1:], dtype=np.float64)
                ends = np.cumsum(lengths)
                bits = sums[ends] - sums[ends - lengths]
                known = np.array([isinstance(t, str) and _LETTER(t) is not None for t in part["text"]])
                if not model.languages:
                    known[:] = False
                    bits = np.zeros((len(texts), 1))
                best = bits.argmin(1)
                least = bits[np.arange(len(best)), best]
                odds = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(1)
                names = np.array([*model.languages, UNKNOWN], object)
                out.append(
                    pd.DataFrame(
                        {
                            "lang_pred": names[np.where(known, best, len(model.languages))],
                            "score": np.where(known, odds, 0.0),
                            "bits": np.where(known, least, 0.0),
                        }
                    )
                )
            yield pd.concat(out) if out else pd.DataFrame({"lang_pred": [], "score": [], "bits": []})

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    guess = F.pandas_udf(score, "lang_pred string, score double, bits double")
    kept = unclash(frame, ["lang_pred", "score", "bits"])
    return kept.withColumn("_found", guess(frame[text])).select(*kept.columns, "_found.*")
