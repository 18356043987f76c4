"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check of candidates.

A window of similarity t to an item holds at least t / (1 + t) of the shingles of both in places that have a
shingle of the item.  All windows, aligned or not, that are as long as an item and hold so many places are laid;
no other can be similar.  Each window gets a 64-bit SimHash.  The fingerprints are cut into blocks: two that differ
in at most ``radius`` bits agree in one block up to ``radius // blocks`` bits, so looking up every block value and
its neighbours finds all of them.  The candidates are then compared exactly, as weighted (counted) shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import saved, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of windows at similarity 0.8 differ in about 10 of 64 bits, three standard deviations are 9 more.
RADIUS, BLOCKS = 19, 10
#: More rows than this are joined by a shuffle instead of being sent to every task (under 100 bytes each).
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda word: F.xxhash64(word))


def grams(words: Column, width: int | Column) -> Column:
    """Hashes of all runs of ``width`` words (none if there are fewer)."""
    width = F.lit(width) if isinstance(width, int) else width
    steps = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1))
    hashed = F.transform(steps, lambda at: F.xxhash64(F.slice(words, at, width)))
    return F.coalesce(hashed, F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the shingles, each as often as it occurs, have it set."""

    def bit(b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.call_function("getbit", h, b) == 1))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(0)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda total, b: total.bitwiseOR(bit(b))
    )


def block_values(fingerprint: Column, blocks: int) -> list[Column]:
    """The fingerprint cut into ``blocks`` runs of bits of nearly equal length."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [
        F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
        for low, high in zip(cuts, cuts[1:], strict=False)
    ]


def _neighbours(value: Column, width: int, radius: int) -> Column:
    """All values of ``width`` bits within ``radius`` bits of ``value``."""
    found = F.array(value)
    for _ in range(min(radius, width)):
        flips = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
        found = F.array_distinct(
            F.concat(found, F.flatten(F.transform(found, lambda v: F.transform(flips, lambda flip: v.bitwiseXOR(flip)))))
        )
    return found


def within_radius(left: DataFrame, right: DataFrame, radius: int, blocks: int, spread: bool) -> DataFrame:
    """All pairs of a left and a right row whose ``fingerprint``s differ in at most ``radius`` bits.

    ``right`` has its fingerprint as ``other``.  A pair that meets in several blocks is kept at the first.
    """
    reach = radius // blocks
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    probe = F.array(*[F.struct(F.lit(k).alias("block"), v.alias("value")) for k, v in enumerate(block_values(F.col("fingerprint"), blocks))])

    def listing(k: int, value: Column) -> Column:
        near = _neighbours(value, cuts[k + 1] - cuts[k], reach)
        return F.transform(near, lambda v: F.struct(F.lit(k).alias("block"), v.alias("value")))

    keys = F.flatten(F.array(*[listing(k, v) for k, v in enumerate(block_values(F.col("other"), blocks))]))
    probes = left.withColumn("at", F.explode(probe)).alias("l")
    listed = right.withColumn("to", F.explode(keys)).alias("r")
    differ = F.col("l.fingerprint").bitwiseXOR(F.col("r.other"))
    first = reduce(
        lambda rest, kv: F.when(F.bit_count(kv[1]) <= reach, kv[0]).otherwise(rest),
        reversed(list(enumerate(block_values(differ, blocks)))),
        F.lit(-1),
    )
    meets = (
        (F.col("l.at.block") == F.col("r.to.block"))
        & (F.col("l.at.value") == F.col("r.to.value"))
        & (F.bit_count(differ) <= radius)
        & (first == F.col("l.at.block"))
    )
    return probes.join(F.broadcast(listed) if spread else listed, meets).drop("at", "to")


def weighted_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two lists of shingles, each weighted by how often it occurs."""

    def times(values: Column, one: Column) -> Column:
        return F.size(F.filter(values, lambda v: v == one))

    shared = F.aggregate(
        F.array_intersect(left, right),
        F.lit(0),
        lambda total, one: total + F.least(times(left, one), times(right, one)),
    )
    return shared / (F.size(left) + F.size(right) - shared)


def _starts(places: Column, length: Column, needed: Column, low: Column, high: Column) -> Column:
    """Starts from ``low`` to ``high`` of all windows of ``length`` places that hold ``needed`` of the sorted ``places``.

    The window has some run of ``needed`` places: it starts at the first of them or before, and ends at the last or after.
    """
    none = F.array().cast("array<int>")

    def around(i: Column) -> Column:
        first, last = F.get(places, i), F.get(places, i + needed - 1)
        a, b = F.greatest(last - length + 1, low), F.least(first, high)
        return F.when(a <= b, F.sequence(a, b)).otherwise(none)

    runs = F.size(places) - needed
    return F.when(runs >= 0, F.flatten(F.transform(F.sequence(F.lit(0), runs), around))).otherwise(none)


def window_starts(places: Column, length: Column, shingles: Column, similarity: float) -> Column:
    """Starts of all windows that can be similar: whole ones, and those that the text's ends cut.

    A whole window has as many shingles as the item (``length``).  One that is cut has fewer, but as it is similar,
    ``similarity`` times ``length`` places at least; it starts before the text or ends after it.
    """
    exact = 1e-9  # keeps a product such as 0.8 * 5 from being rounded up
    whole = F.ceil(2 * similarity / (1 + similarity) * length - exact).cast("int")
    cut = F.ceil(similarity * length - exact).cast("int")
    spare = length - cut
    return F.array_distinct(
        F.concat(
            _starts(places, length, whole, F.lit(0), shingles - length),
            _starts(places, length, cut, -spare, F.lit(-1)),
            _starts(places, length, cut, F.greatest(shingles - length + 1, F.lit(0)), shingles - 1),
        )
    )


def benchmark_items(benchmark: DataFrame, item: str = "item_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``item``, word count, shingle width, shingles and fingerprint of every item that has a word."""
    hashed = benchmark.select(F.col(item).alias("item"), word_hashes(F.col(text)).alias("words"))
    shingled = hashed.where(F.size("words") > 0).select(
        "item", F.size("words").alias("n_words"), F.least(F.size("words"), F.lit(shingle)).alias("width"), "words"
    )
    return shingled.select("item", "n_words", "width", grams(F.col("words"), F.col("width")).alias("shingles")).withColumns(
        {"other": simhash(F.col("shingles")), "number": F.monotonically_increasing_id()}
    )


def contaminated_windows(
    frame: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per document and item it holds: ``key``, ``item_id``, best window (``start``, ``n_words``), ``similarity``.

    Words are split at ASCII white space and compared in lower case.  An item of fewer than ``shingle`` words is
    one shingle.  Windows end with the document.  NULL and empty texts or items match nothing; equal rows give one result; documents with the same id
    and different texts are told apart by a hash; a NULL id is an id; other columns are not looked at.
    The items are sent to every task while they have few shingles (``BROADCAST_ROWS``), else everything is shuffled.
    """
    items = saved(benchmark_items(benchmark, item, item_text, shingle))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    gate = items.select("n_words", "width", F.explode("shingles").alias("gram")).distinct()
    few = gate.count() <= BROADCAST_ROWS
    docs = frame.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))

    def listing(width: int) -> Column:
        return F.transform(
            grams(F.col("words"), width),
            lambda gram, at: F.struct(F.lit(width).alias("width"), at.alias("at"), gram.alias("gram")),
        )

    listed = F.concat(*[listing(width) for width in widths or [shingle]])
    hits = (
        docs.select("id", "body", word_hashes(F.col("text")).alias("words"))
        .select("id", "body", F.size("words").alias("size"), F.inline(listed))
        .join(F.broadcast(gate) if few else gate, ["width", "gram"])
        .groupBy("id", "body", "n_words", "width", "size")
        .agg(F.sort_array(F.collect_set("at")).alias("places"))  # no more than the text has words
    )
    length, within = F.col("n_words") - F.col("width") + 1, F.col("size") - F.col("width") + 1
    starts = window_starts(F.col("places"), length, within, similarity)
    spots = F.transform(starts, lambda at: F.struct("n_words", "width", at.alias("start")))
    laid = saved(  # one row per document with all its windows, so that its text is split once
        hits.select("id", "body", spots.alias("spots"))
        .where(F.size("spots") > 0)
        .groupBy(F.col("id").alias("of"), F.col("body").alias("of_body"))
        .agg(F.flatten(F.collect_set("spots")).alias("spots"))
    )
    slim = laid.agg(F.sum(F.size("spots"))).first()[0] or 0
    placed = docs.join(
        F.broadcast(laid) if slim <= BROADCAST_ROWS else laid,
        F.col("id").eqNullSafe(F.col("of")) & (F.col("body") == F.col("of_body")),
    ).select("id", "body", "spots", word_hashes(F.col("text")).alias("words"))

    def window(spot: Column) -> Column:
        first = F.greatest(spot["start"], F.lit(0))
        last = F.least(spot["start"] + spot["n_words"], F.size("words"))
        return F.struct(
            spot["n_words"].alias("n_words"), spot["width"].alias("width"), first.alias("start"),
            F.slice("words", first + 1, last - first).alias("words"),
        )

    cut = placed.select("id", "body", F.inline(F.transform("spots", window)))
    shingled = saved(
        cut.select("id", "body", "start", "n_words", "width", grams(F.col("words"), F.col("width")).alias("shingles"))
        .where(F.size("shingles") > 0)
        .dropDuplicates(["id", "body", "start", "n_words", "shingles"])
        .withColumn("fingerprint", simhash(F.col("shingles")))
    )
    others = items.select("number", F.col("n_words").alias("item_words"), F.col("width").alias("item_width"), "other")
    copies = sum((64 * (k + 1) // blocks - 64 * k // blocks) ** (radius // blocks) + 1 for k in range(blocks))
    pairs = within_radius(shingled, others, radius, blocks, items.count() * copies <= BROADCAST_ROWS).where(
        (F.col("n_words") == F.col("item_words")) & (F.col("width") == F.col("item_width"))
    )
    # The shingles of the items are joined to the pairs left, not sent along with every block value.
    full = items.select("number", "item", F.col("shingles").alias("item_shingles"))
    scored = pairs.join(F.broadcast(full) if few else full, "number").withColumn(
        "similarity", weighted_similarity(F.col("shingles"), F.col("item_shingles"))
    )
    best = F.min_by(F.struct("start", F.col("item_words").alias("n_words"), "similarity"), F.struct(-F.col("similarity"), F.col("start")))
    return (
        scored.where(F.col("similarity") >= similarity)
        .groupBy("id", "body", "item")
        .agg(best.alias("best"))
        .select(F.col("id").alias(key), F.col("item").alias("item_id"), "best.*", F.col("body").alias("text_hash"))
    )


def decontaminate(frame: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``frame`` without those that hold a benchmark item; columns stay as they are."""
    found = contaminated_windows(frame, benchmark, key, text, **options).select(F.col(key).alias("_id"), F.col("text_hash").alias("_body"))
    found = saved(found.distinct())
    small = found.count() <= BROADCAST_ROWS
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_body"))
    return frame.join(F.broadcast(found) if small else found, same, "left_anti")
