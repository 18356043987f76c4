"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

A set that has n tokens and a partner at similarity t shares one of its first ``n - ceil(t n) + 1`` tokens
with it under every global order of the tokens.  So a set with that many tokens of its own has no
partner; this drops nearly all documents after one count.  The rest are ordered by (frequency class,
hash k) for several hashes k: a candidate must share a prefix token under all of these orders.

Postings are never paired with each other.  Each round picks a few hubs per token, tests the other
members against them only, joins what is linked and leaves out tokens whose members are connected; a
hub is done with its token.  The first rounds look at the first tokens of every prefix alone: copies mostly
meet there, and the tokens after them are then connected without a test.  Rounds end when no token has members of two components, so no link
between different components is lost, and a group of near copies costs about one pair per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import saved, saved_in_loop
from ebbtide.session import ship_package

WIDTH, PERCENT, ORDERS = 3, 90, 3
#: Tokens whose hash lies in the lowest part are counted over all documents: so many times the prefix share, as
#: some tokens of a document without partner are not its own.
COUNTED_FACTOR = 2.0
#: Characters that a Python worker handles at a time.
CHUNK = 4_000_000
#: More rows than this are joined by a shuffle instead of being sent to every task (16 bytes each).
BROADCAST_ROWS = 500_000
#: So many tokens of each prefix are open in the first rounds, one number a round; after these, all are.
FIRST_TOKENS = (2,)
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _scramble(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX[1]
    values = (values ^ (values >> np.uint64(27))) * _MIX[2]
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``width`` words of each text (A-Z lowered, ASCII white space)."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else [] for t in texts]
    total = sum(map(len, split))
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for words in split for w in words), np.uint64, total)
    # Runs over the whole batch at once; those that reach into the next text are never cut out.
    mixed = np.zeros(total, np.uint64)
    for k in range(min(width, total)):
        mixed[: total - k] = _scramble((mixed[: total - k] + _MIX[0]) * _MIX[1] + flat[k:])
    out, at = [], 0
    for words in split:
        n = len(words)
        if n >= width:
            out.append(np.unique(mixed[at : at + n - width + 1]))
        elif n:
            short = np.zeros(1, np.uint64)
            for k in range(n):
                short = _scramble((short + _MIX[0]) * _MIX[1] + flat[at + k : at + k + 1])
            out.append(short ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _signature(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = batch["text"].str.len().fillna(0).to_numpy().cumsum()
        for _, part in batch.groupby((sizes // CHUNK).astype(np.int64), sort=False) if len(batch) else ():
            yield part


def _sets(frame: DataFrame, width: int, share: float | None) -> DataFrame:
    """``id``, ``body``, ``class`` (hash of the set), ``n`` and the set's ``tokens`` (all, or those in the counted part)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = np.uint64(int(share * (1 << 64))) if share is not None and share < 1 else None
        for part in _chunked(batches):
            sets = shingle_sets(part["text"].tolist(), width)
            yield pd.DataFrame(
                {
                    "id": part["id"],
                    "body": part["body"],
                    "class": [_signature(s) for s in sets],
                    "n": [len(s) for s in sets],
                    "tokens": [(s if top is None else s[: np.searchsorted(s, top)]).view(np.int64) for s in sets],
                }
            )

    ship_package(frame.sparkSession)
    return frame.mapInPandas(build, "id long, body long, class long, n long, tokens array<long>")


def prefix_size(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _order_hash(token: Column, order: int) -> Column:
    return F.xxhash64(token, F.lit(order))


def prefixes(sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """Sets that may have a partner, with their ``p0``, ``p1``... under each order (tokens of their own left out)."""
    rows = sets.select("class", "n", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    # Rare tokens first; own tokens (df 1) fill the prefix before all others but can meet nobody.
    shared = rows.join(counts, "token").select("class", "n", F.floor(F.log2("df")).alias("rarity"), "token")
    room = prefix_size(F.col("n"), percent) - (F.col("n") - F.size("shared"))

    def first(order: int) -> Column:
        keyed = F.transform(
            "shared", lambda s: F.struct(s["rarity"].alias("a"), _order_hash(s["token"], order).alias("b"), s["token"].alias("token"))
        )
        return F.transform(F.slice(F.sort_array(keyed), F.lit(1), F.col("room")), lambda s: s["token"]).alias(f"p{order}")

    return (
        shared.groupBy("class", "n")
        .agg(F.collect_list(F.struct("rarity", "token")).alias("shared"))
        .withColumn("room", room.cast("int"))
        .where(F.col("room") > 0)
        .select("class", "n", "room", *[first(k) for k in range(orders)])
    )


def _pulled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after one step along the ``links`` (a, b) between their components and one jump.

    Only connected sets get equal labels; not all connected ones do yet.
    """
    names = labels.select("class", "component")
    edges = links.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select("x", "y")
    least = edges.union(edges.select("y", "x")).groupBy("x").agg(F.min("y").alias("near"))
    least = saved_in_loop(least.where(F.col("near") < F.col("x")))
    jumped = least.join(least.toDF("near", "beyond"), "near", "left").select(
        F.col("x").alias("component"), F.coalesce("beyond", "near").alias("to")
    )
    return names.join(jumped, "component", "left").select("class", F.coalesce("to", "component").alias("component"))


def connect(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``class``, ``component``: labels after joining all components that ``links`` (a, b) connect.

    Every round passes the least neighbouring component on and then jumps to the label's own label.
    """
    names = labels.select("class", "component")
    edges = (
        links.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").where(F.col("x") != F.col("y")).select("x", "y")
    )
    edges = saved_in_loop(edges.union(edges.select("y", "x")).distinct())
    state = edges.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.col("v")).alias("to"))
    state = saved_in_loop(state)
    while True:
        least = edges.join(state.toDF("y", "to"), "y").groupBy("x").agg(F.min("to").alias("near")).withColumnRenamed("x", "v")
        lowered = state.join(least, "v").select("v", F.col("to").alias("was"), F.least("to", "near").alias("to"))
        jumped = saved_in_loop(
            lowered.join(lowered.select(F.col("v").alias("to"), F.col("to").alias("beyond")), "to").select(
                "v", F.least("to", "beyond").alias("to"), "was"
            )
        )
        state = jumped.select("v", "to")
        if jumped.where(F.col("to") != F.col("was")).isEmpty():
            break
    return names.join(state.toDF("component", "to"), "component", "left").select(
        "class", F.coalesce("to", "component").alias("component")
    )


def _verified(pairs: DataFrame, prefixed: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """Pairs that pass the prefix filters of all further orders and then the exact comparison."""
    more = [f"p{k}" for k in range(1, orders)]
    slim = prefixed.select("class", *more)
    met = (
        pairs.join(slim.toDF("a", *[f"a{c}" for c in more]), "a")
        .join(slim.toDF("b", *[f"b{c}" for c in more]), "b")
        .where(F.expr(" AND ".join([f"arrays_overlap(a{c}, b{c})" for c in more]) or "true"))
        .select("a", "b")
    )
    whole = sets.select("class", "tokens")
    both = F.size(F.array_intersect("left", "right"))
    return (
        met.join(whole.toDF("a", "left"), "a")
        .join(whole.toDF("b", "right"), "b")
        .where(100 * both >= percent * (F.size("left") + F.size("right") - both))
        .select("a", "b")
    )


def link_components(sets: DataFrame, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """``class``, ``component`` of all sets that have a link; ``sets`` has distinct ``class``, ``n``, ``tokens``."""
    prefixed = saved_in_loop(prefixes(sets, percent, orders))
    start = prefixed.select("class", F.col("class").alias("component"))
    labels, links, done, hubs, rounds = start, None, None, 1, 1
    steps, open_ = [*FIRST_TOKENS, None], None
    # Tokens from this one on: what two sets share is no more, if it is the first that they share.
    own = prefix_size(F.col("n"), percent) - F.col("room")
    left = (F.col("n") - own - F.col("at")).alias("left")
    while True:
        partly = len(steps) > 1
        if steps:
            # Labels meet whole prefixes, one row per set, and not every token of them.
            whole = prefixed.select("class", "n", "room", "p0")
            whole = whole.withColumn("component", F.col("class")) if links is None else whole.join(labels, "class")
            step = steps.pop(0)
            part = F.col("p0") if step is None else F.slice("p0", 1, step)
            opened = whole.select("class", "n", "room", "component", F.posexplode(part).alias("at", "token"))
            named = opened.select("class", "n", "room", left, "token", "component")
        else:
            named = open_.join(labels, "class")
        # Only tokens whose members are not yet known to be connected.
        mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        open_ = saved_in_loop(named.join(mixed.select("token"), "token", "left_semi"))
        if open_.isEmpty():
            if partly:
                continue
            return start if links is None else connect(start, links)
        # First the member with the fewest tokens of its own, as the text the others were copied from has; later
        # those of the smallest components, so that a few strays are tested against all and not the reverse.
        first = -F.col("room").cast("double") / F.col("n")
        if rounds == 1:
            ranked = open_.withColumn("rank", F.struct(F.lit(1).cast("long").alias("size"), first.alias("own")))
        else:
            sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
            ranked = open_.join(sizes, "component").withColumn("rank", F.struct("size", first.alias("own"))).drop("size")
        chosen = (
            ranked.groupBy("token", F.pmod(F.xxhash64("class", F.lit(hubs)), F.lit(hubs)).alias("part"))
            .agg(F.min_by(F.struct("n", "left", "class", "component"), F.struct("rank", "class")).alias("hub"))
            .select("token", "hub.*")
        )
        enough = (100 + percent) * F.least("m.left", "h.left") >= percent * (F.col("m.n") + F.col("h.n"))
        near = (100 * F.least("m.n", "h.n") >= percent * F.greatest("m.n", "h.n")) & enough
        met = open_.alias("m").join(
            chosen.alias("h"), (F.col("m.token") == F.col("h.token")) & (F.col("m.component") != F.col("h.component")) & near
        )
        pairs = met.select(
            F.least("m.class", "h.class").alias("a"), F.greatest("m.class", "h.class").alias("b")
        ).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = saved_in_loop(pairs)
        done = pairs if done is None else done.union(pairs)
        found = saved_in_loop(_verified(pairs, prefixed, sets, percent, orders))
        links = found if links is None else links.union(found)
        labels = saved_in_loop(_pulled(labels, found))
        if not partly:
            # A hub is done with a token now that all its members were open.
            open_ = open_.join(chosen, ["token", "class"], "left_anti").select("class", "n", "room", "left", "token")
            hubs, rounds = (1 if rounds < 2 else hubs * 8), rounds + 1


def document_components(
    frame: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    orders: int = ORDERS,
) -> DataFrame:
    """One row per row of ``frame``: ``key``, ``n_shingles``, ``component_id`` (smallest key it is linked with or its own),
    ``group`` (a number all linked rows share) and ``body`` (hash of the text).

    Two texts are linked when ``100 * shared >= percent * all`` of their distinct ``width``-word shingles; a
    text with fewer words is one shingle; NULL texts and texts without words have none, are linked with
    nothing and have no ``group``.  A NULL key is never the smallest; if all keys of a group are NULL, so is
    ``component_id``.  Repeated rows are copies.  An empty frame gives an empty result; other columns are not
    looked at.  Sets are compared by 64-bit hashes of shingles and of whole sets.
    """
    share = min(1.0, COUNTED_FACTOR * (100 - percent) / 100)
    slim = frame.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    counted = saved(_sets(slim, width, 0.0).drop("tokens"))
    classes = counted.where(F.col("n") > 0).groupBy("class", "n").agg(F.min("id").alias("first"))
    owned = (
        # The tokens go straight to the count: reading the texts again costs less than keeping them.
        _sets(slim, width, share)
        .select("class", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.min("class").alias("class"), F.max("class").alias("last"))
        .where(F.col("class") == F.col("last"))
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("own"))
    )
    able = classes.join(owned, "class", "left").where(F.coalesce("own", F.lit(0)) < prefix_size(F.col("n"), percent))
    # One text of every class that is left is read again for its whole set.
    able = saved(able.select("class", "n"))
    few = able.count() <= BROADCAST_ROWS
    first = counted.join(F.broadcast(able) if few else able, ["class", "n"]).groupBy("class", "n").agg(
        F.min_by(F.struct("id", "body"), F.struct("id", "body")).alias("of")
    )
    first = saved(first.select("of.*").distinct()).toDF("_id", "_body")
    wanted = F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))
    texts = slim.join(F.broadcast(first) if few else first, wanted, "left_semi")
    sets = saved(_sets(texts, width, None).drop("id", "body").dropDuplicates(["class"]))
    labels = link_components(sets, percent, orders)
    grouped = classes.join(labels, "class", "left").select("class", F.coalesce("component", "class").alias("group"), "first")
    smallest = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    known = saved(grouped.select("class", "group").join(smallest, "group"))
    return (
        counted.select("id", "body", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
        .join(known, "class", "left")
        .select(
            F.col("id").alias(key),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
            "group",
            "body",
        )
    )


def one_of_each_group(frame: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``frame`` with one document of each group of linked ones: that with the smallest key (NULL last).

    Columns stay as they are; of repeated rows one stays; rows without a shingle all stay.
    """
    found = saved(document_components(frame, key, text, **options).select(F.col(key).alias("id"), "body", "group"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "body")
    kept = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(order).alias("of")).select("of.id", "of.body")
    kept = saved(kept)
    alone = found.where(F.col("group").isNull()).select("id", "body").distinct()
    times = found.join(kept, found["id"].eqNullSafe(kept["id"]) & (found["body"] == kept["body"]), "left_semi").count()
    keys = kept.union(alone).toDF("_id", "_body")
    rows = frame.join(keys, F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_body")), "left_semi")
    if times == kept.count():
        return rows
    grouped = rows.join(
        found.where(F.col("group").isNotNull()).select(F.col("id").alias("_id"), F.col("body").alias("_body")).distinct(),
        F.col(key).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_body")),
        "left",
    )
    single = grouped.where(F.col("_body").isNotNull()).dropDuplicates(["_id", "_body"])
    return single.union(grouped.where(F.col("_body").isNull())).select(*frame.columns)
