"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, and a proof for every row.

The levels are built by sibling-shift self-joins: a node meets its siblings by an equijoin on their computed
index (index XOR 1 for runs of two, slot offsets for longer runs), and the node in slot zero emits the parent.
Proofs are put together per block of neighbouring leaves: the nodes of eight levels meet in one shuffle, and each
block takes the path above it from the next eight levels, so a path travels once per block and not once per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import saved, saved_in_loop
from ebbtide.llm.ordering import in_order

#: Children of a node, and levels whose nodes meet in one block of a proof.
RUN, SPAN = 2, 8
RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _or_empty(digest: Column) -> Column:
    return F.coalesce(digest, F.unhex(F.lit("")))


def field(value: Column) -> Column:
    """A value as it enters a leaf: its bytes in UTF-8, a colon and itself, or a dash for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def node_digest(*parts: Column) -> Column:
    """Digest of the joined digests, each as lowercase hexadecimal text."""
    return F.unhex(F.sha2(text_of(F.concat(*map(_or_empty, parts))), 256))


def with_siblings(nodes: DataFrame, run: int) -> DataFrame:
    """Nodes (``group``, ``idx``, ``n``, ``node``) with the digests ``left`` and ``right`` of them in their run, joined."""
    if run == 2:
        others = nodes.select("group", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx"), F.col("node").alias("other"))
        met = nodes.join(others, ["group", "idx"], "left")
        odd = F.col("idx") % 2 == 1
        return met.withColumns({"left": F.when(odd, F.col("other")), "right": F.when(~odd, F.col("other"))}).drop("other")
    slot = F.col("idx") % run
    shifted = nodes.select(
        "group", F.struct(F.col("idx").alias("at"), "node").alias("other"),
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(run - 1)), lambda o: F.col("idx") - slot + (slot + o) % run)).alias("idx"),
    )
    met = shifted.groupBy("group", "idx").agg(F.sort_array(F.collect_list("other")).alias("others"))

    def joined(keep) -> Column:
        chosen = F.transform(F.filter("others", keep), lambda o: F.hex(o["node"]))
        return F.unhex(F.array_join(chosen, ""))

    return nodes.join(met, ["group", "idx"], "left").withColumns(
        {"left": joined(lambda o: o["at"] < F.col("idx")), "right": joined(lambda o: o["at"] > F.col("idx"))}
    ).drop("others")


def build_levels(leaves: DataFrame, run: int = RUN) -> list[DataFrame]:
    """Tables of the levels, each written once: ``group``, ``idx``, ``n`` (nodes of the group there), ``node``, ``left``, ``right``.

    ``leaves`` has the first four and ``row``, which stays at level zero.  A group's root has ``n`` 1.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while True:
        levels.append(saved_in_loop(with_siblings(nodes, run)))
        if largest <= 1:
            return levels
        largest = -(-largest // run)
        nodes = levels[-1].where((F.col("idx") % run == 0) & (F.col("n") > 1)).select(
            "group",
            F.floor(F.col("idx") / run).alias("idx"),
            F.floor((F.col("n") + run - 1) / run).alias("n"),
            node_digest(F.col("left"), F.col("node"), F.col("right")).alias("node"),
        )


def group_roots(levels: list[DataFrame]) -> DataFrame:
    """``group``, its root ``node`` and the ``level`` where it lies."""
    found = [t.where("n = 1").select("group", "node", F.lit(k).alias("level")) for k, t in enumerate(levels)]
    return reduce(DataFrame.unionAll, found)


def proofs(levels: list[DataFrame], tops: DataFrame, run: int = RUN, start: int = 0) -> DataFrame:
    """Nodes of level ``start`` with ``path``: for each level up to the last root, what lies left and right of the way.

    ``tops`` has one row per group: the ``level`` of its root, the path above it (``above``) and ``subroot``.
    """
    span = levels[start : start + SPAN]
    width = [run ** (SPAN - k) for k in range(len(span))]
    own = F.col("row") if start == 0 else F.lit(None).cast("string")
    parts = [
        table.select(
            "group", F.floor(F.col("idx") / width[k]).alias("block"), F.lit(k).alias("k"),
            F.struct("idx", "n", "left", "right").alias("at"),
            *([F.struct("idx", own.alias("row")).alias("own")] if k == 0 else []),
        )
        for k, table in enumerate(span)
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    collected = [F.sort_array(F.collect_list(F.when(F.col("k") == k, F.col("at")))).alias(f"at{k}") for k in range(len(span))]
    blocks = rows.groupBy("group", "block").agg(*collected, F.collect_list("own").alias("own"))
    ends = (F.col("level") >= start) & (F.col("level") < start + SPAN)
    above = tops.where(ends).select("group", F.lit(0).cast("long").alias("block"), "above", "subroot")
    if start + SPAN < len(levels):
        higher = proofs(levels, tops, run, start + SPAN)
        above = above.unionByName(higher.select("group", F.col("idx").alias("block"), F.col("path").alias("above"), "subroot"))

    def step(k: int) -> Column:
        place = F.floor(F.col("own.idx") / run**k) - F.col("block") * width[k]
        node = F.get(f"at{k}", place.cast("int"))
        return F.when(node["n"] > 1, F.struct(node["left"].alias("left"), node["right"].alias("right")))

    path = F.concat(F.filter(F.array(*map(step, range(len(span)))), lambda s: s.isNotNull()), F.col("above"))
    each = blocks.join(above, ["group", "block"]).withColumn("own", F.explode("own"))
    return each.select("group", F.col("own.idx").alias("idx"), F.col("own.row").alias("row"), path.alias("path"), "subroot")


def dataset_manifest(
    frame: DataFrame,
    fields: Sequence[str],
    order: str = "doc_id",
    by: str = "lang",
    run: int = RUN,
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``frame``: ``order``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    A leaf is the digest of ``fields``, each with its length, so that no two rows share one by shifting text from
    one field to the next.  Leaves of a group ascend by ``order`` (NULL first; ties, as in repeated rows, by
    digest); groups ascend bytewise, NULL first.  Every ``run`` consecutive nodes become their digest, a last
    shorter run as well; a lone node is the root.  ``altered`` replaces columns before the check: ``folded_root`` is
    what the altered row and the true siblings give.  NULL and empty text differ, long texts are hashed whole, an
    empty frame gives an empty result, and columns outside ``fields`` are not looked at.

    A group of any size is spread over many tasks: places come from a range split, levels from joins on
    (group, index), proofs from blocks of at most ``run ** 8`` neighbouring leaves.  Each level is a table in the
    shared folder and read from there again.
    """
    spark = frame.sparkSession
    values = [F.col(c) for c in fields]
    changed = [(altered or {}).get(c, F.col(c)) for c in fields]
    hashed = saved(
        frame.select(
            F.col(order).alias("key"),
            F.coalesce(F.concat(F.lit("="), F.col(by)), F.lit("-")).alias("group"),
            leaf_digest(values).alias("node"),
            leaf_digest(changed).alias("changed"),
        )
    )
    placed = in_order(hashed, ["group"], [F.col("key").asc(), F.col("node").asc()])
    same = F.when(F.col("changed") != F.col("node"), F.col("changed"))
    leaves = placed.select(
        "group", F.col("nth").alias("idx"), F.col("group_rows").alias("n"), "node",
        F.struct("key", F.col("node").alias("leaf"), same.alias("changed")).alias("row"),
    )
    levels = build_levels(leaves, run)
    roots = saved(group_roots(levels))
    ranked = in_order(roots.withColumn("all", F.lit("")), ["all"], [F.col("group").asc()])
    upper = build_levels(
        ranked.select(
            F.col("all").alias("group"), F.col("nth").alias("idx"), F.col("group_rows").alias("n"), "node",
            F.struct(F.col("group").alias("of"), "level", F.col("node").alias("subroot")).alias("row"),
        ),
        run,
    )
    top = group_roots(upper).first()
    if top is None:
        return frame.select(order).limit(0).join(spark.createDataFrame([], RESULT), F.lit(False))
    root = F.unhex(F.lit(bytes(top["node"]).hex()))
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    crown = spark.createDataFrame([("", top["level"])], "group string, level int").select(
        "group", "level", nothing.alias("above"), F.lit(None).cast("binary").alias("subroot")
    )
    tops = saved(
        proofs(upper, crown, run).select(
            F.col("row.of").alias("group"), F.col("row.level").alias("level"), F.col("path").alias("above"), "row.subroot"
        )
    )
    found = proofs(levels, tops, run)
    folded = F.aggregate(
        "path", F.coalesce(F.col("row.changed"), F.col("row.leaf")), lambda acc, s: node_digest(s["left"], acc, s["right"])
    )
    around = F.transform("path", lambda s: text_of(F.concat(_or_empty(s["left"]), _or_empty(s["right"]))))
    return found.select(
        F.col("row.key").alias(order),
        text_of(F.col("row.leaf")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        text_of(root).alias("root"),
        F.sha2(F.array_join(around, ""), 256).alias("proof_sha256"),
        text_of(folded).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
