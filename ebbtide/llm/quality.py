"""Quality rules: base counts of a text and boilerplate lines found by their frequency across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import SPACE, let, saved, unclash, words_of

#: A line is boilerplate on its host above both limits: distinct texts holding it, and their share.
LINE_TEXTS = 25
LINE_SHARE = 0.02
#: A document that loses more than this share of its words is depleted.
LOST_SHARE = 0.5
#: More boilerplate lines than this are joined by a shuffle, not sent to every task (16 bytes each).
BROADCAST_LINES = 1_000_000
_ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines",
          "n_removed_words", "kept"]


def _repeated(words: Column) -> Column:
    """Words inside a window of three words that occurs more than once in the text."""
    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, k: F.least(F.coalesce(F.get(starts, k + 1) - at, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def again(windows: Column) -> Column:
        same = F.filter(
            windows,
            lambda w, k: F.coalesce(w["h"] == F.get(windows, k + 1)["h"], F.lit(False))
            | ((k > 0) & F.coalesce(w["h"] == F.get(windows, k - 1)["h"], F.lit(False))),
        )
        return let(F.sort_array(F.transform(same, lambda w: w["at"])), covered)

    def ordered(hashes: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - 3),
            lambda k: F.struct(
                F.xxhash64(F.get(hashes, k), F.get(hashes, k + 1), F.get(hashes, k + 2)).alias("h"), k.alias("at")
            ),
        )
        return let(F.sort_array(windows), again)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, ordered)).cast("long")


def base_counts(frame: DataFrame, text: str = "text") -> DataFrame:
    """Adds the word, symbol, line and repetition counts and ``base_failed``; a NULL text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    counted = frame.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
    return (
        counted.withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": _repeated(F.col("_words")),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_words", "_lines")
    )


def _line_key(line: Column) -> Column:
    """Hash of a normalised line: lower case, single spaces, none at the ends."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), f"[{SPACE}]+", " ")))


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{SPACE}]")


def boilerplate(
    frame: DataFrame, text: str = "text", host: str = "source", texts: int = LINE_TEXTS, share: float = LINE_SHARE
) -> DataFrame:
    """One row per host that has lines in more than ``texts`` and ``share`` of its distinct texts: ``lines``.

    Copies of one text count once, so a page copied often does not lose its lines.  Counts are combined
    before they move; a host or line of any size is spread over many tasks.  NULL is a host of its own.
    """
    keys = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), _has_word), _line_key))
    distinct = (
        frame.where(F.col(text).isNotNull())
        .select(F.col(host).alias("host"), F.xxhash64(text).alias("body"), F.length(text).alias("size"), keys.alias("keys"))
        .groupBy("host", "body", "size")
        .agg(F.any_value("keys").alias("keys"))
    )
    # A NULL key stands for the document itself: its count is the number of distinct texts on the host.
    counts = (
        distinct.select("host", F.explode(F.concat("keys", F.array(F.lit(None).cast("long")))).alias("key"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = saved(counts.where((F.col("n") > texts) | F.col("key").isNull()))
    sizes = counts.where(F.col("key").isNull()).select(F.col("host").alias("of"), F.col("n").alias("size"))
    return (
        counts.where(F.col("key").isNotNull())
        .join(sizes, F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("n") > F.col("size") * share)
        .groupBy("host")
        .agg(F.collect_list("key").alias("lines"))
    )


def quality_rules(
    frame: DataFrame,
    text: str = "text",
    host: str = "source",
    texts: int = LINE_TEXTS,
    share: float = LINE_SHARE,
    lost: float = LOST_SHARE,
) -> DataFrame:
    """Every row with its counts, ``text`` without boilerplate lines, what was removed, and ``kept``.

    ``kept`` is false for texts that fail the base rules or lose more than ``lost`` of their words.  The
    counts describe the text as it came.  A NULL text stays NULL, counts as empty and is not kept; a NULL
    host is a host; repeated rows get equal results; an empty frame stays empty; columns that carry an
    added name are replaced.
    """
    frame = unclash(frame, _ADDED)
    common = saved(boilerplate(frame, text, host, texts, share)).select(F.col("host").alias("_host"), F.col("lines").alias("_common"))
    small = (common.agg(F.sum(F.size("_common"))).first()[0] or 0) <= BROADCAST_LINES
    joined = base_counts(frame, text).join(
        F.broadcast(common) if small else common, F.col(host).eqNullSafe(F.col("_host")), "left"
    )

    def is_common(line: Column) -> Column:
        return _has_word(line) & F.array_contains("_common", _line_key(line))

    lines = F.split(F.col(text), "\n")
    touched = F.col("_common").isNotNull() & F.col(text).isNotNull()
    gone = F.when(touched, F.filter(lines, is_common)).otherwise(F.array().cast("array<string>"))
    found = joined.withColumn("_gone", gone)
    cleaned = F.when(
        F.size("_gone") > 0, F.array_join(F.filter(lines, lambda line: ~F.array_contains("_gone", line)), "\n")
    ).otherwise(F.col(text))
    removed = F.size(words_of(F.array_join("_gone", " "))).cast("long")
    return found.withColumns(
        {
            text: cleaned,
            "n_removed_lines": F.size("_gone").cast("long"),
            "n_removed_words": removed,
            "kept": ~F.col("base_failed") & (removed <= lost * F.col("n_words")),
        }
    ).select(*frame.columns, *_ADDED)
