"""Secret scans: broad candidates, and a random forest trained on labelled findings that removes false positives.

A candidate is a long run of key-like characters that holds a digit, or any value assigned to a telling name.  Its features are its length, how
often its characters change class and how usual its letter pairs are, how much of it dictionary words
cover, where it was found, and the words beside it.  Dictionary and letter pairs are counted over all texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import saved, words_of
from ebbtide.llm.personal import _luhn, matches

RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+"
#: Formats whose findings are labelled without a person: issued keys, and assignments to a telling name.
ISSUED = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$"
NAMED = r"(pass(?:word|wd)?|secret|token|api_?key|access_?key)[\"']?\s*[:=]\s*"
ASSIGNED = rf"(?i){NAMED}[\"']?$"
#: An assigned value: what the quotes hold, or all up to white space or a quote without stops, commas and brackets at its end.
VALUE = r"(?:\"[^\"\n]*[^\"\s][^\"\n]*\"|'[^'\n]*[^'\s][^'\n]*'|[^\s\"']*[^\s\"'.,;:)\]}])"
#: Words of the dictionary, labelled values used for training at most (half of them of each label, or all there are),
#: trees, depth, and least score of a secret.
DICTIONARY, LABELLED, TREES, DEPTH, LEAST = 5_000, 20_000, 30, 6, 0.5
HASHED = 48
NEAR = 60
NUMBERS = ["length", "changes", "digits", "uppers", "usual", "covered"]


def _assigned(text: Column) -> Column:
    """Values assigned to telling names, any characters and length: ``start``, ``end``, ``value``."""
    def inner(span: Column) -> Column:
        lead = F.length(F.regexp_extract(span["value"], f"(?i)^{NAMED}[\"']?", 0))
        tail = F.when(F.substr(span["value"], lead, F.lit(1)).isin("'", '"'), 1).otherwise(0)
        return F.struct(
            (span["start"] + lead).alias("start"),
            (span["end"] - tail).alias("end"),
            F.substr(span["value"], lead + 1, F.length(span["value"]) - lead - tail).alias("value"),
        )

    return F.transform(matches(text, f"(?i){NAMED}{VALUE}", "secret", 0), inner)


def candidates(frame: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Every candidate of every whole text with its place, ``path`` and the text beside it.

    A run inside an assigned value is part of that value.
    """
    rows = frame.where(F.col(text).rlike("[A-Za-z0-9+/_-]{12}") | F.col(text).rlike(f"(?i){NAMED}")).select(
        F.col(key).alias("id"), F.col(path).cast("string").alias("path"), F.col(text).alias("text")
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    named = F.when(F.col("text").rlike(f"(?i){NAMED}"), _assigned(F.col("text"))).otherwise(empty)
    runs = F.transform(matches(F.col("text"), RUN, "secret", 0), lambda r: F.struct(r["start"], r["end"], r["value"]))
    loose = F.filter(runs, lambda r: ~F.exists("named", lambda v: (v["start"] <= r["start"]) & (r["end"] <= v["end"])))
    found = rows.withColumn("named", named).withColumn("found", F.concat("named", loose)).select("id", "path", "text", F.inline("found"))
    before = F.substr("text", F.greatest(F.col("start") - NEAR + 1, F.lit(1)), F.least("start", F.lit(NEAR)))
    after = F.substr("text", F.col("end") + 1, F.lit(NEAR))
    return found.select("id", "path", "start", "end", "value", before.alias("before"), after.alias("after"))


def label(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for issued formats and assigned runs, 0 for payment cards, numbers and ordinary names, NULL if open."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    card = (F.length("value") == F.length(digits)) & F.length(digits).between(14, 19) & _luhn(digits)
    worded = F.col("value").rlike("^[A-Za-z]+([_/-]?[A-Za-z]+)*[_/-]?[0-9]{1,4}$")
    number = F.col("value").rlike("^[0-9-]+$")
    return found.withColumn(
        "label",
        F.when(F.col("value").rlike(ISSUED) | (F.col("before").rlike(ASSIGNED) & F.col("value").rlike(f"^{RUN}$")), 1.0).when(card | worded | number, 0.0),
    )


def word_statistics(frame: DataFrame, text: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` frequent words of letters (``part``), and log10 shares of letter pairs over all words (``pair``, ``usual``).

    Candidates are ASCII, so of the pairs only those of a-z are returned; the shares are among all.
    """
    words = frame.select(F.explode(words_of(F.lower(F.col(text)))).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counted = saved(words.where(F.col("part").rlike("^\\p{L}{2,}$")))
    top = saved(counted.orderBy(F.desc("n"), "part").limit(most))
    twos = F.transform(F.sequence(F.lit(1), F.length("part") - 1), lambda k: F.substr("part", k, F.lit(2)))
    pairs = saved(counted.select("n", F.explode(twos).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")))
    total = pairs.agg(F.sum("n")).first()[0] or 1
    plain = pairs.where(F.col("pair").rlike("^[a-z]{2}$"))
    return top.select("part"), saved(plain.select("pair", F.log10(F.col("n") / total).alias("usual")))


def features(found: DataFrame, dictionary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Numbers and neighbours of each candidate (it must have a unique ``row``)."""

    def classes(value: Column) -> Column:
        return F.translate(
            F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "+/_-", "...."
        )

    shape = classes(F.col("value"))
    changes = F.length(F.regexp_replace(shape, r"(.)\1*", "x")) - 1
    parts = F.array_remove(F.split(F.lower("value"), "[^a-z]+"), "")
    covered = (
        found.select("row", F.explode(parts).alias("part"))
        .join(F.broadcast(dictionary), "part")
        .groupBy("row")
        .agg(F.sum(F.length("part")).alias("inside"))
    )
    steps = F.when(F.length("value") > 1, F.sequence(F.lit(1), F.length("value") - 1))
    usual = (
        found.select("row", F.explode(F.transform(steps, lambda k: F.substr(F.lower("value"), k, F.lit(2)))).alias("pair"))
        .join(F.broadcast(pairs), "pair", "left")
        .groupBy("row")
        .agg(F.avg(F.coalesce("usual", F.lit(-8.0))).alias("usual"))
    )
    size = F.length("value")
    beside = words_of(F.lower(F.regexp_replace("before", "[\"']", "")))
    following = words_of(F.lower("after"))
    near = F.when(F.col("before").rlike(f"[^ {chr(9)}-{chr(13)}]$"), F.try_element_at(beside, F.lit(-1))).otherwise(F.lit(""))
    return (
        found.join(covered, "row", "left")
        .join(usual, "row", "left")
        .withColumns(
            {
                "length": size.cast("double"),
                "changes": changes / size,
                "digits": F.regexp_count("value", F.lit("[0-9]")) / size,
                "uppers": F.regexp_count("value", F.lit("[A-Z]")) / size,
                "covered": F.coalesce(F.col("inside") / size, F.lit(0.0)),
                "usual": F.coalesce("usual", F.lit(-8.0)),
                "at_path": F.coalesce("path", F.lit("")),
                "joined_to": F.coalesce(near, F.lit("")),
                "last_word": F.coalesce(F.try_element_at(beside, F.lit(-1)), F.lit("")),
                "word_before": F.coalesce(F.try_element_at(beside, F.lit(-2)), F.lit("")),
                "word_after": F.coalesce(F.get(following, F.lit(0)), F.lit("")),
            }
        )
        .drop("inside")
    )


def train_forest(labelled: DataFrame, most: int = LABELLED, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
    """A forest over findings with features and ``label``, which weighs both labels alike.

    Of more than ``most`` distinct values those of least hash within their label are used: half of ``most`` of
    each label, and more of one if there are fewer of the other.  None if there are not findings of both labels.
    """
    known = saved(labelled.where(F.col("label").isNotNull()).dropDuplicates(["value", "label"]))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    few, many = sorted(sizes, key=lambda name: (sizes[name], name))
    take = {few: min(sizes[few], max(most // 2, 1))}
    take[many] = min(sizes[many], max(most - take[few], 1))
    drawn = [
        known.where(F.col("label") == name).orderBy(F.xxhash64("value"), "value").limit(n).withColumn("weight", F.lit(sum(take.values()) / 2 / n))
        for name, n in take.items()
    ]
    bounded = saved(reduce(DataFrame.unionByName, drawn))
    words = ["at_path", "joined_to", "last_word", "word_before", "word_after"]
    stages = [
        FeatureHasher(inputCols=words, outputCol="words", numFeatures=HASHED),
        VectorAssembler(inputCols=[*NUMBERS, "words"], outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed),
    ]
    return Pipeline(stages=stages).fit(bounded)


def scan_secrets(
    frame: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", findings: DataFrame | None = None,
    least: float = LEAST, **options,
) -> DataFrame:
    """One row per candidate: ``key``, ``start``, ``end`` (characters, end exclusive), ``value``, ``score``, ``is_secret``.

    ``findings`` are labelled ones (``value``, ``label``) of a person; without them the formats label those they are sure
    of.  A finding labelled 1 scores 1, the forest judges the others; without findings of both labels there is no
    forest and any other scores 0.
    NULL and empty texts have no candidate, NULL paths and ids are values of their own, repeated rows repeat
    their findings, other columns are not looked at, and an empty frame gives an empty result.
    """
    found = saved(candidates(frame, key, text, path)).withColumn("row", F.monotonically_increasing_id())
    if findings is None:
        marked = label(found)
    else:
        marked = found.join(findings.select("value", F.col("label").cast("double")).dropDuplicates(["value"]), "value", "left")
    dictionary, pairs = word_statistics(frame, text, DICTIONARY)
    ready = saved(features(saved(marked), dictionary, pairs))
    forest = train_forest(ready, **options)
    if forest is None:
        scored = ready.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        judged = F.get(vector_to_array("probability"), F.lit(1))
        scored = forest.transform(ready).withColumn("score", F.when(F.col("label") == 1, 1.0).otherwise(judged))
    return scored.select(F.col("id").alias(key), "start", "end", "value", "score", (F.col("score") >= least).alias("is_secret"))
