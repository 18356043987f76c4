"""Tree models on the feature table: fit, score, select, validate, explain and save.

Boosted trees from ``pyspark.ml`` stand in for the original library, so scores differ in value while
inputs, labels, outputs and evaluation match.  Missing numbers become 0 beside a missing marker.
"""

from __future__ import annotations

import math
import random
import statistics
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ebbtide.operators.clean import class_weights
from ebbtide.operators.evaluate import roc_auc
from ebbtide.operators.prefix import running_totals
from ebbtide.operators.select import correlated_pairs, drop_correlated
from ebbtide.operators.slots import KEY, SCENARIO
from ebbtide.session import scratch_path

SEED = 42
LABEL, FEATURES, WEIGHT = "label", "features", "WEIGHT"
ROW_ORDER = (SCENARIO, KEY)

#: Settings that the search draws from: few, strong trees, as every level of a tree is a pass over the rows.
SEARCH_SPACE = {
    "maxIter": [12, 18, 24],
    "maxDepth": [3, 4, 5],
    "stepSize": [0.1, 0.2, 0.3],
    "minInstancesPerNode": [5, 15, 45],
    "featureSubsetStrategy": ["onethird", "0.6", "all"],
    "subsamplingRate": [0.6, 0.8, 1.0],
    "class_weight": ["balanced", None],
}
#: Shares of the trees that the rungs of a search fit, and the share of the settings that stays after each.
RUNGS, SURVIVORS = (0.25, 0.5, 1.0), 1 / 3
#: Bins of a number in a binned table; 0 is a missing one.
BINS = 64
#: Rows of a task that grows forests: fewer tasks than two a core only below the first, more only above the second.
#: Up to the first, rows are too few to be dealt anew.
LEAST_ROWS, MOST_ROWS = 10_000, 500_000


def _string_columns(frame: DataFrame, features: Sequence[str]) -> list[str]:
    return [c for c in features if isinstance(frame.schema[c].dataType, StringType)]


def feature_stages(frame: DataFrame, features: Sequence[str]) -> tuple[list, list[str]]:
    """Stages that turn named columns into one vector, and the name behind every vector position."""
    texts = _string_columns(frame, features)
    numbers = [c for c in features if c not in texts]
    holes = ", ".join(
        f"coalesce(cast(`{c}` AS double), 0D) AS `{c}__v`, cast(`{c}` IS NULL AS double) AS `{c}__m`"
        for c in numbers
    )
    stages: list = [SQLTransformer(statement=f"SELECT *, {holes} FROM __THIS__")] if numbers else []
    if texts:
        stages.append(
            StringIndexer(inputCols=texts, outputCols=[f"{c}__i" for c in texts], handleInvalid="keep")
        )
    inputs = [f"{c}__{part}" for c in numbers for part in "vm"] + [f"{c}__i" for c in texts]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return stages, [c for c in numbers for _ in "vm"] + texts


def labelled(frame: DataFrame, target: str) -> DataFrame:
    return frame.where(F.col(target).isNotNull()).withColumn(LABEL, F.col(target).cast("double"))


def classifier(params: Mapping[str, object] | None = None, **extra: object) -> GBTClassifier:
    return GBTClassifier(labelCol=LABEL, featuresCol=FEATURES, seed=SEED, **{**(params or {}), **extra})


def fit(frame: DataFrame, target: str, features: Sequence[str], estimator=None) -> PipelineModel:
    """Fit a classifier (boosted trees unless given) on the named features."""
    stages, _ = feature_stages(frame, features)
    return Pipeline(stages=[*stages, estimator or classifier()]).fit(labelled(frame, target))


def score(model: PipelineModel, frame: DataFrame, target: str | None = None) -> DataFrame:
    """``PROBA`` and ``PRED_TARGET`` per key and scenario, with ``TARGET`` if it is known."""
    scored = model.transform(frame)
    known = [F.col(target).alias("TARGET")] if target else []
    return scored.select(
        KEY,
        SCENARIO,
        *known,
        vector_to_array("probability")[1].alias("PROBA"),
        (F.col("prediction") == 1).alias("PRED_TARGET"),
    )


def score_horizons(models: Mapping[int, PipelineModel], frame: DataFrame) -> DataFrame:
    """``PROBA_<ph>S`` of every model beside the row's own columns, in one pass without joins."""
    kept = frame.columns
    for ph, model in models.items():
        name = f"PROBA_{ph}S"
        scored = model.transform(frame.select(*kept))
        frame = scored.select(*kept, vector_to_array("probability")[1].alias(name))
        kept = [*kept, name]
    return frame


def importance_ranking(model: PipelineModel, frame: DataFrame, features: Sequence[str]) -> list[tuple[str, float]]:
    """Feature importances, largest first; a feature's value and missing marker are added up."""
    _, names = feature_stages(frame, features)
    totals = dict.fromkeys(features, 0.0)
    for name, weight in zip(names, model.stages[-1].featureImportances.toArray(), strict=True):
        totals[name] += float(weight)
    return sorted(totals.items(), key=lambda item: (-item[1], item[0]))


def select_features(
    frame: DataFrame, target: str, features: Sequence[str], forced: Sequence[str] = (), estimator=None,
    top: int = 40, keep: int = 15, cutoff: float = 0.8,
) -> tuple[list[str], list[tuple[str, float]]]:
    """Most important features that do not repeat a more important one, plus forced ones."""
    ranking = importance_ranking(fit(frame, target, features, estimator), frame, features)
    best = [name for name, _ in ranking[:top]]
    texts = set(_string_columns(frame, best))
    pairs = correlated_pairs(frame, [c for c in best if c not in texts], cutoff)
    return drop_correlated(best, pairs, keep, forced), ranking


def ranking_frame(spark: SparkSession, ranking: Sequence[tuple[str, float]]) -> DataFrame:
    """Importances as a frame (one row per feature)."""
    schema = StructType(
        [
            StructField("POSITION", IntegerType()),
            StructField("FEATURE", StringType()),
            StructField("IMPORTANCE", DoubleType()),
        ]
    )
    return spark.createDataFrame([(i + 1, *item) for i, item in enumerate(ranking)], schema)


def _fold_order(frame: DataFrame) -> list:
    return [F.xxhash64(*ROW_ORDER, F.lit(SEED)), *[F.col(c) for c in ROW_ORDER]]


def count_below(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds are below the value, by steps of a root's length and then one by one."""
    bounds = sorted(bounds, key=lambda b: (math.isnan(b), b))  # as Spark orders numbers
    if not bounds:
        return F.lit(0)
    step = math.ceil(math.sqrt(len(bounds)))
    cuts, marks = F.array(*map(F.lit, bounds)), bounds[step - 1 :: step]
    passed = F.size(F.filter(F.array(*map(F.lit, marks)), lambda b: b < value)) * step
    return passed + F.size(F.filter(F.slice(cuts, passed + 1, step), lambda b: b < value))


def bin_table(frame: DataFrame, target: str, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """Keys, label and features as bin numbers, written once: every fold, draw and round reads this table.

    Boundaries come from one pass of approximate quantiles over all numbers.  A bin is the number of boundaries
    below the value, from 1; a missing number is 0, so trees can tell it from all others.  Texts are numbered by
    frequency.
    """
    rows = labelled(frame, target)
    texts = _string_columns(frame, features)
    numbers = [c for c in features if c not in texts]
    steps = [k / (bins - 1) for k in range(1, bins - 1)]
    cuts = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, 50 * bins).alias(c) for c in numbers]).first() if numbers else {}

    def place(c: str) -> Column:
        bounds = sorted(set(cuts[c] or []))
        value = F.col(c).cast("double")
        return F.when(value.isNull(), 0).otherwise(count_below(value, bounds) + 1).cast("short").alias(c)

    if texts:
        indexer = StringIndexer(inputCols=texts, outputCols=[f"{c}__i" for c in texts], handleInvalid="keep").fit(rows)
        rows = indexer.transform(rows)
    binned = rows.select(*ROW_ORDER, LABEL, *[place(c) for c in numbers], *[F.col(f"{c}__i").alias(c) for c in texts])
    path = scratch_path(frame.sparkSession, "binned")
    binned.write.parquet(path)
    return frame.sparkSession.read.schema(binned.schema).parquet(path)


def hashed_folds(frame: DataFrame, folds: int) -> DataFrame:
    """``FOLD`` by the digest of the row's key and label: no order over all rows, and a row keeps its fold in any frame."""
    text = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (*ROW_ORDER, LABEL)])
    return frame.withColumn("FOLD", (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % folds).cast("int"))


def _matrix(table: DataFrame, features: Sequence[str], folds: int) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES)
    weighted = class_weights(hashed_folds(table, folds), LABEL).withColumn("EVEN", F.lit(1.0))
    return assembler.transform(weighted).select(*ROW_ORDER, LABEL, FEATURES, "FOLD", WEIGHT, "EVEN")


def _in_parallel(spark: SparkSession, work: Callable, cases: Sequence, parallelism: int) -> list:
    """Results of independent fits, whose small jobs share the cluster."""
    pool = ThreadPool(max(1, min(parallelism, len(cases))))
    try:
        return pool.map(inheritable_thread_target(spark)(work), cases)
    finally:
        pool.close()


def fold_auc(rows: DataFrame, fold: int, estimator) -> float:
    """AUC on a fold of an estimator fitted on the others."""
    fitted = estimator.fit(rows.where(F.col("FOLD") != fold))
    evaluator = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="rawPrediction", numBins=0)
    return float(evaluator.evaluate(fitted.transform(rows.where(F.col("FOLD") == fold))))


def cv_auc(
    frame: DataFrame, target: str, features: Sequence[str], folds: int = 6, estimator=None, parallelism: int = 6
) -> DataFrame:
    """Mean and population deviation (three decimals) of the AUC over folds dealt by hash within the label."""
    rows = _matrix(bin_table(frame, target, features), features, folds).persist()
    try:
        found = _in_parallel(frame.sparkSession, lambda k: fold_auc(rows, k, estimator or classifier(maxBins=BINS)), range(folds), parallelism)
    finally:
        rows.unpersist()
    areas = frame.sparkSession.createDataFrame([(v,) for v in found], "ROC_AUC double")
    return areas.agg(
        F.round(F.avg("ROC_AUC"), 3).alias("MEAN_AUC"),
        F.round(F.stddev_pop("ROC_AUC"), 3).alias("STD_AUC"),
        F.count("ROC_AUC").alias("N_FOLDS"),
    )


def draw_params(n: int, space: Mapping[str, Sequence] = SEARCH_SPACE, seed: int = SEED) -> list[dict]:
    """Distinct random settings from a search space."""
    rng = random.Random(seed)
    seen: dict[tuple, dict] = {}
    while len(seen) < min(n, math.prod(len(v) for v in space.values())):
        drawn = {name: rng.choice(list(values)) for name, values in space.items()}
        seen.setdefault(tuple(map(str, drawn.values())), drawn)
    return list(seen.values())


def setting(params: Mapping[str, object], share: float = 1.0) -> GBTClassifier:
    """Classifier of one drawn setting with a share of its trees."""
    plain = {k: v for k, v in params.items() if k != "class_weight"}
    plain["maxIter"] = max(1, math.ceil(share * plain.get("maxIter", 20)))
    weight = WEIGHT if params.get("class_weight") == "balanced" else "EVEN"
    return classifier(plain, maxBins=BINS, weightCol=weight)


def random_search(
    frame: DataFrame, target: str, features: Sequence[str], draws: int = 10, folds: int = 5,
    space: Mapping[str, Sequence] = SEARCH_SPACE, parallelism: int = 8, rungs: Sequence[float] = RUNGS,
) -> tuple[DataFrame, dict]:
    """Randomised search by successive halving: one row per drawn setting, and the best.

    All settings are fitted with the first share of their trees on every fold; the best third goes on to the next
    share, and so on.  A row has the mean and deviation of the AUC over the folds at the last rung it reached.
    All fits read one binned matrix, kept in memory while the search runs.
    """
    rows = _matrix(bin_table(frame, target, features), features, folds).persist()
    drawn = draw_params(draws, space)
    alive, last = list(range(len(drawn))), {}
    try:
        for rung, share in enumerate(rungs):
            cases = [(i, k) for i in alive for k in range(folds)]
            found = _in_parallel(frame.sparkSession, lambda c, s=share: fold_auc(rows, c[1], setting(drawn[c[0]], s)), cases, parallelism)
            for at, i in enumerate(alive):
                areas = found[at * folds : (at + 1) * folds]
                last[i] = (rung, setting(drawn[i], share).getMaxIter(), statistics.fmean(areas), statistics.pstdev(areas))
            alive = sorted(alive, key=lambda i: -last[i][2])
            if rung + 1 < len(rungs):
                alive = alive[: max(1, math.ceil(len(alive) * SURVIVORS))]
    finally:
        rows.unpersist()
    rows_out = [
        (i, ", ".join(f"{k}={v}" for k, v in params.items()), rung, trees, folds, mean, std)
        for i, params in enumerate(drawn)
        for rung, trees, mean, std in [last[i]]
    ]
    schema = "DRAW int, PARAMS string, RUNG int, N_TREES int, N_FOLDS int, MEAN_TEST_SCORE double, STD_TEST_SCORE double"
    return frame.sparkSession.createDataFrame(rows_out, schema), drawn[alive[0]]


def fit_regression(frame: DataFrame, target: str, features: Sequence[str], **params: object) -> PipelineModel:
    """Boosted regression on the 0/1 label."""
    stages, _ = feature_stages(frame, features)
    estimator = GBTRegressor(labelCol=LABEL, featuresCol=FEATURES, seed=SEED, **params)
    return Pipeline(stages=[*stages, estimator]).fit(labelled(frame, target))


def score_regression(model: PipelineModel, frame: DataFrame, target: str) -> DataFrame:
    """Regression output as ``PROBA``, called positive from 0.5."""
    scored = model.transform(labelled(frame, target))
    return scored.select(
        KEY, SCENARIO, F.col(target).alias("TARGET"), F.col("prediction").alias("PROBA"),
        (F.col("prediction") >= 0.5).alias("PRED_TARGET"),
    )


def r_squared(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient of determination of a scored regression, one row per group; NULL if the label never varies."""
    known = scored.where(F.col("TARGET").isNotNull() & F.col("PROBA").isNotNull())
    label = F.col("TARGET").cast("double")
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("N_ROWS"),
        (1 - F.sum(F.pow(label - F.col("PROBA"), 2)) / F.nullif(F.var_pop(label) * F.count(F.lit(1)), F.lit(0.0))).alias("R2"),
    )


def r2(scored: DataFrame) -> float:
    return r_squared(scored).first()["R2"]


def numbered_rows(frame: DataFrame) -> tuple[DataFrame, int]:
    """Rows in a seeded random order with their position, and how many there are."""
    rows = running_totals(frame, _fold_order(frame), {"_row": F.lit(1)}).withColumn("_row", F.col("_row") - 1)
    rows = rows.persist()
    return rows, rows.count()


def with_partner(rows: DataFrame, n: int, shift: int, columns: Sequence[str], suffix: str) -> DataFrame:
    """Add the columns of another row, ``shift`` positions on in the random order: a permuted copy."""
    partner = rows.select(
        ((F.col("_row") + shift) % n).alias("_row"), *[F.col(c).alias(f"{c}{suffix}") for c in columns]
    )
    return rows.join(partner, "_row")


def permutation_importance(model: PipelineModel, frame: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """AUC lost when one feature is taken from another row, for every feature in one scoring job."""
    rows, n = numbered_rows(labelled(frame, target).select(*ROW_ORDER, target, *features))
    paired = with_partner(rows, n, max(1, n // 2), features, "__p")
    variants = ["", *features]
    cases = paired.withColumn("FEATURE", F.explode(F.array(*[F.lit(v) for v in variants])))
    swapped = cases.select(
        *ROW_ORDER,
        target,
        "FEATURE",
        *[F.when(F.col("FEATURE") == c, F.col(f"{c}__p")).otherwise(F.col(c)).alias(c) for c in features],
    )
    scored = model.transform(swapped).select(
        "FEATURE", F.col(target).alias("TARGET"), vector_to_array("probability")[1].alias("PROBA")
    )
    areas = roc_auc(scored, by=["FEATURE"])
    base = areas.where(F.col("FEATURE") == "").select("ROC_AUC").scalar()
    return areas.where(F.col("FEATURE") != "").select(
        "FEATURE", (base - F.col("ROC_AUC")).alias("AUC_DROP"), F.col("ROC_AUC").alias("AUC_PERMUTED")
    )


def _words(features: Sequence[str]) -> list[Column]:
    """Bins of a row, eight to a whole number: what a round lends is a few numbers instead of a vector."""
    parts = [[F.shiftleft(F.col(c).cast("long"), 8 * k) for k, c in enumerate(features[i : i + 8])] for i in range(0, len(features), 8)]
    return [reduce(Column.bitwiseOR, part) for part in parts]


def _bin_at(words: Sequence[str], at: int) -> Column:
    return F.shiftrightunsigned(F.col(words[at // 8]), 8 * (at % 8)).bitwiseAND(F.lit(255)).cast("double")


def with_lenders(rows: DataFrame, n: int, shifts: Sequence[int], words: Sequence[str]) -> DataFrame:
    """Label and words of every row beside, per shift, the words of the row that many positions before it.

    A row is sent to its own position and to one per shift, and all meet in a single shuffle, whatever the number of
    shifts.  Positions are spread over the tasks evenly and stand in order there.  Few rows stay in their place.
    """
    places = [F.struct(((F.col("_row") + shift) % n).alias("_at"), F.lit(k).alias("_turn")) for k, shift in enumerate([0, *shifts])]
    lent = [F.max(F.when(F.col("_turn") == k, F.col(w))).alias(f"{w}_{k}") for k in range(1, len(places)) for w in words]
    if n <= LEAST_ROWS:
        found = rows.select(F.inline(F.array(*places[1:])), *words).groupBy("_at").agg(*lent)
        own = rows.select("_row", LABEL, *[F.col(w).alias(f"{w}_0") for w in words])
        return own.join(F.broadcast(found), F.col("_row") == F.col("_at")).drop("_row", "_at")
    slots = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    parts = min(math.ceil(n / LEAST_ROWS), max(2 * slots, math.ceil(n / MOST_ROWS)))
    sent = rows.select(F.inline(F.array(*places)), LABEL, *words).repartition(parts, "_at")
    own = [F.max(F.when(F.col("_turn") == 0, F.col(c))).alias(name) for c, name in [(LABEL, LABEL), *[(w, f"{w}_0") for w in words]]]
    return sent.groupBy("_at").agg(*own, *lent).sortWithinPartitions("_at").drop("_at")


def shadow_selection(
    frame: DataFrame, target: str, features: Sequence[str], rounds: int = 20, alpha: float = 0.05,
    trees: int = 50, depth: int = 6, parallelism: int = 3,
) -> DataFrame:
    """Features that beat the best permuted copy more often than chance would let them.

    Rows are binned once (a missing number has a bin of its own, so no row is dropped).  Each round sets beside a
    row the whole matrix row of another one: the borrowed values are the shadow features.  After each round a
    binomial test on both sides decides features; a rejected one leaves the forest, and the rounds end when all
    are decided.  Rounds before the next one that could decide a feature do not depend on each other: they borrow in
    one shuffle and their forests grow side by side.  ``SELECTED`` is true for the accepted; ``ROUNDS`` is how many a
    feature took part in.
    """
    texts = set(_string_columns(frame, features))
    if texts:
        raise ValueError(f"numbers only: {sorted(texts)}")
    words = [f"_w{i}" for i in range(math.ceil(len(features) / 8))]
    packed = bin_table(frame, target, features).select(*ROW_ORDER, LABEL, *[w.alias(c) for w, c in zip(_words(features), words, strict=True)])
    rows, n = numbered_rows(packed)
    bar = alpha / len(features)
    hits, played = dict.fromkeys(features, 0), dict.fromkeys(features, 0)
    accepted: set[str] = set()
    inside = list(range(len(features)))
    rng = random.Random(SEED)
    shifts = [rng.randrange(1, max(2, n)) for _ in range(rounds)]

    def importances(paired: DataFrame, turn: int, lender: int) -> Sequence[float]:
        bins = [_bin_at([f"{w}_{k}" for w in words], at).alias(f"{side}{at}") for side, k in (("r", 0), ("s", lender)) for at in inside]
        sides = VectorAssembler(inputCols=[f"{side}{at}" for side in "rs" for at in inside], outputCol=FEATURES)
        forest = RandomForestClassifier(
            labelCol=LABEL, featuresCol=FEATURES, numTrees=trees, maxDepth=depth, maxBins=BINS, seed=SEED + turn
        )
        return forest.fit(sides.transform(paired.select(LABEL, *bins)).select(LABEL, FEATURES)).featureImportances.toArray()

    turn = 0
    try:
        while turn < rounds:
            last = min(rounds, turn + min(_undecided_for(hits[features[k]], played[features[k]], features[k] in accepted, bar, rounds) for k in inside))
            paired = with_lenders(rows, n, shifts[turn:last], words).persist()
            try:
                found = _in_parallel(frame.sparkSession, lambda t, p=paired, at=turn: importances(p, t, t - at + 1), range(turn, last), parallelism)
            finally:
                paired.unpersist()
            for weights in found:
                best_shadow = max(weights[len(inside):])
                for k, at in enumerate(inside):
                    hits[features[at]] += int(weights[k] > best_shadow)
                    played[features[at]] += 1
            accepted |= {c for c in features if at_least(hits[c], played[c]) <= bar}
            inside = [k for k in inside if at_least(played[features[k]] - hits[features[k]], played[features[k]]) > bar]
            if all(features[k] in accepted for k in inside):
                break
            turn = last
    finally:
        rows.unpersist()
    found = [(c, hits[c], played[c], c in accepted) for c in features]
    schema = "FEATURE string, HITS int, ROUNDS int, SELECTED boolean"
    return frame.sparkSession.createDataFrame(found, schema)


def _undecided_for(hits: int, played: int, accepted: bool, bar: float, most: int) -> int:
    """Rounds until the first after which a feature could be rejected or, unless it is yet, accepted."""
    def may(m: int) -> bool:
        return at_least(played - hits + m, played + m) <= bar or (not accepted and at_least(hits + m, played + m) <= bar)

    return next((m for m in range(1, most) if may(m)), most)


def at_least(hits: int, rounds: int) -> float:
    """Chance of at least this many successes in fair coin tosses."""
    return sum(math.comb(rounds, k) for k in range(hits, rounds + 1)) / 2**rounds


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def score_batch(frame: DataFrame, path: str) -> DataFrame:
    """Score rows with a saved model."""
    return score(PipelineModel.load(path), frame)


def log_run(spark: SparkSession, path: str, tags: Mapping[str, object], metrics: Mapping[str, float]) -> None:
    """Append one row per metric to the runs table."""
    rows = [(*(str(tags[k]) for k in ("RUN", "PH", "CP")), name, float(v)) for name, v in metrics.items()]
    schema = "RUN string, PH string, CP string, METRIC string, VALUE double"
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
