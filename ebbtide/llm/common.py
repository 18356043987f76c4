"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.session import ensure_checkpoint_dir, scratch_path
from ebbtide.sources.tables import read_table

#: White space between words, as a class body that Java and Python patterns share.
SPACE = r"\x20\x09-\x0D"
SPLITTER = f"[{SPACE}]+"


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents", columns)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row and then bound to a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a whole text; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLITTER), "")


def saved(frame: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder: later reads do not compute them again."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def saved_in_loop(frame: DataFrame) -> DataFrame:
    """As ``saved``, for loops, as a table in that folder: the planner then knows its true size.

    A checkpoint keeps the estimates of the plan it came from; joined again and again, those grow without end.
    """
    path = scratch_path(frame.sparkSession, "round")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Lets go of an action's shuffle files when it has ended.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved_and_swept(frame: DataFrame) -> DataFrame:
    """As ``saved_in_loop``; the shuffle files go as soon as the table is written, so the disk never holds those of all steps."""
    spark = frame.sparkSession
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        return saved_in_loop(frame)
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def discard(*frames: DataFrame) -> None:
    """Deletes tables of ``saved_in_loop`` that nothing will read any more."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unclash(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without columns that carry a name an operator is about to add (case does not tell names apart)."""
    taken = {name.lower() for name in names}
    clashing = [name for name in frame.columns if name.lower() in taken]
    return frame.drop(*clashing) if clashing else frame
