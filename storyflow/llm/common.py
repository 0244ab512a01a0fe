"""What the operators of this subpackage share: reading, cutting lineage, keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on this machine alone, as in tests.
LOCAL_SHARED = "/tmp/storyflow-checkpoints"

#: Rows summed up together by :func:`offsets`.
CHUNK = 256

#: Whole texts handed to Python at once, at most: see :func:`text_batches`.
TEXT_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme and authority that Spark gives a path without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def session_dir(spark: SparkSession) -> str:
    """This application's folder in the shared place that the session names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = LOCAL_SHARED
    return qualified(spark, f"{root.rstrip('/')}/storyflow-{spark.sparkContext.applicationId}")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in :func:`session_dir`."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application: for callers who are done with its results."""
    remove(spark, session_dir(spark))


def named(alias: str, column: str) -> Column:
    """A column of an aliased table, whatever characters its name has."""
    return F.col(f"{alias}.`{column.replace('`', '``')}`")


def saved(df: DataFrame, *, codec: str = "snappy", folder: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage
    ends there, so a lost executor costs no more than the stage it was in."""
    path = folder or shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """For jobs that run within it: Arrow batches of at most ``TEXT_ROWS`` rows.  A batch of
    texts is held several times over, in the JVM outside its heap and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.  In a text of ASCII alone lower() does just that, and faster."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Words of the licence and benchmark operators: runs of ASCII letters and digits and of all other characters beyond ASCII.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a whole text, as an array; null and empty texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def pieces(df: DataFrame, target: int, least: int, *sizes: Column) -> int:
    """How many partitions of about ``target`` bytes the rows of ``df`` make, by one
    aggregate over them; ``least`` at least."""
    total = df.agg(F.sum(sum(sizes, F.lit(16)).cast("long")).alias("n")).first()["n"] or 0
    return max(least, -(-int(total) // target))


def offsets(rows: DataFrame, amount: str, by: tuple[str, ...] = (), *, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (part, k, ...) with ``at``: the sum of ``amount`` over all rows before it in the
    order of part and k, among those with equal ``by``.

    ``part`` numbers tasks, ``k`` the rows of one.  Sums go up by chunks of ``chunk`` rows,
    by parts and by ``CHUNK`` parts, so that no task sees more than a chunk's rows, a part's
    chunks or a row for every ``CHUNK`` parts.  ``by`` parts chunks further: then they may be larger."""

    def before(group: list[str], order: str, what: str) -> Column:
        return F.sum(what).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(what)

    by = list(by)
    rows = rows.withColumn("chunk", F.expr(f"k div {chunk}"))
    chunks = rows.groupBy(*by, "part", "chunk").agg(F.sum(amount).alias("c"))
    parts = chunks.groupBy(*by, "part").agg(F.sum("c").alias("c")).withColumn("far", F.expr(f"part div {CHUNK}"))
    far = parts.groupBy(*by, "far").agg(F.sum("c").alias("c")).select(*by, "far", before(by, "far", "c").alias("f"))
    parts = parts.join(far, [*by, "far"]).select(*by, "part", (F.col("f") + before([*by, "far"], "part", "c")).alias("p"))
    chunks = chunks.join(parts, [*by, "part"]).select(*by, "part", "chunk", (F.col("p") + before([*by, "part"], "chunk", "c")).alias("prior"))
    own = rows.withColumn("own", before([*by, "part", "chunk"], "k", amount))
    return own.join(chunks, [*by, "part", "chunk"]).withColumn("at", F.col("prior") + F.col("own")).drop("chunk", "own", "prior")
