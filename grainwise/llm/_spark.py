"""Session helpers of the corpus operators: shared scratch tables and Arrow limits."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches that reach Python workers and frees a query's shuffle files when it ends.

    Both are session settings; they hold for the queries that follow.  The package's modules
    are sent to the workers, once for a Spark context.
    """
    context = spark.sparkContext
    if not getattr(context, "_grainwise_sent", False):
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp()  # the driver serves the file to the workers as long as it lives
        atexit.register(shutil.rmtree, folder, True)
        archive = Path(folder) / "grainwise_modules.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._grainwise_sent = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below a folder of our own where that is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/grainwise-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_made: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes a table to the shared folder and reads it again, so that a lost executor costs no more than a re-read."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if _made:
        _made[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes scratch tables made by ``written`` that nothing will read again."""
    for df in frames:
        _delete(df.sparkSession, sorted({p.rsplit("/", 1)[0] for p in df.inputFiles()}))


def tidy(operator: Callable) -> Callable:
    """Deletes the scratch tables of an operator's call that its resulting DataFrames do not read; all of them if it fails."""

    @wraps(operator)
    def run(*args, **more):
        _made.append([])
        keep: set[str] = set()
        try:
            out = operator(*args, **more)
            for df in out if isinstance(out, tuple) else (out,):
                if isinstance(df, DataFrame) and _made[-1]:
                    keep |= {p.rsplit("/", 2)[-2] for p in df.inputFiles()}
        finally:
            paths = _made.pop()
            _delete(SparkSession.active(), [p for p in paths if p.rsplit("/", 1)[-1] not in keep])
        if _made:
            _made[-1] += [p for p in paths if p.rsplit("/", 1)[-1] in keep]
        return out

    return run


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", pieces: int = 2000) -> DataFrame:
    """``left`` joined with a table of one row for each key, in which ``n_left`` says how many rows of left have it.

    A key with over 1/pieces of the rows is dealt out to as many tasks as it has such
    parts, by ``spread`` (of a row of left); its row of right is copied to each.  There are
    at most ``pieces`` such keys, which are broadcast to mark the rows of left, and at most
    2 x pieces copies.  ``right`` is read several times: it should be a written table.
    """
    part = max(1, (right.agg(F.sum("n_left")).first()[0] or 0) // pieces)
    hot = right.filter(F.col("n_left") > part).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.ceil(F.col("n_left") / part).cast("int").alias("_parts"))
    on = None
    for k in keys:
        on = (F.col(k) == F.col(f"_hot_{k}")) if on is None else on & (F.col(k) == F.col(f"_hot_{k}"))
    names = [f"_hot_{k}" for k in keys]
    marked = left.join(F.broadcast(hot), on, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(spread, F.col("_parts"))).cast("int")).drop(*names, "_parts")
    copies = F.when(F.col("n_left") > part, F.ceil(F.col("n_left") / part).cast("int")).otherwise(1)
    copied = right.withColumn("_part", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n_left")
    return marked.join(copied, [*keys, "_part"], how).drop("_part")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_row(df: DataFrame) -> Column:
    """All columns of a table as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def row_columns(df: DataFrame, **instead: Column) -> list[Column]:
    """The columns of a table packed by ``as_row``, some of them replaced."""
    return [instead.get(c, F.col("row")[c]).alias(c) for c in df.columns]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, salt: Column, slices: int = 64) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 within ``keys``, in no single task.

    Each key is cut by ``salt`` into ``slices`` slices that are ranked apart; the
    counts of the slices before (at most slices rows for each key) are added.  Within
    a slice rows follow ``order``.  ``df`` must be stable under recomputation.
    """
    cut = df.withColumn("_slice", F.pmod(salt, F.lit(slices)).cast("int"))
    counts = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)) - 1)
    return local.join(starts, [*keys, "_slice"]).withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_slice", "_start", "_local")
