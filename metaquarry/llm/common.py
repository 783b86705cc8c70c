"""What the operators share: tables in the shared folder, range cuts, and numbering without a single task."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_RUN = uuid.uuid4().hex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="metaquarry-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def new_path(spark: SparkSession, tag: str) -> str:
    top = f"{work_dir(spark)}/metaquarry/{_RUN}"
    if _OWN.get("clean") != top:
        _OWN["clean"] = top
        atexit.register(_clean, spark, top)
    return f"{top}/{tag}-{uuid.uuid4().hex}"


def _clean(spark: SparkSession, top: str) -> None:
    """Deletes what results still read from while the process lives, if its session is still there at the end."""
    try:
        drop(spark, top)
    except Exception:  # noqa: BLE001  the session has ended before
        pass


def stored(df: DataFrame, tag: str, compression: str = "zstd", options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again: lineage ends there, and no executor's loss costs it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**(options or {})).option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later step reads, and lets Spark's cleaner find the shuffle files behind them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    gc.collect()
    jvm.System.gc()


def renamed(columns: list[str], wanted: str) -> str:
    """wanted, or wanted with underscores before it until it clashes with no column (Spark compares without case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def looked_up(rows: DataFrame, by: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the other columns of `by`, whose keys are unique; null keys are equal to each other."""
    names = {k: renamed([*rows.columns, *by.columns], f"{k}_of") for k in keys}
    by = by.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in by.columns if c not in keys])
    on = F.expr(" AND ".join(f"`{k}` <=> `{names[k]}`" for k in keys))
    return rows.join(by, on, how).drop(*names.values())


def cuts(df: DataFrame, key: str, rows_per_range: int, max_ranges: int) -> list[int]:
    """At most max_ranges - 1 ascending values of an integer column that part its rows into ranges of about equal counts. Reads that column alone; max_ranges bounds what the driver holds."""
    slim = df.select(F.col(key).cast("long").alias("k"))
    n = slim.count()
    k = max(1, min(max_ranges, math.ceil(n / rows_per_range)))
    if k == 1:
        return []
    at = slim.where("k is not null").stat.approxQuantile("k", [i / k for i in range(1, k)], 1 / (4 * k))
    return sorted({int(x) for x in at})


def range_of(key: Column, at: list[int]) -> Column:
    """How many cuts lie at or below key (0 for null), by binary search inside one expression."""
    if not at:
        return F.lit(0)
    steps = [1 << i for i in range(len(at).bit_length() - 1, -1, -1)]
    cut, n = F.array(*[F.lit(x).cast("long") for x in at]) if len(at) < 50 else F.from_json(F.lit(str(at)), "array<long>"), len(at)
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when((low + step <= n) & (F.get(cut, low + step - 1) <= key), low + step).otherwise(low),
    )
    return F.coalesce(found, F.lit(0))


def numbered(df: DataFrame, group: str, order: list[str], bucket: Column, into: str) -> DataFrame:
    """Adds `into`: a gapless number from 0 for each row of a group, although a group may hold any share of all rows.

    bucket is an expression that is not null, orders before `order` does, and parts a group's rows evenly; a window
    then only ever holds one bucket, and the buckets' counts (partly summed before their shuffle) give where each
    begins. df must be cheap to read twice, so callers pass a stored table."""
    b, at = renamed(df.columns, "bucket_"), renamed(df.columns, "before_")
    df = df.withColumn(b, bucket)
    sizes = df.groupBy(group, b).agg(F.count("*").alias("n_"))
    w = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn(at, F.coalesce(F.sum("n_").over(w), F.lit(0))).select(group, b, at)
    rows = df.withColumn(into, F.row_number().over(Window.partitionBy(group, b).orderBy(*order)) - 1)
    return looked_up(rows, base, [group, b]).withColumn(into, F.col(into).cast("long") + F.col(at)).drop(b, at)
