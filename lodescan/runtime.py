"""Session set-up, table reading and the few things every operator shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PACKAGE = Path(__file__).resolve().parent


def session(app: str = "lodescan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per Spark context.

    Workers started by a cluster manager need not share the driver's import path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lodescan_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="lodescan-")) / "lodescan.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
    sc.addPyFile(str(target))
    sc._lodescan_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the shared folder named in ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a local folder is set; a cluster must name one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="lodescan-checkpoint-"))
    return df.checkpoint(eager)


def table_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """Mark a side for broadcasting only if its estimated size is under ``limit``."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def counted(df: DataFrame, most_rows: int = 200_000) -> Callable[[DataFrame], DataFrame]:
    """Marks sides with at most as many rows as ``df`` for broadcasting if ``df``, best a written one, has no more than ``most_rows``."""
    few = df.limit(most_rows + 1).count() <= most_rows
    return lambda side: F.broadcast(side) if few else side


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over all cores before costly work on each row, if the input is too small to be read by all of them.

    A larger input is left as it is read. With columns, rows that agree in them stay together, and the number of
    partitions is kept, so that a following aggregation by them needs no further exchange: one per 8 MB, at least
    two per core, at most as many as shuffles have.
    """
    spark = df.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, table_bytes(df)
    if columns:
        most = max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return df.repartition(min(max(2 * cores, size >> 23), most), *columns)
    few = size < cores * (16 << 20) and len(df.inputFiles()) < cores
    return df.repartition(2 * cores) if few else df


def total_order(df: DataFrame, columns: list[str]) -> Column:
    """A number that tells rows with different contents apart, whatever the types of their columns."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(f"`{c}`") for c in columns])


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the one with the greatest ``order`` values, of tied ones always the same.

    Repeated deliveries of a row thereby count once. Rows whose key is null form one group of their own like any other
    key. One exchange by the key and one sort; rows that cannot be a key's last are left out before the exchange.
    """
    by = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order], total_order(df, [c for c in df.columns if c not in keys]).desc())
    return df.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
