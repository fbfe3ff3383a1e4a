"""Session helpers: shared checkpoint folder, size-checked broadcast, salted joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows above which a small side is no longer broadcast.
BROADCAST_ROWS = 20_000


def local_session(app: str = "engram", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where none is set a temporary one is made, but only if driver and executors are one process; on a cluster
    such a folder would be lost with its machine, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="engram-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Set the folder of checkpoints to ``shared_dir`` where the session has none yet."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends in files every executor can read again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fill_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores before Python work, where the input has fewer partitions than the session has cores.

    Only an input of a few small files is dealt anew, by ``keys``; any larger one is left as it is read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2, *keys)


def bounded_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table of unknown skew with a smaller one.

    The small side is counted first: up to ``limit`` rows it is broadcast, beyond that it is joined by a
    salted shuffle (4 salts, the small side repeated per salt), so a hot key never meets a single task.
    ``how`` is inner, left, left_semi or left_anti; null keys match nothing.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 4) -> DataFrame:
    """Equi-join in which each key of the big side is spread over ``salts`` tasks.

    The salt is a hash of the row, so a retried task deals its rows as before.
    """
    row = [F.col(f"`{c}`") for c, kind in big.dtypes if "map<" not in kind and "variant" not in kind]
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def norm_key(c: Column) -> Column:
    """A key without surrounding whitespace and letter case; empty becomes null."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(t != "", t)


def stage(df: DataFrame, **exprs: Column) -> DataFrame:
    """Adds columns that are computed once, here.

    ``inline`` of a one-element array is a barrier to the optimizer: expressions above it refer to its
    output and are never substituted into each other, which would grow long chains exponentially.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))
