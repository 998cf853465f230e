"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    master = f"local[{cpus}]" if cpus else "local[*]"
    return (
        SparkSession.builder.master(master)
        .appName("loomlink")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it.

    Where neither the context nor ``spark.checkpoint.dir`` names one, a session on one machine takes a folder
    under the temporary directory; on a cluster that is an error, as its parts would lie on different machines.
    Files of checkpoints that no DataFrame refers to any more are removed, unless the session forbids it.
    """
    context = spark.sparkContext
    context._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "loomlink-checkpoints")
    context.setCheckpointDir(named)
    return named


_MOST_BYTES = 1 << 50


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder, its lineage cut.

    A checkpoint keeps the optimizer's guess of its size. The guess for a join is the product of its sides, so over many
    steps it becomes a number so long that planning hardly ends; a guess beyond any sense is dropped here.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() <= _MOST_BYTES:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), done._jdf.schema(), False), spark)
