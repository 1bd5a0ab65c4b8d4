"""Tables written between steps: iterative plans stay short and survive lost executors."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    # Rows of long texts: a batch is held on both sides of the pipe to a worker.
    if not spark.sparkContext.getConf().contains(_BATCH) and spark.conf.get(_BATCH) != f"{BATCH_BYTES}b":
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where none is named and all runs on this machine (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("filigree.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="filigree-")
        spark.conf.set("filigree.shared.dir", named)
    return named.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once and read it back; with ``drop_shuffles`` Spark deletes the write's shuffle files when it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/filigree-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._filigree_path = path
    return out


#: Rows of a kept table that may be broadcast; they are counted, not guessed.
FEW = 100_000


def size(kept: DataFrame) -> int:
    """How many rows a table made by ``keep`` has; counted once."""
    if not hasattr(kept, "_filigree_rows"):
        kept._filigree_rows = kept.count()
    return kept._filigree_rows


def is_few(kept: DataFrame) -> bool:
    return size(kept) <= FEW


def hint(kept: DataFrame) -> DataFrame:
    """A kept table, to be broadcast if its rows are few."""
    return F.broadcast(kept) if is_few(kept) else kept


def forget(df: DataFrame | None) -> None:
    """Delete a table made by ``keep`` that nothing reads any more."""
    path = getattr(df, "_filigree_path", None)
    if path:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def let_go(spark: SparkSession) -> None:
    """Have the driver look for finished steps now: Spark deletes their shuffle files once it has found that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
