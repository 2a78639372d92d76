"""Session helpers: building a local session for tests / bench and locating
the shared checkpoint folder that iterative jobs cut lineage into."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants; sizes are per-run tunables.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # local runs: small advisory size so rebalanced row frames use the cores
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # plans of the fits have hundreds of column steps: no call site is kept for each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # iteration state is checkpointed every step: drop files of dead frames
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "dyadic", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by the cluster (``spark.checkpoint.dir``) or
    already set on the context; ``None`` if neither is set."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint folder.  Only a local-mode session without
    one (tests, bench) gets a fresh scratch folder; on a cluster an unset
    folder is an error, because machine-local folders do not survive the loss
    of an executor."""
    d = checkpoint_dir(spark)
    if d is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative jobs need a shared folder")
        d = tempfile.mkdtemp(prefix="dyadic-ckpt-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package as a zip, once per context, so that they
    find it whatever folder the driver runs in."""
    sc = spark.sparkContext
    if getattr(sc, "_dyadic_shipped", False) or sc.master.startswith("local["):
        return
    import zipfile
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="dyadic-zip-"), "dyadic.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "dyadic")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._dyadic_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    import uuid
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
