"""Session helpers.

Library code never creates its own session; it receives one.  ``local_session``
is for tests, benches and the examples.  ``checkpoint_dir`` reads the cluster's
``spark.checkpoint.dir`` and only falls back to a scratch folder when it is unset
(local runs); jobs that cut lineage write there, never to an executor-local path.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between the JVM and a Python worker, unless the session names another number.
BATCH_BYTES = 4 << 20
_PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
_shipped: dict[str, str] = {}
_scratch: list[str] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "parlance") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("PARLANCE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``parlance`` importable in the Python workers of every executor.

    Arrow/pandas functions are pickled by reference to this package, so workers
    must import it.  The package is zipped once per driver process and added with
    ``addPyFile`` (the same as ``--py-files`` on a cluster)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="parlance-pkg-"), "parlance.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(_PACKAGE_DIR):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("parlance", os.path.relpath(full, _PACKAGE_DIR)))
    spark.sparkContext.addPyFile(out)
    _shipped[app] = out


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` bytes, for jobs over texts (by default 64 MB).
    A number that the session names stays."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one set with ``setCheckpointDir``, else the
    one ``spark.checkpoint.dir`` names.  Only a local session gets a folder of its
    own if neither is set; on a cluster that is an error, since other machines
    could not read it."""
    sc = spark.sparkContext
    own, named = sc.getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="parlance-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, below the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def scratch_mark() -> int:
    """How many folders ``scratch_path`` has handed out and not deleted yet."""
    return len(_scratch)


def drop_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the folders ``scratch_path`` has handed out since ``scratch_mark`` gave ``since`` (default:
    all of them); call it once the results that read them are stored.
    (Checkpoints go when Spark forgets them: ``spark.cleaner.referenceTracking.cleanCheckpoints``.)"""
    path_of, conf, n = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while len(_scratch) > since:
        path = path_of(_scratch.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)
