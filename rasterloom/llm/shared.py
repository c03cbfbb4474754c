"""Shared-folder helpers: every intermediate result that cuts lineage goes here.

The folder is the one the session names in ``spark.checkpoint.dir``; only where
that is unset (tests, notebooks) a temporary folder of this machine is used.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.shipping import ship

_SEEN: dict[str, str] = {}
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        base = _SEEN.get(app) or "file://" + tempfile.mkdtemp(prefix="rasterloom-")
    if app not in _SEEN:
        _SEEN[app] = base
        atexit.register(_remove, spark, f"{base.rstrip('/')}/rasterloom-{app}")
    return f"{base.rstrip('/')}/rasterloom-{app}"


def _remove(spark: SparkSession, path: str) -> None:
    """Best-effort removal of this application's folder when the driver ends."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the gateway may be gone already
        pass


#: Rows and bytes of an Arrow batch: texts are long, and both sides hold whole batches.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small, for this and later jobs, whose workers get the package."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _number(text: str) -> int:
    """A setting's bytes: digits and perhaps a unit of Spark's (b, k, m, g, t or p, with or without b)."""
    digits, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", text.lower()).groups()
    return int(digits) << (10 * (" kmgtp".index(unit) if unit else 0))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underlines added until no column of ``df`` has it in any case."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(ids: DataFrame, most_bytes: int, row_bytes: int = 32) -> DataFrame:
    """``ids``, marked for broadcast if its rows, counted first, hold ``most_bytes`` at most."""
    return F.broadcast(ids) if ids.count() * row_bytes <= most_bytes else ids


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later stages then depend on committed files only, so a lost executor never
    makes Spark repeat the work above this point.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")  # once written, the job's shuffle files serve nobody
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete materialised tables that no later result reads."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for df in frames:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/rasterloom-" in f:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(conf).delete(path, True)
