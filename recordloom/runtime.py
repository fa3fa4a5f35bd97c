"""Session, shared storage and table access used by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recordloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one machine, may fall back to a temporary
    folder; on a cluster a missing setting is an error rather than a silent machine-local path.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        where = tempfile.mkdtemp(prefix="recordloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    where = shared_dir(spark)
    where = where.removeprefix("file://").removeprefix("file:")
    if "://" in where:
        # Spark's own file server hands the driver's copy out; nothing reads this folder but the driver.
        where = tempfile.mkdtemp(prefix="recordloom-")
    Path(where).mkdir(parents=True, exist_ok=True)
    target = f"{where}/recordloom-{uuid.uuid4().hex}.zip"
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


_KEPT: set[str] = set()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Unlike a cached plan the files outlive any executor, and unlike an RDD checkpoint they are
    compressed, column-pruned on re-read and carry a size the planner can use. They go when the driver
    ends, or with ``forget``.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/recordloom-{spark.sparkContext.applicationId}"
    if home not in _KEPT:
        _KEPT.add(home)
        atexit.register(forget, spark)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the tables this application stored; results that still read them cannot be used any more."""
    try:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for home in [h for h in _KEPT if h.endswith(spark.sparkContext.applicationId)]:
            place = spark._jvm.org.apache.hadoop.fs.Path(home)
            place.getFileSystem(hadoop).delete(place, True)
    except Exception:  # noqa: BLE001 - the session may have ended already, and its folder with it
        return


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A test table, reduced to ``columns`` when any are given (column pruning reaches the scan)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def trimmed(c: Column) -> Column:
    """``c`` without surrounding white space of any kind; NULL when nothing is left."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def canonical_id(c: Column) -> Column:
    """One spelling per reference: ``ms_`` + upper case, anything else in lower case, blank -> NULL."""
    t = trimmed(c)
    low = F.lower(t)
    return F.when(low.startswith("ms_"), F.concat(F.lit("ms_"), F.upper(F.substring(t, 4, 1_000_000)))).otherwise(low)


def both_records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Rows of the live and the archived record table with ``ref_table`` naming their origin."""
    parts = [
        table(spark, sf_dir, name, *columns).withColumn("ref_table", F.lit(name))
        for name in ("memory_records", "archive_records")
    ]
    return parts[0].unionByName(parts[1])
