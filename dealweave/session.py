"""Session helpers: settings every operator relies on, and the checkpoint folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Timestamps in the data model are naive; pinning the zone keeps every engine on the same clock.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text scoring is CPU-bound: small shuffles keep several tasks. Large ones are not affected,
    # their partitions are far above this floor.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "dealweave") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate data that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    A session on one machine may do without and gets a temporary folder; on a cluster executors
    don't see each other's disks, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    chosen = sc._jsc.sc().getCheckpointDir()
    if not folder and chosen.isDefined():
        folder = chosen.get()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if chosen.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; Spark removes the files with the
    DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_finished(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark removes shuffle files and checkpoints of finished steps, and gives memory back,
    only after their handles are collected, which a driver with heap to spare puts off. For use between steps of a long job."""
    gc.collect()  # handles in Python keep those of the JVM
    spark._jvm.System.gc()


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """Make expensive columns a boundary the optimizer keeps.

    A filter on a computed column is normally pushed below the projection by repeating the
    column's whole expression, which multiplies long regular-expression chains. Passing the values
    through a one-element generator stops that: they are evaluated once per row.
    """
    keep = [c for c in df.columns if c not in names]
    packed = df.select(*keep, F.explode(F.array(F.struct(*names))).alias("_once"))
    return packed.select(*keep, *[F.col(f"_once.{n}").alias(n) for n in names])


def once_per_content(df: DataFrame, inputs, derive) -> DataFrame:
    """Add the columns that ``derive`` makes of ``inputs`` alone; it sees each distinct content once, however many rows have it.

    Contents meet by a digest of their JSON form, in which a null is left out and so differs from every value."""
    named = df.withColumn("_cid", F.sha2(F.to_json(F.struct(*inputs)), 256))
    contents = named.select("_cid", *inputs).distinct()
    return named.join(derive(contents).drop(*inputs), "_cid").drop("_cid")
