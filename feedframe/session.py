"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A repeated key in one JSON object: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Keyed state of the streaming stop rules.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

#: Bytes of a batch of rows that goes to a Python task, about; Spark's own limit is 64 MB and 10,000 rows.
BATCH_BYTES = 4 << 20

#: Bytes of rows in memory for a byte of their file, about.
ROWS_TO_FILES = 16.0

#: Writer options for very many files: tasks move what they wrote into place, not the driver.
#: Where the folder is a local one, they write without a checksum file beside each and without
#: a process started for the permissions of each, which take far longer than a small file;
#: on any other file system these options say nothing.
MANY_FILES = {
    "mapreduce.fileoutputcommitter.algorithm.version": "2",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def build_session(app_name: str = "feedframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` adds or overrides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster shares (``spark.checkpoint.dir``).

    Where that setting is missing, a session in one process works in a temporary folder; on
    a cluster that would be another folder on each machine, so it is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="feedframe-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/feedframe/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Have the session send rows to Python tasks in batches of about ``BATCH_BYTES``.

    Whole texts make batches of tens of MB otherwise, which executor and Python worker each
    hold more than once. A limit that was set for the session stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's own
        spark.conf.set(name, str(BATCH_BYTES))


def size_by_rows(spark: SparkSession) -> None:
    """Have the session take stored tables for about as large as their rows, not as their files.

    Spark decides on a broadcast by the bytes of the files, of the columns read. Rows with the
    name of a run and a few numbers take some 5 bytes in a Parquet file and 100 in a broadcast,
    which the driver holds. What is small by its rows is still found so while the query runs.
    A factor that was set for the session stays.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1.0:  # Spark's own
        spark.conf.set(name, str(ROWS_TO_FILES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    For tables that several later steps read: the parse behind them runs once, and a
    lost executor costs a re-read, not a re-parse.
    """
    bound_batches(df.sparkSession)
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def release(*stored: DataFrame | None) -> None:
    """Delete the files of tables that ``materialize`` wrote.

    Only for tables that nothing still to be computed reads: all that came of them has been
    written or collected.
    """
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
