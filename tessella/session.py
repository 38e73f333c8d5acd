"""The Spark session and its settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


#: Rows that go to a Python worker at once. Spark's own number, ten thousand, is meant for narrow rows; of whole texts they
#: are tens of MB, which the executor and its workers each hold several times over.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in small batches, unless the session has a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def session(app: str = "tessella", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; ``settings`` come on top (dots written as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (base | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where all of Spark runs in one process
    is a folder of this machine as good; a cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found
