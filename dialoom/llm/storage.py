"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def documents_schema() -> list[str]:
    """Columns of ``documents``, in order."""
    return ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of its own only for a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="dialoom-")
    return _LOCAL[app]


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/dialoom-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def stored_by(frame: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Like ``stored``, dealt into one bucket a shuffle partition, so that joins on ``keys`` move only the other side."""
    spark = frame.sparkSession
    ident = f"dialoom_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.format("parquet").option("path", f"{shared_dir(spark)}/{ident}").bucketBy(buckets, *keys).saveAsTable(ident)
    dealt = spark.table(ident)
    spark.sql(f"DROP TABLE {ident}")  # the catalogue's entry alone; the files stay and are read as before
    return dealt


def drop_stored(frame: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and nothing needs any longer."""
    jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in frame.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver's collector find shuffles that no plan refers to any longer, so that executors delete their files."""
    spark._jvm.System.gc()


BATCH_BYTES = 4 << 20  # of an Arrow batch, about, so that long texts make small batches
BATCH_ROWS_NAME, BATCH_BYTES_NAME = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this block, Python workers get at most so many rows, and about BATCH_BYTES, at once; for jobs that run in it."""
    before = {name: spark.conf.get(name) for name in (BATCH_ROWS_NAME, BATCH_BYTES_NAME)}
    spark.conf.set(BATCH_ROWS_NAME, rows)
    spark.conf.set(BATCH_BYTES_NAME, BATCH_BYTES)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
