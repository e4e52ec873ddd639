"""Helpers shared by the corpus operators: shared scratch tables and table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: [\x20\x09-\x0D]. bytes.split() without arguments splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none (local tests) a temporary folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current.rstrip("/")
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldglass-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the cluster's own housekeeping owns the folder then
        pass


class Scratch:
    """Intermediate tables of one query in the shared folder.

    Writing a table cuts the lineage, survives lost executors, and lets Spark free the shuffle files behind it."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark = spark
        self.path = f"{shared_folder(spark)}/fieldglass-{tag}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_remove, spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Delete the n-th table, once nothing needs it any more."""
        _remove(self.spark, f"{self.path}/{n}")


def free_shuffles(spark: SparkSession) -> None:
    """Ask the JVM to collect dead plans, so that their shuffle files leave the executors' disks."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shared:
    """A broadcast object of this package's classes: it travels by value, so executors need not have the package."""

    def __init__(self, spark: SparkSession, x: object) -> None:
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(x))

    @property
    def value(self):
        """The object, loaded anew by each call: a task asks once."""
        return cloudpickle.loads(self._bytes.value)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in slices, for functions that make Python objects of a batch's texts: a worker holds those of one slice."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))
