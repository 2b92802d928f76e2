"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space in the contracts' word pattern [^\x20\x09-\x0D]+.
BLANK = "\x20\x09-\x0d"
#: Bytes of an Arrow batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one (tests) gets a folder of its own; a cluster's must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends rows to Python in batches of BATCH_BYTES at most from now on, or less if it did: 10,000 rows of text are held several times over, by the executor and by its worker."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH_CONF).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the worker gives the memory that it has freed back to the system: it waits for its next task beside the executor, which needs it meanwhile."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return own


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder (in folders ``by`` a column), read again with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes the folders of written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, mod n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n
