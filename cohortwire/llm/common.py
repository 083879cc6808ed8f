"""Shared helpers: the cluster's shared folder, written intermediates, bounded caches, text columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the controls 9 to 13; bytes.split() cuts at exactly these.
ASCII_SPACE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine,
    as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cohortwire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and returns a reader of it: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes what written() stored for df, once no later plan reads it."""
    path = getattr(df, "_written_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of ours and all that is in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def open_stream(path: str):
    """A file system and the path in it, for any address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def bounded_batches(docs: DataFrame, limit_mb: int = 8) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, for texts of any length in little memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(key).rstrip("b")) <= limit_mb << 20:
        conf.set(key, str(limit_mb << 20))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null: empty), and the named further columns; all others are left out, so none can clash."""
    bounded_batches(docs)
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c) for c in keep])


def id_remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Within it, the session has these settings; then it has its own again."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextlib.contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Within it, a query's shuffle files go when the query ends, not when the driver happens to collect garbage.

    For runs that write each intermediate once and read it back, so that no shuffle is read again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class BoundedCache(dict):
    """word -> make(word), emptied when it holds `limit` words, so memory stays bounded on any corpus."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


_WORKER: dict = {}


def per_worker(key, build, keep: int = 3):
    """One object per Python worker process, kept from task to task; the `keep` used last stay."""
    value = _WORKER.pop(key, None)
    if value is None:
        while len(_WORKER) >= keep:
            _WORKER.pop(next(iter(_WORKER)))
        value = build()
    _WORKER[key] = value
    return value


def forget(key) -> None:
    """Drops a per_worker() object that the tasks to come don't need."""
    _WORKER.pop(key, None)
