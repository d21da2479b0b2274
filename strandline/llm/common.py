"""Shared-folder tables and batch helpers used by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where that is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes of an Arrow batch between the JVM and Python: texts are long, and a task holds its batch on both sides.
ARROW_BYTES = 8 << 20
SPARKS_ARROW_BYTES = "67108864b"


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with batches bounded by bytes, unless the session has a bound of its own."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key, SPARKS_ARROW_BYTES) == SPARKS_ARROW_BYTES:
        conf.set(key, f"{ARROW_BYTES}b")
    return df.mapInArrow(run, schema)


class Scratch:
    """Written tables of one operator run, in the shared folder; what is left of them goes when Spark ends.

    Spark shuffle files are freed when each write ends, so an operator's disk need is its largest step.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    @contextlib.contextmanager
    def _freeing_shuffles(self):
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes df as Parquet and rereads it: cuts lineage and outlives any executor."""
        path = self.path(name)
        with self._freeing_shuffles():
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strandline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._strandline_path)
            path.getFileSystem(conf).delete(path, True)


def hashed_share(key: Column, wanted: int, n: int) -> Column:
    """Whether a row, by a hash of key, is among an expected number of `wanted` of n rows; all are where n is no larger."""
    most = (1 << 63) - 1
    return F.shiftrightunsigned(key, 1) <= F.lit(most if n <= wanted else most * wanted // n)


def broadcast_small(df: DataFrame, most: int, width: int = 64) -> DataFrame:
    """df, marked for broadcast where its rows, arrays of any length counted in full, take `most` bytes at most."""
    lists = [F.coalesce(F.greatest(F.size(f.name), F.lit(0)), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "array"]
    size = df.agg(F.sum(sum((16 * n for n in lists), F.lit(width))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= most else df


def perhaps_in(df: DataFrame, key: str, ids: DataFrame, most: int) -> DataFrame:
    """df with `perhaps`: false where key is surely not among ids (id), so that only other rows need be shuffled.

    A bitmap of the ids' hashes, of `most` bytes at most and 16 bits an id while that allows it, is broadcast by words.
    """
    n = ids.count()
    bits = max(64, min(4 * most, 1 << (16 * n).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), {bits}) & 63 as int))")
    words = ids.groupBy(F.shiftright(spot("id"), 6).alias("_word")).agg(F.bit_or(bit("id")).alias("_bits"))
    found = df.join(F.broadcast(words), F.shiftright(spot(key), 6) == F.col("_word"), "left")
    return found.withColumn("perhaps", F.coalesce(F.col("_bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("_word", "_bits")


def crc32_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each part has few rows and few text bytes; one longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size):
            if i > start and (i - start >= rows or total + n > chars):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[memoryview, list[int]]:
    """UTF-8 bytes of a string column as one buffer, with offsets (nulls are empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = pa.concat_arrays([column])
    offsets = memoryview(column.buffers()[1]).cast("q")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return memoryview(data if data is not None else b""), list(offsets)
