"""Tables written to the folder that driver and executors share, and a helper for native expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary folder, in local mode only."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not (conf.get("spark.master", None) or "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="emberlake-"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside hand whole texts to Python in batches of so many rows at most, which bounds an executor's memory; the session is then as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Tables written since each ``scratch`` that is open began.
_scratches: list[list[DataFrame]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs restart from the files, not from the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    for tables in _scratches:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that marks a table made by ``cut`` as one to keep; all others made inside are deleted at the end."""
    tables, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._shared_path)
        return df

    _scratches.append(tables)
    try:
        yield keep
    finally:
        _scratches.remove(tables)
        drop(*(t for t in tables if t._shared_path not in kept))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows: int, per_task: int = 20_000) -> DataFrame:
    """``df`` in as few tasks as ``rows`` rows need; never more than it has."""
    return df.coalesce(max(1, -(-rows // per_task)))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches that Spark hands over (it bounds their bytes) in pieces of so many rows at most."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


#: Bits of the filter that keeps rows without a partner out of a shuffle; 2 MB at most.
MARK_BITS = 1 << 22


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds _marked to rows with a _key: false if it surely is not among the ``keys`` (_key). A fixed number of bits is broadcast; more keys mark more rows."""
    bit = F.pmod(F.xxhash64("_key"), F.lit(MARK_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    marks = keys.select(F.floor(bit / 64).alias("_slot"), one.alias("_one")).groupBy("_slot").agg(F.bit_or("_one").alias("_bits"))
    found = F.call_function("shiftright", F.col("_bits"), (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(marks), F.floor(bit / 64) == F.col("_slot"), "left").withColumn("_marked", F.coalesce(found, F.lit(False))).drop("_slot", "_bits")


def own_names(df: DataFrame, *names: str) -> dict[str, str]:
    """A column name for each of ``names`` that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        own = f"_own_{name}"
        while own in taken:
            own = f"_{own}"
        out[name] = own
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once, however often and in whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)
