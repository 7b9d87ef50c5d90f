"""What the operators of this subpackage share: column picking, durable intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key bitmap: 8 MB, in rows of 32,768 bits.
BITMAP_BITS = 1 << 26


#: Rows of an Arrow batch: texts can be long, and a batch is held at once by the executor and by its Python worker.
BATCH_ROWS = 500


def short_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df, also where other columns repeat a name or differ from it in case only.

    Of several columns with exactly the same name the first counts.
    """
    have = list(df.columns)
    flat = df.toDF(*[f"_{i}" for i in range(len(have))])
    return flat.select(*[F.col(f"_{have.index(n)}").alias(n) for n in names])


def in_parts(batch: pa.RecordBatch, most_bytes: int = 1 << 21, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes, one row at least, so that few long texts are Python objects at once."""
    rows = max(1, min(most_rows, most_bytes * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        if part.num_rows > 1 and part.nbytes > 4 * most_bytes:  # long texts that stand together
            yield from in_parts(part, most_bytes, max(1, part.num_rows // 2))
        else:
            yield part


def tidy() -> None:
    """At a task's end: gives what the Arrow pool holds in reserve back, as workers are used again."""
    pa.default_memory_pool().release_unused()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, local mode (one machine, as in tests) gets a folder of its own; a cluster raises an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tributary-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Tables that written() made and nothing has taken away yet.
_TABLES: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no upstream work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tributary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Takes away tables of written() that nothing reads any more."""
    for df in tables:
        name = next(iter(df.inputFiles()), "").rpartition("/")[0].rpartition("/")[2]
        for path in [p for p in _TABLES if name and p.endswith(f"/{name}")]:
            _remove(df.sparkSession, path)


def tables() -> list[str]:
    """The paths of tables that written() made and nothing has taken away yet."""
    return list(_TABLES)


def discard_all(spark: SparkSession, paths: list[str], docs: DataFrame) -> None:
    """Takes away those of the tables that docs doesn't read."""
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in docs.inputFiles()} if paths else set()
    for path in paths:
        if path in _TABLES and path.rpartition("/")[2] not in read:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    _TABLES.remove(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows without most of those whose long `key` isn't among keys' (one column, no nulls); none that is gets lost."""
    return told_apart(rows, key, keys).where("_maybe").drop("_maybe")


def told_apart(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with boolean _maybe: false only where the long `key` isn't among keys' (one column, no nulls)."""

    def slot(name: str) -> list[Column]:
        at = F.pmod(F.col(name), F.lit(BITMAP_BITS))
        return [F.shiftright(at, 15).cast("int").alias("_row"), at.bitwiseAND(32767).cast("int").alias("_bit")]

    bits = keys.select(*slot(keys.columns[0])).groupBy("_row").agg(F.bitmap_construct_agg(F.col("_bit")).alias("_bitmap"))
    met = rows.select("*", *slot(key)).join(F.broadcast(bits), "_row", "left")  # at most BITMAP_BITS / 8 bytes
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, F.col("_bit").bitwiseAND(7)) == 1, F.lit(False))
    return met.select(*rows.columns, bit.alias("_maybe"))


def without(rows: DataFrame, bad: DataFrame, key: list[str]) -> DataFrame:
    """rows whose `key` columns (long, no nulls) aren't among those of bad, a written table.

    Only rows whose first key may be among bad's are shuffled.
    """
    flagged = told_apart(rows, key[0], bad.select(key[0]))
    doubtful = flagged.where("_maybe").join(bad.select(*key).distinct().hint("merge"), key, "left_anti")
    return flagged.where("NOT _maybe").drop("_maybe").unionByName(doubtful.select(*rows.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component being the least node.

    Alternating large-star and small-star rounds; every round is grouped minima and equi-joins, so a hub's edges are
    pre-aggregated before the shuffle and its join partition can be split. Ends when a round changes nothing.
    Null ends and loops are ignored; an empty input gives an empty table.
    """
    e = written(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        # large star: the greater neighbours of a node move to its least neighbour (itself included)
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        # small star: a node and its lesser neighbours move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        e = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
