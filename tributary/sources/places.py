"""A bulk table of places laid out by city, so that a query about some cities reads their files alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file; a city of more rows has several files, written by several tasks.
FILE_ROWS = 1_000_000
#: So many names of cities may be sent to every task.
MOST_CITIES = 100_000


def write_places(rows: DataFrame, path: str, city: str = "city", key: str = "place_id", file_rows: int = FILE_ROWS, mode: str = "errorifexists") -> None:
    """rows as Parquet by city. With mode "overwrite" only the cities that rows hold are replaced.

    A large city's rows are spread by key over as many tasks as it needs files, small ones share tasks: no task writes a
    file for every city, and no city waits for one task. A null city is a partition of its own.
    """
    sizes = rows.groupBy(city).agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / file_rows).cast("int"))
    spread = rows.join(sizes.drop("_n").withColumnRenamed(city, "_city"), F.col(city).eqNullSafe(F.col("_city")))
    spread = spread.withColumn("_salt", F.pmod(F.xxhash64(key), F.col("_parts")))
    dealt = spread.repartition(city, "_salt").sortWithinPartitions(city, key)
    writer = dealt.drop("_city", "_parts", "_salt").write.option("maxRecordsPerFile", file_rows).option("partitionOverwriteMode", "dynamic")
    writer.mode(mode).partitionBy(city).parquet(path)


def read_places(spark: SparkSession, path: str, cities: DataFrame | None = None, city: str = "city") -> DataFrame:
    """The places, or those of some cities (a table with a column of that name).

    Whatever chooses the cities is found out first and then names the folders to read (dynamic partition pruning).
    """
    rows = spark.read.parquet(path)
    if cities is None:
        return rows
    wanted = cities.select(city).where(F.col(city).isNotNull()).distinct()
    few = wanted.limit(MOST_CITIES + 1).count() <= MOST_CITIES  # else they are joined by shuffling, and pruned by a filter of them
    return rows.join(F.broadcast(wanted) if few else wanted, city)
