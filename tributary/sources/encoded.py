"""Vectors of texts kept by id and content: only what is new or changed goes to the encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
SCHEMA = "item_id {id}, text_sha256 string, embedding array<float>"


def stored(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The table at path, empty if there is none yet. A table of other columns or types is an error."""
    schema = SCHEMA.format(id=id_type)
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        # no folder yet, or one that a failed first write left empty
        if not (e.getCondition() or "").startswith(("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return spark.createDataFrame([], schema)
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    wanted = {"item_id": id_type.replace("long", "bigint"), "text_sha256": "string", "embedding": "array<float>"}
    if kinds != wanted:
        raise ValueError(f"{path} holds {kinds}, not {wanted}")
    return found


def encode(texts: DataFrame, encoder: Encoder, dims: int) -> DataFrame:
    """texts (item_id, text_sha256, text) with the encoder's vectors in place of text, an Arrow batch a call.

    A reply of another shape is an error, so nothing half right is stored.
    """
    kind = texts.schema["item_id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.asarray(encoder(batch.column("text").to_pylist()), dtype=np.float32)
            if vectors.shape != (batch.num_rows, dims):
                raise ValueError(f"the encoder gave {vectors.shape} for {batch.num_rows} texts of {dims} dimensions")
            rows = pa.FixedSizeListArray.from_arrays(pa.array(vectors.reshape(-1)), dims).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text_sha256"), rows], names=["item_id", "text_sha256", "embedding"])

    return texts.select("item_id", "text_sha256", "text").mapInArrow(go, SCHEMA.format(id=kind))


def keyed(texts: DataFrame) -> DataFrame:
    """texts (item_id, text) with text_sha256; a null text counts as empty, an item without id is left out."""
    text = F.coalesce("text", F.lit(""))
    return texts.where("item_id IS NOT NULL").select("item_id", text.alias("text"), F.sha2(text, 256).alias("text_sha256"))


def missing(texts: DataFrame, table: DataFrame) -> DataFrame:
    """Once each, the (item_id, text_sha256, text) that the table has no vector for."""
    return keyed(texts).join(table.select("item_id", "text_sha256"), ["item_id", "text_sha256"], "left_anti").dropDuplicates(["item_id", "text_sha256"])


def read_or_build(texts: DataFrame, path: str, encoder: Encoder, dims: int) -> DataFrame:
    """Rows (item_id, text_sha256, embedding), one for each different (item_id, text) of texts, from the table at path.

    What the table lacks is encoded and appended first; nothing is overwritten, and vectors of older texts stay. A run that
    fails leaves no half-written part, as Spark commits all files of an append at once; the next run encodes what is missing.
    """
    spark = texts.sparkSession
    kind = texts.schema["item_id"].dataType.simpleString()
    new = missing(texts, stored(spark, path, kind.replace("bigint", "long")))
    encode(new, encoder, dims).write.mode("append").parquet(path)
    held = spark.read.schema(SCHEMA.format(id=kind)).parquet(path)
    wanted = keyed(texts).select("item_id", "text_sha256").distinct()
    return held.join(wanted, ["item_id", "text_sha256"], "left_semi").dropDuplicates(["item_id", "text_sha256"])
