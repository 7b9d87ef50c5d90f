"""Corpus preparation in stages over `documents`: toxicity, language, lines, near-duplicates, packing.

A stage takes the documents that its predecessor kept and returns those it keeps, all columns by their places, whatever
their names. Its result is to be written before the next stage begins, which takes away what the stage had written for itself.
All stages: a null text counts as empty; an empty table gives an empty one; whole texts are read, however long.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import langid, linededup, neardup, toxicity
from tributary.llm.common import discard_all, short_batches, tables, told_apart, without, written
from tributary.llm.registry import packed_documents

TOXIC = 0.7
SURE = 0.5
_LEFT: list[str] = []


def stage(f):
    """f, beginning with taking away what earlier stages wrote for themselves and docs doesn't read."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        discard_all(spark, _LEFT, docs)
        before = set(tables())
        out = f(spark, docs, sf_dir)
        _LEFT[:] = [t for t in tables() if t in _LEFT or t not in before]
        return out

    return run_stage


def by_place(docs: DataFrame) -> DataFrame:
    """docs with its columns named by place."""
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> Column:
    """The column of by_place(docs) that docs has under exactly this name."""
    return F.col(f"_c{docs.columns.index(name)}")


def hashes(*columns: Column) -> list[Column]:
    """Two 64-bit hashes, _h1 and _h2, that together tell rows apart; null is a value like others."""
    parts = [x for c in columns for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))]
    return [F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit("second"), *parts).alias("_h2")]


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows of by_place(docs) under the names of docs."""
    return rows.select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; learned from the labels of the documents at hand.

    Repeated rows get one score and stay or go together; rows without id are judged like all others.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = by_place(toxicity.score(docs, model, whole_rows=True))
    return back(scored.where(F.col(f"_c{len(docs.columns)}") < TOXIC), docs)


@stage
def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters, fit some language and have one of at least SURE posterior.

    The column lang teaches the trigram models and stands for the declared language, source for the host. Rows that are
    alike in id, text, lang and source stay or go together; rows without id are judged like all others.
    """
    told_by = [place(docs, n) for n in ("doc_id", "text", "lang", "source")]
    rows = by_place(docs).select("*", *hashes(*told_by))
    slim = rows.select(F.struct("_h1", "_h2").alias("key"), *[c.alias(n) for c, n in zip(told_by, ("doc_id", "text", "lang", "source"))])
    told = langid.identify(slim, langid.fit(slim), "key", "text", host_col="source", declared_col="lang")
    bad = told.where(~F.col("letters") | ~F.col("fits") | (F.coalesce("posterior", F.lit(0.0)) < SURE))
    return back(without(rows, written(bad.select("key._h1", "key._h2")), ["_h1", "_h2"]), docs)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """One row of those with equal doc_id, null ids being equal, and equal text."""
    rows = by_place(docs).select("*", *hashes(place(docs, "doc_id"), place(docs, "text")))
    groups = written(rows.groupBy("_h1", "_h2").count().where("count > 1").select("_h1", "_h2"))
    if groups.isEmpty():
        return docs
    flagged = told_apart(rows, "_h1", groups.select("_h1"))
    once = flagged.where("NOT _maybe").unionByName(flagged.where("_maybe").dropDuplicates(["_h1", "_h2"]))
    return back(once, docs)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, n_chars counted anew; one that loses all its lines goes.

    Line dedup takes rows of equal id and text for one document, so only one of these goes in; null ids come last. An
    empty or null text has no lines to lose and stays.
    """
    docs = drop_repeats(docs)
    n, text, chars = len(docs.columns), docs.columns.index("text"), docs.columns.index("n_chars")
    out = by_place(linededup.dedup(docs))
    n_lines, n_copies, n_near, kept = (F.col(f"_c{n + i}") for i in range(4))
    out = out.where(~((n_lines > 0) & (n_lines == n_copies + n_near)))
    return out.withColumn(f"_c{chars}", F.length(kept).cast("long")).withColumn(f"_c{text}", kept).select(*[f"_c{i}" for i in range(n)]).toDF(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of least doc_id: five-word shingles, similarity of 0.8 or more.

    A copy with one changed word in every ten or so shares too few five-word shingles and stays: the stage is for copies and
    close ones. Rows, not ids, are classed: an id's texts can be of several classes, and rows without id, which come last,
    are of one too. Texts without words are near nothing, so of these only rows of equal id and text count as copies.
    """
    docs = drop_repeats(docs)
    rows = by_place(docs).select("*", *hashes(place(docs, "doc_id"), place(docs, "text")))
    doc_id, text = place(docs, "doc_id").alias("doc_id"), place(docs, "text").alias("text")
    keys = written(rows.select("_h1", "_h2", doc_id))
    if keys.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        key, keyed = "doc_id", rows.withColumn("doc_id", doc_id)
    else:  # equal or null ids: rows are numbered
        key, keyed = "_id", written(rows.withColumn("_id", F.monotonically_increasing_id()))
        keys = written(keyed.select("_id", "_h1", "_h2", doc_id))
    classes = written(neardup.near_duplicates(keyed.select(key, text), width=5, percent=80, id_col=key).select(F.col("doc_id").alias(key), "component_id"))
    shared = classes.groupBy("component_id").count().where("count > 1").select("component_id")
    members = written(classes.join(shared, "component_id", "left_semi").join(keys, key))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("key"))).alias("first"))
    bad = written(members.join(first, "component_id").where(F.col(key) != F.col("first.key")).select("_h1", "_h2"))
    return back(without(keyed, bad, ["_h1", "_h2"]), docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, placed in sequences of at most 2048 tokens.

    Repeated rows and rows without id are packed like all others; an empty text is its end token alone. Columns besides
    doc_id and text aren't read.
    """
    return packed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("packing", pack)]
ORACLE_SQL = None  # classifiers and packing have no SQL form; tests compare the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES:
        docs = written(f(spark, docs, sf_dir))
    discard_all(spark, _LEFT, docs)
    return docs
