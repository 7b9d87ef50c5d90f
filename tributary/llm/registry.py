"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.audit import ORACLE as AUDIT_SQL
from tributary.llm.common import short_batches, written
from tributary.llm.licenses import ORACLE as LICENSE_SQL
from tributary.llm.linededup import ORACLE as LINE_DEDUP_SQL
from tributary.llm.topk import ORACLE as TOPK_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op3_line_dedup": LINE_DEDUP_SQL, "op1_nra_topk": TOPK_SQL, "op11_license_rules": LICENSE_SQL, "op12_filter_audit": AUDIT_SQL}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the public vocabulary file lies on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import topk

    vectors = written(topk.scaled(table(spark, sf_dir, "embeddings"), 256.0))
    return topk.search(vectors, vectors.where("id % 50 = 0"), k=5)


@query
def op2_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = toxicity.fold(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import linededup

    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_copies", "n_near", F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


@query
def op4_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import ann

    vectors = written(ann.usable(table(spark, sf_dir, "embeddings")))
    return ann.search(vectors, vectors.where("id % 50 = 0"), k=5)


@query
def op5_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import classlm
    from tributary.llm.toxicity import fold

    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = classlm.score(docs, ~held_out, whole=True)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import quality
    from tributary.llm.toxicity import fold

    held_out = fold(F.col("doc_id"), 5) == 0
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import bpe

    path = vocabulary("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    from tributary.llm import packing

    cut = packing.pieces(docs, vocabulary("word_bpe_49k.json"), capacity=2048)
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"))
    return packing.pack(slim, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import langid

    model = langid.fit(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), model, "page_id", "html", url_col="url", is_html=True)


@query
def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import licenses

    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import audit

    return audit.order_steps(audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth id, by its checksum, the text's words from a place on repeat a few of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    bound = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.lit(""))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, bound).otherwise(text).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.llm import runs

    found = runs.periodic_runs(with_tails(table(spark, sf_dir, "documents")))
    most = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.array_join(lines, "").alias("lines"), "collapsed")
    return told.select(
        "doc_id", "n_runs", "most.start", "most.length", "most.period", F.floor(1000 * F.col("most.length") / F.col("most.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
