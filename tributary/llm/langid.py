"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior: the text's likelihood under byte-trigram models, the language its markup
declares, the suffix of its address, and a prior of its host. A first pass gives every page the posterior of its text
alone. Grouped sums of these posteriors then estimate, over all pages, how often each language goes with each declared
value and each suffix, and the priors: a host's prior is smoothed towards its suffix's, that towards the whole table's.
The second pass multiplies the evidence.

The trigram models are fitted on a bounded sample of labelled texts (`sample` of each language, by hash of the id).
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import in_parts, pick, tidy, written

SAMPLE = 500
GRAMS = 1 << 16
#: A text's trigrams overlap and repeat, so its log likelihood counts at this rate, and by this much at most.
RATE, MOST = 0.25, 12.0
_SKIP = regex.compile(r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>")
_TAG = regex.compile(r"(?s)<[^>]*>")
_LANG = regex.compile(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b""")
_META = regex.compile(r"""(?i)<meta\b[^>]*?content-language["']?\s+content\s*=\s*["']?\s*([a-z]{2,3})\b""")
_NO_LETTER = regex.compile(r"[^\p{L}]+")


def page_parts(page: str | None) -> tuple[str, str | None]:
    """(visible text, declared language or None) of raw HTML; text that isn't HTML is its own visible text."""
    if not page:
        return "", None
    found = _LANG.search(page) or _META.search(page)
    return html.unescape(_TAG.sub(" ", _SKIP.sub(" ", page))), found.group(1).lower() if found else None


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the lower-cased letters of a text, words set apart by spaces, and how often each occurs."""
    letters = _NO_LETTER.sub(" ", text or "").lower().strip()
    if not letters:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    codes = ((b[:-2] * 256 + b[1:-1]) * 256 + b[2:]) * 0x9E3779B1 % (1 << 32) >> 16
    return np.unique(codes, return_counts=True)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # languages x GRAMS

    def evidence(self, text: str | None) -> tuple[np.ndarray, bool]:
        """Tempered log likelihoods, zero at the best language, all zero without letters; and whether the text fits one.

        A text fits if its trigrams are likelier in its best language than if all trigrams were equally likely.
        """
        grams, times = gram_counts(text)
        if not len(grams):
            return np.zeros(len(self.languages)), False
        weight = np.log1p(times)
        total = (self.logs[:, grams] * weight).sum(axis=1)
        fits = bool(total.max() > -np.log(GRAMS) * weight.sum())
        return np.maximum((total - total.max()) * RATE, -MOST), fits


def fit(texts: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram models of all languages that a text is labelled with; a language's model takes half a megabyte."""
    rows = pick(texts, id_col, text_col, lang_col).toDF("id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL AND id IS NOT NULL").withColumn("lang", F.lower(F.col("lang").cast("string")))
    common = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in common)
    if not languages:
        return Model([], np.zeros((0, GRAMS)))
    counts = {r["lang"]: r["count"] for r in common}
    # an even share by hash, about `sample` of each language, read in one pass
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1_000_000))
    limit = F.element_at(F.create_map(*[x for n in languages for x in (F.lit(n), F.lit(int(1_000_000 * min(1.0, sample / counts[n]))))]), F.col("lang"))
    chosen = rows.where(F.col("lang").isin(languages)).where(draw < limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), GRAMS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, times = gram_counts(text)
                total[languages.index(lang), grams] += times
        at, grams = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at * GRAMS + grams), pa.array(total[at, grams])], names=["place", "n"])

    summed = chosen.select("text", "lang").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(len(languages) * GRAMS, 0.1)
    table[summed.column("place").to_numpy()] += summed.column("n").to_numpy()
    table = table.reshape(len(languages), GRAMS)
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def address_parts(url) -> tuple:
    """Columns (host, suffix) of an address: the host in lower case without www., and what follows its last dot."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), r"^www\.", "")
    return host, F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)


def _texts_scored(rows: DataFrame, model: Model, is_html: bool) -> DataFrame:
    """rows (row.., host, suffix, declared, body) with evidence array<double>, letters boolean and the declared language."""
    names = [c for c in rows.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch):
                said, evidence, letters, fits = part.column("declared").to_pylist(), [], [], []
                for i, body in enumerate(part.column("body").to_pylist()):
                    if is_html:
                        body, found = page_parts(body)
                        said[i] = found or said[i]
                    logs, fit_one = model.evidence(body)
                    evidence.append(logs)
                    fits.append(fit_one)
                    letters.append(regex.search(r"\p{L}", body or "") is not None)
                kept = [pa.array(said, pa.string()) if c == "declared" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(evidence, pa.list_(pa.float64())), pa.array(letters), pa.array(fits)], names=[*names, "evidence", "letters", "fits"])
        tidy()

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, evidence array<double>, letters boolean, fits boolean")


def _normal(logs):
    """A softmax over an array column of logs."""
    shares = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shares, lambda x: x / F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))


def identify(
    rows: DataFrame, model: Model, id_col: str, body_col: str, url_col: str | None = None, host_col: str | None = None, declared_col: str | None = None, is_html: bool = False, strength: float = 20.0
) -> DataFrame:
    """Rows (id, lang, posterior, text_lang, declared, host, letters, fits), one for each input row.

    The host is that of the address, or host_col where there is no address; both may be missing. Null bodies count as empty
    and are told by the other evidence alone. `strength`: with how many pages' weight a prior pulls on the one below it.
    lang is null if the model has no language. Ties go to the language first in the alphabet. Null ids and repeated rows
    pass through. fits: the text's trigrams are likelier in some language than if all were alike; false without letters.
    Whole texts are read, however long; other columns aren't, and an empty table gives an empty one.
    """
    wanted = [id_col, body_col, *[c for c in (url_col, host_col, declared_col) if c]]
    named = pick(rows, *dict.fromkeys(wanted))
    empty = F.lit("")
    host, suffix = address_parts(F.col(url_col).cast("string")) if url_col else (F.coalesce(F.col(host_col).cast("string"), empty) if host_col else empty, empty)
    declared = F.lower(F.col(declared_col).cast("string")) if declared_col else F.lit(None).cast("string")
    slim = named.select(F.col(id_col).alias("id"), host.alias("host"), suffix.alias("suffix"), declared.alias("declared"), F.col(body_col).cast("string").alias("body"))
    kind = slim.schema["id"].dataType.simpleString()
    n = len(model.languages)
    if not n:
        return slim.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", F.coalesce(F.col("body").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.lit(False).alias("fits"))
    known = F.array(*[F.lit(x) for x in model.languages])
    scored = written(_texts_scored(slim, model, is_html).withColumn("p", _normal(F.col("evidence"))).withColumn("said", F.when(F.array_contains(known, F.col("declared")), F.col("declared")).otherwise(F.when(F.col("declared").isNull(), "").otherwise("?"))))

    shares = [F.sum(F.when(F.col("letters"), F.col("p")[i])).alias(f"s{i}") for i in range(n)]
    total = lambda: F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n)])
    hosts = scored.groupBy("host", "suffix").agg(*shares).select("host", "suffix", total().alias("host_n"))
    by_suffix = hosts.groupBy("suffix").agg(*[F.sum(F.col("host_n")[i]).alias(f"s{i}") for i in range(n)]).select("suffix", total().alias("suffix_n"))
    whole = hosts.agg(*[F.sum(F.col("host_n")[i]).alias(f"s{i}") for i in range(n)]).first()
    base = np.array([whole[i] or 0.0 for i in range(n)]) + 1.0
    base /= base.sum()
    # said has at most n + 2 values
    said = {r.said: np.array([r[f"s{i}"] or 0.0 for i in range(n)]) for r in scored.groupBy("said").agg(*shares).collect()}
    per_language = sum(said.values(), np.zeros(n)) + 1.0
    says = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in np.log((v + 1.0 / len(said)) / per_language)]))]) if said else None

    def pulled(counts: str, prior):
        return F.expr(f"transform({counts}, (x, i) -> (x + {strength}D * {prior}[i]) / (aggregate({counts}, 0D, (a, b) -> a + b) + {strength}D))")

    suffix_prior = by_suffix.withColumn("base", F.array(*[F.lit(float(x)) for x in base])).select("suffix", pulled("suffix_n", "base").alias("suffix_p"))
    priors = hosts.join(suffix_prior, "suffix").select("host", "suffix", pulled("host_n", "suffix_p").alias("prior"))
    joined = scored.join(priors, ["host", "suffix"])
    logs = F.zip_with(F.zip_with("evidence", F.col("prior"), lambda a, b: a + F.ln(b)), F.col("says"), lambda a, b: a + b)
    final = joined.withColumn("says", says[F.col("said")] if says is not None else F.array_repeat(F.lit(0.0), n)).withColumn("post", _normal(logs))
    best = lambda c: known[F.array_position(c, F.array_max(c)).cast("int") - 1]
    return final.select(
        F.col("id").cast(kind).alias(id_col), best(F.col("post")).alias("lang"), F.array_max("post").alias("posterior"),
        F.when(F.col("letters"), best(F.col("p"))).alias("text_lang"), "declared", "host", "letters", "fits",
    )
