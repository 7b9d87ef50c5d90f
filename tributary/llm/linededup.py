"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line, in the order of documents and lines, equals it or lies within one edit (a character
inserted, deleted or replaced). The join: every distinct line that can have a partner emits its own key and the key of
each variant with one character deleted. Two lines within one edit either share a variant with the deletion at the same
place (a replacement), or the key of one is a variant of the other (an insertion). So each group of equal (variant,
place) needs links to its earliest member only, and no pairs within a group; links are verified by edit distance.

Before variants are made, parts are compared: lines within one edit share their first or their last half, cut at half the
shorter one's length, and likewise all but one of BLOCKS equal blocks. Only lines that share such parts with a different
line emit variants, which loses no pair.

Where a large table meets few keys, a bitmap of the keys' hashes, of a fixed size, goes to the tasks and spares the shuffle
of most rows that can't match; the join that follows is exact.

Keys of variants are exclusive-or sums of hashes of (character, place), so all variants of a line take one pass over it. A
very long line with a close partner is one task's rows, sorted with spilling; nothing holds it in memory but in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import discard, maybe_in, pick, told_apart, written

#: So many characters of a line are an array at once.
_CHUNK = 1 << 16
BLOCKS = 16


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line): lines that aren't blank, numbered from 0 with blank ones counted."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"\S"))


def _copy_key(line: Column) -> list[Column]:
    """Two hashes that together tell different lines apart."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit("second")).alias("h2")]


def _order(*names: str) -> Column:
    """What comes first: smaller doc_id (null last), then the hash of the text, then the line's number."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), *[F.col(n) for n in names])


def _halves() -> Column:
    """Keys of the first and last half, cut for this length and for one less; lines of one character share empty halves."""
    n = F.length("line")

    def keys(size: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), size, F.substr("line", F.lit(1), size)), F.xxhash64(F.lit("last"), size, F.substr("line", n - size + F.lit(1), size))]

    return F.array_distinct(F.array(*keys(F.floor(n / 2).cast("int")), *keys(F.floor((n - 1) / 2).cast("int"))))


def line_table(docs: DataFrame) -> DataFrame:
    """Distinct lines without their text: copy key, first occurrence, number of occurrences, half keys. Written."""
    rows = _lines(docs).select("doc_id", "text_key", "line_no", *_copy_key(F.col("line")), _halves().alias("halves"))
    first = F.min(_order("doc_id", "text_key", "line_no")).alias("first")
    return written(rows.groupBy("h1", "h2").agg(first, F.count("*").alias("times"), F.first("halves").alias("halves")))


def _but_one_block() -> Column:
    """Keys of the line without one of its blocks, for this length and for one less; blocks may be empty."""
    n = F.length("line")

    def keys(size: Column) -> Column:
        def key(i: Column) -> Column:
            before, after = F.floor(size * i / BLOCKS).cast("int"), (size - F.floor(size * (i + 1) / BLOCKS)).cast("int")
            return F.xxhash64(i, size, F.substr("line", F.lit(1), before), F.substr("line", n - after + F.lit(1), after))

        return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), key)

    return F.array_distinct(F.concat(keys(n), keys(n - 1)))


def _sharing(parts: DataFrame, part: str) -> DataFrame:
    """The part keys that different lines have; parts holds h1, h2 and the part."""
    seen = [f(c).alias(f"{n}_{c}") for c in ("h1", "h2") for n, f in (("least", F.min), ("most", F.max))]
    return parts.groupBy(part).agg(*seen).where("least_h1 <> most_h1 OR least_h2 <> most_h2").select(part)


def near_links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2): keys of lines that have an earlier different line within one edit. distinct: each line's keys and halves."""
    key = ["h1", "h2"]
    halves = distinct.select(*key, F.explode("halves").alias("half"))
    shared = written(_sharing(halves, "half"))
    possible = written(maybe_in(halves, "half", shared).join(shared, "half", "left_semi").select(*key).distinct())
    texts = maybe_in(_lines(docs).select(*_copy_key(F.col("line")), "doc_id", "text_key", "line_no", "line"), "h1", possible.select("h1"))
    # a line's occurrences become one row before they are dealt by key, however many there are
    once = texts.groupBy(*key).agg(F.min(_order("doc_id", "text_key", "line_no")).alias("first"), F.first("line").alias("line"))
    found = written(once.join(possible, key, "left_semi"))
    blocks = written(found.select(*key, F.explode(_but_one_block()).alias("block")))
    close = blocks.join(_sharing(blocks, "block"), "block", "left_semi").select(*key).distinct()
    # numbered in their order: ids grow from one sorted partition to the next
    lines = written(found.join(close, key, "left_semi").orderBy("first").withColumn("id", F.monotonically_increasing_id()).select("id", *key, "line"))
    discard(shared, possible, found, blocks)

    # dealt by id before a line becomes a row for each character, so that the windows need no further shuffle
    n = F.length("line")
    chunks = lines.select("id", "line").repartition("id").select("id", n.alias("n"), "line", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int"))).alias("chunk"))
    chunks = chunks.select("id", "n", "chunk", F.substr("line", F.col("chunk") * _CHUNK + 1, F.lit(_CHUNK)).alias("part"))
    chars = chunks.select("id", "n", "chunk", F.posexplode(F.regexp_extract_all("part", F.lit("(?s)."), F.lit(0))).alias("at", "char"))
    chars = chars.select("id", "n", (F.col("chunk") * _CHUNK + F.col("at")).alias("place"), "char")
    upto = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = chars.select("id", "n", "place", F.xxhash64("char", "place").alias("here"), F.xxhash64("char", F.col("place") - 1).alias("moved"))
    sums = sums.select("id", "n", "place", "here", F.bit_xor("here").over(upto).alias("before"), F.bit_xor("moved").over(upto).alias("gone"), F.bit_xor("moved").over(whole).alias("all_moved"), F.bit_xor("here").over(whole).alias("all_here"))
    variant = F.col("before").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("all_moved")).bitwiseXOR(F.col("gone"))
    variants = written(sums.select((F.col("n") - 1).alias("size"), variant.alias("variant"), "place", "id", "all_here"))
    own = variants.where("place = 0").select((F.col("size") + 1).alias("size"), F.col("all_here").alias("variant"), F.col("id").alias("shorter"))

    # replacements: the members of a (variant, place) differ in one character; each is linked with the earliest
    of_place = variants.groupBy("size", "variant", "place").agg(F.min("id").alias("earlier"), F.max("id").alias("last")).where("earlier <> last").drop("last")
    replaced = variants.join(of_place, ["size", "variant", "place"]).where("earlier <> id").select(F.col("id").alias("later"), "earlier")
    # insertions: a variant equals another line
    inserted = variants.select("size", "variant", F.col("id").alias("longer")).join(own, ["size", "variant"])
    inserted = inserted.select(F.greatest("longer", "shorter").alias("later"), F.least("longer", "shorter").alias("earlier"))
    links = replaced.unionByName(inserted).distinct()
    text = lines.select("id", "line")
    checked = links.join(lines.withColumnRenamed("id", "later"), "later").join(text.toDF("earlier", "earlier_line"), "earlier").where(F.levenshtein("line", "earlier_line", 1).between(0, 1))
    out = written(checked.select(*key).distinct())
    discard(lines, variants)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns in order and these behind: n_lines, n_copies, n_near (long) and kept_text.

    Lines end at a line feed. n_lines counts those that aren't blank; n_copies of them equal an earlier line, n_near more
    are within one edit of one. Both kinds are left out of kept_text; blank lines stay, and a text that loses nothing
    stays as it is. Whether a line goes depends on earlier lines whether or not these stay themselves.
    Earlier: smaller id (null ids last), then the text's hash, then the line. Rows with equal id and text count as one
    document and get the same result. Null text: no lines, kept_text null; an empty table gives an empty one. Columns
    whose names clash, with each other or with the new ones, keep their places; a very long text is one row as before.
    """
    named = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    columns = list(docs.columns)
    i_id, i_text = f"_c{columns.index(id_col)}", f"_c{columns.index(text_col)}"
    slim = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.col("text").cast("string"))
    distinct = line_table(slim)
    key = ["h1", "h2"]
    order = _order("doc_id", "text_key", "line_no")
    near = near_links(slim, distinct).withColumn("near", F.lit(True))
    repeated = distinct.join(near, key, "left").where(F.col("near") | (F.col("times") > 1)).select(*key, "first", F.coalesce("near", F.lit(False)).alias("near"))
    repeated = written(repeated)
    discard(distinct, near)
    occurrences = _lines(slim).select("doc_id", "text_key", "line_no", *_copy_key(F.col("line")))
    marked = maybe_in(occurrences, "h1", repeated.select("h1")).withColumn("order", order).join(repeated, key)
    gone = marked.select("doc_id", "text_key", "line_no", (F.col("order") != F.col("first")).alias("copy"), "near").where("copy or near").distinct()
    by_doc = written(gone.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("gone"), F.count_if("copy").alias("n_copies"), F.count_if(~F.col("copy")).alias("n_near")))
    discard(repeated)

    lines = F.split(F.col("_text"), "\n", -1)
    body = named.withColumn("_text", F.col(i_text).cast("string")).withColumn("_key", F.xxhash64("_text"))
    flagged = told_apart(body, "_key", by_doc.select("text_key"))  # only documents that may lose a line are dealt by key
    same = F.col(i_id).eqNullSafe(by_doc["doc_id"]) & (F.col("_key") == by_doc["text_key"])
    losers = flagged.where("_maybe").join(by_doc.hint("merge"), same, "left")
    nothing = [F.lit(None).cast(by_doc.schema[c].dataType).alias(c) for c in by_doc.columns]
    joined = flagged.where("NOT _maybe").select("*", *nothing).unionByName(losers)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col("_lines"), i)), "\n"))
    some = F.coalesce(F.size(F.filter("_lines", lambda x: x.rlike(r"\S"))), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    out = joined.withColumn("_lines", lines).select(
        *[F.col(f"_c{i}") for i in range(len(columns))],
        F.when(F.col("_text").isNull(), zero).otherwise(some).alias("n_lines"),
        F.coalesce("n_copies", zero).alias("n_copies"),
        F.coalesce("n_near", zero).alias("n_near"),
        kept.alias("kept_text"),
    )
    return out.toDF(*columns, "n_lines", "n_copies", "n_near", "kept_text")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
), real AS (
  SELECT doc_id, line_no, line FROM lines WHERE regexp_replace(line, '\s+', '', 'g') <> ''
), firsts AS (
  SELECT line, length(line) AS n, min(struct_pack(a := doc_id, b := line_no)) AS first FROM real GROUP BY line
), halves AS (
  SELECT line, n, first, unnest([1, 2, 3, 4]) AS side FROM firsts
), keyed AS (
  SELECT line, n, first,
    CASE side WHEN 1 THEN 'f' || (n // 2) || ':' || substr(line, 1, n // 2)
              WHEN 2 THEN 'f' || ((n - 1) // 2) || ':' || substr(line, 1, (n - 1) // 2)
              WHEN 3 THEN 'l' || (n // 2) || ':' || substr(line, n - n // 2 + 1, n // 2)
              ELSE 'l' || ((n - 1) // 2) || ':' || substr(line, n - (n - 1) // 2 + 1, (n - 1) // 2) END AS k
  FROM halves
), near AS (
  SELECT DISTINCT a.line FROM keyed a JOIN keyed b ON a.k = b.k AND b.first < a.first AND abs(a.n - b.n) <= 1
  WHERE CASE WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: substr(a.line, i, 1) <> substr(b.line, i, 1))) <= 1
             WHEN a.n > b.n THEN len(list_filter(range(1, a.n + 1), lambda i: substr(a.line, 1, i - 1) || substr(a.line, i + 1) = b.line)) > 0
             ELSE len(list_filter(range(1, b.n + 1), lambda i: substr(b.line, 1, i - 1) || substr(b.line, i + 1) = a.line)) > 0 END
), judged AS (
  SELECT r.doc_id, r.line_no, r.line, struct_pack(a := r.doc_id, b := r.line_no) <> f.first AS copied, n.line IS NOT NULL AS near
  FROM real r JOIN firsts f ON r.line = f.line LEFT JOIN near n ON r.line = n.line
), counted AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE copied) AS n_copies, count(*) FILTER (WHERE near AND NOT copied) AS n_near
  FROM judged GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS kept_text
  FROM lines l LEFT JOIN judged j ON l.doc_id = j.doc_id AND l.line_no = j.line_no
  WHERE NOT coalesce(j.copied OR j.near, false) GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_copies, 0)::BIGINT AS n_copies, coalesce(c.n_near, 0)::BIGINT AS n_near,
       md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept_text, '') END) AS kept_md5
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
