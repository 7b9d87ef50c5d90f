"""Requests in words turned into constraints, and constraints applied to a catalog.

Parsing is one expression a field. Constraints are applied by their signature: requests that ask for the same are one row, so a
catalog is met by each different signature once, however many requests there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.sources.tables import TAGS

#: What a level, a tag and a month are called; stems match longer words too.
LEVEL_WORDS = {"Budget": ["cheap", "budget", "backpack", "affordab"], "Mid-range": ["mid range", "moderate", "reasonabl"], "Luxury": ["luxur", "five star", "upscale", "splurge"]}
TAG_WORDS = {
    "culture": ["cultur", "museum", "histor", "art "],
    "adventure": ["adventur", "hik", "trek", "climb"],
    "nature": ["natur", "forest", "mountain", "wildlife"],
    "beaches": ["beach", "coast", "seaside"],
    "nightlife": ["nightlife", "club", "bars"],
    "cuisine": ["cuisine", "food", "restaurant", "culinar"],
    "wellness": ["wellness", "spa ", "yoga", "relax"],
    "urban": ["urban", "skyline", "big city"],
    "seclusion": ["seclu", "quiet", "remote", "off the beaten"],
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Words that turn what follows, up to so many words on, into its opposite.
NEGATIONS, REACH = ["no", "not", "without", "avoid", "never"], 2


def _spaced(text: Column) -> Column:
    """Lower-cased words with one space between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")), F.lit(" "))


def parse(text: Column) -> Column:
    """A struct (budget, tags, avoid, month, days) of a request: the first level named, tags asked for and tags ruled out, both
    in the order of TAGS, the first month and the number before "days" or "nights"; null or empty where nothing is said.

    A tag is ruled out if a negation stands up to REACH words before one of its words, and then isn't asked for.
    """

    def made(s: Column) -> Column:
        alternatives = lambda words: "(?:" + "|".join(words) + ")"
        negated = " " + alternatives(NEGATIONS) + r"(?: [a-z0-9]+){0," + str(REACH) + "} "
        named = {level: F.regexp_instr(s, F.lit(" " + alternatives(w))) for level, w in LEVEL_WORDS.items()}
        first = F.array_min(F.filter(F.array(*[F.when(at > 0, F.struct(at.alias("at"), F.lit(level).alias("level"))) for level, at in named.items()]), lambda x: x.isNotNull()))["level"]
        out = {t: s.rlike(negated + alternatives(w)) for t, w in TAG_WORDS.items()}
        wanted = {t: s.rlike(" " + alternatives(w)) & ~out[t] for t, w in TAG_WORDS.items()}
        listed = lambda says: F.filter(F.array(*[F.when(says[t], F.lit(t)) for t in TAGS]), lambda x: x.isNotNull())
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.nullif(F.regexp_extract(s, r" (?:in|during|for) (" + "|".join(MONTHS) + ") ", 1), F.lit("")))
        days = F.nullif(F.regexp_extract(s, r" ([0-9]{1,3}) (?:days?|nights?) ", 1), F.lit("")).try_cast("int")
        return F.struct(first.alias("budget"), listed(wanted).alias("tags"), listed(out).alias("avoid"), F.nullif(month, F.lit(0).cast("long")).cast("int").alias("month"), days.alias("days"))

    return F.get(F.transform(F.array(_spaced(text)), made), F.lit(0))


def allowed(catalog: DataFrame, signatures: DataFrame, least: int = 4, most: int = 2) -> DataFrame:
    """Rows (budget, tags, avoid, item_id): what items (item_id, budget_level, tags) each signature (budget, tags, avoid) allows.

    Hard constraints: the level named, `least` or more in each tag asked for, `most` or less in each tag ruled out. Signatures
    are few (levels times sets of tags that somebody asked for), and an item is met by each of them once.
    """
    rate = lambda t: F.element_at(F.col("rates"), F.array_position(F.array(*map(F.lit, TAGS)), t).cast("int"))
    ok = (F.col("budget").isNull() | (F.col("budget_level") == F.col("budget"))) & F.forall("tags", lambda t: rate(t) >= least) & F.forall("avoid", lambda t: rate(t) <= most)
    return signatures.select("budget", "tags", "avoid").distinct().join(catalog.select("item_id", "budget_level", F.col("tags").alias("rates")), ok).select("budget", "tags", "avoid", "item_id")


def field_match(parsed: DataFrame, real: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (requests, valid, and each field's share of agreement) of two tables of the same requests by key.

    valid: the share of requests that name at least one constraint. Nulls agree with nulls. A request that wasn't parsed agrees
    in nothing.
    """
    names = [F.col(f).alias(f"_{f}") for f in fields]
    both = real.select(key, *fields).join(parsed.select(key, *names, F.lit(True).alias("_there")), key, "left")
    share = [F.round(F.avg(F.when(F.coalesce("_there", F.lit(False)) & F.col(f).eqNullSafe(F.col(f"_{f}")), 1.0).otherwise(0.0)), 6).alias(f) for f in fields]
    said = F.greatest(*[F.when(F.col(f"_{f}").isNotNull() & (F.col(f"_{f}").cast("string") != "[]"), 1.0).otherwise(0.0) for f in fields])
    return both.agg(F.count("*").alias("requests"), F.round(F.avg(said), 6).alias("valid"), *share)
