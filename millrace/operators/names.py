"""Names of a dictionary in texts, by their first words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column | str) -> Column:
    """Lowered runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def find_names(rows: DataFrame, dictionary: DataFrame, text: str, name: str) -> DataFrame:
    """Every place of ``rows`` where a name begins: the columns but the text, ``at`` (the word, from
    0), ``n_words`` and ``name``; where several begin, the longest.

    ``dictionary`` is a table of any size with one name per row; names are compared by their words,
    so case and marks do not count, and of names with the same words the smallest is given.  A
    name's first word is its way in: words of the texts meet the dictionary by an equi-join on it,
    with as many words behind them as the names of that beginning have, and no others travel.  Names
    and texts without words, nulls included, give no rows.
    """
    spelled = dictionary.select(F.col(name).alias("name"), words(name).alias("spelled")).where(F.size("spelled") > 0)
    spelled = spelled.groupBy("spelled").agg(F.min("name").alias("name"))
    entries = spelled.select(F.col("spelled")[0].alias("first"), "spelled", "name")
    ways_in = entries.groupBy("first").agg(F.max(F.size("spelled")).alias("most"))

    kept = [c for c in rows.columns if c != text]
    # a row travels as one struct, so that its columns cannot clash with those used here
    held = rows.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), words(text).alias("all"))
    longest = ways_in.agg(F.max("most")).first()[0] or 0  # one number
    places = held.select("row", F.posexplode(F.transform("all", lambda w, i: F.slice("all", i + 1, longest))).alias("at", "ahead"))
    places = places.withColumn("first", F.col("ahead")[0])
    near = places.join(ways_in, "first").withColumn("ahead", F.slice("ahead", 1, F.col("most")))
    # prefixes of what is ahead, each a possible name
    prefixes = F.transform(F.sequence(F.lit(1), F.size("ahead")), lambda n: F.slice("ahead", 1, n))
    tried = near.select("row", "at", F.explode(prefixes).alias("spelled"))
    found = tried.join(entries.drop("first"), "spelled")
    found = found.withColumn("n_words", F.size("spelled"))
    best = found.groupBy("row", "at").agg(F.max(F.struct("n_words", "name")).alias("best"))
    return best.select(*[F.col("row")[c].alias(c) for c in kept], "at", "best.n_words", "best.name")
