"""Mixing sources to target weights with a low-discrepancy schedule.

Targets are filled by weight; a source that would get more than ``most`` times its size stops there
and the excess is shared out again.  The words of a source, its documents shuffled by a hash, are
cut into blocks of equally many words.  The mix is a row of slots: slot k is the point
frac((k + 1) * golden ratio), in 32-bit fixed point, mapped through the cumulative block quotas to a
source.  The slots of a source are ranked; slot r takes block r modulo its blocks, up to the quota.
``spans`` is that mix, a row per slot and document; ``mixed`` sums it up per document and
``mixed_documents`` puts the documents in the order of their slots.

All of it is DataFrame work.  Ranks and running sums go in two levels, per chunk of slots and per
bucket of hashes first, so a source that holds a third of all rows is ordered in many tasks.  The
schedule has about ``slots`` rows plus ``blocks`` for every source, and blocks grow with the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import WHITE, Scratch, n_words

# Fixed value: the golden ratio's fractional part in 32 bits.
GOLDEN = 2654435769


@dataclass(frozen=True)
class Mix:
    """``slots`` is the length of the schedule, ``blocks`` the fewest blocks of a source that has as
    many words; more of either bring the words taken closer to the targets."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    slots: int = 1 << 20
    blocks: int = 256


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, place, tie``: words of every row and its place in the shuffled order."""
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        "doc_id",
        "source",
        n_words(F.col("text")).alias("size"),
        F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long").alias("place"),
        F.xxhash64("text").alias("tie"),
    )


def _before(value: Column, window: W) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def goals(by_source: DataFrame, mix: Mix) -> DataFrame:
    """Per source: ``source_size``, ``target``, its ``number``, ``block`` words and ``blocks``, the
    ``quota`` of slots and the points ``low <= point < high`` that are its own.

    Sources in order of code point, null last, have the weights in turn.  With sources sorted by
    cap over weight, those before some place are at their cap and the others at one level: the
    highest level (what the capped leave, over the weights left) that is no higher than the next cap.
    One row per source is ordered here, no row of a document.
    """
    everything, by_ratio, by_number = W.partitionBy(), W.orderBy("ratio", "number"), W.orderBy("number")
    cap = F.col("source_size") * mix.most
    weights = F.array(*map(F.lit, mix.weights))
    rows = (
        by_source.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(weights, (F.col("number") % len(mix.weights) + 1).cast("int")))
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * mix.share)
        .withColumn("weights_left", F.sum("weight").over(everything) - _before(F.col("weight"), by_ratio))
        .withColumn("level", (F.col("total") - _before(cap, by_ratio)) / F.col("weights_left"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).cast("double"))
    )
    most_words = F.greatest(F.lit(1.0), F.floor(F.col("total") / mix.slots))
    block = F.ceil(F.least(most_words, F.greatest(F.lit(1.0), F.col("source_size") / mix.blocks)))
    rows = (
        rows.withColumn("block", block.cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("quota", F.floor(F.col("target") / F.col("block") + 0.5).cast("long"))
        .withColumn("quota", F.least("quota", (F.col("blocks") * mix.most).cast("long")))
        .withColumn("slots", F.sum("quota").over(everything))
        .withColumn("low", _before(F.col("quota"), by_number))
    )
    point = lambda quota: f"(({quota}) * 4294967296L) div slots"
    edges = rows.where("slots > 0").withColumns({"low": F.expr(point("low")), "high": F.expr(point("low + quota"))})
    columns = ["source", "source_size", "target", "number", "block", "blocks", "quota", "slots"]
    return rows.select(*columns, "low").join(edges.select("number", F.col("low").alias("from"), "high"), "number", "left").select(
        *columns, F.col("from").alias("low"), "high"
    )


def schedule(wanted: DataFrame, mix: Mix, chunk: int = 4096) -> DataFrame:
    """``slot, number, at, pass``: the block ``at`` that a slot takes from its source, which it is
    the ``pass``-th time (from 0) that the source is run through, from the ranked slots."""
    spark = wanted.sparkSession
    sources = wanted.agg(F.max("slots").alias("n"))
    n = sources.first().n or 0  # one number
    n += n // 16 + 64 if n else 0  # so that every source reaches its quota
    slots = spark.range(n).select("id", ((F.col("id") + 1) * GOLDEN % F.lit(2**32)).alias("point"))
    # points and sources meet in 4096 cells of the unit interval
    cells = F.explode(F.sequence(F.shiftright("low", 20), F.shiftright(F.col("high") - 1, 20)))
    owners = wanted.where("low < high").select("number", "quota", "blocks", "low", "high", cells.alias("cell"))
    owned = (
        slots.withColumn("cell", F.shiftright("point", 20))
        .join(owners, "cell")
        .where("point >= low and point < high")
        .select("id", "number", "quota", "blocks", F.floor(F.col("id") / chunk).alias("chunk"))
    )
    counts = owned.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("number", "chunk", _before(F.col("n"), W.partitionBy("number").orderBy("chunk")).alias("before"))
    within = F.row_number().over(W.partitionBy("number", "chunk").orderBy("id")) - 1
    ranked = owned.withColumn("within", within).join(before, ["number", "chunk"])
    taken = ranked.withColumn("rank", F.col("before") + F.col("within")).where("rank < quota")
    return taken.select(
        F.col("id").alias("slot"), "number", F.expr("rank % blocks").alias("at"), F.expr("rank div blocks").alias("pass")
    )


def _placed(sized: DataFrame, wanted: DataFrame, buckets_log2: int = 12) -> DataFrame:
    """Rows with ``first``, the words of the source that come before theirs in the shuffled order."""
    sized = sized.withColumn("bucket", F.shiftright("place", 60 - buckets_log2))
    cells = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = cells.withColumn("before", _before(F.col("words"), W.partitionBy("source").orderBy("bucket"))).drop("words")
    before = before.alias("b").join(wanted.alias("g"), F.expr("b.source <=> g.source")).select("b.*", "g.*").select(
        F.col("b.source").alias("cell_source"), F.col("bucket").alias("cell"), "before",
        "source_size", "target", "number", "block",
    )
    order = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", "tie")
    running = sized.withColumn("within", _before(F.col("size"), order))
    same = F.expr("source <=> cell_source and bucket = cell")
    return running.join(before, same).withColumn("first", F.col("before") + F.col("within")).select(
        "doc_id", "source", "tie", "size", "source_size", "target", "number", "block", "first"
    )


def _tables(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """Rows at their places, and the schedule."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.put(sizes(docs), "sizes")
    wanted = scratch.put(goals(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix), "goals")
    return _placed(sized, wanted), schedule(wanted, mix)


def _cut(placed: DataFrame) -> DataFrame:
    """A row for every block that holds words of a document: its words from ``start`` on."""
    at = F.expr("sequence(first div block, (first + size - 1) div block)")
    begin = F.expr("greatest(first, at * block)")
    return placed.where("size > 0").withColumn("at", F.explode(at)).withColumns(
        {"start": begin - F.col("first"), "words": F.expr("least(first + size, (at + 1) * block)") - begin}
    )


def spans(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: ``slot, source, block, pass, doc_id, start, words, first, tie``.

    Slot by slot (ids ascend, those past a source's quota are left out) the documents whose words
    from ``start`` on (from 0) it takes, ``words`` of them; inside a slot they go in the order of
    ``first``, the words of the source before the document.  ``block`` is the number of the block
    in its source.  Rows and columns are treated as by ``mixed``; documents without words have no row.
    """
    placed, slots = _tables(docs, mix)
    return _cut(placed).join(slots, ["number", "at"]).select(
        "slot", "source", F.col("at").alias("block"), "pass", "doc_id", "start", "words", "first", "tie"
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, passes, tie`` of every row.

    ``taken`` is the words that the mix takes from the row, repeats counted: the sum over its spans.
    ``passes`` holds for the first, second, ... run through its source the ``words`` taken, which
    are its first ones, the ``slot`` that takes the first of them, and ``first``, its place there.
    Null, empty and blank
    texts have size 0 and nothing taken; a null source is a source of its own; a source without
    words has target 0.  Rows that repeat an id are documents of their own.  Rows without id come
    in one place of the order.  No rows: no rows.  Other columns are ignored.
    """
    placed, slots = _tables(docs, mix)
    parts = _cut(placed).join(slots, ["number", "at"], "left")
    in_pass = lambda t, value: F.when(F.col("pass") == t, value)
    taken = lambda t: F.struct(
        F.coalesce(F.sum(in_pass(t, F.col("words"))), F.lit(0).cast("long")).alias("words"),
        F.min(in_pass(t, F.col("slot"))).alias("slot"),
        F.col("first"),
    )
    row = ["number", "first", "doc_id", "tie", "size", "source_size", "target"]
    runs = range(math.ceil(mix.most))
    full = parts.groupBy(*row).agg(F.array(*(taken(t) for t in runs)).alias("passes"))
    none = placed.where("size = 0").select(*row, F.array().cast(full.schema["passes"].dataType).alias("passes"))
    return full.union(none).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.aggregate("passes.words", F.lit(0).cast("long"), lambda a, b: a + b).alias("taken"),
        "passes",
        "tie",
    )


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, whatever their names, in the order of the
    schedule: a row for every run through its source that takes words of it, at the slot that takes
    the first of them, with its first words (joined by one space) where only some are taken."""
    columns = docs.columns
    number = lambda df: df.withColumn(  # noqa: E731  rows that repeat id and text are told apart
        "nth", F.row_number().over(W.partitionBy("doc_id", "tie").orderBy(F.lit(0)))
    )
    found = number(mixed(docs, mix).where("taken > 0")).select("doc_id", "tie", "nth", "size", "passes")
    rows = number(docs.select("doc_id", F.xxhash64("text").alias("tie"), F.struct(*columns).alias("row")))
    same = F.expr("d.doc_id <=> m.doc_id and d.tie = m.tie and d.nth = m.nth")
    rows = rows.alias("d").join(found.alias("m"), same).select("row", "size", F.explode("passes").alias("run"))
    rows = rows.where("run.words > 0").orderBy("run.slot", "run.first")
    some, text = F.col("run.words") < F.col("size"), F.col("row.text")
    words = F.slice(F.regexp_extract_all(text, F.lit(WHITE), F.lit(0)), F.lit(1), F.col("run.words").cast("int"))
    new = {"text": F.when(some, F.array_join(words, " ")).otherwise(text)}
    if "n_chars" in columns:
        new["n_chars"] = F.when(some, F.length(new["text"]).cast("long")).otherwise(F.col("row.n_chars"))
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in columns))
