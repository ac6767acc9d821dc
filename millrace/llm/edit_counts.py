"""Token counts that follow edits without encoding whole texts again.

A text is cut into leaves of some hundred characters, before blanks and before the full-width marks
that follow a letter.  The tokenizer never joins over these places, so leaves are counted one by
one, and a segment tree per document holds their counts and the sums of its subtrees.  Trees are
kept as a table.  An edit touches the leaves of the characters that it changes and of one more
character on either side; only these regions are encoded again, the sums above them are brought up
to date, and the new trees serve the next edits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.common import Scratch, word_encoder

# Characters before which a text may be cut.  White space to every tokenizer that drops
# it, and marks that end a run of letters.
BLANKS = " \n"
MARKS = "\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
CUT = re.compile(f"[{BLANKS}]|(?<=[^\\W\\d_])[{MARKS}]")


def leaves(text: str, leaf: int) -> list[int]:
    """Where leaves begin: 0, then the first place to cut at least ``leaf`` characters after the last.

    A run of letters without such a place is one token to be for the tokenizer, and so one leaf.
    """
    starts = [0]
    while found := CUT.search(text, starts[-1] + leaf):
        starts.append(found.start())
    return starts


def tree(counts: list[int]) -> list[int]:
    """Sums of all subtrees, the root at 1 and leaf i at ``len(tree) // 2 + i``."""
    size = 1
    while size < len(counts):
        size *= 2
    sums = [0] * size + counts + [0] * (size - len(counts))
    for i in range(size - 1, 0, -1):
        sums[i] = sums[2 * i] + sums[2 * i + 1]
    return sums


def set_leaf(sums: list[int], i: int, count: int) -> None:
    at = len(sums) // 2 + i
    change = count - sums[at]
    while at and change:
        sums[at] += change
        at //= 2


@dataclass
class Edited:
    """A text after edits with its tree, and the regions and characters that were encoded for it."""

    text: str
    starts: list[int]
    sums: list[int]
    regions: int = 0
    encoded: int = 0


def apply(text: str, starts: list[int], sums: list[int], edits: list[tuple[int, int, str]], count, leaf: int) -> Edited:
    """Apply edits ``(at, removed, inserted)`` to a text and its tree; ``count`` gives the tokens of a text.

    Places are those of the text before.  An edit beyond the end is one at the end, and one that
    begins inside what an earlier one removes begins after it.  A region that has grown beyond two
    leaves is cut again.  Where the number of leaves stays, only the sums above them change;
    otherwise sums are added up anew from the counts of the leaves, without encoding.
    """
    if not edits:
        return Edited(text, starts, sums)
    n, done = len(text), 0
    regions: list[list] = []  # first leaf, last leaf, edits
    for at, removed, inserted in sorted(edits, key=lambda e: e[0]):
        at = max(done, min(max(at, 0), n))
        end = max(at, min(at + max(removed, 0), n))
        done = end
        low, high = (max(bisect_right(starts, x) - 1, 0) for x in (max(at - 1, 0), min(end, n - 1)))
        if regions and low <= regions[-1][1]:
            regions[-1][1] = max(high, regions[-1][1])
            regions[-1][2].append((at, end, inserted))
        else:
            regions.append([low, high, [(at, end, inserted)]])

    half = len(sums) // 2
    counts = sums[half : half + len(starts)]
    pieces: list[str] = []
    new_starts: list[int] = []
    new_counts: list[int] = []
    out = Edited("", new_starts, sums, len(regions))
    before, shift = 0, 0  # leaves done, and how far what follows has moved
    for low, high, changes in [*regions, [len(starts), len(starts) - 1, []]]:
        new_starts += [s + shift for s in starts[before:low]]
        new_counts += counts[before:low]
        if not changes:
            pieces.append(text[starts[before] if before < len(starts) else n :])
            break
        begin, stop = starts[low], starts[high + 1] if high + 1 < len(starts) else n
        if before < low:
            pieces.append(text[starts[before] : begin])
        parts, at = [], begin
        for s, e, inserted in changes:
            parts += [text[at:s], inserted]
            at = e
        piece = "".join([*parts, text[at:stop]])
        inner = leaves(piece, leaf) if len(piece) > 2 * leaf else [0]
        new_starts += [begin + shift + s for s in inner]
        new_counts += [count(piece[s:e]) for s, e in zip(inner, [*inner[1:], len(piece)], strict=True)]
        pieces.append(piece)
        out.encoded += len(piece)
        before, shift = high + 1, shift + len(piece) - (stop - begin)
    out.text = "".join(pieces)
    if len(new_starts) == len(starts):
        out.sums = list(sums)
        for i, (old, new) in enumerate(zip(counts, new_counts, strict=True)):
            if old != new:
                set_leaf(out.sums, i, new)
    else:
        out.sums = tree(new_counts)
    return out


def trees(docs: DataFrame, tokenizer: str, leaf: int = 512) -> DataFrame:
    """``doc_id, tie, starts, sums``: the segment tree of every distinct row (tie: hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for b in batches:
            starts, sums = [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                at = leaves(text, leaf)
                starts.append(at)
                sums.append(tree([len(encode(text[s:e])) // 4 for s, e in zip(at, [*at[1:], len(text)], strict=True)]))
            columns = [b.column("doc_id"), b.column("tie"), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, sums))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "starts", "sums"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, starts array<long>, sums array<long>")


def _applied(docs: DataFrame, known: DataFrame, edits: DataFrame, tokenizer: str, leaf: int, schema: str, row) -> DataFrame:
    """``row(doc_id, tokens before, number of edits, Edited)`` of every row, in columns ``schema``."""
    known = known.groupBy("doc_id", "tie").agg(F.min(F.struct("starts", "sums")).alias("known"))
    known = known.select(F.col("doc_id").alias("known_id"), F.col("tie").alias("known_tie"), "known")
    one = F.struct(
        F.coalesce("at", F.lit(0)).cast("long").alias("at"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("removed"),
        F.coalesce("inserted", F.lit("")).alias("inserted"),
    )
    wanted = edits.where("doc_id is not null").groupBy(F.col("doc_id").alias("edited_id")).agg(F.collect_list(one).alias("edits"))
    # trees and edits meet first, so that texts are moved once
    known = known.join(wanted, F.expr("known_id = edited_id"), "left")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").join(
        known, F.expr("doc_id <=> known_id and tie = known_tie")
    )

    form = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        count = lambda text: len(encode(text)) // 4
        for b in batches:
            out = []
            for doc_id, text, known, edits in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "known", "edits")), strict=True):
                changes = sorted((e["at"], e["removed"], e["inserted"]) for e in edits or [])
                after = apply(text or "", known["starts"], known["sums"], changes, count, leaf)
                out.append(row(doc_id, known["sums"][1], len(changes), after))
            yield pa.RecordBatch.from_pylist(out, form)

    return rows.select("doc_id", "text", "known", "edits").mapInArrow(run, schema)


def recounted(docs: DataFrame, known: DataFrame, edits: DataFrame, tokenizer: str, leaf: int = 512) -> DataFrame:
    """``doc_id, tokens_before, tokens_after, n_edits, n_regions, n_encoded`` of every row of ``docs``.

    ``known`` has the trees of ``docs``; ``edits`` has ``doc_id, at, removed, inserted`` with places in
    code points.  A null text is an empty one, nulls in an edit are 0 or empty, and edits of ids that
    are no document are ignored, as are edits and documents without id.  Rows that repeat an id get
    its edits each.  Rows without edits keep their count.  No rows: no rows.  Other columns are
    ignored.
    """
    names = ["doc_id", "tokens_before", "tokens_after", "n_edits", "n_regions", "n_encoded"]

    def row(doc_id: int | None, before: int, n_edits: int, after: Edited) -> dict:
        return dict(zip(names, (doc_id, before, after.sums[1], n_edits, after.regions, after.encoded), strict=True))

    return _applied(docs, known, edits, tokenizer, leaf, ", ".join(f"{n} long" for n in names), row)


def edited_trees(docs: DataFrame, known: DataFrame, edits: DataFrame, tokenizer: str, leaf: int = 512) -> DataFrame:
    """``doc_id, text, starts, sums``: the texts after the edits, and their trees, for the next edits.

    Inputs and odd rows as in ``recounted``; null texts come back empty.  Write the result, and take
    documents and ``of_edited`` from it.
    """

    def row(doc_id: int | None, before: int, n_edits: int, after: Edited) -> dict:
        return {"doc_id": doc_id, "text": after.text, "starts": after.starts, "sums": after.sums}

    return _applied(docs, known, edits, tokenizer, leaf, "doc_id long, text string, starts array<long>, sums array<long>", row)


def of_edited(rows: DataFrame) -> DataFrame:
    """The table of trees, as ``trees`` gives it, of a written result of ``edited_trees``."""
    return rows.select("doc_id", F.xxhash64("text").alias("tie"), "starts", "sums")


def edits_of(docs: DataFrame) -> DataFrame:
    """Three edits for every document: words put in after a quarter, ten characters taken out in the
    middle, five replaced after three quarters (one insertion for texts of fewer than 40)."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda at, removed, inserted: F.struct(
        F.floor(at).cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted")
    )
    three = F.array(edit(n / 4, 0, " two words"), edit(n / 2, 10, ""), edit(n * 3 / 4, 5, "Änd 7"))
    return docs.select("doc_id", F.explode(F.when(n < 40, F.array(edit(n / 4, 0, " two words"))).otherwise(three)).alias("e")).select("doc_id", "e.*")


def edited_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Trees of ``docs``, kept as a table, and their counts after the edits of ``edits_of``."""
    known = Scratch(docs.sparkSession, "edits").put(trees(docs, tokenizer), "trees")
    return recounted(docs, known, edits_of(docs), tokenizer)
