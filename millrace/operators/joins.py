"""Joins by position, by time and by reference."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordered as o
from millrace.runtime import pin

Names = Sequence[str] | str


def _list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def zip_positional(
    left: DataFrame,
    right: DataFrame,
    by: Names = (),
    left_order: Names = (),
    right_order: Names = (),
    name: str = "idx",
) -> DataFrame:
    """i-th row with i-th row per key; ends with the shorter side.

    Columns other than the keys must differ between the sides.
    """
    by = _list(by)
    a = o.ordered(left, by, left_order).add(**{name: o.index()}).df
    b = o.ordered(right, by, right_order).add(**{name: o.index()}).df
    return a.join(b, [*by, name])


def _payload(df: DataFrame, without: Sequence[str]) -> Column:
    # the flag keeps the struct from being empty
    return F.struct(F.lit(True).alias("_is"), *[c for c in df.columns if c not in without])


def _tagged(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    order_by: list[str],
    ranks: tuple[int, int],
    left_without: Sequence[str],
) -> DataFrame:
    """Both sides as one sequence; payloads in the structs ``_a`` and ``_b``.

    What travels as key or order column is not sent a second time in the payload.
    """
    payloads = {"_a": _payload(left, left_without), "_b": _payload(right, by)}
    kinds = {
        n: df.select(payloads[n].alias("s")).schema["s"].dataType
        for n, df in (("_a", left), ("_b", right))
    }

    def side(df: DataFrame, mine: str, other: str, rank: int) -> DataFrame:
        return df.select(
            *by,
            *order_by,
            F.lit(rank).alias("_rank"),
            payloads[mine].alias(mine),
            F.lit(None).cast(kinds[other]).alias(other),
        )

    return side(left, "_a", "_b", ranks[0]).unionByName(side(right, "_b", "_a", ranks[1]))


def combine_latest(
    left: DataFrame,
    right: DataFrame,
    by: Names,
    order_by: Names,
    combine: Callable[[Column, Column], dict[str, Column]],
) -> DataFrame:
    """On each new row of either side, combine it with the last row of the other side.

    Starts once both sides have a row.  ``combine`` gets the two rows as structs (without
    their keys) and names the result columns.  Both sides carry the keys and the order columns; the left side
    comes first where the order columns are equal.
    """
    by, order_by = _list(by), _list(order_by)
    both = _tagged(left, right, by, order_by, (0, 1), left_without=by)
    seq = o.ordered(both, by, [*order_by, "_rank"]).add(
        _la=o.last_known("_a"), _lb=o.last_known("_b")
    )
    ready = seq.where(F.col("_la").isNotNull() & F.col("_lb").isNotNull())
    made = combine(F.col("_la"), F.col("_lb"))
    return ready.df.select(*by, *order_by, *[c.alias(n) for n, c in made.items()])


def asof(
    rows: DataFrame,
    params: DataFrame,
    by: Names,
    order_by: Names,
    use: Callable[[Column, Column], dict[str, Column]],
) -> DataFrame:
    """Each row with the newest parameter row at or before it (null before the first).

    ``use`` gets the row and the parameter row (without its keys) as structs and names the
    result columns.

    Union and last-known value: one shuffle on the keys, no range join.  A parameter with
    the same order values as a row counts as before it.
    """
    by, order_by = _list(by), _list(order_by)
    outside = [*by, *order_by]
    both = _tagged(rows, params, by, order_by, (1, 0), left_without=outside)
    seq = o.ordered(both, by, [*order_by, "_rank"]).add(_p=o.last_known("_b"))
    columns = [
        F.col(c) if c in outside else F.col("_a")[c].alias(c) for c in rows.columns
    ]
    found = seq.df.where(F.col("_a").isNotNull())
    made = use(F.struct(*columns), F.col("_p"))
    return found.select(*columns, *[c.alias(n) for n, c in made.items()])


def versioned_exclusion(
    rows: DataFrame,
    listing: DataFrame,
    value: str,
    order_by: Names,
    version: str = "version",
) -> DataFrame:
    """Rows whose value is not in the list version in force at their time.

    ``listing`` has one row per (version, value) with the order columns of the version; a
    new version replaces the whole list, and before the first one nothing is excluded.
    An empty version is a row with a null value.

    The versions are turned into switches per value - on where a version has it, off where
    the next one does not - so the rows are looked at per value and not as one sequence.
    The list is made once and written, as it is looked at for its versions and for its values.
    """
    order_by = _list(order_by)
    listing = pin(listing.select(value, version, *[c for c in order_by if c not in (value, version)]), "listing")
    versions = listing.select(version, *order_by).distinct()
    here = F.struct(*order_by)
    spans = o.ordered(versions.withColumn("_from", here), (), order_by).add(_to=o.lead("_from"))
    listed = listing.where(F.col(value).isNotNull()).join(
        spans.df.select(version, "_from", "_to"), version
    )

    def switch(at: str, on: bool) -> DataFrame:
        return listed.where(F.col(at).isNotNull()).select(
            value, *[F.col(at)[c].alias(c) for c in order_by], F.lit(on).alias("_on")
        )

    # where one version ends and the next has the value again, "on" wins
    switches = (
        switch("_from", True)
        .unionByName(switch("_to", False))
        .groupBy(value, *order_by)
        .agg(F.max("_on").alias("_on"))
    )
    judged = asof(rows, switches, value, order_by, lambda row, s: {"_out": s["_on"]})
    return judged.where(~F.coalesce(F.col("_out"), F.lit(False))).drop("_out")


def enrich(rows: DataFrame, lookup: DataFrame, key: Names) -> DataFrame:
    """Rows with their looked-up columns; a row without a match is dropped.

    No hint: Spark broadcasts the lookup when its size is under the threshold and joins by
    sort otherwise, with AQE splitting heavy keys.
    """
    return rows.join(lookup, _list(key), "inner")


def match_replies(
    requests: DataFrame, replies: DataFrame, on: Sequence[tuple[str, str]]
) -> DataFrame:
    """Requests with their reply; ``answered`` is false where none came."""
    same = reduce(lambda a, b: a & b, [F.col(q) == F.col(r) for q, r in on])
    return requests.join(replies, same, "left").withColumn(
        "answered", F.col(on[0][1]).isNotNull()
    )


def match_in_order(
    requests: DataFrame,
    replies: DataFrame,
    channel: Names,
    request_order: Names,
    reply_order: Names,
    timeout_seconds: int,
) -> DataFrame:
    """The n-th request of a channel with its n-th reply (``n`` from 0); ``outcome`` tells how it went.

    Replies carry no id: a channel answers in the order it was asked.  A reply counts if it comes
    at the time of its request or up to the timeout after it (``answered``).  Otherwise, and where
    there is none, the request has a ``timeout`` row, without the columns of the reply, and the
    reply still takes its place in the order.  The first order column of each side is its time;
    other columns must differ between the sides.
    """
    by = _list(channel)
    asked = o.ordered(requests, by, request_order).add(n=o.index()).df
    told = o.ordered(replies, by, reply_order).add(n=o.index()).df
    both = asked.join(told, [*by, "n"], "left")
    first, then = (F.col(_list(c)[0]).cast("timestamp") for c in (request_order, reply_order))
    took = F.unix_micros(then) - F.unix_micros(first)
    in_time = F.coalesce(took.between(0, timeout_seconds * 1_000_000), F.lit(False))
    own = [c for c in told.columns if c not in [*by, "n"]]
    kept = both.withColumns({c: F.when(in_time, F.col(c)) for c in own} | {"outcome": F.when(in_time, "answered").otherwise("timeout")})
    return kept.select(*by, "n", *[c for c in asked.columns if c not in [*by, "n"]], *own, "outcome")


def pending(sent: DataFrame, acknowledged: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Sent rows without an acknowledgement."""
    same = reduce(lambda a, b: a & b, [F.col(s) == F.col(a) for s, a in on])
    return sent.join(acknowledged.select(*[a for _, a in on]), same, "left_anti")


def fan_out(df: DataFrame, branches: int, name: str = "branch") -> DataFrame:
    """Every row once per branch; a row-local explode, no join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))


def realign(
    derived: DataFrame, originals: DataFrame, by: Names, position: str, count: str
) -> DataFrame:
    """Derived line i with original line i; surplus lines with the last original.

    ``position`` is the 0-based line number on both sides, ``count`` the number of
    original lines of the group, present on the originals.
    """
    by = _list(by)
    sizes = originals.groupBy(*by).agg(F.max(count).alias("_n"))
    target = derived.join(sizes, by).withColumn(
        "_at", F.least(F.col(position), F.col("_n") - 1)
    )
    side = originals.drop(count).withColumnRenamed(position, "_at")
    return target.join(side, [*by, "_at"]).drop("_n", "_at")
