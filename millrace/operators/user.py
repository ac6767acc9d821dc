"""User functions in Python, run by Spark in Arrow batches.

Column expressions stay the first choice; these are for what they cannot say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

# An odd step, so that the first batches of neighbouring partitions take different lanes.
LANE_STEP = 7919


class RowsFailed(Exception):
    """Raised by a function on batches that knows its failing rows: ``rest`` is the result of the others."""

    def __init__(self, rest: pd.DataFrame):
        super().__init__("rows failed")
        self.rest = rest


def each_row(function: Callable[[tuple], tuple], columns: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of one row (a named tuple) as one on batches; ``columns`` name what it returns.

    Every row is tried by itself, so rows that fail cost no further calls, however many they are.
    """

    def on_batch(batch: pd.DataFrame) -> pd.DataFrame:
        done, first = [], None
        for row in batch.itertuples(index=False, name="Row"):
            try:
                done.append(function(row))
            except Exception as failure:  # whatever the user's function raises
                first = first or failure
        rest = pd.DataFrame(done, columns=list(columns))
        if first is not None:
            raise RowsFailed(rest) from first
        return rest

    return on_batch


def map_batches(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    skip_failing: bool = False,
) -> DataFrame:
    """A function on batches of rows, as many at once as there are partitions.

    It may return more or fewer rows than it gets (map, filter, flatten).  With
    ``skip_failing`` a batch for which it raises is halved until the rows that fail stand
    alone; those are left out, and the others go on.  That takes about one call per row where
    many fail, so a function that can name its failing rows (``each_row``) is not called again.
    """

    def results(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            yield function(batch)
        except RowsFailed as failed:
            if not skip_failing:
                raise failed.__cause__ or failed
            yield failed.rest
        except Exception:  # whatever the user's function raises
            if not skip_failing:
                raise
            half = len(batch) // 2
            if half:
                yield from results(batch.iloc[:half])
                yield from results(batch.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # what is left of a batch goes on as one again
            found = list(results(batch))
            if found:
                yield found[0] if len(found) == 1 else pd.concat(found, ignore_index=True)

    return df.mapInPandas(run, schema)


def fold_per_key(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    state_schema: str,
    fold: Callable[[pd.DataFrame], dict],
    merge: Callable[[pd.DataFrame], dict],
    fan_in: int = 1000,
) -> DataFrame:
    """A user aggregate: ``fold`` turns rows of a key into a state, ``merge`` states into one.

    Every Arrow batch is folded per key before the shuffle.  The states of a key are merged
    in two steps, first in ``fan_in`` lanes side by side and then those, so the states of a
    heavy key do not meet in one task at once.  The lane goes by the place of the batch, not by
    the state, so that equal states are spread as well.
    """
    key_type = df.select(key).schema[0].dataType.simpleString()
    schema = f"{key} {key_type}, {state_schema}"

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            if len(batch):
                lane = (partition * LANE_STEP + n) % fan_in
                rows = [{key: k, **fold(g), "_lane": lane} for k, g in batch.groupby(key, dropna=False)]
                yield pd.DataFrame(rows)

    def merged(group: tuple, states: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{key: group[0], **merge(states)}])

    states = df.select(key, *columns).mapInPandas(per_batch, f"{schema}, _lane BIGINT")
    first = states.groupBy(key, "_lane").applyInPandas(merged, schema)
    return first.groupBy(key).applyInPandas(merged, schema)
