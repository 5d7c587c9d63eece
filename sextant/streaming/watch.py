"""Operators over streams of change events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, key: str, time: str, order: str, seconds: float) -> DataFrame:
    """key and order of the events that stay: the first of a key, and each that is `seconds` or more after the last kept one.

    On a batch, each key's times are folded in order as one array; the fold's state is the last kept time.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(micros.alias("t"), F.col(order).alias("o")))).alias("e"))
    empty = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        keep = acc["last"].isNull() | (x["t"] - acc["last"] >= int(seconds * 1_000_000))
        return F.struct(F.when(keep, x["t"]).otherwise(acc["last"]).alias("last"), F.when(keep, F.concat(acc["kept"], F.array(x["o"].cast("long")))).otherwise(acc["kept"]).alias("kept"))

    return rows.select(key, F.explode(F.aggregate("e", empty, step, lambda a: a["kept"])).alias(order))


def debounce_stream(events: DataFrame, key: str, time: str, order: str, seconds: float) -> DataFrame:
    """The same on a stream (append mode): the last kept time of each key is its state; events of one micro-batch are taken in order."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t, o in sorted((t.value, o) for f in frames for t, o in zip(f[time], f[order], strict=True)):
            if last is None or t - last >= seconds * 1e9:
                last = t
                kept.append(int(o))
        state.update((int(last),))
        yield pd.DataFrame({key: [name[0]] * len(kept), order: kept})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long", "last long", "append", GroupStateTimeout.NoTimeout)
