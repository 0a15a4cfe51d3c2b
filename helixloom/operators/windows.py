"""Window operators over ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_spans(events: DataFrame, keys: list[str], window: int, most: int, longest: int = 0) -> DataFrame:
    """keys, k, total, st, en of the events (keys, k: the order, pos, len, cnt) at which the counts of the window behind exceed `most`.

    In a window lie the event itself and those before whose last base is within `window`. A range frame over positions holds them all, with
    `longest` (the longest event) added; in it, each one's own end is checked. What a window holds bounds its array.
    """
    order = Window.partitionBy(*keys).orderBy("pos").rangeBetween(-(window + longest), 0)
    near = F.collect_list(F.struct("k", "pos", "len", "cnt")).over(order)
    rows = (
        events.withColumn(
            "_near",
            F.filter(near, lambda e: (e["k"] <= F.col("k")) & ((e["k"] == F.col("k")) | (e["pos"] + e["len"] - 1 > F.col("pos") - window))),
        )
    )
    total = F.aggregate("_near", F.lit(0).cast("long"), lambda s, e: s + e["cnt"].cast("long"))
    out = (
        rows.select(
            *keys, "k", total.alias("total"), F.array_min(F.transform("_near", lambda e: e["pos"])).alias("st"),
            (F.col("pos") + F.col("len")).alias("en"),
        )
    )
    return out.filter(F.col("total") > most)
