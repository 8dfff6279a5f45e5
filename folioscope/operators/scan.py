"""Prefix scans over long groups: rows are dealt by stretches of places, and each stretch is told what the ones before it add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a stretch. A task's work is a stretch, however long its group is.
STRETCH = 1 << 13


def scan(rows: DataFrame, group: str, place: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, stretch: int = STRETCH) -> DataFrame:
    """rows with running columns within each group by place: sums (of whole numbers, over the rows so far, this one included) and lasts (the last value so far that isn't null).

    A shuffle deals rows by (group, stretch of places); windows run within stretches. Each stretch's totals, a row for each,
    are scanned by group, and what they carry is joined to the stretch's rows, which lie where they are. Rows with a null
    place come first. Places are whole numbers; rows of one place count as peers in any order.
    """
    sums, lasts = sums or {}, lasts or {}
    # keys that are never null, so that the join below finds rows where the windows had them
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    found = rows.withColumn("_group", key).withColumn("_stretch", F.coalesce(F.floor(F.col(place) / stretch), F.lit(-(2**62)))).select("*", *[x.alias(f"_s_{k}") for k, x in sums.items()], *[x.alias(f"_l_{k}") for k, x in lasts.items()])
    so_far = Window.partitionBy("_group", "_stretch").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = found.select("*", *[F.sum(f"_s_{k}").over(so_far).alias(f"_in_{k}") for k in sums], *[F.last(f"_l_{k}", ignorenulls=True).over(so_far).alias(f"_in_{k}") for k in lasts])
    # the last of a stretch is its row of the greatest place that has a value
    totals = found.groupBy("_group", "_stretch").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums], *[F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.coalesce(F.col(place), F.lit(-(2**63))))).alias(f"_t_{k}") for k in lasts])
    before = Window.partitionBy("_group").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_group", "_stretch", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in sums], *[F.last(f"_t_{k}", ignorenulls=True).over(before).alias(f"_c_{k}") for k in lasts])
    out = local.join(carried, ["_group", "_stretch"])
    made = [(F.col(f"_c_{k}") + F.coalesce(f"_in_{k}", F.lit(0))).alias(k) for k in sums] + [F.coalesce(f"_in_{k}", f"_c_{k}").alias(k) for k in lasts]
    return out.select(*[F.col(c) for c in rows.columns], *made)
