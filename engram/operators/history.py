"""History of changing attributes from periodic snapshots.

Per attribute a change log with its own intervals; the versions of an entity are these logs split at the
union of their boundaries, and equal neighbours coalesced. Of several deliveries of one entity and time the
one ingested last holds (of equals the greatest values). Null is a value; missing periods change nothing;
rows without entity or time are dropped. An entity's rows are first reduced to one per time and then to its
changes within blocks of time, so a hot entity is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, key: str, at: str, arrived: str, attrs: list[str]) -> DataFrame:
    """One row per entity and snapshot time, by a map-side combinable maximum."""
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    best = F.max(F.struct(F.col(arrived), *[F.col(a) for a in attrs])).alias("_best")
    return rows.groupBy(F.col(key).alias("entity"), F.col(at).alias("at")).agg(best).select("entity", "at", *[F.col(f"_best.{a}").alias(a) for a in attrs])


def change_log(states: DataFrame, attrs: list[str], block: str = "quarter") -> DataFrame:
    """(entity, attr, value, valid_from, valid_to): each attribute's own intervals. Values are text.

    Within blocks of time rows equal to the one before are dropped, before what remains meets by entity: the rows are
    dealt by entity and block and then by entity, and all later windows and groups use that.
    """
    dealt = states.withColumn("_b", F.date_trunc(block, "at")).repartition("entity", "_b")
    logs = dealt.select("entity", "at", "_b", F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])).alias("x"))
    logs = logs.select("entity", "at", "_b", "x.attr", "x.value")
    local = Window.partitionBy("entity", "attr", "_b").orderBy("at")
    first = F.row_number().over(local) == 1
    kept = logs.withColumn("_keep", first | ~F.lag("value").over(local).eqNullSafe(F.col("value"))).where("_keep").drop("_keep", "_b").repartition("entity")
    whole = Window.partitionBy("entity", "attr").orderBy("at")
    first = F.row_number().over(whole) == 1
    kept = kept.withColumn("_keep", first | ~F.lag("value").over(whole).eqNullSafe(F.col("value"))).where("_keep").drop("_keep")
    return kept.select("entity", "attr", "value", F.col("at").alias("valid_from"), F.lead("at").over(whole).alias("valid_to"))


def versions(log: DataFrame, attrs: list[str]) -> DataFrame:
    """Versions of all attributes together: (entity, valid_from, valid_to, attributes as text)."""
    bounds = log.groupBy("entity", F.col("valid_from").alias("at")).agg(
        *[F.max(F.when(F.col("attr") == a, F.struct(F.col("value")))).alias(a) for a in attrs])
    order = Window.partitionBy("entity").orderBy("at")
    filled = bounds.select("entity", "at", *[F.last(a, ignorenulls=True).over(order).alias(a) for a in attrs])
    same = F.lit(True)
    for a in attrs:
        same = same & F.lag(a).over(order).eqNullSafe(F.col(a))
    starts = filled.withColumn("_same", same & (F.row_number().over(order) > 1)).where("not _same").drop("_same")
    return starts.select("entity", F.col("at").alias("valid_from"), F.lead("at").over(order).alias("valid_to"), *[F.col(f"{a}.value").alias(a) for a in attrs])
