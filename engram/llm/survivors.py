"""Best representative of each duplicate group: field-by-field survivorship in a single aggregation.

Per field the maximum of a composite struct (possible, source priority, time, value, smallest id) supplies the
surviving value. Null, impossible and missing values never win; a field without any possible value gives no row; of
equal values the smallest id supplies it. Priority and time rank above the value where the caller gives them.
Replayed rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.statements import canonical


def fields() -> dict[str, tuple[Column, Column]]:
    c = F.col
    return {
        "confidence": (c("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), -c("confidence")),
        "last_confirmed": ((c("last_confirmed") >= c("first_seen")) & (c("last_confirmed") <= c("updated_at")), -F.unix_micros(c("last_confirmed").cast("timestamp"))),
        "user_affirmed": (c("user_affirmed").isNotNull(), -c("user_affirmed").cast("int")),
        "access_count": (c("access_count") >= 0, -c("access_count")),
    }


def survivors(facts: DataFrame, priority: Column | None = None, stamp: Column | None = None) -> DataFrame:
    """(group_id, <field> struct of value and id ...) of every statement with two or more ids.

    ``priority`` (a number, higher is more trusted) and ``stamp`` (later is better) are columns of the rows.
    """
    keyed = canonical(facts.where("id is not null")).withColumn("_k", F.sha2("canon", 256))
    trust = F.lit(0) if priority is None else -F.coalesce(priority, F.lit(float("-inf")))
    late = F.lit(0) if stamp is None else -F.coalesce(F.unix_micros(stamp.cast("timestamp")), F.lit(-(1 << 62)))
    best = []
    for name, (possible, rank) in fields().items():
        # The least of the negated parts is the greatest of the parts with the smallest id; nulls are skipped by min.
        parts = F.struct(trust.alias("p"), late.alias("t"), rank.alias("r"), F.col("id").alias("id"), F.col(name).alias("value"))
        best.append(F.min(F.when(possible, parts)).alias(name))
    groups = keyed.groupBy("_k").agg(F.min("id").alias("group_id"), F.max("id").alias("_last"), *best)
    return groups.where("group_id <> _last").drop("_last", "_k")


def suppliers(facts: DataFrame) -> DataFrame:
    """(group_id, field_name, fact_id): who supplies each surviving value; the value alone decides."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"{n}.id").alias("fact_id")) for n in fields()]))
    return survivors(facts).select("group_id", rows.alias("x")).select("group_id", "x.field_name", "x.fact_id").where("fact_id is not null")
