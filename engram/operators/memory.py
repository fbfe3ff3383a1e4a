"""Merging, scoring, forgetting and change history of memory records, as aggregations and counts that meet their rows.

What a group decides is one row per group, made by aggregates that combine where rows are read, so a subject or
predicate of a third of all rows is no task of its own. Times are arguments. Ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import bounded_join, cut

DAY_US = 86_400_000_000
# Predicates with one value at a time.
SINGULAR = ("has_name", "works_at", "lives_in", "timezone", "is_a")


def norm(c: Column) -> Column:
    """Lower case without blanks around."""
    return F.lower(F.regexp_replace(c, "^[ ]+|[ ]+$", ""))


def ordered_union(lists: Column, order: Column) -> Column:
    """Distinct elements of arrays in the order of ``order``; an aggregate."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(lists, F.array().cast("array<string>")).alias("l")))), lambda x: x["l"])))


def merge(rows: DataFrame, key: list[Column], order: list[str], evidence: str | None = None, last: str | None = None) -> DataFrame:
    """One row per key: the first by ``order``, its confidence plus 0.1 per further row, at most 1; evidence united in that order."""
    named = [c.alias(f"_k{i}") for i, c in enumerate(key)]
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != evidence]), F.struct(*order)).alias("f")
    aggs = [first, F.count("*").alias("n")] + ([ordered_union(F.col(evidence), F.struct(*order)).alias("evidence")] if evidence else []) + ([F.max(last).alias("last")] if last else [])
    merged = rows.groupBy(*named).agg(*aggs)
    sure = F.round(F.least(F.lit(1.0), F.col("f.confidence") + 0.1 * (F.col("n") - 1)), 6)
    return merged.select("f.*", "n", sure.alias("merged_confidence"), *[c for c, on in (("evidence", evidence), ("last", last)) if on])


def best_rank(with_evidence: bool = True) -> Column:
    """Order of trust: affirmed, confidence, number of evidence, length of the object; the greatest wins, then the smallest id."""
    parts = [F.coalesce("user_affirmed", F.lit(False)), F.coalesce("confidence", F.lit(-1.0))] + ([F.size("evidence")] if with_evidence else []) + [F.length("object")]
    return F.struct(*[p.alias(f"r{i}") for i, p in enumerate(parts)])


def top_by(rows: DataFrame, key: list[Column], rank: Column) -> DataFrame:
    """(keys, best, n, rank) of each group: the id of the greatest rank, of equals the smallest id."""
    named = rows.select(*key, rank.alias("_rank"), "id")
    names = named.columns[:len(key)]
    halves = named.groupBy(*names, "_rank").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return halves.groupBy(*names).agg(F.max_by("id", "_rank").alias("best"), F.sum("n").alias("n"), F.max("_rank").alias("rank"))


def contradictions(facts: DataFrame, predicates: tuple[str, ...] = SINGULAR) -> DataFrame:
    """(id, winner) of active facts of one agent, subject and single-valued predicate that state different objects.

    The winner is affirmed, last confirmed, most confident, best evidenced, then of the smallest id; every fact of the
    class names it, instead of all pairs.
    """
    rows = facts.where(F.col("is_active") & F.col("predicate").isin(*predicates))
    rank = F.struct(F.coalesce("user_affirmed", F.lit(False)).alias("a"), F.coalesce(F.unix_micros("last_confirmed"), F.lit(-1)).alias("t"), F.coalesce("confidence", F.lit(0.0)).alias("c"), F.size("evidence").alias("e"))
    key = ["agent_id", "subject", "predicate"]
    best = rows.groupBy(*key).agg(F.min("object").alias("lo"), F.max("object").alias("hi"), F.max(rank).alias("top")).where("lo <> hi").select(*key, "top")
    met = bounded_join(rows.select("id", *key, rank.alias("_rank")), best, key, "inner")
    winner = met.where(F.col("_rank") == F.col("top")).groupBy(*key).agg(F.min("id").alias("winner"))
    return bounded_join(met.select("id", *key), winner, key, "inner").select("id", "winner")


def retention(rows: DataFrame, group: Column, causal: Column, trust: Column, keep: Column, spread: float, as_of: Column) -> DataFrame:
    """(id, score) of rows with created_at, access_count: use, trust, causal weight, age, how many share the group, kind.

    Groups are counted and the counts meet the rows, by broadcast or in salted shares, so no group is one task.
    """
    age = F.greatest((F.unix_micros(as_of) - F.unix_micros("created_at")) / DAY_US, F.lit(0.0))
    held = rows.withColumn("_g", group)
    counts = held.groupBy("_g").agg(F.count("*").alias("_n")).where("_g is not null")
    met = bounded_join(held, counts, ["_g"])
    score = (0.2 * F.least(F.col("access_count") / F.greatest(age, F.lit(1.0)), F.lit(1.0)) + 0.15 * F.coalesce(trust, F.lit(0.0)) + 0.25 * causal + 0.15 * F.exp(-age / 30.0)
             + 0.15 * F.exp(-(F.coalesce("_n", F.lit(1)) - 1) / spread) + 0.1 * keep)
    return met.select("id", F.round(score, 6).alias("score"))


def change_log(facts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Append-only events (fact_id, at, kind, confidence): assert at creation, modify where a snapshot's confidence is new, retract.

    Updates in place become events; a state at any time is a query over them.
    """
    made = facts.select(F.col("id").alias("fact_id"), F.col("created_at").alias("at"), F.lit("assert").alias("kind"), "confidence")
    gone = facts.where("not is_active").select(F.col("id").alias("fact_id"), F.col("updated_at").alias("at"), F.lit("retract").alias("kind"), F.lit(0.0).alias("confidence"))
    taken = snapshots.where("snapshot_at is not null and confidence between 0 and 1").groupBy("fact_id", "snapshot_at").agg(F.max_by("confidence", F.struct("ingested_at", "confidence")).alias("confidence"))
    before = F.lag("confidence").over(Window.partitionBy("fact_id").orderBy("snapshot_at"))
    changed = taken.withColumn("_was", before).where(F.col("_was").isNotNull() & (F.col("_was") != F.col("confidence")))
    return made.unionByName(gone).unionByName(changed.select("fact_id", F.col("snapshot_at").alias("at"), F.lit("modify").alias("kind"), "confidence")).where("at is not null")


def as_of(log: DataFrame, at: Column) -> DataFrame:
    """(fact_id, confidence, since) that held at a time: the last event until then, unless it retracts. Of one time the
    retraction counts after the modification, that after the assertion."""
    order = F.struct("at", F.when(F.col("kind") == "assert", 0).when(F.col("kind") == "modify", 1).otherwise(2).alias("o"), F.coalesce("confidence", F.lit(-1.0)).alias("c"))
    last = log.where(F.col("at") <= at).groupBy("fact_id").agg(F.max_by(F.struct("kind", "confidence", "at"), order).alias("e"), F.max(F.col("kind") == "assert").alias("made"))
    return last.where("made and e.kind <> 'retract'").select("fact_id", F.col("e.confidence").alias("confidence"), F.col("e.at").alias("since"))


def snapshot_changes(log: DataFrame, low: Column, high: Column) -> DataFrame:
    """(fact_id, change) between two times: added, removed or modified."""
    a, b = as_of(log, low).select("fact_id", F.struct("confidence").alias("a")), as_of(log, high).select("fact_id", F.struct("confidence").alias("b"))
    both = a.join(b, "fact_id", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.select("fact_id", change.alias("change")).where("change is not null")


def throttle(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(id) of events (id, key, at) that are admitted: the first of a key, then each that is ``minutes`` after the last admitted one.

    Gaps of that length always admit, so keys are split there and stretches are folded apart; rows stream through a fold
    in order, which holds one time.
    """
    step = minutes * 60_000_000
    us = F.unix_micros("at")
    gap = F.when(us - F.lag(us).over(Window.partitionBy("key").orderBy("at", "id")) < step, 0).otherwise(1)
    parts = events.where("at is not null").withColumn("_new", gap).withColumn("_part", F.sum("_new").over(Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)))
    kind = events.schema["id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, 0
        for pdf in batches:
            out = []
            for key, part, us_, i in zip(pdf["key"], pdf["_part"], pdf["us"], pdf["id"]):
                if (key, part) != at or us_ - last >= step:
                    at, last = (key, part), us_
                    out.append(i)
            yield pd.DataFrame({"id": out})

    return parts.select("key", "_part", us.alias("us"), "id").repartition("key", "_part").sortWithinPartitions("key", "_part", "us", "id").mapInPandas(fold, f"id {kind}")


def fixed_window(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(id, admitted) of events (id, key, at): at most ``limit`` in windows that open at the first request after the last one's end.

    As in ``throttle``, keys are split at gaps of the window's length, where a new window always opens.
    """
    step = seconds * 1_000_000
    us = F.unix_micros("at")
    gap = F.when(us - F.lag(us).over(Window.partitionBy("key").orderBy("at", "id")) < step, 0).otherwise(1)
    parts = events.where("at is not null").withColumn("_new", gap).withColumn("_part", F.sum("_new").over(Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)))
    kind = events.schema["id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, start, n = None, 0, 0
        for pdf in batches:
            ok = []
            for key, part, us_ in zip(pdf["key"], pdf["_part"], pdf["us"]):
                if (key, part) != at or us_ - start >= step:
                    at, start, n = (key, part), us_, 0
                n += 1
                ok.append(n <= limit)
            yield pd.DataFrame({"id": pdf["id"], "admitted": ok})

    return parts.select("key", "_part", us.alias("us"), "id").repartition("key", "_part").sortWithinPartitions("key", "_part", "us", "id").mapInPandas(fold, f"id {kind}, admitted boolean")


def hash_chain(rows: DataFrame, order: list[str]) -> DataFrame:
    """Audit chain of rows (id, part, content): (id, part, place, chained), each hash over the one before and the content.

    Parts (such as an agent's day) are chains of their own, so they are made apart; ``part_anchors`` chains their last hashes.
    """
    import hashlib

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h, n = None, "", 0
        for pdf in batches:
            out = []
            for part, i, content in zip(pdf["part"], pdf["id"], pdf["content"]):
                if part != at:
                    at, h, n = part, "", 0
                h, n = hashlib.sha256((h + content).encode()).hexdigest(), n + 1
                out.append((i, part, n, h))
            yield pd.DataFrame(out, columns=["id", "part", "place", "chained"])

    ordered = rows.repartition("part").sortWithinPartitions("part", *order).select("part", "id", F.coalesce("content", F.lit("")).alias("content"))
    return ordered.mapInPandas(fold, "id string, part string, place bigint, chained string")


def verify_chain(chain: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, part) of links of a stored chain (id, part, place, chained) whose hash isn't that of the one before and the content.

    A change of content breaks its own link, a change of a hash its own and the next one.
    """
    before = F.coalesce(F.lag("chained").over(Window.partitionBy("part").orderBy("place")), F.lit(""))
    met = chain.withColumn("_before", before).join(rows.select("id", F.col("part"), F.coalesce("content", F.lit("")).alias("content")), ["id", "part"], "left")
    return met.where(~F.col("chained").eqNullSafe(F.sha2(F.concat("_before", "content"), 256))).select("id", "part")


def part_anchors(chain: DataFrame) -> DataFrame:
    """(part, n, anchor): length and last hash of each part, so a change anywhere in it shows."""
    return chain.groupBy("part").agg(F.count("*").alias("n"), F.max_by("chained", "place").alias("anchor"))


def floor_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], pieces: int = 256) -> DataFrame:
    """(key, <name> ...): the value at index floor(n share) of each key's sorted values.

    Values are counted by ranges between approximate quantiles; only the ranges that hold a wanted index are sorted.
    """
    held = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    edges = held.groupBy("k").agg(F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 10_000).alias("edges"), F.count("*").alias("n"))
    placed = bounded_join(held, edges, ["k"], "inner").withColumn("piece", F.size(F.filter("edges", lambda e: e < F.col("v"))))
    upto = F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cut(placed.groupBy("k", "piece").agg(F.count("*").alias("c"), F.first("n").alias("n")).withColumn("low", upto))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.col("n") * share).alias("i")) for name, share in shares.items()])
    hits = sizes.select("k", "piece", "low", "c", F.explode(wanted).alias("w")).where((F.col("w.i") >= F.col("low")) & (F.col("w.i") < F.col("low") + F.col("c"))).select("k", "piece", "low", "w.name", "w.i")
    sorted_ = bounded_join(placed.select("k", "piece", "v"), hits, ["k", "piece"], "inner").groupBy("k", "name").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("i").alias("i"), F.first("low").alias("low"))
    at = F.element_at("vs", (F.col("i") - F.col("low") + 1).cast("int"))
    return sorted_.select("k", "name", at.alias("x")).groupBy(F.col("k").alias(key)).pivot("name", list(shares)).agg(F.first("x"))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """(case, a, b, score): pairs (case, a, b, score) taken from the best on while both sides are free; cases are folded apart."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, right = None, set(), set()
        for pdf in batches:
            out = []
            for case, a, b, score in zip(pdf["case"], pdf["a"], pdf["b"], pdf["score"]):
                if case != at:
                    at, left, right = case, set(), set()
                if a not in left and b not in right:
                    left.add(a)
                    right.add(b)
                    out.append((case, a, b, score))
            yield pd.DataFrame(out, columns=["case", "a", "b", "score"])

    ordered = pairs.select("case", "a", "b", "score").repartition("case").sortWithinPartitions("case", F.desc("score"), "a", "b")
    return ordered.mapInPandas(fold, "case string, a string, b string, score double")


def fuzzy(a: Column, b: Column) -> Column:
    """Likeness of two texts: equal 1, held 0.9, else the better of word and letter overlap."""
    x, y = (F.lower(F.trim(F.translate(c, "İ", "i"))) for c in (a, b))

    def overlap(p: Column, q: Column) -> Column:
        both = F.size(F.array_union(p, q))
        return F.when(both > 0, F.size(F.array_intersect(p, q)) / both).otherwise(0.0)

    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda w: w != ""))
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.9).otherwise(F.greatest(overlap(words(x), words(y)), overlap(letters(x), letters(y))))


def laplace(key: Column, scale: float, seed: int) -> Column:
    """Noise of a Laplace distribution from a hash of ``key`` and the seed, the same in every run."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) + 0.5) / (1 << 40) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))
