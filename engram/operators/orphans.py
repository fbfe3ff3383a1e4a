"""References to records that don't exist: pending-orphan state kept incrementally.

State is a parent index (target, key, first_seen) and the references, pending or resolved. A batch does three things:
its new references probe the index, its new parents resolve waiting references (as ``late`` where they arrived after
the reference), its deletions remove parents and reopen their references, which therefore stay in the state. What was
resolved is not probed again. A batch of any size gives the same final states, as times are compared, not batches. Null
and empty keys are dropped; repeated references and parents count once, at their earliest time.

``run`` keeps the state in checkpoints between the batches of one job. ``OrphanStore`` keeps it as tables by key bucket in
a shared folder for jobs and streams that come back: a batch reads and writes only the buckets of its own keys.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.session import cut, norm_key, salted_join

REF_ID = ["ref_table", "row_id", "ref_field", "ref_key"]


@dataclass(frozen=True)
class OrphanState:
    """parents: target, key, first_seen. refs: REF_ID, target, key, seen, parent_seen (null while pending)."""

    parents: DataFrame
    refs: DataFrame


def with_keys(refs: DataFrame) -> DataFrame:
    """References with comparable keys, once each at the earliest arrival."""
    keyed = refs.withColumn("key", norm_key(F.col("ref_key"))).where("key is not null and target is not null and row_id is not null")
    return keyed.groupBy(*REF_ID, "target", "key").agg(F.min("seen").alias("seen"))


def first_parents(parents: DataFrame) -> DataFrame:
    """(target, key, first_seen) of parent rows (target, id, seen)."""
    return parents.withColumn("key", norm_key(F.col("id"))).where("key is not null").groupBy("target", "key").agg(F.min("seen").alias("first_seen"))


def empty_state(refs: DataFrame, parents: DataFrame) -> OrphanState:
    none_p, none_r = first_parents(parents).limit(0), with_keys(refs).limit(0)
    return OrphanState(none_p, none_r.withColumn("parent_seen", F.lit(None).cast("timestamp")))


def advance(state: OrphanState, refs: DataFrame, parents: DataFrame, deleted: DataFrame | None = None) -> OrphanState:
    """The state after one batch of references, parents and deletions (target, id)."""
    index = state.parents.unionByName(first_parents(parents)).groupBy("target", "key").agg(F.min("first_seen").alias("first_seen"))
    if deleted is not None:
        gone = deleted.select("target", norm_key(F.col("id")).alias("key")).distinct()
        index = index.join(gone, ["target", "key"], "left_anti")
    known = state.refs.drop("parent_seen").unionByName(with_keys(refs))
    known = known.groupBy(*REF_ID, "target", "key").agg(F.min("seen").alias("seen"))
    found = salted_join(known, index, ["target", "key"]).withColumnRenamed("first_seen", "parent_seen")
    return replace(state, parents=index, refs=found)


def probe(state: OrphanState, refs: DataFrame, parents: DataFrame) -> OrphanState:
    """``advance`` without deletions for batches in order of arrival.

    New references probe the whole index, waiting ones only the parents that arrived; an index entry is kept once, at
    its earliest time, so the index is added to and not built again.
    """
    arrived = first_parents(parents).join(state.parents.select("target", "key"), ["target", "key"], "left_anti")
    seen = state.refs.where("parent_seen is not null")
    waiting = state.refs.where("parent_seen is null").drop("parent_seen")
    fresh = with_keys(refs).join(state.refs.select(*REF_ID), REF_ID, "left_anti")
    index = state.parents.unionByName(arrived)
    found = salted_join(fresh, index, ["target", "key"]).unionByName(salted_join(waiting, arrived, ["target", "key"]).select(*fresh.columns, "first_seen"))
    return replace(state, parents=index, refs=seen.unionByName(found.withColumnRenamed("first_seen", "parent_seen").select(seen.columns)))


def run(refs: DataFrame, parents: DataFrame, cuts: list) -> DataFrame:
    """Feeds the rows in order of arrival, in batches that end at each of ``cuts``; the state between two
    batches is a checkpoint. Returns all references with ``state``: absent, late or known."""
    state, low = empty_state(refs, parents), None
    for high in [*cuts, None]:
        within = F.lit(True) if low is None else (F.col("seen") >= F.lit(low))
        within = within if high is None else within & (F.col("seen") < F.lit(high))
        if low is None:
            within = within | F.col("seen").isNull()
        state = probe(state, refs.where(within), parents.where(within))
        if high is not None:
            state = OrphanState(cut(state.parents), cut(state.refs))
        low = high
    return labelled(state.refs)


def labelled(refs: DataFrame) -> DataFrame:
    """Adds ``state`` (absent, late or known) to references of a state."""
    return refs.withColumn("state", F.when(F.col("parent_seen").isNull(), "absent").when(F.col("parent_seen") > F.col("seen"), "late").otherwise("known"))


def open_counts(refs: DataFrame, period: str = "month") -> DataFrame:
    """Snapshots of the number of waiting references: (ref_table, ref_field, period, opened, resolved, open) per period.

    A reference waits from its arrival to its parent's, if that comes later; ``open`` is the running balance at the
    end of the period. Counts are summed by period before they meet, so a window holds one row a period.
    """
    waits = labelled(refs).where("state <> 'known' and seen is not null")
    moves = waits.select("ref_table", "ref_field", F.explode(F.array(
        F.struct(F.date_trunc(period, "seen").alias("period"), F.lit(1).alias("opened"), F.lit(0).alias("resolved")),
        F.struct(F.date_trunc(period, "parent_seen").alias("period"), F.lit(0).alias("opened"), F.lit(1).alias("resolved")))).alias("m")).select("ref_table", "ref_field", "m.*")
    sums = moves.where("period is not null").groupBy("ref_table", "ref_field", "period").agg(F.sum("opened").alias("opened"), F.sum("resolved").alias("resolved"))
    upto = Window.partitionBy("ref_table", "ref_field").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("open", F.sum(F.col("opened") - F.col("resolved")).over(upto))


class OrphanStore:
    """The state as parquet tables in a shared folder, by buckets of (target, key).

    ``apply`` reads only the buckets that a batch's keys fall into, writes these anew under the batch's number and then
    the list of current files, whose replacement is the commit. A batch that is applied again (a restarted stream gives
    its last one) starts from the list before it, so it changes nothing twice. One writer at a time.
    """

    PARENTS = "target string, key string, first_seen timestamp, bucket int"
    REFS = "ref_table string, row_id string, ref_field string, ref_key string, target string, key string, seen timestamp, parent_seen timestamp, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("target", "key"), F.lit(self.buckets)).cast("int"))

    def _lists(self) -> DataFrame:
        """(batch, bucket, kind, file) of all commits."""
        return self.spark.read.schema("batch bigint, bucket int, kind string, folder string").json(f"{self.path}/commits")

    def _current(self, before: int | None = None) -> dict[tuple[str, int], str]:
        """The folder of each bucket's parents and references; at most two a bucket."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return {}
        rows = self._lists().where(F.lit(True) if before is None else F.col("batch") < before)
        last = rows.groupBy("kind", "bucket").agg(F.max_by("folder", "batch").alias("folder")).collect()
        return {(r["kind"], r["bucket"]): r["folder"] for r in last}

    def _read(self, kind: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        schema, now = (self.PARENTS if kind == "parents" else self.REFS), self._current(before)
        at = [f for (k, b), f in now.items() if k == kind and (buckets is None or b in buckets)]
        plain = schema.rsplit(", ", 1)[0]
        return self._bucket(self.spark.read.schema(plain).parquet(*at)) if at else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """All references with their state."""
        return labelled(self._read("refs").drop("bucket"))

    def apply(self, batch: int, refs: DataFrame, parents: DataFrame, deleted: DataFrame | None = None) -> None:
        """One batch of references (REF_ID, target, seen), parents (target, id, seen) and deletions (target, id)."""
        news, arrived = self._bucket(with_keys(refs)).persist(), self._bucket(first_parents(parents)).persist()
        gone = self.spark.createDataFrame([], "target string, key string, bucket int")
        if deleted is not None:
            gone = self._bucket(deleted.select("target", norm_key(F.col("id")).alias("key")).where("key is not null").distinct())
        touched = sorted(r[0] for r in news.select("bucket").union(arrived.select("bucket")).union(gone.select("bucket")).distinct().collect())
        if touched:
            old = self._read("parents", touched, before=batch)
            index = old.unionByName(arrived).groupBy("target", "key", "bucket").agg(F.min("first_seen").alias("first_seen")).join(gone, ["target", "key", "bucket"], "left_anti")
            held = self._read("refs", touched, before=batch)
            waiting = held.join(gone, ["target", "key", "bucket"], "left_semi").unionByName(held.where("parent_seen is null")).drop("parent_seen").unionByName(news)
            waiting = waiting.groupBy(*REF_ID, "target", "key", "bucket").agg(F.min("seen").alias("seen"))
            settled = held.where("parent_seen is not null").join(gone, ["target", "key", "bucket"], "left_anti")
            fresh = waiting.join(settled.select(*REF_ID), REF_ID, "left_anti")
            found = salted_join(fresh, index, ["target", "key", "bucket"]).withColumnRenamed("first_seen", "parent_seen")
            rows = []
            for kind, table in (("parents", index), ("refs", settled.unionByName(found.select(settled.columns)))):
                table.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/batch={batch}")
                rows += [(batch, b, kind, f"{self.path}/{kind}/batch={batch}/bucket={b}") for b in touched]
            kept = {(r["bucket"], k) for k in ("parents", "refs") for r in self.spark.read.schema("target string, bucket int").parquet(f"{self.path}/{k}/batch={batch}").select("bucket").distinct().collect()}
            empty = f"{self.path}/empty/batch={batch}"
            self.spark.createDataFrame([], "target string").write.mode("overwrite").parquet(empty)
            rows = [(a, b, k, f if (b, k) in kept else empty) for a, b, k, f in rows]
            self.spark.createDataFrame(rows, "batch bigint, bucket int, kind string, folder string").coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/id={batch}")
        news.unpersist()
        arrived.unpersist()
