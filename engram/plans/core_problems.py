"""Queries of the general data-quality problems: p2 (references), p4 (timestamps), p7 (history)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import history, orphans, timestamps
from engram.session import cut, fill_cores

#: (table, its id, where the row came from)
TS_TABLES = (("raw_messages", "msg_id"), ("sheep_episodes", "id"), ("memory_requests", "request_id"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, row_id, agent_id, ts) of every table with received time texts."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(k).alias("row_id"), "agent_id", "ts") for t, k in TS_TABLES]
    return fill_cores(parts[0].unionByName(parts[1]).unionByName(parts[2]), "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of the time texts that aren't in the canonical form."""
    rows = stated_times(spark, sf_dir).where(~F.col("ts").rlike(timestamps.CANONICAL))
    out = timestamps.normalise(rows, table(spark, sf_dir, "agents")).where(F.col("status") == "resolved")
    return out.select(F.col("source").alias("source_table"), "row_id", "epoch_ms").distinct()


def p4_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table, format and status over all time texts."""
    out = timestamps.normalise(stated_times(spark, sf_dir), table(spark, sf_dir, "agents"))
    return out.groupBy(F.col("source").alias("source_table"), "format", "status").agg(F.count("*").alias("n_rows"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_table, row_id, ref_field, ref_key, target, seen) of links and episodes."""
    links, eps = table(spark, sf_dir, "sheep_causal_links"), table(spark, sf_dir, "sheep_episodes")
    target = lambda c: F.when(F.lower(F.trim(c)) == "fact", "sheep_facts").when(F.lower(F.trim(c)) == "episode", "sheep_episodes")
    ends = F.explode(F.array(*[F.struct(F.lit(f"{x}_id").alias("f"), F.col(f"{x}_id").alias("k"), target(F.col(f"{x}_type")).alias("t")) for x in ("cause", "effect")]))
    a = links.select(F.lit("sheep_causal_links").alias("ref_table"), F.col("id").alias("row_id"), ends.alias("e"), F.col("ingested_at").cast("timestamp").alias("seen"))
    a = a.select("ref_table", "row_id", F.col("e.f").alias("ref_field"), F.col("e.k").alias("ref_key"), F.col("e.t").alias("target"), "seen")
    b = eps.select(F.lit("sheep_episodes").alias("ref_table"), F.col("id").alias("row_id"), F.lit("source_message_ids").alias("ref_field"),
                   F.explode("source_message_ids").alias("ref_key"), F.lit("raw_messages").alias("target"), F.col("ingested_at").cast("timestamp").alias("seen"))
    return a.unionByName(b)


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, id, seen) of all referable rows."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("target"), F.col(k).alias("id"), F.col("ingested_at").cast("timestamp").alias("seen"))
             for t, k in (("sheep_facts", "id"), ("sheep_episodes", "id"), ("raw_messages", "msg_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _reference_states(spark: SparkSession, sf_dir: str, batches: int = 2) -> DataFrame:
    """All references with their state, fed in ``batches`` of arrival time."""
    low, high = table(spark, sf_dir, "sheep_causal_links").agg(F.min("ingested_at"), F.max("ingested_at")).first()
    cuts = [low + (high - low) * i / batches for i in range(1, batches)] if low else []
    return orphans.run(references(spark, sf_dir), parents(spark, sf_dir), cuts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to rows that are absent or came later."""
    out = _reference_states(spark, sf_dir).where("state in ('absent', 'late')")
    return out.select("ref_table", "row_id", "ref_field", "ref_key", "state").distinct()


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References per table, field, month of arrival and state."""
    out = _reference_states(spark, sf_dir)
    return out.groupBy("ref_table", "ref_field", F.date_format("seen", "yyyy-MM").alias("period"), "state").agg(F.count("*").alias("n_refs"))


def p2_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting references per table, field and month of arrival: opened, resolved, open at its end."""
    return orphans.open_counts(_reference_states(spark, sf_dir)).select("ref_table", "ref_field", F.date_format("period", "yyyy-MM").alias("period"), "opened", "resolved", "open")


def p2_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that were resolved and are orphans again once the retracted facts are deleted."""
    state = orphans.advance(orphans.empty_state(references(spark, sf_dir), parents(spark, sf_dir)), references(spark, sf_dir), parents(spark, sf_dir))
    state = orphans.OrphanState(cut(state.parents), cut(state.refs))
    facts = table(spark, sf_dir, "sheep_facts")
    after = orphans.advance(state, references(spark, sf_dir).limit(0), parents(spark, sf_dir).limit(0), facts.where("not is_active").select(F.lit("sheep_facts").alias("target"), "id"))
    was = state.refs.where("parent_seen is not null").select(*orphans.REF_ID)
    return after.refs.where("parent_seen is null").select(*orphans.REF_ID).join(was, orphans.REF_ID, "left_semi").distinct()


ATTRS = ["first_seen", "last_confirmed", "is_active", "retracted_reason"]


def p7_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each fact with the attributes that held (as text)."""
    snaps = table(spark, sf_dir, "sheep_fact_snapshots").withColumn("retracted_reason", F.lower(F.regexp_replace("retracted_reason", r"(?U)^\s+|\s+$", "")))
    states = history.latest_delivery(snaps, "fact_id", "snapshot_at", "ingested_at", ATTRS)
    return history.versions(history.change_log(states, ATTRS), ATTRS).withColumnRenamed("entity", "fact_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each fact: valid_to_ms is -1 for the last."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return p7_versions(spark, sf_dir).select("fact_id", ms("valid_from").alias("valid_from_ms"), F.coalesce(ms("valid_to"), F.lit(-1)).cast("bigint").alias("valid_to_ms"))


QUERIES = {
    "p2_found": p2_found, "p2_periods": p2_periods, "p2_snapshots": p2_snapshots, "p2_reopened": p2_reopened, "p4_found": p4_found, "p4_status": p4_status, "p7_found": p7_found, "p7_versions": p7_versions}

ORACLES = {
    "p2_found": r"""
with refs as (
  select 'sheep_causal_links' ref_table, id row_id, 'cause_id' ref_field, cause_id ref_key, lower(trim(cause_type)) t, ingested_at seen from sheep_causal_links
  union all select 'sheep_causal_links', id, 'effect_id', effect_id, lower(trim(effect_type)), ingested_at from sheep_causal_links
  union all select 'sheep_episodes', id, 'source_message_ids', unnest(source_message_ids), 'message', ingested_at from sheep_episodes),
r as (select ref_table, row_id, ref_field, ref_key, t, min(seen) seen from refs
  where t in ('fact', 'episode', 'message') and regexp_replace(ref_key, '^\s+|\s+$', '', 'g') <> '' group by all),
pa as (select 'fact' t, id k, ingested_at seen from sheep_facts union all select 'episode', id, ingested_at from sheep_episodes
  union all select 'message', msg_id, ingested_at from raw_messages),
p as (select t, lower(regexp_replace(k, '^\s+|\s+$', '', 'g')) k, min(seen) first_seen from pa group by all)
select distinct ref_table, row_id, ref_field, ref_key, case when first_seen is null then 'absent' else 'late' end as state
from r left join p on p.t = r.t and p.k = lower(regexp_replace(ref_key, '^\s+|\s+$', '', 'g'))
where first_seen is null or first_seen > seen""",
    "p2_reopened": r"""
with refs as (
  select 'sheep_causal_links' ref_table, id row_id, 'cause_id' ref_field, cause_id ref_key, lower(trim(cause_type)) t from sheep_causal_links
  union all select 'sheep_causal_links', id, 'effect_id', effect_id, lower(trim(effect_type)) from sheep_causal_links)
select distinct ref_table, row_id, ref_field, ref_key from refs
where t = 'fact' and lower(regexp_replace(ref_key, '^\s+|\s+$', '', 'g')) in (select lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) from sheep_facts where not is_active)""",
    "p2_snapshots": r"""
with refs as (
  select 'sheep_causal_links' ref_table, id row_id, 'cause_id' ref_field, cause_id ref_key, lower(trim(cause_type)) t, ingested_at seen from sheep_causal_links
  union all select 'sheep_causal_links', id, 'effect_id', effect_id, lower(trim(effect_type)), ingested_at from sheep_causal_links
  union all select 'sheep_episodes', id, 'source_message_ids', unnest(source_message_ids), 'message', ingested_at from sheep_episodes),
r as (select ref_table, row_id, ref_field, ref_key, t, min(seen) seen from refs
  where t in ('fact', 'episode', 'message') and regexp_replace(ref_key, '^\s+|\s+$', '', 'g') <> '' group by all),
pa as (select 'fact' t, id k, ingested_at seen from sheep_facts union all select 'episode', id, ingested_at from sheep_episodes
  union all select 'message', msg_id, ingested_at from raw_messages),
p as (select t, lower(regexp_replace(k, '^\s+|\s+$', '', 'g')) k, min(seen) first_seen from pa group by all),
o as (select ref_table, ref_field, seen, first_seen from r left join p on p.t = r.t and p.k = lower(regexp_replace(ref_key, '^\s+|\s+$', '', 'g')) where (first_seen is null or first_seen > seen) and seen is not null),
m as (select ref_table, ref_field, strftime(seen, '%Y-%m') period, 1 a, 0 b from o union all select ref_table, ref_field, strftime(first_seen, '%Y-%m'), 0, 1 from o where first_seen is not null),
s as (select ref_table, ref_field, period, sum(a)::bigint opened, sum(b)::bigint resolved from m group by all)
select *, sum(opened - resolved) over (partition by ref_table, ref_field order by period)::bigint as open from s""",
    "p7_found": r"""
with s as (select fact_id, snapshot_at, first_seen, last_confirmed, is_active, lower(regexp_replace(retracted_reason, '^\s+|\s+$', '', 'g')) reason, ingested_at from sheep_fact_snapshots),
o as (select * from s qualify row_number() over (partition by fact_id, snapshot_at order by ingested_at desc) = 1),
c as (select *, row_number() over w = 1 or lag(first_seen) over w is distinct from first_seen or lag(last_confirmed) over w is distinct from last_confirmed
  or lag(is_active) over w is distinct from is_active or lag(reason) over w is distinct from reason as starts from o window w as (partition by fact_id order by snapshot_at))
select fact_id, epoch_ms(snapshot_at) as valid_from_ms, coalesce(epoch_ms(lead(snapshot_at) over (partition by fact_id order by snapshot_at)), -1) as valid_to_ms from c where starts""",
}
