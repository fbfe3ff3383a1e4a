"""Queries of merging, scoring, forgetting, change history and record keeping, with DuckDB SQL of their meaning.

Records that the tables don't hold (profiles, relationships, core memories, foresights) are made from those they do,
alike on both sides: a preference from what the user likes, a relationship from who works with whom, a core memory from
a salient episode, a foresight from a planned fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import rules
from engram.operators import memory as M
from engram.plans.core_problems import table
from engram.session import bounded_join, salted_join


def at(day: str):  # noqa: ANN201
    return F.lit(f"{day} 00:00:00").cast("timestamp")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct facts; a confidence outside 0..1 is null."""
    t = table(spark, sf_dir, "sheep_facts")
    times = [F.col(c).cast("timestamp").alias(c) for c in ("first_seen", "last_confirmed", "created_at", "updated_at")]
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence")).alias("confidence")
    return t.select("id", "agent_id", "subject", "predicate", "object", sure, "evidence", "user_affirmed", "is_active", "access_count", *times).distinct()


def eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "sheep_episodes")
    return t.select("id", "agent_id", "summary", "topic", "emotional_salience", "utility_score", "session_id", "ttl", "access_count", F.col("created_at").cast("timestamp").alias("created_at")).distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "sheep_causal_links")
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence")).alias("confidence")
    return t.select("id", "agent_id", "cause_type", "cause_id", "cause", "effect_type", "effect_id", "effect", "mechanism", sure, "evidence", F.col("created_at").cast("timestamp").alias("created_at")).distinct()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sheep_fact_snapshots").select("fact_id", F.col("snapshot_at").cast("timestamp").alias("snapshot_at"), "confidence", "is_active", F.col("ingested_at").cast("timestamp").alias("ingested_at"))


def merge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.merge(facts(spark, sf_dir), [F.col(c) for c in ("subject", "predicate", "object")], ["created_at", "id"], "evidence", "last_confirmed")
    return out.select("id", "n", F.col("merged_confidence").alias("confidence"), F.array_join("evidence", ",").alias("evidence"), F.unix_micros("last").alias("last_us"))


def merge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.merge(links(spark, sf_dir), [F.substring("cause", 1, 30), F.substring("effect", 1, 30)], ["created_at", "id"], "evidence")
    return out.select("id", "n", F.col("merged_confidence").alias("confidence"), F.array_join("evidence", ",").alias("evidence"))


def fact_dedup_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that the most confident of their normalised triple replaces."""
    f = facts(spark, sf_dir)
    keys = [M.norm(F.col(c)).alias(f"k_{c}") for c in ("subject", "predicate", "object")]
    best = M.top_by(f, keys, F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"))).where("n > 1")
    names = [f"k_{c}" for c in ("subject", "predicate", "object")]
    return bounded_join(f.select(*keys, "id"), best.select(*names, "best"), names, "inner").where("id <> best").select("id")


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).where("is_active")
    return M.top_by(f, [F.lower("subject").alias("subject"), F.lower("predicate").alias("predicate")], M.best_rank()).where("n > 1").select("subject", "predicate", "n", "best")


def cleanup_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a duplicate group to retract: near-equal to its best object, or unsure and not affirmed."""
    f = facts(spark, sf_dir).where("is_active and subject is not null and predicate is not null and object is not null")
    keys = [F.lower("subject").alias("s"), F.lower("predicate").alias("p")]
    best = M.top_by(f, keys, M.best_rank()).where("n > 1").select("s", "p", "best")
    text = best.join(f.select(F.col("id").alias("best"), F.col("object").alias("best_object")), "best")
    met = bounded_join(f.select(*keys, "id", "object", "confidence", "user_affirmed"), text, ["s", "p"], "inner").where("id <> best")
    a, b = (F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"[^A-Za-z0-9_\s]", ""), r"\s+", " ") for c in ("object", "best_object"))
    near = (a == b) | ((a.startswith(b) | b.startswith(a)) & (F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1)) > 0.8))
    near = near | ((F.length(a) > 10) & (F.length(b) > 10) & (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) > 0.85))
    unsure = (F.coalesce("confidence", F.lit(1.0)) < 0.5) & ~F.coalesce("user_affirmed", F.lit(False))
    return met.where(near | unsure).select("id", F.when(near, "near").otherwise("unsure").alias("why"))


def single_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object per subject and single-valued predicate: the most confident, of equals the first seen, then the smallest id."""
    f = facts(spark, sf_dir).where(F.col("predicate").isin("works_at", "lives_at", "has_name", "married_to"))
    rank = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), (-F.unix_micros("created_at")).alias("t"))
    return M.top_by(f, [F.col("subject"), F.col("predicate")], rank).select("subject", "predicate", F.col("best").alias("id"))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contradictions(facts(spark, sf_dir))


def endpoints(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    t = links(spark, sf_dir)
    return t.where(F.col("cause_type") == kind).select(F.col("cause_id").alias("id")).unionByName(t.where(F.col("effect_type") == kind).select(F.col("effect_id").alias("id"))).where("id is not null").distinct()


def _fact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).where("is_active")
    f = f.join(endpoints(spark, sf_dir, "fact").withColumn("_c", F.lit(1)), "id", "left")
    return M.retention(f, F.col("predicate"), F.when(F.col("_c") == 1, 1.0).otherwise(0.2), F.col("confidence"), F.when(F.col("user_affirmed"), 1.0).otherwise(0.3), 3.0, at("2025-12-01"))


def retention_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fact_scores(spark, sf_dir)


def _episode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = endpoints(spark, sf_dir, "episode").withColumn("_own", F.lit(1))
    told = facts(spark, sf_dir).select("id", F.explode("evidence").alias("ep")).join(endpoints(spark, sf_dir, "fact"), "id", "left_semi").select(F.col("ep").alias("id")).distinct().withColumn("_told", F.lit(1))
    e = eps(spark, sf_dir).join(own, "id", "left").join(told, "id", "left")
    causal = F.when(F.col("_own") == 1, 1.0).when(F.col("_told") == 1, 0.7).otherwise(0.2)
    keep = F.when(F.col("ttl") == "permanent", 1.0).when(F.col("ttl") == "90d", 0.7).when(F.col("ttl") == "30d", 0.3).when(F.col("ttl") == "7d", 0.1).otherwise(0.0)
    return M.retention(e, F.lower("topic"), causal, F.col("emotional_salience"), keep, 5.0, at("2025-12-01"))


def retention_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All episodes of a topic count, not the newest hundred alone."""
    return _episode_scores(spark, sf_dir)


def retention_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.3, "medium").otherwise("low")
    return _fact_scores(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"))


def active_forgetting(spark: SparkSession, sf_dir: str, least: float = 0.2) -> DataFrame:
    """What is forgotten: episodes out of their time, then episodes and facts that score under ``least``, but permanent and affirmed ones."""
    e, f = eps(spark, sf_dir), facts(spark, sf_dir).where("is_active")
    days = F.when(F.col("ttl") == "7d", 7).when(F.col("ttl") == "30d", 30).when(F.col("ttl") == "90d", 90)
    over = e.where(F.unix_micros("created_at") < F.unix_micros(at("2025-12-01")) - days * M.DAY_US).select("id", F.lit("expired").alias("why"))
    low_e = _episode_scores(spark, sf_dir).where(F.col("score") < least).join(e.where("ttl <> 'permanent' or ttl is null").select("id"), "id", "left_semi").join(over, "id", "left_anti").select("id", F.lit("episode").alias("why"))
    low_f = _fact_scores(spark, sf_dir).where(F.col("score") < least).join(f.where("not coalesce(user_affirmed, false)").select("id"), "id", "left_semi").select("id", F.lit("fact").alias("why"))
    return over.unionByName(low_e).unionByName(low_f).distinct()


def prune_lowest(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """The ``n`` facts, episodes and links each that go first when a limit is passed."""
    f = facts(spark, sf_dir).where("not coalesce(user_affirmed, false)").orderBy(F.asc_nulls_first("is_active"), F.asc_nulls_first("confidence"), "created_at", "id").limit(n).select(F.lit("fact").alias("kind"), "id")
    e = eps(spark, sf_dir).orderBy(F.asc_nulls_first("utility_score"), "created_at", "id").limit(n).select(F.lit("episode").alias("kind"), "id")
    k = links(spark, sf_dir).orderBy(F.asc_nulls_first("confidence"), "created_at", "id").limit(n).select(F.lit("link").alias("kind"), "id")
    return f.unionByName(e).unionByName(k)


def rolling_last_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).orderBy(F.desc("at"), F.desc("id")).limit(1000).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.floor_percentiles(events(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir).where("value is not null").groupBy("event_type").agg(*[F.count_if(c).alias(n) for n, c in (("b50", v < 50), ("b100", (v >= 50) & (v < 100)), ("b200", (v >= 100) & (v < 200)), ("b500", (v >= 200) & (v < 500)), ("rest", v >= 500))])


def learning_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.throttle(events(spark, sf_dir).select("id", "key", "at"), 30).select(F.col("id").alias("event_id"))


def fixed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day here, three requests each, as the events are hours apart."""
    return M.fixed_window(events(spark, sf_dir).select("id", "key", "at"), 3, 86_400).select(F.col("id").alias("event_id"), "admitted")


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return f.select("id", F.concat_ws("/", "agent_id", F.date_format("created_at", "yyyy-MM-dd")).alias("part"), F.concat_ws("|", "id", "predicate", "object").alias("content"))


def audit_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and last hash of the chain of each agent's day; chained to each other by what reads them in order."""
    return M.part_anchors(M.hash_chain(audit_rows(spark, sf_dir), ["id"]))


def audit_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification finds after the content of every fact of confidence under 0.5 was changed."""
    rows = audit_rows(spark, sf_dir)
    chain = M.hash_chain(rows, ["id"])
    changed = facts(spark, sf_dir).where("confidence < 0.5").select("id", F.lit(" changed").alias("x"))
    after = rows.join(changed, "id", "left").select("id", "part", F.concat("content", F.coalesce("x", F.lit(""))).alias("content"))
    return M.verify_chain(chain, after)


def intersection_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in all three result lists; the score is averaged pair by pair in the order of the lists."""
    f = facts(spark, sf_dir)
    lists = [f.where("subject = 'user'").select("id", F.lit(1.0).alias("s0")), f.where(F.col("predicate").isin("likes", "prefers", "uses")).select("id", F.lit(0.8).alias("s1")), f.where("confidence >= 0.5").select("id", F.col("confidence").alias("s2"))]
    met = lists[0].join(lists[1], "id").join(lists[2], "id")
    return met.select("id", F.round(((F.col("s0") + F.col("s1")) / 2 + F.col("s2")) / 2, 6).alias("score"))


def fact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = facts(spark, sf_dir).where("is_active and predicate = 'likes'")
    total = kept.agg(F.count("*").alias("total"))
    return kept.select("id").orderBy("id").limit(100).join(F.broadcast(total))  # total is one row


def two_hop_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about what the direct facts of a keyword name, without these."""
    f = facts(spark, sf_dir)
    direct = f.where(F.lower("object").contains("festival") | F.lower("subject").contains("team"))
    named = direct.select(F.lower("subject").alias("s")).distinct()
    return f.join(named, F.lower("subject") == F.col("s"), "left_semi").select("id").distinct().join(direct.select("id"), "id", "left_anti")


def low_quality_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meaningless, cut short, too short for the predicate, unsure; affirmed ones are none."""
    t = F.trim("object")
    empty = F.lower(t).rlike(r"\A(it|this|that|what|the|a|an|\d+|yes|no|ok|okay|done|here|there)\z")
    short = (F.length(t) < 3) | t.rlike(r"\s[A-Za-z0-9_]{1,2}\z")
    least = {"prefers": 5, "uses": 3, "wants": 5, "needs": 5, "likes": 3, "dislikes": 3, "is_interested_in": 5, "works_on": 5, "working_on": 5, "location": 3, "email": 5, "is": 3}
    need = F.element_at(F.create_map(*[F.lit(x) for p in least.items() for x in p]), F.lower("predicate"))
    why = F.when(empty, "meaningless").when(short, "truncated").when(F.length("object") < need, "short").when(F.col("confidence") < 0.3, "unsure")
    return facts(spark, sf_dir).where("not coalesce(user_affirmed, false)").select("id", why.alias("why")).where("why is not null")


def orphaned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).where("not coalesce(user_affirmed, false) and coalesce(size(evidence), 0) = 0").select("id")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.change_log(facts(spark, sf_dir), snapshots(spark, sf_dir))


def facts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.as_of(log(spark, sf_dir), at("2025-01-01")).select("fact_id", "confidence", F.unix_micros("since").alias("since_us"))


def belief_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that held at a time and the episodes of the week around it."""
    held = M.as_of(log(spark, sf_dir), at("2025-01-01")).select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"))
    near = eps(spark, sf_dir).where(F.abs(F.unix_micros("created_at") - F.unix_micros(at("2025-01-01"))) <= 7 * M.DAY_US).select(F.lit("episode").alias("kind"), "id")
    return held.unionByName(near.distinct())


def belief_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the facts about a subject: made, changed, retracted."""
    about = facts(spark, sf_dir).where(F.col("subject").ilike("%user%")).select(F.col("id").alias("fact_id"), "predicate")
    return log(spark, sf_dir).join(about, "fact_id").select("fact_id", "predicate", "kind", F.unix_micros("at").alias("at_us"), "confidence").distinct()


def belief_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief_timeline(spark, sf_dir).groupBy("predicate").agg(F.count("*").alias("n"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"), F.count_if(F.col("kind") == "modify").alias("changed"))


def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = at("2025-06-01")
    moved = log(spark, sf_dir).where(F.col("at") >= since).groupBy("kind").agg(F.count("*").alias("n"))
    seen = eps(spark, sf_dir).where(F.col("created_at") >= since).select("id").distinct().agg(F.lit("episode").alias("kind"), F.count("*").alias("n"))
    return moved.unionByName(seen)


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.snapshot_changes(log(spark, sf_dir), at("2025-01-01"), at("2025-06-01"))


def as_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir).where(F.col("snapshot_at") <= at("2025-01-01"))
    last = s.groupBy("fact_id").agg(F.max_by(F.struct("is_active", "confidence"), F.struct("snapshot_at", "ingested_at", F.coalesce("confidence", F.lit(-1.0)))).alias("x"))
    return last.select("fact_id", "x.is_active", "x.confidence")


def explain_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fact its number of evidence episodes found and its changes, newest first."""
    told = facts(spark, sf_dir).select(F.col("id").alias("fact_id"), F.explode_outer("evidence").alias("ep"))
    found = told.join(eps(spark, sf_dir).select(F.col("id").alias("ep")).distinct().withColumn("_f", F.lit(1)), "ep", "left").groupBy("fact_id").agg(F.count("_f").alias("found"))
    history = log(spark, sf_dir).groupBy("fact_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "kind")), asc=False), lambda e: e["kind"]), ",").alias("changes"))
    return found.join(history, "fact_id")


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).where(F.col("predicate").isin("likes", "prefers", "dislikes"))
    return f.select("id", F.col("agent_id").alias("user_id"), F.when(F.col("predicate") == "dislikes", "negative").otherwise("positive").alias("sentiment"), "confidence", "created_at")


def preference_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(spark, sf_dir).where("sentiment = 'positive' and confidence >= 0.5").orderBy(F.desc("confidence"), F.desc("created_at"), "id").limit(20).select("id", "confidence")


def core_memory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = eps(spark, sf_dir).where("emotional_salience >= 0.6 and topic is not null")
    return c.orderBy(F.desc("emotional_salience"), F.desc_nulls_last("utility_score"), "id").limit(20).select("id", F.col("emotional_salience").alias("importance"))


def best_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident trait of each agent."""
    f = facts(spark, sf_dir).where("predicate is not null and object is not null").where(rules.profile_kind(F.col("predicate"), F.col("object")) == "trait")
    return M.top_by(f.where("confidence is not null"), [F.col("agent_id").alias("user_id")], F.struct("confidence")).select("user_id", "best")


def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of each agent's user, later ones over earlier: (user_id, attribute, value)."""
    f = facts(spark, sf_dir).where("lower(subject) = 'user' and is_active and predicate is not null")
    return f.groupBy(F.col("agent_id").alias("user_id"), F.lower("predicate").alias("attribute")).agg(F.max_by("object", F.struct("updated_at", "id")).alias("value"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected pairs of who is tied to whom, with the strongest tie and evidence united."""
    f = facts(spark, sf_dir).where(F.col("predicate").isin("works_with", "married_to", "rents_from"))
    a, b = F.lower(F.trim("subject")), F.lower(F.trim("object"))
    return f.groupBy(F.least(a, b).alias("person1"), F.greatest(a, b).alias("person2")).agg(F.max("confidence").alias("strength"), F.size(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("n_evidence"))


def foresights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).where(F.col("predicate").isin("plans_to_visit", "has_deadline") & F.col("first_seen").isNotNull())
    return f.select("id", F.col("agent_id").alias("user_id"), "confidence", "is_active", F.col("first_seen").alias("start"), (F.col("first_seen") + F.expr("interval 200 days")).alias("end"))


def active_foresights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active ones of an agent by confidence, and whether their end has passed."""
    f = foresights(spark, sf_dir).where("is_active")
    return f.select("id", "user_id", "confidence", (F.col("end") < at("2025-06-01")).alias("over"))


def grounded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of which a word longer than three letters occurs in one of their evidence episodes, or that are sure (0.95)."""
    f = facts(spark, sf_dir).where("object is not null")
    words = F.filter(F.split(F.lower("object"), r"\s+"), lambda w: F.length(w) > 3)
    told = f.select("id", words.alias("w"), F.explode("evidence").alias("ep"))
    seen = told.join(eps(spark, sf_dir).select(F.col("id").alias("ep"), F.lower("summary").alias("s")), "ep").where(F.exists("w", lambda w: F.col("s").contains(w))).select("id")
    return seen.unionByName(f.where("confidence >= 0.95").select("id")).distinct()


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of correcting every statement `user likes X`: the old ones are retracted, one new fact of 0.95 names them."""
    old = facts(spark, sf_dir).where("is_active and subject = 'user' and predicate = 'likes'")
    gone = old.select(F.lit("retract").alias("kind"), "id", F.lit(0.0).alias("confidence"))
    made = old.groupBy("object").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("id")).select(F.lit("assert").alias("kind"), "id", F.lit(0.95).alias("confidence"))
    return gone.unionByName(made)


def output_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of facts of one subject and single-valued predicate, those whose object is part of a longer one that is as sure, which replaces them."""
    f = facts(spark, sf_dir).where("object is not null and length(object) >= 3 and predicate in ('has_name', 'married_to', 'works_at', 'lives_at')").select("id", "subject", "predicate", F.lower("object").alias("o"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
    key = ["subject", "predicate"]
    longer = f.select(*key, F.col("id").alias("by"), F.col("o").alias("p"), F.col("c").alias("d"))
    met = salted_join(f, longer, key, "inner").where(F.col("p").contains(F.col("o")) & ((F.length("p") > F.length("o")) | ((F.col("p") == F.col("o")) & (F.col("by") < F.col("id")))) & (F.col("d") >= F.col("c")))
    return met.groupBy("id").agg(F.min("by").alias("kept_id"))


def matched_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected causes (sure links) and found effects of an agent's day, matched one to one by likeness of 0.5 or more."""
    t = links(spark, sf_dir).where("cause is not null and effect is not null").select(F.concat_ws("/", "agent_id", F.date_format("created_at", "yyyy-MM-dd")).alias("case"), "id", "cause", "effect")
    pairs = t.select("case", F.col("id").alias("a"), F.col("cause").alias("x")).join(t.select("case", F.col("id").alias("b"), F.col("effect").alias("y")), "case")
    scored = pairs.select("case", "a", "b", F.round(M.fuzzy(F.col("x"), F.col("y")), 6).cast("double").alias("score")).where("score >= 0.5")
    return M.greedy_match(scored)


def noisy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts per predicate with Laplace noise of scale 1, and the true number; budgets add up per query."""
    n = facts(spark, sf_dir).groupBy("predicate").agg(F.count("*").alias("n"))
    return n.select("predicate", "n", F.greatest(F.lit(0), F.round(F.col("n") + M.laplace(F.col("predicate"), 1.0, 7)).cast("bigint")).alias("noisy"))


def consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user's consent, made of the mode of recall requests: `none` withdraws."""
    r = table(spark, sf_dir, "recall_requests").select("agent_id", F.col("received_at").cast("timestamp").alias("at"), "request_id", F.coalesce(F.lower("mode_name"), F.lit("none")).alias("mode")).distinct()
    last = r.groupBy("agent_id").agg(F.max_by("mode", F.struct("at", "request_id")).alias("mode"))
    return last.select("agent_id", (F.col("mode") != "none").alias("consents"))


def synthesis_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one normalised triple as one: greatest confidence, affirmed if any is, evidence united; the others are inactive."""
    f = facts(spark, sf_dir)
    keys = [M.norm(F.col(c)).alias(c[0]) for c in ("subject", "predicate", "object")]
    out = f.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.max(F.coalesce("user_affirmed", F.lit(False))).alias("affirmed"), F.size(F.array_distinct(F.flatten(F.collect_list(F.coalesce("evidence", F.array().cast("array<string>")))))).alias("n_evidence"))
    return out.where("n > 1").select("id", "n", "confidence", "affirmed", "n_evidence")


def array_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and contradictions of each fact: how many in either, in both, in the first alone."""
    f = table(spark, sf_dir, "sheep_facts").select("id", F.coalesce("evidence", F.array().cast("array<string>")).alias("a"), F.coalesce("contradictions", F.array().cast("array<string>")).alias("b")).distinct()
    return f.select("id", F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("first_alone"))


def overall_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.4 share of recalls with a mode, 0.3 of ten requests per agent, 0.3 of fifty facts per agent."""
    r = table(spark, sf_dir, "recall_requests").select("request_id", "agent_id", "mode_name").distinct().groupBy("agent_id").agg(F.count("*").alias("n"), F.avg(F.col("mode_name").isNotNull().cast("double")).alias("hit"))
    f = facts(spark, sf_dir).where("is_active").groupBy("agent_id").agg(F.count("*").alias("k"))
    met = r.join(f, "agent_id", "left")
    return met.select("agent_id", F.round(0.4 * F.col("hit") + 0.3 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.3 * F.least(F.coalesce("k", F.lit(0)) / 50, F.lit(1.0)), 6).alias("health"))


def generated_conversations(spark: SparkSession, sf_dir: str, n: int = 1000) -> DataFrame:
    """Deterministic conversations by number: template number % 3, slots by number % list length."""
    cities, tools = ["Porto", "Izmir", "Lyon"], ["spark", "duckdb", "arrow", "numpy"]
    i = F.col("id").cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), i % len(values) + 1)
    text = F.when(i % 3 == 0, F.concat(F.lit("I live in "), pick(cities))).when(i % 3 == 1, F.concat(F.lit("I use "), pick(tools))).otherwise(F.concat(F.lit("I moved to "), pick(cities), F.lit(" because of "), pick(tools)))
    return spark.range(n).select("id", text.alias("text"))


QUERIES = {f.__name__: f for f in (
    merge_facts, merge_links, fact_dedup_job, duplicate_groups, cleanup_actions, single_valued, contradictions, retention_facts, retention_episodes, retention_histogram, active_forgetting, prune_lowest, rolling_last_1000, latency_percentiles,
    latency_buckets, learning_throttle, fixed_rate, audit_anchors, audit_breaks, intersection_join, fact_listing, two_hop_entities, low_quality_facts, orphaned_facts, facts_as_of, belief_snapshot, belief_timeline, belief_evolution, changes_since,
    snapshot_diff, as_of_snapshot, explain_history, preference_query, core_memory_query, best_profiles, merged_profiles, relationships, active_foresights, grounded_facts, corrected, output_dedup, matched_answers, noisy_counts, consents,
    synthesis_merge, array_algebra, overall_health, generated_conversations)}

FACTS = "facts as (select distinct id, agent_id, subject, predicate, object, case when confidence between 0 and 1 then confidence end as confidence, evidence, first_seen, last_confirmed, user_affirmed, is_active, access_count, created_at, updated_at from sheep_facts)"
EPS = "eps as (select distinct id, agent_id, summary, topic, emotional_salience, utility_score, session_id, ttl, access_count, created_at from sheep_episodes)"
LINKS = "links as (select distinct id, agent_id, cause_type, cause_id, cause, effect_type, effect_id, effect, mechanism, case when confidence between 0 and 1 then confidence end as confidence, evidence, created_at from sheep_causal_links)"
LOG = f"""{FACTS}, sn as (select fact_id, snapshot_at, max_by(confidence, [epoch_us(ingested_at)::double, confidence]) as confidence from sheep_fact_snapshots where snapshot_at is not null and confidence between 0 and 1 group by 1, 2),
log as (select id as fact_id, created_at as at_, 'assert' as kind, confidence, 0 as o from facts where created_at is not null union all select id, updated_at, 'retract', 0.0, 2 from facts where not is_active and updated_at is not null
  union all select fact_id, snapshot_at, 'modify', confidence, 1 from (select *, lag(confidence) over (partition by fact_id order by snapshot_at) as was from sn) where was <> confidence)"""


def as_of_sql(name: str, day: str) -> str:
    return f"""{name} as (select fact_id, confidence, at_ from (select *, bool_or(kind = 'assert') over (partition by fact_id) as made, row_number() over (partition by fact_id order by at_ desc, o desc, coalesce(confidence, -1) desc) as r from log where at_ <= timestamp '{day} 00:00:00') where r = 1 and made and kind <> 'retract')"""


AGE = "greatest((epoch_us(timestamp '2025-12-01 00:00:00') - epoch_us(f.created_at)) / 86400000000.0, 0.0)"
ENDS = {k: f"(select cause_id as k from links where cause_type = '{k}' union select effect_id from links where effect_type = '{k}')" for k in ("fact", "episode")}
BASE = f"0.2 * least(f.access_count / greatest({AGE}, 1.0), 1.0) + 0.15 * exp(-{AGE} / 30.0)"
FS = f"""fs as (select f.id, round({BASE} + 0.15 * coalesce(f.confidence, 0.0) + 0.25 * case when f.id in {ENDS['fact']} then 1.0 else 0.2 end + 0.15 * exp(-(count(*) over (partition by f.predicate) - 1) / 3.0) + 0.1 * case when f.user_affirmed then 1.0 else 0.3 end, 6)::double as score, user_affirmed from facts f where f.is_active)"""
ES = f"""told as (select distinct ep from (select id, unnest(evidence) as ep from facts) where id in {ENDS['fact']}),
es as (select f.id, f.ttl, round({BASE} + 0.15 * coalesce(f.emotional_salience, 0.0) + 0.25 * case when f.id in {ENDS['episode']} then 1.0 when f.id in (select ep from told where ep is not null) then 0.7 else 0.2 end
  + 0.15 * exp(-(case when topic is null then 0 else count(*) over (partition by lower(f.topic)) - 1 end) / 5.0) + 0.1 * case f.ttl when 'permanent' then 1.0 when '90d' then 0.7 when '30d' then 0.3 when '7d' then 0.1 else 0.0 end, 6)::double as score from eps f)"""
NORM = "lower(regexp_replace({}, '^[ ]+|[ ]+$', '', 'g'))"
RANK = "coalesce(user_affirmed, false) desc, coalesce(confidence, -1) desc, len(evidence) desc nulls last, length(object) desc nulls last, id"
PROFILE = "case " + " ".join(f"when lower(predicate) in ({', '.join(repr(p) for p in rules.KINDS[k])}) then '{k}'" for k in ("preference", "trait", "plan", "state")) + r" when regexp_matches(lower(object), '\b(week|month|day|tomorrow|soon|later|next)\b') then 'plan' else 'trait' end"
CLEAN = r"regexp_replace(regexp_replace(trim(lower({})), '[^A-Za-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')"


ORACLES = {
    "merge_facts": f"with {FACTS}, o as (select *, row_number() over w as r, count(*) over (partition by subject, predicate, object) as n from facts window w as (partition by subject, predicate, object order by created_at, id)), e as (select subject s, predicate p, object b, flatten(list(coalesce(evidence, []) order by created_at, id)) as ev, epoch_us(max(last_confirmed)) as last_us from facts group by all) select id, n, round(least(1.0, confidence + 0.1 * (n - 1)), 6)::double as confidence, array_to_string(list_filter(ev, lambda x, i: list_position(ev, x) = i), ',') as evidence, last_us from o join e on subject is not distinct from s and predicate is not distinct from p and object is not distinct from b where r = 1",
    "merge_links": f"with {LINKS}, o as (select *, left(cause, 30) as x, left(effect, 30) as y, row_number() over (partition by left(cause, 30), left(effect, 30) order by created_at, id) as r, count(*) over (partition by left(cause, 30), left(effect, 30)) as n from links), e as (select left(cause, 30) s, left(effect, 30) p, flatten(list(coalesce(evidence, []) order by created_at, id)) as ev from links group by all) select id, n, round(least(1.0, confidence + 0.1 * (n - 1)), 6)::double as confidence, array_to_string(list_filter(ev, lambda z, i: list_position(ev, z) = i), ',') as evidence from o join e on x is not distinct from s and y is not distinct from p where r = 1",
    "fact_dedup_job": f"with {FACTS} select id from facts where subject is not null and predicate is not null and object is not null qualify row_number() over (partition by {NORM.format('subject')}, {NORM.format('predicate')}, {NORM.format('object')} order by coalesce(confidence, -1) desc, id) > 1",
    "duplicate_groups": f"with {FACTS}, g as (select lower(subject) as subject, lower(predicate) as predicate, id as best, count(*) over (partition by lower(subject), lower(predicate)) as n, row_number() over (partition by lower(subject), lower(predicate) order by {RANK}) as r from facts where is_active) select subject, predicate, n, best from g where r = 1 and n > 1",
    "cleanup_actions": f"""with {FACTS}, g as (select *, lower(subject) as s, lower(predicate) as p, first_value(object) over w as bo, row_number() over w as r from facts where is_active and subject is not null and predicate is not null and object is not null window w as (partition by lower(subject), lower(predicate) order by {RANK})),
x as (select id, {CLEAN.format('object')} as a, {CLEAN.format('bo')} as b, coalesce(confidence, 1.0) < 0.5 and not coalesce(user_affirmed, false) as unsure from g where r > 1),
y as (select *, a = b or ((starts_with(a, b) or starts_with(b, a)) and least(length(a), length(b)) / greatest(length(a), length(b), 1)::double > 0.8) or (length(a) > 10 and length(b) > 10 and 1 - levenshtein(a, b) / greatest(length(a), length(b))::double > 0.85) as near from x)
select id, case when near then 'near' else 'unsure' end as why from y where near or unsure""",
    "single_valued": f"with {FACTS} select subject, predicate, id from facts where predicate in ('works_at', 'lives_at', 'has_name', 'married_to') qualify row_number() over (partition by subject, predicate order by coalesce(confidence, -1) desc, created_at, id) = 1",
    "contradictions": f"with {FACTS}, g as (select id, agent_id, subject, predicate, first_value(id) over (partition by agent_id, subject, predicate order by coalesce(user_affirmed, false) desc, coalesce(epoch_us(last_confirmed), -1) desc, coalesce(confidence, 0) desc, len(evidence) desc, id) as winner from facts where is_active and predicate in ('has_name', 'works_at', 'lives_in', 'timezone', 'is_a')), k as (select agent_id, subject, predicate from facts where is_active group by all having count(distinct object) > 1) select id, winner from g join k using (agent_id, subject, predicate)",
    "retention_facts": f"with {FACTS}, {LINKS}, {FS} select id, score from fs",
    "retention_episodes": f"with {FACTS}, {EPS}, {LINKS}, {ES} select id, score from es",
    "retention_histogram": f"with {FACTS}, {LINKS}, {FS} select case when score >= 0.6 then 'high' when score >= 0.3 then 'medium' else 'low' end as band, count(*) as n, round(avg(score), 5) as mean from fs group by 1",
    "active_forgetting": f"""with {FACTS}, {EPS}, {LINKS}, {FS}, {ES}, x as (select id from eps where created_at < timestamp '2025-12-01 00:00:00' - to_days(case ttl when '7d' then 7 when '30d' then 30 when '90d' then 90 end))
select distinct id, 'expired' as why from x union all select distinct id, 'episode' from es where score < 0.2 and ttl is distinct from 'permanent' and id not in (select id from x) union all select distinct id, 'fact' from fs where score < 0.2 and not coalesce(user_affirmed, false)""",
    "prune_lowest": f"with {FACTS}, {EPS}, {LINKS} select * from (select 'fact' as kind, id from facts where not coalesce(user_affirmed, false) order by is_active nulls first, confidence nulls first, created_at nulls first, id limit 50) union all select * from (select 'episode', id from eps order by utility_score nulls first, created_at nulls first, id limit 50) union all select * from (select 'link', id from links order by confidence nulls first, created_at nulls first, id limit 50)",
    "rolling_last_1000": "select count(*) as n, round(avg(value), 6) as mean from (select value from events order by ts desc, event_id desc limit 1000)",
    "latency_percentiles": "with v as (select event_type, value, row_number() over (partition by event_type order by value, event_id) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) select event_type, max(case when i = floor(n * 0.5) then value end) as p50, max(case when i = floor(n * 0.95) then value end) as p95, max(case when i = floor(n * 0.99) then value end) as p99 from v group by event_type",
    "latency_buckets": "select event_type, count(*) filter (value < 50) as b50, count(*) filter (value >= 50 and value < 100) as b100, count(*) filter (value >= 100 and value < 200) as b200, count(*) filter (value >= 200 and value < 500) as b500, count(*) filter (value >= 500) as rest from events where value is not null group by 1",
    "learning_throttle": "with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as r from events), w(user_id, r, event_id, last, ok) as (select user_id, r, event_id, ts, true from e where r = 1 union all select e.user_id, e.r, e.event_id, case when e.ts >= w.last + interval 30 minute then e.ts else w.last end, e.ts >= w.last + interval 30 minute from w join e on e.user_id = w.user_id and e.r = w.r + 1) select event_id from w where ok",
    "fixed_rate": "with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as r from events), w(user_id, r, event_id, start, n) as (select user_id, r, event_id, ts, 1 from e where r = 1 union all select e.user_id, e.r, e.event_id, case when e.ts >= w.start + interval 1 day then e.ts else w.start end, case when e.ts >= w.start + interval 1 day then 1 else w.n + 1 end from w join e on e.user_id = w.user_id and e.r = w.r + 1) select event_id, n <= 3 as admitted from w",
    "audit_anchors": f"with {FACTS}, c as (select concat_ws('/', agent_id, strftime(created_at, '%Y-%m-%d')) as part, id, concat_ws('|', id, predicate, object) as content from facts) select part, count(*) as n, list_reduce(list_prepend('', list(content order by id)), lambda a, x: sha256(a || x)) as anchor from c group by part",
    "audit_breaks": f"with {FACTS} select id, concat_ws('/', agent_id, strftime(created_at, '%Y-%m-%d')) as part from facts where confidence < 0.5",
    "intersection_join": f"with {FACTS} select id, round(((1.0 + 0.8) / 2 + confidence) / 2, 6)::double as score from facts where subject = 'user' and predicate in ('likes', 'prefers', 'uses') and confidence >= 0.5",
    "fact_listing": f"with {FACTS} select id, count(*) over () as total from facts where is_active and predicate = 'likes' order by id limit 100",
    "two_hop_entities": f"with {FACTS}, d as (select * from facts where contains(lower(object), 'festival') or contains(lower(subject), 'team')) select distinct id from facts where lower(subject) in (select lower(subject) from d) and id not in (select id from d)",
    "low_quality_facts": rf"""with {FACTS}, t as (select *, trim(object) as t from facts where not coalesce(user_affirmed, false)), w as (select id, case when regexp_matches(lower(t), '\A(it|this|that|what|the|a|an|\d+|yes|no|ok|okay|done|here|there)\z') then 'meaningless' when length(t) < 3 or regexp_matches(t, '\s[A-Za-z0-9_]{{1,2}}\z') then 'truncated'
  when length(object) < case lower(predicate) when 'prefers' then 5 when 'uses' then 3 when 'wants' then 5 when 'needs' then 5 when 'likes' then 3 when 'dislikes' then 3 when 'is_interested_in' then 5 when 'works_on' then 5 when 'working_on' then 5 when 'location' then 3 when 'email' then 5 when 'is' then 3 end then 'short' when confidence < 0.3 then 'unsure' end as why from t) select id, why from w where why is not null""",
    "orphaned_facts": f"with {FACTS} select id from facts where not coalesce(user_affirmed, false) and coalesce(len(evidence), 0) = 0",
    "facts_as_of": f"with {LOG}, {as_of_sql('a', '2025-01-01')} select fact_id, confidence, epoch_us(at_) as since_us from a",
    "belief_snapshot": f"with {LOG}, {as_of_sql('a', '2025-01-01')} select 'fact' as kind, fact_id as id from a union all select distinct 'episode', id from sheep_episodes where abs(epoch_us(created_at) - epoch_us(timestamp '2025-01-01 00:00:00')) <= 7 * 86400000000",
    "belief_timeline": f"with {LOG} select distinct fact_id, predicate, kind, epoch_us(at_) as at_us, log.confidence from log join facts on id = fact_id where subject ilike '%user%'",
    "belief_evolution": f"with {LOG}, t as (select distinct fact_id, predicate, kind, epoch_us(at_) as at_us, log.confidence from log join facts on id = fact_id where subject ilike '%user%') select predicate, count(*) as n, min(at_us) as first_us, max(at_us) as last_us, count(*) filter (kind = 'modify') as changed from t group by predicate",
    "changes_since": f"with {LOG} select kind, count(*) as n from log where at_ >= timestamp '2025-06-01 00:00:00' group by kind union all select 'episode', count(distinct id) from sheep_episodes where created_at >= timestamp '2025-06-01 00:00:00'",
    "snapshot_diff": f"with {LOG}, {as_of_sql('a', '2025-01-01')}, {as_of_sql('b', '2025-06-01')}, x as (select coalesce(a.fact_id, b.fact_id) as fact_id, case when a.fact_id is null then 'added' when b.fact_id is null then 'removed' when a.confidence is distinct from b.confidence then 'modified' end as change from a full join b on a.fact_id = b.fact_id) select * from x where change is not null",
    "as_of_snapshot": "select fact_id, is_active, confidence from sheep_fact_snapshots where snapshot_at <= timestamp '2025-01-01 00:00:00' qualify row_number() over (partition by fact_id order by snapshot_at desc, ingested_at desc, coalesce(confidence, -1) desc) = 1",
    "explain_history": f"with {LOG}, t as (select f.id as fact_id, count(e.id) as found from (select id, unnest(case when len(evidence) > 0 then evidence else [null] end) as ep from facts) f left join (select distinct id from sheep_episodes) e on e.id = f.ep group by f.id), h as (select fact_id, string_agg(kind, ',' order by at_ desc, kind desc) as changes from log group by fact_id) select fact_id, found, changes from t join h using (fact_id)",
    "preference_query": f"with {FACTS} select id, confidence from facts where predicate in ('likes', 'prefers') and confidence >= 0.5 order by confidence desc, created_at desc nulls last, id limit 20",
    "core_memory_query": f"with {EPS} select id, emotional_salience as importance from eps where emotional_salience >= 0.6 and topic is not null order by emotional_salience desc, utility_score desc nulls last, id limit 20",
    "best_profiles": f"with {FACTS} select agent_id as user_id, id as best from facts where confidence is not null and predicate is not null and object is not null and {PROFILE} = 'trait' qualify row_number() over (partition by agent_id order by confidence desc, id) = 1",
    "merged_profiles": f"with {FACTS} select agent_id as user_id, lower(predicate) as attribute, object as value from facts where lower(subject) = 'user' and is_active and predicate is not null qualify row_number() over (partition by agent_id, lower(predicate) order by updated_at desc nulls last, id desc) = 1",
    "relationships": f"with {FACTS} select least(lower(trim(subject)), lower(trim(object))) as person1, greatest(lower(trim(subject)), lower(trim(object))) as person2, max(confidence) as strength, len(list_distinct(flatten(list(evidence))))::int as n_evidence from facts where predicate in ('works_with', 'married_to', 'rents_from') group by 1, 2",
    "active_foresights": f"with {FACTS} select id, agent_id as user_id, confidence, first_seen + interval 200 day < timestamp '2025-06-01 00:00:00' as over from facts where predicate in ('plans_to_visit', 'has_deadline') and first_seen is not null and is_active",
    "grounded_facts": f"with {FACTS}, {EPS}, t as (select id, list_filter(string_split_regex(lower(object), '\\s+'), lambda w: length(w) > 3) as w, unnest(evidence) as ep from facts where object is not null) select distinct id from (select t.id from t join eps e on e.id = t.ep where len(list_filter(w, lambda x: contains(lower(e.summary), x))) > 0 union all select id from facts where object is not null and confidence >= 0.95)",
    "corrected": f"with {FACTS}, o as (select * from facts where is_active and subject = 'user' and predicate = 'likes') select 'retract' as kind, id, 0.0::double as confidence from o union all select 'assert', string_agg(distinct id, ',' order by id), 0.95::double from o group by object",
    "output_dedup": f"with {FACTS}, f as (select id, agent_id, subject, predicate, lower(object) as o, coalesce(confidence, 0) as c from facts where length(object) >= 3 and predicate in ('has_name', 'married_to', 'works_at', 'lives_at')) select a.id, min(b.id) as kept_id from f a join f b on a.subject = b.subject and a.predicate = b.predicate where contains(b.o, a.o) and (length(b.o) > length(a.o) or (b.o = a.o and b.id < a.id)) and b.c >= a.c group by a.id",
    "consents": "with r as (select distinct agent_id, received_at, request_id, coalesce(lower(mode_name), 'none') as mode from recall_requests) select agent_id, mode <> 'none' as consents from r qualify row_number() over (partition by agent_id order by received_at desc nulls last, request_id desc) = 1",
    "synthesis_merge": f"with {FACTS} select min(id) as id, count(*) as n, max(confidence) as confidence, bool_or(coalesce(user_affirmed, false)) as affirmed, len(list_distinct(flatten(list(coalesce(evidence, [])))))::int as n_evidence from facts group by {NORM.format('subject')}, {NORM.format('predicate')}, {NORM.format('object')} having count(*) > 1",
    "array_algebra": "with f as (select distinct id, coalesce(evidence, []) as a, coalesce(contradictions, []) as b from sheep_facts) select id, len(list_distinct(list_concat(a, b)))::int as either, len(list_distinct(list_filter(a, lambda x: list_contains(b, x))))::int as both, len(list_distinct(list_filter(a, lambda x: not list_contains(b, x))))::int as first_alone from f",
    "overall_health": f"with {FACTS}, r as (select agent_id, count(*) as n, avg(case when mode_name is not null then 1.0 else 0.0 end) as hit from (select distinct request_id, agent_id, mode_name from recall_requests) group by 1), f as (select agent_id, count(*) as k from facts where is_active group by 1) select r.agent_id, round(0.4 * hit + 0.3 * least(n / 10.0, 1.0) + 0.3 * least(coalesce(k, 0) / 50.0, 1.0), 6)::double as health from r left join f on r.agent_id = f.agent_id",
    "generated_conversations": "select i as id, case i % 3 when 0 then 'I live in ' || ['Porto', 'Izmir', 'Lyon'][i % 3 + 1] when 1 then 'I use ' || ['spark', 'duckdb', 'arrow', 'numpy'][i % 4 + 1] else 'I moved to ' || ['Porto', 'Izmir', 'Lyon'][i % 3 + 1] || ' because of ' || ['spark', 'duckdb', 'arrow', 'numpy'][i % 4 + 1] end as text from range(1000) t(i)",
}
