"""Queries of upkeep: statistics, limits, health, decay, deletion, the whole knowledge graph, significance, tiers, recall of a bot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.operators import memory as M
from engram.plans.memory_queries import EPS, FACTS, LINKS, LOG, at, duplicate_groups, eps, events, facts, links, log, low_quality_facts, orphaned_facts
from engram.plans.memory_queries import ORACLES as MEMORY_ORACLES
from engram.plans.retrieval_queries import ORACLES as RETRIEVAL_ORACLES
from engram.plans.retrieval_queries import procedures

# Bytes that a record counts for, and the limits of a store.
BYTES = {"episodes": 500, "facts_n": 200, "links_n": 300, "procedures": 250, "changes": 300}
LIMITS = {"episodes": 10_000, "facts_n": 50_000, "links_n": 10_000, "procedures": 5_000, "size_bytes": 100 * 1024 * 1024}


def one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each, side by side; each is an aggregate without groups, so it always has its row."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), frames)


def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all kinds, mean confidence of active facts, first and last episode, retractions, size."""
    e, f, k = eps(spark, sf_dir), facts(spark, sf_dir), links(spark, sf_dir)
    out = one_row(e.agg(F.count("*").alias("episodes"), F.unix_micros(F.min("created_at")).alias("oldest_us"), F.unix_micros(F.max("created_at")).alias("newest_us")),
                  f.agg(F.count("*").alias("facts_n"), F.count_if("is_active").alias("active"), F.round(F.avg(F.when(F.col("is_active"), F.col("confidence"))), 6).alias("avg_confidence"), F.countDistinct("agent_id").alias("agents_n"), F.count_if("user_affirmed").alias("affirmed")),
                  k.agg(F.count("*").alias("links_n")), procedures(spark, sf_dir).agg(F.count("*").alias("procedures")), log(spark, sf_dir).agg(F.count("*").alias("changes"), F.count_if(F.col("kind") == "retract").alias("retracted")))
    return out.withColumn("size_bytes", sum((F.col(c) * b for c, b in BYTES.items()), F.lit(0)).cast("bigint"))


def memory_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = store_statistics(spark, sf_dir)
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("bigint").alias("n"), (F.col(k) > v).alias("over_limit")) for k, v in LIMITS.items()])).alias("x")).select("x.*")


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 less the share of penalties: 10, 5, 2, 1 by the severity of each issue, over twice the active facts; halves go up."""
    f = facts(spark, sf_dir).where("is_active")
    weight = F.when(F.col("n") > 10, 5).when(F.col("n") > 5, 2).otherwise(1)
    dup = duplicate_groups(spark, sf_dir).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("a"))
    active = f.select("id")
    low = low_quality_facts(spark, sf_dir).join(active, "id", "left_semi").agg(F.coalesce(F.sum(F.when(F.col("why") == "meaningless", 5).when(F.col("why") == "truncated", 2).otherwise(1)), F.lit(0)).alias("b"))
    lone = orphaned_facts(spark, sf_dir).join(active, "id", "left_semi").agg(F.count("*").alias("c"))
    stale = f.where("not coalesce(user_affirmed, false) and access_count = 0").where(F.col("last_confirmed") < at("2025-12-01") - F.expr("interval 30 days")).agg(F.count("*").alias("d"))
    total = f.agg(F.count("*").alias("n"))
    penalty = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return one_row(dup, low, lone, stale, total).select(penalty.alias("penalty"), F.when(F.col("n") == 0, 100.0).otherwise(F.floor(F.greatest(F.lit(0.0), 100 - penalty / (2 * F.col("n")) * 100) + 0.5).cast("double")).alias("health"))


def confidence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New confidence of facts of a month or more and at most five uses; under 0.2 they are retracted."""
    f = facts(spark, sf_dir).where("is_active and confidence is not null and access_count <= 5")
    periods = F.floor((F.unix_micros(at("2025-12-01")) - F.unix_micros("created_at")) / (30 * M.DAY_US))
    new = F.round(F.col("confidence") - 0.05 * periods + F.least(F.col("access_count") * 0.02, F.lit(0.1)), 6)
    return f.where(periods >= 1).select("id", new.alias("confidence"), (new < 0.2).alias("retract"))


def forgotten(spark: SparkSession, sf_dir: str, topic: str = "project", before: str = "2024-03-01") -> DataFrame:
    """Deletion events of a topic and of what is older than a date: facts are retracted, episodes deleted, each once."""
    f, e = facts(spark, sf_dir), eps(spark, sf_dir)
    about = [F.coalesce(F.lower(c).contains(topic), F.lit(False)) for c in ("subject", "object", "topic", "summary")]
    old = F.coalesce(F.col("created_at") < at(before), F.lit(False))
    a = f.where(F.col("is_active") & (about[0] | about[1] | old)).select(F.lit("retract").alias("kind"), "id", F.lit("fact").alias("what"))
    b = e.where(about[2] | about[3] | old).select(F.lit("delete").alias("kind"), "id", F.lit("episode").alias("what"))
    return a.unionByName(b).distinct()


def knowledge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges: entities (objects under 50 characters that aren't numbers), facts, causal links between their ends."""
    f = facts(spark, sf_dir).where("is_active and subject is not null and object is not null")
    entity = (F.length("object") < 50) & ~F.col("object").rlike(r"\A[0-9]+\z")
    e = lambda c: F.concat(F.lit("entity:"), F.col(c))
    fact = F.concat(F.lit("fact:"), F.col("id"))
    nodes = f.select(e("subject").alias("src")).unionByName(f.where(entity).select(e("object").alias("src"))).unionByName(f.select(fact.alias("src"))).distinct().select(F.lit("node").alias("what"), "src", F.lit(None).cast("string").alias("dst"))
    edges = f.select(e("subject").alias("src"), fact.alias("dst")).unionByName(f.where(entity).select(fact.alias("src"), e("object").alias("dst")))
    k = links(spark, sf_dir).where("cause_id is not null and effect_id is not null")
    causal = k.select(F.concat_ws(":", "cause_type", "cause_id").alias("src"), F.concat_ws(":", "effect_type", "effect_id").alias("dst"))
    return nodes.unionByName(edges.unionByName(causal).distinct().select(F.lit("edge").alias("what"), "src", "dst"))


def win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square of wins, losses and ties of salience against utility per topic; 5.991 is the bound of two degrees of freedom."""
    e = eps(spark, sf_dir).where("topic is not null and emotional_salience is not null and utility_score is not null")
    s, u = F.round("emotional_salience", 1), F.round("utility_score", 1)
    n = e.groupBy("topic").agg(F.count_if(s > u).alias("wins"), F.count_if(s < u).alias("losses"), F.count_if(s == u).alias("ties"))
    third = (F.col("wins") + F.col("losses") + F.col("ties")) / 3
    chi = sum(((F.col(c) - third) ** 2 / third for c in ("wins", "losses", "ties")), F.lit(0.0))
    return n.select("topic", F.round(chi, 5).alias("chi"), (chi > 5.991).alias("significant"))


def tier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests beyond the limit of each tier in the six hours up to them (tiers by user: id modulo four)."""
    ev = events(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("key").orderBy(F.unix_seconds("at")).rangeBetween(-6 * 3600, 0))
    tier = F.element_at(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(m).alias("most")) for t, m in (("free", 1), ("personal", 2), ("pro", 3), ("team", 4))]), (F.col("key") % 4 + 1).cast("int"))
    return ev.select("key", n.alias("n"), tier.alias("t")).where("n > t.most").groupBy(F.col("t.tier").alias("tier")).agg(F.count("*").alias("limited"))


def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words longer than three letters in predicate and object per subject, but the user."""
    f = facts(spark, sf_dir).where("subject is not null and lower(subject) <> 'user'")
    words = F.explode(F.split(F.lower(F.concat_ws(" ", F.replace("predicate", F.lit("_"), F.lit(" ")), "object")), "[^a-z0-9]+"))
    return f.select(F.lower("subject").alias("subject"), words.alias("word")).where(F.length("word") > 3).groupBy("subject", "word").agg(F.count("*").alias("n"))


# Words that ask for memory, by a part of the word that they are told from.
TRIGGERS = {"hatırla": ("remember", "memory", "recall"), "konuşma": ("conversation", "chat", "talk"), "proje": ("project", "build", "develop"), "çalışma": ("work", "project", "build"), "görev": ("task", "mission", "goal"), "plan": ("plan", "goal", "roadmap"),
            "nerede": ("where", "location", "place"), "kaldık": ("last", "previous", "continue"), "kalmıştık": ("last", "previous", "continue"), "sevdiğin": ("prefer", "like", "love", "favorite"), "biliyorsun": ("know", "remember", "fact")}


def expanded(message: str) -> list[str]:
    """Words of a message longer than three letters, with those that its trigger words stand for."""
    words = [w for w in message.lower().split() if len(w) > 3]
    return list(dict.fromkeys(words + [x for w in words for t, xs in TRIGGERS.items() if t in w for x in xs]))


def bot_recall(spark: SparkSession, sf_dir: str, message: str = "proje hakkında coffee") -> DataFrame:
    """The fifteen most confident facts about the user, then the ten best others that hold a word of the message."""
    f = facts(spark, sf_dir).where("is_active")
    order = [F.desc_nulls_last("confidence"), "id"]
    core = f.where("lower(subject) = 'user'").orderBy(*order).limit(15).select("id", F.lit("core").alias("kind"))
    text = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    hit = reduce(lambda a, b: a | b, [text.contains(w) for w in expanded(message)], F.lit(False))
    return core.unionByName(f.where(hit).join(core.select("id"), "id", "left_anti").orderBy(*order).limit(10).select("id", F.lit("word").alias("kind")))


QUERIES = {f.__name__: f for f in (store_statistics, memory_limits, health_score, confidence_decay, forgotten, knowledge_graph, win_loss, tier_rates, keyword_index, bot_recall)}

_PROCS = RETRIEVAL_ORACLES["merged_procedures"]
_STATS = f"""p as ({_PROCS}), {EPS}, {LINKS}, {LOG},
st as (select (select count(*) from eps) as episodes, (select epoch_us(min(created_at)) from eps) as oldest_us, (select epoch_us(max(created_at)) from eps) as newest_us, (select count(*) from facts) as facts_n, (select count(*) from facts where is_active) as active,
  (select round(avg(confidence), 6) from facts where is_active) as avg_confidence, (select count(distinct agent_id) from facts) as agents_n, (select count(*) from facts where user_affirmed) as affirmed, (select count(*) from links) as links_n, (select count(*) from p) as procedures,
  (select count(*) from log) as changes, (select count(*) from log where kind = 'retract') as retracted), sz as (select *, (episodes * 500 + facts_n * 200 + links_n * 300 + procedures * 250 + changes * 300)::bigint as size_bytes from st)"""
_WORDS = "[" + ", ".join("'" + w + "'" for w in expanded("proje hakkında coffee")) + "]"
ORACLES = {
    "store_statistics": f"with {_STATS} select * from sz",
    "memory_limits": f"with {_STATS} " + " union all ".join(f"select '{k}' as kind, {k}::bigint as n, {k} > {v} as over_limit from sz" for k, v in LIMITS.items()),
    "health_score": f"""with {FACTS}, d as (select count(*) as n from facts where is_active group by lower(subject), lower(predicate) having count(*) > 1), q as ({MEMORY_ORACLES['low_quality_facts']}), a as (select id from facts where is_active),
x as (select (select coalesce(sum(case when n > 10 then 5 when n > 5 then 2 else 1 end), 0) from d) + (select coalesce(sum(case why when 'meaningless' then 5 when 'truncated' then 2 else 1 end), 0) from q where id in (select id from a))
  + (select count(*) from facts where is_active and not coalesce(user_affirmed, false) and coalesce(len(evidence), 0) = 0) + (select count(*) from facts where is_active and not coalesce(user_affirmed, false) and access_count = 0 and last_confirmed < timestamp '2025-11-01 00:00:00') as p, (select count(*) from a) as n)
select p::bigint as penalty, floor(greatest(0.0, 100 - p / (2.0 * n) * 100) + 0.5)::double as health from x""",
    "confidence_decay": f"with {FACTS}, d as (select *, floor((epoch_us(timestamp '2025-12-01 00:00:00') - epoch_us(created_at)) / (30 * 86400000000.0)) as m from facts where is_active and confidence is not null and access_count <= 5), n as (select id, round(confidence - 0.05 * m + least(access_count * 0.02, 0.1), 6)::double as confidence from d where m >= 1) select *, confidence < 0.2 as retract from n",
    "forgotten": f"with {FACTS}, {EPS} select distinct 'retract' as kind, id, 'fact' as what from facts where is_active and (contains(lower(subject), 'project') or contains(lower(object), 'project') or created_at < timestamp '2024-03-01 00:00:00') union all select distinct 'delete', id, 'episode' from eps where contains(lower(topic), 'project') or contains(lower(summary), 'project') or created_at < timestamp '2024-03-01 00:00:00'",
    "knowledge_graph": rf"""with {FACTS}, {LINKS}, f as (select *, length(object) < 50 and not regexp_matches(object, '\A[0-9]+\z') as ent from facts where is_active and subject is not null and object is not null)
select 'node' as what, src, null::varchar as dst from (select 'entity:' || subject as src from f union select 'entity:' || object from f where ent union select 'fact:' || id from f)
union all select 'edge', src, dst from (select 'entity:' || subject as src, 'fact:' || id as dst from f union select 'fact:' || id, 'entity:' || object from f where ent union select concat_ws(':', cause_type, cause_id), concat_ws(':', effect_type, effect_id) from links where cause_id is not null and effect_id is not null)""",
    "win_loss": f"with {EPS}, n as (select topic, count(*) filter (round(emotional_salience, 1) > round(utility_score, 1)) as w, count(*) filter (round(emotional_salience, 1) < round(utility_score, 1)) as l, count(*) filter (round(emotional_salience, 1) = round(utility_score, 1)) as t from eps where topic is not null and emotional_salience is not null and utility_score is not null group by topic), c as (select topic, ((w - (w + l + t) / 3.0::double) ** 2 + (l - (w + l + t) / 3.0::double) ** 2 + (t - (w + l + t) / 3.0::double) ** 2) / ((w + l + t) / 3.0::double) as chi from n) select topic, round(chi, 5) as chi, chi > 5.991 as significant from c",
    "tier_rates": "with e as (select user_id, epoch(ts)::bigint as s, count(*) over (partition by user_id order by epoch(ts)::bigint range between 21600 preceding and current row) as n from events), t as (select ['free', 'personal', 'pro', 'team'][user_id % 4 + 1] as tier, user_id % 4 + 1 as most, n from e) select tier, count(*) as limited from t where n > most group by tier",
    "keyword_index": f"with {FACTS}, w as (select lower(subject) as subject, unnest(string_split_regex(lower(concat_ws(' ', replace(predicate, '_', ' '), object)), '[^a-z0-9]+')) as word from facts where subject is not null and lower(subject) <> 'user') select subject, word, count(*) as n from w where length(word) > 3 group by all",
    "bot_recall": f"with {FACTS}, c as (select id from facts where is_active and lower(subject) = 'user' order by confidence desc nulls last, id limit 15) select id, 'core' as kind from c union all (select id, 'word' from facts where is_active and id not in (select id from c) and len(list_filter({_WORDS}, lambda w: contains(lower(concat_ws(' ', subject, predicate, object)), w))) > 0 order by confidence desc nulls last, id limit 10)",
}
