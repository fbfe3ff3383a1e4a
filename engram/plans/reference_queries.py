"""Relational memory operators: filters, joins, merges, ranking, retention, time, graph, rules.

Each is one declarative statement in the common part of Spark SQL and DuckDB SQL; the few functions that are
named differently are written in capitals and translated per engine. Replayed rows count once throughout
(``facts``, ``eps``, ``links`` are distinct rows; a confidence outside 0..1, NaN included, is null), ties are broken by id, and time is an argument (AS_OF).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.graph import chain_by_id

AS_OF = "timestamp '2025-12-01 00:00:00'"
VIEWS = {
    "facts": "select distinct id, agent_id, subject, predicate, object, case when confidence between 0 and 1 then confidence end as confidence, first_seen, last_confirmed, user_affirmed, is_active, retracted_reason, access_count, created_at, updated_at from sheep_facts",
    "eps": "select distinct id, agent_id, summary, topic, emotional_salience, utility_score, session_id, ttl, access_count, created_at, updated_at from sheep_episodes",
    "links": "select distinct id, agent_id, cause_type, cause_id, cause, effect_type, effect_id, effect, mechanism, confidence, strength, created_at from sheep_causal_links",
    "msgs": "select distinct agent_id, session_id, msg_id, seq, role, content from raw_messages",
    "reqs": "select distinct request_id, agent_id, session_id, query_text, mode_name, received_at from recall_requests",
}
TABLES = ("agents", "raw_messages", "sheep_episodes", "sheep_facts", "sheep_causal_links", "recall_requests", "documents", "embeddings", "events", "orders", "customer")
SPARK = {"MICROS": "unix_micros", "MATCHES": "regexp_like", "UNNEST": "explode", "SIZE": "size", "SHA": "sha2", "SHA_END": ", 256)", "STRPOS": "instr"}
DUCK = {"MICROS": "epoch_us", "MATCHES": "regexp_matches", "UNNEST": "unnest", "SIZE": "len", "SHA": "sha256", "SHA_END": ")", "STRPOS": "strpos"}

#: Capitalised words that are no names.
COMMON = "the and for are but not you all can her was one our out day get has him his how its may new now old see two way who boy did man try use she many some time very when come here just like long make over such take than them well were".split()

NEGATION = "not|no|never|none|neither|without|lack|absent|opposite|contrary"


def _normalised(col: str, duck: bool) -> str:
    """A text as part of a template's signature: without addresses, phone numbers, links and names, lower case, other signs as '_'."""
    text, r, g = f"coalesce({col}, '')", "" if duck else "r", ", 'g'" if duck else ""
    for pattern, kind in ((r"\b[\w.-]+@[\w.-]+\.\w+\b", "email"), (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "phone"), (r"https?://[^\s]+", "url")):
        text = f"regexp_replace({text}, {r}'{pattern}', '[{kind}]'{g})"
    common = ", ".join(f"'{w}'" for w in COMMON)
    word = f"case when length(w) >= 3 and not (w like '[%]') and substring(w, 1, 1) = upper(substring(w, 1, 1)) and lower(w) not in ({common}) then '[name]' else w end"
    words = f"array_to_string(list_transform(string_split_regex({text}, '\\s+'), lambda w: {word}), ' ')" if duck else f"array_join(transform(split({text}, r'\\s+'), w -> {word}), ' ')"
    return f"regexp_replace(lower({words}), '[^a-z0-9]', '_'{g})"


def _translate(sql: str, names: dict[str, str], duck: bool) -> str:
    g = ", 'g'" if duck else ""
    sql = sql.replace("AS_OF", AS_OF)
    split = "string_split" if duck else "split"
    sql = re.sub(r"TOKENS\((\w+)\)", rf"{split}(trim(lower(regexp_replace(\1, '[^A-Za-z0-9_]+', ' '{g}))), ' ')", sql)
    sql = re.sub(r"SHA\((.*?)\)#", lambda m: f"sha256({m[1]})" if duck else f"sha2({m[1]}, 256)", sql)
    dot = "list_sum(list_transform(list_zip(\\1, \\2), lambda z: z[1]::double * z[2]::double))" if duck else "aggregate(zip_with(\\1, \\2, (x, y) -> cast(x as double) * cast(y as double)), 0D, (a, x) -> a + x)"
    sql = re.sub(r"DOT\(([\w.]+), ([\w.]+)\)", dot, sql)
    sql = re.sub(r"TRIM\((\w+)\)", rf"regexp_replace(\1, '^[ ]+|[ ]+$', ''{g})", sql)
    sql = re.sub(r"SQUEEZED\((\w+)\)", rf"regexp_replace(lower(\1), '[^a-z0-9]', ''{g})", sql)
    sql = re.sub(r"UNNEGATED\((\w+)\)", rf"regexp_replace(regexp_replace(lower(\1), '{NEGATION}', ''{g}), '[^a-z0-9]', ''{g})", sql)
    # One in the other, or more than 0.8 of their characters in common.
    common, either = ("len(list_intersect(string_split(\\1, ''), string_split(\\2, '')))", "len(list_distinct(string_split(concat(\\1, \\2), '')))") if duck else ("size(array_remove(array_intersect(split(\\1, ''), split(\\2, '')), ''))", "size(array_remove(array_distinct(split(concat(\\1, \\2), '')), ''))")
    sql = re.sub(r"SIMILAR\(([\w.]+), ([\w.]+)\)", rf"(\1 = '' or \2 = '' or STRPOS(\1, \2) > 0 or STRPOS(\2, \1) > 0 or 5 * {common} > 4 * {either})", sql)
    sql = re.sub(r"NORMALISED\((\w+)\)", lambda m: _normalised(m[1], duck), sql)
    # Decimal literals are doubles in both engines.
    sql = re.sub(r"(?<![\w.])\d+\.\d+(?![\w.])", r"\g<0>e0", sql)
    for k in ("MICROS", "MATCHES", "UNNEST", "SIZE", "STRPOS"):
        sql = re.sub(rf"\b{k}\(", names[k] + "(", sql)
    return sql


def _with(sql: str) -> str:
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} as ({VIEWS[v]})" for v in used]
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return "with recursive " + ", ".join(parts + [body[len("with recursive"):].strip()])
    if body.lower().startswith("with"):
        return "with " + ", ".join(parts + [body[4:].strip()])
    return ("with " + ", ".join(parts) + " " if parts else "") + body


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = _translate(_with(sql), SPARK, False)
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        for t in used:
            df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            df = df.select(*[df[c].cast("timestamp").alias(c) if kind == "timestamp_ntz" else df[c] for c, kind in df.dtypes])
            df.createOrReplaceTempView(t)
        return spark.sql(text)

    return run


FACT_CAUSAL = "(select distinct k from (select cause_id k from links where cause_type = 'fact' union all select effect_id from links where effect_type = 'fact') u)"

SQL = {
    # filters and lookups
    "episode_query": "select id, topic, emotional_salience from eps where topic ilike '%garden%' and emotional_salience >= 0.5 and created_at >= timestamp '2024-06-01 00:00:00'",
    "fact_query": "select id, subject, object, confidence from facts where predicate = 'likes' and is_active and confidence >= 0.6",
    "link_query": "select id, cause_id, effect_id, confidence from links where confidence >= 0.8 and strength = 'direct'",
    "facts_about_topic": "select id from facts where STRPOS(lower(subject), 'garden') > 0 or STRPOS(lower(predicate), 'plans') > 0 or STRPOS(lower(object), 'museum') > 0",
    "causal_by_text": "select id, case when STRPOS(lower(cause), 'router') > 0 then 'effects' else 'causes' end as found_as from links where STRPOS(lower(cause), 'router') > 0 or STRPOS(lower(effect), 'router') > 0",
    "metadata_search": """select id, round(least(1.0, 0.7 * confidence + 0.3 * ((case when subject = 'user' then 1 else 0 end) + (case when predicate in ('likes', 'prefers') then 1 else 0 end)) / 2.0), 6) as score
      from facts where subject = 'user' and predicate in ('likes', 'prefers') and confidence is not null""",
    "session_facts": "with ev as (select distinct id, UNNEST(evidence) as ep from sheep_facts) select distinct ev.id, e.session_id from ev join eps e on e.id = ev.ep",
    "explain_belief": "with ev as (select distinct id, UNNEST(evidence) as ep from sheep_facts) select ev.id, ev.ep, e.topic, e.id is null as missing from ev left join eps e on e.id = ev.ep",
    "primary_predicates": "select predicate, count(*) as n from facts where predicate in ('likes', 'works_at', 'lives_at', 'has_name') or confidence >= 0.95 group by predicate",
    "hosted_why": "select id, confidence from links where STRPOS(lower(concat(cause, ' ', effect, ' ', coalesce(mechanism, ''))), 'garden') > 0 order by confidence desc nulls last, id limit 10",
    "core_facts_per_subject": "select subject, id, confidence from (select *, row_number() over (partition by subject order by confidence desc nulls last, id) as rn from facts where is_active) x where rn <= 3",
    "exact_upsert": "select lower(TRIM(subject)) as s, lower(TRIM(predicate)) as p, lower(TRIM(object)) as o, max(confidence) as confidence, count(*) as n from facts group by 1, 2, 3",
    "template_mining": "with s as (select concat(NORMALISED(cause), '→', NORMALISED(effect), '→', NORMALISED(mechanism)) as sig, confidence from links where confidence is not null) select sig, count(*) as n, round(avg(confidence), 6) as mean from s group by sig having count(*) >= 2 and avg(confidence) >= 0.6",
    "confidence_distribution": "select case when confidence >= 0.9 then 'high' when confidence >= 0.7 then 'good' when confidence >= 0.5 then 'medium' when confidence is null then 'none' else 'low' end as bucket, count(*) as n from facts group by 1",
    "daily_quota": "select agent_id, cast(MICROS(date_trunc('day', received_at)) as bigint) as day_us, count(*) as n, count(*) > 20 as over_quota from reqs group by 1, 2",
    "usage_by_mode": "select coalesce(lower(mode_name), 'none') as mode_name, count(*) as n from reqs where received_at > AS_OF - interval 300 day group by 1",
    "stale_facts": "select id from facts where is_active and access_count = 0 and last_confirmed < AS_OF - interval 30 day",
    # joins
    "causal_endpoints": f"select f.id, c.k is not null as is_endpoint from facts f left join {FACT_CAUSAL} c on c.k = f.id",
    "known_preferences": "select f.id from facts f where f.predicate in ('likes', 'prefers') and not exists (select 1 from facts g where g.predicate = 'dislikes' and lower(trim(g.object)) = lower(trim(f.object)))",
    "preference_derivation": "select id, object, case when predicate in ('dislikes', 'hates', 'prefers_not') then 'negative' else 'positive' end as sentiment from facts where lower(subject) = 'user' and predicate in ('likes', 'loves', 'prefers', 'dislikes', 'hates', 'prefers_not')",
    "ttl_expiry": "select id from eps where (ttl = '7d' and created_at < AS_OF - interval 7 day) or (ttl = '30d' and created_at < AS_OF - interval 30 day) or (ttl = '90d' and created_at < AS_OF - interval 90 day)",
    "when_learned": "select subject, predicate, MICROS(min(first_seen)) as learned_us, min_by(id, concat(cast(MICROS(first_seen) as varchar(20)), id)) as id from facts group by subject, predicate",
    "temporal_neighbourhood": "select a.id, count(*) as near from facts a join eps e on e.agent_id = a.agent_id and e.created_at between a.created_at - interval 7 day and a.created_at + interval 7 day group by a.id",
    # graph
    "causal_chain": "with recursive chain(root, id, cause_id, depth) as (select id, id, cause_id, 1 from links where effect_type = 'fact' and confidence >= 0.9 union all select c.root, l.id, l.cause_id, c.depth + 1 from chain c join links l on l.effect_id = c.cause_id where c.depth < 4) select distinct root, id, depth from chain",
    "graph_degrees": "select node, count(*) as degree from (select cause_id as node from links where cause_id is not null union all select effect_id from links where effect_id is not null) u group by node",
    "predicate_normalise": "select id, lower(replace(TRIM(predicate), ' ', '_')) as predicate from facts",
    "idle_gaps": "select user_id, count(*) as sessions from (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as prev from events) x where prev is null or MICROS(ts) - MICROS(prev) > 7200000000 group by user_id",
    "sleep_decision": "with a as (select agent_id, count(*) as n, (MICROS(AS_OF) - MICROS(max(received_at))) / 3600000000.0 as idle from reqs group by agent_id) select agent_id, n > 50 or (idle > 1 and n > 10) or (idle > 6 and n > 5) or idle > 24 as due from a",
    "causal_contradictions": f"""with n as (select id, agent_id, lower(cause) as c, lower(effect) as e, SQUEEZED(cause) as ck, SQUEEZED(effect) as ek from links where cause is not null and effect is not null),
      t as (select agent_id, c as x from n union select agent_id, e from n), w as (select agent_id, x, MATCHES(x, '{NEGATION}') as neg, UNNEGATED(x) as k, SQUEEZED(x) as s from t),
      opp as (select a.agent_id, a.x, b.x as y, SIMILAR(a.s, b.s) as near from w a join w b on a.agent_id = b.agent_id where a.neg and not b.neg and SIMILAR(a.k, b.k)), o as (select agent_id, x, y, near from opp union all select agent_id, y, x, near from opp)
      select a.id as a_id, b.id as b_id, 'same_cause_different_effect' as type from o join n a on a.agent_id = o.agent_id and a.e = o.x join n b on b.agent_id = o.agent_id and b.e = o.y where not o.near and a.id < b.id and SIMILAR(a.ck, b.ck)
      union all select a.id, b.id, 'same_effect_different_cause' from o join n a on a.agent_id = o.agent_id and a.c = o.x join n b on b.agent_id = o.agent_id and b.c = o.y where a.id < b.id and SIMILAR(a.ek, b.ek)""",
    "causal_confidence": "select id, round(least(1.0, greatest(0.1, 0.5 + (case when strength = 'direct' then 0.2 when strength = 'contributing' then 0.1 else 0 end) + (case when length(coalesce(mechanism, '')) > 0 then 0.15 else 0 end) - (case when length(cause) < 10 then 0.15 else 0 end))), 6) as confidence from links",
    "fact_confidence": "select id, round(least(1.0, greatest(0.0, 0.5 + (case when predicate in ('has_name', 'works_at', 'lives_at') then 0.15 else 0 end) + (case when user_affirmed then 0.2 else 0.1 end) - (case when length(object) < 4 then 0.2 else 0 end))), 6) as confidence from facts",
    "ttl_assignment": "select id, case when (emotional_salience + utility_score) / 2 > 0.8 then 'permanent' when (emotional_salience + utility_score) / 2 > 0.6 then '90d' when (emotional_salience + utility_score) / 2 > 0.4 then '30d' else '7d' end as ttl from eps where emotional_salience is not null and utility_score is not null",
    "document_texts": "select id, concat_ws(' ', subject, replace(predicate, '_', ' '), object) as doc from facts union all select id, concat_ws(' ', cause, 'causes', effect) from links",
    "profile_stability": "select subject, predicate, count(*) as n, count(*) >= 3 and (MICROS(max(created_at)) - MICROS(min(created_at))) >= 604800000000 as stable from facts where is_active group by subject, predicate",
    "predicate_success": "select predicate, round(sum(case when user_affirmed then 1 else 0 end) / cast(count(*) as double), 6) as success_rate, count(*) as used from facts group by predicate",
    "one_sample_t": "with s as (select predicate, avg(confidence) as m, stddev_samp(confidence) as sd, count(confidence) as n from facts group by predicate) select predicate, round((m - 0.5) / (sd / sqrt(n)), 5) as t from s where n >= 5 and sd > 0",
    "precision_by_tag": "select topic, round(sum(case when emotional_salience >= 0.5 and utility_score >= 0.5 then 1 else 0 end) / cast(greatest(sum(case when emotional_salience >= 0.5 then 1 else 0 end), 1) as double), 6) as prec, count(*) as n from eps group by topic",
    "weekly_activity": "select agent_id, MICROS(date_trunc('week', created_at)) as week_us, count(*) as n from eps group by 1, 2",
    "trust_scores": "select agent_id, round(0.6 * least(count(*), 100) / 100.0 + 0.4 * avg(case when is_active then 1.0 else 0.0 end), 6) as trust from facts group by agent_id",
    "order_status_as_of": "select o_custkey, max(o_orderkey) as last_order, MICROS(max(o_orderdate)) as at_us from orders where o_orderdate <= timestamp '1997-01-01 00:00:00' group by o_custkey",
}
TABLES = (*TABLES, "sheep_fact_snapshots")


def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL["causal_chain"] by rounds of joins: Spark's recursion keeps every way to a link and ends with an error beyond a million rows."""
    links = spark.read.parquet(f"{sf_dir}/sheep_causal_links.parquet").select("id", "cause_id", "effect_type", "effect_id", "confidence")
    return chain_by_id(links, (F.col("effect_type") == "fact") & F.col("confidence").between(0.9, 1))


QUERIES = {name: _query(sql) for name, sql in SQL.items()} | {"causal_chain": causal_chain}
ORACLES = {name: _translate(_with(sql), DUCK, True) for name, sql in SQL.items()}
