"""Queries over the causal graph and of records told apart by text, with DuckDB SQL of their meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import graph as G
from engram.operators import memory as M
from engram.operators import retrieval as R
from engram.plans.core_problems import table
from engram.plans.memory_queries import FACTS, LINKS, facts, links

TARGET = "plans around the night train changed"


def fact_change_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.change_causes(facts(spark, sf_dir))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).where("predicate = 'works_at' and confidence >= 0.9").select(F.col("id").alias("node"))


def causal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of up to three links from sure employments."""
    return G.paths(links(spark, sf_dir), _seeds(spark, sf_dir)).select(F.array_join("path", ">").alias("path"), F.round("score", 6).alias("score"))


def path_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = facts(spark, sf_dir).select(F.col("id").alias("node"), F.concat_ws(" ", "subject", "predicate", "object").alias("name"))
    told = G.narrative(G.paths(links(spark, sf_dir), _seeds(spark, sf_dir), 2), names)
    return told.select(F.array_join("path", ">").alias("path"), "story")


def text_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to five links to the target, from the links of one agent that are sure."""
    mine = links(spark, sf_dir).where("confidence >= 0.9")
    return G.chain_by_text(mine, TARGET, least=0.9 - 0.05).select("root", "id", "depth", F.round("total", 6).alias("total"))


def target_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like each effect is to the target text."""
    t = links(spark, sf_dir).where("effect is not null").select("id", F.round(R.text_similarity(F.col("effect"), F.lit(TARGET)), 6).alias("score"))
    return t.where("score >= 0.15")


def entity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entity_gate(facts(spark, sf_dir), "mafick team", ["festival", "coffee"])


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like each fact's object is to its class's best one (of subject and predicate)."""
    f = facts(spark, sf_dir).where("is_active and subject is not null and predicate is not null and object is not null")
    best = M.top_by(f, [F.lower("subject").alias("s"), F.lower("predicate").alias("p")], M.best_rank()).where("n > 1")
    text = best.join(f.select(F.col("id").alias("best"), F.col("object").alias("b")), "best").select("s", "p", "best", "b")
    met = f.select("id", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), "object").join(text, ["s", "p"]).where("id <> best")
    return met.select("id", "best", F.round(M.fuzzy(F.col("object"), F.col("b")), 6).alias("score"))


def valid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of two members or more."""
    from engram.operators import folds

    members = folds.leader_clusters(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return members.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2")


QUERIES = {f.__name__: f for f in (fact_change_causes, causal_paths, path_stories, text_chains, target_likeness, entity_gates, fuzzy_best, valid_clusters)}

_WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9_[:space:]]', ' ', 'g'), '\\s+'), lambda w: length(w) > {n}))"


def likeness_sql(a: str, b: str) -> str:
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9_[:space:]]', ' ', 'g'))"
    x, y, kx, ky = (_WORDS.format(c=c, n=n) for n in (2, 4) for c in (a, b))
    return f"""case when contains({norm(a)}, {norm(b)}) or contains({norm(b)}, {norm(a)}) then 0.85 when len({x}) = 0 or len({y}) = 0 then 0.0 else greatest(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::double,
  0.7 * len(list_filter({x}, lambda w: len(list_filter({y}, lambda v: contains(w, v) or contains(v, w))) > 0)) / len({x}), case when len({kx}) > 0 and len({ky}) > 0 then 0.8 * len(list_intersect({kx}, {ky})) / least(len({kx}), len({ky})) else 0.0 end) end"""


_PATHS = """g as (select * from links where confidence >= 0.3 and cause_id is not null and effect_id is not null and cause_id <> effect_id), ed as (select a, b, max(c) as c from (select cause_id a, effect_id b, confidence c from g union all select effect_id, cause_id, confidence from g) group by a, b),
p(a, path, score, n) as (select distinct id, [id], 1.0::double, 0 from facts where predicate = 'works_at' and confidence >= 0.9 union all select ed.b, list_append(path, ed.b), score * c, n + 1 from p join ed on ed.a = p.a where n < {hops} and not list_contains(path, ed.b))"""
_LETTERS = "list_distinct(list_filter(string_split({}, ''), lambda w: w <> ''))"
_TOKENS = "list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"
_OVER = lambda x, y: f"len(list_intersect({x}, {y})) / greatest(len(list_distinct(list_concat({x}, {y}))), 1)::double"
ORACLES = {
    "fact_change_causes": f"with {FACTS}, f as (select * from facts where predicate in ('prefers', 'uses', 'works_at') and object is not null) select a.id as old_id, (select b.id from f b where b.is_active and b.agent_id = a.agent_id and b.subject = a.subject and b.predicate = a.predicate and b.object <> a.object order by b.last_confirmed desc nulls first, b.id limit 1) as new_id from f a where not a.is_active and exists (select 1 from f b where b.is_active and b.agent_id = a.agent_id and b.subject = a.subject and b.predicate = a.predicate and b.object <> a.object)",
    "causal_paths": f"with recursive {FACTS}, {LINKS}, {_PATHS.format(hops=3)} select array_to_string(path, '>') as path, round(score, 6) as score from p where n > 0",
    "path_stories": f"with recursive {FACTS}, {LINKS}, {_PATHS.format(hops=2)}, x as (select path, unnest(path) as node, generate_subscripts(path, 1) as i from p where n > 0), n as (select id, min(concat_ws(' ', subject, predicate, object)) as name from facts group by id), t as (select path, string_agg(coalesce(name, node), ' -> ' order by i) as s from x left join n on n.id = x.node group by path) select array_to_string(path, '>') as path, case when length(s) > 2000 then left(s, 1997) || '...' else s end as story from t",
    "target_likeness": f"with {LINKS}, s as (select id, {likeness_sql('effect', chr(39) + TARGET + chr(39))} as score from links where effect is not null) select id, round(score, 6)::double as score from s where round(score, 6) >= 0.15",
    "entity_gates": f"with {FACTS}, r as (select lower(subject) as s, count(*) as k, sum(contains(lower(concat_ws(' ', predicate, object)), 'festival')::int + contains(lower(concat_ws(' ', predicate, object)), 'coffee')::int)::bigint as h from facts where subject is not null group by 1 having count(*) >= 20), o as (select h as n from r where s = 'mafick team'), x as (select s as other, h as m from r where s <> 'mafick team' order by h desc, s desc limit 1) select 'mafick team' as person, n, other, m, (n = 0 and m > 0) or m > 3 * n as blocked from o, x",
    "fuzzy_best": f"""with {FACTS}, g as (select id, lower(regexp_replace(replace(object, 'İ', 'i'), '^ +| +$', '', 'g')) as x, lower(regexp_replace(replace(first_value(object) over w, 'İ', 'i'), '^ +| +$', '', 'g')) as y, first_value(id) over w as best from facts where is_active and subject is not null and predicate is not null and object is not null window w as (partition by lower(subject), lower(predicate) order by coalesce(user_affirmed, false) desc, coalesce(confidence, -1) desc, len(evidence) desc nulls last, length(object) desc, id))
select id, best, round(case when x = y then 1.0 when contains(x, y) or contains(y, x) then 0.9 else greatest({_OVER(_TOKENS.format('x'), _TOKENS.format('y'))}, {_OVER(_LETTERS.format('x'), _LETTERS.format('y'))}) end, 6)::double as score from g where id <> best""",
}
