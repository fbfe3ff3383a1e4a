"""Queries of ranked retrieval over whole tables. Query vectors are those whose id is divisible by 20.

A document's vector is the one of the same number; documents beyond have none and are found by words alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import retrieval as R
from engram.plans.core_problems import table
from engram.plans.rule_queries import extracted_procedures
from engram.session import fill_cores
from engram.plans.rule_queries import ORACLES as RULE_ORACLES

QUERY, PHRASE, PLACE = "the garden shed and the night train", '"garden shed" train', "garden"
EFFECT, HABIT = "plans changed kitchen", "when the night train fails restart"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_cores(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def asked(v: DataFrame) -> DataFrame:
    return v.where("id % 20 = 0")


def first_query(v: DataFrame) -> DataFrame:
    return v.where("id = 0")


def rounded(df: DataFrame, n: int = 6, *cols: str) -> DataFrame:
    for c in cols or ("score",):
        df = df.withColumn(c, F.round(c, n))
    return df


def recall_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.bm25(docs(spark, sf_dir), QUERY)).where("score >= 0.1").orderBy(F.desc("score"), "id").limit(10)


def fts_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.fts(docs(spark, sf_dir), PHRASE)).orderBy(F.desc("score"), "id").limit(20)


def substring_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.bm25_substring(docs(spark, sf_dir), "garden train"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(R.vector_topk(v, asked(v)), 5).select("qid", F.col("id").alias("vec_id"), F.col("score").alias("cosine"))


def vector_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(R.vector_best(v, asked(v)), 5, "best").select(F.col("id").alias("vec_id"), "best")


def vector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of each query under each other metric."""
    v = vectors(spark, sf_dir)
    parts = [rounded(R.vector_topk(v, asked(v), 3, 0.0, m), 5).withColumn("metric", F.lit(m)) for m in ("dot", "euclidean", "manhattan", "pearson")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New records (queries) and the stored one that each would be merged with: the nearest of likeness 0.3 or more."""
    v = vectors(spark, sf_dir)
    return rounded(R.vector_topk(v, asked(v), 1, 0.3), 5)


def vectors_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(R.by_label(v, asked(v)).select("qid", "label", "mean", "n"), 5, "mean")


def relevant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    means = R.by_label(v, asked(v)).groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("mean", 9)).alias("m"), "label"))), 1, 3).alias("x"))
    return means.select("qid", F.explode("x.label").alias("label"))


def similar_within_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return R.by_label(v, asked(v), least=0.1).where("own = label").select("qid", "n")


def vector_scores(spark: SparkSession, sf_dir: str, least: float = 0.1, k: int = 40) -> DataFrame:
    v = vectors(spark, sf_dir)
    return R.vector_topk(v, first_query(v), k, least, itself=True).select("id", "score")


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = R.fuse([(R.bm25(docs(spark, sf_dir), QUERY), 0.4, "words"), (vector_scores(spark, sf_dir), 0.6, "vector")], limit=40)
    return fused.select("id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


def hybrid_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 (0.4 / (60 + rank by words) + 0.6 / (60 + rank by vector)), ranks from 1, from 0.2 on, at most 1."""
    fused = R.fuse([(R.bm25(docs(spark, sf_dir), QUERY), 0.4, "words"), (vector_scores(spark, sf_dir, 0.0), 0.6, "vector")], limit=40)
    return fused.select("id", F.round(F.least(F.lit(1.0), 60 * F.col("score")), 6).alias("score")).where("score >= 0.2")


def linear_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = R.bm25(docs(spark, sf_dir), QUERY).select("id", (0.3 * F.col("score")).alias("s"))
    b = vector_scores(spark, sf_dir, -1.0, 10_000_000).select("id", (0.7 * F.col("score")).alias("s"))
    return a.unionByName(b).groupBy("id").agg(F.round(F.sum("s"), 6).alias("score"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata list: documents of one language and source, newest first."""
    return table(spark, sf_dir, "documents").where("lang = 'en' and created_at is not null").select(F.col("doc_id").alias("id"), F.unix_micros(F.col("created_at").cast("timestamp")).cast("double").alias("score"))


def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.hybrid([(R.bm25(docs(spark, sf_dir), QUERY), 0.3, "words"), (vector_scores(spark, sf_dir), 0.4, "vector"), (tagged(spark, sf_dir), 0.3, "tags")])
    return rounded(out).withColumn("sources", F.array_join("sources", ","))


def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.merge_results([(R.bm25(docs(spark, sf_dir), q), n) for q, n in (("garden shed", "a"), ("night train", "b"))])
    return rounded(out).withColumn("sources", F.array_join("sources", ","))


def agentic_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds until ten results: the query's words one by one where the whole finds too few."""
    d = docs(spark, sf_dir)
    out = R.agentic(lambda q: R.fts(d, q), "garden shed night train unheard", lambda f: f.count() >= 10, lambda q, _: ["garden shed", "night train"])
    return rounded(out.select("id", "score"))


def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = table(spark, sf_dir, "sheep_episodes").select("id", "summary").distinct()
    return eps.select("id", R.word_hits(F.col("summary"), "garden train router").alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(20)


def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and episodes that hold the whole query."""
    f = table(spark, sf_dir, "sheep_facts").where("is_active").where(F.lower(F.concat_ws(" ", "subject", "predicate", "object")).contains(PLACE)).select(F.lit("fact").alias("kind"), "id")
    e = table(spark, sf_dir, "sheep_episodes").where(F.lower(F.concat_ws(" ", "topic", "summary")).contains(PLACE)).select(F.lit("episode").alias("kind"), "id")
    return f.unionByName(e).distinct()


def semantic_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted fusion of words and vectors; what only holds the query gets 0.01; times 0.8 + 0.2 of n_chars / 10000 as trust."""
    d = docs(spark, sf_dir)
    lists = R.fuse([(R.bm25_substring(d, "garden train"), 1.0, "words"), (vector_scores(spark, sf_dir, 0.2), 1.0, "vector")], limit=40).select("id", "score")
    held = d.where(F.lower("text").contains("garden shed")).select("id", F.lit(0.01).alias("score"))
    best = lists.unionByName(held).groupBy("id").agg(F.max("score").alias("score"))
    trust = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (0.8 + 0.2 * F.least(F.coalesce("n_chars", F.lit(0)) / 10_000, F.lit(1.0))).alias("t"))
    return best.join(trust, "id").select("id", F.round(F.col("score") * F.col("t"), 7).alias("score"))


def causal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "sheep_causal_links").where("cause is not null and effect is not null").select("id", "cause", "effect").distinct()
    return links.select("id", F.round(R.effect_match(F.col("cause"), F.col("effect"), EFFECT), 6).alias("score")).where("score > 0.05")


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures of all episodes merged by the first 30 characters of trigger and action: examples and tags united.

    Use and success aren't in the tables: they are made from the lengths of the texts.
    """
    p = extracted_procedures(spark, sf_dir)
    key = [F.substring("trigger_text", 1, 30).alias("k1"), F.substring("action", 1, 30).alias("k2")]
    merged = p.groupBy(*key).agg(F.min(F.struct("id", "trigger_text", "action")).alias("f"), F.countDistinct("id").alias("examples"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("tags", ","))))), ",").alias("tags"))
    out = merged.select(F.col("f.trigger_text").alias("trigger_text"), F.col("f.action").alias("action"), "examples", "confidence", "tags", (F.length("f.trigger_text") % 20).alias("used"), ((F.length("f.action") % 11) / 10).alias("success"))
    return out


def merged_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procedures(spark, sf_dir)


def procedure_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trigger, success and tag; the most used of the best."""
    return procedures(spark, sf_dir).where(F.col("trigger_text").ilike("%the%") & (F.col("success") >= 0.3)).orderBy(F.desc("success"), F.desc("used"), "trigger_text", "action").limit(10).select("trigger_text", "action", "success", "used")


def procedure_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    scored = procedures(spark, sf_dir).withColumn("score", F.round(R.procedure_match(c("trigger_text"), c("action"), c("success"), c("used"), c("examples"), HABIT), 6))
    return scored.where("score >= 0.3").orderBy(F.desc("score"), "trigger_text", "action").limit(5).select("trigger_text", "action", "score")


def bridge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused results first, then what holds the query and isn't among them."""
    d = docs(spark, sf_dir)
    first = R.fuse([(R.bm25(d, QUERY), 0.4, "words"), (vector_scores(spark, sf_dir), 0.6, "vector")], limit=20).select("id", F.lit(1).alias("tier"), F.round("score", 9).alias("score"))
    then = d.where(F.lower("text").contains("garden shed")).select("id").join(first, "id", "left_anti").select("id", F.lit(2).alias("tier"), F.lit(0.01).alias("score"))
    return first.unionByName(then)


QUERIES = {f.__name__: f for f in (recall_bm25, fts_all_terms, substring_bm25, vector_topk, vector_best, vector_metrics, knn_join, vectors_by_label, relevant_labels, similar_within_label, rank_fusion, hybrid_outer, linear_fusion,
                                   hybrid_retrieve, merged_results, agentic_rounds, keyword_recall, keyword_fallback, semantic_recall, causal_search, merged_procedures, procedure_query, procedure_matches, bridge_search)}


def bm25_sql(query: str, name: str = "bm", norm: bool = True) -> str:
    """CTEs up to ``name`` (id, score) by exploded words, with the query's words as a table."""
    n = len(R.terms(query))
    return f"""tok{name} as (select doc_id as id, unnest(string_split(trim(lower(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g'))), ' ')) as term from documents), w{name} as (select * from tok{name} where length(term) > 1),
dl{name} as (select id, count(*) as dl from w{name} group by id), st{name} as (select count(*) as n, avg(dl) as avgdl from dl{name}), q{name} as (select term, count(*) as qn from (select unnest({R.terms(query)}) as term) group by term),
tf{name} as (select id, w.term, qn, count(*) as tf from w{name} w join q{name} q on q.term = w.term group by all), df{name} as (select term, count(*) as df from tf{name} group by term),
{name} as (select id, least(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) / {3 * n if norm else 1}.0, 1.0) as score, count(*) as k from tf{name} join df{name} using (term) join dl{name} using (id), st{name} group by id)"""


COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform({a}, lambda z: z::double * z::double))) * sqrt(list_sum(list_transform({b}, lambda z: z::double * z::double))))"
SIM = f"sim as (select q.vec_id as qid, q.label as own, v.vec_id, v.label, {COS.format(a='q.embedding', b='v.embedding')} as cosine, q.embedding as x, v.embedding as y from embeddings q join embeddings v on v.vec_id <> q.vec_id where q.vec_id % 20 = 0)"
VS = f"vs as (select v.vec_id as id, {COS.format(a='q.embedding', b='v.embedding')} as score from embeddings q, embeddings v where q.vec_id = 0)"
DOT = "list_sum(list_transform(list_zip(x, y), lambda z: z[1]::double * z[2]::double))"
FUSED = """l1 as (select id, row_number() over (order by score desc, id) as r from bm qualify r <= {n}), l2 as (select id, row_number() over (order by round(score, 9) desc, id) as r from vs where score >= {least} qualify r <= {n}),
fu as (select id, sum(w) as score, array_to_string(list_sort(list(s)), ',') as sources from (select id, 0.4 / (60 + r) as w, 'words' as s from l1 union all select id, 0.6 / (60 + r), 'vector' from l2) group by id)"""


def _metric(name: str) -> str:
    n = "len(x)"
    pairs = "list_zip(x, y)"
    return {"dot": f"({DOT} + 1) / 2", "euclidean": f"1 / (1 + sqrt(list_sum(list_transform({pairs}, lambda z: (z[1]::double - z[2]::double) ** 2))) / sqrt({n}))", "manhattan": f"1 / (1 + list_sum(list_transform({pairs}, lambda z: abs(z[1]::double - z[2]::double))) / {n})",
            "pearson": f"(list_sum(list_transform({pairs}, lambda z: (z[1]::double - list_avg(x)::double) * (z[2]::double - list_avg(y)::double))) / sqrt(list_sum(list_transform(x, lambda z: (z::double - list_avg(x)::double) ** 2)) * list_sum(list_transform(y, lambda z: (z::double - list_avg(y)::double) ** 2))) + 1) / 2"}[name]


_SUB = """d as (select doc_id as id, lower(text) as t from documents where text is not null), c as (select id, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) as dl, (length(t) - length(replace(t, 'garden', ''))) / 6.0 as a, (length(t) - length(replace(t, 'train', ''))) / 5.0 as b from d),
st as (select count(*) as n, avg(dl) as av, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from c),
sb as (select id, ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * dl / av)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * dl / av)) as score from c, st where a + b > 0)"""
_PROCS = f"""p0 as ({RULE_ORACLES['extracted_procedures']}), p1 as (select substr(trigger_text, 1, 30) as k1, substr(action, 1, 30) as k2, min_by(trigger_text, [id, trigger_text, action]) as trigger_text, min_by(action, [id, trigger_text, action]) as action, count(distinct id) as examples, max(confidence) as confidence, list(tags) as tl from p0 group by 1, 2),
procs as (select trigger_text, action, examples, confidence, array_to_string(list_sort(list_distinct(flatten(list_transform(tl, lambda x: string_split(x, ','))))), ',') as tags, length(trigger_text) % 20 as used, (length(action) % 11) / 10.0::double as success from p1)"""


def _like(c: str) -> str:
    own = f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9_[:space:]]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2))"
    words = str(list(dict.fromkeys(w for w in HABIT.split() if len(w) > 2)))
    return f"least(1.0, len(list_intersect({own}, {words})) / len(list_distinct(list_concat({own}, {words})))::double + case when contains(lower({c}), '{HABIT}') or contains('{HABIT}', lower({c})) then 0.2 else 0 end)"


_WORDS = str(EFFECT.split())
ORACLES = {
    "recall_bm25": f"with {bm25_sql(QUERY)} select id, round(score, 6) as score from bm where round(score, 6) >= 0.1 order by round(score, 6) desc, id limit 10",
    "fts_all_terms": f"with {bm25_sql('train garden shed')} select id, round(score, 6) as score from bm where k = 3 and id in (select doc_id from documents where contains(lower(text), 'garden shed')) order by round(score, 6) desc, id limit 20",
    "substring_bm25": f"with {_SUB} select id, round(score, 6) as score from sb",
    "vector_topk": f"with {SIM} select qid, vec_id, round(cosine, 5) as cosine from sim where cosine >= 0.1 qualify row_number() over (partition by qid order by round(cosine, 9) desc, vec_id) <= 10",
    "vector_best": f"with {SIM} select vec_id, round(max(cosine), 5) as best from sim group by vec_id having max(cosine) >= 0.3",
    "vector_metrics": f"with {SIM}, m as (" + " union all ".join(f"select qid, vec_id as id, '{m}' as metric, {_metric(m)} as score from sim" for m in ("dot", "euclidean", "manhattan", "pearson")) + ") select qid, id, metric, round(score, 5) as score from m where score >= 0 qualify row_number() over (partition by qid, metric order by round(score, 9) desc, id) <= 3",
    "knn_join": f"with {SIM} select qid, vec_id as id, round(cosine, 5) as score from sim where cosine >= 0.3 qualify row_number() over (partition by qid order by round(cosine, 9) desc, vec_id) <= 1",
    "vectors_by_label": f"with {SIM} select qid, label, round(avg(cosine), 5) as mean, count(*) as n from sim group by qid, label",
    "relevant_labels": f"with {SIM}, c as (select qid, label, avg(cosine) as m from sim group by qid, label) select qid, label from c qualify row_number() over (partition by qid order by round(m, 9) desc, label) <= 3",
    "similar_within_label": f"with {SIM} select qid, count(*) as n from sim where own = label and cosine >= 0.1 group by qid",
    "rank_fusion": f"with {bm25_sql(QUERY)}, {VS}, {FUSED.format(n=40, least=0.1)} select id, round(score, 9)::double as score, sources from fu",
    "hybrid_outer": f"with {bm25_sql(QUERY)}, {VS}, {FUSED.format(n=40, least=0.0)} select id, round(least(1.0, 60 * score), 6)::double as score from fu where round(least(1.0, 60 * score), 6) >= 0.2",
    "linear_fusion": f"with {bm25_sql(QUERY)}, {VS} select id, round(sum(s), 6) as score from (select id, 0.3 * score as s from bm union all select id, 0.7 * round(score, 9) from vs) group by id",
    "hybrid_retrieve": f"""with {bm25_sql(QUERY)}, {VS}, l1 as (select id, row_number() over (order by score desc, id) as r from bm qualify r <= 40), l2 as (select id, row_number() over (order by round(score, 9) desc, id) as r from vs where score >= 0.1 qualify r <= 40),
l3 as (select doc_id as id, row_number() over (order by created_at desc, doc_id) as r from documents where lang = 'en' and created_at is not null qualify r <= 40),
fu as (select id, sum(w) as s, array_to_string(list_sort(list(n)), ',') as sources from (select id, 0.3 / (60 + r) as w, 'words' as n from l1 union all select id, 0.4 / (60 + r), 'vector' from l2 union all select id, 0.3 / (60 + r), 'tags' from l3) group by id)
select id, round(s / (select max(s) from fu), 6)::double as score, sources from fu where s / (select max(s) from fu) >= 0.1 order by s desc, id limit 20""",
    "merged_results": f"with {bm25_sql('garden shed', 'ba')}, {bm25_sql('night train', 'bb')} select id, round(max(score), 6) as score, array_to_string(list_sort(list(s)), ',') as sources from (select id, score, 'a' as s from ba union all select id, score, 'b' from bb) group by id order by max(score) desc, id limit 50",
    "agentic_rounds": f"with {bm25_sql('garden shed', 'ba')}, {bm25_sql('night train', 'bb')} select id, round(max(score), 6) as score from (select id, score from ba where k = 2 union all select id, score from bb where k = 2) group by id order by max(score) desc, id limit 50",
    "keyword_recall": "with e as (select distinct id, lower(summary) as s from sheep_episodes), h as (select id, contains(s, 'garden')::int + contains(s, 'train')::int + contains(s, 'router')::int as hits from e) select id, hits from h where hits > 0 order by hits desc, id limit 20",
    "keyword_fallback": f"select distinct 'fact' as kind, id from sheep_facts where is_active and contains(lower(concat_ws(' ', subject, predicate, object)), '{PLACE}') union select 'episode', id from sheep_episodes where contains(lower(concat_ws(' ', topic, summary)), '{PLACE}')",
    "semantic_recall": f"""with {_SUB}, {VS}, l1 as (select id, row_number() over (order by score desc, id) as r from sb qualify r <= 40), l2 as (select id, row_number() over (order by round(score, 9) desc, id) as r from vs where score >= 0.2 qualify r <= 40),
f as (select id, sum(w) as s from (select id, 1.0 / (60 + r) as w from l1 union all select id, 1.0 / (60 + r) from l2) group by id), u as (select id, max(s) as s from (select * from f union all select doc_id, 0.01 from documents where contains(lower(text), 'garden shed')) group by id)
select id, round(s * (0.8 + 0.2 * least(coalesce(n_chars, 0) / 10000, 1.0)), 7)::double as score from u join documents on doc_id = id""",
    "causal_search": f"""with l as (select distinct id, lower(cause) as c, lower(effect) as e from sheep_causal_links where cause is not null and effect is not null), w as (select *, list_distinct(list_filter(string_split_regex(e, '\\s+'), lambda x: length(x) > 2)) as ws from l),
s as (select id, case when contains(e, '{EFFECT}') or contains('{EFFECT}', e) then 0.9 when contains(c, '{EFFECT}') then 0.85 else greatest(len(list_intersect(ws, {_WORDS})) / len(list_distinct(list_concat(ws, {_WORDS})))::double, 0.8 * len(list_filter({_WORDS}, lambda q: len(list_filter(ws, lambda v: contains(v, q) or contains(q, v))) > 0)) / {len(EFFECT.split())}.0) end as score from w)
select id, round(score, 6)::double as score from s where round(score, 6) > 0.05""",
    "merged_procedures": f"with {_PROCS} select * from procs",
    "procedure_query": f"with {_PROCS} select trigger_text, action, success, used from procs where trigger_text ilike '%the%' and success >= 0.3 order by success desc, used desc, trigger_text, action limit 10",
    "procedure_matches": f"with {_PROCS}, b as (select *, greatest({_like('trigger_text')}, 0.8 * {_like('action')}) as m from procs), s as (select trigger_text, action, round(0.5 * m + 0.25 * success + 0.15 * least(1.0, log10(used + 1) / 2) + 0.1 * least(1.0, examples / 5), 6)::double as score from b where m >= 0.1) select * from s where score >= 0.3 order by score desc, trigger_text, action limit 5",
    "bridge_search": f"with {bm25_sql(QUERY)}, {VS}, {FUSED.format(n=20, least=0.1)} select id, 1 as tier, round(score, 9)::double as score from fu union all select doc_id, 2, 0.01 from documents where contains(lower(text), 'garden shed') and doc_id not in (select id from fu)",
}
