"""Queries of the text rules over whole tables, with DuckDB SQL written from the rules' meaning.

Extraction reads the distinct summaries of episodes; requests are told apart by id. A candidate that several rules give
counts once, of the first rule. Confidences are rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import relative_time, rules
from engram.plans.core_problems import table
from engram.session import fill_cores


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, salience) of distinct episodes."""
    rows = table(spark, sf_dir, "sheep_episodes").select("id", F.col("summary").alias("text"), F.coalesce("emotional_salience", F.lit(0.0)).alias("salience"))
    return fill_cores(rows.where("text is not null and id is not null"), "id").distinct()


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "recall_requests").select("request_id", F.col("query_text").alias("text"), F.col("received_at").cast("timestamp").alias("now"))
    return fill_cores(rows.where("text is not null"), "request_id").distinct()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, text, now) of distinct messages, at their first arrival."""
    rows = table(spark, sf_dir, "raw_messages").where("content is not null").groupBy("msg_id", F.col("content").alias("text"))
    return rows.agg(F.min(F.col("ingested_at").cast("timestamp")).alias("now"))


def clamp(c, low: float = 0.0):  # noqa: ANN001, ANN201
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(low), c)), 6)


def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that the patterns and mentions give for each episode, with their confidence of 0.3 or more."""
    eps = episodes(spark, sf_dir)
    caught = F.transform(rules.groups(F.col("text"), [(p, g, o) for p, g, _, o in rules.FACTS]), lambda m: F.struct(
        F.when(rules.pick([g for _, g, _, _ in rules.FACTS], m["rule"]) == 0, "user").otherwise(rules.clean_fact(m["a"])).alias("s"), rules.pick([p for _, _, p, _ in rules.FACTS], m["rule"]).alias("p"), rules.clean_fact(m["b"]).alias("o"), F.lit(0.2).alias("w")))
    said = F.filter(caught, lambda m: (m["s"] != "") & (F.length(m["o"]) > 1))
    named = F.transform(rules.mentions(F.col("text")), lambda m: F.struct(m["s"].alias("s"), m["p"].alias("p"), m["o"].alias("o"), F.lit(0.1).alias("w")))
    rows = eps.select("id", "salience", F.inline(F.concat(said, named))).groupBy("id", "salience", "s", "p", "o").agg(F.max("w").alias("w"))
    strong = F.when(F.col("p").isin(*rules.STRONG), 0.15).otherwise(0.0)
    sure = clamp(F.lit(0.5) + F.col("w") + strong + F.col("salience") * 0.1 - F.when(F.length("o") < 3, 0.2).otherwise(0.0))
    return rows.select("id", F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), sure.alias("confidence")).where("confidence >= 0.3")


def _clauses(text, table_, pronouns: str):  # noqa: ANN001, ANN202
    caught = rules.groups(text, [(r[0], r[1], r[2]) for r in table_])
    whole = F.transform(caught, lambda m: F.struct(m["rule"].alias("rule"), m["at"].alias("at"), F.when(rules.pick([r[1] for r in table_], m["rule"]) == 0, "[context]").otherwise(rules.clean_clause(m["a"], pronouns)).alias("a"), rules.clean_clause(m["b"], pronouns).alias("b")))
    return F.filter(whole, lambda m: (F.length(m["a"]) >= 3) & (F.length(m["b"]) >= 3) & (m["a"] != m["b"]))


def extracted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal links of each episode: of equal cause and effect the first pattern's, of confidence 0.4 or more; direct above 0.7."""
    rows = episodes(spark, sf_dir).select("id", "salience", F.inline(_clauses(F.col("text"), rules.CAUSES, "i|we|they|he|she|it")))
    first = rows.groupBy("id", "salience", F.lower("a").alias("x"), F.lower("b").alias("y")).agg(F.min(F.struct("rule", "at", "a", "b")).alias("m"))
    kind = rules.pick([r[3] for r in rules.CAUSES], F.col("m.rule"))
    sure = clamp(F.lit(0.5) + rules.pick([r[4] for r in rules.CAUSES], F.col("m.rule")) + F.when(kind.contains("direct") | kind.contains("explicit"), 0.1).otherwise(0.0) + F.col("salience") * 0.1
                 - F.when((F.length("m.a") < 10) | (F.length("m.b") < 10), 0.15).otherwise(0.0), 0.1)
    out = first.select("id", F.col("m.a").alias("cause"), F.col("m.b").alias("effect"), kind.alias("mechanism"), sure.alias("confidence")).where("confidence >= 0.4")
    return out.withColumn("strength", F.when(F.col("confidence") > 0.7, "direct").otherwise("contributing"))


def extracted_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures of each episode, said or implied, with tags; of equal trigger and action the most confident."""
    eps = episodes(spark, sf_dir)
    said = F.transform(_clauses(F.col("text"), rules.PROCEDURES, "i|we|they|he|she|it|you"), lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), rules.pick([r[3] for r in rules.PROCEDURES], m["rule"]).alias("c")))
    rows = eps.select("id", F.inline(F.concat(said, rules.implied_procedures(F.col("text")))))
    best = rows.groupBy("id", F.lower("a").alias("trigger_text"), F.lower("b").alias("action")).agg(F.max("c").alias("confidence"))
    return best.withColumn("tags", F.array_join(rules.tags(F.concat_ws(" ", "trigger_text", "action")), ","))


def message_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("request_id", rules.intent(F.col("text")).alias("i")).select("request_id", "i.intent", "i.confidence")


def message_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("request_id", F.inline(rules.entities(F.col("text"))))


def message_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to fetch for a request: needs, confidence, queries and whether to fetch at all."""
    rows = requests(spark, sf_dir).select("request_id", "text", rules.intent(F.col("text"))["intent"].alias("intent"), F.transform(F.filter(rules.entities(F.col("text")), lambda e: e["confidence"] > 0.5), lambda e: e["value"]).alias("e"), rules.time_range(F.col("text"), F.col("now"))["reference"].alias("t"))
    needs, sure = F.array().cast("array<string>"), F.lit(0.0)
    for k in rules.NEEDS:
        needs = F.when(F.col("intent") == k, F.array(*map(F.lit, rules.NEEDS[k])).cast("array<string>")).otherwise(needs)
        sure = F.when(F.col("intent") == k, rules.SURE[k]).otherwise(sure)
    has_e, has_t = F.size("e") > 0, F.col("t").isNotNull()
    needs = F.array_union(F.array_union(needs, F.when(has_e, F.array(F.lit("entity_facts"))).otherwise(F.array().cast("array<string>"))), F.when(has_t, F.array(F.lit("episodes"))).otherwise(F.array().cast("array<string>")))
    queries = F.concat(F.flatten(F.transform("e", lambda e: F.array(F.concat(F.lit("subject:"), e), F.concat(F.lit("object:"), e)))), F.when(has_t, F.array(F.concat(F.lit("temporal:"), "t"))).otherwise(F.array().cast("array<string>")),
                       F.when(has_e & (F.col("intent") == "question"), F.array(F.concat(F.lit("related:"), F.array_join("e", ",")))).otherwise(F.array().cast("array<string>")))
    fetch = ~((F.col("intent") == "social") | ((F.length(F.trim("text")) < 10) & ~has_e) | ((F.col("intent") == "creative") & ~has_e))
    total = F.round(F.least(F.lit(1.0), sure + F.when(has_e, 0.1).otherwise(0.0) + F.when(has_t, 0.1).otherwise(0.0)), 6)
    return rows.select("request_id", F.array_join(needs, ",").alias("needs"), total.alias("confidence"), F.array_join(queries, "|").alias("queries"), fetch.alias("fetch"))


def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of time that a message names, relative to its arrival."""
    rows = messages(spark, sf_dir).select("msg_id", rules.time_range(F.col("text"), F.col("now")).alias("r")).where("r is not null")
    return rows.select("msg_id", "r.reference", F.unix_millis("r.start").alias("start_ms"), F.unix_millis("r.end").alias("end_ms"))


def text_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with and without underscores, and the topic, of every episode."""
    t = F.col("text")
    return episodes(spark, sf_dir).select("id", F.array_join(rules.keywords(t), " ").alias("keywords"), F.array_join(rules.keywords_plain(t), " ").alias("plain"), rules.topic(t).alias("topic")).distinct()


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density, salience, utility and time to live of every episode's text."""
    t = F.col("text")
    rows = episodes(spark, sf_dir).select("id", rules.density(t).alias("density"), rules.salience(t).alias("salience"), rules.utility(t).alias("utility")).distinct()
    mean = (F.col("salience") + F.col("utility")) / 2
    return rows.withColumn("ttl", F.when(mean > 0.8, "permanent").when(mean > 0.6, "90d").when(mean > 0.4, "30d").otherwise("7d"))


def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("request_id", *[c.alias(n) for n, c in rules.question_flags(F.col("text")).items()]).distinct()


def plan_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each fact and when a plan or state is over, counted from its last confirmation."""
    facts = table(spark, sf_dir, "sheep_facts").select("id", "predicate", "object", F.col("last_confirmed").cast("timestamp").alias("now")).distinct().where("predicate is not null and object is not null")
    kind = rules.profile_kind(F.col("predicate"), F.col("object"))
    return facts.select("id", kind.alias("kind"), F.when(kind.isin("plan", "state"), F.unix_millis(rules.expiry(F.col("object"), F.col("now")))).alias("until_ms"))


def personal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per kind, the masked text and whether it must stay local (three items or more) of every document."""
    docs = fill_cores(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"), "doc_id")
    rows = docs.select("doc_id", rules.personal_counts(F.col("text")).alias("n"), F.md5(rules.personal_masked(F.col("text"))).alias("masked"))
    total = F.aggregate(F.map_values("n"), F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", *[F.element_at("n", F.lit(k)).alias(k) for k, _ in rules.PERSONAL], (total >= 3).alias("keep_local"), "masked")


def resolved_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant that a message's relative time phrase names."""
    rows = messages(spark, sf_dir).select("msg_id", relative_time.resolve(F.col("text"), F.col("now")).alias("at"))
    return rows.where("at is not null").select("msg_id", F.unix_millis("at").alias("at_ms"))


QUERIES = {f.__name__: f for f in (extracted_facts, extracted_links, extracted_procedures, message_intents, message_entities, message_needs, time_ranges, text_keywords, text_scores, question_types, plan_expiry, personal_scan, resolved_phrases)}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EPS = "e as (select distinct id, summary as t, coalesce(emotional_salience, 0.0) as sal from sheep_episodes where summary is not null and id is not null)"
REQS = "r as (select distinct request_id, query_text as t, received_at as now from recall_requests where query_text is not null)"
MSGS = "r as (select msg_id as request_id, content as t, min(ingested_at) as now from raw_messages where content is not null group by all)"
STRIP = r"regexp_replace({}, '\A\s+|\s+\z', '', 'g')"


def _fact(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_replace({STRIP.format(c)}, '(?i)\A(a|an|the)\s+', ''), '[''\x22]', '', 'g'), '\s+', ' ', 'g'))"


def _clause(c: str, pronouns: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({STRIP.format(c)}, '(?i)\A({pronouns})\s+', ''), '[''\x22]', '', 'g'), '\s+', ' ', 'g')"


def _caught(rows: list, value: str = "") -> str:
    """One select per pattern: id, rule, a, b; lists of both groups are unnested side by side."""
    one = lambda p, g: f"unnest(regexp_extract_all(t, {q('(?i)' + p)}, {g}))"
    return " union all ".join(f"select id, sal, {i} as rule, {one(p, a) if a else one(p, 0)} as a, {one(p, b)} as b from e" for i, (p, a, b) in enumerate(rows))


def _case(name: str, values: list) -> str:
    return f"case {name} " + " ".join(f"when {i} then {q(v) if isinstance(v, str) else v}" for i, v in enumerate(values)) + " end"


def _mention(first: str, second: str | None, s: str, p: str, o: str | None) -> str:
    hit = f"regexp_matches(t, {q(first)})" + (f" and regexp_matches(t, {q(second)})" if second else "")
    return f"select id, sal, '{s}' as s, '{p}' as p, {q(o) if o else f'lower(regexp_extract(t, {q(first)}, 1))'} as o, 0.1 as w from e where {hit}"


def _tags(c: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(lower({c}), {q(p)}) then '{n}' end" for n, p in rules.TAGS) + "], lambda x: x is not null), ',')"


INTENT = "list_max([" + ", ".join(f"case when regexp_matches(t, {q('(?i)' + p)}) then {{'c': {c}, 'i': {-i}, 'k': '{k}'}} end" for i, (p, k, c) in enumerate(rules.INTENTS)) + ", {'c': 0.3, 'i': -99, 'k': 'question'}])"
WORDS = "array_to_string({}, ' ')"
STOP = "[" + ", ".join(q(w) for w in rules.STOP_WORDS) + "]"


def _keywords(kept: str) -> str:
    raw = f"list_filter(string_split_regex(regexp_replace(lower(t), '{kept}', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 and not list_contains({STOP}, w))"
    return f"list_filter({raw}, lambda w, i: list_position({raw}, w) = i)"


ENTITY = (" union all ".join(f"select request_id, t, {i} as k, '{t}' as type, unnest(regexp_extract_all(t, {q(p)}, 1)) as v, generate_subscripts(regexp_extract_all(t, {q(p)}, 1), 1) as ix from r" for i, (p, t) in enumerate(rules.ENTITIES)))
ENTITIES = f"""c as ({ENTITY}), d as (select *, regexp_replace(v, '\\A\\s+|\\s+\\z', '', 'g') as value from c),
f as (select * from d where length(value) between 2 and 50 and value not in ({', '.join(map(q, rules.NO_ENTITIES))}) qualify row_number() over (partition by request_id, lower(value) order by k, ix) = 1),
ent as (select request_id, value, type, k, ix, round(least(1.0, 0.5 + case when contains(t, '"' || value || '"') or contains(t, '''' || value || '''') then 0.3 else 0 end + case when contains(value, ' ') then 0.1 else 0 end
  + case when type = 'thing' and regexp_matches(value, '\\A[A-Z]{{2,}}\\z') then 0.2 else 0 end + 0.1 * least(greatest((length(lower(t)) - length(replace(lower(t), lower(value), ''))) / length(value) - 1, 0), 3)), 6) as confidence from f)"""
RANGE = r"""tr as (select request_id, case
  when regexp_matches(t, '(?i)\byesterday\b') then ['yesterday', epoch_ms(date_trunc('day', now) - interval 1 day)::varchar, (epoch_ms(date_trunc('day', now)) - 1)::varchar]
  when regexp_matches(t, '(?i)\blast\s+week\b') then [lower(regexp_extract(t, '(?i)(\blast\s+week\b)', 1)), epoch_ms(now - interval 7 day)::varchar, epoch_ms(now)::varchar]
  when regexp_matches(t, '(?i)\blast\s+month\b') then [lower(regexp_extract(t, '(?i)(\blast\s+month\b)', 1)), epoch_ms(now - interval 1 month)::varchar, epoch_ms(now)::varchar]
  when regexp_matches(t, '(?i)\b\d{1,4}\s+days?\s+ago\b') then [lower(regexp_extract(t, '(?i)(\b\d{1,4}\s+days?\s+ago\b)', 1)), (epoch_ms(now) - 86400000 * regexp_extract(t, '(?i)\b(\d{1,4})\s+days?\s+ago\b', 1)::bigint)::varchar, epoch_ms(now)::varchar]
  when regexp_matches(t, '(?i)\bthis\s+morning\b') then ['this morning', epoch_ms(date_trunc('day', now))::varchar, epoch_ms(date_trunc('day', now) + interval 12 hour)::varchar]
  when regexp_matches(t, '(?i)\bearlier\s+today\b') then ['earlier today', epoch_ms(date_trunc('day', now))::varchar, epoch_ms(now)::varchar]
  when regexp_matches(t, '(?i)\brecently\b') then ['recently', epoch_ms(now - interval 7 day)::varchar, epoch_ms(now)::varchar]
  when try_strptime(regexp_extract(t, '\b(\d{4}-\d{2}-\d{2})\b', 1), '%Y-%m-%d') is not null then [regexp_extract(t, '\b(\d{4}-\d{2}-\d{2})\b', 1), epoch_ms(try_strptime(regexp_extract(t, '\b(\d{4}-\d{2}-\d{2})\b', 1), '%Y-%m-%d'))::varchar, (epoch_ms(try_strptime(regexp_extract(t, '\b(\d{4}-\d{2}-\d{2})\b', 1), '%Y-%m-%d')) + 86399999)::varchar]
  end as x from r)"""
SCORES = r"""with {eps}, s as (select distinct id, t, lower(t) as l, greatest(len(list_filter(string_split_regex(t, '\s+'), lambda w: length(w) > 2)), 1) as n from e),
v as (select id, round(least(1.0, 0.4 * len({keys}) / n + 0.3 * len(regexp_extract_all(t, '\b[A-Z][a-z]+\b')) / n + case when regexp_matches(t, '\d') then 0.1 else 0 end
    + case when regexp_matches(t, '\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}|\d{{4}}[/\-]\d{{1,2}}[/\-]\d{{1,2}}') then 0.1 else 0 end + case when regexp_matches(l, 'project|company|location|technology|tool|method|approach') then 0.1 else 0 end), 6) as density,
  round(least(1.0, 0.3 + case when contains(l, '!') then 0.1 else 0 end + case when len(regexp_extract_all(l, '!+')) > 2 then 0.1 else 0 end + case when regexp_matches(l, '\b(amazing|awesome|fantastic|incredible|love|great|excellent)\b') then 0.1 else 0 end
    + case when regexp_matches(l, '\b(important|critical|urgent|must|need|essential|crucial)\b') then 0.15 else 0 end + case when regexp_matches(l, '\b(remember|don''t forget|note|save|keep)\b') then 0.1 else 0 end + least(0.05 * len(regexp_extract_all(l, '\?')), 0.15)), 6) as salience,
  round(least(1.0, 0.4 + case when regexp_matches(l, '\b(solved|fixed|working|works|done|completed|success)\b') then 0.2 else 0 end + case when regexp_matches(l, '\b(thank|thanks|perfect|exactly)\b') then 0.15 else 0 end
    + case when regexp_matches(l, '\b(learned|understand|got it|makes sense|i see)\b') then 0.1 else 0 end + case when regexp_matches(l, '```|function|class|import|export|const|let|var') then 0.1 else 0 end), 6) as utility from s)
select distinct id, density::double as density, salience::double as salience, utility::double as utility, case when (salience + utility) / 2 > 0.8 then 'permanent' when (salience + utility) / 2 > 0.6 then '90d' when (salience + utility) / 2 > 0.4 then '30d' else '7d' end as ttl from v"""


def _masked() -> str:
    masks = {"email": "m[1] || '***@' || string_split(m, '@')[2]", "phone": "left(m, 3) || '***' || right(m, 2)", "ssn": "'***-**-****'", "credit_card": "'****-****-****-' || right(m, 4)", "ip_address": "'***.***.***.***'", "api_key": "left(m, 6) || '***REDACTED***'", "password": "'password: ***REDACTED***'"}
    out = "text"
    for kind, pattern in rules.PERSONAL:
        out = f"list_reduce(list_prepend({out}, regexp_extract_all(text, {q(pattern)})), lambda a, m: replace(a, m, {masks[kind]}))"
    return out


_FACT_ROWS = [(p, g, o) for p, g, _, o in rules.FACTS]
_PROC = "i|we|they|he|she|it|you"
ORACLES = {
    "extracted_facts": f"""with {EPS}, c as ({_caught(_FACT_ROWS)}),
f as (select id, sal, case when {_case('rule', [g for _, g, _, _ in rules.FACTS])} = 0 then 'user' else {_fact('a')} end as s, {_case('rule', [p for _, _, p, _ in rules.FACTS])} as p, {_fact('b')} as o, 0.2 as w from c),
u as (select * from f where s <> '' and length(o) > 1 union all {' union all '.join(_mention(*m) for m in rules.MENTIONS)}), g as (select id, sal, s, p, o, max(w) as w from u group by all),
x as (select id, s as subject, p as predicate, o as object, round(least(1.0, greatest(0.0, 0.5 + w + case when p in ('has_name', 'works_at', 'lives_in', 'timezone', 'speaks') then 0.15 else 0 end + sal * 0.1 - case when length(o) < 3 then 0.2 else 0 end)), 6)::double as confidence from g)
select * from x where confidence >= 0.3""",
    "extracted_links": f"""with {EPS}, c as ({_caught([(r[0], r[1], r[2]) for r in rules.CAUSES])}), n as (select *, row_number() over () as ix from c),
k as (select id, sal, rule, ix, case when {_case('rule', [r[1] for r in rules.CAUSES])} = 0 then '[context]' else {_clause('a', 'i|we|they|he|she|it')} end as a, {_clause('b', 'i|we|they|he|she|it')} as b from n),
m as (select * from k where length(a) >= 3 and length(b) >= 3 and a <> b qualify row_number() over (partition by id, sal, lower(a), lower(b) order by rule, ix) = 1),
x as (select id, lower(a) as la, lower(b) as lb, a as cause, b as effect, {_case('rule', [r[3] for r in rules.CAUSES])} as mechanism, round(least(1.0, greatest(0.1, 0.5 + {_case('rule', [r[4] for r in rules.CAUSES])} + case when rule in (0, 3, 16) then 0.1 else 0 end + sal * 0.1 - case when length(a) < 10 or length(b) < 10 then 0.15 else 0 end)), 6)::double as confidence from m)
select id, cause, effect, mechanism, confidence, case when confidence > 0.7 then 'direct' else 'contributing' end as strength from x where confidence >= 0.4""",
    "extracted_procedures": f"""with {EPS}, c as ({_caught([(r[0], r[1], r[2]) for r in rules.PROCEDURES])}),
k as (select id, {_clause('a', _PROC)} as a, {_clause('b', _PROC)} as b, {_case('rule', [r[3] for r in rules.PROCEDURES])} as c from c),
u as (select * from k where length(a) >= 3 and length(b) >= 3 and a <> b union all {' union all '.join(f"select id, '{t}', '{d}', {c} from e where regexp_matches(lower(t), '{a}') and regexp_matches(lower(t), '{b}')" for a, b, t, d, c in rules.IMPLIED)})
select id, lower(a) as trigger_text, lower(b) as action, max(c)::double as confidence, {_tags("lower(a) || ' ' || lower(b)")} as tags from u group by id, lower(a), lower(b)""",
    "message_intents": f"with {REQS}, i as (select request_id, {INTENT} as m from r) select request_id, m.k as intent, m.c::double as confidence from i",
    "message_entities": f"with {REQS}, {ENTITIES} select request_id, value, type, confidence::double as confidence from ent",
    "message_needs": f"""with {REQS}, {ENTITIES}, {RANGE}, i as (select request_id, t, {INTENT}.k as intent from r),
g as (select request_id, list(value order by k, ix) as e from ent where confidence > 0.5 group by request_id), j as (select i.*, coalesce(g.e, []) as e, tr.x[1] as tt from i left join g using (request_id) left join tr using (request_id))
select request_id, array_to_string(list_concat(case intent when 'question' then ['facts', 'episodes'] when 'command' then ['procedures', 'facts'] when 'reference' then ['episodes', 'facts', 'causal'] when 'social' then ['facts'] else [] end,
    case when len(e) > 0 then ['entity_facts'] else [] end, case when tt is not null and intent not in ('question', 'reference') then ['episodes'] else [] end), ',') as needs,
  round(least(1.0, case intent when 'question' then 0.8 when 'command' then 0.7 when 'reference' then 0.85 when 'creative' then 0.3 else 0.5 end + case when len(e) > 0 then 0.1 else 0 end + case when tt is not null then 0.1 else 0 end), 6)::double as confidence,
  array_to_string(list_concat(flatten(list_transform(e, lambda v: ['subject:' || v, 'object:' || v])), case when tt is not null then ['temporal:' || tt] else [] end, case when len(e) > 0 and intent = 'question' then ['related:' || array_to_string(e, ',')] else [] end), '|') as queries,
  not (intent = 'social' or (length(trim(t)) < 10 and len(e) = 0) or (intent = 'creative' and len(e) = 0)) as fetch from j""",
    "time_ranges": f"with {MSGS}, {RANGE} select request_id as msg_id, x[1] as reference, x[2]::bigint as start_ms, x[3]::bigint as end_ms from tr where x is not null",
    "text_keywords": f"with {EPS} select distinct id, {WORDS.format(_keywords('[^a-zA-Z0-9_[:space:]]'))} as keywords, {WORDS.format(_keywords('[^a-z0-9[:space:]]'))} as plain, case when len({_keywords('[^a-z0-9[:space:]]')}) > 0 then array_to_string(({_keywords('[^a-z0-9[:space:]]')})[1:3], ', ') else 'General discussion' end as topic from e",
    "text_scores": SCORES.format(eps=EPS, keys=_keywords("[^a-z0-9[:space:]]")),
    "question_types": rf"""with {REQS} select distinct request_id, regexp_matches(lower(t), '\b(likely|would|might|could|suspected|possible|probably|suggest)\b') as is_inference, regexp_matches(lower(t), '\bhow (long|many years|many months)\b') as is_duration,
  regexp_matches(lower(t), '\bhow many\b') and not regexp_matches(lower(t), '\bhow (long|many years|many months)\b') as is_count, regexp_matches(lower(t), '^(is |are |does |do |did |has |have |was |were |will |would |can |could |should )') as is_yes_no from r""",
    "plan_expiry": """with f as (select distinct id, lower(predicate) as p, lower(object) as o, last_confirmed as now from sheep_facts where predicate is not null and object is not null), k as (select *, case """ + " ".join(
        f"when p in ({', '.join(map(q, rules.KINDS[k]))}) then '{k}'" for k in ("preference", "trait", "plan", "state")) + r""" when regexp_matches(o, '\b(week|month|day|tomorrow|soon|later|next)\b') then 'plan' else 'trait' end as kind from f)
select id, kind, case when kind in ('plan', 'state') then epoch_ms(case when contains(o, 'today') then date_trunc('day', now) + interval 86399 second when contains(o, 'tomorrow') then date_trunc('day', now) + interval 172799 second
  when contains(o, 'this week') or contains(o, 'next week') then now + interval 7 day when contains(o, 'this month') or contains(o, 'next month') then now + interval 1 month when contains(o, 'this year') or contains(o, 'next year') then now + interval 1 year end) end as until_ms from k""",
    "personal_scan": "with n as (select doc_id, " + ", ".join(f"len(regexp_extract_all(text, {q(p)}))::int as {k}" for k, p in rules.PERSONAL) + f", md5({_masked()}) as masked from documents where text is not null) select *, " + " + ".join(k for k, _ in rules.PERSONAL) + " >= 3 as keep_local from n",
    "resolved_phrases": r"""with r as (select msg_id, lower(content) as t, min(ingested_at) as now, date_trunc('day', min(ingested_at)) as d from raw_messages where content is not null group by msg_id, content),
x as (select msg_id, case when regexp_extract(t, '\b(\d{1,4}) (minute|hour|day|week)s? ago', 1) <> '' then epoch_ms(now) - regexp_extract(t, '\b(\d{1,4}) (minute|hour|day|week)s? ago', 1)::bigint * case regexp_extract(t, '\b(\d{1,4}) (minute|hour|day|week)s? ago', 2) when 'minute' then 60000 when 'hour' then 3600000 when 'day' then 86400000 else 604800000 end
  when contains(t, 'yesterday') then epoch_ms(d - interval 1 day) when contains(t, 'tomorrow') then epoch_ms(d + interval 1 day) when contains(t, 'last week') then epoch_ms(d - interval 7 day) when contains(t, 'next week') then epoch_ms(d + interval 7 day)
  when contains(t, 'last month') then epoch_ms(d - interval 1 month) when contains(t, 'last year') then epoch_ms(d - interval 12 month) when regexp_matches(t, '\b(today|now)\b') then epoch_ms(d) end as at_ms from r) select * from x where at_ms is not null""",
}
