"""Queries of answers, privacy, metadata search and episode records, with DuckDB SQL where it can say them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import answers, rules
from engram.operators import folds
from engram.plans.core_problems import table
from engram.plans.memory_queries import FACTS, facts
from engram.plans.rule_queries import messages
from engram.session import fill_cores


def metadata(rows: DataFrame, persons: list[str] = (), subjects: list[str] = (), predicates: list[str] = (), locations: list[str] = (), start: str | None = None, end: str | None = None, fuzzy: bool = False, top: int = 20) -> DataFrame:
    """(id, score, reasons): facts that meet every given group; of a group any value will do.

    Persons stand in subject or object, locations in the object, times in any of three columns. The score is 0.7 of the
    confidence plus 0.3 of the share of groups met as reasons. No group at all finds nothing.
    """
    def among(c: str, values: list[str]):  # noqa: ANN202
        return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{v.replace('%', chr(92) + '%').replace('_', chr(92) + '_')}%") for v in values]) if fuzzy else F.col(c).isin(*values)

    tests = []
    if persons:
        tests.append(("person", among("subject", persons) | among("object", persons)))
    tests += [(n, among(c, v)) for n, c, v in (("subject", "subject", subjects), ("predicate", "predicate", predicates), ("location", "object", locations)) if v]
    if start or end:
        within = lambda c: (F.lit(True) if start is None else F.col(c) >= F.lit(start).cast("timestamp")) & (F.lit(True) if end is None else F.col(c) <= F.lit(end).cast("timestamp"))
        tests.append(("date", within("created_at") | within("first_seen") | within("last_confirmed")))
    if not tests:
        return rows.select("id", F.lit(0.0).alias("score"), F.lit("").alias("reasons")).limit(0)
    kept = rows.where(reduce(lambda a, b: a & b, [t for _, t in tests]))
    # The reason of a date looks at the creation alone.
    reasons = F.array_compact(F.array(*[F.when(within("created_at"), n) if n == "date" else F.lit(n) for n, _ in tests]))
    score = F.round(F.least(F.lit(1.0), 0.7 * F.coalesce("confidence", F.lit(0.0)) + 0.3 * F.size(reasons) / len(tests)), 6)
    return kept.select("id", score.alias("score"), F.array_join(reasons, ",").alias("reasons"), "confidence").orderBy(F.desc_nulls_last("confidence"), "id").limit(top).drop("confidence")


def metadata_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(facts(spark, sf_dir), persons=["user"], predicates=["likes", "prefers"], start="2024-06-01", end="2025-06-01")


def metadata_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(facts(spark, sf_dir), subjects=["team", "user"], locations=["museum", "festival"], fuzzy=True)


def by_subject(rows: DataFrame, name: str) -> DataFrame:
    return metadata(rows, subjects=[name], fuzzy=True)


def by_predicate(rows: DataFrame, name: str) -> DataFrame:
    return metadata(rows, predicates=[name])


def by_person(rows: DataFrame, name: str) -> DataFrame:
    return metadata(rows, persons=[name], fuzzy=True)


def by_dates(rows: DataFrame, start: str, end: str) -> DataFrame:
    return metadata(rows, start=start, end=end)


def by_location(rows: DataFrame, name: str) -> DataFrame:
    return metadata(rows, locations=[name], fuzzy=True)


def summary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 and correctness of each episode's summary as an answer to its topic."""
    e = fill_cores(table(spark, sf_dir, "sheep_episodes").select("id", "topic", "summary").where("topic is not null and summary is not null"), "id").distinct()
    return e.select("id", F.round(answers.token_f1(F.col("summary"), F.col("topic")), 6).alias("f1"), answers.correct(F.col("topic"), F.col("summary"), F.lit(1)).alias("right"))


def detected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of personal data in the messages, with confidence."""
    m = fill_cores(table(spark, sf_dir, "raw_messages").select("msg_id", "content").where("content is not null"), "msg_id").distinct()
    return m.select("msg_id", F.inline(answers.detect(F.col("content"))))


def anonymised_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anonymised text (as a hash) of every message and whether nothing shows any more."""
    m = fill_cores(table(spark, sf_dir, "raw_messages").select("msg_id", "content").where("content is not null"), "msg_id").distinct()
    return m.select("msg_id", F.md5(answers.anonymised(F.col("content"))).alias("text"), (F.size(answers.unsafe(answers.anonymised(F.col("content")))) == 0).alias("safe"))


def absolute_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose relative time phrase was made absolute."""
    rows = messages(spark, sf_dir).withColumn("new", answers.absolute_phrases(F.col("text"), F.col("now")))
    return rows.where("new <> text").select("msg_id", F.col("new").alias("text"))


def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose cause and effect share two terms or more."""
    t = table(spark, sf_dir, "sheep_causal_links").select("id", "cause", "effect").distinct().where("cause is not null and effect is not null")
    return t.select("id", answers.overlap_terms(F.col("cause"), F.col("effect")).alias("n")).where("n >= 2")


def episode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes built of the messages' segments: text, topic, keywords, scores, time to live.

    A segment of density under 0.1 is left out, but not the last one of a session.
    """
    m = table(spark, sf_dir, "raw_messages").groupBy(F.coalesce("session_id", F.lit("none")).alias("session"), F.coalesce("agent_id", F.lit("none")).alias("agent"), "msg_id", "seq", "role", "content").agg(F.min(F.col("ingested_at").cast("timestamp")).alias("at"))
    segments = folds.segment(m.select("session", "agent", "msg_id", "seq", "content", "at"))
    met = m.join(segments, ["session", "msg_id"])
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("user")), F.lit("]: "), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "msg_id", line.alias("line"), F.coalesce("content", F.lit("")).alias("content"))))
    built = met.groupBy("session", "segment").agg(ordered.alias("m"), F.min("at").alias("started"))
    text = F.array_join(F.transform("m", lambda x: x["content"]), " ")
    whole = F.array_join(F.transform("m", lambda x: x["line"]), "\n\n")
    rows = built.select("session", "segment", F.size("m").alias("n"), F.unix_millis("started").alias("started_ms"), text.alias("text"), whole.alias("whole"))
    out = rows.select("session", "segment", "n", "started_ms", F.md5(F.when(F.length("whole") > 5000, F.concat(F.substring("whole", 1, 4997), F.lit("..."))).otherwise(F.col("whole"))).alias("summary"), rules.topic(F.col("text")).alias("topic"),
                      rules.density(F.col("text")).alias("density"), rules.salience(F.col("text")).alias("salience"), rules.utility(F.col("text")).alias("utility"))
    least = out.groupBy("session").agg(F.max("density").alias("most"))
    mean = (F.col("salience") + F.col("utility")) / 2
    ttl = F.when(mean > 0.8, "permanent").when(mean > 0.6, "90d").when(mean > 0.4, "30d").otherwise("7d")
    return out.join(least, "session").where("density >= 0.1 or density = most").drop("most").withColumn("ttl", ttl)


QUERIES = {f.__name__: f for f in (metadata_groups, metadata_fuzzy, summary_f1, detected_items, anonymised_messages, absolute_messages, shared_terms, episode_records)}

_NA = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({})), '\b(a|an|the|and)\b', ' ', 'g'), '[.,!?''"]', '', 'g'), '\s+', ' ', 'g'))"""
_SURE = {"email": "0.95", "phone": r"case when length(regexp_replace(v, '\D', '', 'g')) >= 10 then 0.9 else 0.6 end", "ssn": "0.85", "api_key": "case when length(v) > 30 then 0.8 else 0.5 end",
         "credit_card": "case when list_sum(list_transform(range(1, length(v) + 1), lambda i: case when (length(v) - i) % 2 = 0 then v[i]::int else case when 2 * v[i]::int > 9 then 2 * v[i]::int - 9 else 2 * v[i]::int end end)) % 10 = 0 then 0.95 else 0.5 end"}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MSGS = "m as (select distinct msg_id, content as t from raw_messages where content is not null)"
_ANON = reduce(lambda c, kp: f"regexp_replace({c}, {q(kp[1])}, '{answers.PLACEHOLDERS[kp[0]]}', 'g')", reversed(answers.DETECTED), "t")
_ANON = f"regexp_replace(regexp_replace(regexp_replace({_ANON}, {q(answers.NAMES)}, '[PERSON]', 'g'), {q(answers.CITIES)}, '[LOCATION]', 'g'), {q(answers.DATES)}, '[DATE]', 'g')"
ORACLES = {
    "metadata_groups": f"""with {FACTS}, h as (select *, created_at between timestamp '2024-06-01' and timestamp '2025-06-01' as made from facts where (subject = 'user' or object = 'user') and predicate in ('likes', 'prefers')
  and (created_at between timestamp '2024-06-01' and timestamp '2025-06-01' or first_seen between timestamp '2024-06-01' and timestamp '2025-06-01' or last_confirmed between timestamp '2024-06-01' and timestamp '2025-06-01'))
select id, round(least(1.0, 0.7 * coalesce(confidence, 0) + 0.3 * (2 + coalesce(made, false)::int) / 3), 6)::double as score, 'person,predicate' || case when made then ',date' else '' end as reasons from h order by confidence desc nulls last, id limit 20""",
    "metadata_fuzzy": f"with {FACTS} select id, round(least(1.0, 0.7 * coalesce(confidence, 0) + 0.3), 6)::double as score, 'subject,location' as reasons from facts where (subject ilike '%team%' or subject ilike '%user%') and (object ilike '%museum%' or object ilike '%festival%') order by confidence desc nulls last, id limit 20",
    "summary_f1": f"""with e as (select distinct id, {_NA.format('topic')} as e, {_NA.format('summary')} as a from sheep_episodes where topic is not null and summary is not null),
w as (select *, list_filter(string_split(a, ' '), lambda w: w <> '') as x, list_filter(string_split(e, ' '), lambda w: w <> '') as y from e), c as (select *, len(list_distinct(list_filter(x, lambda w: list_contains(y, w)))) as b from w),
f as (select *, case when len(x) = 0 or len(y) = 0 then (a = e)::int::double when b = 0 then 0.0 else 2 * (b / len(x)::double) * (b / len(y)::double) / (b / len(x)::double + b / len(y)::double) end as f1 from c)
select id, round(f1, 6) as f1, a = e or (contains(a, e) and length(e) > 2) or (contains(e, a) and length(a) > 3) or f1 >= 0.5 as right from f""",
    "detected_items": f"with {_MSGS} " + " union all ".join(f"select msg_id, '{k}' as kind, v as value, ({_SURE.get(k, '0.7')})::double as confidence from (select msg_id, unnest(regexp_extract_all(t, {q(p)})) as v from m)" for k, p in answers.DETECTED),
    "shared_terms": "with t as (select distinct id, cause, effect from sheep_causal_links where cause is not null and effect is not null), w as (select id, list_distinct(list_filter(string_split_regex(lower(cause), '[^a-z0-9]+'), lambda w: length(w) > 2)) as x, list_distinct(list_filter(string_split_regex(lower(effect), '[^a-z0-9]+'), lambda w: length(w) > 2)) as y from t), n as (select id, len(list_filter(x, lambda w: len(list_filter(y, lambda v: contains(v, w) or contains(w, v))) > 0))::int as n from w) select * from n where n >= 2",
}
