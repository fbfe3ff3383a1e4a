"""Rules, retrieval, memory and graph operators on small rows with nulls, empty texts, ties and cycles."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import answers, rules
from engram.operators import graph, memory, retrieval
from engram.sources import stores

T0 = datetime(2025, 1, 1)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_facts_of_a_sentence(spark):
    got = {(m["rule"], m["a"], m["b"]) for m in one(spark, lambda t: rules.groups(t, [(p, g, o) for p, g, _, o in rules.FACTS]), "My name is Ana Diaz. I live in Porto.")}
    assert {(6, "", "Ana Diaz"), (3, "", "Porto"), (0, "name", "Ana Diaz")} == got
    assert one(spark, lambda t: rules.groups(t, [(p, g, o) for p, g, _, o in rules.FACTS]), None) == [] == one(spark, lambda t: rules.groups(t, [(p, g, o) for p, g, _, o in rules.FACTS]), "")


def test_cause_and_effect(spark):
    m = one(spark, lambda t: rules.groups(t, [(r[0], r[1], r[2]) for r in rules.CAUSES]), "We moved because rent rose.")
    assert [(x["rule"], x["a"], x["b"]) for x in m] == [(0, "rent rose", "We moved")]
    assert one(spark, lambda t: rules.clean_clause(t), "We moved 'twice'  there") == "moved twice there"


def test_keywords_and_topic(spark):
    assert one(spark, rules.keywords, "The garden_shed, the GARDEN shed and it") == ["garden_shed", "garden", "shed"]
    assert one(spark, rules.keywords_plain, "The garden_shed, the GARDEN shed") == ["garden", "shed"] and one(spark, rules.topic, "it is") == "General discussion"


@pytest.mark.parametrize("text,want", [("when did we meet", "question"), ("build the shed", "command"), ("hello there", "social"), ("you said so", "reference"), ("", "question")])
def test_intents(spark, text, want):
    assert one(spark, rules.intent, text)["intent"] == want


def test_masks(spark):
    text = "a@b.org and a@b.org, card 4111 1111 1111 1111, 192.168.1.10, password: x1"
    assert one(spark, rules.personal_masked, text).count("a***@b.org") == 2 and one(spark, rules.personal_counts, text)["email"] == 2
    assert one(spark, answers.anonymised, "Mary of Boston, a@b.org, 2024-05-06") == "[PERSON] of [LOCATION], [EMAIL], [DATE]"
    assert one(spark, answers.unsafe, "my secret") == ["secret"]


def test_answers(spark):
    df = spark.createDataFrame([("the red car", "a red car!", 1), ("1999", "In 1999", 2), ("x", "not mentioned", 5), ("", "", 1), ("blue", "green", 1)], "e string, a string, c int")
    rows = df.select(answers.token_f1(F.col("a"), F.col("e")).alias("f"), answers.correct(F.col("e"), F.col("a"), F.col("c")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, True, True, True, False] and rows[0]["f"] == 1.0 and rows[3]["f"] == 1.0


def test_json_repair():
    assert answers.repair('```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]} and answers.repair('say {"a": {"b": 1}} done') == {"a": {"b": 1}}
    assert answers.repair('{"facts": [{"s": 1}], oops') == {"facts": [{"s": 1}]} and answers.repair("") is None is answers.repair("none")


def test_phrases(spark):
    df = spark.createDataFrame([("met last year", T0), ("met yesterday.", T0), ("saw it last week", T0), ("2 years ago it was", T0), ("nothing", T0), (None, T0)], "t string, at timestamp")
    got = [r[0] for r in df.select(answers.absolute_phrases(F.col("t"), F.col("at"))).collect()]
    assert got == ["met 2024", "met 31 December 2024.", "saw it the week before 1 January 2025", "2023 it was", "nothing", None]
    assert answers.plan("Why did Anna move the shed?")["kind"] == "causal"


def test_bm25_and_fts(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, None), (4, "")], "id bigint, text string")
    row = retrieval.bm25(docs, "alpha").first()
    assert row["id"] == 1 and abs(row["score"] - np.log(2) / 3) < 1e-9
    assert retrieval.fts_query('"garden shed" a train') == (["garden shed"], ["train"]) and retrieval.fts_query(" ") is None
    assert retrieval.fts(docs, "alpha gamma").count() == retrieval.bm25(docs, "").count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double")
    b = spark.createDataFrame([("b", 2.0), ("c", 1.0)], "id string, score double")
    got = {r["id"]: r["score"] for r in retrieval.fuse([(a, 0.4, "x"), (b, 0.3, "y")]).collect()}
    assert got == pytest.approx({"b": 0.4 / 62 + 0.3 / 61, "a": 0.4 / 61, "c": 0.3 / 62})


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean", "manhattan", "pearson"])
def test_vectors_by_blocks_against_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(120, 6))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)] + [(500, None, 1), (501, [], 1), (502, [1.0], 2), (503, [0.0] * 6, 2)]
    v = spark.createDataFrame(rows, "id bigint, embedding array<double>, label int").repartition(5)
    asked = v.where("id % 20 = 0")
    want = set()
    pool = [(i, np.array(e)) for i, e, _ in rows if e and len(e) == 6]
    for q in range(0, 120, 20):
        s = [(-round(float(retrieval.similarities(metric, m[q][None], x[None])[0, 0]), 9), i) for i, x in pool if i != q]
        want |= {(q, i) for d, i in sorted(s)[:4] if -d >= -1}
    real, retrieval.BLOCK = retrieval.BLOCK, 2
    try:
        got = {(r["qid"], r["id"]) for r in retrieval.vector_topk(v, asked, 4, -1.0, metric).collect() if r["qid"] < 120}
    finally:
        retrieval.BLOCK = real
    assert got == want


FACTS = "id string, agent_id string, subject string, predicate string, object string, confidence double, evidence array<string>, user_affirmed boolean, is_active boolean, last_confirmed timestamp, created_at timestamp, updated_at timestamp"


def test_contradictions_and_merges(spark):
    row = lambda i, o, days, c=0.5, e=None: (i, "a", "u", "works_at", o, c, e, None, True, T0 + timedelta(days=days), T0 + timedelta(days=days), T0)
    df = spark.createDataFrame([row("1", "A", 0), row("2", "B", 5), row("3", "B", 5, e=["x"]), row("4", "A", 1, None)], FACTS)
    assert {(r["id"], r["winner"]) for r in memory.contradictions(df).collect()} == {(i, "3") for i in "1234"}
    same = spark.createDataFrame([row(str(i), "A", i, 0.7, [f"e{i}", "e0"]) for i in range(3)], FACTS)
    got = memory.merge(same, [F.col("subject"), F.col("predicate"), F.col("object")], ["created_at", "id"], "evidence").first()
    assert got["id"] == "0" and got["merged_confidence"] == 0.9 and got["evidence"] == ["e0", "e1", "e2"]
    assert memory.contradictions(df.limit(0)).count() == 0


def test_change_log(spark):
    f = spark.createDataFrame([("f", "a", "u", "p", "o", 0.5, None, None, False, None, T0, T0 + timedelta(days=30))], FACTS)
    snaps = spark.createDataFrame([("f", T0 + timedelta(days=d), c, T0 + timedelta(days=d)) for d, c in ((7, 0.5), (14, 0.9), (21, 0.9))], "fact_id string, snapshot_at timestamp, confidence double, ingested_at timestamp")
    log = memory.change_log(f, snaps)
    assert [r["kind"] for r in log.orderBy("at").collect()] == ["assert", "modify", "retract"]
    at = lambda d: [r["confidence"] for r in memory.as_of(log, F.lit(T0 + timedelta(days=d)).cast("timestamp")).collect()]
    assert (at(-1), at(1), at(15), at(31)) == ([], [0.5], [0.9], [])
    days = lambda d: F.lit(T0 + timedelta(days=d)).cast("timestamp")
    assert [r["change"] for r in memory.snapshot_changes(log, days(1), days(15)).collect()] == ["modified"]


def test_throttle_and_windows(spark):
    rows = [(str(m), k, T0 + timedelta(minutes=m)) for k in ("x", "y") for m in (0, 20, 40, 100, 101)]
    df = spark.createDataFrame(rows, "id string, key string, at timestamp")
    assert sorted(r["id"] for r in memory.throttle(df).collect()) == sorted(["0", "40", "100"] * 2)
    got = [r["admitted"] for r in memory.fixed_window(df.where("key = 'x'"), 2, 3600).orderBy(F.col("id").cast("int")).collect()]
    assert got == [True, True, False, True, True]


def test_chain_shows_every_change(spark):
    rows = spark.createDataFrame([(f"{i}", "p" if i < 6 else "q", f"c{i}") for i in range(9)], "id string, part string, content string")
    chain = memory.hash_chain(rows, ["id"])
    assert memory.verify_chain(chain, rows).count() == 0
    changed = rows.withColumn("content", F.when(F.col("id") == "2", "x").otherwise(F.col("content")))
    assert {r["id"] for r in memory.verify_chain(chain, changed).collect()} == {"2"}
    before, after = ({r["part"]: r["anchor"] for r in memory.part_anchors(memory.hash_chain(d, ["id"])).collect()} for d in (rows, changed))
    assert before["p"] != after["p"] and before["q"] == after["q"]


def test_percentiles_by_pieces(spark):
    rows = [("a", float(i % 37)) for i in range(500)] + [("b", 1.0), ("c", None), (None, 2.0)]
    got = {r["k"]: (r["p50"], r["p99"]) for r in memory.floor_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p99": 0.99}, 8).collect()}
    s = sorted(float(i % 37) for i in range(500))
    assert got == {"a": (s[250], s[495]), "b": (1.0, 1.0)}


def test_paths_end_in_cycles(spark):
    links = spark.createDataFrame([("A", "B", 0.5), ("B", "C", 0.5), ("C", "A", 1.0), ("C", "C", 1.0), (None, "A", 1.0), ("A", "Z", 0.1)], "cause_id string, effect_id string, confidence double")
    got = {tuple(r["path"]): r["score"] for r in graph.paths(links, spark.createDataFrame([("A",)], "node string"), 5).collect()}
    assert got == {("A", "B"): 0.5, ("A", "C"): 1.0, ("A", "B", "C"): 0.25, ("A", "C", "B"): 0.5}


def test_chain_by_text(spark):
    rows = [("1", "the boat broke badly", "the journey stopped early", 0.5), ("2", "heavy storms arrived", "The boat broke badly!", 0.5), ("3", "the journey stopped early", "heavy storms arrived", 0.9), ("4", "x", None, 1.0)]
    df = spark.createDataFrame(rows, "id string, cause string, effect string, confidence double")
    got = {(r["root"], r["id"], r["depth"], r["total"]) for r in graph.chain_by_text(df, "journey stopped early", 0.8).collect()}
    assert got == {("1", "1", 1, 0.5), ("1", "2", 2, 0.25), ("1", "3", 3, 0.225)}


def test_greedy_match(spark):
    df = spark.createDataFrame([("c", "a", "x", 0.9), ("c", "a", "y", 0.8), ("c", "b", "x", 0.8), ("c", "b", "y", 0.5), ("d", "a", "x", 0.1)], "case string, a string, b string, score double")
    assert {(r["case"], r["a"], r["b"]) for r in memory.greedy_match(df).collect()} == {("c", "a", "x"), ("c", "b", "y"), ("d", "a", "x")}


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", T0), ("2", None, T0 + timedelta(days=1)), ("3", "z", None)], "id string, t string, created_at timestamp")
    stores.dump({"a": df}, str(tmp_path / "d"))
    back = stores.load(spark, str(tmp_path / "d"), {"a": "id string, t string, created_at timestamp"})["a"]
    assert sorted(back.collect()) == sorted(df.collect())
    new, mark = stores.since(df, T0, "created_at")
    assert {r["id"] for r in new.collect()} == {"2", "3"} and mark == T0 + timedelta(days=1)
    stores.save_index(df, str(tmp_path / "i"), 2)
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "i")).collect()} == {"1", "2"}
    assert stores.with_ids(df.drop("id"), "e", "t").select("id").distinct().count() == 3
    spends = spark.createDataFrame([("u", 1, "a", 0.6), ("u", 2, "b", 0.4), ("u", 3, "c", 0.1)], "user string, at int, id string, epsilon double")
    assert [r["allowed"] for r in stores.running_budget(spends, 1.0).orderBy("at").collect()] == [True, True, False]
    msgs = spark.createDataFrame([('{"type":"discover","agent_id":"a","capabilities":[]}',), ('{"type":"discover"}',), ("broken",), (None,)], "value string")
    assert [r[0] for r in msgs.select(stores.message_kind()).collect()] == ["discover", None, None, None]


def test_transcript_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.jsonl").write_text(f'{{"type":"session","id":"s"}}\n{{"type":"message","id":"m{i}","message":{{"role":"user","content":"hi"}}}}\n')
        q = stores.stream_transcripts(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert {r["msg_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {f"m{k}" for k in range(i + 1)}
