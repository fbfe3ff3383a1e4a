"""Operators that once left out part of their rows, against plain Python over all of them."""

import math
import random
import re
from datetime import datetime, timedelta
from itertools import combinations, groupby

from engram.operators import folds


def test_size_chunks_hold_every_message(spark):
    rows = [(a, s, f"m{i:04}", i // 2, "x" * (7 * i % 400)) for a, s, n in (("a1", "default", 600), ("a2", "default", 5), ("a1", None, 300), (None, None, 9), ("a1", "s1", 200)) for i in range(n)]
    want = set()
    for (a, s), own in groupby(rows, lambda r: (r[0], r[1])):
        total = 0
        for r in own:
            total += len(r[4])
            want.add((s, r[2], (total - 1) // 2500))
    got = folds.size_chunks(spark.createDataFrame(rows, "agent_id string, session_id string, msg_id string, seq int, content string").repartition(5), 2500, 16).collect()
    assert len(got) == len(rows) and {(r["session_id"], r["msg_id"], r["chunk"]) for r in got} == want


def upserts_by_force(rows):
    """Each fact against every kept one of its subject, in order."""
    norm = lambda x: (x or "").strip(" ").lower()
    kept, out = [], set()
    for i, s, p, o, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        t = (norm(s), norm(p), norm(o))
        hit = next((k for k, u in kept if u == t), None) or next((k for k, u in kept if u[0] == t[0] and folds.similarity(t, u) >= 0.9), None)
        if hit is None:
            kept.append((i, t))
        out.add((i, hit or i))
    return out


def test_upserts_across_predicates_and_beginnings(spark):
    rng = random.Random(5)
    words = ["red", "car", "lake", "museum", "tram", "of", "Île", "54", "the", "week"]
    spoil = [lambda x: x, lambda x: x + "–", lambda x: "- " + x, lambda x: '"' + x, lambda x: x[1:], lambda x: x.upper(), lambda x: x + " new", lambda x: " ".join(reversed(x.split(" "))), lambda x: x.replace(" ", "\t", 1), lambda x: ""]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 6, 9, 12]))) for _ in range(40)]
    rows = [(f"f{k:04}", rng.choice(["user", "User ", "Ann"]), rng.choice(["works_at", "works_at–", "likes", "is part of", "part of is", "- likes"]), rng.choice(spoil[:9] * 6 + spoil[9:])(rng.choice(base)), datetime(2025, 1, 1) + timedelta(hours=rng.randrange(300))) for k in range(700)]
    got = {(r["id"], r["kept_id"]) for r in folds.upsert(spark.createDataFrame(rows, "id string, subject string, predicate string, object string, at timestamp")).collect()}
    assert got == upserts_by_force(rows) and len({k for _, k in got}) < 500


def test_upserts_of_the_finding(spark):
    at = datetime(2025, 1, 1)
    rows = [("1", "u", "works_at", "Borezakos Bakery", at), ("2", "u", "works_at–", "Borezakos Bakery", at), ("3", "u", "works_at", '"Borezakos Bakery', at), ("4", "u", "works_at", "- Borezakos Bakery", at), ("5", "v", "works_at", "Borezakos Bakery", at)]
    got = {r["id"]: r["kept_id"] for r in folds.upsert(spark.createDataFrame(rows, "id string, subject string, predicate string, object string, at timestamp")).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "1", "5": "5"}


def clusters_by_force(vectors, least, most):
    """The reference's loop over all vectors, in plain Python."""
    def cosine(a, b):
        if len(a) != len(b) or not a:
            return -1.0
        return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) + 1e-12)

    clusters = []
    for i, v in vectors:
        best = max(clusters, key=lambda c: cosine(v, c[0]), default=None) if v else None
        if best and cosine(v, best[0]) >= least:
            n = len(best[1])
            best[0] = [(x * n + y) / (n + 1) for x, y in zip(best[0], v)]
            best[1].append(i)
            continue
        if v and len(clusters) >= most:
            a, b = max(combinations(clusters, 2), key=lambda p: cosine(p[0][0], p[1][0]))
            m, n = len(a[1]), len(b[1])
            a[0], a[1] = [(x * m + y * n) / (m + n) for x, y in zip(a[0], b[0])], a[1] + b[1]
            clusters.remove(b)
        clusters.append([v or [], [i]])
    return {frozenset(c[1]) for c in clusters}


def test_clusters_are_one_fold_over_all_vectors(spark):
    rng = random.Random(3)
    middle = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(25)]
    vectors = [(i, [x + rng.gauss(0, 0.35) for x in rng.choice(middle)]) for i in range(300)] + [(300, None), (301, []), (302, [1.0, 0.0]), (303, [1.0, 0.1])]
    df = spark.createDataFrame(vectors, "id bigint, embedding array<double>").repartition(6)
    for least, most in ((0.7, 100), (0.9, 20)):
        got = {}
        for r in folds.leader_clusters(df, least, most).collect():
            got.setdefault(r["cluster"], set()).add(r["id"])
        assert {frozenset(x) for x in got.values()} == clusters_by_force(vectors, least, most)
        assert len(got) <= most + 2


def test_template_signatures_take_the_whole_texts(spark, tmp_path):
    import __spark_entry__ as entry

    at = datetime(2025, 1, 1)
    texts = [("the boat is late", "plans around the boat changed", None)] * 2 + [("the boat is late", "plans around the train changed", "ask Anna at a.b@c.org"), ("The boat is late", "plans around the train changed", "ask Berta at d@e.org"), ("the boat is late", "plans around the lake changed", "x")]
    texts += [("low", "plans around", "1"), ("low", "plans around", "1")]
    rows = [(f"l{i}", "a", "fact", "f", c, "fact", "g", e, m, 0.5 if c == "low" else 0.8, "direct", at) for i, (c, e, m) in enumerate(texts)]
    spark.createDataFrame(rows, "id string, agent_id string, cause_type string, cause_id string, cause string, effect_type string, effect_id string, effect string, mechanism string, confidence double, strength string, created_at timestamp").write.parquet(f"{tmp_path}/sheep_causal_links.parquet")
    got = {r["sig"]: r["n"] for r in entry.queries()["template_mining"](spark, str(tmp_path)).collect()}
    assert got == {"the_boat_is_late→plans_around_the_boat_changed→": 2, "the_boat_is_late→plans_around_the_train_changed→ask__name__at__email_": 2}


def test_segments_cross_days_in_the_order_of_seq(spark, tmp_path):
    import __spark_entry__ as entry

    rng = random.Random(4)
    rows, want = [], {}
    for session, agent, count in (("default", "a1", 400), ("default", "a2", 30), ("s1", "a1", 25), (None, "a1", 12)):
        n, size, words, text = 0, 0, set(), []
        for i in range(count):
            if i % 11 == 0:
                text = rng.sample(["cats", "dogs", "birds", "trains", "rails", "steam", "lakes", "boats"], 3)
            own = set(text)
            if size >= 20 or (size >= 2 and len(own & words) / min(len(own), len(words)) < 0.2):
                n, size, words = n + 1, 0, set()
            size, words = size + 1, words | own
            want[(session or "none", f"{agent}-{session}-{i}")] = f"{agent}/{n}"
            at = datetime(2025, 1, 1) + timedelta(hours=5 * i)
            late = timedelta(days=9) if i % 7 == 0 else timedelta()
            rows += [(agent, session, f"{agent}-{session}-{i}", i, "user", " ".join(text), at + late)] + [(agent, session, f"{agent}-{session}-{i}", i, "user", " ".join(text), at + timedelta(days=30))] * (i % 5 == 0)
    rng.shuffle(rows)
    spark.createDataFrame(rows, "agent_id string, session_id string, msg_id string, seq int, role string, content string, ingested_at timestamp").write.parquet(f"{tmp_path}/raw_messages.parquet")
    got = entry.queries()["episode_segments"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["session"], r["msg_id"]): r["segment"] for r in got} == want


def contradictions_by_force(links):
    """The reference's loop over all pairs of an agent."""
    negation = "not|no|never|none|neither|without|lack|absent|opposite|contrary"
    bare = lambda x: re.sub("[^a-z0-9]", "", x.lower())

    def similar(x, y):
        x, y = bare(x), bare(y)
        return x in y or y in x or len({*x} & {*y}) / len({*x} | {*y}) > 0.8

    def opposed(x, y):
        x, y = x.lower(), y.lower()
        return bool(re.search(negation, x)) != bool(re.search(negation, y)) and similar(re.sub(negation, "", x), re.sub(negation, "", y))

    out = set()
    for (i, a, c, e), (j, b, d, f) in combinations(sorted(links), 2):
        if a == b and similar(c, d) and not similar(e, f) and opposed(e, f):
            out.add((i, j, "same_cause_different_effect"))
        if a == b and similar(e, f) and opposed(c, d):
            out.add((i, j, "same_effect_different_cause"))
    return out


def test_contradictions_of_both_kinds(spark, tmp_path):
    import __spark_entry__ as entry

    rng = random.Random(6)
    causes = ["the train ran late", "The train ran late!", "the trains ran late", "the train never ran late", "a quite different thing", "without the boat"]
    effects = ["trip off", "trip not off", "never a trip, opposite: off", "plans changed", "plans changed.", "no plans changed", "contrary absent without opposite plans changed"]
    links = [(f"l{i:03}", rng.choice("ab"), rng.choice(causes), rng.choice(effects)) for i in range(120)]
    rows = [(i, a, "fact", "f", c, "fact", "g", e, None, 0.8, "direct", datetime(2025, 1, 1)) for i, a, c, e in links]
    spark.createDataFrame(rows, "id string, agent_id string, cause_type string, cause_id string, cause string, effect_type string, effect_id string, effect string, mechanism string, confidence double, strength string, created_at timestamp").write.parquet(f"{tmp_path}/sheep_causal_links.parquet")
    got = [tuple(r) for r in entry.queries()["causal_contradictions"](spark, str(tmp_path)).collect()]
    want = contradictions_by_force(links)
    assert len(got) == len(want) and set(got) == want and {k for _, _, k in want} == {"same_cause_different_effect", "same_effect_different_cause"}


def chains_by_force(links):
    """Sets of links a root by steps; a link leads to those whose effect is its cause."""
    into = {}
    for i, c, e, _, _ in links:
        if e is not None:
            into.setdefault(e, set()).add((i, c))
    out = set()
    for root in {i for i, _, _, kind, sure in links if kind == "fact" and sure is not None and 0.9 <= sure <= 1}:
        at = {(i, c) for i, c, _, kind, sure in links if i == root and kind == "fact" and sure is not None and 0.9 <= sure <= 1}
        for depth in (1, 2, 3, 4):
            out |= {(root, i, depth) for i, _ in at}
            at = {x for c in {c for _, c in at} for x in into.get(c, ())}
    return out


def test_chains_through_a_hub_have_more_than_a_million_ways(spark, tmp_path):
    import __spark_entry__ as entry

    rng = random.Random(7)
    links = [(f"h{i:03}", "hub" if i < 40 else rng.choice(["hub", "n1", "n2", f"m{i}"]) if i < 60 else f"m{i}", "hub", "fact", 0.95 if i < 30 else 0.4) for i in range(620)]
    links += [(f"l{i:03}", rng.choice(["hub", "n1", "n2", "n3", "", None]), rng.choice(["n1", "n2", "n3", "n4", "", None]), rng.choice(["fact", "event", None]), rng.choice([0.9, 0.95, 0.5, 1.2, float("nan"), None])) for i in range(80)]
    # Ids that stand for two links, and links without an id.
    links += [("l003", "hub", "n4", "fact", 0.9), ("l004", "n1", "n2", "fact", 0.9), ("l004", "n2", "n1", "fact", 1.0), ("h001", "n3", "hub", "fact", 0.9)] + [(None, "n1", "n2", "fact", 0.3)] * 2 + [(None, "n2", "n3", "event", 0.3)]
    rows = [(i, "a", "fact", c, "x", k, e, "y", None, s, "direct", datetime(2025, 1, 1)) for i, c, e, k, s in links + links[::9]]
    spark.createDataFrame(rows, "id string, agent_id string, cause_type string, cause_id string, cause string, effect_type string, effect_id string, effect string, mechanism string, confidence double, strength string, created_at timestamp").write.parquet(f"{tmp_path}/sheep_causal_links.parquet")
    df = entry.queries()["causal_chain"](spark, str(tmp_path))
    got = [tuple(r) for r in df.collect()]
    want = chains_by_force(links)
    assert df.columns == ["root", "id", "depth"] and len(got) == len(want) and set(got) == want
    assert len([r for r in want if r[2] == 4]) > 620 * 30


def test_chains_of_links_without_roots_or_causes(spark):
    from pyspark.sql import functions as F

    from engram.operators import graph

    schema = "id string, cause_id string, effect_id string"
    found = lambda rows, cond: sorted(tuple(r) for r in graph.chain_by_id(spark.createDataFrame(rows, schema), cond).collect())
    assert found([], F.lit(True)) == [] and found([("a", "x", "y")], F.lit(False)) == []
    assert found([("a", None, None), ("b", "x", "y")], F.lit(True)) == [("a", "a", 1), ("b", "b", 1)]
    assert found([("a", "x", "y"), ("b", "y", "x")], F.col("id") == "a") == [("a", "a", 1), ("a", "a", 3), ("a", "b", 2), ("a", "b", 4)]
