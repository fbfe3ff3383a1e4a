"""Every query with SQL of its own against DuckDB, and what the rest must hold, on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
#: Of queries that a small table leaves without rows, the next one is taken.
LARGER = "/root/testdata/sf0.01"
MAY_BE_EMPTY = {"causal_contradictions"}


def norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def both(spark, name, folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    df = entry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    place = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(place) == cols
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((tuple(norm(r[place[c]]) for c in cols) for r in cur.fetchall()), key=key)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key), want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_duckdb(spark, name):
    got, want = both(spark, name, DIR)
    if not want and name not in MAY_BE_EMPTY:
        got, want = both(spark, name, LARGER)
        assert want, "no rows on either side prove nothing"
    assert got == want


def test_no_plan_puts_a_table_into_one_task(spark):
    """No nested loops, and no window over rows that were all sent to one task."""
    for name in ("merge_facts", "retention_facts", "duplicate_groups", "contradictions", "vector_best", "prune_lowest", "rolling_last_1000", "facts_as_of", "extracted_facts", "recall_bm25", "p7_found", "p4_found"):
        plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
        assert not re.search(r"Window [^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan), name


def test_folds_and_sources(spark, tmp_path):
    from engram.operators import folds
    from engram.sources import transcripts

    msgs = spark.createDataFrame([("s", "a", None, f"m{i}", "cats dogs birds" if i < 3 else "trains rails steam") for i in range(6)], "session string, agent string, at timestamp, msg_id string, content string")
    assert len({r["segment"] for r in folds.segment(msgs).collect()}) == 2
    (tmp_path / "a.jsonl").write_text('{"type":"session","id":"s1","timestamp":"t"}\nbroken\n{"type":"message","id":"m1","message":{"role":"user","content":"hi"}}\n'
                                      '{"type":"message","id":"m2","message":{"role":"user","content":"[{\\"type\\":\\"text\\",\\"text\\":\\"a\\"},{\\"type\\":\\"text\\",\\"text\\":\\"b\\"}]"}}\n{"type":"message","id":"m3","message":{"role":"system","content":"x"}}\n')
    (tmp_path / "b.jsonl").write_text('{"type":"message","id":"m9","message":{"role":"user","content":"no header"}}\n')
    got = {r["msg_id"]: r["content"] for r in transcripts.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"m1": "hi", "m2": "a\nb"}
    ups = spark.createDataFrame([("1", "u", "p", "red big car", None), ("2", "U", "p", "red big car ", None), ("3", "u", "p", "blue", None)], "id string, subject string, predicate string, object string, at timestamp")
    assert {(r["id"], r["kept_id"]) for r in folds.upsert(ups).collect()} == {("1", "1"), ("2", "1"), ("3", "3")}
