from datetime import datetime, timedelta

from engram.operators import history, orphans
from engram.streaming.streams import OrphanStream

T0 = datetime(2025, 1, 6)
REFS = "ref_table string, row_id string, ref_field string, ref_key string, target string, seen timestamp"
PARENTS = "target string, id string, seen timestamp"


def day(n):
    return T0 + timedelta(days=n)


def tables(spark):
    refs = spark.createDataFrame([
        ("l", "1", "c", " A ", "f", day(1)), ("l", "1", "c", " A ", "f", day(3)), ("l", "2", "c", "b", "f", day(1)), ("l", "3", "c", "zz", "f", day(1)),
        ("l", "4", "c", None, "f", day(1)), ("l", "5", "c", "  ", "f", day(1)), ("l", "6", "c", "a", None, day(1)), ("l", "7", "c", "a", "e", day(1))], REFS)
    parents = spark.createDataFrame([("f", "a", day(0)), ("f", "a", day(9)), ("f", "B", day(5)), ("f", None, day(0))], PARENTS)
    return refs, parents


def test_states_do_not_depend_on_batches(spark):
    want = {("1", "known"), ("2", "late"), ("3", "absent"), ("7", "absent")}
    for cuts in ([], [day(2)], [day(1), day(4), day(8)]):
        refs, parents = tables(spark)
        assert {(r["row_id"], r["state"]) for r in orphans.run(refs, parents, cuts).collect()} == want


COLS = "kind string, ref_table string, row_id string, ref_field string, ref_key string, target string, seen timestamp, id string"


def states(store):
    return {(r["row_id"], r["state"]) for r in store.state().collect()}


def test_deletion_reopens_and_a_batch_counts_once(spark, tmp_path):
    store = orphans.OrphanStore(spark, str(tmp_path / "s"), buckets=4)
    stream = OrphanStream(store)
    first = spark.createDataFrame([("ref", "l", "1", "c", "a", "f", day(1), None), ("ref", "l", "2", "c", "b", "f", day(1), None), ("parent", None, None, None, None, "f", day(0), "a")], COLS)
    stream.on_batch(first, 0)
    assert states(store) == {("1", "known"), ("2", "absent")}
    second = spark.createDataFrame([("deleted", None, None, None, None, "f", day(2), "A"), ("parent", None, None, None, None, "f", day(3), "b")], COLS)
    for _ in range(2):  # Spark gives the last batch again after a failure
        stream.on_batch(second, 1)
        assert states(store) == {("1", "absent"), ("2", "late")}
    stream.on_batch(spark.createDataFrame([("parent", None, None, None, None, "f", day(4), "a")], COLS), 2)
    assert states(store) == {("1", "late"), ("2", "late")}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, rows in enumerate(([("ref", "l", "1", "c", "a", "f", day(1), None)], [("parent", None, None, None, None, "f", day(5), "A ")])):
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(source)
        store = orphans.OrphanStore(spark, str(tmp_path / "s"))  # nothing is kept in the process
        OrphanStream(store).start(spark.readStream.schema(COLS).parquet(source), str(tmp_path / "c")).awaitTermination(120)
        assert states(store) == {("1", ("absent", "late")[i])}


def test_open_counts(spark):
    refs, parents = tables(spark)
    got = {(str(r["period"])[:7], r["opened"], r["resolved"], r["open"]) for r in orphans.open_counts(orphans.run(refs, parents, [])).where("ref_table = 'l'").collect()}
    assert got == {("2025-01", 3, 1, 2)}


def test_empty(spark):
    refs, parents = tables(spark)
    assert orphans.run(refs.limit(0), parents, []).count() == 0


def test_versions(spark):
    rows = [("f", day(0), day(0), 1, "x"), ("f", day(7), day(7), 1, "x"), ("f", day(7), day(8), None, "x"), ("f", day(21), day(21), None, None), ("f", day(21), day(21), None, None),
            (None, day(0), day(0), 1, "x"), ("g", None, day(0), 1, "x"), ("h", day(200), day(0), None, None)]
    df = spark.createDataFrame(rows, "k string, at timestamp, arrived timestamp, a int, b string")
    log = history.change_log(history.latest_delivery(df, "k", "at", "arrived", ["a", "b"]), ["a", "b"])
    got = {(r["entity"], r["valid_from"], r["valid_to"], r["a"], r["b"]) for r in history.versions(log, ["a", "b"]).collect()}
    assert got == {("f", day(0), day(7), "1", "x"), ("f", day(7), day(21), None, "x"), ("f", day(21), None, None, None), ("h", day(200), None, None, None)}


def test_versions_across_blocks(spark):
    rows = [("f", day(7 * i), day(7 * i), i // 20) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, at timestamp, arrived timestamp, a int")
    assert history.versions(history.change_log(history.latest_delivery(df, "k", "at", "arrived", ["a"]), ["a"]), ["a"]).count() == 3
