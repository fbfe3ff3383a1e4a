import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from engram.operators import timestamps as T


def ms(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


CASES = [
    ("2025-01-31T23:59:59.123Z", "de", "exact", ms(2025, 1, 31, 23, 59, 59) + 123),
    ("1763679268", "de", "resolved", 1763679268000),
    (" D7: 1763679268.5\n", "de", "resolved", 1763679268500),
    ("1763679268123456", "de", "resolved", 1763679268123),
    ("20240714T182236Z", "de", "resolved", ms(2024, 7, 14, 18, 22, 36)),
    ("2024-06-09 14:01:43 CEST", "de", "resolved", ms(2024, 6, 9, 12, 1, 43)),
    ("2024-06-09 14:01:43,999", "de", "resolved", ms(2024, 6, 9, 12, 1, 43) + 999),
    ("Mon, 24 Mar 2025 10:37:19 +0100", "us", "resolved", ms(2025, 3, 24, 9, 37, 19)),
    ("01/08/2025 17:00", "us", "resolved", ms(2025, 1, 8, 22, 0)),
    ("01/08/2025 17:00", "de", "resolved", ms(2025, 8, 1, 15, 0)),
    ("13/08/2025 2:51 PM", "us", "unreadable", None),
    ("01/02/2025 12:51 AM", "us", "resolved", ms(2025, 1, 2, 5, 51)),
    ("28 Haziran 2025 14:19", "de", "resolved", ms(2025, 6, 28, 12, 19)),
    ("15. August 2025 21:25", "de", "resolved", ms(2025, 8, 15, 19, 25)),
    ("10 de julio de 2024, 08:28", "de", "resolved", ms(2024, 7, 10, 6, 28)),
    ("2025-03-29T12:40:58+01:00[Europe/Paris]", "us", "resolved", ms(2025, 3, 29, 11, 40, 58)),
    ("2024-10-27 02:30:00", "de", "resolved", ms(2024, 10, 27, 0, 30)),
    ("2025-03-30 02:30:00", "de", "resolved", ms(2025, 3, 30, 1, 30)),
    ("2025-02-30 10:00:00", "de", "unreadable", None),
    ("2025-02-20 24:00:00", "de", "unreadable", None),
    ("D7:24", "de", "unreadable", None), ("yesterday", "de", "unreadable", None), ("", "de", "unreadable", None), (None, "de", "unreadable", None),
    ("2024-06-09 14:01", "nobody", "unreadable", None),
    ("2024-06-09 14:01Z", "nobody", "resolved", ms(2024, 6, 9, 14, 1)),
    ("x" * 50_000, "de", "unreadable", None),
]


@pytest.fixture(scope="module")
def agents(spark):
    return spark.createDataFrame([("de", "Europe/Berlin", "de-DE"), ("us", "America/New_York", "en-US"), ("free", "UTC", None)], "agent_id string, home_zone string, locale string")


def test_forms(spark, agents):
    df = spark.createDataFrame([("t", str(i), a, ts) for i, (ts, a, _, _) in enumerate(CASES)], "source string, row_id string, agent_id string, ts string")
    got = {int(r["row_id"]): (r["status"], r["epoch_ms"]) for r in T.normalise(df, agents).collect()}
    assert {i: got[i] for i in got} == {i: (c[2], c[3]) for i, c in enumerate(CASES)}


def test_em_finds_the_order_without_a_locale(spark, agents):
    rows = [("t", f"r{i}", "free", f"{i:02d}/03/2025 10:00") for i in range(1, 29)]
    df = spark.createDataFrame(rows, "source string, row_id string, agent_id string, ts string")
    out = T.normalise(df, agents)
    assert {r["format"] for r in out.collect()} == {"dmy"} and out.where("row_id = 'r5'").first()["epoch_ms"] == ms(2025, 3, 5, 10)
    few = spark.createDataFrame([("t", "a", "free", "05/03/2025 10:00")], "source string, row_id string, agent_id string, ts string")
    assert T.normalise(few, agents).first()["status"] == "ambiguous"


def test_posteriors_against_hidden_locales(spark):
    """Half of the agents lose their locale: the estimate must find the order that their values were written in."""
    rng = random.Random(7)
    agents, rows, want = [], [], {}
    for a in range(20):
        order = ("dmy", "mdy")[a % 2]
        agents.append((f"a{a}", "UTC", ("de-DE", "en-US")[a % 2] if a % 4 < 2 else None))
        for i in range(60):
            at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=rng.randrange(500_000))
            form = rng.choice(["num", "num", "iso", "epoch"])
            text = {"num": at.strftime("%d/%m/%Y %H:%M" if order == "dmy" else "%m/%d/%Y %H:%M"), "iso": at.strftime("%Y-%m-%d %H:%M"), "epoch": str(int(at.timestamp()))}[form]
            rows.append(("t", f"{a}-{i}", f"a{a}", text))
            want[f"{a}-{i}"] = int(at.timestamp() * 1000)
    df = spark.createDataFrame(rows, "source string, row_id string, agent_id string, ts string")
    got = T.normalise(df, spark.createDataFrame(agents, "agent_id string, home_zone string, locale string")).collect()
    assert {r["row_id"]: r["epoch_ms"] for r in got if r["status"] == "resolved"} == want
    assert {r["format"] for r in got} == {"dmy", "mdy", "iso", "epoch_s"} and min(r["posterior"] for r in got) >= 0.9


def test_empty_and_clashing_columns(spark, agents):
    df = spark.createDataFrame([], "source string, row_id string, agent_id string, ts string, home_zone string")
    assert T.normalise(df.withColumn("locale", F.lit("x")), agents).count() == 0
