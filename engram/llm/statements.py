"""Duplicates hidden by formatting: canonical statements, counted by recursive radix partitioning into tries.

Canonical bytes keep letters and digits in order (composed Unicode, case folded) and a point between two
digits; an object of several named values becomes its sorted name-value pairs. Rows with a null part are no
statements and are left out; empty parts are compared as they are.

Buckets are prefixes of these bytes. A bucket above ``limit`` rows is split by the byte after the prefix that all its
keys share, until each fits or holds one key; then a trie per bucket gives the counts. Which buckets are split is a
table that rows meet in a join, so nothing of it is collected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import bounded_join, cut

NAME = re.compile(r"([^\W\d_]\w*)[\"'’`”“\s]*[:=]")
MARK, PAIR, PART = "\x1c", "\x1d", "\x1f"


#: What is dropped from folded text; the JVM form is for ASCII.
DROPPED = re.compile(r"[^\p{L}\p{N}\p{M}.]+|(?<!\p{N})\.|\.(?!\p{N})")
DROPPED_ASCII = r"[^a-z0-9.]+|(?<![0-9])\.|\.(?![0-9])"


def plain(text: str) -> str:
    """Letters, digits and points between digits of a text, composed and case folded."""
    if text.isascii():
        return DROPPED.sub("", text.lower())
    return DROPPED.sub("", unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).upper().casefold()).replace("i̇", "i"))


def canonical_object(text: str) -> str:
    """``plain`` of a value, or its sorted pairs where it is made of two or more named values."""
    found = list(NAME.finditer(text))
    if len(found) > 1 and not plain(text[: found[0].start()]):
        ends = [m.start() for m in found[1:]] + [len(text)]
        pairs = [(plain(m[1]), plain(text[m.end():e])) for m, e in zip(found, ends)]
        if all(v for _, v in pairs):
            return MARK + PAIR.join(sorted(f"{k}={v}" for k, v in pairs))
    return plain(text)


def canonical(facts: DataFrame) -> DataFrame:
    """Adds ``canon`` (binary) to rows with subject, predicate and object.

    ASCII statements without named values stay in the JVM; only the others' texts are sent to Python.
    """

    @F.pandas_udf("binary")
    def canon(subject: pd.Series, predicate: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else PART.join((plain(s), plain(p), canonical_object(o))).encode() for s, p, o in zip(subject, predicate, value)], dtype=object)

    whole = facts.where(F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull())
    easy = F.concat("subject", "predicate", "object").rlike(r"\A[\x00-\x7f]*\z") & ~F.col("object").rlike(r"(?s)[:=].*[:=]")
    bare = lambda c: F.regexp_replace(F.lower(c), DROPPED_ASCII, "")
    hard = [F.when(~easy, F.col(c)) for c in ("subject", "predicate", "object")]
    quick = F.when(easy, F.encode(F.concat(bare("subject"), F.lit(PART), bare("predicate"), F.lit(PART), bare("object")), "UTF-8"))
    return whole.withColumn("canon", F.coalesce(quick, canon(*hard)))


class Trie:
    """Strings under a byte trie with stride ``step``; a terminal holds its count and smallest id."""

    def __init__(self, step: int = 8) -> None:
        self.root, self.step = {}, step

    def add(self, key: bytes, n: int, first: str) -> None:
        node = self.root
        for i in range(0, len(key), self.step):
            node = node.setdefault(key[i:i + self.step], {})
        had = node.get(None)
        node[None] = (n, first) if had is None else (had[0] + n, min(had[1], first))

    def __iter__(self) -> Iterator[tuple[bytes, int, str]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for k, child in node.items():
                if k is None:
                    yield prefix, *child
                else:
                    stack.append((prefix + k, child))


def buckets(partials: DataFrame, limit: int, step: int = 1) -> DataFrame:
    """Adds ``bucket`` to rows (canon, ...): prefixes, split until a bucket has at most ``limit`` rows or one key.

    Each level counts the buckets of rows that the level before split, and those above the limit go on by ``step`` bytes
    beyond what their keys share; they are at most rows / limit. Keys of any length and likeness end up split, as each
    level goes at least a byte deeper.
    """

    @F.pandas_udf("int")
    def shared(low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([len(commonprefix([bytes(a), bytes(b)])) for a, b in zip(low, high)], dtype="int32")

    placed = partials.withColumn("bucket", F.substring("canon", 1, step)).withColumn("_open", F.lit(True))
    while True:
        sizes = placed.where("_open").groupBy("bucket").agg(F.count("*").alias("n"), F.min("canon").alias("low"), F.max("canon").alias("high"))
        big = cut(sizes.where((F.col("n") > limit) & (F.col("low") < F.col("high"))).select("bucket", (shared("low", "high") + step).alias("_depth")))
        if big.isEmpty():
            return placed.drop("_open")
        placed = bounded_join(placed, big, ["bucket"], limit=200_000)
        deeper = F.col("_depth").isNotNull()
        placed = placed.withColumn("_open", deeper).withColumn("bucket", F.when(deeper, F.expr("substring(canon, 1, _depth)")).otherwise(F.col("bucket"))).drop("_depth")


COUNTS = "canon binary, n_copies bigint, first_id string"


def merged(batches: Iterator[pd.DataFrame], most: int = 200_000) -> Iterator[pd.DataFrame]:
    """Copies merged where they are read, in tries of at most ``most`` rows."""
    trie, held = Trie(), 0
    for pdf in batches:
        for canon, n, first in zip(pdf["canon"], pdf["n_copies"], pdf["first_id"]):
            trie.add(bytes(canon), n, first)
        held += len(pdf)
        if held > most:
            yield pd.DataFrame(list(trie), columns=["canon", "n_copies", "first_id"])
            trie, held = Trie(), 0
    if held:
        yield pd.DataFrame(list(trie), columns=["canon", "n_copies", "first_id"])


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The final counts: rows come by bucket, and a task holds the trie of one bucket."""
    trie, at, out = Trie(), None, []
    for pdf in batches:
        for bucket, canon, n, first in zip(pdf["bucket"], pdf["canon"], pdf["n_copies"], pdf["first_id"]):
            if bucket != at:
                out.extend(trie)
                trie, at = Trie(), bucket
            trie.add(bytes(canon), n, first)
        yield pd.DataFrame(out, columns=["canon", "n_copies", "first_id"])
        out = []
    yield pd.DataFrame(list(trie), columns=["canon", "n_copies", "first_id"])


def count_statements(rows: DataFrame, limit: int = 5_000) -> DataFrame:
    """(canon, n_copies, first_id) of rows (id, canon), distinct ids, by radix buckets and their tries.

    Copies are merged where they are read, so a statement that a third of all rows repeat costs a row a task.
    """
    partials = cut(rows.select("canon", F.lit(1).cast("bigint").alias("n_copies"), F.col("id").alias("first_id")).mapInPandas(merged, COUNTS))
    return buckets(partials, limit).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(counted, COUNTS)


def distinct_ids(facts: DataFrame) -> DataFrame:
    """(id, canon): a replayed row counts once."""
    return canonical(facts.where("id is not null").select("id", "subject", "predicate", "object").distinct()).groupBy("id").agg(F.min("canon").alias("canon"))


def duplicate_pairs(facts: DataFrame, hot: int = 100_000) -> DataFrame:
    """(first_id, dup_id) of every statement with several ids.

    Statements of ``hot`` copies or more, at most rows / hot of them, meet their rows by broadcast, or by a salted
    shuffle where they are too many for it; all others meet in a shuffle whose keys have fewer rows than that.
    """
    rows = cut(distinct_ids(facts))
    key = F.sha2("canon", 256)
    many = cut(count_statements(rows).where("n_copies > 1").select(key.alias("_k"), "n_copies", "first_id"))
    keyed = rows.select("id", key.alias("_k"))
    tops = many.where(F.col("n_copies") >= hot).select("_k", F.col("first_id").alias("_top"))
    lows = many.where(F.col("n_copies") < hot).select("_k", "first_id")
    known = bounded_join(keyed, tops, ["_k"])
    of_tops = known.where("_top is not null").select(F.col("_top").alias("first_id"), "id")
    of_lows = known.where("_top is null").join(lows, "_k").select("first_id", "id")
    return of_tops.unionByName(of_lows).where("id <> first_id").select("first_id", F.col("id").alias("dup_id"))
