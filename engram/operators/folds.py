"""Order-dependent folds: segmentation into episodes, leader clustering, similarity upsert, size chunks.

Each fold runs per key in the order given by its arguments; the docstrings say what a task holds where a key may be hot
(the session ``default`` holds a tenth of all messages).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from engram.session import cut

WORDS = re.compile(r"[a-z0-9_]{3,}")


def segment(messages: DataFrame, longest: int = 20, overlap: float = 0.2) -> DataFrame:
    """(session, msg_id, segment) of messages (session, agent, at, msg_id, content, seq if there is one).

    Per session and agent in the order (seq, at, msg_id), nulls first. A segment ends at ``longest`` messages, or from
    two on where the keywords' overlap with it, over the smaller set, falls under ``overlap``. Messages without text
    stay in the running segment. Rows stream through in order, so a task holds one open segment, however long a session is.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, size, words = None, 0, 0, set()
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if (r.session, r.agent) != key:
                    key, n, size, words = (r.session, r.agent), 0, 0, set()
                own = set(WORDS.findall((r.content or "").lower()))
                least = min(len(own), len(words))
                if size >= longest or (size >= 2 and least and len(own & words) / least < overlap):
                    n, size, words = n + 1, 0, set()
                size, words = size + 1, words | own
                out.append((r.session, r.msg_id, f"{r.agent}/{n}"))
            yield pd.DataFrame(out, columns=["session", "msg_id", "segment"])

    order = ["session", "agent", *[c for c in ("seq", "at", "msg_id") if c in messages.columns]]
    ordered = messages.na.fill({"session": "none", "agent": "none"}).repartition("session", "agent").sortWithinPartitions(*order)
    return ordered.select("session", "agent", "msg_id", "content").mapInPandas(fold, "session string, msg_id string, segment string")


def size_chunks(messages: DataFrame, most: int = 25000, block: int = 64) -> DataFrame:
    """(session_id, msg_id, chunk) of distinct messages (agent_id, session_id, msg_id, seq, content).

    Running length per session and agent in the order (seq, msg_id), cut every ``most`` characters. The sum has two
    levels, within blocks of ``block`` sequence numbers and over the blocks, so a hot session is spread over tasks
    (rows of one sequence number stay together). Messages without session form one group per agent, those without
    seq come first.
    """
    key = ["session_id", "agent_id", "_b"]
    sized = messages.select("agent_id", "session_id", "msg_id", "seq", F.length(F.coalesce("content", F.lit(""))).alias("_n"), F.floor(F.col("seq") / block).alias("_b"))
    before = F.sum("_sum").over(Window.partitionBy(*key[:2]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sized.groupBy(*key).agg(F.sum("_n").alias("_sum")).select(*[F.col(c).alias(f"o{c}") for c in key], F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy(*key).orderBy("seq", "msg_id").rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(c).eqNullSafe(F.col(f"o{c}")) for c in key]
    return sized.withColumn("_within", within).join(offsets, same).select("session_id", "msg_id", F.floor((F.col("_before") + F.col("_within") - 1) / most).alias("chunk"))


def leader_clusters(vectors: DataFrame, least: float = 0.7, most: int = 100) -> DataFrame:
    """(id, cluster) of vectors (id, embedding), one fold over all of them in the order of id: the nearest centroid of
    cosine ``least`` takes a vector and moves by the running mean, else it opens a cluster; from ``most`` on the closest
    pair merges before. Vectors of different lengths never meet, a null or empty one has a cluster of its own.

    The order makes it one task; rows stream through it, so it holds the centroids and a number per merged cluster.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, sizes, names, into, fresh = [], [], [], {}, 0

        def cosines(v: np.ndarray) -> np.ndarray:
            same = [k for k, c in enumerate(centroids) if len(c) == len(v)]
            out = np.full(len(centroids), -1.0)
            if same:
                m = np.array([centroids[k] for k in same])
                out[same] = m @ v / (np.linalg.norm(m, axis=1) * np.linalg.norm(v) + 1e-12)
            return out

        for pdf in batches:
            got = []
            for x in pdf["embedding"]:
                v = np.asarray([] if x is None else x, float)
                sims = cosines(v) if len(v) else np.zeros(0)
                if len(sims) and sims.max() >= least:
                    j = int(sims.argmax())
                    centroids[j] = (centroids[j] * sizes[j] + v) / (sizes[j] + 1)
                    sizes[j] += 1
                    got.append(names[j])
                    continue
                if len(v) and len(centroids) >= most:
                    pair = np.full((len(centroids), len(centroids)), -1.0)
                    for n in {len(c) for c in centroids} - {0}:
                        same = [k for k, c in enumerate(centroids) if len(c) == n]
                        u = np.array([centroids[k] for k in same])
                        u /= np.linalg.norm(u, axis=1, keepdims=True) + 1e-12
                        pair[np.ix_(same, same)] = np.where(np.tri(len(u), dtype=bool), -1.0, u @ u.T)
                    a, b = divmod(int(pair.argmax()), len(centroids))
                    if pair[a, b] > -1:
                        centroids[a] = (centroids[a] * sizes[a] + centroids[b] * sizes[b]) / (sizes[a] + sizes[b])
                        sizes[a] += sizes[b]
                        into[names[b]] = names[a]
                        for y in (centroids, sizes, names):
                            y.pop(b)
                for y, z in ((centroids, v), (sizes, 1), (names, fresh)):
                    y.append(z)
                got.append(fresh)
                fresh += 1
            yield pd.DataFrame({"id": pdf["id"], "_first": pd.Series(got, dtype="int64", index=pdf.index), "_last": None})
        for x in sorted(into):  # a cluster merges into an older one, whose last name is known
            into[x] = into.get(into[x], into[x])
        yield pd.DataFrame({"id": None, "_first": pd.Series(list(into), dtype="int64"), "_last": pd.Series(list(into.values()), dtype="int64")})

    ordered = vectors.select("id", "embedding").repartition(1).sortWithinPartitions("id")
    folded = cut(ordered.mapInPandas(fold, "id bigint, _first bigint, _last bigint"))
    merged = folded.where(F.col("_last").isNotNull()).select("_first", "_last")
    return folded.where(F.col("_last").isNull()).select("id", "_first").join(merged, "_first", "left").select("id", F.coalesce("_last", "_first").cast("int").alias("cluster"))


def similarity(a: tuple, b: tuple) -> float:
    """Triple similarity: fields equal 1, contained 0.95, else token Jaccard; weights 0.2, 0.3, 0.5."""

    def one(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if x in y or y in x:
            return 0.95
        p, q = set(x.split()), set(y.split())
        return len(p & q) / len(p | q) if p | q else 0.0

    return sum(w * one(x, y) for w, x, y in zip((0.2, 0.3, 0.5), a, b))


#: Lengths of the pieces by which a text is found in longer ones; each is at least half of the texts it stands for, up to 40.
PIECES = (1, 3, 6, 12, 20)


@F.pandas_udf(ArrayType(StringType()))
def tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: sorted(set(x.split())))


@F.pandas_udf(DoubleType())
def field_similarity(p1: pd.Series, o1: pd.Series, p2: pd.Series, o2: pd.Series) -> pd.Series:
    return pd.Series([similarity(("", a, b), ("", c, d)) for a, b, c, d in zip(p1, o1, p2, o2)], dtype=float)


def _by_tokens(facts: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of one subject whose objects' tokens have a Jaccard similarity of ``share``, among others.

    Prefix filter: of n tokens, the rarest of the subject first, one of the first n - ceil(share n) + 1 is common.
    """
    words = facts.select("id", "s", tokens("o").alias("w")).select("id", "s", F.size("w").alias("n"), F.explode("w").alias("w"))
    ranked = words.join(words.groupBy("s", "w").count(), ["s", "w"])
    order = F.row_number().over(Window.partitionBy("id").orderBy("count", "w"))
    keys = ranked.withColumn("r", order).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select(F.xxhash64("s", "w").alias("k"), "id", "n")
    other = keys.select("k", F.col("id").alias("b"), F.col("n").alias("m"))
    near = (F.col("n") >= F.col("m") * share - 1e-9) & (F.col("m") >= F.col("n") * share - 1e-9)
    return keys.join(other, "k").where(near & (F.col("id") < F.col("b"))).select(F.col("id").alias("a"), "b")


def _by_containment(facts: DataFrame) -> DataFrame:
    """Pairs (a, b) of one subject, the object of a in that of b or equal, among others: a is known by its beginning, b by all its pieces."""
    n, q = F.length("o"), F.lit(0)
    for x in PIECES:
        q = F.when(n >= x, x).otherwise(q)
    short = facts.where(n > 0).select(F.xxhash64("s", q.alias("q"), F.substr("o", F.lit(1), q)).alias("k"), F.col("id").alias("a"))
    pieces = lambda x: F.when(n >= x, F.transform(F.sequence(F.lit(1), n - x + 1), lambda i: F.xxhash64("s", F.lit(x), F.substr("o", i, F.lit(x)))))
    whole = facts.where(n > 0).select("id", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*[pieces(x) for x in PIECES]))))).alias("k"))
    pairs = short.join(whole, "k").where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b"))
    empty = facts.where(n == 0).select("s", F.col("id").alias("a"))
    return pairs.union(empty.join(facts.select("s", F.col("id").alias("b")), "s").where(F.col("a") != F.col("b")).select("a", "b"))


def similar_pairs(facts: DataFrame, least: float = 0.9) -> DataFrame:
    """(s, early, late, early_at, late_at) of all pairs of similarity ``least`` in facts (id, s, p, o, at) of equal subject s.

    With equal subjects the objects' similarity must reach (least - 0.5) / 0.5, so each pair shares tokens or one
    object holds the other; candidates of both kinds are judged by ``similarity`` itself.
    """
    found = _by_tokens(facts, (least - 0.5) / 0.5).union(_by_containment(facts))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: facts.select(*[F.col(c).alias(f"{x}_{c}") for c in ("s", "p", "o", "at")], F.col("id").alias(x))
    both = found.join(side("a"), "a").join(side("b"), "b").where(F.col("a_s") == F.col("b_s"))
    pairs = both.where(field_similarity("a_p", "a_o", "b_p", "b_o") >= least)
    first = F.coalesce(F.struct("a_at", "a") < F.struct("b_at", "b"), F.lit(True))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select(F.col("a_s").alias("s"), pick("a", "b").alias("early"), pick("b", "a").alias("late"), pick("a_at", "b_at").alias("early_at"), pick("b_at", "a_at").alias("late_at"))


def upsert(facts: DataFrame, least: float = 0.9) -> DataFrame:
    """(id, kept_id) of facts (id, subject, predicate, object, at): which earlier fact absorbs each one.

    Exact copies are merged before. Of the others, in the order (at, id), each is absorbed by the first kept fact of its
    subject that is similar; only facts that are similar to another one meet in the fold, so what a task holds
    is the similar pairs of one subject. Null fields count as empty; an empty field is contained in all.
    """

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gone: dict[str, str] = {}
        for r in pdf.sort_values(["late_at", "late", "early_at", "early"], na_position="first").itertuples():
            if r.late not in gone and r.early not in gone:
                gone[r.late] = r.early
        return pd.DataFrame(list(gone.items()), columns=["id", "kept_id"])

    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    keyed = facts.select("id", "at", *[norm(F.col(c)).alias(c[0]) for c in ("subject", "predicate", "object")])
    first = cut(keyed.groupBy("s", "p", "o").agg(F.min(F.struct("at", "id")).alias("f")).select("s", "p", "o", F.col("f.at").alias("at"), F.col("f.id").alias("id")))
    folded = similar_pairs(first, least).groupBy("s").applyInPandas(fold, "id string, kept_id string")
    lead = first.join(folded, "id", "left").select("s", "p", "o", F.coalesce("kept_id", "id").alias("kept_id"))
    return keyed.join(lead, ["s", "p", "o"]).select("id", "kept_id").distinct()
