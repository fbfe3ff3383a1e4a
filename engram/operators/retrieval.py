"""Ranked retrieval: lexical, by vector, by keyword, and the fusion of ranked lists. Queries are arguments.

A query text becomes a handful of terms at plan time, so scoring is one pass over the texts without a shuffle of their
words; what a pass needs of the whole corpus (number, mean length, document frequencies) is one row. Vectors are met by
queries in blocks of ``BLOCK``, by matrix products where the vectors are read; only partial results are shuffled.
Null texts and empty queries give no rows; ties are broken by id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import stage

BLOCK = 4_096


def terms(query: str) -> list[str]:
    """Words of a query, repeated ones again, of two letters or more."""
    return [t for t in re.sub(r"[^A-Za-z0-9_]+", " ", query).lower().split() if len(t) > 1]


def fts_query(raw: str) -> tuple[list[str], list[str]] | None:
    """(phrases, terms) that a text must all have; null for a query without any."""
    phrases = re.findall(r'"([^"]+)"', raw or "")
    rest = re.sub(r'"[^"]+"', "", raw or "")
    found = [t.lower() for t in re.findall(r"[A-Za-z0-9_]+", rest) if len(t) > 1]
    return (phrases, found) if phrases or found else None


def bm25(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75, every: bool = False) -> DataFrame:
    """(id, score) of documents (id, text) with a term of the query (with ``every``, all of them).

    The sum over the query's terms, repeated ones again, is divided by three times their number and capped at 1.
    """
    asked = terms(query)
    distinct = list(dict.fromkeys(asked))
    if not distinct:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    # Two scans of a text: its words are counted, and those that the query asks for are taken out.
    found = F.regexp_extract_all("text", F.lit(rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(distinct)})(?![A-Za-z0-9_])"), F.lit(0))
    # A barrier keeps what refers to the counts from scanning again.
    held = stage(docs.where("text is not null").select("id", "text"), dl=F.regexp_count("text", F.lit("[A-Za-z0-9_]{2,}")), w=F.split(F.lower(F.array_join(found, " ")), " "))
    counted = held.where("dl > 0").select("id", "dl", *[(F.size("w") - F.size(F.array_remove("w", t))).alias(f"tf{i}") for i, t in enumerate(distinct)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))]).first()
    total = F.lit(0.0)
    for i, t in enumerate(distinct):
        idf = float(np.log((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5) + 1))
        tf = F.col(f"tf{i}")
        total = total + asked.count(t) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / (stats["avg"] or 1.0)))
    join = (lambda x, y: x & y) if every else (lambda x, y: x | y)
    return counted.where(reduce(join, [F.col(f"tf{i}") > 0 for i in range(len(distinct))])).select("id", F.least(total / (3 * len(asked)), F.lit(1.0)).alias("score"))


def fts(docs: DataFrame, raw: str) -> DataFrame:
    """(id, score) of documents that hold all phrases and terms of a query, by BM25 of its words."""
    got = fts_query(raw)
    if got is None:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    phrases, found = got
    kept = docs
    for p in phrases:
        kept = kept.where(F.lower("text").contains(p.lower()))
    scored = bm25(docs, " ".join([*found, *phrases]), every=True)
    return scored.join(kept.select("id"), "id", "left_semi") if phrases else scored


def bm25_substring(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) where terms count wherever they stand in a text; lengths are words between white space."""
    asked = [t for t in query.lower().split() if t]
    if not asked:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    low = docs.where("text is not null").select("id", F.lower("text").alias("t"))
    counted = low.select("id", F.size(F.filter(F.split("t", r"\s+"), lambda w: w != "")).alias("dl"), *[((F.length("t") - F.length(F.replace("t", F.lit(t), F.lit("")))) / len(t)).alias(f"tf{i}") for i, t in enumerate(asked)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))]).first()
    total = F.lit(0.0)
    for i in range(len(asked)):
        tf = F.col(f"tf{i}")
        idf = float(np.log((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5) + 1))
        total = total + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / (stats["avg"] or 1.0)))
    return counted.select("id", total.alias("score")).where("score > 0")


def similarities(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Matrix of queries by vectors under a metric; a zero norm has similarity 0."""
    if metric == "pearson":
        q, v = q - q.mean(axis=1, keepdims=True), v - v.mean(axis=1, keepdims=True)
    if metric in ("cosine", "pearson"):
        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        cos = np.divide(q @ v.T, norm, out=np.zeros((len(q), len(v))), where=norm > 0)
        return cos if metric == "cosine" else np.where(norm > 0, (cos + 1) / 2, 0.0)
    if metric == "dot":
        return (q @ v.T + 1) / 2
    n = q.shape[1]
    if metric == "euclidean":
        square = (q ** 2).sum(axis=1)[:, None] + (v ** 2).sum(axis=1)[None, :] - 2 * q @ v.T
        return 1 / (1 + np.sqrt(np.maximum(square, 0)) / np.sqrt(n))
    if metric == "manhattan":
        return np.array([1 / (1 + np.abs(v - x).sum(axis=1) / n) for x in q])
    raise ValueError(metric)


def sweep(vectors: DataFrame, queries: DataFrame, part: Callable, schema: str, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """Partial results of all queries (id, embedding, label) against all vectors (id, embedding, label).

    ``part`` makes a table from (query ids, query labels, vector ids, vector labels, similarities). Queries come by blocks of
    ``block``, so what is sent to the tasks has a bound; of every block one pass reads the vectors. Vectors of another
    length than the query's, null and empty ones meet no query.
    """
    out, held = None, []

    def passes(rows: list) -> DataFrame:
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r["embedding"]), []).append(r)
        sent = vectors.sparkSession.sparkContext.broadcast({n: (np.array([r["id"] for r in g]), np.array([r["label"] for r in g], object), np.array([r["embedding"] for r in g], float)) for n, g in by_size.items()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sizes = pdf["embedding"].map(lambda e: 0 if e is None else len(e))
                for n, (qid, qlabel, q) in sent.value.items():
                    own = pdf[sizes == n]
                    if len(own):
                        yield part(qid, qlabel, own["id"].to_numpy(), own["label"].to_numpy(object), similarities(metric, q, np.array(own["embedding"].tolist(), float)))

        return vectors.select("id", "embedding", "label").mapInPandas(run, schema)

    for row in queries.where("embedding is not null and size(embedding) > 0").select("id", "embedding", "label").toLocalIterator():
        held.append(row)
        if len(held) == block:
            out = passes(held) if out is None else out.unionByName(passes(held))
            held = []
    if held:
        out = passes(held) if out is None else out.unionByName(passes(held))
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.1, metric: str = "cosine", itself: bool = False) -> DataFrame:
    """(qid, id, score): the ``k`` nearest vectors of each query; each batch gives its own ``k``, which are merged."""

    def part(qid: np.ndarray, _ql: np.ndarray, ids: np.ndarray, _l: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
        rows = []
        for i, q in enumerate(qid):
            s = np.round(sims[i], 9)
            if not itself:
                s = np.where(ids == q, -np.inf, s)
            order = np.lexsort((ids, -s))[:k]
            rows += [(q, ids[j], float(s[j])) for j in order if s[j] >= least]
        return pd.DataFrame(rows, columns=["qid", "id", "score"])

    partial = sweep(vectors, queries, part, "qid bigint, id bigint, score double", metric)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return partial.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def vector_best(vectors: DataFrame, queries: DataFrame, least: float = 0.3, metric: str = "cosine") -> DataFrame:
    """(id, best): each vector's highest similarity to any query but itself."""

    def part(qid: np.ndarray, _ql: np.ndarray, ids: np.ndarray, _l: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": ids, "best": np.where(qid[:, None] == ids[None, :], -np.inf, sims).max(axis=0)})

    return sweep(vectors, queries, part, "id bigint, best double", metric).groupBy("id").agg(F.max("best").alias("best")).where(F.col("best") >= least)


def by_label(vectors: DataFrame, queries: DataFrame, least: float | None = None, metric: str = "cosine") -> DataFrame:
    """(qid, own, label, mean, n): similarity of each query to the vectors of each label, itself left out."""

    def part(qid: np.ndarray, ql: np.ndarray, ids: np.ndarray, labels: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
        use = qid[:, None] != ids[None, :]
        use = use if least is None else use & (sims >= least)
        rows = []
        for label in pd.unique(labels):
            at = np.array([x == label for x in labels])
            rows.append(pd.DataFrame({"qid": qid, "own": ql, "label": label, "total": np.where(use[:, at], sims[:, at], 0).sum(axis=1), "n": use[:, at].sum(axis=1)}))
        return pd.concat(rows)

    sums = sweep(vectors, queries, part, "qid bigint, own int, label int, total double, n bigint", metric).groupBy("qid", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.where("n > 0").select("qid", "own", "label", (F.col("total") / F.col("n")).alias("mean"), "n")


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    """(id, score, rank from 0) of the ``limit`` best: cut first, then numbered, so no window holds the table."""
    top = scores.orderBy(F.desc("score"), "id").limit(limit)
    return top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "id", "score"))).alias("x")).select(F.posexplode("x").alias("rank", "x")).select("x.id", "x.score", "rank")


def fuse(lists: list[tuple[DataFrame, float, str]], k: int = 60, limit: int = 50) -> DataFrame:
    """(id, score, sources): weighted reciprocal ranks of ranked lists (scores, weight, name), of each the ``limit`` best."""
    parts = [ranked(scores, limit).select("id", (F.lit(w) / (k + F.col("rank") + 1)).alias("w"), F.lit(name).alias("source")) for scores, w, name in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("w").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def hybrid(lists: list[tuple[DataFrame, float, str]], top: int = 20, least: float = 0.1) -> DataFrame:
    """(id, score, sources): lists of twice ``top``, weights made to sum 1, scores divided by the best, from ``least`` on."""
    whole = sum(w for _, w, _ in lists)
    fused = fuse([(s, w / whole, n) for s, w, n in lists], limit=2 * top)
    best = fused.agg(F.max("score").alias("best"))
    scaled = fused.join(F.broadcast(best)).select("id", (F.col("score") / F.col("best")).alias("score"), "sources")  # best is one row
    return scaled.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(top)


def merge_results(lists: list[tuple[DataFrame, str]], limit: int = 50) -> DataFrame:
    """(id, score, sources): the best score of each id over several result lists, and the lists that have it."""
    parts = [s.select("id", "score", F.lit(n).alias("source")) for s, n in lists]
    merged = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return merged.orderBy(F.desc("score"), "id").limit(limit)


def agentic(retrieve: Callable[[str], DataFrame], query: str, enough: Callable[[DataFrame], bool], follow: Callable[[str, DataFrame], list[str]], rounds: int = 3, most: int = 50) -> DataFrame:
    """Rounds of retrieval until ``enough`` says so: each adds the results of at most four follow-up queries.

    ``enough`` and ``follow`` are the caller's judges of the ``most`` best results so far (a model or a rule).
    """
    found = merge_results([(retrieve(query), "round 1")], most)
    for i in range(2, rounds + 1):
        if enough(found):
            break
        more = follow(query, found)[:4]
        if not more:
            break
        found = merge_results([(found.select("id", "score"), "before"), *[(retrieve(q), f"round {i}") for q in more]], most)
    return found


def word_hits(text: Column, query: str, longer: int = 2) -> Column:
    """How many words of a query, longer than ``longer``, a text contains."""
    words = list(dict.fromkeys(w for w in query.lower().split() if len(w) > longer))
    return reduce(lambda a, b: a + b, [F.lower(text).contains(w).cast("int") for w in words], F.lit(0))


def words_over(text: Column, longer: int = 2) -> Column:
    """Distinct lower-case words of a text, other signs as blanks, longer than ``longer``."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > longer))


def text_similarity(one: Column, other: Column) -> Column:
    """0.85 where a text holds the other, else the best of word overlap, 0.7 of partly shared words, 0.8 of shared long words.

    An empty text is held by every other.
    """
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", " "), r"\A\s+|\s+\z", "")
    a, b = norm(one), norm(other)
    x, y = words_over(one), words_over(other)
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    part = F.size(F.filter(x, lambda w: F.exists(y, lambda v: w.contains(v) | v.contains(w)))) / F.size(x)
    kx, ky = words_over(one, 4), words_over(other, 4)
    key = F.when((F.size(kx) > 0) & (F.size(ky) > 0), F.size(F.array_intersect(kx, ky)) / F.least(F.size(kx), F.size(ky))).otherwise(0.0)
    return F.when(a.contains(b) | b.contains(a), 0.85).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.greatest(jaccard, part * 0.7, key * 0.8))


def effect_match(cause: Column, effect: Column, query: str) -> Column:
    """How well a link answers why ``query``: 0.9 by its effect, 0.85 by its cause, else shared words."""
    low, q = F.lower(effect), query.lower()
    words = [w for w in q.split() if len(w) > 2]
    own = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 2)
    asked = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    overlap = F.size(F.array_intersect(own, asked)) / F.greatest(F.size(F.array_union(own, asked)), F.lit(1))
    partial = F.size(F.filter(asked, lambda w: F.exists(own, lambda v: v.contains(w) | w.contains(v)))) / max(len(words), 1)
    return F.when(low.contains(q) | F.lit(q).contains(low), 0.9).when(F.lower(cause).contains(q), 0.85).otherwise(F.greatest(overlap, partial * 0.8))


def procedure_match(trigger: Column, action: Column, success: Column, used: Column, examples: Column, query: str) -> Column:
    """Relevance of a procedure: its likeness to the query, its success, use and examples; null under a likeness of 0.1."""
    words = F.array(*map(F.lit, dict.fromkeys(w for w in re.sub(r"[^a-z0-9_\s]", " ", query.lower()).split() if len(w) > 2)))

    def like(c: Column) -> Column:
        own = words_over(c)
        both = F.size(F.array_union(own, words))
        near = F.when(both > 0, F.size(F.array_intersect(own, words)) / both).otherwise(0.0)
        return F.least(F.lit(1.0), near + F.when(F.lower(c).contains(query.lower()) | F.lit(query.lower()).contains(F.lower(c)), 0.2).otherwise(0.0))

    best = F.greatest(like(trigger), like(action) * 0.8)
    total = best * 0.5 + success * 0.25 + F.least(F.lit(1.0), F.log10(used + 1) / 2) * 0.15 + F.least(F.lit(1.0), examples / 5) * 0.1
    return F.when(best >= 0.1, total)
