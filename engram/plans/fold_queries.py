"""Queries of the order-dependent folds and the export, on whole tables (no SQL form; tested on fixtures)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import folds
from engram.plans.core_problems import table
from engram.sources import transcripts


def episode_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = [F.col("session_id").alias("session"), F.col("agent_id").alias("agent"), "msg_id", "seq", "content"]
    msgs = table(spark, sf_dir, "raw_messages")
    return folds.segment(msgs.groupBy(*key).agg(F.min(F.col("ingested_at").cast("timestamp")).alias("at")))


def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.leader_clusters(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


def fact_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.upsert(table(spark, sf_dir, "sheep_facts").select("id", "subject", "predicate", "object", F.col("created_at").cast("timestamp").alias("at")).distinct())


def size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.size_chunks(table(spark, sf_dir, "raw_messages").select("agent_id", "session_id", "msg_id", "seq", "role", "content").distinct())


def user_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.export_rows(*[table(spark, sf_dir, t) for t in ("sheep_facts", "sheep_episodes", "sheep_causal_links")]).distinct()


QUERIES = {"episode_segments": episode_segments, "embedding_clusters": embedding_clusters, "fact_upserts": fact_upserts, "size_chunks": size_chunks, "user_export": user_export}
ORACLES = {
    "size_chunks": "with m as (select distinct agent_id, session_id, msg_id, seq, role, content from raw_messages) select session_id, msg_id, floor((sum(length(coalesce(content, ''))) over (partition by session_id, agent_id order by seq nulls first, msg_id rows between unbounded preceding and current row) - 1) / 25000)::bigint as chunk from m",
}
