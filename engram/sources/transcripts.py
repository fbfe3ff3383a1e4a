"""Sources and sinks: JSONL session transcripts, JSON and CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "type string, id string, timestamp string, message struct<role: string, content: string>"


def flatten_content(content: Column) -> Column:
    """A text, or the text blocks of an array of blocks joined by newlines; empty becomes null."""
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.when(F.ltrim(content).startswith("["), joined).otherwise(content)
    return F.when(F.trim(text) != "", text)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, session_id, started, msg_id, ts, role, content) of JSONL files.

    A file without a header record gives no rows; broken lines and system messages are dropped.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.from_json("value", RECORD).alias("r")).where("r.type is not null")
    heads = lines.where("r.type = 'session'").groupBy("path").agg(F.min(F.struct(F.col("r.id").alias("id"), F.col("r.timestamp").alias("at"))).alias("h"))
    rows = lines.where("r.type = 'message' and coalesce(r.message.role, '') <> 'system'").join(heads, "path")
    return rows.select("path", F.col("h.id").alias("session_id"), F.col("h.at").alias("started"), F.col("r.id").alias("msg_id"), F.col("r.timestamp").alias("ts"),
                       F.col("r.message.role").alias("role"), flatten_content(F.col("r.message.content")).alias("content")).where("content is not null")


def export_rows(facts: DataFrame, episodes: DataFrame, links: DataFrame) -> DataFrame:
    """User-data export: one layout for three kinds; line ends in values become spaces."""
    flat = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    cols = ("subject", "predicate", "object", "confidence", "timestamp")
    parts = [
        facts.select(F.lit("fact").alias("type"), *[x.alias(n) for n, x in zip(cols, (flat(F.col("subject")), flat(F.col("predicate")), flat(F.col("object")), F.col("confidence"), F.col("created_at")))]),
        episodes.select(F.lit("episode").alias("type"), *[x.alias(n) for n, x in zip(cols, (flat(F.col("topic")), F.lit("summary"), flat(F.col("summary")), F.col("utility_score"), F.col("created_at")))]),
        links.select(F.lit("causal").alias("type"), *[x.alias(n) for n, x in zip(cols, (flat(F.col("cause")), F.lit("causes"), flat(F.col("effect")), F.col("confidence"), F.col("created_at")))]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def import_new(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows whose id isn't there yet; ids are kept."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
