"""Reading on from where a run ended, appending, whole dumps, and the search index as a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.sources.transcripts import RECORD, flatten_content


def since(rows: DataFrame, processed_to: datetime | None, at: str = "at") -> tuple[DataFrame, datetime | None]:
    """(rows after ``processed_to``, the next watermark). Late rows count by their own time, not their session's; rows without a time are always new."""
    new = rows if processed_to is None else rows.where(F.col(at).isNull() | (F.col(at) > F.lit(processed_to)))
    last = new.agg(F.max(at)).first()[0]
    return new, last or processed_to


def stream_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, msg_id, ts, role, content) of message records in the files of a folder as they arrive.

    The stream's checkpoint remembers the files, so a restart goes on behind them. A session's header may come in
    another batch, so messages carry their file instead.
    """
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", RECORD).alias("r"))
    kept = lines.where("r.type = 'message' and coalesce(r.message.role, '') <> 'system'")
    return kept.select("path", F.col("r.id").alias("msg_id"), F.col("r.timestamp").alias("ts"), F.col("r.message.role").alias("role"), flatten_content(F.col("r.message.content")).alias("content")).where("content is not null")


def with_ids(rows: DataFrame, prefix: str, *parts: str) -> DataFrame:
    """Rows with an id made of their parts, the same in every run; given ids stay."""
    made = F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts]), 256), 1, 24))
    return rows.withColumn("id", F.coalesce("id", made) if "id" in rows.columns else made)


def append(rows: DataFrame, path: str, *partition: str) -> None:
    rows.write.mode("append").partitionBy(*partition).parquet(path)


def dump(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """All tables as JSON lines, a folder each, with the version in every row; ids are kept."""
    for name, df in tables.items():
        df.withColumn("_version", F.lit(version)).write.mode("overwrite").json(f"{path}/{name}")


def load(spark: SparkSession, path: str, schemas: dict[str, str], version: int = 1) -> dict[str, DataFrame]:
    """The tables of a dump; rows of another version are an error when read."""
    checked = F.when(F.col("_version") != version, F.raise_error(F.lit("another version"))).otherwise(F.lit(True))
    return {name: spark.read.schema(f"{schema}, _version int").json(f"{path}/{name}").where(checked).drop("_version") for name, schema in schemas.items()}


def save_index(rows: DataFrame, path: str, most: int, at: str = "created_at") -> None:
    """The newest ``most`` rows (id, ...) of a search index: cut by order, not by a window over the table."""
    rows.orderBy(F.desc_nulls_last(at), F.desc("id")).limit(most).write.mode("overwrite").parquet(path)


def running_budget(spends: DataFrame, total: float) -> DataFrame:
    """Adds ``allowed``: whether a query (user, at, id, epsilon) still fits into its user's budget of ``total``."""
    upto = Window.partitionBy("user").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return spends.withColumn("allowed", F.sum("epsilon").over(upto) <= total + 1e-12)


# Kinds of messages and what each must hold.
MESSAGES = {"discover": ("agent_id", "capabilities"), "announce": ("agent_id", "endpoint"), "contribute": ("agent_id", "template"), "request": ("agent_id", "category"), "response": ("agent_id", "templates")}


def message_kind(raw: str = "value"):  # noqa: ANN201
    """The kind of a JSON message that holds all it must, else null."""
    got = F.try_parse_json(F.col(raw))
    out = F.lit(None).cast("string")
    for kind, fields in MESSAGES.items():
        whole = F.try_variant_get(got, "$.type", "string") == kind
        for f in fields:
            whole = whole & F.try_variant_get(got, f"$.{f}", "variant").isNotNull()
        out = F.when(whole, kind).otherwise(out)
    return out


def discover(agents: DataFrame, capability: str | None = None, tier: str | None = None, karma: float = 0.0, trust: float = 0.0) -> DataFrame:
    """Agents (capabilities, tier, karma, trust) that fit; trust is 0.6 of karma up to 100 and 0.4 of the local score."""
    held = agents.withColumn("reputation", 0.6 * F.least(F.col("karma"), F.lit(100.0)) / 100 + 0.4 * F.col("trust"))
    tests = [F.col("karma") >= karma, F.col("reputation") >= trust] + ([F.array_contains("capabilities", capability)] if capability else []) + ([F.col("tier") == tier] if tier else [])
    for t in tests:
        held = held.where(t)
    return held
