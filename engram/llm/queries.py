"""Queries of the llm problems and, where SQL can say them, their DuckDB counterparts."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import language, packing, pii, residue, statements, survivors, tokens
from engram.session import fill_cores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fact supplies each surviving field of each statement."""
    return survivors.suppliers(fill_cores(table(spark, sf_dir, "sheep_facts"), "id"))


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving values themselves."""
    s = survivors.survivors(fill_cores(table(spark, sf_dir, "sheep_facts"), "id"))
    return s.select("group_id", *[F.col(f"{n}.value").alias(n) for n in survivors.fields()])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the smallest id and each other id of the same statement."""
    return statements.duplicate_pairs(fill_cores(table(spark, sf_dir, "sheep_facts"), "id"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement once with the number of its copies."""
    return statements.count_statements(statements.distinct_ids(fill_cores(table(spark, sf_dir, "sheep_facts"), "id"))).select("first_id", "n_copies")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokens.with_ids(fill_cores(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")).select("doc_id", "ids")


def p9_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment of every document to bins of every container."""
    sizes = packing.cut(tokens.with_sizes(fill_cores(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")).select("doc_id", "n_tokens"))
    return packing.fill(sizes, table(spark, sf_dir, "containers"))


def personal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, row_id, field_name, text) of all fields with free text, replays as they came."""
    take = lambda t, k, f, c: table(spark, sf_dir, t).select(F.lit(t).alias("source_table"), F.col(k).alias("row_id"), F.lit(f).alias("field_name"), c.alias("text"))
    parts = take("raw_messages", "msg_id", "content", F.col("content")).unionByName(take("sheep_episodes", "id", "summary", F.col("summary")))
    parts = parts.unionByName(take("sheep_facts", "id", "object", F.col("object"))).unionByName(take("sheep_facts", "id", "evidence", F.explode("evidence")))
    return fill_cores(parts.where("text is not null and row_id is not null"), "row_id")


def pseudonym_key(spark: SparkSession) -> str:
    """The secret of the session setting ``engram.pseudonym.key``; where none is set a new one, kept in the session and told to none."""
    key = spark.conf.get("engram.pseudonym.key", None)
    if key is None:
        key = token_hex(32)
        spark.conf.set("engram.pseudonym.key", key)
    return key


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its items replaced by placeholders; a text that comes again in a replay comes out once."""
    out = pii.redacted(personal_fields(spark, sf_dir).dropDuplicates(), pseudonym_key(spark))
    return out.select("source_table", "row_id", "field_name", F.col("r.redacted").alias("redacted"), F.col("r.kinds").alias("kinds"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal data in each field. Texts are scanned where they are read; only found kinds are shuffled."""
    out = pii.redacted(personal_fields(spark, sf_dir), pseudonym_key(spark))
    return out.select("source_table", "row_id", "field_name", F.explode("r.kinds").alias("kind")).distinct()


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, row_id, lang, text) of messages and queries; replays once."""
    a = table(spark, sf_dir, "raw_messages").select(F.lit("raw_messages").alias("source_table"), F.col("msg_id").alias("row_id"), "lang", F.col("content").alias("text"))
    b = table(spark, sf_dir, "recall_requests").select(F.lit("recall_requests").alias("source_table"), F.col("request_id").alias("row_id"), "lang", F.col("query_text").alias("text"))
    return a.unionByName(b).where("row_id is not null")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(table(spark, sf_dir, "documents"))
    return language.passages(fill_cores(labelled_texts(spark, sf_dir), "row_id"), model)


def p3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every text with its language and confidence."""
    return _judged(spark, sf_dir).select("source_table", "row_id", F.posexplode("passages").alias("passage", "p")).select("source_table", "row_id", "passage", F.col("p.lang").alias("lang"), F.round("p.confidence", 4).alias("confidence")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of texts whose label is missing or wrong, or that hold several languages."""
    label = F.lower(F.trim(F.translate("lang", "İ", "i")))
    names = F.create_map(*[F.lit(x) for pair in language.BY_NAME.items() for x in pair])
    said = F.coalesce(F.element_at(names, label), F.element_at(names, F.element_at(F.split(label, r"[-_ (]"), 1)))
    rows = _judged(spark, sf_dir).select("source_table", "row_id", said.alias("said"), language.languages(F.col("passages")).alias("langs"))
    wrong = (F.size("langs") > 1) | F.col("said").isNull() | ~F.array_contains("langs", F.coalesce("said", F.lit("")))
    return rows.where((F.size("langs") > 0) & wrong).select("source_table", "row_id", F.explode("langs").alias("lang")).distinct()


def p10_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every excluded document with its reason."""
    return residue.excluded(fill_cores(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")).where("reason is not null").select("doc_id", "reason")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to exclude."""
    return p10_reasons(spark, sf_dir).select("doc_id").distinct()


QUERIES = {
    "p10_found": p10_found, "p10_reasons": p10_reasons, "p1_found": p1_found, "p1_survivors": p1_survivors, "p3_found": p3_found, "p3_passages": p3_passages, "p5_found": p5_found, "p5_counts": p5_counts,
    "p6_found": p6_found, "p6_redacted": p6_redacted, "p8_ids": p8_ids, "p9_bins": p9_bins}
ORACLES: dict[str, str] = {}
