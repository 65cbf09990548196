"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import credentials, lookalikes, mixing, neighbours, packing, personal, splitting, stuffing
from quern.session import spread, table

# White space as Unicode has it.
WHITE = [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

Query = Callable[[SparkSession, str], DataFrame]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "memory_records").select("id", "embedder_name", "embedder_dim", "embedding"))


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(_vectors(spark, d), whole=True)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours.nearest(_vectors(spark, d))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    content = lookalikes.alike_pairs(spread(table(spark, d, "memory_records").select("id", "content")), "id", "content")
    payload = lookalikes.alike_pairs(table(spark, d, "attack_corpus"), "attack_id", "payload")
    return content.select(F.lit("content").alias("field"), "key_a", "key_b").unionByName(
        payload.select(F.lit("payload").alias("field"), "key_a", "key_b")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "memory_records").select("id", "content"))
    found = personal.scan(rows, table(spark, d, "name_lexicon"), redact=False)
    return found.select("id", F.explode("pii_types").alias("pii_type")).distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "memory_records").select("seq", "content"))
    return personal.scan(rows, table(spark, d, "name_lexicon"), key="seq").select("seq", "redacted")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "memory_records").select("id", "content", "prov_source_file"))
    pieces = splitting.split_oversized(rows).filter("is_cut")
    cut = F.when(F.max("is_forced"), "forced").otherwise("natural")
    return pieces.groupBy("id").agg(cut.alias("cut"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "memory_records").select("seq", "id", "content", "prov_source_file"))
    pieces = splitting.split_oversized(rows)
    return pieces.select("seq", "id", F.col("piece_index").alias("prov_chunk_index"), "piece_start", "piece_overlap", "piece")


def p4_tiling(spark: SparkSession, d: str) -> DataFrame:
    # Whether the pieces of each record join to its text, each within its limit and with its overlap.
    rows = spread(table(spark, d, "memory_records").select("seq", "content", "prov_source_file"))
    p = splitting.split_oversized(rows).withColumn("limit", splitting.size_limit(F.col("prov_source_file"))).filter("piece IS NOT NULL")
    new = F.substring("piece", F.col("piece_overlap") + 1, F.length("piece"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece_index", new.alias("new")))), lambda x: x["new"])
    within = F.bool_and((F.length("piece") <= F.col("limit")) & (F.col("piece_overlap") == F.least(F.lit(splitting.OVERLAP), F.col("piece_start"))))
    return p.groupBy("seq").agg(F.md5(F.array_join(parts, "")).alias("joined"), within.alias("is_within"), (F.count("*") > 1).alias("is_cut"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "memory_records").select("seq", "id", "scope_key", "content"))
    places = credentials.find(rows).select("k", F.col("line").alias("line_no")).distinct()
    return places.join(rows.select(F.col("seq").alias("k"), "id"), "k").select("id", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "memory_records").select("seq", "id", "scope_key", "content"))
    return credentials.redact(rows, credentials.find(rows)).select("seq", "id", "redacted")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack_documents(spread(table(spark, d, "documents").select("doc_id", "text")))
    return packed.filter("part > 0").select("doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack_documents(spread(table(spark, d, "documents").select("doc_id", "text")))
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("n_tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = mixing.prepared(spread(table(spark, d, "documents").select("doc_id", "source", "text")))
    shares = mixing.plan_shares(docs, table(spark, d, "source_weights"))
    return mixing.report(docs, shares).filter("is_short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    docs = mixing.prepared(spread(table(spark, d, "documents").select("doc_id", "source", "text")))
    return mixing.report(docs, mixing.plan_shares(docs, table(spark, d, "source_weights")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = mixing.prepared(spread(table(spark, d, "documents").select("doc_id", "source", "text")))
    return mixing.mix(docs, mixing.plan_shares(docs, table(spark, d, "source_weights")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    pages = stuffing.features(table(spark, d, "documents").select("doc_id", "text"))
    return stuffing.stuffed(pages).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.features(table(spark, d, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    """Query name to function of session and data directory."""
    return {f.__name__: f for f in (p1_found, p1_nearest, p2_found, p3_found, p3_redacted, p4_found, p4_pieces, p4_tiling, p5_found, p5_redacted, p6_found, p6_containers, p7_found, p7_report, p7_mix, p8_found, p8_scores)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    white = "".join(f"\\x{{{c:x}}}" for c in WHITE)
    return {
        "p4_found": rf"""
            WITH t AS (SELECT id, regexp_replace(content, '\A[{white}]+|[{white}]+\z', '', 'g') AS c,
                   CASE WHEN lower(prov_source_file) LIKE '%.py' THEN 2000 WHEN lower(prov_source_file) LIKE '%.md' OR lower(prov_source_file) LIKE '%.markdown' THEN 1500 ELSE 800 END AS n
                   FROM memory_records),
            r AS (SELECT id, n, list_max(list_transform(string_split_regex(c, '[{white}]'), lambda x: length(x))) AS run FROM t WHERE length(c) > n)
            SELECT id, CASE WHEN bool_or(run > n) THEN 'forced' ELSE 'natural' END AS cut FROM r GROUP BY id""",
        "p4_tiling": rf"""
            WITH t AS (SELECT seq, regexp_replace(content, '\A[{white}]+|[{white}]+\z', '', 'g') AS c,
                   CASE WHEN lower(prov_source_file) LIKE '%.py' THEN 2000 WHEN lower(prov_source_file) LIKE '%.md' OR lower(prov_source_file) LIKE '%.markdown' THEN 1500 ELSE 800 END AS n
                   FROM memory_records WHERE content IS NOT NULL)
            SELECT seq, md5(c) AS joined, true AS is_within, length(c) > n AS is_cut FROM t""",
    }
