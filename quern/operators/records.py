"""Reads over records: lookup, counts, feeds, board, metadata, lineage, integrity.

Every function takes a frame of the record schema. Feeds are ranked per scope, so one job serves
all scopes; filters on ``scope_key`` and ``kind`` reach the scan as partition filters of the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import schema as S
from quern.functions.text import hash_column, id_column


def scoped(df: DataFrame, scope_key: str, kind: str | None = None) -> DataFrame:
    """Rows of one scope, and of one kind on demand."""
    if not scope_key:
        raise ValueError("a scope is required")
    df = df.filter(F.col("scope_key") == scope_key)
    return df if kind is None else df.filter(F.col("kind") == kind)


def lookup(df: DataFrame, scope_key: str, ids: list[str]) -> DataFrame:
    """Records by id within a scope; ids of other scopes are ignored."""
    if not ids:
        return df.limit(0)
    return scoped(df, scope_key).filter(F.col("id").isin(list(dict.fromkeys(ids))))


def count_by_status(df: DataFrame) -> DataFrame:
    """Records per scope and effective status."""
    return df.groupBy("scope_key", S.effective_status().alias("effective_status")).agg(F.count("*").alias("n"))


def count_by_kind(df: DataFrame) -> DataFrame:
    """Records per scope and kind, with totals per scope and over all (null marks a total)."""
    return df.rollup("scope_key", "kind").agg(F.count("*").alias("n"), F.count_if(S.surfacable()).alias("n_recallable"))


def census(df: DataFrame) -> DataFrame:
    """Effective-active records per scope over the whole store."""
    return df.filter(S.effective_status() == "active").groupBy("scope_key").agg(F.count("*").alias("n"))


def count_by_source(df: DataFrame) -> DataFrame:
    """Effective-active records per scope and source."""
    return df.filter(S.effective_status() == "active").groupBy("scope_key", "prov_source_uri").agg(F.count("*").alias("n"))


def top_per_scope(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each scope with their rank from 1; Spark cuts each partition before it shuffles."""
    w = Window.partitionBy("scope_key").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def newest(df: DataFrame, n: int = 10) -> DataFrame:
    """Latest records per scope, whatever their status."""
    return top_per_scope(df, [F.desc("created_at"), F.desc("id")], n)


def recent_feed(df: DataFrame, n: int = 10) -> DataFrame:
    """Latest effective-active records of trust 1 or more per scope."""
    live = df.filter((S.effective_status() == "active") & (F.col("trust_tier") >= 1))
    return top_per_scope(live, [F.desc("created_at"), F.desc("id")], S.board_limit(n))


def active_directives(df: DataFrame, n: int = S.PINNED_LIMIT, floor: int = S.DIRECTIVE_FLOOR) -> DataFrame:
    """Standing rules per scope, oldest first."""
    rules = df.filter((F.col("kind") == "directive") & (S.effective_status() == "active") & (F.col("trust_tier") >= floor))
    return top_per_scope(rules, [F.asc("created_at"), F.asc("id")], n)


def typed_metadata(md: DataFrame) -> DataFrame:
    """Metadata with values read by their type: one column each for text, number, real and boolean.

    A value that doesn't fit its type is null in all of them. Repeated rows collapse.
    """
    v = F.col("meta_value")
    return md.distinct().select(
        "record_id", "meta_key", "vtype",
        F.when(F.col("vtype") == "str", v).alias("str_value"),
        F.when((F.col("vtype") == "int") & v.rlike(r"^[+-]?[0-9]{1,18}$"), v.try_cast("bigint")).alias("int_value"),
        F.when((F.col("vtype") == "float") & v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), v.try_cast("double")).alias("float_value"),
        F.when((F.col("vtype") == "bool") & F.lower(v).isin("1", "true"), F.lit(True))
        .when((F.col("vtype") == "bool") & F.lower(v).isin("0", "false"), F.lit(False)).alias("bool_value"),
    )


def board_entries(df: DataFrame, md: DataFrame, tag: str, n: int | None) -> DataFrame:
    """Records tagged for the board that pass its floor, oldest first per scope; ``n`` None: all."""
    tagged = md.filter((F.col("meta_key") == "board") & (F.col("meta_value") == tag)).select(F.col("record_id").alias("id")).distinct()
    live = df.filter((S.effective_status() == "active") & (F.col("trust_tier") >= S.BOARD_FLOOR)).join(tagged, "id", "left_semi")
    return live if n is None else top_per_scope(live, [F.asc("created_at"), F.asc("id")], S.board_limit(n))


def pending_open(df: DataFrame, md: DataFrame) -> DataFrame:
    """All open pending entries per scope, without limit."""
    return board_entries(df, md, "pending", None).groupBy("scope_key").agg(F.count("*").alias("n"))


def board(df: DataFrame, md: DataFrame, recent: int = 10, majors: int = 10, rules: int = 5) -> DataFrame:
    """The legs of the board in one frame (leg, scope_key, rank, id), from one snapshot."""
    pick = lambda leg, d: d.select(F.lit(leg).alias("leg"), "scope_key", "rank", "id")
    return (
        pick("rules", active_directives(df, rules))
        .unionByName(pick("majors", board_entries(df, md, "major", majors)))
        .unionByName(pick("recent", recent_feed(df, recent)))
    )


def tampered(df: DataFrame) -> DataFrame:
    """Records whose stored hash isn't that of their content."""
    return df.withColumn("computed_hash", hash_column(F.col("content"))).filter(~F.col("content_hash").eqNullSafe(F.col("computed_hash")))


def identities(df: DataFrame) -> DataFrame:
    """Each record's stored id and the one its parts give."""
    made = id_column(F.col("scope_key"), F.col("prov_source_uri"), F.col("kind"), F.col("content_hash"))
    return df.select("seq", "id", made.alias("computed_id"), F.col("id").eqNullSafe(made).alias("is_same"))


def dedup(df: DataFrame) -> DataFrame:
    """One row per scope and content: the first record that has it, and how many have."""
    return df.groupBy("scope_key", "content_hash").agg(F.min_by("id", "seq").alias("id"), F.count("*").alias("n"))


def lineage(df: DataFrame) -> DataFrame:
    """Edges of derived_from: record, target, and the target's place in the list."""
    return df.select("id", F.posexplode("derived_from").alias("position", "target_id")).distinct()


def dangling(links: DataFrame, df: DataFrame) -> DataFrame:
    """Links whose target isn't stored."""
    return links.distinct().join(df.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_anti")


def embedder_states(df: DataFrame, identities_: DataFrame) -> DataFrame:
    """Records per scope that match their scope's embedder, don't, or can't be told."""
    want = identities_.select("scope_key", F.col("embedder_name").alias("want_name"), F.col("embedder_dim").alias("want_dim"))
    j = df.join(want, "scope_key", "left")
    state = (
        F.when(F.col("want_name").isNull() | F.col("embedder_name").isNull(), "unknown")
        .when((F.col("embedder_name") == F.col("want_name")) & F.col("embedder_dim").eqNullSafe(F.col("want_dim")), "match")
        .otherwise("mismatch")
    )
    return j.groupBy("scope_key", state.alias("state")).agg(F.count("*").alias("n"))


def sources_of(hits: DataFrame) -> DataFrame:
    """Hits with file and chunk of each, null where there is no file."""
    return hits.withColumn("source", F.when(F.col("prov_source_file").isNotNull(), F.struct(F.col("prov_source_file").alias("file"), F.col("prov_chunk_index").alias("chunk"))))


def eligible_for_summary(df: DataFrame, least_trust: int = int(S.Trust.UNVERIFIED)) -> DataFrame:
    """What a summary may draw on, and the trust it may then have (column summary_trust)."""
    floor = max(least_trust, int(S.Trust.UNVERIFIED))
    ok = df.filter((S.effective_status() != "quarantined") & (F.col("trust_tier") >= floor))
    # A grouping and a join, as a window would bring a whole scope into one task.
    return ok.join(ok.groupBy("scope_key").agg(F.min("trust_tier").alias("summary_trust")), "scope_key")
