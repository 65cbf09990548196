"""Hybrid retrieval over ranked lists: fusion, gate, surfacing filter, leg settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import hash_column
from quern.schema import POOL_FACTOR, RRF_K, surfacable


def fuse(vec: DataFrame, lex: DataFrame, top: int, k: int = RRF_K) -> DataFrame:
    """(qid, id, rrf, vrank, lrank, rank): reciprocal rank fusion of two ranked lists (qid, id, rank, score).

    One grouping instead of a full join. Equal scores keep the order of first appearance: the vector
    list, then the lexical one. A list with a repeated (qid, id) counts its best rank.
    """
    none = F.lit(None)
    both = vec.select("qid", "id", F.col("rank").alias("v"), none.cast("int").alias("l")).unionByName(
        lex.select("qid", "id", none.cast("int").alias("v"), F.col("rank").alias("l"))
    )
    g = both.groupBy("qid", "id").agg(F.min("v").alias("vrank"), F.min("l").alias("lrank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    g = g.withColumn("rrf", part("vrank") + part("lrank"))
    first = F.coalesce("vrank", F.col("lrank") + 1_000_000)
    w = Window.partitionBy("qid").orderBy(F.desc("rrf"), first)
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def surfaced(fused: DataFrame, records: DataFrame, k: int, keep_quarantined: bool = False) -> DataFrame:
    """The first ``k`` hits of each query that may be shown; applied above the pool, so hits beyond ``k`` move up.

    Where ``records`` have content and its hash, a hit whose content doesn't give its hash counts as quarantined;
    only the pool's hits are hashed.
    """
    checked = {"content", "content_hash"} <= set(records.columns)
    hits = fused.join(records.select("id", "status", "trust_tier", *(["content", "content_hash"] if checked else [])), "id")
    if not keep_quarantined:
        hits = hits.filter(surfacable())
        if checked:
            hits = hits.filter(F.col("content_hash").eqNullSafe(hash_column(F.col("content"))))
    hits = hits.drop("content", "content_hash")
    w = Window.partitionBy("qid").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column, top: int) -> DataFrame:
    """Hits (qid, id, rank, ...) by a second score, the best ``top`` of each query; ties keep their order."""
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    scored = hits.withColumn("rerank_score", score).withColumn("new_rank", F.row_number().over(w))
    return scored.filter(F.col("new_rank") <= top).drop("rank").withColumnRenamed("new_rank", "rank")


def first_gold(runs: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Rank of the first relevant hit of each query; null if there is none."""
    hit = runs.join(gold.select("qid", "id").distinct(), ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return queries.select("qid").join(hit, "qid", "left")


def fingerprint(runs: DataFrame) -> DataFrame:
    """One hash per query over its ranked ids, to show that a change moved nothing."""
    line = F.concat_ws(":", "rank", "id", "score")
    return runs.groupBy("qid").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))["line"]), 256).alias("fingerprint"))


def leaks(runs: DataFrame, queries: DataFrame, records: DataFrame, scope: str) -> DataFrame:
    """(qid, n_hits, n_foreign): hits of each query, and those that lie outside its scope."""
    j = runs.join(records.select("id", F.col(scope).alias("__s")), "id").join(queries.select("qid", F.col(scope).alias("__q")), "qid")
    return j.groupBy("qid").agg(F.count("*").alias("n_hits"), F.count_if(~F.col("__s").eqNullSafe(F.col("__q"))).alias("n_foreign"))


def pool_size(k: int, candidates: int | None = None) -> int:
    return candidates or POOL_FACTOR * k


def gate(queries: DataFrame, vec: DataFrame, records: DataFrame, min_score: float | None, keep_quarantined: bool = False) -> DataFrame:
    """(qid, top_score, verdict) per query: off, pass, abstain, or unavailable and why.

    The top score is the best cosine among the vector pool's hits that may be shown, before fusion. One that
    isn't a number can't pass.
    """
    if min_score is not None and not -1 <= min_score <= 1:
        raise ValueError("min_score must be between -1 and 1")
    shown = vec.join((records if keep_quarantined else records.filter(surfacable())).select("id"), "id", "left_semi")
    top = shown.groupBy("qid").agg(F.max("score").alias("top_score"))
    j = queries.select("qid").join(top, "qid", "left")
    if min_score is None:
        return j.withColumn("verdict", F.lit("off"))
    finite = (F.abs("top_score") < float("inf")) & ~F.isnan("top_score")
    return j.withColumn(
        "verdict",
        F.when(F.col("top_score").isNull(), "unavailable: no vector candidates").when(finite & (F.col("top_score") >= min_score), "pass").otherwise("abstain"),
    )


def hybrid(
    vec: DataFrame, lex: DataFrame, records: DataFrame, queries: DataFrame, k: int = 10, candidates: int | None = None,
    min_score: float | None = None, use_vector: bool = True, use_lexical: bool = True, keep_quarantined: bool = False,
) -> DataFrame:
    """Final hits: fuse the legs' pools, drop what may not be shown, cut to ``k``, leave out abstained queries."""
    pool = pool_size(k, candidates)
    v, x = (d.filter(F.col("rank") <= pool) if on else d.limit(0) for d, on in ((vec, use_vector), (lex, use_lexical)))
    out = surfaced(fuse(v, x, pool), records, k, keep_quarantined)
    if min_score is not None and use_vector:
        out = out.join(gate(queries, v, records, min_score).filter("verdict <> 'abstain'").select("qid"), "qid", "left_semi")
    return out


def mode(vector: bool, lexical: bool, reranked: bool = False, stub: bool = False, mismatch: bool = False, abstained: tuple[float, float] | None = None, ungated: bool = False) -> str:
    """How a result came about, in words."""
    if mismatch:
        text = "lexical-only" + "+rerank" * reranked + ": embedder mismatch"
    elif not (vector or lexical):
        text = "none: both legs off"
    else:
        text = "+".join(["vector"] * vector + ["lexical"] * lexical + ["rerank"] * reranked) + " (stub-embedder)" * stub
    if ungated:
        text += "; min_score not applied"
    if abstained:
        text += f": abstained (top-1 cosine {abstained[0]:.3f} < min_score {abstained[1]:.3f})"
    return text
