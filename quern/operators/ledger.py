"""The ledger of recalls: what is kept, what informed a call, and credits from use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import schema as S


def entries(ledger: DataFrame) -> DataFrame:
    """Entries as they are stored: no empty lists, at most 20 ids and 200 characters; repeats collapse."""
    e = ledger.filter(F.size("ids") > 0).withColumn("ids", F.slice("ids", 1, S.LEDGER_IDS))
    return e.withColumn("query_text", F.substring("query_text", 1, S.LEDGER_QUERY)).distinct()


def kept(ledger: DataFrame, now: Column, cap: int = S.LEDGER_CAP, ttl_s: int = S.LEDGER_TTL_S) -> DataFrame:
    """The latest ``cap`` entries not older than ``ttl_s`` at ``now``, newest first (column rank)."""
    fresh = entries(ledger).filter((F.col("ts") <= now) & (F.col("ts") >= now - F.make_dt_interval(secs=F.lit(ttl_s))))
    w = Window.orderBy(F.desc("ts"), "call_id", "query_text")
    top = fresh.orderBy(F.desc("ts"), "call_id", "query_text").limit(cap)
    return top.withColumn("rank", F.row_number().over(w))


def informed_by(ledger: DataFrame, limit: int = 5) -> DataFrame:
    """Each call's latest entries, newest first; a limit below 1 counts as 1. Entries without a call are left out.

    A busy call may hold a third of all entries: each partition keeps only its latest before the shuffle.
    """
    w = Window.partitionBy("call_id").orderBy(F.desc("ts"), "query_text", F.concat_ws(",", "ids"))
    e = entries(ledger).filter("call_id IS NOT NULL")
    return e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, limit))


def credits(ledger: DataFrame) -> DataFrame:
    """(id, n): entries in which each record was returned."""
    ids = entries(ledger).select(F.explode(F.array_distinct("ids")).alias("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n"))
