"""Writes as plans: upsert that never lowers trust, strict insert, delete, counters, status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.schema import STATUSES, effective_status

KEY = ["scope_key", "kind", "content_hash"]


def fold(rows: DataFrame) -> DataFrame:
    """State after applying deliveries in order of ``seq``.

    In each (scope, kind, content hash) a delivery is accepted if its trust is above all
    before it, or equal to the highest and of the record that holds that trust. The last accepted
    one stays whole, but its proof count is the highest of the accepted ones. Everything is decided
    in narrow columns; full rows are fetched for the winners only.

    A group may hold a third of all deliveries, under any number of ids: it's reduced by aggregates, map-side,
    to one row for each of its five trusts, with the first delivery and its id. Only these meet in a window.
    """
    n = rows.select(*KEY, "seq", "id", "trust_tier", "proof_count")
    # The first delivery of a trust holds it, if no higher trust came before.
    a = n.groupBy(*KEY, "trust_tier").agg(F.min("seq").alias("first_seq"), F.min_by("id", "seq").alias("id"))
    higher = Window.partitionBy(*KEY).orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("before", F.max("trust_tier").over(higher)).filter(F.col("before").isNull() | (F.col("trust_tier") > F.col("before")))
    # These rise in trust; each is open until the next begins.
    nxt = Window.partitionBy(*KEY).orderBy("first_seq")
    a = a.withColumn("closed_at", F.lead("first_seq").over(nxt)).withColumn("holder", F.struct("id")).drop("id", "before")
    j = n.withColumn("holder", F.struct("id")).join(a, [*KEY, "trust_tier", "holder"])
    j = j.filter((F.col("seq") >= F.col("first_seq")) & (F.col("closed_at").isNull() | (F.col("seq") < F.col("closed_at"))))
    return j.groupBy(*KEY).agg(
        F.max_by("id", "seq").alias("id"), F.max_by("trust_tier", "seq").alias("trust_tier"),
        F.max("proof_count").alias("proof_count"), F.max("seq").alias("seq"),
    )


def merged(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Full rows of the store after an upsert of ``incoming`` (unique ``seq``, above the store's)."""
    rows = store.unionByName(incoming, allowMissingColumns=True)
    state = fold(rows).select("seq", F.col("proof_count").alias("__proof"))
    return rows.join(state, "seq").withColumn("proof_count", F.col("__proof")).drop("__proof")


def conflicts(rows: DataFrame) -> DataFrame:
    """What a strict insert would refuse: keys and ids that come more than once."""
    by_id = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("id").alias("what"), F.col("id").alias("value"), "n")
    key = F.concat_ws("|", *KEY)
    by_key = rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("key").alias("what"), key.alias("value"), "n")
    return by_id.unionByName(by_key)


def delete(store: DataFrame, scope_key: str, ids: DataFrame) -> DataFrame:
    """The store without the given ids of one scope."""
    gone = ids.select("id").distinct().withColumn("scope_key", F.lit(scope_key))
    return store.join(gone, ["id", "scope_key"], "left_anti")


def bumped(store: DataFrame, credits: DataFrame) -> DataFrame:
    """The store with ``n`` proofs more per credit (id, n), or (scope_key, id, n), for what isn't quarantined."""
    by = ["scope_key", "id"] if "scope_key" in credits.columns else ["id"]
    c = credits.groupBy(*by).agg(F.sum("n").alias("__n"))
    add = F.when(effective_status() != "quarantined", F.coalesce("__n", F.lit(0))).otherwise(0)
    return store.join(c, by, "left").withColumn("proof_count", F.col("proof_count") + add).drop("__n")


def set_status(store: DataFrame, scope_key: str, ids: list[str], status: str) -> DataFrame:
    """The store with a new status for those of the ids that are effective-active in the scope."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    hit = (F.col("scope_key") == scope_key) & F.col("id").isin(ids) & (effective_status() == "active")
    return store.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


def carried(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Incoming rows without a vector get the stored one of the same id."""
    old = store.filter("embedding IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("embedding", "embedder_name", "embedder_dim"), "seq").alias("__old"))
    j = incoming.join(old, "id", "left")
    lacking = F.col("embedding").isNull() & F.col("__old").isNotNull()
    for c in ("embedder_name", "embedder_dim", "embedding"):
        j = j.withColumn(c, F.when(lacking, F.col("__old")[c]).otherwise(F.col(c)))
    return j.drop("__old")
