"""Mixing sources to target weights.

Every document has a fixed pseudo-random place on a line of 2^60 positions. Tokens are summed
by source and stretch of that line; from these sums, a few numbers per source, comes the place
up to which its documents are taken so that the budget is met. Only the stretch in which the
budget ends is summed again in finer stretches. Selection is then one filter by place and
source: no sort, and no row leaves its executor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import with_token_counts
from quern.session import checkpointed

PLACE_BITS = 60
LEVEL_BITS = 10
# The weights are read by the driver; a table of more sources than this is refused.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Share:
    """What one source contributes: ``whole`` uses of each document, and one more below ``below``."""

    source: str
    target: float
    size: int
    whole: int
    below: int
    is_short: bool


def clean_source(c):
    """Sources are equal after trimming and lower-casing."""
    return F.lower(F.trim(c))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, place) of each document; null text has size 0."""
    d = with_token_counts(docs.select("doc_id", "source", "text"), "text").drop("text")
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), 64 - PLACE_BITS)
    return d.withColumn("source", clean_source(F.col("source"))).withColumn("place", place)


def source_sizes(docs: DataFrame) -> DataFrame:
    """Tokens per source, the null source included."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("size"))


def plan_shares(docs: DataFrame, weights: DataFrame, budget: int | None = None) -> list[Share]:
    """Uses of each source's documents that bring the mix to the target weights.

    ``docs`` is the result of :func:`sized`, ``budget`` the tokens of the whole mix (default: those of all
    documents, each counted once). A source falls short if its documents, used ``max_repeats``
    times, don't reach its share of the budget.
    """
    rows = weights.select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    want = {}
    for r in rows:
        if r.source is not None:
            want[r.source] = (float(r.target_share or 0), max(0, int(r.max_repeats or 0)))
    clean = {s: s.strip(" ").lower() for s in want}
    known = docs.sparkSession.createDataFrame([(c,) for c in sorted(set(clean.values()))], "source string")
    sums = source_sizes(docs)
    total = sums.agg(F.sum("size").alias("size"))
    got = sums.join(F.broadcast(known), "source").unionByName(total.select(F.lit(None).cast("string").alias("source"), "size"))
    size = {r.source: int(r["size"] or 0) for r in got.collect()}
    everything = size.get(None, 0)
    budget = everything if budget is None else budget
    open_ends, out = {}, []
    for s, (share, most) in want.items():
        have, need = size.get(clean[s], 0), share * budget
        short = most * have < need
        whole = most if short or not have else min(most, int(need // have))
        out.append([s, share, have, whole, 0, short or (not have and need >= 0)])
        if have and not short and whole < most:
            open_ends[s] = need - whole * have
    ends = _thresholds(docs, {clean[s]: r for s, r in open_ends.items()})
    for o in out:
        if o[0] in open_ends:
            o[4] = ends[clean[o[0]]]
    return [Share(*o) for o in out]


def _thresholds(docs: DataFrame, rest: dict[str, float]) -> dict[str, int]:
    """Place below which a source's documents hold about ``rest`` tokens, level by level."""
    low, left = dict.fromkeys(rest, 0), dict(rest)
    spark = docs.sparkSession
    for level in range(PLACE_BITS // LEVEL_BITS):
        shift = PLACE_BITS - LEVEL_BITS * (level + 1)
        if not left:
            break
        at = spark.createDataFrame([(s, low[s] >> (shift + LEVEL_BITS), float(left[s])) for s in left], "source string, high bigint, open double")
        part = docs.withColumn("high", F.shiftright("place", shift + LEVEL_BITS)).join(F.broadcast(at), ["source", "high"])
        sums = part.groupBy("source", "open", F.shiftright("place", shift).alias("b")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
        upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        # At most 1,024 sums a source; of these, only the one in which the budget ends comes to the driver.
        ends = sums.withColumn("upto", F.sum("n").over(upto)).filter((F.col("upto") > F.col("open")) & (F.col("upto") - F.col("n") <= F.col("open")))
        found = {r.source: r for r in ends.collect()}
        for s in list(left):
            end = low[s] + (1 << (shift + LEVEL_BITS))
            if (r := found.get(s)) is None:
                del left[s]
            else:
                left[s] -= r.upto - r.n
                end = r.b << shift
                if r.k == 1 or shift == 0:
                    # One row is the boundary: take it if that comes nearer to the target.
                    end = (r.b + 1) << shift if r.n - left[s] < left[s] else end
                    del left[s]
            low[s] = end
    return low


def mix(docs: DataFrame, shares: list[Share]) -> DataFrame:
    """Rows (doc_id, source, n_tokens, n_uses) of the documents that the mix uses.

    Documents without text, or of a source without weight, aren't used. Repeated rows count as
    documents of their own, and are used alike.
    """
    plan = docs.sparkSession.createDataFrame(
        [(s.source.strip(" ").lower(), s.whole, s.below) for s in shares if s.size],
        "source string, whole int, below bigint",
    )
    n = F.col("whole") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)
    used = docs.join(F.broadcast(plan), "source").withColumn("n_uses", n)
    return used.filter("n_uses > 0 AND n_tokens > 0").select("doc_id", "source", "n_tokens", "n_uses")


def report(docs: DataFrame, shares: list[Share]) -> DataFrame:
    """One row per source of the weights: its size, tokens used, share reached, and if it falls short."""
    used = mix(docs, shares).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used"))
    plan = docs.sparkSession.createDataFrame(
        [(s.source, s.source.strip(" ").lower(), s.target, s.size, s.is_short) for s in shares],
        "source string, clean string, target_share double, size bigint, is_short boolean",
    )
    j = plan.join(used.withColumnRenamed("source", "clean"), "clean", "left")
    j = j.withColumn("used_tokens", F.coalesce("used", F.lit(0).cast("bigint")))
    total = j.agg(F.sum("used_tokens").alias("all_tokens"))
    j = j.crossJoin(F.broadcast(total))  # one row
    reached = F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), F.col("all_tokens")), F.lit(0.0))
    return j.select("source", "target_share", F.col("size").alias("source_tokens"), "used_tokens", reached.alias("reached_share"), "is_short")


def prepared(docs: DataFrame) -> DataFrame:
    """Sized documents, written once so that no level tokenizes again."""
    return checkpointed(sized(docs))
