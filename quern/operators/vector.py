"""Exact nearest rows for a stated set of queries.

A stated set of queries of checked size goes to the rows, which stay where they are: each task keeps the
best k of its rows for each query, and only these are shuffled. Larger sets of queries and the rows are
packed into blocks of bounded size. A block of queries meets all blocks of rows in one task, or in few, by matrix
products, and gives its best rows once, so neither side has to fit anywhere whole, and what is shuffled doesn't
grow with the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import places, valid
from quern.session import checkpointed, partitions_for, small_batches, spread

QUERY_BLOCK, ROW_BLOCK = 2048, 8192
# Numbers in a block of rows or queries at most (8 MB), and in a piece of a product.
BLOCK_NUMBERS, PRODUCT = 1_000_000, 4_000_000
# Scores within so little of a bound are rounded before they are compared.
MARGIN = 1e-8
# Up to so many queries, of so many numbers in all (64 MB), are sent to the rows where they lie; more meet blocks of rows by a join.
BROADCAST_QUERIES, BROADCAST_NUMBERS = 4096, 8_000_000
SLICE = 2048


PACKED = "spaces array<string>, sizes array<int>, ids array<string>, matrix binary"


def _packed(block: int):
    """Function of batches of rows (id, space, vector) giving blocks of up to so many, ordered by space, where they lie."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            batch = batch.sort_values("space", kind="stable")
            numbers = np.cumsum(batch["vector"].map(len).to_numpy())
            while at < len(batch):
                room = np.searchsorted(numbers, (numbers[at - 1] if at else 0) + BLOCK_NUMBERS, side="right")
                part = batch.iloc[at : max(at + 1, min(at + block, int(room)))]
                at += len(part)
                spaces = part.groupby("space", sort=False)
                m = b"".join(_unit(g["vector"]).tobytes() for _, g in spaces)
                yield pd.DataFrame({"spaces": [[x for x, _ in spaces]], "sizes": [[len(g) for _, g in spaces]], "ids": [part["id"].tolist()], "matrix": [m]})

    return pack


def _opened(spaces, sizes, ids, matrix: bytes) -> Iterator[tuple]:
    """(space, ids, matrix) of a block."""
    ids, numbers, row, at = np.asarray(ids, dtype=object), np.frombuffer(matrix), 0, 0
    for space, n in zip(spaces, sizes):
        dim = int(space.rpartition("|")[2])
        yield space, ids[row : row + n], numbers[at : at + n * dim].reshape(n, dim)
        row, at = row + n, at + n * dim


class _Found:
    """The best ``k`` rows so far of each query of one space in a block."""

    def __init__(self, qids: np.ndarray, x: np.ndarray, k: int, rounding: int):
        self.qids, self.x, self.k, self.rounding = qids, x, k, rounding
        self.single = x.astype("f4")
        self.least = np.full(len(qids), -np.inf)
        self.new, self.n_new = [(np.zeros(0, "i8"), np.zeros(0), np.zeros(0, dtype=object))], 0

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        step = max(1, PRODUCT // len(ids))
        single = y.astype("f4").T
        # Products of single precision are off by less than this; what they let through is worked out in double.
        off = MARGIN + (len(single) + 2) * 2.0**-22
        for lo in range(0, len(self.qids), step):
            s = self.single[lo : lo + step] @ single
            least = self.least[lo : lo + step, None] - off
            if len(ids) > self.k and np.isinf(least).any():
                least = np.maximum(least, -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1 : self.k] - 2 * off)
            # All that reach the k-th score stay, so that ties are decided by id.
            i, j = np.divmod(places(s >= least.astype("f4")), len(ids))
            s = np.einsum("ij,ij->i", self.x[i + lo], y[j])
            reach = s >= self.least[i + lo] - MARGIN
            i, j, s = i[reach], j[reach], s[reach]
            self.new.append((i + lo, np.round(s, self.rounding) + 0.0, ids[j]))
            self.n_new += len(i)
        if self.n_new >= len(self.qids) * self.k or np.isinf(self.least).any():
            self.settle()

    def settle(self) -> None:
        q, s, ids = (np.concatenate(x) for x in zip(*self.new))
        order = np.lexsort((-s, q))
        q, s, ids = q[order], s[order], ids[order]
        sizes = np.bincount(q, minlength=len(self.qids))
        starts = np.cumsum(sizes) - sizes
        full = sizes >= self.k
        self.least[full] = s[starts[full] + self.k - 1]
        rank = np.arange(len(q)) - starts[q]
        kept = rank < self.k
        # Where more rows tie for the last places than there is room, the lowest ids have them.
        tied = s == self.least[q]
        for x in np.unique(q[tied & ~kept]).tolist():
            part = np.flatnonzero(tied[starts[x] : starts[x] + sizes[x]]) + starts[x]
            room = int(kept[part].sum())
            kept[part] = False
            kept[sorted(part.tolist(), key=ids.__getitem__)[:room]] = True
        self.new, self.n_new = [(q[kept], s[kept], ids[kept])], 0

    def hits(self) -> Iterator[pd.DataFrame]:
        self.settle()
        q, s, ids = self.new[0]
        for at in range(0, len(q), 50_000):
            yield pd.DataFrame({"qid": self.qids[q[at : at + 50_000]], "id": ids[at : at + 50_000], "score": s[at : at + 50_000]})


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype="f8") for v in vectors])
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _in_place(queries: DataFrame, k: int, rounding: int):
    """Function of batches of rows giving the best ``k`` of a whole task for each query."""
    rows = queries.collect()
    known: dict = {}
    for r in rows:
        known.setdefault(r.space, ([], []))[0].append(r.id)
        known[r.space][1].append(r.vector)
    shared = queries.sparkSession.sparkContext.broadcast({s: (np.asarray(i, dtype=object), _unit(v)) for s, (i, v) in known.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            found = [] if best is None else [best]
            for space, g in b.groupby("space"):
                qids, x = shared.value.get(space, (None, None))
                for at in range(0, len(g) if qids is not None else 0, SLICE):
                    part = g.iloc[at : at + SLICE]
                    s = np.round(x @ _unit(part["vector"]).T, rounding) + 0.0
                    n = min(k, len(part))
                    # All that reach the k-th score stay, so that ties are decided by id.
                    i, j = np.nonzero(s >= -np.partition(-s, n - 1, axis=1)[:, n - 1 : n])
                    found.append(pd.DataFrame({"qid": qids[i], "id": part["id"].to_numpy()[j], "score": s[i, j]}))
            if found:
                best = pd.concat(found).sort_values(["qid", "score", "id"], ascending=[True, False, True])
                best = best[best.groupby("qid").cumcount() < k]
        if best is not None:
            yield best

    return run


def topk(queries: DataFrame, rows: DataFrame, k: int, rounding: int = 9) -> DataFrame:
    """Rows (qid, id, score, rank): the ``k`` rows most similar to each query.

    Both sides have (id, space, vector); they meet within equal space and dimension. Scores are
    cosines rounded to ``rounding`` digits, 0 for vectors of no length; ties rank by id. Vectors that
    aren't valid take no part. k of 0 or less gives no rows.
    """
    def keep(df: DataFrame) -> DataFrame:
        v = F.col("vector").cast("array<double>")
        df = df.select(F.col("id").cast("string").alias("id"), F.col("space").cast("string").alias("space"), v.alias("vector"))
        return df.filter(valid(F.col("vector"))).withColumn("space", F.concat_ws("|", F.coalesce("space", F.lit("")), F.size("vector")))

    q, r = keep(queries), keep(rows)
    if k <= 0:
        return q.limit(0).select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("numbers")).first()
    if size["n"] <= BROADCAST_QUERIES and size["numbers"] <= BROADCAST_NUMBERS:
        parts = spread(r).mapInPandas(_in_place(q, k, rounding), "qid string, id string, score double")
        return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    small_batches(rows.sparkSession)
    # Tasks enough for all cores, whatever the number of queries.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    block = max(1, min(QUERY_BLOCK, -(-size["n"] // (2 * cores)), BLOCK_NUMBERS * size["n"] // max(1, size["numbers"])))
    nq = partitions_for(size["n"], block)
    qb = checkpointed(q.repartitionByRange(nq, "space", F.xxhash64("id")).mapInPandas(_packed(QUERY_BLOCK), PACKED))
    qb = qb.select(F.monotonically_increasing_id().alias("b"), *(F.col(c).alias(f"q_{c}") for c in qb.columns))
    rb = checkpointed(r.mapInPandas(_packed(ROW_BLOCK), PACKED))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            for t in batch.itertuples(index=False):
                if t.b not in known:
                    known[t.b] = {x: _Found(qids, m, k, rounding) for x, qids, m in _opened(t.q_spaces, t.q_sizes, t.q_ids, t.q_matrix)}
                for space, ids, m in _opened(t.spaces, t.sizes, t.ids, t.matrix):
                    if space in known[t.b]:
                        known[t.b][space].meet(ids, m)
        for found in known.values():
            for x in found.values():
                yield from x.hits()

    # The hint keeps a small side from being sent to all tasks, which would leave one task for all queries.
    pairs = rb.coalesce(partitions_for(2 * cores, nq)).crossJoin(qb.hint("shuffle_replicate_nl"))
    parts = pairs.mapInPandas(score, "qid string, id string, score double")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
