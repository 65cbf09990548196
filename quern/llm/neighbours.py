"""Most similar vectors for every vector, by multi-index hashing.

Vectors of one embedder and dimension become binary codes: signs of several learned rotations.
Each code is cut into substrings of about log2(rows) bits, and each substring is an index of its own.
Two codes with a substring that differs in at most one bit are candidates (the pigeonhole rule
puts every code within a Hamming radius there); a substring within one bit has one of its halves
equal, so rows meet by (substring, half, value of the half) and probe only the other half's
neighbours. Candidates within the Hamming bound are then compared by their floats.

Only codes are shuffled to the indexes. Exact copies of a vector are one class first, so a group
of copies never meets in a bucket; its members are listed again at the end.

Rows to which the index gives fewer than k neighbours can be ranked exactly instead: blocks of
them are multiplied with blocks of all rows of their space, and only the best of each are kept. So
are rows of a crowd, a group of near copies that share index entries far beyond chance: the index
would give all pairs of them, while each needs k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import checkpointed, partitions_for

K = 10
MIN_SIMILARITY = 0.90
RECALL = 0.95  # aimed at for neighbours at exactly the least similarity; higher above it
FIT_ROWS = 20_000  # vectors the rotations are learned from, over all spaces
LEAST_FIT = 500  # spaces with fewer sampled vectors get random rotations
ROTATION_STEPS = 8
CLASS_BYTES = 12  # of the hash that names a vector's class
BUCKET_ROWS = 120_000  # index entries a task holds at once
PAIR_BLOCK = 500_000  # candidate pairs a task holds at once
# An index entry is crowded if it has so many rows, and so many times what chance gives it; a row is if such a share of its entries are.
CROWD_ROWS, CROWD, CROWDED = 2_000, 16, 0.25
# Exact ranking: rows of a block at most, bytes of its vectors, and blocks of all rows that a task takes.
QUERY_BLOCK, QUERY_BYTES = 2048, 1 << 19
ROW_BLOCK, ROW_BYTES = 8192, 1 << 21
TASK_BLOCKS = 32
ROUNDING = 1e-5  # more than float32 products of unit vectors are off


def usable(vector: Column, dim: Column) -> Column:
    """Not null, as many elements as ``dim`` says, all finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0)


def flip_rate(similarity: float) -> float:
    """Share of code bits in which vectors of this cosine differ, by the angle between them."""
    return math.acos(max(-1.0, min(1.0, similarity))) / math.pi


def index_shape(rows: int, min_similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring, near log2(rows) in steps of four, and how many substrings reach the recall."""
    bits = max(8, min(32, 4 * round((math.log2(max(2, rows)) - 1) / 4)))
    p = flip_rate(min_similarity)
    near = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-near))) if near < 1 else 1


def hamming_bound(bits: int, min_similarity: float) -> int:
    """Differing bits that all but one in ten thousand pairs of this cosine stay within."""
    p = flip_rate(min_similarity)
    return min(bits, math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p))))


def learn_rotation(sample: np.ndarray | None, dim: int, seed: int) -> np.ndarray:
    """Orthogonal matrix whose output signs lose little of the sample's geometry."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
    if sample is None:
        return r
    for _ in range(ROTATION_STEPS):
        signs = np.where(sample @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(sample.T @ signs)
        r = u @ vt
    return r


def learn_codes(sample: pd.DataFrame, bits: int) -> dict:
    """Per space (name, dim): mean and ``bits`` projections, from a bounded sample."""
    out = {}
    for (name, dim), g in sample.groupby(["name", "dim"]):
        dim = int(dim)
        x = np.stack([np.asarray(v, dtype="f8") for v in g["vector"]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        known = len(x) >= LEAST_FIT
        mean = x.mean(0) if known else np.zeros(dim)
        rs = [learn_rotation(x - mean if known else None, dim, seed) for seed in range(math.ceil(bits / dim))]
        out[(name, dim)] = (mean, np.hstack(rs)[:, :bits])
    return out


def default_codes(dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections for a space that the sample didn't hold."""
    return np.zeros(dim), np.hstack([learn_rotation(None, dim, s) for s in range(math.ceil(bits / dim))])[:, :bits]


def encode(codes: dict, bits: int, sub: int):
    """Function of Arrow batches (id, name, dim, vector) giving (id, space, class, code, unit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, dims = b.column("id"), b.column("name").to_pylist(), b.column("dim").to_numpy(zero_copy_only=False)
            vectors = b.column("vector")
            flat, ends = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            n = len(dims)
            cls, code, unit, space = [None] * n, [None] * n, [None] * n, [None] * n
            groups: dict = {}
            for i, key in enumerate(zip(names, dims.tolist())):
                groups.setdefault(key, []).append(i)
            for (name, dim), rows in groups.items():
                x = np.stack([flat[ends[i] : ends[i] + dim] for i in rows]).astype("f8")
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if (name, dim) not in codes:
                    codes[(name, dim)] = default_codes(dim, bits)
                mean, r = codes[(name, dim)]
                packed = np.packbits((x - mean) @ r >= 0, axis=1)
                x32, tag = x.astype("f4"), f"{name!r}\0{dim}"
                seed = blake2b(tag.encode(), digest_size=8).digest()
                number = int.from_bytes(seed[:4], "little", signed=True)
                for j, i in enumerate(rows):
                    raw = x32[j].tobytes()
                    cls[i], code[i], unit[i], space[i] = blake2b(raw, digest_size=CLASS_BYTES, key=seed).digest(), packed[j].tobytes(), raw, number
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(space, pa.int32()), pa.array(cls, pa.binary()), pa.array(code, pa.binary()), pa.array(unit, pa.binary())],
                names=["id", "space", "class", "code", "unit"],
            )

    return run


def index_entries(bits: int, sub: int):
    """Function of (space, class, code) batches giving one entry per substring and half.

    An entry is one number: 32 bits of the space, then the half's place (16) and its value (16).
    """
    half = sub // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            code = _bits(b.column("code"), bits)
            value = _substrings(code, half, bits // half).astype("i8")
            where = np.arange(bits // half, dtype="i8")
            space = b.column("space").to_numpy(zero_copy_only=False).astype("i8") << 32
            entry = space[:, None] + (where[None, :] << 16) + value
            t = b.select(["class", "code"]).take(pa.array(np.repeat(np.arange(n), bits // half)))
            yield pa.RecordBatch.from_arrays([pa.array(entry.ravel()), *t.columns], names=["entry", "class", "code"])

    return run


def _bits(column: pa.Array, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="u1").reshape(len(column), -1)
    return np.unpackbits(raw, axis=1)[:, :bits]


def bucket_pairs(bits: int, sub: int, bound: int):
    """Function of one partition's index entries giving candidate pairs (class_a < class_b), each once.

    Rows are (entry, cell, dense, class, code). Dense rows meet others, but not each other; in cells but the
    first, rows that aren't dense have met each other elsewhere.
    """
    half, n_sub = sub // 2, bits // sub

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        t = t.take(pa.compute.sort_indices(t, sort_keys=[("entry", "ascending"), ("cell", "ascending")])).combine_chunks()
        entry, cell = t.column("entry").to_numpy(), t.column("cell").to_numpy()
        raw = np.frombuffer(b"".join(t.column("class").to_pylist()), dtype=f"V{CLASS_BYTES}")
        code = _bits(t.column("code").combine_chunks(), bits)
        words = np.packbits(np.pad(code, ((0, 0), (0, -bits % 64))), axis=1).view("u8")
        where = (entry >> 16) & 0xFFFF
        other = code.reshape(len(code), bits // half, half)[np.arange(len(code)), where ^ 1].astype("i8") @ (1 << np.arange(half, dtype="i8"))
        # Rows of one bucket, sorted by the other half, so that a probe is a range.
        new = np.r_[True, (entry[1:] != entry[:-1]) | (cell[1:] != cell[:-1])]
        bucket = np.cumsum(new) - 1
        key = (bucket.astype("i8") << half) + other
        order = np.argsort(key, kind="stable")
        key, sub_at, is_second, cell = key[order], (where >> 1)[order], (where & 1)[order], cell[order]
        raw, words, dense = raw[order], words[order], t.column("dense").to_numpy(zero_copy_only=False).astype(bool)[order]
        subs = _substrings(code[order], sub, n_sub)

        def flush(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
            near = np.bitwise_count(words[a] ^ words[b]).sum(1) <= bound
            a, b = a[near], b[near]
            # A pair counts only in the first substring within one bit, and then in the first half that is equal.
            gap = np.bitwise_count(subs[a] ^ subs[b])
            first = (gap <= 1).argmax(1) == sub_at[a]
            a, b = a[first], b[first]
            if not len(a):
                return None
            both = [sorted((x.tobytes(), y.tobytes())) for x, y in zip(raw[a], raw[b])]
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in both], pa.binary()), pa.array([y for _, y in both], pa.binary())], names=["class_a", "class_b"]
            )

        def meet(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, to: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = np.maximum(hi - lo, 0)
            rows, lo, n = rows[n > 0], lo[n > 0], n[n > 0]
            # Blocks of bounded memory; a single row's range is cut as well if it's longer.
            while len(rows):
                upto = max(1, int(np.searchsorted(np.cumsum(n), PAIR_BLOCK)))
                r, s, c = rows[:upto], lo[:upto], np.minimum(n[:upto], PAIR_BLOCK)
                a = np.repeat(r, c)
                b = np.repeat(s - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
                if (out := flush(a, to[b])) is not None:
                    yield out
                rest = n[:upto] > c
                rows = np.r_[rows[:upto][rest], rows[upto:]]
                lo, n = np.r_[(s + c)[rest], lo[upto:]], np.r_[(n[:upto] - c)[rest], n[upto:]]

        plain, crowd = np.flatnonzero(~dense), np.flatnonzero(dense)
        once = np.flatnonzero(~dense & (cell == 0))
        for flip in [-1, *range(half)]:
            # Equal halves on both sides are probed in the first half only; a flip is probed from its lower side.
            rows = once[is_second[once] == 0] if flip < 0 else once[(key[once] >> flip) & 1 == 0]
            probe = key[rows] + (0 if flip < 0 else 1 << flip)
            to = key[once]
            lo = np.searchsorted(once, rows) + 1 if flip < 0 else np.searchsorted(to, probe, "left")
            yield from meet(rows, lo, np.searchsorted(to, probe, "right"), once)
            if len(crowd):
                rows = plain[is_second[plain] == 0] if flip < 0 else plain
                probe = key[rows] ^ (0 if flip < 0 else 1 << flip)
                to = key[crowd]
                yield from meet(rows, np.searchsorted(to, probe, "left"), np.searchsorted(to, probe, "right"), crowd)

    return run


def _crowded(entries: DataFrame, classes: DataFrame, half: int, places: int) -> tuple[DataFrame, DataFrame] | None:
    """(entry, cells) of crowded index entries, and the (class) of dense rows; None if there are none.

    Crowded entries are few, as each has many times its share of the rows of its space: under 2^half / ``CROWD``
    for each place of a half.
    """
    sizes = F.broadcast(classes.groupBy(F.col("space").cast("bigint").alias("s")).agg(F.count("*").alias("all")))
    n = entries.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD_ROWS).withColumn("s", F.shiftright("entry", 32))
    hot = n.join(sizes, "s").filter(F.col("n") > F.col("all") * min(CROWD / 2**half, 0.25))
    hot = checkpointed(hot.select("entry", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("cells")))
    if hot.isEmpty():
        return None
    times = entries.join(F.broadcast(hot), "entry").groupBy("class").agg(F.count("*").alias("n"))
    return hot, checkpointed(times.filter(F.col("n") >= CROWDED * places).select("class"))


def _substrings(code: np.ndarray, sub: int, n_sub: int) -> np.ndarray:
    out = np.zeros((len(code), n_sub), dtype="u4")
    for i in range(sub):
        out |= code[:, i::sub].astype("u4") << np.uint32(i)
    return out


def nearest(
    df: DataFrame, id: str = "id", name: str = "embedder_name", dim: str = "embedder_dim",
    vector: str = "embedding", k: int = K, min_similarity: float = MIN_SIMILARITY, recall: float = RECALL, whole: bool = False,
) -> DataFrame:
    """Rows (id, other, similarity): of each id, up to ``k`` nearest ids of cosine ``min_similarity`` or more.

    With ``whole``, ids with fewer than ``k`` such neighbours get their ``k`` nearest of any similarity, ranked
    exactly, or all others of their space if these are fewer.

    Ids meet only within an equal name and dimension. Rows whose vector isn't usable are left out, so are
    null ids; of an id delivered several times, the least vector counts. Equal similarities rank by
    id. Without ``whole``, neighbours below ``min_similarity`` aren't listed. Other columns are dropped.
    """
    src = df.select(F.col(id).alias("id"), F.col(name).alias("name"), F.col(dim).alias("dim"), F.col(vector).cast("array<double>").alias("vector"))
    src = src.filter(F.col("id").isNotNull() & usable(F.col("vector"), F.col("dim")))
    total = df.count()
    sub, n_sub = index_shape(total, min_similarity, recall)
    bits = sub * n_sub
    sample = src.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / max(1, total)) * (1 << 30)))
    sample = sample.limit(2 * FIT_ROWS).toPandas()
    codes = learn_codes(sample, bits)
    kind = src.schema["id"].dataType.simpleString()
    coded = src.mapInArrow(encode(codes, bits, sub), f"id {kind}, space int, class binary, code binary, unit binary")
    # One vector an id; then members and classes, kept apart so that ids never travel with vectors again.
    coded = coded.groupBy("id").agg(F.min(F.struct("class", "space", "code", "unit")).alias("v")).select("id", "v.*")
    coded = checkpointed(coded)
    members = coded.select("id", "class")
    classes = coded.groupBy("class").agg(F.min(F.struct("space", "code")).alias("v")).select("class", "v.*")
    entries = classes.select("space", "class", "code").mapInArrow(index_entries(bits, sub), "entry bigint, class binary, code binary")
    parts = partitions_for(total * n_sub * 2, BUCKET_ROWS, 1)
    # Rows of a crowd (near copies, all alike) are ranked exactly, as the index would give all pairs of them.
    crowd = _crowded(entries, classes, sub // 2, 2 * n_sub)
    entries = entries.withColumn("cell", F.lit(0)).withColumn("dense", F.lit(False))
    if crowd is not None:
        hot, dense = crowd
        entries = entries.drop("cell", "dense").join(F.broadcast(hot), "entry", "left").join(dense.withColumn("is", F.lit(True)), "class", "left")
        one = F.pmod(F.xxhash64("class"), F.col("cells")).cast("int")
        cells = F.when(F.col("cells").isNull(), F.array(F.lit(0))).when(F.col("is"), F.array(one)).otherwise(F.sequence(F.lit(0), F.col("cells") - 1))
        entries = entries.select("entry", F.explode(cells).alias("cell"), F.coalesce("is", F.lit(False)).alias("dense"), "class", "code")
    entries = entries.select("entry", "cell", "dense", "class", "code")
    pairs = entries.repartition(parts, "entry", "cell").mapInArrow(
        bucket_pairs(bits, sub, hamming_bound(bits, min_similarity)), "class_a binary, class_b binary"
    )
    units = coded.groupBy("class").agg(F.min("unit").alias("unit"))
    scored = _rerank(checkpointed(pairs.distinct()), units, min_similarity)
    both = scored.unionByName(scored.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), "similarity"))
    near = Window.partitionBy("class_a").orderBy(F.desc("similarity"), "class_b")
    near = both.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k).drop("n")
    rows = None
    if crowd is not None or whole:
        rows = checkpointed(coded.groupBy("class").agg(F.min(F.struct("space", "unit")).alias("v")).select("class", "v.*"))
    if crowd is not None:
        exact = _exact(dense, rows, k).filter(F.col("similarity") >= min_similarity)
        near = near.join(dense.withColumnRenamed("class", "class_a"), "class_a", "left_anti").unionByName(exact)
    if whole:
        near = checkpointed(near)
        have = near.groupBy(F.col("class_a").alias("class")).agg(F.count("*").alias("found"))
        sizes = members.groupBy("class").agg((F.count("*") - 1).alias("copies"))
        few = checkpointed(sizes.join(have, "class", "left").filter(F.col("copies") + F.coalesce("found", F.lit(0)) < k).select("class"))
        exact = _exact(few, rows, k)
        near = near.join(few.withColumnRenamed("class", "class_a"), "class_a", "left_anti").unionByName(exact)
    # Members of a class are alike: each lists the first ids of its own class and of the near ones.
    first = Window.partitionBy("class").orderBy("id")
    heads = members.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    several = heads.filter("n = 2").select("class")
    own = several.select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.lit(1.0).alias("similarity"))
    links = near.unionByName(own).join(heads.select(F.col("class").alias("class_b"), F.col("id").alias("other")), "class_b")
    best = Window.partitionBy("class_a").orderBy(F.desc("similarity"), "other")
    links = links.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    out = members.join(links, members["class"] == links["class_a"]).filter("id <> other")
    rank = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return out.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= k).select("id", "other", "similarity")


def _rerank(pairs: DataFrame, units: DataFrame, min_similarity: float) -> DataFrame:
    """Cosine of each candidate pair from its unit vectors."""
    a = pairs.join(units.withColumnsRenamed({"class": "class_a", "unit": "ua"}), "class_a")
    both = a.join(units.withColumnsRenamed({"class": "class_b", "unit": "ub"}), "class_b")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = [
                float(np.dot(np.frombuffer(x, "f4").astype("f8"), np.frombuffer(y, "f4").astype("f8"))) if len(x) == len(y) else -1.0
                for x, y in zip(b.column("ua").to_pylist(), b.column("ub").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column("class_a"), b.column("class_b"), pa.array(sims, pa.float64())], names=["class_a", "class_b", "similarity"])

    s = both.mapInArrow(cosine, "class_a binary, class_b binary, similarity double")
    return s.filter(F.col("similarity") >= min_similarity)


def _blocks(rows: DataFrame, most: int, size: int, per_task: int) -> DataFrame:
    """Rows (space, width, classes, units): vectors of one space in blocks, ``per_task`` blocks a partition."""
    rows = rows.withColumn("width", F.octet_length("unit"))
    # Blocks are numbered through all spaces, so that each partition gets as many as it should.
    spaces = rows.groupBy("space", "width").agg(F.count("*").alias("n"))
    spaces = spaces.withColumn("blocks", F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(most), F.floor(size / F.col("width"))))).cast("int"))
    w = Window.orderBy("space", "width").rowsBetween(Window.unboundedPreceding, -1)
    spaces = checkpointed(spaces.withColumn("start", F.coalesce(F.sum("blocks").over(w), F.lit(0)).cast("int")).drop("n"))
    total = spaces.agg(F.sum("blocks")).first()[0] or 1
    placed = rows.join(F.broadcast(spaces), ["space", "width"])
    placed = placed.withColumn("b", F.col("start") + F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        one = t.slice(0, 1)
        joined = [pa.array([b"".join(t.column(c).to_pylist())], pa.binary()) for c in ("class", "unit")]
        return pa.table([one.column("space"), one.column("width"), one.column("b"), *joined], names=["space", "width", "b", "classes", "units"])

    packed = placed.groupBy("space", "width", "b").applyInArrow(pack, "space int, width int, b int, classes binary, units binary")
    return checkpointed(packed.repartitionById(partitions_for(total, per_task), F.floor(F.col("b") / per_task).cast("int")).drop("b"))


def _exact(few: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Rows (class_a, class_b, similarity): of each class of ``few``, the ``k`` most similar others among ``rows``.

    Every pair of a block of queries and a block of rows is one task's product; blocks are read
    where they are and aren't shuffled. What a task gives is at most k rows a query and ``TASK_BLOCKS`` blocks.
    """
    queries = _blocks(rows.join(few, "class"), QUERY_BLOCK, QUERY_BYTES, 1).withColumnsRenamed({"classes": "ca", "units": "ua"})
    others = _blocks(rows, ROW_BLOCK, ROW_BYTES, TASK_BLOCKS).withColumnsRenamed({"classes": "cb", "units": "ub"})
    paired = queries.join(others.hint("shuffle_replicate_nl"), ["space", "width"]).select("width", "ca", "ua", "cb", "ub")
    parts = paired.mapInArrow(best_of_blocks(k), "class_a binary, class_b binary, similarity double")
    best = Window.partitionBy("class_a").orderBy(F.desc("similarity"), "class_b")
    return parts.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def best_of_blocks(k: int):
    """Function of one task's pairs of blocks giving the ``k`` best rows of each query, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for b in batches:
            for width, ca, ua, cb, ub in zip(*(b.column(c) for c in ("width", "ca", "ua", "cb", "ub"))):
                name = ca.as_buffer().to_pybytes()
                if name != now:
                    if best is not None:
                        yield best.out()
                    now, best = name, _Best(name, _matrix(ua, width.as_py()), k)
                best.add(np.frombuffer(cb.as_buffer(), dtype=f"V{CLASS_BYTES}"), _matrix(ub, width.as_py()))
        if best is not None:
            yield best.out()

    return run


def _matrix(units: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(units.as_buffer(), dtype="f4").reshape(-1, width // 4)


class _Best:
    """The best rows so far of each query of a block; float32 products choose, float64 ones decide."""

    def __init__(self, names: bytes, x: np.ndarray, k: int):
        self.names, self.x, self.k = np.frombuffer(names, dtype=f"V{CLASS_BYTES}"), x, k
        self.at, self.cls, self.sim = np.empty(0, "i8"), np.empty(0, f"V{CLASS_BYTES}"), np.empty(0)
        self.least = np.full(len(x), -np.inf, dtype="f4")

    def add(self, names: np.ndarray, y: np.ndarray) -> None:
        s = self.x @ y.T
        least = self.least
        # A query itself is among the rows, so one more than k is asked for.
        if len(y) > self.k + 1 and np.isinf(least).any():
            least = np.maximum(least, np.partition(s, len(y) - self.k - 1, axis=1)[:, len(y) - self.k - 1])
        i, j = np.divmod(np.flatnonzero(s >= (least - np.float32(ROUNDING))[:, None]), len(y))
        other = self.names[i] != names[j]
        i, j = i[other], j[other]
        sim = np.concatenate([np.einsum("ij,ij->i", self.x[i[n : n + PAIR_BLOCK]].astype("f8"), y[j[n : n + PAIR_BLOCK]].astype("f8")) for n in range(0, len(i), PAIR_BLOCK)] or [np.empty(0)])
        at, cls, sim = np.r_[self.at, i], np.concatenate([self.cls, names[j]]), np.r_[self.sim, sim]
        # Equal similarities rank by class.
        order = np.lexsort((*cls.view(">u4").reshape(-1, CLASS_BYTES // 4).T[::-1], -sim, at))
        at, cls, sim = at[order], cls[order], sim[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
        self.at, self.cls, self.sim = at[rank < self.k], cls[rank < self.k], sim[rank < self.k]
        last = rank == self.k - 1
        self.least[at[last]] = sim[last]

    def out(self) -> pa.RecordBatch:
        a, b = ([x.tobytes() for x in c] for c in (self.names[self.at], self.cls))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(self.sim, pa.float64())], names=["class_a", "class_b", "similarity"])
