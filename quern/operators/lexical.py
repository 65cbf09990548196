"""Lexical search: tokens, postings, statistics and BM25, for batches of queries."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import places
from quern.schema import QUERY_CHARS, QUERY_TERMS
from quern.session import checkpointed, partitions_for, small_batches

# Queries and documents are scored in blocks of so many rows.
QUERY_BLOCK, DOC_BLOCK = 2048, 32_768
# Words of so many queries are sent to all tasks at once; more queries take more passes.
PASS_QUERIES = 262_144
# Worths as whole numbers have so many levels. Terms of one in so many documents of a block have a row of all its documents, up to so many numbers in all (24 MB).
LEVELS, ROW_SHARE, ROW_NUMBERS = 100, 32, 12_000_000
# Scores within so little of a bound are worked out in full.
MARGIN = 1e-8
# Words that the overlap measure and hard-negative mining leave out.
STOPWORDS = tuple(
    "a about after all an and any are as at be been before being but by can could did do does doing for from had has have how i if in into is it "
    "its of on or our out over should so some that the their them then there these they this to under up was we were what when where which who "
    "why will with would you your".split()
)


@cache
def _plain_letters() -> tuple[str, str]:
    """Letters with marks and their bare letters, of one code point each; and accents, to be dropped.

    Other marks, such as joiners, end a word.
    """
    pairs, marks = [], []
    for cp in range(0xC0, 0x2000):
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if 0x300 <= cp <= 0x331:
            marks.append(ch)
        elif len(d) > 1 and unicodedata.category(d[0])[0] == "L" and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            pairs.append((ch, d[0]))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics; plain ASCII skips the second step."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(low, *_plain_letters())).otherwise(low)


def tokens(text: Column) -> Column:
    """Words: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """A query's distinct terms in order, at most 32 of its first 8,192 characters.

    Words joined by underscores are one term, a phrase: its words with spaces between.
    """
    whole = F.regexp_extract_all(folded(F.substring(text, 1, QUERY_CHARS)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    phrases = F.filter(F.transform(whole, lambda w: F.trim(F.regexp_replace(w, "_+", " "))), lambda w: w != "")
    return F.slice(F.array_distinct(phrases), 1, QUERY_TERMS)


def eval_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of two characters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))


def postings(docs: DataFrame, words=tokens) -> DataFrame:
    """(id, term, tf, len) of documents (id, text).

    Texts stay where they are; what is shuffled is words, counted before. Null and empty texts have none.
    Repeated ids count as one document with all their words.
    """
    d = docs.select("id", words(F.col("text")).alias("w"))
    # The outer form, as the plain one makes the optimizer count words before they are spread.
    d = d.select("id", F.size("w").alias("len"), F.explode_outer("w").alias("term")).filter("term IS NOT NULL")
    return d.groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def term_stats(post: DataFrame) -> DataFrame:
    """Documents per term."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def fts_idf(n: Column, df: Column) -> Column:
    """Inverse document frequency floored just above zero."""
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def okapi_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(
    queries: DataFrame, docs: DataFrame, k: int, corpus: DataFrame | None = None, k1: float = 1.2, b: float = 0.75,
    idf=fts_idf, words=tokens, terms=query_terms, repeat_terms: bool = False, exclude: DataFrame | None = None,
) -> DataFrame:
    """(qid, id, score, rank): the ``k`` best documents of each query.

    ``queries`` (qid, text), ``docs`` (id, text). Statistics come from ``corpus`` (default: docs), of which
    docs are a part, so a filter on docs doesn't change scores. Scores are rounded to 9 digits, ties rank by id.
    A term of several words is a phrase, which counts where they follow each other. ``exclude`` (qid, id)
    takes pairs out before ranking. Queries without words and k of 0 or less find nothing.

    The corpus is read once for ``PASS_QUERIES`` queries. Each text becomes, where it lies, the numbers of the
    asked terms in it; only these are shuffled, and written as blocks of documents by term. A block of queries then
    meets all blocks of documents in one task, or in few, and gives its best ``k`` once, however many
    documents there are. Documents that can't reach a query's k-th best score so far aren't scored.
    """
    none = queries.sparkSession.createDataFrame([], "qid string, id string, score double, rank int")
    if k <= 0:
        return none
    q = queries.select(F.col("qid").cast("string").alias("qid"), F.explode_outer(terms(F.col("text"))).alias("term")).filter("term IS NOT NULL")
    q = checkpointed(q.groupBy("qid", "term").agg(F.count("*").alias("qtf")))
    most = k
    if exclude is not None:
        # As many more are kept as a query may lose.
        lost = exclude.groupBy("qid").count().agg(F.max("count")).first()[0]
        most = k + (lost or 0)
    n_queries = q.select("qid").distinct().count()
    passes = partitions_for(n_queries, PASS_QUERIES)
    scored = []
    for i in range(passes if n_queries else 0):
        part = q.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i)
        scored.append(_scored(part, partitions_for(n_queries, passes), docs, corpus, most, k1, b, idf, words, repeat_terms))
    if not scored:
        return none
    found = reduce(DataFrame.unionByName, scored)
    if exclude is not None:
        found = found.join(exclude.select("qid", "id").distinct(), ["qid", "id"], "left_anti")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _vocabulary(asked: list[str]) -> tuple[dict[str, int], np.ndarray, list[tuple]]:
    """Numbers of all words; of each word, the number of its term, or -1; and per further word of phrases, sorted keys
    (number of the beginning, number of the word) with the numbers of what they begin and of their terms.
    """
    codes: dict[str, int] = {}
    single: dict[int, int] = {}
    levels: list[dict[tuple, list]] = []
    for t, term in enumerate(asked):
        parts = [codes.setdefault(w, len(codes)) for w in term.split(" ")]
        at = parts[0]
        if len(parts) == 1:
            single[at] = t
        for n, w in enumerate(parts[1:]):
            levels += [{}] if n == len(levels) else []
            entry = levels[n].setdefault((at, w), [len(levels[n]), -1])
            at = entry[0]
            if n == len(parts) - 2:
                entry[1] = t
    terms = np.full(len(codes) + 1, -1)  # the last is for words that nobody asks for
    terms[list(single)] = list(single.values())
    flat = []
    for level in levels:
        rows = sorted((a * len(codes) + w, *entry) for (a, w), entry in level.items())
        flat.append(tuple(np.array(x) for x in zip(*rows)))
    return codes, terms, flat


def _occurrences(texts: pd.Series, codes: dict[str, int], terms: np.ndarray, levels: list[tuple]) -> list[bytes]:
    """Of each text, given as words, the numbers of the asked terms in it, as often as they come."""
    sizes = texts.map(len).to_numpy()
    flat = np.fromiter((codes.get(w, -1) for w in chain.from_iterable(texts)), "i8", int(sizes.sum()))
    at = np.repeat(np.arange(len(texts)), sizes)
    found, where = [terms[flat]], [at]
    begun = flat
    for n, (keys, begins, ends) in enumerate(levels, 1):
        m = max(0, len(flat) - n)
        begun, last = begun[:m], flat[n:]
        key = np.where((begun >= 0) & (last >= 0) & (at[:m] == at[n:]), begun * len(codes) + last, -1)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[place] == key
        begun = np.where(hit, begins[place], -1)
        found.append(np.where(hit, ends[place], -1))
        where.append(at[:m])
    t, at = np.concatenate(found), np.concatenate(where)
    t, at = t[t >= 0], at[t >= 0]
    t = t[np.argsort(at, kind="stable")].astype("i4")
    ends = np.cumsum(np.bincount(at, minlength=len(texts))) * 4
    raw = t.tobytes()
    return [raw[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]


BLOCK = "n long, words long, ids array<string>, lens binary, counted array<int>, dfs array<int>, terms array<int>, sizes array<int>, docs binary, tf binary"


def _block(df: pd.DataFrame) -> pd.DataFrame:
    """One block of documents: rows of an id together are one document."""
    ids = df["id"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    n = len(starts)
    row = np.repeat(np.arange(n), np.diff([*starts, len(ids)]))
    shown = np.maximum.reduceat(df["shown"].to_numpy(), starts) > 0
    flat = np.frombuffer(b"".join(df["terms"]), "i4")
    # Keys of four bytes where they do, as this is most of what a worker holds.
    key = flat.astype(_whole((int(flat.max(initial=0)) + 1) * n + 1, "u4"))
    key *= key.dtype.type(n)
    key += np.repeat(row, df["terms"].map(len).to_numpy() // 4).astype(key.dtype)
    key.sort()
    begins = np.flatnonzero(np.concatenate([[len(key) > 0], key[1:] != key[:-1]]))[: len(key)]
    key, tf = key[begins].astype("i8"), np.diff(begins, append=len(key))
    term, doc = np.divmod(key, n)
    counted, dfs = np.unique(term, return_counts=True)
    term, doc, tf = term[shown[doc]], doc[shown[doc]], tf[shown[doc]]
    terms, sizes = np.unique(term, return_counts=True)
    lens = df["len"].to_numpy()
    return pd.DataFrame({
        "n": [int(df["rows"].sum())], "words": [int((lens * df["rows"].to_numpy()).sum())], "ids": [ids[starts]], "lens": [np.maximum.reduceat(lens, starts).astype("i4").tobytes()],
        "counted": [counted.astype("i4")], "dfs": [dfs.astype("i4")], "terms": [terms.astype("i4")], "sizes": [sizes.astype("i4")],
        "docs": [doc.astype(_whole(n)).tobytes()], "tf": [tf.astype(_whole(int(tf.max(initial=0)) + 1)).tobytes()],
    })


def _whole(n: int, least: str = "u1") -> str:
    """The type of whole numbers below ``n``, ``least`` or larger."""
    return next(t for t, most in (("u1", 256), ("u2", 65_536), ("u4", 2**32), ("u8", 2**64)) if n <= most and t >= least)


def _numbers(raw: pa.Buffer, n: int) -> np.ndarray:
    """``n`` whole numbers, of the type that their bytes show."""
    return np.frombuffer(raw, f"u{max(1, len(raw) // max(1, n))}")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of about ``DOC_BLOCK`` rows in order of their ids, which no two blocks share."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= DOC_BLOCK:
            df = pd.concat(held, ignore_index=True)
            last = (df["id"] == df["id"].iloc[-1]).to_numpy()
            if not last.all():
                yield _block(df[~last])
            held = [df[last]]
    if sum(map(len, held)):
        yield _block(pd.concat(held, ignore_index=True))


def _packed_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for b, g in batch.groupby("b"):
            qs = g["qs"].iloc[0]
            qids, which = np.unique(np.array([x["qid"] for x in qs], dtype=object), return_inverse=True)
            order = np.argsort(which, kind="stable")
            t, w = np.array([x["t"] for x in qs], dtype="i4")[order], np.array([x["w"] for x in qs], dtype="f8")[order]
            yield pd.DataFrame({"b": [b], "qids": [qids], "asked": [np.bincount(which).astype("i4")], "qt": [t.tobytes()], "qw": [w.tobytes()]})


class _Found:
    """The best ``k`` documents of one query so far, and the k-th score once there are so many."""

    def __init__(self, k: int):
        self.k, self.least = k, 0.0
        self.scores, self.ids = np.zeros(0), np.zeros(0, dtype=object)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(s) > self.k:
            least = -np.partition(-s, self.k - 1)[self.k - 1]
            above, tied = np.flatnonzero(s > least), np.flatnonzero(s == least)
            room = self.k - len(above)
            if len(tied) > room:
                tied = np.array(sorted(tied.tolist(), key=i.__getitem__)[:room], dtype="i8")
            kept = np.concatenate([above, tied])
            s, i = s[kept], i[kept]
        self.scores, self.ids = s, i
        if len(s) == self.k:
            self.least = float(s.min())


def _scored(q: DataFrame, n_queries: int, docs: DataFrame, corpus: DataFrame | None, k: int, k1: float, b: float, idf, words, repeat_terms: bool) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    asked = sorted(r.term for r in q.select("term").distinct().collect())
    shared = sc.broadcast(_vocabulary(asked))
    every = docs if corpus is None else corpus
    d = every.select(F.col("id").cast("string").alias("id"), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))

    shown = int(corpus is None)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "len": batch["w"].map(len), "terms": _occurrences(batch["w"], *shared.value), "rows": 1, "shown": shown})

    form = "id string, len int, terms binary, rows int, shown int"
    d = d.mapInPandas(number, form)
    if corpus is not None:
        # Ids of the documents that may be found come as rows without words.
        d = d.unionByName(docs.select(F.col("id").cast("string").alias("id"), F.lit(0).alias("len"), F.lit(b"").alias("terms"), F.lit(0).alias("rows"), F.lit(1).alias("shown")))
    cores = sc.defaultParallelism
    parts = partitions_for(every.count(), DOC_BLOCK, cores)
    d = checkpointed(d.repartition(parts, "id").sortWithinPartitions("id").mapInPandas(_blocks, BLOCK).withColumn("block", F.monotonically_increasing_id()))
    stats = d.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n, mean = stats.n or 0, (stats.words or 0) / max(1, stats.n or 0)
    df = d.select(F.explode(F.arrays_zip("counted", "dfs")).alias("x")).groupBy(F.col("x.counted").alias("t")).agg(F.sum("x.dfs").alias("df"))
    table = spark.createDataFrame(list(zip(asked, range(len(asked)))), "term string, t int")
    weight = idf(F.lit(n), F.col("df")) * (F.col("qtf") if repeat_terms else F.lit(1))
    # Tasks enough for all cores, whatever the number of queries.
    nq = partitions_for(n_queries, max(1, min(QUERY_BLOCK, -(-n_queries // (2 * cores)))))
    qs = q.join(F.broadcast(table), "term").join(df, "t").select(F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("b"), F.struct("qid", "t", weight.cast("double").alias("w")).alias("x"))
    qs = qs.groupBy("b").agg(F.collect_list("x").alias("qs")).mapInPandas(_packed_queries, "b int, qids array<string>, asked array<int>, qt binary, qw binary")
    qs = checkpointed(qs).repartitionByRange(nq, "b")

    # Blocks are read where Arrow has them, and one at a time, so a worker holds few of them.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        at, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i] for name in batch.schema.names}
                if r["block"].as_py() != at:
                    at, block = r["block"].as_py(), None
                    block = _Postings(r, k1, b, mean)
                if (of := r["b"].as_py()) not in known:
                    ends = np.cumsum(r["asked"].as_py())[:-1]
                    terms, weights = (np.split(np.frombuffer(r[c].as_buffer(), kind), ends) for c, kind in (("qt", "i4"), ("qw", "f8")))
                    known[of] = [(x, t.tolist(), w.tolist(), _Found(k)) for x, t, w in zip(r["qids"].as_py(), terms, weights)]
                for _, t, w, found in known[of]:
                    block.search(t, w, found)
                del r
            del batch
        block = None
        for found in known.values():
            hits = [(x, f) for x, _, _, f in found if len(f.scores)]
            for i in range(0, len(hits), 256):
                part = hits[i : i + 256]
                yield pa.RecordBatch.from_pydict({
                    "qid": pa.array([x for x, f in part for _ in f.ids], pa.string()), "id": pa.array(np.concatenate([f.ids for _, f in part]), pa.string()),
                    "score": pa.array(np.concatenate([f.scores for _, f in part])),
                })

    # The hint keeps a small side from being sent to all tasks, which would leave one task for all queries.
    pairs = d.coalesce(partitions_for(2 * cores, nq)).crossJoin(qs.hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, "qid string, id string, score double")


class _Postings:
    """A block of documents by term and by document, with what each occurrence is worth.

    Worths are also kept as whole numbers, rounded up; terms of many documents have a row of these for all documents.
    """

    def __init__(self, r: dict[str, pa.Scalar], k1: float, b: float, mean: float):
        self.ids = r["ids"].values.to_numpy(zero_copy_only=False)
        sizes = r["sizes"].values.to_numpy().astype("i8")
        n, m = int(sizes.sum()), len(self.ids)
        docs = _numbers(r["docs"].as_buffer(), n)
        self.docs = docs.astype("i8")
        x = _numbers(r["tf"].as_buffer(), n).astype("f8")
        lens = np.frombuffer(r["lens"].as_buffer(), "i4")
        x *= (k1 + 1) / (x + (k1 * ((1 - b) + b * lens / max(mean, 1e-300)))[self.docs])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        self.unit = float(x.max(initial=0.0)) / LEVELS or 1.0
        self.whole = np.ceil(x / self.unit).astype("u2")
        top = np.maximum.reduceat(self.whole, starts) if n else self.whole
        often = np.argsort(-sizes, kind="stable")[: ROW_NUMBERS // max(1, m)]
        often = often[sizes[often] * ROW_SHARE >= m]
        self.rows = np.zeros((len(often), m), "u2")
        rows = np.full(len(sizes), -1)
        for row, t in enumerate(often.tolist()):
            rows[t] = row
            self.rows[row, self.docs[starts[t] : ends[t]]] = self.whole[starts[t] : ends[t]]
        self.terms = dict(zip(r["terms"].as_py(), zip(range(len(sizes)), top.tolist(), starts.tolist(), ends.tolist(), rows.tolist())))
        order = np.argsort(docs, kind="stable")
        self.place, self.x = np.repeat(np.arange(len(sizes), dtype="i4"), sizes)[order], x[order]
        self.sizes = np.bincount(docs, minlength=m)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.sums, self.worth, self.weights = np.zeros(m, "u2"), np.zeros(m, "u2"), np.zeros(len(sizes))

    def score(self, doc: np.ndarray) -> np.ndarray:
        """Scores of documents with asked terms, by the weights set."""
        sizes = self.sizes[doc]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[doc] - first, sizes) + np.arange(int(sizes.sum()))
        return np.round(np.add.reduceat(self.weights[self.place[at]] * self.x[at], first), 9)

    def search(self, terms: list[int], weights: list[float], found: _Found) -> None:
        """Give ``found`` the documents that reach its k-th score. Sums of whole numbers, which no score exceeds, tell which may."""
        here = [(w, *x) for t, w in zip(terms, weights) if (x := self.terms.get(t))]
        good = [x for x in here if x[0] > 0]
        most = sum(w * top for w, _, top, *_ in good)
        if not good or most * self.unit < found.least - MARGIN:
            return
        # Weights in such units that no sum exceeds 16 bits. Terms of no or negative weight add nothing to what is possible.
        unit = most / (65_535 - sum(top for _, _, top, *_ in good))
        sums = self.sums
        sums[:] = 0
        for w, _, _, lo, hi, row in good:
            w = np.uint16(math.ceil(w / unit))
            if row >= 0:
                sums += np.multiply(self.rows[row], w, out=self.worth)
            else:
                sums[self.docs[lo:hi]] += self.whole[lo:hi] * w
        asked = [x[1] for x in here]
        self.weights[asked] = [x[0] for x in here]
        least = found.least
        if not least:
            # The first documents: the score that so many of the likeliest reach.
            doc = np.argpartition(sums, -found.k)[-found.k :] if len(sums) > found.k else np.arange(len(sums))
            doc = doc[sums[doc] > 0]
            least = max(0.0, float(self.score(doc).min())) if len(doc) == found.k else 0.0
        doc = places(sums >= min(65_535, max(1, math.floor((least - MARGIN) / (unit * self.unit)))))
        if len(doc):
            s = self.score(doc)
            reach = (s >= least) & (s > 0)
            if reach.any():
                found.add(s[reach], self.ids[doc[reach]])
        self.weights[asked] = 0


def hard_negatives(queries: DataFrame, docs: DataFrame, gold: DataFrame, k: int = 20) -> DataFrame:
    """The best documents of each query by Okapi BM25 that aren't its gold ones (qid, id)."""
    return bm25(queries, docs, k, k1=1.5, idf=okapi_idf, words=eval_tokens, terms=eval_tokens, repeat_terms=True, exclude=gold)


def overlap(queries: DataFrame, docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, overlap, bucket): largest share of a query's words that one gold document has."""
    q = queries.select("qid", F.array_distinct(eval_tokens(F.col("text"))).alias("qw"))
    d = docs.select("id", F.array_distinct(eval_tokens(F.col("text"))).alias("dw"))
    j = gold.select("qid", "id").distinct().join(q, "qid").join(d, "id")
    share = F.when(F.size("qw") == 0, 0.0).otherwise(F.size(F.array_intersect("qw", "dw")) / F.size("qw"))
    by = j.groupBy("qid").agg(F.round(F.max(share), 9).alias("overlap"))
    bucket = F.when(F.col("overlap") < 0.25, "low").when(F.col("overlap") < 0.5, "med").otherwise("high")
    return by.withColumn("bucket", bucket)
