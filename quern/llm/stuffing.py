"""Keyword-stuffed and link-list pages.

Corpus counts of words and of neighbouring words give each page the mean pointwise mutual
information of its neighbouring words, its own occurrences left out and normalised to -1..1. How
high that is depends on the words as well, so the same mean over the page's own words in a
random order is its background: what remains, the page's lift, is what the order of its words
says. Sentences join words that belong together, in any language; in word salad, and in lists of
keywords, neighbours are as good as random. A page is stuffed if its lift is far below that of
the corpus's typical page, or below it while the page repeats the same few collocations or links.
There is no list of words, and all measures stay the same if every count doubles.

Pages are taken in blocks where they lie, and read once: a block gives the counts of its distinct
neighbour pairs, and its pages as word numbers, which the second step needs. Texts aren't
shuffled; what is grows with distinct pairs a block, not with words.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed, spread

# A block holds at most so many pages, and about so many characters of text.
BLOCK_DOCS, BLOCK_BYTES = 4_000, 16_000_000

BACKGROUND = 32  # pairs of a page's words, drawn by hash, whose mean information is its background
LEAST_WORDS = 8  # shorter pages are judged by their links only
LEAST_SEEN = 20  # occurrences on other pages from which a word's neighbours are known
LEAST_KNOWN = 0.5  # share of neighbour pairs of such words below which a page's order isn't judged
FAR_BELOW, BELOW = 2 / 3, 0.8  # of the typical page's lift
REPEATED, ALL_REPEATED = 0.7, 0.9  # share of a page in pairs that it has three times or more
LINKED, LINKS_ONLY = 0.15, 0.5  # share of links, addresses and tags in the page's strings

WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d\w*|[^\W\d_]\w*")
NOISE = re.compile(r"https?://\S+|www\.\S+|\[/?url[^\]]*\]|<[^<>]{0,500}>")
LINK = re.compile(r"\S*(?:https?://|www\.|\[/?url|href=|\]\()\S*|(?<!\S)#+\w\S*|(?<!\S)[\w.-]+\.[a-z]{2,10}/\S+")
LINK_HINTS = ("://", "www.", "[url", "href=", "](")
TAG_HINT = re.compile(r"#\w|\.[a-z]{2,10}/")
PAIR, IS_WORD, PAGES = 0, 1, 2


def words_of(text: str) -> list[str]:
    """Lower-case words; whatever has a digit in it is one word, so that ids don't count as words."""
    if "://" in text or "www." in text or "<" in text or "[" in text:
        text = NOISE.sub(" ", text)
    return WORD.findall(text.lower())


def link_share(text: str) -> float:
    """Share of a page's strings that are links, addresses or tags."""
    if not any(h in text for h in LINK_HINTS) and not TAG_HINT.search(text):
        return 0.0
    return len(LINK.findall(text)) / max(1, len(text.split()))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers spread evenly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Block:
    """Words of a block of pages as numbers, with their neighbour pairs and pairs of any two words of a page."""

    def __init__(self, n: np.ndarray, code: np.ndarray, hashes: np.ndarray, links: np.ndarray):
        self.n, self.code, self.hash, self.links = n, code, hashes, links
        self.page = np.repeat(np.arange(len(n)), n)
        first = np.flatnonzero(self.page[1:] == self.page[:-1])
        # Places of the background's pairs follow from a page's words alone.
        start = np.cumsum(n) - n
        own = np.add.reduceat(np.append(hashes[code], np.uint64(0)), start) if len(n) else np.zeros(0, "u8")
        several = np.flatnonzero(n >= 2)
        draw = lambda salt: _mixed(own[several, None] + _mixed(np.arange(salt, salt + BACKGROUND, dtype="u8"))[None, :])
        size = n[several, None].astype("u8")
        one = draw(1) % size
        two = (one + 1 + draw(1 + BACKGROUND) % (size - np.uint64(1))) % size
        at = start[several, None].astype("u8")
        places = [(first, first + 1), ((at + one).ravel().astype("i8"), (at + two).ravel().astype("i8"))]
        self.places = [np.concatenate(x) for x in zip(*places)]
        self.n_real = len(first)
        a, b = (hashes[code[x]] for x in self.places)
        self.pair = (_mixed(a) ^ (b + np.uint64(0x7F4A7C15))).astype("i8")

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        lists = [words_of(t) if t else [] for t in texts]
        flat = np.array([w for x in lists for w in x], dtype=object)
        code, vocabulary = pd.factorize(flat) if len(flat) else (np.zeros(0, "i8"), np.zeros(0, object))
        plain = np.array(["0" if any(c.isdigit() for c in w) else w for w in vocabulary], dtype=object)
        hashes = pd.util.hash_array(plain, categorize=False) if len(plain) else np.zeros(0, "u8")
        # Words with digits share a hash, so each hash gets one number.
        hashes, again = np.unique(hashes, return_inverse=True)
        links = np.array([link_share(t) if t else 0.0 for t in texts], dtype="f8")
        return cls(np.array([len(x) for x in lists], dtype="i8"), again[code].astype("i4") if len(code) else np.zeros(0, "i4"), hashes, links)

    def packed(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, n=self.n, code=self.code, hash=self.hash, links=self.links)
        return zlib.compress(f.getvalue(), 1)

    @classmethod
    def unpacked(cls, raw: bytes) -> Block:
        z = np.load(io.BytesIO(zlib.decompress(raw)))
        return cls(z["n"], z["code"], z["hash"], z["links"])

    def counts(self) -> pd.DataFrame:
        """Numbers of distinct pairs and words (by hash); pairs of the background only have 0."""
        ids, keys = pd.factorize(self.pair)
        n = np.bincount(ids[: self.n_real], minlength=len(keys))
        w = np.bincount(self.code, minlength=len(self.hash))
        return pd.DataFrame({
            "what": np.r_[np.full(len(keys), PAIR), np.full(len(w), IS_WORD)].astype("i1"),
            "key": np.r_[keys, self.hash.astype("i8")], "n": np.r_[n, w],
        })

    def features(self, pairs: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], total: float) -> pd.DataFrame:
        """Per page, from the corpus numbers of (sorted) keys: words, known share, information, lift, repeated share."""
        pages, m = len(self.n), self.n_real
        if not len(self.pair):
            none = np.zeros(pages)
            return pd.DataFrame({"n_words": self.n, "known_share": none, "mean_npmi": none, "lift": none, "repeated_share": none, "link_share": self.links})
        word = words[1][np.searchsorted(words[0], self.hash.astype("i8"))].astype("f8")
        # Whether a word comes often enough on other pages.
        own, _ = pd.factorize(self.page * len(self.hash) + self.code)
        known = word[self.code] - np.bincount(own)[own] >= LEAST_SEEN
        ids, keys = pd.factorize(self.pair)
        a, b = self.places
        page = self.page[a]
        here, _ = pd.factorize(page * len(keys) + ids)
        here = np.bincount(here[:m], minlength=here.max() + 1)[here]
        n = np.maximum(pairs[1][np.searchsorted(pairs[0], keys)][ids] - here, 0).astype("f8")
        with np.errstate(divide="ignore", invalid="ignore"):
            info = np.log(n * total / (word[self.code[a]] * word[self.code[b]])) / -np.log(n / total)
        info = np.where(n > 0, np.clip(info, -1, 1), -1.0)
        told = known[a] & known[b]

        def mean(x: np.ndarray, part: slice, by: np.ndarray | None = None) -> np.ndarray:
            n = np.bincount(page[part], weights=None if by is None else by[part], minlength=pages)
            return np.bincount(page[part], weights=x[part], minlength=pages) / np.maximum(n, 1)

        real, mock = slice(0, m), slice(m, None)
        info = info * told
        score = mean(info, real, told)
        return pd.DataFrame({
            "n_words": self.n, "known_share": np.minimum(mean(told, real), mean(told, mock)), "mean_npmi": score,
            "lift": score - mean(info, mock, told), "repeated_share": mean(here >= 3, real), "link_share": self.links,
        })


def _filled(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """Keys and texts of one block after the other."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch["k"], batch["t"]):
            if keys and (len(keys) >= BLOCK_DOCS or size >= BLOCK_BYTES):
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(k)
            texts.append(t)
            size += len(t or "")
    if keys:
        yield keys, texts


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per page (key, n_words, known_share, mean_npmi, lift, repeated_share, link_share).

    Null and empty texts have no words and shares of 0. Texts of any length count whole; repeated rows
    count as pages of their own; a null key is kept; other columns are dropped. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    placed = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    placed = spread(placed)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, (keys, texts) in enumerate(_filled(batches)):
            b = Block.of(texts)
            out = b.counts().assign(pages=None, keys=None).astype({"pages": object, "keys": object})
            out.loc[len(out)] = [PAGES, 0, 0, b.packed(), keys]
            # Blocks are written once, so a number that is unique in this run will do.
            out.insert(0, "block", (TaskContext.get().partitionId() << 32) + number)
            yield out

    own = checkpointed(placed.mapInPandas(count, "block bigint, what tinyint, key bigint, n bigint, pages binary, keys array<string>"))
    pages = own.filter(F.col("what") == PAGES).select(F.col("block").alias("b"), "keys", "pages")
    parts = max(1, pages.count())
    counted = own.filter(F.col("what") != PAGES).select("block", "what", "key", "n")
    sums = counted.groupBy("what", "key").agg(F.sum("n").alias("total"))
    total = counted.filter(F.col("what") == IS_WORD).agg(F.sum("n")).first()[0] or 1
    looked_up = counted.drop("n").join(sums, ["what", "key"]).repartition(parts, "block")
    pages = pages.repartition(parts, "b")

    def score(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("key")
        tables = [known[known["what"] == w] for w in (PAIR, IS_WORD)]
        pairs, words = ((t["key"].to_numpy(), t["total"].to_numpy()) for t in tables)
        out = Block.unpacked(own["pages"].iloc[0]).features(pairs, words, float(total))
        out.insert(0, "k", own["keys"].iloc[0])
        return out

    scored = pages.groupBy("b").cogroup(looked_up.groupBy("block")).applyInPandas(
        score, "k string, n_words bigint, known_share double, mean_npmi double, lift double, repeated_share double, link_share double"
    )
    return scored.withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", key)


def stuffed(pages: DataFrame) -> DataFrame:
    """Rows of :func:`features` that are stuffed.

    The typical lift is the median over all pages whose order can be judged. The others are judged
    by their links, and by repetition if they hold hardly anything else.
    """
    pages = checkpointed(pages)
    enough = F.col("n_words") >= LEAST_WORDS
    judged = enough & (F.col("known_share") >= LEAST_KNOWN)
    typical = pages.filter(judged).agg(F.percentile_approx("lift", 0.5, 10_000).alias("typical"))
    low = F.col("lift") < FAR_BELOW * F.col("typical")
    spammy = (F.col("lift") < BELOW * F.col("typical")) & ((F.col("repeated_share") >= REPEATED) | (F.col("link_share") >= LINKED))
    loops = enough & ~judged & (F.col("repeated_share") >= ALL_REPEATED)
    hit = F.coalesce(judged & (low | spammy), F.lit(False)) | loops | (F.col("link_share") >= LINKS_ONLY)
    return pages.crossJoin(F.broadcast(typical)).filter(hit).drop("typical")  # one row
