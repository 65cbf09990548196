"""Documents and directories as records: walk, read, chunk, screen, identify."""

from __future__ import annotations

import fnmatch
import os
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schema as S
from quern.functions import text as X
from quern.functions.chunking import chunk_file
from quern.session import spread

# What a walk reads, and what it leaves out.
INCLUDE = (".py", ".md", ".markdown", ".txt", ".rst", ".toml", ".yml", ".yaml", ".json", ".cfg", ".ini", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java")
SKIP_DIRS = (".git", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build", "site-packages", ".pytest_cache", ".mypy_cache", ".ruff_cache")
SKIP_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "bun.lockb", "gemfile.lock", "composer.lock")
SECRET_FILES = ("credentials.json", "id_rsa", "id_ed25519", "*.pem", "*.key", ".env", "service-account*.json", "token.pickle")
FILES_PER_TASK = 256

def too_large(name: str | None, text: str, pieces: list[str] | None = None) -> str | None:
    """Why a document is refused; None if it isn't."""
    if len(text) > S.TEXT_BYTES or len(text) * 4 > S.TEXT_BYTES and len(text.encode(errors="replace")) > S.TEXT_BYTES:
        return f"more than {S.TEXT_BYTES} bytes"
    # A chunk and what parts it from the next have two characters at least.
    if len(text) < 2 * S.MAX_CHUNKS:
        return None
    n = len(chunk_file(name, text) if pieces is None else pieces)
    return f"more than {S.MAX_CHUNKS} chunks" if n > S.MAX_CHUNKS else None


def rejected(docs: DataFrame) -> DataFrame:
    """(name, scope_key, reason) of the documents that :func:`ingest` leaves out for their size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            why = [too_large(n, t) for n, t in zip(b["name"], b["text"])]
            yield pd.DataFrame({"name": b["name"], "scope_key": b["scope_key"], "reason": pd.Series(why, dtype="object")})

    large = docs.select("name", "text", "scope_key").filter(F.length("text") >= min(2 * S.MAX_CHUNKS, S.TEXT_BYTES // 4))
    return large.mapInPandas(run, "name string, scope_key string, reason string").filter("reason IS NOT NULL")


CHUNK = "name string, scope_key string, chunk_index int, content string, action string, trust int, redactions array<string>, n_markers int, is_split boolean"


def ingest(docs: DataFrame, trust: int, kind: str = "raw_fact", scheme: str = "text://", split: str | None = None) -> DataFrame:
    """Records of documents (name, text, scope_key): chunked, screened, addressed by content.

    Chunking and both screenings happen in one pass over each document. A marker that is split
    over chunks quarantines all of them, if the source isn't trusted. Chunks that screening
    leaves empty are dropped, but keep their number. Null and empty texts give nothing. Equal chunks of a
    source collapse to one record. A text beyond the fixed byte or chunk limit is left out; :func:`rejected`
    names it. How much was redacted, and how many markers were found, is kept in ``metadata``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, text, scope in zip(b["name"], b["text"], b["scope_key"]):
                if not text:
                    continue
                if len(text) > S.TEXT_BYTES:
                    continue
                pieces = chunk_file(name, text)
                if too_large(name, text, pieces):
                    continue
                cut = X.split_markers(pieces) if trust <= S.Trust.UNVERIFIED else {}
                for i, p in enumerate(pieces):
                    s = X.screen(p, trust)
                    if X.normalize_content(s.content):
                        rows.append((name, scope, i, s.content, s.action, s.trust, s.redactions, len(s.markers), i in cut))
            yield pd.DataFrame(rows, columns=["name", "scope_key", "chunk_index", "content", "action", "trust", "redactions", "n_markers", "is_split"])

    c = spread(docs.select("name", "text", "scope_key")).mapInPandas(run, CHUNK)
    bad = (F.col("action") == "QUARANTINE") | F.col("is_split")
    uri = F.concat(F.lit(scheme), "name")
    number = lambda n: F.struct(F.lit("int").alias("vtype"), n.cast("string").alias("value"))
    counts = F.create_map(F.lit("redactions"), number(F.size("redactions")), F.lit("injection_flags"), number(F.col("n_markers")))
    noted = F.when((F.size("redactions") > 0) | (F.col("n_markers") > 0), counts)
    out = c.select(
        "scope_key", F.lit(kind).alias("kind"), "content", X.hash_column(F.col("content")).alias("content_hash"), uri.alias("prov_source_uri"),
        F.col("name").alias("prov_source_file"), F.col("chunk_index").alias("prov_chunk_index"),
        F.when(bad, F.lit(0)).otherwise(F.col("trust")).alias("trust_tier"),
        F.when(bad, F.lit("quarantined")).otherwise(F.lit("active")).alias("status"), noted.alias("metadata"),
    )
    out = out.withColumn("id", X.id_column(F.col("scope_key"), F.col("prov_source_uri"), F.col("kind"), F.col("content_hash")))
    # The first chunk of equal ones stays; sizes are reduced map-side.
    keys = [c for c in out.columns if c != "id"]
    return out.groupBy("id").agg(F.min_by(F.struct(*keys), "prov_chunk_index").alias("r")).select("id", "r.*")


def walk(root: str, include: tuple[str, ...] = INCLUDE, skip_dirs: tuple[str, ...] = SKIP_DIRS, skip_files: tuple[str, ...] = SKIP_FILES, skip_secrets: bool = True, follow_symlinks: bool = False) -> tuple[list[str], dict[str, int]]:
    """Relative paths of the files to read, and what was left out.

    Environments, packaging folders, links that leave the root and cycles are pruned.
    """
    real, seen, out = os.path.realpath(root), set(), []
    n = {"filtered": 0, "secrets_skipped": 0}
    secret = lambda name: any(fnmatch.fnmatchcase(name.lower(), g) for g in SECRET_FILES)
    if os.path.isfile(root):
        # Naming a file is a wish to read it, whatever it's called.
        if secret(os.path.basename(root)):
            warnings.warn(f"{root} is named like a file of secrets", stacklevel=2)
        return [os.path.basename(root)], n
    for at, dirs, names in os.walk(root, followlinks=follow_symlinks):
        here = os.path.realpath(at)
        if here in seen or os.path.commonpath([here, real]) != real:
            dirs[:] = []
            continue
        seen.add(here)
        dirs[:] = sorted(x for x in dirs if x not in skip_dirs and not x.endswith(".egg-info") and not os.path.exists(os.path.join(at, x, "pyvenv.cfg")))
        for name in sorted(names):
            low, path = name.lower(), os.path.join(at, name)
            if skip_secrets and secret(name):
                n["secrets_skipped"] += 1
            elif any(fnmatch.fnmatchcase(low, g) for g in skip_files):
                n["filtered"] += 1
            elif (low.endswith(include) or not skip_secrets and secret(name)) and os.path.commonpath([os.path.realpath(path), real]) == real:
                out.append(os.path.relpath(path, root))
    if n["secrets_skipped"]:
        warnings.warn(f"{n['secrets_skipped']} files named like files of secrets were skipped", stacklevel=2)
    return out, n


def read_files(spark: SparkSession, root: str, names: list[str], scope_key: str) -> DataFrame:
    """(name, text, scope_key) of files, read on the executors; too large or undecodable ones have null text."""
    base = root if os.path.isdir(root) else os.path.dirname(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for name in b["name"]:
                try:
                    with open(os.path.join(base, name), "rb") as f:
                        raw = f.read(S.TEXT_BYTES + 1)
                    texts.append(raw.decode() if len(raw) <= S.TEXT_BYTES else None)
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield pd.DataFrame({"name": b["name"], "text": texts, "scope_key": scope_key})

    n = max(1, -(-len(names) // FILES_PER_TASK))
    paths = spark.createDataFrame([(x,) for x in names], "name string").repartition(n)
    return paths.mapInPandas(run, "name string, text string, scope_key string")
