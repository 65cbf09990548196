"""A store of records as numbered snapshots over Parquet files, by scope and kind.

A snapshot is a manifest: for each (scope, kind) the folders that hold its rows, which is a base and
the deliveries that came since. An upsert writes its own rows only, and a change of rows rewrites only
the scopes and kinds it touches; everything else is shared with the snapshot before. A read merges
deliveries over their base, and ``compact`` turns them into new bases.

A manifest is published by creating the next number's file exclusively. Of several writers that start from
the same snapshot exactly one succeeds; the others see a conflict and may try again from the new one. A
reader that has pinned a number reads one consistent state, whatever is written meanwhile. Paths
may be on any file system that Spark can write to.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schema as S
from quern.operators import records, upsert
from quern.session import checkpointed

MOST_DELIVERIES = 16  # of a scope and kind; then an upsert merges them


class Conflict(RuntimeError):
    """Another writer published this number first."""


class SnapshotStore:
    """Records under one path. Capabilities: vector, lexical, relational."""

    CAPABILITIES = frozenset({"vector", "lexical", "relational"})
    METRIC = "cosine"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def supports(self, capability: str) -> bool:
        return capability in self.CAPABILITIES

    # --- snapshots ---

    def versions(self) -> list[int]:
        """Published numbers, in order."""
        at = self._path(f"{self.path}/manifests")
        if not self._fs.exists(at):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(at))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The latest number; 0 before the first write."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``parts``: folders, base first, by scope and kind; ``last_seq``; ``identities``: embedder by scope."""
        n = self.version() if version is None else version
        if n == 0:
            return {"parts": {}, "last_seq": 0, "identities": {}}
        for _ in range(50):
            stream = self._fs.open(self._path(f"{self.path}/manifests/v{n}.json"))
            try:
                raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
            if raw:
                return json.loads(raw)
            time.sleep(0.1)  # another writer has taken the number and is writing
        raise RuntimeError(f"the manifest of snapshot {n} is empty")

    def read(self, version: int | None = None, scope_key: str | None = None, kind: str | None = None) -> DataFrame:
        """One snapshot (default: the latest), or a scope or kind of it: only its folders are read."""
        return self._read(self.manifest(version), scope_key, kind)

    def _read(self, manifest: dict, scope_key: str | None = None, kind: str | None = None) -> DataFrame:
        merged, single = [], []
        for scope, kinds in manifest["parts"].items():
            for k, folders in kinds.items():
                if (scope_key is None or scope == scope_key) and (kind is None or k == kind):
                    (single if len(folders) == 1 else merged).extend(f for f in folders if f)
        load = lambda x: self.spark.read.schema(S.RECORD).parquet(*(f"{self.path}/{f}" for f in x))
        if not merged:
            return load(single) if single else self.spark.createDataFrame([], S.RECORD)
        rows = load(merged)
        state = upsert.fold(rows).select("seq", F.col("proof_count").alias("__proof"))
        rows = rows.join(state, "seq").withColumn("proof_count", F.col("__proof")).select(*S.RECORD.names)
        return rows.unionByName(load(single)) if single else rows

    def _write(self, df: DataFrame, number: int) -> dict:
        """Rows as new folders: {scope: {kind: folder}}."""
        token = self.spark.sql("SELECT uuid()").first()[0]
        root = f"data/v{number}-{token}"
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.RECORD.fields]
        # Rebalanced at run time: a large scope is split over tasks, small ones share them. Scope and kind stay in the rows as well.
        df = df.select(*cols, F.col("scope_key").alias("p_scope"), F.col("kind").alias("p_kind")).hint("rebalance", "p_scope", "p_kind")
        df.write.partitionBy("p_scope", "p_kind").parquet(f"{self.path}/{root}")
        out: dict = {}
        for s in self._fs.listStatus(self._path(f"{self.path}/{root}")):
            name = s.getPath().getName()
            if name.startswith("p_scope="):
                for k in self._fs.listStatus(s.getPath()):
                    kind = k.getPath().getName()
                    if kind.startswith("p_kind="):
                        out.setdefault(unquote(name[8:]), {})[unquote(kind[7:])] = f"{root}/{name}/{kind}"
        return out

    def _publish(self, manifest: dict, base: int) -> int:
        at = self._path(f"{self.path}/manifests/v{base + 1}.json")
        self._fs.mkdirs(at.getParent())
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            raise Conflict(f"snapshot {base + 1} was published by another writer") from e
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        return base + 1

    def publish(self, df: DataFrame, base: int, scope_key: str | None = None, kinds: list[str] | None = None) -> int:
        """Replace all rows after ``base``, or those of a scope (and some kinds of it); raises Conflict if the next number is taken."""
        m = self.manifest(base)
        gone = [(s, k) for s, ks in m["parts"].items() for k in ks if scope_key is None or (s == scope_key and (kinds is None or k in kinds))]
        for s, k in gone:
            del m["parts"][s][k]
        for s, by in self._write(df, base + 1).items():
            for k, folder in by.items():
                m["parts"].setdefault(s, {})[k] = [folder]
        if scope_key is None:
            m["last_seq"] = df.agg(F.max("seq")).first()[0] or 0
        return self._publish(m, base)

    def _again(self, write: Callable[[int], int], tries: int = 5) -> int:
        for left in range(tries, 0, -1):
            try:
                return write(self.version())
            except Conflict:
                if left == 1:
                    raise
        raise ValueError("tries must be positive")

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 5, scope_key: str | None = None, kinds: list[str] | None = None) -> int:
        """Apply a change to the latest rows, or those of a scope, and publish it, again from the new ones after a conflict."""

        def write(base: int) -> int:
            now = self.read(base, scope_key)
            return self.publish(change(now if kinds is None else now.filter(F.col("kind").isin(kinds))), base, scope_key, kinds)

        return self._again(write, tries)

    def compact(self, least: int = 2) -> int:
        """Merge the deliveries of scopes and kinds that have ``least`` folders or more; the number after it."""

        def write(base: int) -> int:
            m = self.manifest(base)
            return self._merge(m, [(s, k) for s, ks in m["parts"].items() for k, f in ks.items() if len(f) >= least], base)

        return self._again(write)

    def _merge(self, m: dict, parts: list[tuple[str, str]], base: int) -> int:
        if not parts:
            return base
        some: dict = {}
        for s, k in parts:
            some.setdefault(s, {})[k] = m["parts"][s][k]
        for s, by in self._write(self._read(m | {"parts": some}), base + 1).items():
            for k, folder in by.items():
                m["parts"][s][k] = [folder]
        return self._publish(m, base)

    # --- embedder identity ---

    def identity(self, scope_key: str, version: int | None = None) -> tuple | None:
        """(name, dim, config hash) of the embedder whose vectors the scope holds; None before the first."""
        found = self.manifest(version)["identities"].get(scope_key)
        return tuple(found) if found else None

    def set_identity(self, scope_key: str, identity: tuple) -> int:
        def write(base: int) -> int:
            m = self.manifest(base)
            if m["identities"].get(scope_key) == list(identity):
                return base
            m["identities"][scope_key] = list(identity)
            return self._publish(m, base)

        return self._again(write)

    # --- writes ---

    @staticmethod
    def stamped(df: DataFrame) -> DataFrame:
        """Rows with arrival numbers of no particular order, frozen by writing them once."""
        return checkpointed(df.withColumn("seq", F.monotonically_increasing_id()))

    def _append(self, incoming: DataFrame, base: int) -> int:
        """Rows as deliveries, with arrival numbers after the store's, in the order of their own ``seq``."""
        m = self.manifest(base)
        low, high = incoming.agg(F.min("seq"), F.max("seq")).first()
        if low is None:
            return base
        rows = incoming.withColumn("seq", F.col("seq") - F.lit(low) + F.lit(m["last_seq"] + 1))
        m["last_seq"] += high - low + 1
        for s, by in self._write(rows, base + 1).items():
            for k, folder in by.items():
                # A first delivery may hold a content twice, so it has no base before it, and is merged like any other.
                m["parts"].setdefault(s, {}).setdefault(k, [None]).append(folder)
        number = self._publish(m, base)
        full = [(s, k) for s, ks in m["parts"].items() for k, f in ks.items() if len(f) > MOST_DELIVERIES]
        try:
            return self._merge(m, full, number)
        except Conflict:
            return number  # left to a later write

    def upsert(self, incoming: DataFrame) -> int:
        """Merge rows (with unique ``seq``); trust never falls. Only the rows given are written."""
        return self._again(lambda base: self._append(incoming, base))

    def add(self, incoming: DataFrame) -> int:
        """Append rows; the whole batch is refused if any id or (scope, kind, hash) is there twice."""

        def write(base: int) -> int:
            rows = self.read(base).unionByName(incoming, allowMissingColumns=True)
            if not upsert.conflicts(rows).isEmpty():
                raise ValueError("a record with this id or content is already stored")
            return self._append(incoming, base)

        return self._again(write)

    def _change(self, scope_key: str, ids: list[str], which, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Rewrite the kinds of a scope that hold any of the ids; how many of these pass ``which``, in the same snapshot."""
        n = 0

        def write(base: int) -> int:
            nonlocal n
            now = self.read(base, scope_key)
            hit = records.lookup(now, scope_key, ids).filter(which).groupBy("kind").agg(F.count("*").alias("n")).collect()
            n = sum(r.n for r in hit)
            if not n:
                return base
            kinds = [r.kind for r in hit]
            return self.publish(change(now.filter(F.col("kind").isin(kinds))), base, scope_key, kinds)

        self._again(write, tries)
        return n

    def delete(self, scope_key: str, ids: list[str]) -> int:
        """Remove ids of one scope; how many were there."""
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        return self._change(scope_key, ids, F.lit(True), lambda now: upsert.delete(now, scope_key, gone))

    def set_status(self, scope_key: str, record_id: str | list[str], status: str) -> int:
        """Move effective-active records to a status; how many moved. 0 if another writer was first."""
        if status not in S.STATUSES:
            raise ValueError(f"unknown status {status!r}")
        ids = [record_id] if isinstance(record_id, str) else list(dict.fromkeys(record_id))
        try:
            return self._change(scope_key, ids, S.effective_status() == "active", lambda now: upsert.set_status(now, scope_key, ids, status), tries=1)
        except Conflict:
            return 0

    def bump_proof_count(self, scope_key: str, ids: list[str]) -> int:
        """One proof more for each of the ids that is in the scope and not quarantined."""
        credit = self.spark.createDataFrame([(scope_key, i, 1) for i in dict.fromkeys(ids)], "scope_key string, id string, n bigint")
        return self._change(scope_key, ids, S.effective_status() != "quarantined", lambda now: upsert.bumped(now, credit))


REGISTRY: dict[str, Callable[..., SnapshotStore]] = {"snapshot": SnapshotStore}


def register_store(name: str, factory: Callable[..., SnapshotStore]) -> None:
    """Make a kind of store known by name."""
    REGISTRY[name] = factory


def open_store(name: str, spark: SparkSession, path: str) -> SnapshotStore:
    if name not in REGISTRY:
        raise KeyError(f"unknown store {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](spark, path)
