"""The facade: remember, recall, ingest, board, consolidate, usage and health over one scope."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schema as S
from quern.functions import text as X
from quern.functions.vectors import Embedder, StubEmbedder, embedded
from quern.operators import envelope, lexical, records, retrieval, upsert, vector
from quern.session import checkpointed
from quern.sources import files
from quern.sources.store import SnapshotStore


@dataclass
class Recall:
    """Hits of one query, best first, and how they came about."""

    rows: list
    mode: str
    directives: list = field(default_factory=list)
    abstained: bool = False
    top_vector_score: float | None = None
    gate: str = "off"

    def texts(self) -> list[str]:
        return [r.content for r in self.rows]

    def ids(self) -> list[str]:
        return [r.id for r in self.rows]

    def sources(self) -> list[dict | None]:
        return [{"file": r.prov_source_file, "chunk": r.prov_chunk_index} if r.prov_source_file else None for r in self.rows]

    def envelope(self) -> tuple[list[str], list[str]]:
        """Rules (pinned, then ranked) and evidence."""
        pinned = {r.id for r in self.directives}
        rule = lambda r: r.kind == "directive" and r.trust_tier >= S.DIRECTIVE_FLOOR
        ranked = [r for r in self.rows if rule(r) and r.id not in pinned]
        return [r.content for r in [*self.directives, *ranked]], [r.content for r in self.rows if not rule(r)]

    def context(self) -> str:
        return envelope.render(*self.envelope())


class Ledger:
    """The last recalls of this process."""

    def __init__(self, cap: int = S.LEDGER_CAP, ttl_s: int = S.LEDGER_TTL_S):
        self.rows: deque = deque(maxlen=cap)
        self.ttl_s = ttl_s

    def record(self, query: str, ids: list[str], call_id: str | None, now: datetime | None = None) -> None:
        if ids:
            self.rows.append((now or datetime.now(UTC), call_id, query[: S.LEDGER_QUERY], ids[: S.LEDGER_IDS]))

    def entries(self, call_id: str | None = None, limit: int = 5, now: datetime | None = None) -> list[tuple]:
        """Newest first; what is too old is dropped."""
        now = now or datetime.now(UTC)
        self.rows = deque((r for r in self.rows if (now - r[0]).total_seconds() <= self.ttl_s), maxlen=self.rows.maxlen)
        hits = [r for r in reversed(self.rows) if call_id is None or r[1] == call_id]
        return hits[: max(1, int(limit))]


class Memory:
    """One scope of a store."""

    def __init__(
        self, spark: SparkSession, store: SnapshotStore | str, scope: S.Scope | None = None, embedder: Embedder | None = None,
        redact_pii: bool = False, reranker: Callable | None = None,
    ):
        self.spark = spark
        self.store = SnapshotStore(spark, store) if isinstance(store, str) else store
        self.scope = scope or S.Scope()
        self.embedder = embedder or StubEmbedder()
        self.redact_pii, self.reranker = redact_pii, reranker
        self.ledger = Ledger()

    # --- state ---

    def _rows(self, version: int | None = None) -> DataFrame:
        return self.store.read(version, self.scope.key())

    def identity_state(self, version: int | None = None) -> str:
        """Whether stored vectors come from this embedder as configured: unknown, match or mismatch."""
        return S.identity_state(self.store.identity(self.scope.key(), version), tuple(self.embedder.identity()))

    # --- writes ---

    def _make(self, rows: list[tuple], kind: str, trust: int, adapter: str, derived: tuple[str, ...] = (), declared: tuple[str, ...] = ()) -> list[dict]:
        out = []
        for content, uri, meta in rows:
            s = X.screen(content, trust, self.redact_pii)
            if not X.normalize_content(s.content):
                raise ValueError("nothing is left of the content")
            if len(s.content) > S.CONTENT_CHARS:
                raise ValueError(f"more than {S.CONTENT_CHARS} characters after sanitising")
            tier = s.trust
            md = {**meta, "redactions": len(s.redactions), "injection_flags": len(s.markers)} if s.redactions or s.markers else meta
            hashed = X.content_hash(s.content)
            out.append({
                "id": X.record_id(self.scope.key(), uri, kind, hashed), "scope_key": self.scope.key(), "tenant": self.scope.tenant,
                "project": self.scope.project, "agent": self.scope.agent, "kind": kind, "content": s.content, "content_hash": hashed,
                "prov_source_uri": uri, "prov_adapter_name": adapter, "prov_adapter_version": "1", "derived_from": list(derived),
                "trust_tier": tier, "status": "active" if tier > 0 else "quarantined", "created_at": datetime.now(UTC), "seen_at": datetime.now(UTC),
                "proof_count": 0, "declared_transformations": list(declared), "privacy_class": "default", "metadata": {k: typed(v) for k, v in md.items()},
            })
        return out

    def _store(self, df: DataFrame) -> None:
        """Upsert rows, with vectors unless the scope holds another embedder's.

        Then rows that are stored already keep the vectors they have.
        """
        version = self.store.version()
        state = self.identity_state(version)
        if state == "mismatch":
            df = upsert.carried(df.withColumns({n: F.lit(None).cast(S.RECORD[n].dataType) for n in ("embedding", "embedder_name", "embedder_dim")}), self._rows(version))
        else:
            name, dim, _ = self.embedder.identity()
            df = df.withColumn("embedding", embedded(F.col("content"), self.embedder)).withColumn("embedder_name", F.lit(name)).withColumn("embedder_dim", F.lit(dim))
        self.store.upsert(df)
        if state == "unknown":
            self.store.set_identity(self.scope.key(), tuple(self.embedder.identity()))

    def remember(self, content: str, kind: str = "raw_fact", trust: int | None = None, source: str = "memory://note", metadata: dict | None = None, board: str | None = None) -> str:
        """Store one text; its id."""
        if kind not in S.KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        if board is not None and board not in S.BOARD_TAGS:
            raise ValueError(f"board is one of {S.BOARD_TAGS}")
        if kind == "directive" and trust is None:
            raise ValueError("a directive needs an explicit trust")
        if len(content) > S.CONTENT_CHARS:
            raise ValueError(f"more than {S.CONTENT_CHARS} characters")
        meta = {**(metadata or {}), **({"board": board} if board else {})}
        rows = self._make([(content, source, meta)], kind, int(S.Trust.UNVERIFIED if trust is None else trust), "memory")
        self._store(self.spark.createDataFrame([{f.name: None for f in S.RECORD.fields} | {"seq": i} | r for i, r in enumerate(rows)], S.RECORD))
        return rows[0]["id"]

    def _ingest(self, docs: DataFrame, trust: int, scheme: str) -> int:
        made = files.ingest(docs, trust, scheme=scheme)
        parts = dict(zip(("tenant", "project", "agent"), (self.scope.tenant, self.scope.project, self.scope.agent)))
        df = made.withColumns({k: F.lit(v) for k, v in parts.items()} | {
            "prov_adapter_name": F.lit("files"), "prov_adapter_version": F.lit("1"),
            "created_at": F.current_timestamp(), "seen_at": F.current_timestamp(), "proof_count": F.lit(0).cast("bigint"),
        })
        before = self._rows().count()
        self._store(self.store.stamped(df))
        return self._rows().count() - before

    def ingest_text(self, text: str, name: str = "default", trust: int = int(S.Trust.UNVERIFIED)) -> int:
        """Chunk, screen and store one document; how many records are new."""
        return self._ingest(self.spark.createDataFrame([(name, text, self.scope.key())], "name string, text string, scope_key string"), trust, "text://")

    def ingest_path(self, path: str, trust: int = int(S.Trust.UNVERIFIED), **options) -> dict[str, int]:
        """Chunk, screen and store a file or directory; what was read and what wasn't."""
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        names, skipped = files.walk(path, **options)
        docs = files.read_files(self.spark, path, names, self.scope.key())
        unread = docs.filter("text IS NULL").count()
        new = self._ingest(docs.filter("text IS NOT NULL"), trust, "file://") if len(names) > unread else 0
        refused = files.rejected(docs).count()
        rows = self._rows()
        stored = rows.filter(F.col("metadata")["redactions"]["value"].cast("int") > 0).filter(F.col("prov_adapter_name") == "files").count()
        return {"files": len(names) - unread - refused, "new": new, "skipped": unread + refused, **skipped, "redacted": stored, "total": rows.count()}

    def forget(self, *ids: str) -> int:
        return self.store.delete(self.scope.key(), list(ids))

    def resolve(self, *ids: str) -> int:
        """Mark board entries as superseded; how many moved."""
        return self.store.set_status(self.scope.key(), list(ids), "superseded")

    def reindex(self) -> int:
        """Embed every row of the scope again, and make this embedder the scope's."""
        name, dim, _ = self.embedder.identity()

        def change(now: DataFrame) -> DataFrame:
            new = now.withColumn("embedding", embedded(F.col("content"), self.embedder))
            return new.withColumn("embedder_name", F.lit(name)).withColumn("embedder_dim", F.lit(dim))

        self.store.update(change, scope_key=self.scope.key())
        self.store.set_identity(self.scope.key(), tuple(self.embedder.identity()))
        return self._rows().count()

    def compact(self) -> None:
        """Merge what was written since the last time, of the whole store."""
        self.store.compact()

    def close(self) -> None:
        """Forget the recalls of this process; the store itself needs no closing."""
        self.ledger.rows.clear()

    def consolidate(self, consolidator: Callable[[list[str]], str], ids: list[str] | None = None, query: str | None = None, least_trust: int = int(S.Trust.UNVERIFIED)) -> str:
        """Store a summary of records as an observation of their lowest trust."""
        if (ids is None) == (query is None):
            raise ValueError("give either ids or a query")
        wanted = ids if ids is not None else self.recall(query, k=10).ids()
        found = records.eligible_for_summary(records.lookup(self._rows(), self.scope.key(), wanted), least_trust).collect()
        by = {r.id: r for r in found}
        if ids is not None and (missing := [i for i in ids if i not in {x.id for x in records.lookup(self._rows(), self.scope.key(), ids).select("id").collect()}]):
            raise KeyError(missing)
        if not found:
            raise ValueError("nothing to summarise")
        ordered = [by[i] for i in dict.fromkeys(wanted) if i in by]
        made = self._make([(consolidator([r.content for r in ordered]), "memory://summary", {})], "observation", min(r.trust_tier for r in ordered), "consolidator", tuple(r.id for r in ordered), ("llm_summary",))
        self._store(self.spark.createDataFrame([{f.name: None for f in S.RECORD.fields} | {"seq": 0} | made[0]], S.RECORD))
        return made[0]["id"]

    # --- reads ---

    def count(self) -> int:
        return self._rows().count()

    def search(
        self, queries: DataFrame, k: int = 5, kind: str | None = None, where: dict | None = None, candidates: int | None = None,
        min_score: float | None = None, use_vector: bool = True, use_lexical: bool = True, include_quarantined: bool = False,
    ) -> DataFrame:
        """Hits (qid, id, rank) of a batch of queries (qid, text) in one job, of one snapshot."""
        version = self.store.version()
        rows, queries, vec = self._vectors(version, queries, k, kind, where, candidates, use_vector)
        gate = retrieval.gate(queries, vec, rows, min_score if use_vector else None, include_quarantined)
        lex = self._words(version, rows, queries, k, candidates, use_lexical)
        out = retrieval.hybrid(vec, lex, rows, queries, k, candidates, None, use_vector, use_lexical, include_quarantined)
        return out.join(gate.filter("verdict = 'abstain'").select("qid"), "qid", "left_anti")

    def _vectors(self, version, queries, k, kind, where, candidates, use_vector):
        """Answering rows, clean queries and the vector leg, written once."""
        rows = self.store.read(version, self.scope.key(), kind).filter(S.where_condition(where))
        queries = queries.select("qid", X.clean_query(F.col("text")).alias("text"))
        qv = queries.select(F.col("qid").alias("id"), F.lit("").alias("space"), embedded(F.col("text"), self.embedder).alias("vector"))
        rv = rows.filter("embedding IS NOT NULL").select("id", F.lit("").alias("space"), F.col("embedding").alias("vector"))
        pool = retrieval.pool_size(k, candidates) if use_vector else 0
        return rows, queries, checkpointed(vector.topk(qv, rv, pool)) if pool else vector.topk(qv, rv, 0)

    def _words(self, version, rows, queries, k, candidates, use_lexical):
        pool = retrieval.pool_size(k, candidates) if use_lexical else 0
        return lexical.bm25(queries, rows.select("id", F.col("content").alias("text")), pool, corpus=self.store.read(version).select("id", F.col("content").alias("text")))

    def recall(
        self, query: str, k: int = 5, kind: str | None = None, min_score: float | None = None, call_id: str | None = None,
        where: dict | None = None, include_quarantined: bool = False,
    ) -> Recall:
        """Best records for one query, with standing rules apart.

        Everything is of one snapshot. Hits are verified and reranked in the pool, before it's cut to ``k``; if the
        gate abstains, nothing after it runs.
        """
        version = self.store.version()
        vectors = self.identity_state(version) != "mismatch"
        q = self.spark.createDataFrame([("q", query)], "qid string, text string")
        rows, q, vec = self._vectors(version, q, k, kind, where, None, vectors)
        top, verdict = None, "off"
        if min_score is not None and not vectors:
            verdict = "unavailable: no vector leg"
        elif vectors:
            g = retrieval.gate(q, vec, rows, min_score, include_quarantined).first()
            top, verdict = g.top_score, g.verdict
        abstained = verdict == "abstain"
        ranked: list = []
        if not abstained:
            lex = self._words(version, rows, q, k, None, True)
            pool = retrieval.pool_size(k)
            hits = retrieval.hybrid(vec, lex, rows, q, pool if self.reranker else k, pool, None, vectors, True, include_quarantined)
            ranked = rows.join(hits.select("id", "rank"), "id").orderBy("rank").collect()
            if self.reranker and ranked:
                ranked = self.reranker(query, ranked)[:k]
        mode = retrieval.mode(
            vectors, not abstained, bool(self.reranker) and not abstained, isinstance(self.embedder, StubEmbedder), not vectors,
            (top if top is not None else float("nan"), min_score) if abstained else None, min_score is not None and verdict.startswith("unavailable"),
        )
        out = Recall(ranked, mode, self.rules(version=version), abstained, top, verdict)
        self.ledger.record(query, out.ids(), call_id)
        return out

    def rules(self, limit: int = S.PINNED_LIMIT, version: int | None = None) -> list:
        found = records.active_directives(self.store.read(version, self.scope.key(), "directive"), limit).orderBy("rank").collect()
        return [r for r in found if r.content_hash == X.content_hash(r.content)]

    def board(self, recent: int = 10, majors: int = 10, rules: int = 5) -> dict:
        """Rules, majors, recent entries, open pending ones and the latest time, of one snapshot."""
        rows = self._rows(self.store.version())
        tag = F.col("metadata")["board"]["value"]
        md = rows.select(F.col("id").alias("record_id"), F.lit("board").alias("meta_key"), tag.alias("meta_value")).filter("meta_value IS NOT NULL")
        legs = records.board(rows, md, recent, majors, rules).join(rows, ["scope_key", "id"]).orderBy("leg", "rank").collect()
        entry = lambda r: {"id": r.id, "kind": r.kind, "trust": r.trust_tier, "created_at": r.created_at.isoformat(), "text": X.excerpt(r.content, r.trust_tier)}
        sound = [r for r in legs if r.content_hash == X.content_hash(r.content)]
        out = {leg: [entry(r) for r in sound if r.leg == leg] for leg in ("rules", "majors", "recent")}
        pending = records.pending_open(rows, md).first()
        return out | {"pending_open": pending.n if pending else 0, "latest": max((e["created_at"] for leg in out.values() for e in leg), default=None)}

    def mark_used(self, *ids: str) -> int:
        return self.store.bump_proof_count(self.scope.key(), list(dict.fromkeys(ids)))

    def informed_by(self, call_id: str, limit: int = 5) -> list[tuple]:
        return self.ledger.entries(call_id, limit)

    def health(self, n: int = 3, k: int = 5) -> dict:
        """Whether the newest records are embedded, intact and found by their own text, in one batch."""
        rows = self._rows()
        probe = rows.filter(S.surfacable()).orderBy(F.desc("created_at"), F.desc("id")).limit(n).collect()
        if not probe:
            return {"checked": 0, "embedded": 0, "intact": 0, "found": 0, "identity": self.identity_state()}
        q = self.spark.createDataFrame([(r.id, r.content) for r in probe], "qid string, text string")
        found = self.search(q, max(k, 20)).filter("qid = id").count()
        intact = sum(r.content_hash == X.content_hash(r.content) for r in probe)
        return {"checked": len(probe), "embedded": sum(r.embedding is not None for r in probe), "intact": intact, "found": found, "identity": self.identity_state()}

    def self_test(self) -> bool:
        """Store a sentinel, find it first, and remove it."""
        text = f"sentinel {datetime.now(UTC).isoformat()}"
        i = self.remember(text, trust=int(S.Trust.OWNER), source="memory://self-test")
        try:
            return self.recall(text, k=1).ids() == [i]
        finally:
            self.forget(i)


def typed(v) -> tuple[str, str | None]:
    """A scalar as (vtype, value); anything nested is refused."""
    if v is None:
        return ("none", None)
    for kind, t in (("bool", bool), ("int", int), ("float", float), ("str", str)):
        if isinstance(v, t):
            return (kind, str(v))
    raise TypeError(f"metadata holds scalars, not {type(v).__name__}")
