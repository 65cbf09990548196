"""Names the queries over the reference's operators; their SQL is in :mod:`quern.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schema as S
from quern.functions import text as X
from quern.functions import vectors as V
from quern.functions.chunking import chunks
from quern.operators import envelope, evaluation, ledger, lexical, records, retrieval, upsert, vector
from quern.plans import oracle
from quern.session import checkpointed, spread, table
from quern.sources import files

Query = Callable[[SparkSession, str], DataFrame]
K, POOL = 10, 60
# So many rows that go or change are sent to all tasks at most (16 MB); more meet the others by a join.
SENT = 500_000


def _mem(spark, d):
    return table(spark, d, "memory_records")


def current(spark: SparkSession, d: str) -> DataFrame:
    """The store after all deliveries: one row per scope, kind and content."""
    rows = _mem(spark, d).filter("seq IS NOT NULL")
    state = upsert.fold(rows).select("seq", F.col("proof_count").alias("__proof"), F.lit(True).alias("__kept"))
    # Numbers of those rows only that go or change, written once however often the store is read.
    moved = rows.select("seq", "proof_count").join(state, "seq", "left").filter("__kept IS NULL OR NOT __proof <=> proof_count").drop("proof_count")
    moved = checkpointed(moved.withColumn("__moved", F.lit(True)))
    # Few of them are sent to the rows, so that texts and vectors stay where they are.
    moved = F.broadcast(moved) if moved.count() <= SENT else moved
    rows = rows.join(moved, "seq", "left").filter("__moved IS NULL OR __kept")
    return rows.withColumn("proof_count", F.when(F.col("__kept"), F.col("__proof")).otherwise(F.col("proof_count"))).drop("__proof", "__kept", "__moved")


def _eval_queries(spark, d):
    return table(spark, d, "eval_queries").select("qid", F.col("query_text").alias("text"), "project", "control")


def _labels(spark, d):
    return table(spark, d, "eval_labels").select("qid", F.col("record_id").alias("id"), "grade")


def _docs(df):
    return df.select("id", F.col("content").alias("text"))


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


# --- store ----------------------------------------------------------------------------------------


def store_state(spark, d):
    return upsert.fold(_mem(spark, d))


def strict_add_conflicts(spark, d):
    return upsert.conflicts(_mem(spark, d))


def usage_bump(spark, d):
    # Records that calls were informed by gain one proof per entry.
    return upsert.bumped(_mem(spark, d), ledger.credits(table(spark, d, "recall_ledger"))).select("seq", "id", "proof_count")


def delete_scoped(spark, d):
    # Every superseded record of the largest scope goes.
    rows = _mem(spark, d).filter("seq IS NOT NULL")
    scope = rows.groupBy("scope_key").count().orderBy(F.desc("count"), "scope_key").first()[0]
    gone = rows.filter((F.col("status") == "superseded"))
    return upsert.delete(rows, scope, gone).groupBy("scope_key").agg(F.count("*").alias("n"))


def resolve_pending(spark, d):
    # Compare-and-set: open pending entries become superseded, if they are still active.
    rows, md = _mem(spark, d), table(spark, d, "record_metadata")
    open_ = records.board_entries(rows, md, "pending", None).select("id").distinct().withColumn("hit", F.lit(True))
    moved = rows.join(open_, "id", "left")
    done = moved.withColumn("status", F.when(F.col("hit") & (S.effective_status() == "active"), "superseded").otherwise(F.col("status")))
    return done.groupBy("scope_key", "status").agg(F.count("*").alias("n"))


def carry_forward(spark, d):
    rows = _mem(spark, d).filter("seq IS NOT NULL")
    return upsert.carried(rows, rows).groupBy("embedder_name").agg(F.count("*").alias("n"), F.count("embedding").alias("n_vectors"))


# --- reads ----------------------------------------------------------------------------------------


def count_by_status(spark, d):
    return records.count_by_status(_mem(spark, d))


def count_by_kind(spark, d):
    return records.count_by_kind(_mem(spark, d))


def scope_census(spark, d):
    return records.census(_mem(spark, d))


def count_by_source(spark, d):
    return records.count_by_source(_mem(spark, d))


def newest(spark, d):
    return records.newest(current(spark, d)).select("scope_key", "rank", "id")


def recent_feed(spark, d):
    return records.recent_feed(current(spark, d)).select("scope_key", "rank", "id")


def active_directives(spark, d):
    return records.active_directives(current(spark, d)).select("scope_key", "rank", "id")


def board_entries(spark, d):
    return records.board_entries(current(spark, d), table(spark, d, "record_metadata"), "major", 10).select("scope_key", "rank", "id")


def pending_open(spark, d):
    return records.pending_open(current(spark, d), table(spark, d, "record_metadata"))


def board_snapshot(spark, d):
    return records.board(checkpointed(current(spark, d)), table(spark, d, "record_metadata"))


def metadata_typed_decode(spark, d):
    # Shown as text, as a column of whole numbers with gaps has no one form in data frames.
    t = records.typed_metadata(table(spark, d, "record_metadata"))
    return t.withColumns({c: F.col(c).cast("string") for c in ("int_value", "bool_value")})


def record_ids(spark, d):
    return records.identities(_mem(spark, d))


def tamper_check(spark, d):
    return records.tampered(_mem(spark, d)).select("seq", "id", "computed_hash")


def dedup_by_content(spark, d):
    return records.dedup(_mem(spark, d))


def largest_scopes(spark, d):
    # A report of the five largest scopes.
    return records.census(_mem(spark, d)).orderBy(F.desc("n"), "scope_key").limit(5)


def derived_from_edges(spark, d):
    return records.lineage(_mem(spark, d))


def dangling_links(spark, d):
    return records.dangling(table(spark, d, "record_links"), _mem(spark, d)).select("record_id", "target_id", "link_type")


def links_to_hidden(spark, d):
    return records.dangling(table(spark, d, "record_links"), _mem(spark, d).filter(S.surfacable())).select("record_id", "target_id", "link_type")


def embedder_states(spark, d):
    return records.embedder_states(_mem(spark, d), table(spark, d, "embedder_identity"))


def summary_eligible(spark, d):
    out = records.eligible_for_summary(_mem(spark, d))
    return out.groupBy("scope_key").agg(F.count("*").alias("n"), F.min("summary_trust").alias("summary_trust"))


# --- vectors --------------------------------------------------------------------------------------


def vector_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", F.lit("").alias("space"), F.col("embedding").alias("vector"))
    return vector.topk(e.filter("vec_id % 50 = 0"), e, K)


def vector_topk_filtered(spark, d):
    # Queries are the records whose number is divisible by 50; only active rows of trust 2 or more answer.
    rows = current(spark, d).withColumn("space", F.concat_ws("|", "embedder_name", "kind")).withColumn("vector", F.col("embedding"))
    rows = rows.filter("embedding IS NOT NULL")
    return vector.topk(rows.filter("seq % 50 = 0"), rows.filter(S.where_condition({"status": "active", "min_trust": 2})), K)


def vector_topk_kind(spark, d):
    # One kind only answers; queries are the records whose number is divisible by 50.
    rows = current(spark, d).filter("embedding IS NOT NULL").withColumn("space", F.col("embedder_name")).withColumn("vector", F.col("embedding"))
    return vector.topk(rows.filter("seq % 50 = 0"), rows.filter("kind = 'observation'"), K)


def vector_zero_and_dim_skip(spark, d):
    # Vectors of no length score 0, and other dimensions never meet.
    rows = _mem(spark, d).filter("embedding IS NOT NULL").withColumn("space", F.lit("")).withColumn("vector", F.col("embedding")).withColumn("id", F.col("seq").cast("string"))
    odd = rows.filter(F.coalesce((V.norm(F.col("embedding")) == 0) | (F.size("embedding") != F.col("embedder_dim")), F.lit(True)))
    return vector.topk(odd, odd, K)


def vector_validity(spark, d):
    v, n = F.col("embedding"), F.col("embedder_dim")
    fine = F.coalesce(V.valid(v), F.lit(False))
    state = (
        F.when(v.isNull(), "absent").when(~fine, "invalid").when(~F.size(v).eqNullSafe(n), "other dimension").when(V.norm(v) == 0, "no length").otherwise("usable")
    )
    return _mem(spark, d).groupBy("embedder_name", state.alias("state")).agg(F.count("*").alias("n"))


def stub_embedding(spark, d):
    q = _eval_queries(spark, d).select("qid", F.posexplode(V.stub_embedding(F.col("text"))).alias("i", "x"))
    return _rounded(q, "x")


# --- lexical --------------------------------------------------------------------------------------


def bm25_corpus_stats(spark, d):
    return lexical.term_stats(lexical.postings(_docs(current(spark, d))))


def bm25_topk(spark, d):
    return lexical.bm25(_eval_queries(spark, d), _docs(current(spark, d)), K)


def bm25_topk_filtered(spark, d):
    cur = current(spark, d)
    return lexical.bm25(_eval_queries(spark, d), _docs(cur.filter(S.where_condition({"status": "active", "min_trust": 2}))), K, corpus=_docs(cur))


def okapi_hard_negatives(spark, d):
    return lexical.hard_negatives(_eval_queries(spark, d), _docs(current(spark, d)), _labels(spark, d))


def lexical_overlap(spark, d):
    docs = _mem(spark, d).groupBy("id").agg(F.min("content").alias("text"))
    return lexical.overlap(_eval_queries(spark, d), docs, _labels(spark, d).filter("grade >= 1"))


# --- hybrid ---------------------------------------------------------------------------------------


def _legs(spark, d, pool=POOL):
    """Both legs for all evaluation queries over the whole store, each written once."""
    cur = current(spark, d)
    q = _eval_queries(spark, d)
    # Written once: each use of the column would compute the embedding again.
    qv = checkpointed(spread(q).select(F.col("qid").alias("id"), F.lit("stub-hash").alias("space"), V.stub_embedding(F.col("text")).alias("vector")))
    rows = cur.filter("embedding IS NOT NULL").select("id", F.col("embedder_name").alias("space"), F.col("embedding").alias("vector"))
    vec = checkpointed(vector.topk(qv, rows, pool))
    lex = checkpointed(lexical.bm25(q, _docs(cur), pool))
    return q, cur.select("id", "kind", "status", "trust_tier", "created_at", "scope_key", "content"), vec, lex


def rrf_hybrid(spark, d):
    _, _, vec, lex = _legs(spark, d)
    return _rounded(retrieval.fuse(vec, lex, POOL).select("qid", "id", "rrf", "rank"), "rrf")


def hybrid_surfacable(spark, d):
    q, rec, vec, lex = _legs(spark, d)
    return retrieval.hybrid(vec, lex, rec, q, K).select("qid", "id", "rank")


def hybrid_verified(spark, d):
    # Hits whose content doesn't give its hash make room for those behind them.
    q, rec, vec, lex = _legs(spark, d)
    whole = rec.join(current(spark, d).select("id", "content_hash"), "id")
    return retrieval.hybrid(vec, lex, whole, q, K).select("qid", "id", "rank")


def abstain_gate(spark, d):
    q, rec, vec, _ = _legs(spark, d)
    return _rounded(retrieval.gate(q, vec, rec, 0.45), "top_score")


def envelope_partition(spark, d):
    q, rec, vec, lex = _legs(spark, d)
    hits = retrieval.hybrid(vec, lex, rec, q, K).select("qid", "id", "rank").join(rec.drop("content"), "id")
    pinned = rec.filter((F.col("kind") == "directive") & S.surfacable() & (F.col("trust_tier") >= S.DIRECTIVE_FLOOR))
    pinned = pinned.orderBy("created_at", "id").limit(S.PINNED_LIMIT).selectExpr("*", "row_number() OVER (ORDER BY created_at, id) AS rank")
    pinned = q.select("qid").crossJoin(F.broadcast(pinned))  # at most five rows
    return envelope.partition(hits, pinned)


def _runs(spark, d):
    q, rec, vec, lex = _legs(spark, d)
    y = _labels(spark, d)
    legs = {"vector": (True, False), "lexical": (False, True), "hybrid": (True, True)}
    per = {n: evaluation.per_query(retrieval.hybrid(vec, lex, rec, q, K, use_vector=v, use_lexical=x), y, q, 5) for n, (v, x) in legs.items()}
    return q, rec, vec, lex, y, per


def ir_metrics_per_query(spark, d):
    return _runs(spark, d)[-1]["hybrid"]


def ablation_legs(spark, d):
    per = _runs(spark, d)[-1]
    out = None
    for n, m in per.items():
        m = evaluation.means(m).withColumn("config", F.lit(n))
        out = m if out is None else out.unionByName(m)
    return out


def pool_depth_sweep(spark, d):
    q, rec, vec, lex = _legs(spark, d, 200)
    y, out = _labels(spark, d), None
    for pool in (30, 50, 100, 200):
        m = evaluation.means(evaluation.per_query(retrieval.hybrid(vec, lex, rec, q, 5, candidates=pool), y, q, 5)).withColumn("pool", F.lit(pool))
        out = m if out is None else out.unionByName(m)
    return out


def paired_wlt(spark, d):
    per = _runs(spark, d)[-1]
    return evaluation.paired(per["lexical"], per["vector"], "recall")


def resampling_tests(spark, d):
    per = _runs(spark, d)[-1]
    return evaluation.resampled(per["lexical"], per["vector"])


def _top_lexical(spark, d):
    q = _eval_queries(spark, d)
    top = lexical.bm25(q, _docs(current(spark, d)), 1)
    return q.select("qid", "control").join(top.select("qid", "score"), "qid")


def rank_auc(spark, d):
    return _rounded(evaluation.rank_auc(_top_lexical(spark, d).withColumn("answerable", ~F.col("control")), "score", "answerable"), "auc")


def threshold_sweep(spark, d):
    return _rounded(evaluation.threshold_sweep(_top_lexical(spark, d), "score", "control", [5.0, 10.0, 15.0, 20.0, 30.0]), "accept_rate")


def latency_percentiles(spark, d):
    p = evaluation.percentiles(table(spark, d, "events"), "value", "event_type")
    return _rounded(p, "p50", "p95", "mean", "min", "max")


def scope_leak_check(spark, d):
    q = _eval_queries(spark, d)
    rows = current(spark, d).filter("embedding IS NOT NULL AND embedder_name = 'stub-hash'")
    qv = checkpointed(spread(q).select(F.col("qid").alias("id"), F.col("project").alias("space"), V.stub_embedding(F.col("text")).alias("vector")))
    runs = vector.topk(qv, rows.select("id", F.col("project").alias("space"), F.col("embedding").alias("vector")), K)
    return retrieval.leaks(runs, q, rows, "project")


def run_fingerprints(spark, d):
    return retrieval.fingerprint(bm25_topk(spark, d).withColumn("score", F.round(F.col("score") * 1e6).cast("bigint")))


def first_gold_rank(spark, d):
    # Labels are few and seldom near the top, so more than the first page is ranked.
    # Queries without a relevant record have no such rank, so they aren't searched for.
    gold = _labels(spark, d).filter("grade >= 1")
    q = _eval_queries(spark, d).join(gold.select("qid").distinct(), "qid", "left_semi")
    runs = lexical.bm25(q, _docs(current(spark, d)), 200)
    return retrieval.first_gold(runs, gold, q).filter("first_rank IS NOT NULL")


def rerank_overlap(spark, d):
    q, cur = _eval_queries(spark, d), current(spark, d)
    hits = lexical.bm25(q, _docs(cur), 30).join(q.select("qid", F.col("text").alias("query")), "qid").join(_docs(cur), "id")
    asked, has = lexical.query_terms(F.col("query")), F.array_distinct(lexical.tokens(F.col("text")))
    share = F.round(F.size(F.array_intersect(asked, has)) / F.size(asked), 9)
    return retrieval.rerank(hits, share, 5).select("qid", "id", "rerank_score", "rank")


# --- ledger ---------------------------------------------------------------------------------------


def ledger_informed_by(spark, d):
    out = ledger.informed_by(table(spark, d, "recall_ledger"))
    return out.select("call_id", "rank", "ts", "query_text", F.concat_ws(",", "ids").alias("ids"))


def ledger_kept(spark, d):
    e = table(spark, d, "recall_ledger")
    # As of the latest entry of the whole table.
    now = e.agg(F.max("ts").alias("now"))
    at = now.first().now
    out = ledger.kept(e, F.lit(at))
    return out.select("rank", "call_id", "ts", "query_text", F.concat_ws(",", "ids").alias("ids"))


def ledger_credits(spark, d):
    return ledger.credits(table(spark, d, "recall_ledger"))


# --- text -----------------------------------------------------------------------------------------


def screen_records(spark, d):
    m = spread(_mem(spark, d).select("seq", "id", "content", "trust_tier")).select("seq", "id", X.screened(F.col("content"), F.col("trust_tier"), redact_pii=True).alias("s"))
    return m.select("seq", "id", F.col("s.action").alias("action"), F.col("s.trust").alias("trust"), F.size("s.redactions").alias("n_redactions"), F.size("s.markers").alias("n_markers"))


def attack_screen(spark, d):
    a = table(spark, d, "attack_corpus")
    s = a.select("category", "detected", X.screened(F.col("payload"), F.lit(1)).alias("s"))
    flagged = F.col("s.action") == "QUARANTINE"
    return s.groupBy("category", "detected").agg(F.count("*").alias("n"), F.count_if(flagged).alias("n_flagged"))


def neutralized_payloads(spark, d):
    return table(spark, d, "attack_corpus").select("attack_id", X.neutralized(F.col("payload")).alias("payload"))


def split_marker_screen(spark, d):
    # Documents whose chunks hold a marker only when they are read on.
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), "text", F.lit("s").alias("scope_key"))
    made = files.ingest(docs, trust=int(S.Trust.UNVERIFIED))
    return made.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("metadata").isNotNull()).alias("n_noted"))


def chunk_records(spark, d):
    m = spread(_mem(spark, d).select("seq", "id", "prov_source_file", "content")).select("seq", "id", F.posexplode(chunks(F.col("prov_source_file"), F.col("content"))).alias("chunk_index", "chunk"))
    return m


def ingest_documents(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), F.col("text"), F.concat_ws("/", F.lit("default"), "project", F.lit("ingest")).alias("scope_key"))
    return files.ingest(docs, trust=int(S.Trust.UNVERIFIED)).select("id", "scope_key", "content_hash", "prov_chunk_index", "status", "trust_tier")


def queries() -> dict[str, Query]:
    """Query name to function of session and data directory."""
    fs = [
        store_state, strict_add_conflicts, usage_bump, delete_scoped, resolve_pending, carry_forward,
        count_by_status, count_by_kind, scope_census, count_by_source, newest, recent_feed, active_directives, board_entries,
        pending_open, board_snapshot, metadata_typed_decode, record_ids, tamper_check, derived_from_edges, dangling_links, links_to_hidden,
        embedder_states, summary_eligible, vector_topk, vector_topk_filtered, vector_topk_kind, vector_zero_and_dim_skip, vector_validity, stub_embedding, bm25_corpus_stats,
        bm25_topk, bm25_topk_filtered, okapi_hard_negatives, lexical_overlap, rrf_hybrid, hybrid_surfacable, hybrid_verified, abstain_gate,
        envelope_partition, ir_metrics_per_query, ablation_legs, pool_depth_sweep, paired_wlt, resampling_tests, rank_auc,
        dedup_by_content, largest_scopes, scope_leak_check, run_fingerprints, first_gold_rank, rerank_overlap,
        threshold_sweep, latency_percentiles, ledger_informed_by, ledger_kept, ledger_credits, screen_records, attack_screen,
        neutralized_payloads, split_marker_screen, chunk_records, ingest_documents,
    ]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return oracle.sql()
