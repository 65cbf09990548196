"""Streams: documents into the store, and recalls into a ledger with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern import schema as S
from quern.sources import files
from quern.sources.store import SnapshotStore

LEDGER = "call_id string, ts timestamp, query_text string, ids array<string>"


def ingest_stream(docs: DataFrame, store: SnapshotStore, trust: int, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Documents (name, text, scope_key) into the store, a snapshot per micro-batch.

    Records are named by their content, so a batch that runs twice changes nothing the second time.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = files.ingest(batch, trust)
        parts = F.split("scope_key", "/")
        rows = made.withColumns({
            "tenant": parts[0], "project": parts[1], "agent": parts[2],
            "created_at": F.current_timestamp(), "seen_at": F.current_timestamp(), "proof_count": F.lit(0).cast("bigint"),
        })
        store.upsert(store.stamped(rows))

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_recalls(ledger: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Recalls per call and window of event time; what comes later than ``late`` is dropped."""
    e = ledger.filter(F.size("ids") > 0).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "call_id").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("n_ids"))


def ledger_state(ledger: DataFrame, cap: int = S.LEDGER_CAP, ttl_s: int = S.LEDGER_TTL_S) -> DataFrame:
    """Per call, the entries now kept (a ring of ``cap`` within ``ttl_s``), after each micro-batch.

    A call's state is dropped when event time has passed its newest entry by ``ttl_s``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = list(state.get[0]) if state.exists else []
        for b in batches:
            old += [(t.value // 1000, q, list(i)) for t, q, i in zip(b["ts"], b["query_text"], b["ids"]) if i is not None and len(i)]
        old.sort(key=lambda x: x[0], reverse=True)
        kept = [x for x in old if old[0][0] - x[0] <= ttl_s * 1_000_000][:cap]
        state.update((kept,))
        # Gone once nothing it holds could still count. What comes later than the watermark starts anew.
        if kept:
            state.setTimeoutTimestamp(max(kept[0][0] // 1000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"call_id": [key[0]] * len(kept), "rank": range(1, len(kept) + 1), "ts_us": [x[0] for x in kept], "query_text": [x[1] for x in kept]})

    return ledger.filter("call_id IS NOT NULL").withWatermark("ts", f"{ttl_s} seconds").groupBy("call_id").applyInPandasWithState(
        run, "call_id string, rank int, ts_us bigint, query_text string",
        "kept array<struct<ts_us: bigint, query_text: string, ids: array<string>>>", "update", GroupStateTimeout.EventTimeTimeout,
    )
