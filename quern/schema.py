"""The record's shape, its enumerations, fixed limits, and checks of arguments."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
KINDS = ("raw_fact", "observation", "directive", "episode")
STATUSES = ("proposed", "active", "quarantined", "superseded", "invalidated")
RECALLABLE = ("active",)
BOARD_TAGS = ("major", "pending")
RRF_K = 60
DIRECTIVE_FLOOR = BOARD_FLOOR = 2
PINNED_LIMIT = 5
BOARD_LIMIT_MAX = 50
QUERY_CHARS = 8192
POOL_FACTOR = 6
MAX_DIM = 65_536
CONTENT_CHARS = 100_000
TEXT_BYTES, MAX_CHUNKS, BATCH = 10 * 1024 * 1024, 25_000, 256
LEDGER_CAP, LEDGER_TTL_S, LEDGER_IDS, LEDGER_QUERY = 50, 7200, 20, 200
QUERY_TERMS = 32


class Trust(IntEnum):
    """Ordered trust of a record's source."""

    QUARANTINED = 0
    UNVERIFIED = 1
    TRUSTED_SOURCE = 2
    CURATED = 3
    OWNER = 4


@dataclass(frozen=True)
class Scope:
    """Isolation key of every record and query."""

    tenant: str = "default"
    project: str = "default"
    agent: str = "default"

    def __post_init__(self):
        for part in (self.tenant, self.project, self.agent):
            if not part or "/" in part or "\0" in part:
                raise ValueError(f"bad scope part {part!r}")
            part.encode()

    def key(self) -> str:
        return f"{self.tenant}/{self.project}/{self.agent}"


TYPED = T.StructType([T.StructField("vtype", T.StringType()), T.StructField("value", T.StringType())])
RECORD = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("seq", T.LongType()), ("id", T.StringType()), ("human_id", T.StringType()), ("scope_key", T.StringType()),
            ("tenant", T.StringType()), ("project", T.StringType()), ("agent", T.StringType()), ("kind", T.StringType()),
            ("content", T.StringType()), ("content_hash", T.StringType()), ("source_id", T.StringType()),
            ("prov_source_uri", T.StringType()), ("prov_adapter_name", T.StringType()), ("prov_adapter_version", T.StringType()),
            ("prov_ingest_run_id", T.StringType()), ("prov_source_file", T.StringType()), ("prov_chunk_index", T.IntegerType()),
            ("derived_from", T.ArrayType(T.StringType())), ("trust_tier", T.IntegerType()), ("status", T.StringType()),
            ("embedding", T.ArrayType(T.DoubleType())), ("embedder_name", T.StringType()), ("embedder_dim", T.IntegerType()),
            ("created_at", T.TimestampType()), ("seen_at", T.TimestampType()), ("valid_from", T.TimestampType()),
            ("valid_until", T.TimestampType()), ("proof_count", T.LongType()), ("declared_transformations", T.ArrayType(T.StringType())),
            ("privacy_class", T.StringType()), ("metadata", T.MapType(T.StringType(), TYPED)),
        ]
    ]
)


def effective_status(trust: str = "trust_tier", status: str = "status") -> Column:
    """Status as every read must take it: untrusted rows marked active are quarantined."""
    return F.when((F.col(trust) <= 0) & (F.col(status) == "active"), F.lit("quarantined")).otherwise(F.col(status))


def surfacable(trust: str = "trust_tier", status: str = "status") -> Column:
    """Recallable and not untrusted."""
    return effective_status(trust, status).isin(*RECALLABLE) & (F.col(trust) > 0)


def where_condition(where: Mapping | None) -> Column:
    """Condition of a ``where`` mapping: status (effective) and min_trust (raw) only."""
    if where is None:
        return F.lit(True)
    if not isinstance(where, Mapping):
        raise ValueError("where must be a mapping")
    if unknown := sorted(set(where) - {"status", "min_trust"}):
        raise ValueError(f"unknown where keys: {unknown}")
    c = F.lit(True)
    if where.get("status") is not None:
        c = c & (effective_status() == str(getattr(where["status"], "value", where["status"])))
    if where.get("min_trust") is not None:
        try:
            c = c & (F.col("trust_tier") >= int(where["min_trust"]))
        except (TypeError, ValueError) as e:
            raise ValueError("min_trust must be an integer") from e
    return c


def board_limit(n: int) -> int:
    """A board leg's limit; 0 turns the leg off."""
    if isinstance(n, bool) or not isinstance(n, int) or not 0 <= n <= BOARD_LIMIT_MAX:
        raise ValueError(f"board limits are 0 to {BOARD_LIMIT_MAX}")
    return n


def identity_state(stored: tuple | None, current: tuple) -> str:
    """'unknown', 'match' or 'mismatch' of two (name, dim, config hash)."""
    if stored is None:
        return "unknown"
    return "match" if tuple(stored) == tuple(current) else "mismatch"
