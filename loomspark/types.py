"""Errors, limits, and the values that describe databases, collections and documents."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

MAX_DIMENSION = 65_536
MAX_ID_BYTES = 512
MAX_NAME_BYTES = 64
MAX_METADATA_BYTES = 64 * 1024
MAX_METADATA_DEPTH = 16
MAX_CONTENT_BYTES = 1 << 20
MAX_TOP_K = 10_000
MAX_BATCH = 100_000
MAX_FILTER_NODES, MAX_FILTER_DEPTH = 256, 32
METRICS = ("cosine", "l2", "dot")
FORMAT_VERSION = 1


class EngineError(Exception):
    """Any failure; ``code`` is stable, its leading digit tells the kind."""

    code = 9999


def _kind(name: str, code: int, base: type = EngineError) -> type:
    return type(name, (base,), {"code": code, "__doc__": f"Code {code}."})


InvalidPath = _kind("InvalidPath", 1001)
InvalidConfig = _kind("InvalidConfig", 1002)
UnsupportedConfiguration = _kind("UnsupportedConfiguration", 1003)
AlreadyOpen = _kind("AlreadyOpen", 2001)
DatabaseNotFound = _kind("DatabaseNotFound", 2002)
DatabaseClosed = _kind("DatabaseClosed", 2003)
ReadOnly = _kind("ReadOnly", 2004)
NotADatabase = _kind("NotADatabase", 2005)
CollectionNotFound = _kind("CollectionNotFound", 3001)
DocumentNotFound = _kind("DocumentNotFound", 3002)
ValidationError = _kind("ValidationError", 4000)
CollectionExists = _kind("CollectionExists", 4001)
DuplicateId = _kind("DuplicateId", 4002)
InvalidVectorDimension = _kind("InvalidVectorDimension", 4003, ValidationError)
InvalidVectorData = _kind("InvalidVectorData", 4004, ValidationError)
InvalidDocumentId = _kind("InvalidDocumentId", 4005, ValidationError)
InvalidCollectionName = _kind("InvalidCollectionName", 4006, ValidationError)
MetadataTooLarge = _kind("MetadataTooLarge", 4007, ValidationError)
MetadataTooDeep = _kind("MetadataTooDeep", 4008, ValidationError)
TopKOutOfRange = _kind("TopKOutOfRange", 4009, ValidationError)
FilterTooComplex = _kind("FilterTooComplex", 4010, ValidationError)
BatchTooLarge = _kind("BatchTooLarge", 4011, ValidationError)
InvalidDimension = _kind("InvalidDimension", 4013, ValidationError)
StorageFailure = _kind("StorageFailure", 5001)
ChecksumMismatch = _kind("ChecksumMismatch", 6002)
NoValidManifest = _kind("NoValidManifest", 6004)
MissingSegment = _kind("MissingSegment", 6005)
Cancelled = _kind("Cancelled", 9001)


class BatchAborted(EngineError):
    """A batch of which nothing was applied."""

    code = 8001

    def __init__(self, failed_at: int, total_ops: int, cause: EngineError):
        super().__init__(f"operation {failed_at} of {total_ops}: {cause}")
        self.failed_at, self.total_ops, self.cause = failed_at, total_ops, cause


@dataclass(frozen=True)
class Include:
    """Which parts of a document a read returns."""

    vector: bool = False
    metadata: bool = True
    content: bool = False

    def columns(self) -> list[str]:
        return [c for c in ("vector", "metadata", "content") if getattr(self, c)]


INCLUDE_NONE, INCLUDE_ALL = Include(metadata=False), Include(True, True, True)


@dataclass(frozen=True)
class Config:
    create_if_missing: bool = True
    read_only: bool = False
    durability: str = "batch"
    flush_threshold: int = 8 << 20

    def __post_init__(self):
        if self.durability not in ("full", "batch", "relaxed"):
            raise InvalidConfig(f"durability {self.durability!r}: full, batch or relaxed")
        if self.flush_threshold < 1:
            raise InvalidConfig("flush_threshold must be positive")
        if self.read_only and self.create_if_missing:
            raise InvalidConfig("a read-only database can't be created")


@dataclass(frozen=True)
class CollectionSpec:
    """Fixed when a collection is created."""

    name: str
    dimension: int
    metric: str = "cosine"
    id_kind: str = "string"
    id_max_len: int = MAX_ID_BYTES
    index: str = "flat"
    created_at_ms: int = 0

    def __post_init__(self):
        check_name(self.name)
        if not 1 <= self.dimension <= MAX_DIMENSION:
            raise InvalidDimension(f"dimension {self.dimension}: 1 to {MAX_DIMENSION}")
        if self.metric not in METRICS:
            raise InvalidConfig(f"metric {self.metric!r}: one of {METRICS}")
        if self.id_kind not in ("string", "u64") or self.index not in ("flat", "ann"):
            raise InvalidConfig("id_kind is string or u64, index is flat or ann")
        if not 1 <= self.id_max_len <= MAX_ID_BYTES:
            raise InvalidConfig(f"id_max_len may only narrow {MAX_ID_BYTES}")

    def same_shape(self, other: CollectionSpec) -> bool:
        return (self.dimension, self.metric, self.id_kind) == (other.dimension, other.metric, other.id_kind)


@dataclass
class Document:
    id: Any
    vector: Any
    metadata: dict[str, Any] | None = None
    content: bytes | None = None


@dataclass(frozen=True)
class SearchStats:
    index: str
    exact: bool
    considered: int
    scanned: int
    skipped: int


@dataclass(frozen=True)
class Hit:
    id: Any
    score: float
    distance: float | None
    document: Document | None = None


@dataclass(frozen=True)
class SearchResponse:
    hits: list[Hit]
    stats: SearchStats


@dataclass
class BatchReport:
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    missing_deletes: int = 0


@dataclass
class VerifyReport:
    level: str
    collections: dict[str, dict] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    segments_checked: int = 0

    @property
    def is_clean(self) -> bool:
        return not self.errors


def check_name(name: str) -> None:
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", name):
        raise InvalidCollectionName(f"{name!r}: 1 to {MAX_NAME_BYTES} of A-Z a-z 0-9 _ -")


def check_top_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MAX_TOP_K:
        raise TopKOutOfRange(f"top_k {k}: 1 to {MAX_TOP_K}")


def check_id(id_: Any, spec: CollectionSpec) -> None:
    if spec.id_kind == "u64":
        if isinstance(id_, bool) or not isinstance(id_, int) or not 0 <= id_ < 1 << 63:
            raise InvalidDocumentId(f"{id_!r}: an integer from 0 to 2**63 - 1")
    elif not isinstance(id_, str) or not 1 <= len(id_.encode("utf-8", "surrogatepass")) <= spec.id_max_len or re.search(r"[\x00-\x1f\x7f-\x9f\ud800-\udfff]", id_):
        raise InvalidDocumentId(f"{id_!r:.80}: 1 to {spec.id_max_len} bytes without control characters")


def check_vector(vector: Any, dimension: int) -> list[float]:
    """The vector as a list of float32 values; bytes are little-endian float32."""
    import numpy as np

    if isinstance(vector, bytes | bytearray | memoryview):
        if len(bytes(vector)) != 4 * dimension:
            raise InvalidVectorDimension(f"{len(bytes(vector))} bytes instead of {4 * dimension}")
        own = np.frombuffer(bytes(vector), "<f4")
    else:
        with np.errstate(over="ignore"):
            own = np.asarray(vector, np.float32)
    if own.ndim != 1 or len(own) != dimension:
        raise InvalidVectorDimension(f"{own.size} components instead of {dimension}")
    if not np.isfinite(own).all():
        at = int(np.flatnonzero(~np.isfinite(own))[0])
        raise InvalidVectorData(f"component {at} is {'NaN' if math.isnan(own[at]) else '+Inf' if own[at] > 0 else '-Inf'}")
    return own.tolist()


def _encoded_size(value: Any, depth: int) -> int:
    if depth > MAX_METADATA_DEPTH:
        raise MetadataTooDeep(f"nested deeper than {MAX_METADATA_DEPTH}")
    if value is None or isinstance(value, bool):
        return 1
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValidationError(f"{value} isn't a 64-bit integer")
        return 9
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValidationError(f"metadata number {value} isn't finite")
        return 9
    if isinstance(value, str):
        return 5 + len(value.encode())
    if isinstance(value, bytes):
        return 5 + len(value)
    if isinstance(value, list | tuple):
        return 5 + sum(_encoded_size(x, depth + 1) for x in value)
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValidationError("metadata keys are strings")
        return 5 + sum(5 + len(k.encode()) + _encoded_size(x, depth + 1) for k, x in value.items())
    raise ValidationError(f"{type(value).__name__} isn't a metadata value")


def check_metadata(metadata: dict[str, Any] | None) -> None:
    if metadata is None:
        return
    if not isinstance(metadata, dict):
        raise ValidationError("metadata is a map")
    sizes = {k: 5 + len(str(k).encode()) + _encoded_size(x, 2) if isinstance(x, dict | list | tuple) else 5 + len(str(k).encode()) + _encoded_size(x, 1) for k, x in metadata.items()}
    if sum(sizes.values()) > MAX_METADATA_BYTES:
        raise MetadataTooLarge(f"{sum(sizes.values())} bytes; the largest field is {max(sizes, key=sizes.get)!r}")


def check_document(doc: Document, spec: CollectionSpec) -> list[float]:
    """Validates everything; the vector as stored."""
    check_id(doc.id, spec)
    vector = check_vector(doc.vector, spec.dimension)
    check_metadata(doc.metadata)
    if doc.content is not None and len(doc.content) > MAX_CONTENT_BYTES:
        raise MetadataTooLarge(f"content of {len(doc.content)} bytes; at most {MAX_CONTENT_BYTES}")
    return vector
