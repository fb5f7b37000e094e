"""Row types of the knowledge index, and its default parameters."""

from __future__ import annotations

from dataclasses import dataclass

PARENT = "t string, x string, u string, host string, kind string, weight double"
CHILD = f"{PARENT}, pid bigint"
CACHE = "url string, etag string, last_modified string, fetched_at double, sha256 string, body string"
RESPONSE = "url string, call_no int, status int, content_type string, etag string, last_modified string, body string"
SECTION = "array<struct<heading:string,text:string>>"


@dataclass(frozen=True)
class ChunkSizes:
    parent_max: int = 1200
    parent_min: int = 60
    child_max: int = 350
    child_min: int = 60
    child_overlap: int = 53

    @property
    def child_step(self) -> int:
        return max(self.child_max - self.child_overlap, 60)


@dataclass(frozen=True)
class Bm25:
    k: float = 1.2
    b: float = 0.75
    d: float = 0.5


NEAR_DUP_COSINE = 0.95
CALIBRATION_SAMPLE, CALIBRATION_SEED = 500, 42
INT8_SCALE = 127
EMBED_MODEL, EMBED_MODEL_BROWSER, EMBED_DIMS, EMBED_BATCH = "BAAI/bge-small-en-v1.5", "Xenova/bge-small-en-v1.5", 384, 64
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
MAX_PAGES, DELAY_S, DEFAULT_SITE = 10_000, 0.5, "Knowledge Base"
CACHE_SAVE_INTERVAL, GET_TIMEOUT_S = 25, 15
FORMAT_VERSION = 2
