"""Event log: what was asked of providers and found by retrieval, as rows of a table partitioned by kind."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import singledispatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schemas import EVENT
from quarry.settings import Settings


@singledispatch
def plain(value) -> object:
    """What stands in JSON for a value that JSON does not know: its text, unless its type has a rule below."""
    return str(value)


@plain.register(bytes)
@plain.register(bytearray)
def _size(value) -> object:
    return {"type": "bytes", "length": len(value)}


@plain.register(set)
@plain.register(frozenset)
def _sorted(value) -> object:
    return sorted(value, key=repr)


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=plain)


@dataclass(frozen=True)
class Embedding:
    """Texts that went to an embedding provider, for documents or for a question."""

    purpose: str
    provider: str
    model: str
    count: int
    sources: list[str] = field(default_factory=list)
    error: str | None = None

    def row(self) -> dict:
        told = asdict(self)
        error, purpose = told.pop("error"), told.pop("purpose")
        return {"kind": f"embedding_{purpose}", "request": as_json(told), "error": error}


@dataclass(frozen=True)
class Retrieval:
    """A question and what each side found for it."""

    kb_id: str
    query: str
    top_k: int
    fetch_k: int
    filters: list[str]
    hits: dict[str, list[dict]]

    def row(self) -> dict:
        asked = {k: v for k, v in asdict(self).items() if k != "hits"}
        return {"kind": "retrieval", "request": as_json(asked), "response": as_json({f"{side}_hits": found for side, found in self.hits.items()})}


@dataclass(frozen=True)
class Generation:
    """A question to a language model, and its answer or failure."""

    model: str
    question: str
    answer: str | None = None
    error: str | None = None

    def row(self) -> dict:
        return {"kind": "generation", "request": as_json({"model": self.model, "question": self.question}), "response": as_json(self.answer), "error": self.error}


Event = Embedding | Retrieval | Generation


class EventLog:
    """Appends events in one file a call; the settings say which kinds are wanted."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        settings = settings or Settings()
        self.spark, self.path = spark, path
        self.off = tuple(kind for kind, on in ((Embedding, settings.logs.embeddings), (Retrieval, settings.logs.retrievals)) if not on)

    def write(self, events: Iterable[Event]) -> None:
        now = datetime.now(timezone.utc)
        rows = [{"event_id": uuid.uuid4().hex, "at": now, "request": None, "response": None, "error": None} | e.row() for e in events if not isinstance(e, self.off)]
        if rows:
            self.spark.createDataFrame(rows, EVENT).coalesce(1).write.partitionBy("kind").mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """All events, with a name that sorts by time."""
        return self.spark.read.schema(EVENT).parquet(self.path).withColumn("name", F.concat_ws("_", compact_time(F.col("at")), "kind"))


def compact_time(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmssSSSSSS'Z'")
