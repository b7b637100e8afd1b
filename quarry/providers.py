"""Embedding and language-model providers: callables that pickle, and readers for their replies."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.runtime import reach_workers
from quarry.settings import Settings

Embedder = Callable[[list[str]], list[list[float]]]

#: Names under which providers are known: a server of one's own, and hosted ones.
PROVIDERS = ("local", "hosted")

#: Keys under which replies hold vectors, texts, and states, in the order in which they are tried.
VECTOR_KEYS, ITEM_KEYS = ("embeddings", "embedding", "data", "result", "output"), ("embedding", "vector", "values")
TEXT_KEYS = ("text", "content", "result", "output")
CHOICE_PATHS = (("message", "content"), ("delta", "content"), ("text",))
CODE_KEYS, MESSAGE_KEYS = ("status_code", "status"), ("message", "error")


def _under(node: Any, *keys: str) -> list:
    """What a reply's dict or object has under the keys, but for nothing."""
    if node is None or isinstance(node, (str, bytes, int, float, list)):
        return []
    found = map(node.get, keys) if isinstance(node, dict) else (getattr(node, k, None) for k in keys)
    return [x for x in found if x is not None]


def _at(node: Any, path: tuple[str, ...]) -> Any:
    for key in path:
        node = next(iter(_under(node, key)), None)
    return node


def is_vector(value: Any) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(x, (int, float)) for x in value)


def vectors(payload: Any) -> list[list[float]]:
    """The vectors of a reply: those of the list that stands nearest to its top; items without one are passed over."""
    level = [payload]
    while level:
        for rows in filter(lambda node: isinstance(node, list), level):
            held = [next(filter(is_vector, (row, *_under(row, *ITEM_KEYS))), None) for row in rows]
            if found := [[float(x) for x in v] for v in held if v]:
                return found
        level = [below for node in level for below in _under(node, *VECTOR_KEYS)]
    return []


def _texts(node: Any) -> Iterator[str]:
    """All texts of a reply, in the order of the keys, choices last."""
    if isinstance(node, str):
        yield node.strip()
    for below in _under(node, *TEXT_KEYS):
        yield from _texts(below)
    for choice in (c for held in _under(node, "choices") if isinstance(held, list) for c in held):
        for path in CHOICE_PATHS:
            if isinstance(said := _at(choice, path), str):
                yield said.strip()


def content(payload: Any) -> str:
    """The first text of a reply that is not blank."""
    return next(filter(None, _texts(payload)), "")


def response_text(said: Any) -> str:
    """A model's message as text: texts, or the texts of its parts on a line each."""
    if isinstance(said, list):
        parts = (p if isinstance(p, str) else p.get("text") if isinstance(p, dict) else None for p in said)
        return "\n".join(p for p in parts if isinstance(p, str) and p).strip()
    return "" if said is None else str(said)


def status(payload: Any) -> tuple[int | None, str | None]:
    """State and message of a reply."""
    codes = [c for c in _under(payload, *CODE_KEYS) if isinstance(c, int)]
    messages = [str(m) for m in _under(payload, *MESSAGE_KEYS) if m]
    return next(iter(codes), None), next(iter(messages), None)


def base_url(url: str) -> str:
    """With /v1 at its end."""
    clean = url.rstrip("/")
    return clean if clean.endswith("/v1") else f"{clean}/v1"


@dataclass(frozen=True)
class HttpEmbedder:
    """A server that takes {model, input}; texts go in batches, and each must come back with a vector."""

    url: str
    model: str
    api_key: str | None = None
    batch: int = 16
    timeout: float = 60.0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        found: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            reply = _post(f"{base_url(self.url)}/embeddings", {"model": self.model, "input": part}, self.api_key, self.timeout)
            code, message = status(reply)
            got = vectors(reply)
            if (code or 0) >= 400 or len(got) != len(part):
                raise RuntimeError(f"embedding failed: {message or f'{len(got)} vectors for {len(part)} texts'}")
            found += got
        return found


@dataclass(frozen=True)
class HttpLlm:
    url: str
    model: str
    api_key: str | None = None
    temperature: float = 0.2
    timeout: float = 60.0

    def __call__(self, question: str, context: str) -> str:
        messages = [{"role": "system", "content": "Answer from the context and cite its labels."}, {"role": "user", "content": f"Context:\n{context}\n\nQuestion: {question}"}]
        reply = _post(f"{base_url(self.url)}/chat/completions", {"model": self.model, "messages": messages, "temperature": self.temperature}, self.api_key, self.timeout)
        code, message = status(reply)
        if (code or 0) >= 400:
            raise RuntimeError(f"model failed: {message}")
        return content(reply)


def embedder(settings: Settings) -> Embedder:
    """The provider that the settings name; without a base URL, hashed words, which need no server."""
    kind = settings.embedding.provider
    if kind not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {kind}")
    if not settings.embedding.url:
        return HashEmbedder()
    if not settings.embedding.model:
        raise ValueError("name an embedding model")
    # A local server takes all texts of a call at once, a hosted one so many.
    return HttpEmbedder(settings.embedding.url, settings.embedding.model, settings.embedding.key or settings.answering.key, 1 << 30 if kind == "local" else settings.embedding.batch)


def llm(settings: Settings) -> HttpLlm | None:
    """The language model that the settings name; None without one."""
    if not settings.answering.model:
        return None
    if settings.answering.provider not in PROVIDERS:
        raise ValueError(f"unknown language model provider {settings.answering.provider}")
    if not (url := settings.answering.url or settings.embedding.url):
        raise ValueError("the language model needs a base URL")
    return HttpLlm(url, settings.answering.model, settings.answering.key)


def _post(url: str, body: dict, key: str | None, timeout: float) -> Any:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as reply:
        return json.loads(reply.read())


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vectors from hashed words: the same text always gives the same vector. For tests and offline use."""

    size: int = 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.size
        for word in text.lower().split():
            h = hashlib.blake2b(word.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "big") % self.size] += 1.0 if h[4] & 1 else -1.0
        length = math.sqrt(sum(x * x for x in v))
        return [x / length for x in v] if length else [1.0, *[0.0] * (self.size - 1)]


def embed(rows: DataFrame, provider: Embedder, text: str = "text", column: str = "embedding") -> DataFrame:
    """rows with the provider's vector of each text; the provider is called on batches, inside the executors."""
    reach_workers(rows.sparkSession)
    schema = rows.drop(column).schema
    place = schema.names.index(text)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = provider([t or "" for t in batch.column(place).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float32()))], names=[*names, column])

    from pyspark.sql import types as T

    return rows.drop(column).mapInArrow(run, T.StructType([*schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))]))
