"""Settings, read from the environment once and passed along explicitly."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields
from pathlib import Path

TRUE, FALSE = frozenset(("1", "true", "yes", "y", "on")), frozenset(("0", "false", "no", "n", "off"))


def env_first(names: Iterable[str], default: str = "", env: Mapping[str, str] = os.environ) -> str:
    """The first of the variables that is not empty."""
    return next((v for n in names if (v := env.get(n))), default)


def env_bool(names: str | Iterable[str], default: bool, env: Mapping[str, str] = os.environ) -> bool:
    """The first of the variables that reads as yes or no."""
    for name in [names] if isinstance(names, str) else names:
        value = (env.get(name) or "").strip().lower()
        if value in TRUE or value in FALSE:
            return value in TRUE
    return default


def env_number(name: str, default: float, kind: type = int, env: Mapping[str, str] = os.environ) -> float:
    """A number, or the default where the variable is missing or no number."""
    try:
        return kind(env[name])
    except (KeyError, ValueError):
        return default


def env_path(names: Iterable[str], env: Mapping[str, str] = os.environ) -> Path | None:
    found = env_first(names, "", env)
    return Path(found) if found else None


# Defaults are fixed values: results depend on those of cutting and search.


@dataclass(frozen=True)
class Cutting:
    """How texts become chunks, in characters."""

    size: int = 800
    overlap: int = 100


@dataclass(frozen=True)
class Search:
    """How questions find chunks: whether by words as well, the constants of BM25, and how much each step takes."""

    words: bool = True
    k1: float = 1.2
    b: float = 0.75
    document_terms: int = 1024
    question_terms: int = 128
    dense_share: float = 0.7
    candidates: int = 24
    results: int = 10
    context: int = 12000
    #: Whether a sync keeps an inverted file of its vectors.
    lists: bool = False


@dataclass(frozen=True)
class Model:
    """A provider of vectors or answers."""

    provider: str = "hosted"
    model: str = ""
    url: str | None = None
    key: str | None = None
    batch: int = 16


@dataclass(frozen=True)
class Ocr:
    """Where images are read, and how often and long that is tried; pauses in milliseconds, times in seconds."""

    backend: str = "remote"
    url: str = ""
    field: str = "file"
    workers: int = 4
    timeout: float = 30.0
    page_timeout: float = 30.0
    retries: int = 1
    pause: int = 300


@dataclass(frozen=True)
class Logs:
    root: str = ""
    level: str = "INFO"
    embeddings: bool = True
    retrievals: bool = True


def _group(kind: type, env: Mapping[str, str]) -> dict:
    """A group's fields from QUARRY_<GROUP>_<FIELD>."""
    found = {}
    for f in fields(kind):
        name = f"QUARRY_{kind.__name__.upper()}_{f.name.upper()}"
        if f.type == "bool":
            found[f.name] = env_bool(name, f.default, env)
        elif f.type in ("int", "float"):
            found[f.name] = env_number(name, f.default, int if f.type == "int" else float, env)
        else:
            found[f.name] = env.get(name) or f.default
    return found


class Embedding(Model):
    """The provider of vectors."""


class Answering(Model):
    """The provider of answers."""


@dataclass(frozen=True)
class Settings:
    root: str = "."
    store: str = ""
    store_url: str = ""
    cutting: Cutting = Cutting()
    search: Search = Search()
    embedding: Model = Embedding()
    answering: Model = Answering()
    ocr: Ocr = Ocr()
    logs: Logs = Logs()

    @classmethod
    def from_env(cls, root: str = ".", env: Mapping[str, str] = os.environ) -> Settings:
        """Every group from the environment; a URL for embeddings selects the local provider unless one is named."""
        embedding, answering, ocr = (_group(kind, env) for kind in (Embedding, Answering, Ocr))
        embedding["provider"] = (env.get("QUARRY_EMBEDDING_PROVIDER") or ("local" if embedding["url"] else "hosted")).strip().lower()
        answering["provider"] = answering["provider"].strip().lower()
        ocr |= {"workers": max(1, ocr["workers"]), "retries": max(0, ocr["retries"]), "pause": max(0, ocr["pause"])}
        ocr["page_timeout"] = max(1.0, env_number("QUARRY_OCR_PAGE_TIMEOUT", ocr["timeout"], float, env))
        return cls(root, env.get("QUARRY_STORE") or "", env.get("QUARRY_STORE_URL") or "", Cutting(**_group(Cutting, env)), Search(**_group(Search, env)), Embedding(**embedding), Answering(**answering), Ocr(**ocr), Logs(**_group(Logs, env)))

    def path(self, *parts: str) -> str:
        """A table's place under the store's address, else its path, else the root; each may be any path that Spark reads."""
        return "/".join([(self.store_url or self.store or self.root).rstrip("/"), *parts])
