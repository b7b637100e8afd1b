"""OCR engines: a callable (image bytes, name, timeout) -> lines. Here: a client for a server, retries, and what replies look like."""

from __future__ import annotations

import inspect
import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass
from functools import partial
from itertools import chain
from typing import Any

from quarry.settings import Settings, env_bool, env_first

Engine = Callable[[bytes, str, float | None], list[str]]

#: Names under which engines are known, and keys under which replies hold their results.
REMOTE, LOCAL = ("remote", "server", "http"), ("local", "ppocr", "paddle", "paddleocr")
RESULT_KEYS = ("res", "result", "data", "output", "outputs", "results", "pages")


@dataclass(frozen=True)
class Retry:
    most: int = 1
    backoff_ms: float = 300
    timeout: float | None = 30.0
    concurrency: int = 4


def with_retry(call: Callable[[float | None], list[str]], how: Retry, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """The call, tried again after pauses that double; the last failure is raised."""
    for attempt in range(how.most + 1):
        try:
            return call(how.timeout)
        except Exception:  # noqa: BLE001  whatever an engine raises may pass
            if attempt == how.most:
                raise
            sleep(how.backoff_ms / 1000 * 2**attempt)
    return []


class Lazy:
    """An engine that is built at its first use."""

    def __init__(self, make: Callable[[], Engine]):
        self._make, self._engine = make, None

    def __call__(self, image: bytes, name: str = "image.png", timeout: float | None = None) -> list[str]:
        if self._engine is None:
            self._engine = self._make()
        return self._engine(image, name, timeout)


def takes_timeout(call: Callable) -> bool:
    """Whether an engine can be given a timeout."""
    try:
        inspect.signature(call).bind(b"", "", None)
    except TypeError:
        return False
    except ValueError:  # a callable that does not tell
        return True
    return True


def timed(call: Callable) -> Engine:
    """An engine of three arguments, whether or not the one given knows of timeouts."""
    return call if takes_timeout(call) else lambda image, name="image.png", timeout=None: call(image, name)


def engine(backend: str, url: str = "", field: str = "file", local: Callable[[], Callable] | None = None) -> Engine:
    name = backend.strip().lower()
    if name in REMOTE:
        return RemoteEngine(url, field)
    if name in LOCAL:
        return Lazy(lambda: timed((local or LocalEngine)()))
    raise ValueError(f"unknown OCR backend {backend}")


def from_settings(settings: Settings) -> Callable[[], Engine] | None:
    """What builds the engine that the settings name, in a worker; None where they name no server and no local engine."""
    if settings.ocr.backend.strip().lower() in REMOTE and not settings.ocr.url:
        return None
    return partial(engine, settings.ocr.backend, settings.ocr.url, settings.ocr.field)


def retry_from_settings(settings: Settings) -> Retry:
    return Retry(settings.ocr.retries, settings.ocr.pause, settings.ocr.page_timeout, settings.ocr.workers)


def read_image(engine_: Engine, path: str, timeout: float | None = None) -> list[str]:
    """The lines of an image file that the worker can open."""
    with open(path, "rb") as held:
        return engine_(held.read(), os.path.basename(path), timeout)


class RemoteEngine:
    def __init__(self, url: str, field: str = "file", opener: Callable = urllib.request.urlopen):
        self.url, self.field, self.open = url, field, opener

    def __call__(self, image: bytes, name: str = "image.png", timeout: float | None = None) -> list[str]:
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="{self.field}"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'
        body = head.encode() + image + f"\r\n--{mark}--\r\n".encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": f"multipart/form-data; boundary={mark}"})
        try:
            with self.open(request, timeout=timeout) as reply:
                return texts(json.loads(reply.read()))
        except (urllib.error.URLError, ValueError) as failure:
            raise RuntimeError(f"OCR failed: {failure}") from failure


def _search(node: Any, take: Callable[[Any], list[str] | None], members: Callable[[Any], list], every: bool) -> list[str] | None:
    """What `take` finds in a node, or else in its members: in those of a list together, in those of a dict the first that has something (or together, too)."""
    if (taken := take(node)) is not None:
        return taken
    inner = (found for m in members(node) if (found := _search(m, take, members, every)) is not None)
    if every or isinstance(node, list):
        parts = list(inner)
        return list(chain.from_iterable(parts)) if parts else None
    return next(inner, None)


def _filled(values: Iterable) -> list[str]:
    return [v.strip() for v in values if isinstance(v, str) and v.strip()]


def _named(node: Any) -> list[str] | None:
    """The texts under rec_texts, each a text or a list that begins with one."""
    match node:
        case {"rec_texts": list() | tuple() as held}:
            return _filled(v[0] if isinstance(v, (list, tuple)) and v else v for v in held)
        case {"rec_texts": _}:
            return []
    return None


def _written(node: Any) -> list[str] | None:
    """A text, or the lines [box, [text, score]] of a list of lists."""
    match node:
        case str():
            return _filled([node])
        case [list() | tuple(), *_]:
            return [line[1][0] for line in node if isinstance(line, (list, tuple)) and len(line) > 1 and isinstance(line[1], (list, tuple)) and line[1] and isinstance(line[1][0], str) and line[1][0]] or None
    return None


def texts(payload: Any) -> list[str]:
    """The lines of an OCR reply: what it has under the known keys, else lines or texts from anywhere, where `result` stands for the whole of a dict that has it."""
    listed = lambda node, held: node if isinstance(node, list) else held(node) if isinstance(node, dict) else []
    by_key = _search(payload, _named, lambda node: listed(node, lambda d: [d[k] for k in RESULT_KEYS if k in d]), False)
    if by_key is not None:
        return by_key
    return _search(payload, _written, lambda node: listed(node, lambda d: [d["result"]] if "result" in d else list(d.values())), True) or []


def local_texts(result: Any) -> list[str]:
    """The lines of a local engine's result object."""
    match getattr(result, "json", result):
        case {"res": {"rec_texts": list() | tuple() as held}} | {"rec_texts": list() | tuple() as held}:
            return [t for t in held if isinstance(t, str)]
    return []


#: Options of the local engine that are off unless they are set, and variables that set them and the others.
LOCAL_FLAGS = ("use_doc_orientation_classify", "use_doc_unwarping", "use_textline_orientation")
LOCAL_PREFIXES, LOCAL_NAMES = ("PPOCR_", "OCR_"), {"lang": "LANG", "ocr_version": "VERSION"}


def local_options(env: Mapping[str, str], **given: Any) -> dict[str, Any]:
    """Options of the local engine: as given, else from the environment, else off."""
    named = {option: env_first([f"{p}{name}" for p in LOCAL_PREFIXES], "", env) for option, name in LOCAL_NAMES.items()}
    flags = {flag: env_bool([f"{p}{flag.upper()}" for p in LOCAL_PREFIXES], False, env) for flag in LOCAL_FLAGS}
    return {**flags, **{k: v for k, v in named.items() if v}, **given}


class LocalEngine:
    """An engine that runs in the worker, if its package is installed there."""

    def __init__(self, keep: Callable[[Any], None] | None = None, **options: Any):
        import paddleocr

        self._model, self._keep = paddleocr.PaddleOCR(**local_options(os.environ, **options)), keep

    def __call__(self, image: bytes, name: str = "image.png") -> list[str]:
        import cv2
        import numpy as np

        return self.read(cv2.imdecode(np.frombuffer(image, np.uint8), cv2.IMREAD_COLOR))

    def read(self, source: Any) -> list[str]:
        """The lines of a decoded image, or of a file by its path; `keep` gets each result, and may fail."""
        found = list(self._model.predict(input=source))
        for result in found if self._keep else ():
            with suppress(Exception):
                self._keep(result)
        return [line for result in found for line in local_texts(result)]


def pdf_pages(content: bytes, reader: Callable, ocr: Engine | None, how: Retry) -> list[str]:
    """Embedded text if any page has some, else each page's image through OCR; a page that fails is blank, in its place.

    reader(content) -> (texts of pages, function that renders page i).
    """
    embedded, render = reader(content)
    embedded = [t.strip() for t in embedded]
    if any(embedded) or ocr is None:
        return embedded

    def one(i: int) -> str:
        try:
            return "\n".join(with_retry(lambda timeout: ocr(render(i), f"page_{i + 1}.png", timeout), how))
        except Exception:  # noqa: BLE001
            return ""

    with ThreadPoolExecutor(max(1, min(how.concurrency, len(embedded) or 1))) as pool:
        return list(pool.map(one, range(len(embedded))))
