"""The log of a knowledge base: on the driver's standard error, and in a file where a folder for logs is set."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

LOGGER = logging.getLogger("quarry")
LINE = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def level(name: str) -> int:
    """A level by its name in any case; that of information for any other name."""
    return logging.getLevelNamesMapping().get(name.strip().upper(), logging.INFO)


def log_file(root: str, kb_id: str) -> Path:
    return Path(root, kb_id, "ingest.log")


@contextmanager
def kept(kb_id: str, root: str = "", least: int = logging.INFO) -> Iterator[logging.Logger]:
    """The logger, with its handlers for as long as the work on a knowledge base lasts."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if root:
        log_file(root, kb_id).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(log_file(root, kb_id), encoding="utf-8"))
    before = LOGGER.level
    LOGGER.setLevel(least)
    for handler in handlers:
        handler.setFormatter(logging.Formatter(LINE))
        LOGGER.addHandler(handler)
    try:
        yield LOGGER
    finally:
        LOGGER.setLevel(before)
        for handler in handlers:
            LOGGER.removeHandler(handler)
            handler.close()
