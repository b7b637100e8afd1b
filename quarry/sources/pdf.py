"""A reader of PDF pages for sources.ocr.pdf_pages, where a PDF library is installed."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

Reader = Callable[[bytes], tuple[list[str], Callable[[int], bytes]]]


def available() -> bool:
    return importlib.util.find_spec("fitz") is not None


def reader(dpi: int = 200) -> Reader:
    """content -> (text of each page, what renders a page as PNG). The library is looked for in the worker, once a file comes."""

    def read(content: bytes) -> tuple[list[str], Callable[[int], bytes]]:
        import fitz

        book = fitz.open(stream=content, filetype="pdf")
        zoom = fitz.Matrix(dpi / 72, dpi / 72)
        return [page.get_text("text") for page in book], lambda i: book[i].get_pixmap(matrix=zoom).tobytes("png")

    return read
