"""Word and Excel files by the standard library: both are zipped XML."""

from __future__ import annotations

import importlib.util
import io
import posixpath
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _paragraph(p: ElementTree.Element) -> str:
    parts = {f"{W}t": lambda e: e.text or "", f"{W}tab": lambda e: "\t", f"{W}br": lambda e: "" if e.get(f"{W}type") == "page" else "\n", f"{W}cr": lambda e: "\n"}
    return "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)


def _breaks(p: ElementTree.Element) -> bool:
    return any(e.tag == f"{W}lastRenderedPageBreak" or (e.tag == f"{W}br" and e.get(f"{W}type") == "page") for e in p.iter())


def docx_pages(content: bytes) -> list[str]:
    """Paragraphs by page (a break counts from the next paragraph on), then all tables, cells parted by tabs, on the last page."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        body = ElementTree.fromstring(box.read("word/document.xml")).find(f"{W}body")
    pages: list[list[str]] = [[]]
    for p in body.findall(f"{W}p") if body is not None else []:
        text = _paragraph(p).strip()
        if text:
            pages[-1].append(text)
        if _breaks(p):
            pages.append([])
    for table in body.findall(f"{W}tbl") if body is not None else []:
        for row in table.findall(f"{W}tr"):
            cells = ["\n".join(_paragraph(p) for p in cell.findall(f"{W}p")).strip() for cell in row.findall(f"{W}tc")]
            line = "\t".join(c for c in cells if c)
            if line:
                pages[-1].append(line)
    return ["\n".join(lines) for lines in pages]


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _number(text: str) -> str:
    """A number as a spreadsheet shows it: whole ones without a fraction."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def xlsx_rows(content: bytes) -> list[dict]:
    """All rows of all sheets that are not blank: sheet, row (from 1), cells as text, their line, and whether it is a sheet's first."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        names = set(box.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{S}t")) for item in ElementTree.fromstring(box.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(box.read("xl/_rels/workbook.xml.rels"))}
        found: list[dict] = []
        for sheet in ElementTree.fromstring(box.read("xl/workbook.xml")).iter(f"{S}sheet"):
            target = targets[sheet.get(f"{R}id")]
            member = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            found += shaped_rows(sheet.get("name"), _cells(ElementTree.fromstring(box.read(member)), shared))
    return found


def _cells(sheet: ElementTree.Element, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
    number = 0
    for row in sheet.iter(f"{S}row"):
        number = int(row.get("r") or number + 1)
        cells: list[str] = []
        for cell in row.findall(f"{S}c"):
            at = _column(cell.get("r")) if cell.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            kind, value = cell.get("t", "n"), cell.find(f"{S}v")
            text = (value.text or "") if value is not None else ""
            if kind == "s":
                text = shared[int(text)] if text else ""
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{S}t"))
            elif kind == "b":
                text = "True" if text == "1" else "False"
            elif kind == "n" and text:
                text = _number(text)
            cells[at] = text
        yield number, cells


def shaped_rows(sheet: str, rows: Iterator[tuple[int, list[str]]]) -> list[dict]:
    found = []
    for number, cells in rows:
        clean = [c.strip() for c in cells]
        if any(clean):
            found.append({"sheet": sheet, "row": number, "cells": clean, "text": "\t".join(clean).rstrip(), "is_header": not found})
    return found


def legacy_rows(content: bytes) -> list[dict]:
    """Rows of an .xls file, where a reader for them is installed."""
    if importlib.util.find_spec("xlrd") is None:
        raise RuntimeError("no reader for .xls files")
    import xlrd

    book = xlrd.open_workbook(file_contents=content)
    return [r for s in book.sheets() for r in shaped_rows(s.name, ((i + 1, [_number(str(v)) if isinstance(v, float) else str(v) for v in s.row_values(i)]) for i in range(s.nrows)))]


def rows_to_text(rows: list[dict]) -> str:
    """Rows as lines, each sheet announced where it begins."""
    lines, sheet = [], None
    for row in rows:
        if row["sheet"] != sheet:
            sheet = row["sheet"]
            lines.append(f"[Sheet: {sheet}]")
        lines.append(row["text"])
    return "\n".join(lines)


def doc_by_office(content: bytes, timeout: float = 120) -> str | None:
    """The text of a .doc file by an office suite, or None without one."""
    program = shutil.which("soffice") or shutil.which("libreoffice")
    if not program:
        return None
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder, "in.doc")
        source.write_bytes(content)
        done = subprocess.run([program, "--headless", "--convert-to", "txt:Text", "--outdir", folder, str(source)], capture_output=True, timeout=timeout, check=False)
        out = Path(folder, "in.txt")
        return out.read_text("utf-8", "replace") if done.returncode == 0 and out.exists() else None


def doc_by_package(content: bytes) -> str | None:
    """The text of a .doc file by a text extraction package, or None where it is not installed."""
    if importlib.util.find_spec("textract") is None:
        return None
    import textract

    with tempfile.NamedTemporaryFile(suffix=".doc") as held:
        held.write(content)
        held.flush()
        return (textract.process(held.name) or b"").decode("utf-8", "replace")


def first_of(*extractors: Callable[[bytes], str | None]) -> Callable[[bytes], str]:
    """An extractor that takes the first answer of several."""

    def run(content: bytes) -> str:
        for extract in extractors:
            if (text := extract(content)) is not None:
                return text
        raise RuntimeError("no extractor could read the file")

    return run
