"""File formats, OCR replies, providers, settings and events."""

from __future__ import annotations

import importlib.machinery
import io
import json
import logging
import sys
import types
import zipfile
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from quarry import logs, providers
from quarry.operators import events
from quarry.settings import Answering, Embedding, Logs, Ocr, Settings, env_bool, env_first, env_number, env_path
from quarry.sources import files, ocr, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, text in members.items():
            box.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def docx(body: str) -> bytes:
    return zipped(**{"word__document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def para(text: str, extra: str = "") -> str:
    return f"<w:p><w:r><w:t>{text}</w:t>{extra}</w:r></w:p>"


def xlsx(rows: str, shared: str = "") -> bytes:
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped(
        **{
            "xl__workbook.xml": f'<workbook {S} xmlns:r="{rel}"><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>',
            "xl___rels__workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl__sharedStrings.xml": f"<sst {S}>{shared}</sst>",
            "xl__worksheets__sheet1.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>",
        }
    )


ROWS = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"/><row r="4"><c r="A4"><v>3.0</v></c><c r="B4" t="b"><v>1</v></c></row>'


def test_docx_pages_and_tables():
    table = "<w:tbl><w:tr><w:tc>" + para("a") + "</w:tc><w:tc>" + para(" ") + "</w:tc><w:tc>" + para("b") + "</w:tc></w:tr></w:tbl>"
    content = docx(para("one", '<w:br w:type="page"/>') + para("two") + table + para("three"))
    assert office.docx_pages(content) == ["one", "two\nthree\na\tb"]


def test_xlsx_rows():
    got = office.xlsx_rows(xlsx(ROWS, "<si><t>head</t></si>"))
    assert [(r["sheet"], r["row"], r["cells"], r["text"], r["is_header"]) for r in got] == [("One", 1, ["head", "", "x"], "head\t\tx", True), ("One", 4, ["3", "True"], "3\tTrue", False)]
    assert office.rows_to_text(got) == "[Sheet: One]\nhead\t\tx\n3\tTrue"


def test_first_extractor_wins():
    assert office.first_of(lambda b: None, lambda b: "x")(b"") == "x"
    with pytest.raises(RuntimeError):
        office.first_of(lambda b: None)(b"")


@pytest.mark.parametrize(
    ("payload", "wanted"),
    [
        ({"rec_texts": [" a ", "", 3, ["b", 0.9]]}, ["a", "b"]),
        ([{"rec_texts": [["t", 0.9]]}, {"res": {"rec_texts": ["u"]}}], ["t", "u"]),
        ({"result": [[[0, 0], ["hello", 0.9]]]}, ["hello"]),
        ({"res": {"rec_texts": "no list"}}, []),
        ({"a": "x", "b": [" y ", {"c": "z"}]}, ["x", "y", "z"]),
        (None, []),
    ],
)
def test_ocr_replies(payload, wanted):
    assert ocr.texts(payload) == wanted


def test_ocr_retry_and_backends():
    calls, slept = [], []

    def fails(timeout):
        calls.append(timeout)
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        ocr.with_retry(fails, ocr.Retry(most=2, backoff_ms=100, timeout=5), slept.append)
    assert calls == [5, 5, 5] and slept == [0.1, 0.2]
    with pytest.raises(ValueError, match="unknown"):
        ocr.engine("nothing")
    assert ocr.engine("PaddleOCR", local=lambda: lambda i, n, t: ["x"])(b"") == ["x"]
    assert ocr.local_texts(types.SimpleNamespace(json={"res": {"rec_texts": ["a", 1]}})) == ["a"] and ocr.local_texts(3) == []


def test_pdf_pages():
    reader = lambda content: (["", " "], lambda i: b"%d" % i)

    def engine(image, name, timeout):
        if image == b"0":
            raise OSError
        return [name, "x"]

    assert ocr.pdf_pages(b"", reader, engine, ocr.Retry(most=0)) == ["", "page_2.png\nx"]
    assert ocr.pdf_pages(b"", lambda c: ([" a ", ""], None), engine, ocr.Retry()) == ["a", ""]


def test_provider_replies():
    assert providers.vectors({"data": [{"embedding": [1, 2]}, {"x": 1}]}) == [[1.0, 2.0]]
    assert providers.vectors({"output": {"embeddings": [{"vector": [1]}, {"values": [2]}]}}) == [[1.0], [2.0]]
    assert providers.vectors([[1, 2], [3, 4]]) == [[1.0, 2.0], [3.0, 4.0]] and providers.vectors("x") == []
    assert providers.vectors(types.SimpleNamespace(output={"embeddings": [[1]]})) == [[1.0]]
    assert providers.content({"choices": [{"message": {"content": " hi "}}]}) == "hi" and providers.content({"output": {"text": "t"}}) == "t"
    assert providers.content({"choices": [{"text": "u"}]}) == "u" and providers.content(None) == "" and providers.content(5) == ""
    assert providers.response_text(["a", {"text": "b"}, 3, ""]) == "a\nb" and providers.response_text(None) == "" and providers.response_text(5) == "5"
    assert providers.status({"status_code": 500, "message": "m"}) == (500, "m") and providers.status(types.SimpleNamespace(status=1)) == (1, None)
    assert providers.base_url("http://x/") == "http://x/v1" == providers.base_url("http://x/v1")


def test_embedding_is_deterministic(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id int, text string")
    got = [r["embedding"] for r in providers.embed(rows, providers.HashEmbedder(8)).orderBy("id").collect()]
    assert got[0] == got[2] and len(got[1]) == 8 and abs(sum(x * x for x in got[0]) - 1) < 1e-6


def test_settings():
    s = Settings.from_env("/r", {"QUARRY_CUTTING_SIZE": "5", "QUARRY_SEARCH_DENSE_SHARE": "x", "QUARRY_SEARCH_WORDS": "off", "QUARRY_EMBEDDING_URL": "http://e", "QUARRY_OCR_WORKERS": "0"})
    assert (s.cutting.size, s.search.dense_share, s.search.words, s.embedding.provider, s.ocr.workers, s.search.results) == (5, 0.7, False, "local", 1, 10)
    assert s.path("a", "b") == "/r/a/b"
    env = {"A": "", "B": "yes", "N": "x"}
    assert env_first(["A", "B"], "d", env) == "yes" and env_bool(["A", "B"], False, env) and env_number("N", 3, int, env) == 3 and env_path(["A"], env) is None


def test_events(spark, tmp_path):
    assert json.loads(events.as_json({"b": b"xyz", "p": PurePosixPath("/a"), "l": (1, {2})})) == {"b": {"type": "bytes", "length": 3}, "p": "/a", "l": [1, [2]]}
    log = events.EventLog(spark, f"file://{tmp_path}/log")
    log.write([events.Retrieval("kb", "q", 1, 2, [], {"vector": [], "bm25": [{"doc_id": "x"}], "merged": []}), events.Embedding("query", "p", "m", 2, ["a"], "bad")])
    events.EventLog(spark, log.path, Settings(logs=Logs(embeddings=False))).write([events.Embedding("query", "p", "m", 2)])
    rows = log.read()
    assert sorted(r["kind"] for r in rows.collect()) == ["embedding_query", "retrieval"]
    found = rows.where("kind = 'retrieval'").first()
    assert json.loads(found["response"])["bm25_hits"] == [{"doc_id": "x"}] and found["name"][8] == "T" and found["name"].endswith("Z_retrieval")
    assert rows.where("kind = 'embedding_query'").first()["error"] == "bad"


def test_engines_from_settings():
    assert ocr.from_settings(Settings()) is None
    made = ocr.from_settings(Settings(ocr=Ocr(url="http://ocr", field="f")))()
    assert (made.url, made.field) == ("http://ocr", "f") and ocr.retry_from_settings(Settings(ocr=Ocr(retries=3))).most == 3
    assert ocr.timed(lambda image, name: [name])(b"", "x", 3.0) == ["x"] and ocr.timed(lambda image, name, timeout: [timeout])(b"", "x", 3.0) == [3.0]
    env = {"PPOCR_LANG": "ch", "OCR_USE_DOC_UNWARPING": "yes", "OCR_VERSION": "v"}
    assert ocr.local_options(env, ocr_version="w") == {"lang": "ch", "ocr_version": "w", "use_doc_orientation_classify": False, "use_doc_unwarping": True, "use_textline_orientation": False}


def test_image_files(tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    assert ocr.read_image(lambda image, name, timeout: [name, image.decode(), timeout], str(tmp_path / "a.png"), 2.0) == ["a.png", "x", 2.0]


def test_providers_from_settings():
    assert isinstance(providers.embedder(Settings()), providers.HashEmbedder) and providers.llm(Settings()) is None
    made = providers.embedder(Settings(embedding=Embedding("hosted", "m", "http://e", batch=7)))
    assert (made.url, made.model, made.batch) == ("http://e", "m", 7)
    for wrong in (Settings(embedding=Embedding("other")), Settings(embedding=Embedding(url="http://e"))):
        with pytest.raises(ValueError, match="embedding"):
            providers.embedder(wrong)
    for wrong in (Settings(answering=Answering(model="m")), Settings(answering=Answering("x", "m"))):
        with pytest.raises(ValueError, match="language model"):
            providers.llm(wrong)
    assert providers.llm(Settings(answering=Answering(model="m"), embedding=Embedding(url="http://e"))).model == "m"


def test_documents_of_each_format(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("知识库检索\r\nline".encode("gb18030"))
    (tmp_path / "b.csv").write_text(" x,y \n1,2\n")
    (tmp_path / "c.docx").write_bytes(docx(para("one", '<w:br w:type="page"/>') + para("two")))
    (tmp_path / "d.xlsx").write_bytes(xlsx(ROWS, "<si><t>head</t></si>"))
    (tmp_path / "e.png").write_bytes(b"img")
    (tmp_path / "f.pdf").write_bytes(b"pdf")
    (tmp_path / "g.docx").write_bytes(b"broken")
    (tmp_path / "h.txt").write_text("  ")
    found = files.files(spark, str(tmp_path))
    docs = files.documents(found, make_ocr=lambda: lambda image, name, timeout: [name, image.decode()]).cache()
    got = {(r["abs_path"].rsplit("/", 1)[1], r["doc_pos"]): (r["text"], r["page"], r["row"], r["error"] is not None) for r in docs.collect()}
    assert got == {
        ("a.txt", 0): ("知识库检索\nline", None, None, False),
        ("b.csv", 0): ("x,y \n1,2", None, None, False),
        ("c.docx", 0): ("one", 1, None, False),
        ("c.docx", 1): ("two", 2, None, False),
        ("d.xlsx", 0): ("3\tTrue", None, 4, False),
        ("e.png", 0): ("e.png\nimg", None, None, False),
        ("f.pdf", 0): (None, None, None, True),
        ("g.docx", 0): (None, None, None, True),
    }
    texts = {r["abs_path"].rsplit("/", 1)[1]: r["text"] for r in files.full_texts(docs).collect()}
    assert texts["c.docx"] == "=== Page 1 ===\n\none\n\n=== Page 2 ===\n\ntwo" and texts["d.xlsx"] == "[Sheet: One]\n3\tTrue"
    listed = files.listing(spark, str(tmp_path)).orderBy("abs_path").collect()
    assert [r["rel_path"] for r in listed][:2] == ["a.txt", "b.csv"] and listed[0]["suffix"] == ".txt"
    assert files.listing(spark, str(tmp_path)).where(F.length("hash") == 64).count() == 8


def test_logs_of_a_knowledge_base(tmp_path):
    assert (logs.level(" debug "), logs.level("nothing"), logs.level("")) == (logging.DEBUG, logging.INFO, logging.INFO)
    before = list(logs.LOGGER.handlers)
    with logs.kept("kb", str(tmp_path), logging.WARNING) as log:
        log.info("left out")
        log.warning("written")
    with logs.kept("kb", str(tmp_path)) as log:
        log.info("more")
    lines = logs.log_file(str(tmp_path), "kb").read_text().splitlines()
    assert [line.rsplit(" ", 1)[1] for line in lines] == ["written", "more"] and "WARNING quarry:" in lines[0]
    assert logs.LOGGER.handlers == before


def test_place_of_the_tables():
    assert Settings(root="/r/").path("tables") == "/r/tables" and Settings(root="/r", store="/s").path("t") == "/s/t"
    assert Settings.from_env("/r", {"QUARRY_STORE": "/s", "QUARRY_STORE_URL": "hdfs://u/"}).path("t") == "hdfs://u/t"


def test_doc_by_package(monkeypatch):
    assert office.doc_by_package(b"x") is None
    made = types.ModuleType("textract")
    made.__spec__ = importlib.machinery.ModuleSpec("textract", None)
    made.process = lambda path: open(path, "rb").read() + b"\xff"
    monkeypatch.setitem(sys.modules, "textract", made)
    assert office.doc_by_package(b"abc") == "abc\ufffd"
    made.process = lambda path: None
    assert office.doc_by_package(b"abc") == ""
