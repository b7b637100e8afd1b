"""Incremental sync, questions and streams end to end."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.operators.ingest import KnowledgeBase
from quarry.providers import HashEmbedder
from quarry.settings import Cutting, Search, Settings
from quarry.sources import files
from quarry.streaming.ingest import watch


@pytest.fixture
def kb(spark, tmp_path):
    return KnowledgeBase(spark, Settings(root=f"file://{tmp_path}/kb", cutting=Cutting(40, 5)))


def touch(path, at):
    os.utime(path, (at, at))


def test_sync_is_incremental(spark, kb, tmp_path):
    docs = tmp_path / "My Docs"
    docs.mkdir()
    (docs / "a.txt").write_text("apples are red\n\nChapter 2\nbananas are yellow")
    (docs / "b.txt").write_text("cherries are dark")
    (docs / "c.mp3").write_bytes(b"x")
    (docs / "d.txt").write_text("   ")
    for name in ("a.txt", "b.txt"):
        touch(docs / name, 1_700_000_000)
    first = kb.report(kb.ingest(str(docs), provider=HashEmbedder())).first()
    assert sorted(r["abs_path"].rsplit("/", 1)[1] for r in first["ingested"]) == ["a.txt", "b.txt"]
    assert [(r["reason"], r["status"]) for r in first["skipped"]] == [("unsupported", "skipped")]
    assert [r["reason"] for r in first["errors"]] == ["no_text"]
    name = kb.paths.read().first()["kb_id"]
    assert name == "my_docs"
    assert kb.manifests.read().first()["doc_count"] == 2 and kb.chunks.read().count() == 3

    (docs / "a.txt").write_text("apples are green")
    (docs / "b.txt").unlink()
    second = kb.report(kb.ingest(str(docs), provider=HashEmbedder())).first()
    assert [r["abs_path"].rsplit("/", 1)[1] for r in second["ingested"]] == ["a.txt"]
    assert "source_missing" in [r["reason"] for r in second["skipped"]]
    texts = sorted(r["text"] for r in kb.chunks.read().collect())
    assert texts == ["apples are green", "cherries are dark"], "chunks of deleted files stay, changed ones are replaced"
    gone = kb.records(name).read().where("source_deleted").collect()
    assert [r["rel_path"] for r in gone] == ["b.txt"]

    got = cli.ask(kb, "cherries", [name], 2)
    assert any(c["source_deleted"] for c in got["citations"]) and "cherries are dark" in got["context"]
    assert cli.ask(kb, "cherries", [name], 2, "a.txt")["files"] == [("a.txt", 1)]
    assert cli.kb_for_query(kb, str(docs), None) == name
    with pytest.raises(SystemExit):
        cli.kb_for_query(kb, "/nowhere", None)
    third = kb.report(kb.ingest(str(docs), provider=HashEmbedder())).first()
    assert third["ingested"] == [] and kb.chunks.read().count() == 2


def test_stream_syncs_new_files(spark, kb, tmp_path):
    docs = tmp_path / "stream"
    docs.mkdir()
    (docs / "a.txt").write_text("one text")
    watch(spark, kb, str(docs), str(tmp_path / "cp"), provider=HashEmbedder(), once=True).awaitTermination()
    (docs / "b.txt").write_text("two texts")
    watch(spark, kb, str(docs), str(tmp_path / "cp"), provider=HashEmbedder(), once=True).awaitTermination()
    assert sorted(r["text"] for r in kb.chunks.read().select(F.col("text")).collect()) == ["one text", "two texts"]


def test_a_batch_touches_its_own_files(spark, kb, tmp_path, monkeypatch):
    docs, cp = tmp_path / "stream", str(tmp_path / "cp")
    docs.mkdir()
    for i in range(6):
        (docs / f"f{i}.txt").write_text(f"text number {i}")
    opened = []
    whole, some = files.listing, files.some
    monkeypatch.setattr(files, "listing", lambda *a, **k: opened.append("folder") or whole(*a, **k))
    monkeypatch.setattr(files, "some", lambda spark, root, paths: opened.append(sorted(p.rsplit("/", 1)[1] for p in paths)) or some(spark, root, paths))
    run = lambda: watch(spark, kb, str(docs), cp, provider=HashEmbedder(), once=True).awaitTermination()
    run()
    (docs / "f2.txt").write_text("another text")
    touch(docs / "f2.txt", 1_900_000_000)
    (docs / "new.txt").write_text("new text")
    run()
    # Each file is opened twice, to be hashed and to be parsed.
    assert opened == [[f"f{i}.txt" for i in range(6)]] * 2 + [["f2.txt", "new.txt"]] * 2, "no other file is hashed or opened"
    run()
    assert len(opened) == 4
    records = lambda: {(r["rel_path"], r["hash"], r["mtime"], r["status"]) for r in kb.records("stream").read().collect()}
    streamed = records()
    monkeypatch.setattr(files, "listing", whole)
    report = kb.report(kb.ingest(str(docs), provider=HashEmbedder())).first()
    assert report["ingested"] == [] and records() == streamed and len(streamed) == 7, "the records of a full sync"
    assert sorted(r["text"] for r in kb.chunks.read().collect()) == sorted([f"text number {i}" for i in (0, 1, 3, 4, 5)] + ["another text", "new text"])


def test_questions_read_the_lists_of_their_chunks(spark, tmp_path):
    held = KnowledgeBase(spark, Settings(root=f"file://{tmp_path}/kb", search=Search(lists=True)))
    docs = tmp_path / "docs"
    docs.mkdir()
    for i, text in enumerate(("apples are red", "bananas are yellow", "cherries are dark")):
        (docs / f"{i}.txt").write_text(text)
    held.ingest(str(docs), provider=HashEmbedder())
    assert held.lists("docs").rows(spark).count() == 3
    got = cli.ask(held, "bananas are yellow", ["docs"], 1)
    assert "bananas are yellow" in got["context"] and got["files"] == [("1.txt", 1)]
    held.chunks.change(held.chunks.read("docs").limit(0), spark.createDataFrame([(str(docs), "1.txt")], "root string, doc_id string"), "docs")
    assert held.lists("docs") is None, "lists of other chunks are not read"


def test_arguments():
    args = cli.parser().parse_args(["query", "q", "--kb", "k", "--top-k", "3"])
    assert (args.command, args.question, args.kb, args.top_k) == ("query", "q", "k", 3)
