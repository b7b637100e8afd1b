"""The folder as a format, and the table function, against the readers over binaryFile."""

from __future__ import annotations

import pytest

from quarry.sources import datasource, files
from tests.test_sources import ROWS, docx, para, xlsx


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("folder")
    (root / "deep").mkdir()
    (root / "a.txt").write_text("plain text\r\nsecond line ")
    (root / "deep" / "b.csv").write_bytes("名,值\n1,2".encode("gb18030"))
    (root / "c.docx").write_bytes(docx(para("Hello") + para("docx world")))
    (root / "d.xlsx").write_bytes(xlsx(ROWS, "<si><t>head</t></si>"))
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "bad.xlsx").write_bytes(b"PK\x03\x04 broken")
    (root / "empty.txt").write_text(" \n")
    (root / "e.mp3").write_bytes(b"x")
    return root


def seen(df):
    return sorted((r["abs_path"], r["doc_pos"], r["text"], r["source_type"], r["page"], r["sheet"], r["row"], r["error"] is not None) for r in df.collect())


def test_the_format_reads_what_the_readers_read(spark, folder):
    datasource.register(spark)
    got = spark.read.format(datasource.NAME).load(str(folder))
    want = files.documents(files.files(spark, str(folder)).where("path not like '%.mp3'"))
    assert seen(got) == seen(want)
    assert {r["abs_path"].rsplit("/", 1)[1] for r in got.where("error is not null").collect()} == {"bad.docx", "bad.xlsx"}
    assert {r["source_type"] for r in got.collect()} == {"txt", "csv", "docx", "xlsx"}
    assert seen(spark.read.format(datasource.NAME).load(f"file://{folder}")) == seen(want)


def test_kinds_reach_the_listing(spark, folder):
    datasource.register(spark)
    read = lambda **how: spark.read.format(datasource.NAME).option("partitionBytes", "1").options(**how).load(str(folder))
    assert {r["source_type"] for r in read(kinds="docx, .CSV").collect()} == {"docx", "csv"}
    assert read(kinds="docx").rdd.getNumPartitions() == 2 and read().rdd.getNumPartitions() == 7, "a partition for each file, and none for files of other kinds"
    whole = read()
    assert whole.where("source_type = 'docx'").count() == 2 and whole.where("source_type = 'txt'").count() == 1, "a frame can be filtered again"


def test_parts_by_size(folder):
    reader = datasource.FolderReader({"path": str(folder), "partitionBytes": "60"})
    dealt = [p.paths for p in reader.partitions()]
    assert sorted(x for p in dealt for x in p) == [f.path for f in reader.listed()] and 1 < len(dealt) < 8
    (folder.parent / "none").mkdir(exist_ok=True)
    assert [p.paths for p in datasource.FolderReader({"path": str(folder.parent / "none")}).partitions()] == [[]]


def test_the_table_function(spark, folder):
    datasource.register(spark)
    files.files(spark, str(folder)).where("path not like '%.mp3'").createOrReplaceTempView("binary_files")
    got = spark.sql("SELECT d.* FROM binary_files f, LATERAL parse_file(f.path, f.content) d")
    assert seen(got) == seen(files.documents(files.files(spark, str(folder)).where("path not like '%.mp3'")))
    assert spark.sql("SELECT * FROM parse_file(null, null)").collect() == []
