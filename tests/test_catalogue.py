"""Every query of the reference's operators against its SQL oracle."""

from __future__ import annotations

import pytest

from quarry.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    got = rows_of(QUERIES[name](spark, sf_dir))
    assert got[1], "no rows"
    assert got == rows_of_sql(duck, ORACLE_SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_orders_are_chunked(spark, duck, sf_dir):
    got = [r["text"] for r in QUERIES["chunk_table_rows"](spark, sf_dir).collect()]
    assert len(got) == duck.sql("SELECT count(*) FROM orders").fetchall()[0][0]
    assert {"[DATE=" in t for t in got} == {True, False}


def test_whole_texts_are_joined(spark, duck, sf_dir):
    got = {r["doc_id"]: r["pages"] for r in QUERIES["page_join"](spark, sf_dir).collect()}
    assert all(text.strip() in got[doc] for doc, text in duck.sql("SELECT doc_id, text FROM documents").fetchall())
