"""Command line: ingest a folder, ask a question, list knowledge bases."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry import logs, providers
from quarry.functions.text import parse_file_filters
from quarry.operators import answer, events, facets, inspect, retrieve
from quarry.operators.ingest import KnowledgeBase
from quarry.settings import Settings
from quarry.sources import office, pdf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("--root", required=True)
    ingest.add_argument("--kb")
    query = sub.add_parser("query")
    query.add_argument("question")
    query.add_argument("--root")
    query.add_argument("--kb")
    query.add_argument("--top-k", type=int, default=0)
    query.add_argument("--file", default="")
    sub.add_parser("list")
    look = sub.add_parser("inspect", help="chunks, or with --schema what the table holds")
    look.add_argument("--doc")
    look.add_argument("--contains", action="store_true")
    look.add_argument("--chunk", type=int)
    look.add_argument("--limit", type=int, default=20)
    look.add_argument("--width", type=int, default=200)
    look.add_argument("--schema", action="store_true")
    return p


def inspected(kb: KnowledgeBase, args: argparse.Namespace) -> list[dict]:
    """Rows to print: chunks that match, or the fields of the chunk table and its vectors."""
    chunks = kb.chunks.read()
    if args.schema:
        fields = [{"field": name, "type": kind} for name, kind in inspect.payload_schema(chunks)]
        return fields + [r.asDict() for r in inspect.vector_config(chunks).collect()]
    where = F.lit(True)
    if args.doc is not None:
        where = where & inspect.matches_doc(F.col("doc_id"), args.doc, args.contains)
    if args.chunk is not None:
        where = where & inspect.matches_chunk(F.col("chunk_id"), args.chunk)
    return [r.asDict() for r in inspect.show(chunks, where, args.limit, args.width).collect()]


def kb_for_query(kb: KnowledgeBase, root: str | None, kb_id: str | None) -> str:
    if kb_id:
        return kb_id
    row = kb.paths.read().where(F.col("root") == root).first() if root else None
    if row is None:
        raise SystemExit("name a knowledge base, or a root that has one")
    return row["kb_id"]


def parsed_filters(spark: SparkSession, raw: str) -> list[str]:
    return spark.range(1).select(parse_file_filters(F.lit(raw)).alias("f")).first()["f"]


def ask(kb: KnowledgeBase, question: str, kb_ids: list[str], top_k: int = 0, file_filter: str = "") -> dict:
    """Search one or several knowledge bases, keep the files asked for, and answer from what is left."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    s, log = kb.settings, kb.events
    chunks = kb.chunks.read(*kb_ids)
    k = top_k or s.search.results
    per = retrieve.share(k, len(kb_ids))
    vector = kb.embedded(question)
    lists = kb.lists(kb_ids[0]) if s.search.lists and len(kb_ids) == 1 else None
    if lists:
        found = retrieve.hybrid(chunks, question, vector, kb_ids[0], s, per, index=kb.index(*kb_ids), vectors=lists).withColumn("kb_id", F.lit(kb_ids[0])).cache()
    else:
        found = retrieve.hybrid_each(chunks, question, vector, kb_ids, s, per, index=kb.index(*kb_ids)).cache()
    top = retrieve.across(found, kb_ids, k).join(chunks.drop("kb_id", "embedding"), "chunk_key")
    filters = parsed_filters(kb.spark, file_filter)
    hits = facets.filter_files(top.withColumn("rank", (F.col("kb_order") * 1_000_000 + F.col("rank")).cast("int")), filters).cache()
    for name in kb_ids:
        rows = [r.asDict() for r in found.where(F.col("kb_id") == name).orderBy("rank").collect()]
        sides = {side: [r for r in rows if r[score] is not None] for side, score in (("vector", "dense_score"), ("bm25", "sparse_score"), ("merged", "score"))}
        log.write([events.Retrieval(name, question, per, max(per, s.search.candidates), filters, sides)])
    records = None
    for name in kb_ids:
        one = kb.records(name).read()
        records = one if records is None else records.unionByName(one)
    model = providers.llm(s)
    got = answer.answer(question, hits, model, s.search.context, records)
    if model and got.citations:
        log.write([events.Generation(s.answering.model, question, got.answer, got.error)])
    return {"answer": got.answer, "citations": got.citations, "context": got.context, "error": got.error, "files": [tuple(r) for r in facets.facet_files(hits).collect()]}


def ingested(kb: KnowledgeBase, root: str, kb_id: str | None) -> str:
    """A sync with every reader there is, and its log; the run's id."""
    with logs.kept(kb_id or root.strip("/").replace("/", "_"), kb.settings.logs.root, logs.level(kb.settings.logs.level)) as log:
        try:
            run = kb.ingest(root, kb_id, providers.embedder(kb.settings), pdf=pdf.reader() if pdf.available() else None, doc=office.first_of(office.doc_by_package, office.doc_by_office))
        except Exception:
            log.exception("sync of %s failed", root)
            raise
        log.info("run %s of %s: %s", run, root, {r["bucket"]: r["count"] for r in kb.reports.read().where(F.col("run_id") == run).groupBy("bucket").count().collect()})
    return run


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    kb = KnowledgeBase(spark, Settings.from_env())
    if args.command == "ingest":
        print(ingested(kb, args.root, args.kb))
    elif args.command == "inspect":
        for row in inspected(kb, args):
            print(json.dumps(row, default=str, ensure_ascii=False))
    elif args.command == "list":
        for row in facets.list_kbs(kb.paths.read(), kb.manifests.read(), kb.paths.read()).collect():
            print(json.dumps(row.asDict(), default=str, ensure_ascii=False))
    else:
        print(json.dumps(ask(kb, args.question, [kb_for_query(kb, args.root, args.kb)], args.top_k, args.file), default=str, ensure_ascii=False, indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
