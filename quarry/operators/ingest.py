"""Incremental synchronisation of a folder with a knowledge base."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import chunking, ivf, manifest, segments, store
from quarry.operators.embeddings import EmbeddingCache
from quarry.operators.events import Embedding, EventLog
from quarry.providers import Embedder, embedder
from quarry.runtime import materialise
from quarry.settings import Settings
from quarry.sources import files, ocr


@dataclass
class KnowledgeBase:
    """The tables of all knowledge bases under one root path."""

    spark: SparkSession
    settings: Settings

    def table(self, name: str, schema: str = "") -> store.Table:
        return store.Table(self.spark, self.settings.path("tables", name), schema)

    @property
    def chunks(self) -> segments.Indexed:
        """Chunks and their index, a table for each knowledge base."""
        return segments.Indexed(self.table("chunks", schemas.CHUNK), ("root", "doc_id"), self.settings.search.k1, self.settings.search.b, self.settings.search.document_terms)

    @property
    def paths(self) -> store.Table:
        return self.table("kb_paths", schemas.KB_PATHS)

    @property
    def reports(self) -> store.Deltas:
        return store.Deltas(self.table("reports", schemas.INGEST_ITEM), ("run_id",))

    @property
    def manifests(self) -> store.Table:
        return self.table("index_manifests", schemas.INDEX_MANIFEST)

    def records(self, kb_id: str) -> store.Deltas:
        return store.Deltas(self.table(f"records/{kb_id}", schemas.FILE_RECORD), ("abs_path",))

    @property
    def texts(self) -> store.Deltas:
        """The whole text of each file, a table for each knowledge base."""
        return store.Deltas(self.table("processed", "abs_path string, text string"), ("abs_path",))

    def index(self, *kb_ids: str) -> segments.Segments | None:
        """The stored index of the knowledge bases; None before the first sync of them all."""
        return self.chunks.index(*kb_ids)

    def lists(self, kb_id: str) -> ivf.Index | None:
        """The inverted file of a knowledge base's vectors, if there is one of its chunks as they are now."""
        held = self.table("lists")
        for folder in held.folders(kb_id):
            if [r["folder"] for r in self.spark.read.parquet(f"{folder}/of").orderBy("nth").collect()] == self.chunks.table.held(kb_id):
                return ivf.Index.read(self.spark, folder)
        return None

    def build_lists(self, kb_id: str) -> None:
        """Fit and write the inverted file, with the names of the folders of chunks that it stands for."""
        now = self.chunks.table.held(kb_id)

        def write(folder: str) -> None:
            ivf.build(self.chunks.read(kb_id).select("chunk_key", "embedding"), folder)
            self.spark.createDataFrame(list(enumerate(now)), "nth int, folder string").coalesce(1).write.parquet(f"{folder}/of")

        self.table("lists").publish(write, kb_id)

    @property
    def vectors(self) -> EmbeddingCache:
        return EmbeddingCache(self.table("vectors", EmbeddingCache.SCHEMA), self.settings.embedding.provider, self.settings.embedding.model)

    @property
    def events(self) -> EventLog:
        return EventLog(self.spark, self.settings.path("tables", "events"), self.settings)

    def embedded(self, question: str) -> list[float]:
        """The question's vector, from the provider that the settings name."""
        told = Embedding("query", self.settings.embedding.provider, self.settings.embedding.model, 1)
        try:
            found = embedder(self.settings)([question])[0]
        except Exception as failure:
            self.events.write([replace(told, error=str(failure))])
            raise
        self.events.write([told])
        return found

    def resolve(self, root: str, kb_id: str | None = None) -> str:
        """The knowledge base of a root; a new root is bound to a new one, or to the one named."""
        bindings = self.paths.read()
        asked = self.spark.createDataFrame([(root, kb_id)], "root string, wanted string")
        found = manifest.resolve_kb_ids(asked, bindings).first()["kb_id"]
        kept = bindings.where(F.col("root") != root)
        self.paths.write(kept.unionByName(self.spark.createDataFrame([(root, found)], schemas.KB_PATHS)))
        return found

    def ingest(self, root: str, kb_id: str | None = None, provider: Embedder | None = None, make_ocr: Callable | None = None, pdf: Callable | None = None, doc: Callable | None = None, only: DataFrame | None = None) -> str:
        """Sync: parse what is new or changed, mark what is gone, replace chunks by key, derive the index. Returns the run's id.

        With `only`, a listing of some files, no other file is looked at: none is listed, hashed or marked as gone.
        """
        if "://" not in root and not root.startswith("/"):
            raise ValueError("the root must be an absolute path")
        kb = self.resolve(root, kb_id)
        run_id = uuid.uuid4().hex
        # Written once: a lost executor hashes no file twice, and reads none again for OCR or a provider.
        listing = materialise(files.listing(self.spark, root) if only is None else only, "listing")
        old = self.records(kb).read()
        old = old if only is None else old.join(listing.select("abs_path"), "abs_path", "left_semi")
        planned = materialise(manifest.plan(listing, old, root), "planned")
        todo = planned.where("action = 'parse'").select("abs_path")

        source = files.some(self.spark, root, [r["abs_path"] for r in todo.toLocalIterator()])
        docs = materialise(files.documents(source, make_ocr or ocr.from_settings(self.settings), pdf, doc, ocr.retry_from_settings(self.settings)), "documents")
        rel = listing.select("abs_path", F.col("rel_path").alias("doc_id"))
        good = docs.where(F.col("error").isNull()).join(rel, "abs_path")
        cut = chunking.chunk(good, self.settings.cutting.size, self.settings.cutting.overlap)
        shaped = store.keyed(cut.withColumns({"kb_id": F.lit(kb), "root": F.lit(root), "source": F.col("abs_path"), "embedding": F.lit(None).cast("array<float>")}))
        shaped = materialise(shaped.select(*self.spark.createDataFrame([], schemas.CHUNK).columns), "shaped")
        if provider:
            shaped = materialise(self.vectors.embed(shaped, provider).select(*shaped.columns), "embedded")
            store.check_dimension(self.chunks.read(kb).select("embedding").unionByName(shaped.select("embedding")))
            counts = shaped.groupBy("doc_id").count().orderBy("doc_id").collect()
            self.events.write([Embedding("documents", self.settings.embedding.provider, self.settings.embedding.model, sum(r["count"] for r in counts), [r["doc_id"] for r in counts])])

        per_file = docs.groupBy("abs_path").agg(F.max("error").alias("failed"), F.count_if(F.col("error").isNull()).alias("documents"))
        per_file = per_file.join(shaped.groupBy(F.col("source").alias("abs_path")).agg(F.count("*").alias("chunks")), "abs_path", "left")
        outcome = materialise(todo.join(per_file, "abs_path", "left").select("abs_path", manifest.classify(F.col("failed"), F.col("documents"), F.col("chunks")).alias("error")), "outcome")

        done = outcome.where(F.col("error").isNull()).join(rel, "abs_path").select(F.lit(root).alias("root"), "doc_id")
        if todo.head(1):
            self.chunks.change(shaped, done, kb)
            self.texts.change(files.full_texts(docs), todo, kb)
        lost = old.join(planned.where(F.col("action") == schemas.DELETED).select("abs_path"), "abs_path", "left_semi")
        changed = materialise(manifest.records_after(planned, outcome, lost, listing, root), "records")
        if changed.head(1):
            self.records(kb).change(changed, changed)
        self.reports.change(manifest.report(planned, outcome, run_id, kb, root), self.spark.createDataFrame([], "run_id string"), kb)
        self._manifest(kb)
        if self.settings.search.lists and todo.head(1):
            self.build_lists(kb)
        return run_id

    def _manifest(self, kb: str) -> None:
        row = manifest.doc_count(self.records(kb).read()).crossJoin(self.chunks.read(kb).agg(F.count("*").alias("chunk_count")))
        row = row.select(F.lit(kb).alias("kb_id"), F.lit(self.settings.embedding.model).alias("embedding_model"), F.lit(self.settings.cutting.size).alias("chunk_size"), F.lit(self.settings.cutting.overlap).alias("chunk_overlap"), "doc_count", "chunk_count", F.current_timestamp().alias("updated_at"))
        self.manifests.write(row, kb)

    def report(self, run_id: str) -> DataFrame:
        return manifest.nested_report(self.reports.read().where(F.col("run_id") == run_id))
