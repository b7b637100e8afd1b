"""Embeddings by content: a text that a model has seen once is not sent again."""

from __future__ import annotations

from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.store import Deltas, Table
from quarry.providers import Embedder, embed


class EmbeddingCache:
    """A table (key, embedding), where the key is a digest of the provider, the model and the text.

    `embed` calls the provider for the distinct texts that the table lacks, in the executors, writes what it gave, and joins the table back. Copies of a text, renamed files and later syncs call nothing;
    a run that dies loses the calls of its unfinished write only. A missing text counts as an empty one.
    """

    SCHEMA: ClassVar[str] = "key string, embedding array<float>"

    def __init__(self, table: Table, provider: str = "", model: str = ""):
        self.held, self.provider, self.model = Deltas(table, ("key",)), provider, model

    def key(self, text: Column) -> Column:
        """The length of each part stands before it, so no two triples are alike."""
        named = "".join(f"{len(part)}:{part}" for part in (self.provider, self.model))
        return F.sha2(F.concat(F.lit(named), F.coalesce(text, F.lit(""))).cast("binary"), 256)

    def missing(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """(key, text) of the distinct texts that the table lacks."""
        wanted = rows.select(self.key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        return wanted.groupBy("key").agg(F.first("text").alias("text")).join(self.held.read().select("key"), "key", "left_anti")

    def embed(self, rows: DataFrame, provider: Embedder, text: str = "text", column: str = "embedding") -> DataFrame:
        """rows with the vector of each text in `column`."""
        lacking = self.missing(rows, text)
        if lacking.head(1):
            self.held.change(embed(lacking, provider), lacking.select("key").limit(0))
        kept = rows.drop(column)
        return kept.withColumn("__key", self.key(F.col(text))).join(self.held.read().select(F.col("key").alias("__key"), F.col("embedding").alias(column)), "__key", "left").drop("__key")
