"""Language identification by hyperdimensional profiles.

Every letter, of any script, has a random vector of +1 and -1 of its own, which follows from its code point. A trigram's vector binds (multiplies) its letters'
vectors, each permuted by its position; a document's vector bundles (adds) its trigrams' vectors; a language's prototype bundles the normalised
vectors of its training documents, less the mean of all prototypes, so that what languages share does not count. The prediction is the
prototype with the largest cosine.

Prototypes are fitted on about `per_language` documents of each language, drawn by a hash of doc_id (all, where there
are no more); prediction covers every document and its whole text. Prototypes are one vector for each learned language. Texts are bundled in groups
of bounded size, and a group's distinct trigrams in steps of bounded size, so memory does not grow with texts or alphabets.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything if nothing was learned;
repeated rows repeat; a null doc_id is not held out; extra columns are ignored; an empty table gives an empty result. Ties go to the language that sorts first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bound_batches, materialise

DIMENSIONS = 1024
PER_LANGUAGE = 3000
SEED = 42
UNDETERMINED = "und"
FOLDS = 5
GROUP_LETTERS = 400_000
GROUP_TEXTS = 256
STEP = 4096

#: A code point takes so many bits of a trigram's number.
_BITS, _LOW = 21, (1 << 21) - 1


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letter_vectors(letters: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """A vector of +1 and -1 for each code point: the bits of a counter-based generator, the same wherever it runs. What is no letter is 0, and has one too."""
    words = -(-dimensions // 64)
    with np.errstate(over="ignore"):
        x = (letters.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(letters), 8 * words), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The bound vectors of trigrams, a trigram being its three code points side by side."""
    three = np.stack([grams >> (2 * _BITS), grams >> _BITS & _LOW, grams & _LOW])
    letters, at = np.unique(three, return_inverse=True)
    v = letter_vectors(letters, dimensions, seed)
    at = at.reshape(three.shape)
    return np.roll(v, 2, axis=1)[at[0]] * np.roll(v, 1, axis=1)[at[1]] * v[at[2]]


def grams(text: str) -> np.ndarray:
    """The trigrams of a text in lower case, with one 0 for whatever parts words; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[0], np.where(_is_letter()[codes], codes, 0), [0]]).astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    found = (codes[:-2] << (2 * _BITS)) | (codes[1:-1] << _BITS) | codes[2:]
    return found[codes[1:-1] != 0]


def document_vectors(texts: list[str | None], dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and whether it has a letter."""
    lettered = np.zeros(len(texts), bool)
    out = np.zeros((len(texts), dimensions), np.float32)
    rows: list[int] = []
    held: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):  # in groups of bounded size; a long text is counted like any other
        found = grams(text) if text else np.zeros(0, np.int64)
        lettered[i] = len(found) > 0
        for at in range(0, len(found), GROUP_LETTERS):
            rows.append(i)
            held.append(found[at : at + GROUP_LETTERS])
            size += len(held[-1])
            if size >= GROUP_LETTERS or len(rows) >= GROUP_TEXTS:
                _bundle(out, rows, held, dimensions, seed)
                rows, held, size = [], [], 0
    if held:
        _bundle(out, rows, held, dimensions, seed)
    return out, lettered


def _bundle(out: np.ndarray, rows: list[int], held: list[np.ndarray], dimensions: int, seed: int) -> None:
    """Add the trigrams' vectors to the rows. Only counts that are not 0 are kept; sums of whole numbers do not depend on their order."""
    kinds, at = np.unique(np.concatenate(held), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(h) for h in held])
    cells, counts = np.unique(at * len(rows) + owner, return_counts=True)
    kind, row = np.divmod(cells, len(rows))
    edges = np.searchsorted(kind, np.arange(0, len(kinds) + STEP, STEP))
    for step, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        some = kinds[step * STEP : (step + 1) * STEP]
        vectors = gram_vectors(some, dimensions, seed)
        if (b - a) * 16 >= len(rows) * len(some):
            dense = np.zeros((len(rows), len(some)), np.float32)
            dense[row[a:b], kind[a:b] - step * STEP] = counts[a:b]
            sums = dense @ vectors.astype(np.float32)
            for i, r in enumerate(rows):
                out[r] += sums[i]
            continue
        order = a + np.argsort(row[a:b], kind="stable")
        for c in range(0, len(order), STEP):
            part = order[c : c + STEP]
            first = np.flatnonzero(np.diff(row[part], prepend=-1))
            sums = np.add.reduceat(vectors[kind[part] - step * STEP] * counts[part, None].astype(np.float32), first, axis=0)
            for i, r in enumerate(row[part[first]]):
                out[rows[r]] += sums[i]


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The centred unit prototype of each language, from the documents that are not held out."""
    bound_batches(docs.sparkSession)
    known = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    counts = materialise(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if not counts.head(1):
        return {}
    share = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = known.join(counts, "lang").where(share * F.col("n") < per_language)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, _ = document_vectors(batch.column(0).to_pylist(), dimensions, seed)
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            vectors = _unit(vectors).astype(np.float64)
            for name in set(names):
                sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0)
        if sums:
            yield _vectors(sums)

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.array(table.column("v").to_pylist()).sum(axis=0)
        return pa.Table.from_batches([_vectors({key[0].as_py(): total})])

    bundled = drawn.select("text", "lang").mapInArrow(bundle, "lang string, v array<double>").groupBy("lang").applyInArrow(add, "lang string, v array<double>")
    found = {r["lang"]: _unit(np.array(r["v"])) for r in bundled.collect()}
    middle = np.mean(list(found.values()), axis=0) if len(found) > 1 else 0
    return {name: _unit(found[name] - middle) for name in sorted(found)}


def _vectors(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def identify(docs: DataFrame, learned: dict[str, np.ndarray], seed: int = SEED, text: str = "text", added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (or columns of other names); only the text is looked at."""
    spark = docs.sparkSession
    bound_batches(spark)
    names = list(learned)
    shared = spark.sparkContext.broadcast((names, np.array([learned[n] for n in names], np.float32)))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if names:
                vectors, lettered = document_vectors(batch.column(place).to_pylist(), matrix.shape[1], seed)
                cosines = _unit(vectors) @ matrix.T
                best = cosines.argmax(axis=1)
                predicted = [names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, np.clip(cosines.max(axis=1), 0, 1), 0).astype(np.float64)
            else:
                predicted, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.string()), pa.array(score)], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())]))


def crc(doc_id: int) -> int:
    """The checksum that decides whether a document is held out."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def predict(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs."""
    learned = prototypes(docs, doc_id=doc_id, text=text, lang=lang, **how)
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    return identify(source, learned).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
