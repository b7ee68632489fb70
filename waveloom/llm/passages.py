"""What the two passage operators share besides word hashes: texts on their way through shuffles, and what is done with the words to remove."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

#: Words of the least passage, and of the runs by whose hashes positions in it are selected.
WINDOW = 50
GRAM = 16
#: Compressed bytes of text that a task opens at once, or one document.
SLICE = 640 << 10
DIGEST_SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def text_key(text: bytes) -> int:
    """As ``F.xxhash64`` of the string."""
    key = xxh64_intdigest(text, 42)
    return key - (1 << 64) if key >> 63 else key


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc_id, k, [rest,] z), dealt by k: z is the compressed text, k the doc_id or, where there is none, a hash of
    the text, and rest a struct of the other columns. k is never null, so every join on it reads the same shuffle."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("k"), *([F.struct(*rest).alias("rest")] if rest else []), "text")
    return common.compressed(named, *named.columns[:-1]).repartition("k")


def joined(base: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    """``base`` with what ``other`` has for its doc_id."""
    return base.join(other.withColumnRenamed("doc_id", "k"), "k", how)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that can have or own a passage; text is binary."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


def finished(base: DataFrame, marks: DataFrame, mark: Callable, schema, emit: Callable) -> DataFrame:
    """Give each slice of documents, joined with ``marks``, to ``mark``, which tells the words to remove; ``emit`` makes a
    record batch of a slice, its texts and those words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "z", SLICE):
            found = common.inflated(batch.column("z"))
            words = [t.split() for t in found]
            yield emit(batch, found, words, mark(batch, found, words))

    return joined(base, marks).mapInArrow(run, schema)


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words lie in one of the (start, count) spans."""
    step = np.zeros(n + 1, np.int64)
    for start, count in spans:
        step[start] += 1
        step[start + count] -= 1
    return np.cumsum(step[:-1]) > 0


def kept_words(batch: pa.RecordBatch, texts: list[bytes], words: list[list[bytes]], gone: list[np.ndarray]) -> pa.RecordBatch:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space."""
    kept = [b" ".join(w) if not g.any() else b" ".join([x for x, out in zip(w, g.tolist(), strict=True) if not out]) for w, g in zip(words, gone, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
