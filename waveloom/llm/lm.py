"""LM scoring by cross-entropy difference.

Two word bigram models of one form are counted: a target model over the documents that are labelled good, a background
model over all documents. Both use one vocabulary, every word of all documents, and the same smoothing, so their losses on
a token can be compared. A document's score is the mean of target loss minus background loss over its tokens: the lower,
the more it is like the target. A target document is part of both models that score it, so its own bigrams count in its favour.

Words and counts grow with the corpus and are gathered nowhere. Documents are packed in blocks of a few megabytes. A block
sends each of its distinct n-grams, with its counts, to the bucket of the n-gram's hash; a bucket adds them up over all
blocks and returns the sums to the blocks that asked, where the losses are formed. The number of buckets grows with the
texts. Blocks and sums are tables in the shared folder; the driver sees four numbers. N-grams are told apart by 62 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash import FOLD

#: Hash of the mark before the first word; words are hashed by XXH64.
START = np.uint64(0x5B1D3C9E77A4F02D)
BIGRAM, TOKEN, CONTEXT = (np.uint64(k) for k in range(3))
#: Bytes of text for each bucket and of each block.
BUCKET_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20


def _packed(values: np.ndarray) -> bytes:
    """64-bit values, compressed byte place by byte place: small ones cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _key(x: np.ndarray, kind: np.uint64) -> np.ndarray:
    return (common._mixed(x * np.uint64(0xA0761D6478BD642F) + kind) & ~np.uint64(3)) | kind


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: the ascending keys of their n-grams, the places among them of each bigram's own, token's and context's
    key, the bigram of each token, and the number of tokens of each text."""
    symbols = [np.r_[START, common.word_hashes(t.translate(FOLD).split())] for t in texts]
    n = np.array([len(s) - 1 for s in symbols], np.int64)
    before, after = np.concatenate([s[:-1] for s in symbols]), np.concatenate([s[1:] for s in symbols])
    bigrams, at, token = np.unique(_key(common._mixed(before * np.uint64(0xD6E8FEB86659FD93)) + after, BIGRAM), return_index=True, return_inverse=True)
    keys, places = np.unique(np.concatenate([bigrams, _key(after[at], TOKEN), _key(before[at], CONTEXT)]), return_inverse=True)
    return keys, places.reshape(3, -1), token, n


def _counts(size: int, places: np.ndarray, token: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """How often each key occurs, by the weights of the tokens."""
    found = np.bincount(token, weights, minlength=places.shape[1])
    return sum(np.bincount(p, found, minlength=size) for p in places).astype(np.uint64)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, strength: float = 50.0) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) of each row of ``docs`` (doc_id, text).

    ``target_ids`` (doc_id) names the target documents; null ids and ids of no document are ignored, and with no target
    the target model knows nothing but the vocabulary. Losses are nats a token. Texts without words, and null, have no
    losses and no score. Rows that repeat count each. Texts of any length are scored whole; empty tables give an empty
    result. Other columns are ignored. A context seen n times weighs n / (n + strength) against unigrams that have one
    count more each.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, (size // BUCKET_BYTES).bit_length())
    # Labels grow with the documents, so the plan is the same join at every size and never a broadcast of them.
    target = target_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    marked = common.compressed(docs, "doc_id").join(target.hint("merge"), "doc_id", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        ids, good, texts = zip(*rows, strict=True)
        columns = (uuid.uuid4().int >> 65, ids, good, [len(t) for t in texts], zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))
        types = (pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], names=["block", "ids", "target", "sizes", "z"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in common.text_slices(batches, "z", 2 << 20):
            for row in zip(batch.column("doc_id").to_pylist(), map(bool, batch.column("target").to_pylist()), common.inflated(batch.column("z")), strict=True):
                held.append(row)
                size += len(row[2]) + 64
                if size >= BLOCK_BYTES:
                    yield block(held, batch.column("doc_id").type)
                    held, size = [], 0
        if held:
            yield block(held, batch.column("doc_id").type)

    blocks = common.staged(marked.mapInArrow(pack, f"block long, ids array<{kind}>, target array<boolean>, sizes array<int>, z binary"), "lm-blocks")

    def texts_of(z: bytes, sizes: list[int]) -> list[bytes]:
        data, ends = zstandard.ZstdDecompressor().decompress(z), np.cumsum(sizes).tolist()
        return [data[e - s : e] for e, s in zip(ends, sizes, strict=True)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, places, token, n = _grams(texts_of(row["z"], row["sizes"]))
                good = np.repeat(np.array(row["target"], np.float64), n)
                counts = [_counts(len(keys), places, token), _counts(len(keys), places, token, good)]
                buckets, starts = np.unique((keys >> np.uint64(64 - bits)).astype(np.int32), return_index=True)
                cells = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True))
                steps = [_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cells]
                arrays = [pa.array([row["block"]] * len(cells), pa.int64()), pa.array(buckets), pa.array(steps, pa.binary()), *(pa.array([_packed(c[a:b]) for a, b in cells], pa.binary()) for c in counts)]
                sums = [int(n.sum())] + [0] * max(0, len(cells) - 1), [int(good.sum())] + [0] * max(0, len(cells) - 1)
                arrays += [pa.array(s[: len(cells)], pa.int64()) for s in sums]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "bucket", "steps", "background", "good", "n", "n_good"])

    def add(cells: pa.Table) -> pa.Table:
        parts = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in cells.column("steps").to_pylist()]
        keys, back = np.unique(np.concatenate(parts), return_inverse=True)
        ends = np.cumsum([0, *map(len, parts)])
        sums = [np.bincount(back, np.concatenate([_unpacked(x) for x in cells.column(c).to_pylist()]), minlength=len(keys)).astype(np.uint64)[back] for c in ("background", "good")]
        words = [int((keys & np.uint64(3) == TOKEN).sum())] + [0] * (len(parts) - 1)
        replies = [pa.array([_packed(s[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for s in sums]
        return pa.table([cells.column("block"), cells.column("bucket"), *replies, pa.array(words, pa.int64()), cells.column("n"), cells.column("n_good")], names=["block", "bucket", "background", "good", "words", "n", "n_good"])

    asked = blocks.select("block", "target", "sizes", "z").mapInArrow(ask, "block long, bucket int, steps binary, background binary, good binary, n long, n_good long")
    replies = common.staged(asked.groupBy("bucket").applyInArrow(add, "block long, bucket int, background binary, good binary, words long, n long, n_good long"), "lm-sums")
    words, *totals = (x or 0 for x in replies.agg(F.sum("words"), F.sum("n_good"), F.sum("n")).first())

    def score(sums: pa.Table, whole: pa.Table) -> pa.Table:
        ids, sizes = whole.column("ids").combine_chunks().flatten(), whole.column("sizes")[0].as_py()
        _, places, token, n = _grams(texts_of(whole.column("z")[0].as_py(), sizes))
        order = np.argsort(np.asarray(sums.column("bucket")))
        doc, means = np.repeat(np.arange(len(n)), n), []
        for column, total in zip(("good", "background"), totals, strict=True):
            cells = sums.column(column).to_pylist()
            counts = np.concatenate([_unpacked(cells[k]) for k in order]).astype(np.float64) if cells else np.empty(0)
            of_bigram, of_token, of_context = (counts[p] for p in places)
            loss = -np.log((of_bigram + strength * (of_token + 1) / (total + words + 1)) / (of_context + strength))
            means.append(np.bincount(doc, loss[token], minlength=len(n)) / np.maximum(n, 1))
        return pa.table([ids, pa.array(n), *(pa.array(m, mask=n == 0) for m in means)], names=["doc_id", "n_tokens", "loss_target", "loss_background"])

    wholes = blocks.select("block", "ids", "sizes", "z")
    scored = replies.select("block", "bucket", "background", "good").groupBy("block").cogroup(wholes.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double")
    return scored.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by how much more it is like the documents of quality 1 than like all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1"))
