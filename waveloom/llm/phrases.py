"""Substring dedup by repeated-phrase automata.

First the recurring phrases are confirmed. Of each window of ``WINDOW`` words the least hash of its ``GRAM``-word runs is
taken; windows over hashes that occur in two different texts are compared as 128-bit hashes, and the smallest (doc_id,
place) of equal windows owns them. Neighbouring windows of an owner that the same documents have, each in step, are one
phrase. Of texts that are equal as wholes only the first takes part in this, and is a phrase as a whole. Long phrases are
cut into pieces that overlap by a window less a word.

Then the phrases are dealt into shards by their least run hash, and each shard is compiled into an Aho-Corasick automaton.
A document goes to the shards whose phrases' hashes are among its own; it can hold no other phrase. Documents of a shard
are streamed through its automaton, which locates every occurrence. A shard that very many documents go to is compiled
once for every few thousand of them. Words of occurrences whose owner is smaller than the document are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common, passages
from .passages import GRAM, WINDOW, text_key

#: Bytes of phrases in one automaton, on average; documents that one automaton streams, on average; words of the longest phrase.
SHARD_BYTES = 1 << 20
CELL_DOCS = 4096
PIECE_WORDS = 1000
#: Modulus of the sums that tell sets of places apart.
SUM_BITS = 47


def minima(h: np.ndarray) -> np.ndarray:
    """The least run hash of each window, in order of the windows' starts."""
    return common.sliding_min(common.sequence_hashes(h, GRAM), WINDOW - GRAM + 1)


def anchors(docs: DataFrame) -> DataFrame:
    """(h, doc_id, key): the window minima of each document, each run of equal ones once; key is the text's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, limit=4 << 20):
            found, ids, keys = [np.empty(0, np.uint64)], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                m = minima(common.word_hashes(text.split()))
                if len(m):
                    m = m[np.r_[True, m[1:] != m[:-1]]]
                    found.append(m)
                    ids += [doc_id] * len(m)
                    keys += [text_key(text)] * len(m)
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(np.concatenate(found))), pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], names=["h", "doc_id", "key"])

    return passages.texts(docs).mapInArrow(run, "h long, doc_id long, key long")


def copied_texts(docs: DataFrame) -> DataFrame:
    """(digest, key, first): the texts that several documents have, and the smallest of these."""
    marked = passages.texts(docs).select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("key"), F.sha2("text", 256).alias("digest"))
    return marked.groupBy("digest", "key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first").drop("last")


def windows(base: DataFrame, hits: DataFrame, copied: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, key, start, a, b): the windows over ``hits`` (doc_id, hits), but not those of copies of a smaller document.
    a is a number of the document, b that number times the place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "z", passages.SLICE):
            parts = [[np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 2 + [np.empty(0, np.int32)] + [np.empty(0, np.uint64)] * 2]
            for doc_id, text, hit, copies in zip(batch.column("k").to_pylist(), common.inflated(batch.column("z")), batch.column("hits"), batch.column("copies").to_pylist(), strict=True):
                key = text_key(text)
                if key in (copies or ()):
                    continue
                h = common.word_hashes(text.split())
                m = common.signed(minima(h))
                at = np.flatnonzero(np.isin(m, np.asarray(hit.values)))
                if len(at):
                    a = np.uint64(xxh64_intdigest(b"%d %d" % (doc_id, key)) >> (64 - SUM_BITS))
                    b = (a * at.astype(np.uint64)) & np.uint64((1 << SUM_BITS) - 1)
                    parts.append([common.sequence_hashes(h, WINDOW)[at], common.sequence_hashes(h, WINDOW, 0x5851F42D4C957F2D)[at], np.full(len(at), doc_id), np.full(len(at), key), at.astype(np.int32), np.full(len(at), a), b])
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            for lo in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(c[lo : lo + (1 << 16)]) if c.dtype == np.uint64 else c[lo : lo + (1 << 16)]) for c in cols], names=["w1", "w2", "doc_id", "key", "start", "a", "b"])

    asked = passages.joined(passages.joined(base, hits, "inner"), copied)
    return asked.mapInArrow(run, "w1 long, w2 long, doc_id long, key long, start int, a long, b long")


def owned_stretches(found: DataFrame) -> DataFrame:
    """(doc_id, key, start, n): the stretches of an owner's text whose windows all have the same places, in step, in all documents.

    Windows that follow one another in every document that has them have equal counts and sums of a, and sums of b that
    differ by the sum of a. Where a sum overflows, a stretch ends; that makes more stretches and loses none."""
    owner = found.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "key", "start")).alias("o"), F.max("doc_id").alias("last"), F.count("*").alias("m"), F.try_sum("a").alias("a"), F.try_sum("b").alias("b"))
    owner = owner.filter("last > o.doc_id").select("o.*", "m", "a", "b")
    order = Window.partitionBy("doc_id", "key").orderBy("start")
    was = {c: F.lag(c).over(order) for c in ("start", "m", "a", "b")}
    same = (F.col("start") == was["start"] + 1) & (F.col("m") == was["m"]) & (F.col("a") == was["a"]) & (F.pmod(F.pmod("b", F.lit(1 << SUM_BITS)) - F.pmod(was["b"], F.lit(1 << SUM_BITS)) - F.pmod("a", F.lit(1 << SUM_BITS)), F.lit(1 << SUM_BITS)) == 0)
    numbered = owner.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    return numbered.groupBy("doc_id", "key", "run").agg(F.min("start").alias("start"), (F.count("*") + WINDOW - 1).cast("int").alias("n")).drop("run")


def phrase_texts(base: DataFrame, stretches: DataFrame) -> DataFrame:
    """(h, owner, n, phrase): the words of each stretch (doc_id, key, start, n), or of the whole text where n is null, in
    pieces of ``PIECE_WORDS`` at most, and the least run hash in each."""
    asked = stretches.groupBy("doc_id").agg(F.collect_set(F.struct("key", "start", "n")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "z", passages.SLICE):
            for owner, text, asked in zip(batch.column("k").to_pylist(), common.inflated(batch.column("z")), batch.column("asked"), strict=True):
                key, words = text_key(text), text.split()
                runs, rows, size = common.sequence_hashes(common.word_hashes(words), GRAM), [], 0
                for x in asked.as_py():
                    if x["key"] != key or len(words) < WINDOW:
                        continue
                    start, end = (x["start"], x["start"] + x["n"]) if x["n"] is not None else (0, len(words))
                    for s in range(start, end - WINDOW + 1, PIECE_WORDS - WINDOW + 1):
                        e = min(end, s + PIECE_WORDS)
                        rows.append((int(common.signed(runs[s : e - GRAM + 1]).view(np.uint64).min()), owner, e - s, b" ".join(words[s:e])))
                        size += len(rows[-1][3])
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        h, owner, n, phrase = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(common.signed(np.array(h, np.uint64))), pa.array(owner, pa.int64()), pa.array(n, pa.int32()), pa.array(phrase, pa.binary())], names=["h", "owner", "n", "phrase"])

    return passages.joined(base, asked, "inner").mapInArrow(run, "h long, owner long, n int, phrase binary")


def compiled(phrases: dict[bytes, tuple[int, int]]):
    """An automaton over phrases, which are words joined by spaces; values are (characters, words, owner)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, (n, owner) in phrases.items():
        text = f" {phrase.decode('latin-1')} "  # bytes as characters; the spaces let phrases start and end with words only
        automaton.add_word(text, (len(text), n, owner))
    automaton.make_automaton()
    return automaton


def occurrences(automaton, words: list[bytes], doc_id: int) -> list[tuple[int, int]]:
    """The (start, words) of each phrase of a smaller owner in a document."""
    starts, out = np.cumsum([0, *(len(w) + 1 for w in words)]), []
    for end, (length, n, owner) in automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
        if owner < doc_id:
            out.append((int(np.searchsorted(starts, end - length + 1)), n))
    return out


CELL = "shard long, salt int, kind int, doc_id long, n int, data binary"
SPANS = "doc_id long, key long, starts array<int>, counts array<int>"


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole cells, phrases (kind 0) before documents (kind 1): each cell's automaton is compiled once, and its documents go through it."""
    cell, phrases, automaton, found = None, {}, None, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        ids, keys, starts, counts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "key", "starts", "counts"])

    for batch in common.text_slices(batches, "data", 1 << 20):
        kinds, ids, ns = (batch.column(c).to_pylist() for c in ("kind", "doc_id", "n"))
        for k, at in enumerate(zip(batch.column("shard").to_pylist(), batch.column("salt").to_pylist(), strict=True)):
            if at != cell:
                cell, phrases, automaton = at, {}, None
            data = batch.column("data")[k].as_py()
            if not kinds[k]:
                _, owner = phrases.get(data, (0, ids[k]))
                phrases[data] = ns[k], min(owner, ids[k])
                continue
            if automaton is None:
                automaton = compiled(phrases)
            text = common.inflated(pa.array([data], pa.binary()))[0]
            spans = occurrences(automaton, text.split(), ids[k])
            if spans:
                starts, counts = zip(*spans, strict=True)
                found.append((ids[k], text_key(text), starts, counts))
        if found:
            yield batch_of(found)
            found = []


def located(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, found): for each document the (key, starts, counts) of the phrases in it that a smaller document owns."""
    first = common.staged(anchors(docs), "anchors")
    # Unique sides of joins are written first: the join then shuffles both sides, and can split a partition that one very
    # common key fills.
    recurring = first.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("key") != F.max("key")).alias("differ")).filter("a < b").select("h", "differ")
    hits = common.staged(first.join(common.staged(recurring, "recurring"), "h").select("h", "doc_id", "differ"), "recurring-anchors")
    common.forget(first)
    copied = common.staged(copied_texts(docs), "copied-texts")
    copies = passages.texts(docs).select("doc_id", F.sha2("text", 256).alias("digest")).join(copied, "digest").filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("copies"))
    hit = hits.filter("differ").groupBy("doc_id").agg(F.collect_set("h").alias("hits"))
    stretches = owned_stretches(windows(base, hit, copies)).union(copied.select(F.col("first").alias("doc_id"), "key", F.lit(0).alias("start"), F.lit(None).cast("int").alias("n")))
    phrases = common.staged(phrase_texts(base, stretches), "phrases")
    size = phrases.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    shards = F.lit(size // SHARD_BYTES + 1)
    shard = F.pmod(F.xxhash64("h"), shards).alias("shard")
    routes = hits.join(common.staged(phrases.select("h").distinct(), "phrase-hashes"), "h").select("doc_id", shard).distinct()
    routes = common.staged(routes, "routes")
    # One row a shard.
    cells = common.staged(routes.groupBy("shard").agg(F.ceil(F.count("*") / CELL_DOCS).cast("int").alias("salts")), "cells")
    sent = phrases.select(shard, "owner", "n", "phrase").join(cells, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "owner", "n", "phrase")
    asking = routes.join(cells, "shard").select("doc_id", "shard", F.pmod(F.hash("doc_id"), F.col("salts")).alias("salt"))
    streamed = passages.joined(base, asking, "inner").select("shard", "salt", F.lit(1).alias("kind"), "k", F.lit(0).alias("n"), "z")
    rows = sent.toDF("shard", "salt", "kind", "doc_id", "n", "data").union(streamed)
    # A counted repartition: as many tasks as cells, though a task may get several of them by hash.
    tasks = cells.agg(F.sum("salts")).first()[0] or 1
    found = rows.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(stream, SPANS)
    out = common.staged(common.staged(found, "occurrences").groupBy("doc_id").agg(F.collect_list(F.struct("key", "starts", "counts")).alias("found")), "located")
    common.forget(hits, copied, phrases, routes, cells)
    return out


def removed(batch: pa.RecordBatch, texts: list[bytes], words: list[list[bytes]]) -> list[np.ndarray]:
    """The words that lie in a located phrase."""
    out = []
    for text, w, found in zip(texts, words, batch.column("found"), strict=True):
        key = text_key(text)
        out.append(passages.covered(len(w), [s for x in found.as_py() or () if x["key"] == key for s in zip(x["starts"], x["counts"], strict=True)]))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of ``docs`` (doc_id, text): the words that no window of 50 covers whose
    words also start in a document with a smaller doc_id.

    Null texts have no words. Rows without doc_id are returned whole and take nothing from others. Rows that repeat a
    doc_id are neither smaller nor larger than one another. Texts of any length are streamed whole, empty tables give an
    empty result. Other columns, whatever their names, are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = passages.spread(docs)
    return passages.finished(base, located(docs, base), removed, passages.DIGEST_SCHEMA, passages.kept_words)


def op2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document has."""
    return passages.digests(without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') END AS w FROM documents),
     win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
     own AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
     hit AS (SELECT doc_id, i FROM win JOIN own USING (h) WHERE doc_id > first),
     gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g FROM hit GROUP BY doc_id),
     k AS (SELECT d.doc_id, w, coalesce(g, []) AS g FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(g) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(g, i)), ' '), '')) AS kept_sha256
FROM k
"""
