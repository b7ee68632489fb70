"""Suffix-array dedup with a sparse suffix array.

Only suffixes that start at content-selected positions are kept: where a run of ``GRAM`` words has the least hash of some
window of ``WINDOW`` words. Equal passages select equal positions, so a window of that length always holds one, and reaches
at most ``LEFT`` words to its left and ``WINDOW`` words to its right. Suffixes whose first words recur in no other document
are let go; those that agree in all words within reach are one class, which the smallest document stands for.

The suffixes, ``WINDOW`` words of text each and what stands left of them, are sorted over the cluster as text, by range.
Each range is walked in order: the common prefix of neighbours tells which suffixes agree in how many words to the right,
and each such stretch of the array is extended word by word to the left. So for every window over a selected position the
smallest document that has it is found. Ranges end between groups of equal first words; only a group of more than ``CHUNK``
suffixes may be cut, so that tasks can share it, and is compared across the border by the hashes of its windows. Last, the
words of windows that a smaller document has are cut from the later one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, passages
from .passages import GRAM, WINDOW

LEFT = WINDOW - GRAM
#: Suffixes that are compared at once.
CHUNK = 1 << 17
#: Stand for the words before and behind a text.
BEFORE, BEHIND = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
CONTEXT_SALT, SECOND_SALT = 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D


def selected(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose run of words has the least hash of some window, and those hashes."""
    runs = common.sequence_hashes(h, GRAM)
    least = common.sliding_min(runs, LEFT + 1)
    if not len(least):
        return np.empty(0, np.int64), least
    # The greatest of the minima of the windows over a position; windows beyond the ends have none.
    edge = np.zeros(LEFT, np.uint64)
    most = ~common.sliding_min(~np.concatenate([edge, least, edge]), LEFT + 1)
    at = np.flatnonzero(most == runs)
    return at, runs[at]


def contexts(h: np.ndarray) -> np.ndarray:
    """For each word, a hash of all words that a window over its position may reach."""
    return common.sequence_hashes(np.concatenate([np.full(LEFT, BEFORE), h, np.full(WINDOW, BEHIND)]), LEFT + WINDOW, CONTEXT_SALT)[: len(h)]


def entries(docs: DataFrame) -> DataFrame:
    """(g, c, doc_id, place) of each selected suffix: hashes of its first words and of all words in reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, limit=4 << 20):
            parts = [[np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 2]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = common.word_hashes(text.split())
                at, g = selected(h)
                if len(at):
                    parts.append([g, contexts(h)[at], np.full(len(at), doc_id), at])
            g, c, ids, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(g)), pa.array(common.signed(c)), pa.array(ids), pa.array(places.astype(np.int32))], names=["g", "c", "doc_id", "place"])

    return passages.texts(docs).mapInArrow(run, "g long, c long, doc_id long, place int")


def suffix_texts(base: DataFrame, representatives: DataFrame) -> DataFrame:
    """(suffix, left, head, doc_id, g, c, large): the words from each place on and, last word first, those before it; a space after each. ``head`` has the first words."""
    asked = representatives.groupBy("doc_id").agg(F.collect_list(F.struct("place", "g", "c", "large")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "z", passages.SLICE):
            for doc_id, text, some in zip(batch.column("k").to_pylist(), common.inflated(batch.column("z")), batch.column("asked"), strict=True):
                words = text.split()
                own = common.signed(contexts(common.word_hashes(words)))
                # A doc_id may have several texts: the context tells which of them is meant.
                rows = [x for x in some.as_py() if x["place"] < len(words) and own[x["place"]] == x["c"]]
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    right = [b" ".join([*words[x["place"] : x["place"] + WINDOW], b""]) for x in part]
                    left = [b" ".join([*words[max(0, x["place"] - LEFT) : x["place"]][::-1], b""]) for x in part]
                    head = [b" ".join([*words[x["place"] : x["place"] + GRAM], b""]) for x in part]
                    columns = [pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(head, pa.binary()), pa.array([doc_id] * len(part), pa.int64()), *(pa.array([x[f] for x in part], k) for f, k in (("g", pa.int64()), ("c", pa.int64()), ("large", pa.bool_())))]
                    yield pa.RecordBatch.from_arrays(columns, names=["suffix", "left", "head", "doc_id", "g", "c", "large"])

    return passages.joined(base, asked, "inner").mapInArrow(run, "suffix binary, left binary, head binary, doc_id long, g long, c long, large boolean")


def _grid(texts: pa.ChunkedArray, width: int, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text as numbers, equal for equal words, zero behind the last; and how many there are. Only the numbers are held."""
    grid, counts = np.zeros((len(texts), width), np.int32), np.zeros(len(texts), np.int64)
    at = 0
    for chunk in texts.chunks:
        for lo in range(0, len(chunk), 1024):
            for text in chunk.slice(lo, 1024).to_pylist():
                words = text.split()
                grid[at, : len(words)] = [ids.setdefault(w, len(ids) + 1) for w in words]
                counts[at] = len(words)
                at += 1
    return grid, counts


def first_owners(right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix of a sorted run, the windows over it that a smaller document in the run has: bit o for the window that starts o words before it."""
    differ = right[1:] != right[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
    out, side = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    for o in range(LEFT + 1):
        if o:  # one word further to the left
            side = np.unique(side * (int(left.max(initial=0)) + 1) + left[:, o - 1], return_inverse=True)[1]
        has = np.flatnonzero((n_left >= o) & (n_right >= WINDOW - o))
        stretch = np.cumsum(np.r_[0, shared < WINDOW - o]) if len(doc) else side
        found, back = np.unique((stretch * len(doc) + side)[has], return_inverse=True)
        least = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(least, back, doc[has])
        out[has[least[back] < doc[has]]] |= 1 << o
    return out


COMPARED = {"g": pa.int64(), "c": pa.int64(), "mask": pa.int64(), "w1": pa.int64(), "w2": pa.int64(), "doc_id": pa.int64(), "o": pa.int32()}


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, c, mask) for what a sorted range settles, and a row (g, c, w1, w2, doc_id, o) for each window of groups that its ends may
    cut: of large groups, and of one that turns out to be more than is compared at once."""
    def compare(rows: pa.Table, cut: str, last: bool) -> tuple[list[pa.RecordBatch], int]:
        """What is found, and where the group starts that may go on; ``cut``: the first group may have begun before, in this range (inside) or in the one before it (start)."""
        ids: dict[bytes, int] = {}
        (a, n_right), (b, n_left) = (_grid(rows.column(c), w, ids) for c, w in (("suffix", WINDOW), ("left", LEFT)))
        new = np.r_[True, (a[1:, :GRAM] != a[:-1, :GRAM]).any(axis=1)]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        whole = int(starts[-1]) if not last else len(a)
        open_ = np.zeros(len(a), bool)
        large = np.asarray(rows.column("large").combine_chunks().cast(pa.int8())).astype(bool)
        if cut:
            open_ |= (group == 0) & (large | (cut == "inside"))
        if last:
            open_ |= (group == group[-1]) & large
        if not whole:  # one group, larger than what is compared at once
            whole, open_[:] = len(a), True
        doc, g, c = (np.asarray(rows.column(x).combine_chunks())[:whole] for x in ("doc_id", "g", "c"))
        mask = first_owners(a[:whole], n_right[:whole], b[:whole], n_left[:whole], doc)
        at = np.flatnonzero(mask)
        found = [{"g": g[at], "c": c[at], "mask": mask[at]}]
        for k in np.flatnonzero(open_[:whole]).tolist():
            h = common.word_hashes([*rows.column("left")[k].as_py().split()[::-1], *rows.column("suffix")[k].as_py().split()])
            o = n_left[k] - np.arange(max(0, len(h) - WINDOW + 1))
            own = np.flatnonzero(mask[k] >> o & 1 == 0)  # of equal windows here only the smallest document's is sent on
            w1, w2 = common.sequence_hashes(h, WINDOW)[own], common.sequence_hashes(h, WINDOW, SECOND_SALT)[own]
            n = len(own)
            found.append({"g": np.full(n, g[k]), "c": np.full(n, c[k]), "w1": common.signed(w1), "w2": common.signed(w2), "doc_id": np.full(n, doc[k]), "o": o[own].astype(np.int32)})
        out = []
        for part in (found[:1], *(found[lo : lo + 1024] for lo in range(1, len(found), 1024))):
            names = part[0].keys()
            n = sum(len(p["g"]) for p in part)
            out.append(pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[x] for p in part]), t) if x in names else pa.nulls(n, t) for x, t in COMPARED.items()], names=list(COMPARED)))
        return out, whole

    held, cut = None, "start"
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows >= CHUNK:
            out, whole = compare(held, cut, False)
            yield from out
            cut, held = "inside" if whole == held.num_rows else "", held.slice(whole).combine_chunks()
    if held is not None and held.num_rows:
        yield from compare(held, cut, True)[0]


def repeated(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, found): for each document the places, with their contexts, over which windows lie that a smaller document
    has; a mask tells which windows, -1 all of them."""
    found = common.staged(entries(docs), "suffixes")
    # Unique sides of joins are written first: the join then shuffles both sides, and can split a partition that one very
    # common key fills.
    recurring = common.staged(found.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("g"), "recurring")
    hits = common.staged(found.join(recurring, "g"), "recurring-suffixes")
    classes = common.staged(hits.groupBy("g", "c").agg(F.min(F.struct("doc_id", "place")).alias("o")).select("g", "c", "o.*"), "contexts")
    several = classes.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a < b").select("g", (F.col("n") > CHUNK).alias("large"))
    array = common.staged(suffix_texts(base, classes.join(common.staged(several, "several"), "g")), "suffix-array")
    within = [F.when(F.col("large"), F.col(c)) for c in ("suffix", "left")]
    ordered = array.repartitionByRange("head", *within).sortWithinPartitions("suffix", "left").drop("head")
    compared = common.staged(ordered.mapInArrow(compare_neighbours, "g long, c long, mask long, w1 long, w2 long, doc_id long, o int"), "neighbours", spark__sql__execution__rangeExchange__sampleSizePerPartition="20")
    cut = compared.filter("o IS NOT NULL")
    first = common.staged(cut.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last"), "cut-groups")
    late = cut.join(first, ["w1", "w2"]).filter("doc_id > first").select("g", "c", F.expr("shiftleft(1L, o)").alias("mask"))
    masks = compared.filter("mask IS NOT NULL").select("g", "c", "mask").union(late).groupBy("g", "c").agg(F.bit_or("mask").alias("mask"))
    settled = common.staged(classes.withColumnRenamed("doc_id", "first").drop("place").join(masks, ["g", "c"], "left"), "settled")
    places = hits.join(settled, ["g", "c"]).select("doc_id", "place", "c", F.when(F.col("doc_id") > F.col("first"), F.lit(-1)).otherwise(F.coalesce("mask", F.lit(0))).cast("long").alias("mask"))
    out = common.staged(places.filter("mask != 0").groupBy("doc_id").agg(F.collect_list(F.struct("place", "c", "mask")).alias("found")), "repeated")
    common.forget(found, recurring, hits, classes, array, compared, first, settled)
    return out


def removed(batch: pa.RecordBatch, texts: list[bytes], words: list[list[bytes]]) -> list[np.ndarray]:
    """The words that lie in such a window."""
    out = []
    for w, found in zip(words, batch.column("found"), strict=True):
        spans = []
        if found.is_valid:
            own = common.signed(contexts(common.word_hashes(w)))
            for x in found.as_py():
                p, mask = x["place"], x["mask"]
                if p >= len(w) or own[p] != x["c"]:
                    continue  # the place of another text of this doc_id
                if mask == -1:
                    start, end = max(0, p - LEFT), min(len(w), p + WINDOW)
                    spans += [(start, end - start)] if end - start >= WINDOW else []
                else:
                    spans += [(p - o, WINDOW) for o in range(LEFT + 1) if mask >> o & 1]
        out.append(passages.covered(len(w), spans))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of ``docs`` (doc_id, text): what is left without the words of passages
    of 50 words or more that a document with a smaller doc_id has too.

    Null texts have no words. Rows without doc_id are returned whole and take nothing from others. Rows that repeat a
    doc_id are neither smaller nor larger than one another; passages that repeat within one document stay. Texts of any
    length are treated whole, empty tables give an empty result. Other columns, whatever their names, are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = passages.spread(docs)
    return passages.finished(base, repeated(docs, base), removed, passages.DIGEST_SCHEMA, passages.kept_words)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with such passages cut out of ``text``, and ``n_chars``, if there is one, counted anew. All other text, its
    white space too, and all columns, whatever their names, stay; documents of which nothing is left but white space are
    dropped if anything was cut. Nulls, repeats and empty tables as in ``without_repeats``."""
    base = passages.spread(docs)

    def emit(batch: pa.RecordBatch, texts: list[bytes], words: list[list[bytes]], gone: list[np.ndarray]) -> pa.RecordBatch:
        left = []
        for text, w, g in zip(texts, words, gone, strict=True):
            if not g.any():
                left.append(text)
                continue
            parts, at = [], 0
            for word, out in zip(w, g.tolist(), strict=True):
                start = text.index(word, at)
                parts.append(text[at:start] if out else text[at : start + len(word)])
                at = start + len(word)
            left.append(b"".join([*parts, text[at:]]))
        cut = pa.array([bool(g.any()) for g in gone], pa.bool_())
        columns = {c: batch.column(c) for c in kept} | {"text": pa.array(left, pa.binary()).cast(pa.string()), "cut": cut}
        columns["text"] = pc.if_else(batch.column("z").is_null(), pa.scalar(None, pa.string()), columns["text"])
        out = pa.RecordBatch.from_pydict(columns)
        return out.filter(pa.array([bool(t.strip()) or not g.any() for t, g in zip(left, gone, strict=True)], pa.bool_()))

    kept = [c for c in base.columns if c not in ("z", "k")]
    schema = base.select(*kept, F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("cut")).schema
    done = passages.finished(base, repeated(docs, base), removed, schema, emit)
    rest = {c: F.col("rest")[c] for c in docs.columns if c not in ("doc_id", "text")}
    if "n_chars" in rest:
        rest["n_chars"] = F.when(F.col("cut"), F.length("text")).otherwise(rest["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*((F.col(c) if c in ("doc_id", "text") else rest[c].alias(c)) for c in docs.columns))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document has, by sorted suffixes."""
    return passages.digests(without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
