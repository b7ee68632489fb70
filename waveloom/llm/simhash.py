"""SimHash near-dedup with BK-trees.

Two fingerprints that differ in at most ``radius`` bits agree in two of ``radius + 2`` blocks of bits. So distinct
fingerprints are dealt into shards by (two blocks, their values), of some 26 bits; each shard has a BK-tree whose children are keyed by their Hamming
distance to the parent, and a search follows only edges within the radius. A shard of more than ``tree_size``
fingerprints is cut into trees of about that size, and each of its fingerprints visits every tree: a cell holds one tree
and the fingerprints of one other, so no task holds an unbounded group. A cell returns a spanning set of its links, not all
pairs; components do not need more.

The trees of many cells are built and searched together, level by level, as arrays.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .components import connected_components

RADIUS = 3
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(_UPPER, _LOWER)


def fingerprints(texts: list[bytes | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of each UTF-8 text: a bit is 1 if it is set in over half of the shingles' hashes."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or b"").translate(FOLD).split()
        if words:
            runs = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            got = np.fromiter((xxh64_intdigest(r, seed) for r in runs), np.uint64)
            hashes.append(got)
            counts[i] = len(got)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        at = 0
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for i, got in zip(full, hashes, strict=True):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(got), 1 << 16):
                bits = np.unpackbits(got[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int32)
            out[i] = weights[2 * ones > len(got)].sum(dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text); fp is the fingerprint as a signed 64-bit integer. Null texts have no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, limit=4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(common.signed(fingerprints(batch.column("text").to_pylist())))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class Forest:
    """BK-trees over distinct 64-bit values, one for each group of ``tree`` (ascending); searched all at once."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values = values
        first = np.r_[True, tree[1:] != tree[:-1]]
        self.roots = np.flatnonzero(first)
        n = len(values)
        parent = self.roots[np.cumsum(first) - 1]
        waiting = np.flatnonzero(~first)
        # A child is keyed by parent * 65 + distance; at each level the first of those with one key becomes the child.
        keys, nodes = [], []
        while len(waiting):
            key = parent[waiting] * 65 + np.bitwise_count(values[waiting] ^ values[parent[waiting]])
            found, where, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            nodes.append(waiting[where])
            parent[waiting] = waiting[where][back]
            taken = np.zeros(len(waiting), bool)
            taken[where] = True
            waiting = waiting[~taken]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.nodes = self.keys[order], self.nodes[order]
        assert len(self.nodes) + len(self.roots) == n

    def search(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, value) index pairs within ``radius``; ``tree`` is the ordinal of each query's tree."""
        query, node = np.arange(len(queries)), self.roots[tree]
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            yield query[near], node[near]
            # Children between distance - radius and distance + radius lie side by side in the sorted keys.
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0))
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), side="right")
            counts = hi - lo
            query = np.repeat(query, counts)
            ends = np.cumsum(counts)
            node = self.nodes[np.repeat(lo - (ends - counts), counts) + np.arange(len(query))] if len(query) else query


def _root(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def spanning_links(values: np.ndarray, cell: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), each within ``radius``, that join, cell by cell, all values that lie within it of one another: tree members against those that ask."""
    members = np.flatnonzero(in_tree)
    forest = Forest(values[members], cell[members])
    tree_of = {c: k for k, c in enumerate(cell[members][forest.roots])}
    asking = np.flatnonzero(asks)
    asking = asking[[c in tree_of for c in cell[asking]]] if len(asking) else asking
    label = np.arange(len(values))
    ends = [(label[:0], label[:0])]
    for lo in range(0, len(asking), block):
        part = asking[lo : lo + block]
        trees = np.array([tree_of[c] for c in cell[part]])
        for q, t in forest.search(values[part], trees, radius):
            x, y = part[q], members[t]
            while True:
                a, b = label[x], label[y]
                differ = a != b
                if not differ.any():
                    break
                a, b, x, y = a[differ], b[differ], x[differ], y[differ]
                # Each root is hung below one smaller root, by the link that says so.
                high, at = np.unique(np.maximum(a, b), return_index=True)
                label[high] = np.minimum(a, b)[at]
                ends.append((x[at], y[at]))
                label = _root(label)
    x, y = (np.concatenate(e) for e in zip(*ends, strict=True))
    return values[x], values[y]


def near_links(fps: DataFrame, radius: int = RADIUS, tree_size: int = 4096) -> DataFrame:
    """Links (a, b) among the distinct values ``fp`` that connect all pairs within ``radius`` bits."""
    edges = [64 * k // (radius + 2) for k in range(radius + 3)]
    bits = [(F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1), hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    pairs = [F.shiftleft(a, width) + b for (a, _), (b, width) in itertools.combinations(bits, 2)]
    parts = F.array(*(F.struct(F.lit(k).alias("block"), value.alias("value")) for k, value in enumerate(pairs)))
    return shard_links(fps.select("fp", F.explode(parts).alias("p")).select("fp", "p.block", "p.value"), radius, tree_size)


def shard_links(posts: DataFrame, radius: int, tree_size: int = 4096) -> DataFrame:
    """Links (a, b) that connect, shard by shard, all fingerprints within ``radius`` bits; ``posts`` (fp, block, value) has each fingerprint once a shard."""
    large = posts.groupBy("block", "value").count().filter(F.col("count") > tree_size).select("block", "value", F.ceil(F.col("count") / tree_size).cast("int").alias("trees"))
    cut = posts.join(large, ["block", "value"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    cells = cut.select("block", "value", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asker"), (F.col("own") <= F.col("other")).alias("in_tree"), (F.col("own") >= F.col("other")).alias("asks"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]
            cell = np.cumsum(new) - 1
            a, b = spanning_links(rows[:, 6].view(np.uint64) if rows.flags.f_contiguous else np.ascontiguousarray(rows[:, 6]).view(np.uint64), cell, rows[:, 4] == 1, rows[:, 5] == 1, radius)
            return pa.RecordBatch.from_arrays([pa.array(common.signed(a)), pa.array(common.signed(b))], names=["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(c.cast(pa.int64())) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([*held, rows]) if held else rows
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            stop = last[-1] + 1 if len(last) else 0
            if stop:
                yield links(rows[:stop])
            held = [rows[stop:]]  # a cell that may go on: two trees at most
        if held and len(held[0]):
            yield links(held[0])

    keys = ["block", "value", "tree", "asker"]
    ordered = cells.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return ordered.mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``: documents whose fingerprints differ in at most ``radius`` bits are linked.

    component_id is the least doc_id that can be reached. Equal fingerprints are one class before anything is searched, so
    groups of copies cost nothing. Rows without doc_id take part in no group and have no component; a doc_id that repeats
    is in the group of each of its texts. Null and empty texts have fingerprint zero and are linked like any other.
    """
    marked = common.staged(with_fingerprints(docs), "fingerprints")
    classes = marked.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    classes = common.staged(classes, "classes")
    links = near_links(classes.select("fp"), radius)
    found = common.staged(connected_components(links), "components")
    # The least doc_id of each component of fingerprints; then whole documents, where one doc_id has several texts.
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex_fingerprint(fp="fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the least of its group; rows without doc_id stay, rows that repeat
    the kept doc_id stay too, and an empty table stays empty."""
    dropped = near_components(docs).filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(common.columns_of(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")
