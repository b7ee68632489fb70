"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A set of n shingles, put in any order that all sets share, has a prefix of n - ceil(0.8 n) + 1: two sets as similar as
that have their first common shingle in both prefixes, so the pairs that meet on a prefix shingle miss none. Shingles that a
sample of texts has often come last in the order, which keeps boilerplate out of the prefixes; the sample changes the cost,
never the result. Equal sets are one class before anything is searched.

Classes are linked as ``simhash`` links documents, by 64-bit fingerprints and BK-trees, but of five-word shingles: the classes
of a prefix shingle are a shard, since blocks of bits do not tell fingerprints apart at the radius that 0.8 needs. Links are
verified on the whole sets. As no radius is sure to hold all pairs, what the fingerprints leave in different components is
then searched exactly.

For that, the groups of a prefix shingle are searched twice: first neighbours in size only, then all pairs that the links so
found leave in different components. A pair is let go before its texts are read if its sets' parity sketches differ in more
bits than the sets may differ in shingles: each shingle flips one bit, so the sketches never differ in more bits than that. So
a large group of near copies costs its rows and not their square. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .components import connected_components
from .simhash import FOLD, fingerprints, shard_links

SHINGLE = 5
#: Bits that fingerprints of linked classes may differ in: sets of a similarity of 0.8 differ in some ten, others in some 32.
RADIUS = 16
#: Fingerprints of a BK-tree.
TREE = 1024
#: Counts that order the shingles; their number is fixed, since they need only tell common shingles from rare ones.
BUCKET_BITS = 20
POST = "h long, n long, place long, cls long"
#: Words of 64 bits in a parity sketch.
SKETCH = 8
SKETCHES = [f"s{k}" for k in range(SKETCH)]


def shingle_set(text: bytes | None) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending; a text of fewer words than a shingle is one, of all of them."""
    words = (text or b"").translate(FOLD).split()
    return np.unique(common.sequence_hashes(common.word_hashes(words), min(SHINGLE, len(words)))) if words else np.empty(0, np.uint64)


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Bits that the shingles flip, each one; of two sets, as many bits differ as an odd number of shingles flip that only one of them has."""
    flips = np.bincount((h >> np.uint64(7) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, one_in: int = 16) -> np.ndarray:
    """How many sampled texts hold a shingle of each bucket of hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in common.text_slices(batches, limit=4 << 20):
            for text in batch.column("text").to_pylist():
                np.add.at(total, _bucket(shingle_set(text)), 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["bucket", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select(F.col("text").cast("binary").alias("text"))
    found = sample.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 1 << BUCKET_BITS rows at most
    out = np.zeros(1 << BUCKET_BITS, np.int32)
    out[np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
    return out


def with_prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, n, fp, prefix, s0 ..) of each row of ``docs`` (doc_id, text): the class of its shingle set, the set's size, the fingerprint, the set's prefix and sketch."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, limit=4 << 20):
            cls, n, prefixes, sketches = [], [], [], []
            texts = batch.column("text").to_pylist()
            fps = common.signed(fingerprints(texts, SHINGLE))
            for text in texts:
                h = shingle_set(text)
                cls.append(xxh64_intdigest(h.tobytes()))
                n.append(len(h))
                sketches.append(parity_sketch(h))
                prefixes.append(h[np.argsort(counts.value[_bucket(h)], kind="stable")][: len(h) - (4 * len(h) + 4) // 5 + 1])
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(common.signed(np.concatenate(prefixes))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(common.signed(np.array(cls, np.uint64))), pa.array(n, pa.int64()), pa.array(fps), lists, *map(pa.array, np.stack(sketches, axis=1))], names=["doc_id", "cls", "n", "fp", "prefix", *SKETCHES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, cls long, n long, fp long, prefix array<long>, " + ", ".join(f"{c} long" for c in SKETCHES))


def _by_group(posts: DataFrame, schema: str, found) -> DataFrame:
    """``found`` over the rows, as columns, of whole groups of one value of the first column (shingle or cell) each, in the order of that, size and class."""
    names = posts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c) for c in batch.columns])
            last = np.flatnonzero(rows[0] != rows[0, -1])
            stop = last[-1] + 1 if len(last) else 0
            if held and (stop or held[0][0, 0] != rows[0, -1]):
                yield from found(np.concatenate([*held, rows[:, :stop]], axis=1))
                held = []
            elif stop:
                yield from found(rows[:, :stop])
            held.append(rows[:, stop:])  # a group that may go on
        if held:
            yield from found(np.concatenate(held, axis=1))

    ordered = posts.repartition(names[0]).sortWithinPartitions(names[0], "n", "cls")
    return ordered.select(names).mapInArrow(run, schema)


def _in_order(posts: DataFrame, schema: str, found) -> DataFrame:
    """``found`` over the rows, as columns, of all batches, in the order of shingle, size and class; groups are not held."""
    names = posts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from found(np.stack([np.asarray(c) for c in batch.columns]) for batch in batches if batch.num_rows)

    return posts.repartition("h").sortWithinPartitions("h", "n", "cls").select(names).mapInArrow(run, schema)


def shared_posts(batches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of shingles that several classes have in their prefixes, once a class. A row waits for the next; no more is held."""
    held, before = None, False
    for rows in batches:
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        rows = rows[:, np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[3, 1:] != rows[3, :-1])]]
        equal = rows[0, 1:] == rows[0, :-1]
        shared = np.r_[before, equal]
        out = rows[:, :-1][:, shared[:-1] | equal]
        if out.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in out], names=["h", "n", "place", "cls"])
        held, before = rows[:, -1:], bool(shared[-1])
    if before:
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in held], names=["h", "n", "place", "cls"])


def _pairs(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs of rows that can be similar enough if their shingle is the first that they share."""
    n, place, cls = rows[1:4]
    can = 9 * np.minimum(n[a] - place[a], n[b] - place[b]) >= 4 * (n[a] + n[b])
    if len(rows) > 5:  # the sketches: sets of a similarity of 0.8 differ in a ninth of their sizes' sum at most
        a, b = a[can], b[can]
        can = 9 * np.bitwise_count((rows[5:, a] ^ rows[5:, b]).astype(np.uint64)).sum(axis=0, dtype=np.int64) <= n[a] + n[b]
    a, b = cls[a[can]], cls[b[can]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    if pairs.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def neighbour_pairs(batches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each class of a group with the next in size, whatever shingle the two share first: what they are for is to link groups early."""
    held = None
    for rows in batches:
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        a = np.flatnonzero((rows[0, 1:] == rows[0, :-1]) & (5 * rows[1, :-1] >= 4 * rows[1, 1:]))
        pairs = np.unique(np.sort(np.stack([rows[3, a], rows[3, a + 1]]), axis=0), axis=1)
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
        held = rows[:, -1:]


#: Rows of a shingle's group that one task compares at once; a larger group is cut into cells of at most some four times as many.
GROUP = 4096


def celled(posts: DataFrame, group: int = GROUP) -> DataFrame:
    """``posts`` (h, n, ..) dealt into cells: (cell, i, j, mine, low, ..).

    The group of a shingle that ``group`` rows or fewer have is one cell. A larger one is cut by size, in bands of a ratio of 1.26, and
    each band into blocks by class; a cell has two blocks (i and j) of a band, marked ``low``, and of the next band, and every pair that
    0.8 allows meets in one cell, as it lies within a band or in two that adjoin. ``mine`` is a row's block."""
    rest = [c for c in posts.columns if c not in ("h", "n", "cls")]
    large = posts.groupBy("h").agg(F.count("*").alias("size")).filter(F.col("size") > group)
    marked = posts.join(large, "h", "left").withColumns({"blocks": F.coalesce(F.ceil(F.col("size") / group), F.lit(1)).cast("int"), "band": F.when(F.col("size").isNull(), F.lit(0)).otherwise(F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1.26)))).cast("int")})
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    bands = F.when(F.col("size").isNull(), F.array(F.col("band"))).otherwise(F.array(F.col("band"), F.col("band") - 1))
    dealt = marked.withColumn("mine", mine).select("h", "n", "cls", *rest, "mine", "blocks", "band", F.explode(bands).alias("at"))
    dealt = dealt.select("h", "n", "cls", *rest, "mine", "at", (F.col("at") == F.col("band")).cast("long").alias("low"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    return dealt.select(F.xxhash64("h", "at", i, j).alias("cell"), "n", F.col("h"), "cls", *rest, (F.col("mine") == i).cast("long").alias("in_i"), (i == j).cast("long").alias("same"), "low")


def open_pairs(rows: np.ndarray, block: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """All pairs of a cell in different components, within the sizes that 0.8 allows. ``rows`` are cell, n, place, cls, component, sketches, and then in_i, same and low."""
    groups, group = np.unique(rows[0], return_inverse=True)
    # A cell whose rows are all in one component has nothing open.
    first = np.full(len(groups), np.iinfo(np.int64).max)
    last = np.full(len(groups), np.iinfo(np.int64).min)
    np.minimum.at(first, group, rows[4])
    np.maximum.at(last, group, rows[4])
    rows = rows[:, (first != last)[group]]
    if not rows.shape[1]:
        return
    _, group = np.unique(rows[0], return_inverse=True)
    in_i, same, low = rows[-3:].astype(bool)
    key = (group.astype(np.int64) << 40) + rows[1]
    stop = np.searchsorted(key, (group.astype(np.int64) << 40) + 5 * rows[1] // 4, side="right")
    counts = stop - np.arange(len(stop)) - 1
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + block, side="right")))
        a = np.repeat(np.arange(lo, hi), counts[lo:hi])
        b = np.arange(len(a)) - np.repeat(ends[lo:hi] - counts[lo:hi] - base, counts[lo:hi]) + a + 1
        fit = (rows[4, a] != rows[4, b]) & (low[a] | low[b]) & (same[a] | (in_i[a] != in_i[b]))
        yield from _pairs(rows[:-3], a[fit], b[fit])
        lo = hi


def fingerprint_pairs(posts: DataFrame, prints: DataFrame, radius: int = RADIUS, tree_size: int = TREE) -> DataFrame:
    """Pairs (a, b) of classes whose fingerprints BK-trees find within ``radius`` bits of one another; ``posts`` (h, .., cls), ``prints`` (cls, fp).

    A shard has the classes of one prefix shingle. One of more than ``tree_size`` is dealt into trees of about that size that are
    searched by their own members only, others in each shard. A fingerprint's least class stands for it; the others are paired with that."""
    first = prints.groupBy("fp").agg(F.min("cls").alias("cls"))
    shards = posts.select("h", "cls").join(first, "cls")
    large = shards.groupBy("h").count().filter(F.col("count") > tree_size).select("h", F.ceil(F.col("count") / tree_size).cast("int").alias("trees"))
    shards = shards.join(large, "h", "left").select("fp", F.pmod(F.xxhash64("fp", "h"), F.coalesce("trees", F.lit(1))).cast("int").alias("block"), F.col("h").alias("value"))
    links = shard_links(shards, radius, 2 * tree_size).distinct()
    near = links.join(first.select(F.col("fp").alias("a"), F.col("cls").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("cls").alias("y")), "b")
    equal = prints.join(first.withColumnRenamed("cls", "y"), "fp").select(F.col("cls").alias("x"), "y").filter("x != y")
    return near.select("x", "y").union(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``found`` (node, component) has in different components."""
    def side(name: str) -> DataFrame:
        return found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_component"))

    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.filter(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")


def sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and sketches (cls, n, s0 ..) allow a similarity of 0.8; no similar pair goes."""
    def side(name: str) -> DataFrame:
        return sketches.select(F.col("cls").alias(name), F.col("n").alias(f"{name}_n"), *(F.col(c).alias(f"{name}_{c}") for c in SKETCHES))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCHES)
    return both.filter(9 * differ <= F.col("a_n") + F.col("b_n")).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets have a Jaccard similarity of 0.8 or more; exact, in whole numbers. A staged table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, limit=4 << 20):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            cls = common.signed(np.array([xxh64_intdigest(h.tobytes()) for h in sets], np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(common.signed(np.concatenate(sets))))
            yield pa.RecordBatch.from_arrays([pa.array(cls), lists], names=["cls", "h"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = common.staged(wanted.join(classes, "cls").select("cls", F.col("least").alias("doc_id")), "wanted")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(wanted.select("doc_id").distinct(), "doc_id").select("text")
    # A doc_id may have several texts, and rows may repeat: the class tells which set is meant.
    sets = texts.mapInArrow(run, "cls long, h array<long>").join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    sets = common.staged(sets, "sets")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("cls").alias("b"), F.col("h").alias("hb")), "b")
    links = common.staged(both.filter(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b"), "links")
    common.forget(wanted, sets)
    return links


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of each row of ``docs`` that has a doc_id; component_id is the least doc_id that links lead to.

    A doc_id that repeats is in the group of each of its texts. Texts without words are equal to one another.
    """
    marked = common.staged(with_prefixes(docs.filter("doc_id IS NOT NULL")), "prefixes")
    classes = common.staged(marked.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp"), *(F.min(c).alias(c) for c in SKETCHES)), "classes")
    sketches, prints, classes = classes.select("cls", "n", *SKETCHES), classes.select("cls", "fp"), classes.select("cls", "least")
    one = marked.join(classes.withColumnRenamed("least", "doc_id"), ["cls", "doc_id"])
    posts = one.select("cls", "n", F.posexplode("prefix").alias("place", "h")).select("h", "n", F.col("place").cast("long").alias("place"), "cls")
    posts = common.staged(_in_order(posts, POST, shared_posts), "posts")
    close = common.staged(sketched(fingerprint_pairs(posts, prints), sketches), "pairs")
    linked = verified(close, docs, classes)
    found = common.staged(connected_components(linked), "components")
    first = common.staged(sketched(apart(_in_order(posts, "a long, b long", neighbour_pairs).distinct(), found), sketches), "pairs")
    early = verified(first, docs, classes)
    common.forget(found)
    found = connected_components(linked.union(early)).withColumnRenamed("node", "cls")
    labelled = posts.join(found, "cls", "left").join(sketches.drop("n"), "cls").select("h", "n", "place", "cls", F.coalesce("component", "cls").alias("component"), *SKETCHES)
    labelled = common.staged(labelled, "labelled")
    # Shingles that only one component has are done; the rest is dealt into cells of a bounded size.
    several = labelled.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("h")
    cells = celled(labelled.join(several, "h", "left_semi")).select("cell", "n", "place", "cls", "component", *SKETCHES, "in_i", "same", "low")
    rest = common.staged(_by_group(cells, "a long, b long", open_pairs).distinct().join(close.union(first), ["a", "b"], "left_anti"), "pairs")
    common.forget(posts, close, first, labelled)
    late = verified(rest, docs, classes)
    found = common.staged(connected_components(linked.union(early).union(late)), "components").withColumnRenamed("node", "cls")
    common.forget(rest, linked, early, late)
    named = classes.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cls", "component_id")
    return marked.select("doc_id", "cls").join(named, "cls").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the least of its group; rows without doc_id stay."""
    dropped = near_components(docs).filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(common.columns_of(docs))
