"""Ranked lexical search over bags that many documents share.

Only what the items ask for can score, so each document is restricted to the items' vocabulary: a bag of (term, occurrences).
Documents of equal bags and equal length class m score alike. They are grouped by a hash of both and by the bag itself, so
equal hashes alone never make a class; each class is scored once, in Arrow batches, through the items' postings; and the
best classes of an item are expanded to their documents by ascending doc_id.

Items go in blocks of ``block_bytes`` of text, each with its own vocabulary, which bounds what is broadcast and what a task
holds; all blocks see all documents. Scores are whole numbers: they are added as doubles where 2^53 bounds the
sum an item can reach, and as 64-bit integers otherwise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes that belong to a term map to themselves, A-Z to a-z, all others to a space.
_TERM_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Share of a document's length in m, in hundredths; and the scale of a term's saturation.
LENGTH_SHARE, SCALE, SATURATION = 75, 1_000_000_000, 8
#: Postings that are worked on together.
STEP = 1 << 20


def terms(text: bytes) -> list[bytes]:
    """The maximal runs of digits, letters and characters beyond ASCII in a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag) of each document with a term: n counts its terms, ``bag`` has the (term, occurrences) of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for whole in batches:
            for batch in common.text_slices([whole]):
                ids, counts, packed = [], [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = terms(text)
                    if words:
                        found = Counter(map(get, words))
                        found.pop(None, None)
                        ids.append(doc_id)
                        counts.append(len(words))
                        packed.append(np.array(sorted(found.items()), "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "bag"])

    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, bag binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and occurrences of each entry of a column of bags."""
    data = column.to_pylist()
    entries = np.frombuffer(b"".join(data), "<u4").reshape(-1, 2)
    return np.repeat(np.arange(len(data)), [len(d) // 8 for d in data]), entries[:, 0].astype(np.int64), entries[:, 1].astype(np.int64)


def _document_counts(classes: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            rows, term, _ = _unpacked(batch.column("bag"))
            np.add.at(total, term, np.asarray(batch.column("members"))[rows])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "docs"])

    out = np.zeros(size, np.int64)
    for row in classes.select("bag", "members").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toLocalIterator():
        out[row.term] = row.docs
    return out


class _Postings:
    """The items of each term, and how often they have it."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        rows = sorted((t, i, c) for i, item in enumerate(items) for t, c in Counter(item).items())
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.item, self.count = table[:, 1], table[:, 2]
        self.start = np.searchsorted(table[:, 0], np.arange(len(weights) + 1))
        self.weights, self.items = weights, len(items)
        # No occurrence adds more than weight * SCALE / 1000.
        most = np.bincount(self.item, (weights[table[:, 0]] * self.count).astype(float), self.items).max(initial=0.0) * (SCALE // 1000)
        self.exact_in_doubles = most < 2.0**53

    def scores(self, rows: np.ndarray, term: np.ndarray, occurrences: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The score of each class (rows) for each item."""
        value = self.weights[term] * ((SCALE * occurrences) // (1000 * occurrences + SATURATION * m[rows]))
        out = np.zeros(len(m) * self.items, np.int64)
        lengths = self.start[term + 1] - self.start[term]
        ends = np.cumsum(lengths)
        at = 0
        while at < len(term):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
            n = lengths[at:stop]
            place = np.repeat(self.start[term[at:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(rows[at:stop] * self.items, n) + self.item[place]
            gain = np.repeat(value[at:stop], n) * self.count[place]
            if self.exact_in_doubles:
                low, high = rows[at] * self.items, (rows[stop - 1] + 1) * self.items
                out[low:high] += np.bincount(cell - low, gain, high - low).astype(np.int64)
            else:
                np.add.at(out, cell, gain)
            at = stop
        return out.reshape(len(m), self.items)


def _best_classes(classes: DataFrame, postings: _Postings, k: int) -> DataFrame:
    """(item, class, score, first): of each task's classes the ``k`` best of each item, ties to the class with the smaller first document."""
    sent = classes.sparkSession.sparkContext.broadcast(postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        best = np.zeros((0, 4), np.int64)  # item, score, first, class
        least = np.zeros(found.items, np.int64)
        for whole in batches:
            size = max(1, (4 << 20) // max(1, found.items))
            for batch in (whole.slice(i, size) for i in range(0, whole.num_rows, size)):
                scores = found.scores(*_unpacked(batch.column("bag")), np.asarray(batch.column("m")))
                row, item = np.nonzero((scores > 0) & (scores >= least))
                first, class_ = np.asarray(batch.column("first")), np.asarray(batch.column("class"))
                best = np.concatenate([best, np.stack([item, scores[row, item], first[row], class_[row]], axis=1)])
                best = best[np.lexsort((best[:, 3], best[:, 2], -best[:, 1], best[:, 0]))]
                begin = np.searchsorted(best[:, 0], best[:, 0])
                place = np.arange(len(best)) - begin
                full = best[place == k - 1]
                least[full[:, 0]] = full[:, 1]
                best = best[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(best[:, i]) for i in (0, 3, 1, 2)], ["item", "class", "score", "first"])

    return classes.select("bag", "m", "first", "class").mapInArrow(run, "item long, class long, score long, first long")


def _block(docs: DataFrame, items: list[tuple], item_type: str, k: int) -> DataFrame:
    """The ranking for one block of items (item_id, text)."""
    spark = docs.sparkSession
    cut = [terms((text or "").encode()) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*cut)))}
    numbered = [[vocabulary[t] for t in c] for c in cut]
    kept = common.staged(bags(docs, vocabulary), "bags")
    n_docs, n_terms = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    length = F.lit(100 - LENGTH_SHARE) + F.expr(f"({LENGTH_SHARE} * n * {n_docs}L) div {max(1, n_terms)}L")
    classed = kept.filter(F.length("bag") > 0).withColumn("m", length.cast("long")).withColumn("h", F.xxhash64("bag", "m"))
    # A document without an id comes after all others.
    last = F.lit((1 << 63) - 1)
    grouped = classed.groupBy("h", "m", "bag").agg(F.count("*").alias("members"), F.min(F.coalesce(F.col("doc_id").cast("long"), last)).alias("first"))
    classes = common.staged(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    holding = _document_counts(classes, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    if n_docs and vocabulary:
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "first", "class"))
        best = _best_classes(classes, _Postings(numbered, weights), k).withColumn("place", place).filter(F.col("place") <= k).select("item", "class", "score")
    else:
        best = spark.createDataFrame([], "item long, class long, score long")
    best = common.staged(best, "best-classes")
    # k documents of a class are enough, however many it has.
    wanted = classes.join(best.select("class").distinct(), "class").select("class", "h", "m", "bag")
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.asc_nulls_last("doc_id")))
    members = classed.join(wanted, ["h", "m", "bag"]).select("class", "doc_id").withColumn("place", place).filter(F.col("place") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = best.join(members, "class").withColumn("rank", rank).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], f"item long, item_id {item_type}")
    out = common.staged(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    common.forget(kept, classes, best)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of ``items`` (item_id, text) the ``k`` documents of ``docs`` (doc_id, text) with the
    highest scores above 0, equal scores by ascending doc_id; all of them, if fewer.

    Rows of ``docs`` that repeat a doc_id are documents of their own, and a document without an id comes after all others of
    its score. Items that repeat are ranked each for itself. Null, empty and term-less texts take no part; empty tables give
    no rows; other columns are ignored. The driver holds one block of items, of about ``block_bytes`` of text or one
    item, at a time. Lengths and counts are multiplied as 64-bit integers, and an overflow raises an error."""
    spark = docs.sparkSession
    kept = common.staged(items.select("item_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")), "items")
    size = kept.agg(F.coalesce(F.sum("size"), F.lit(0)) + 64 * F.count("*")).first()[0]
    blocks = max(1, -(-size // block_bytes))
    while True:
        # By text as well as id: equal items weigh nothing more than one in a vocabulary, but their number must be bounded too.
        block = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(blocks))
        dealt = common.staged(kept.withColumn("block", block), "items")
        largest = dealt.groupBy("block").agg((F.sum("size") + 64 * F.count("*")).alias("size"), F.count("*").alias("n")).filter(F.col("n") > 1).agg(F.max("size")).first()[0]
        if largest is None or largest <= 2 * block_bytes:
            break
        common.forget(dealt)
        blocks *= 2
    item_type = items.schema["item_id"].dataType.simpleString()
    found = [_block(docs, [(r.item_id, r.text) for r in dealt.filter(F.col("block") == b).collect()], item_type, k) for b in range(blocks)]
    common.forget(kept, dealt)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
     d AS (SELECT doc_id, d, ts, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0),
     s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
     i AS (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     q AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS times FROM i GROUP BY i, term),
     p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY d, term),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
     c AS (SELECT p.d, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS v FROM p JOIN w USING (term) JOIN d USING (d), s),
     r AS (SELECT i, any_value(item_id) AS item_id, c.d, CAST(sum(times * v) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY i, c.d),
     k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r JOIN d USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
