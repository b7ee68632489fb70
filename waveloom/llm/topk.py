"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks of bounded size, and so are queries; blocks of queries are sent to the buckets that hold
the blocks of vectors. Each round scores everything, counts for each query how many scores fall into each bin of the
range that holds its k-th best score, and narrows the range to the bin where the k-th lies, until bins are one score
wide. A last round returns what reaches that score, and ties go to the smaller id.

A task adds up its counts and returns, for each query, only the top bins that hold the scores still to be found: a bin
below those of any one task cannot hold the k-th score of all. In the last round a block returns at most k rows a query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BINS = 512
EXACT = 2.0**53
#: Greatest score that is searched; histograms need room for twice as much.
LARGEST = 1 << 61


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, held as doubles, in the least integer type that holds them, or as doubles."""
    top = np.abs(values).max(initial=0)
    kind = "b" if top < 1 << 7 else "h" if top < 1 << 15 else "i" if top < 1 << 31 else "d"
    return kind.encode() + values.astype(kind).tobytes()


def unpack(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, data[:1].decode(), offset=1).reshape(rows, -1).astype(np.float64)


def scored(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if bound < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in queries], object) @ np.array([[int(x) for x in row] for row in vectors], object).T
    if exact.size and max(exact.max(), -exact.min()) > LARGEST:
        raise OverflowError("a score is beyond the range of 64-bit integers that can be searched")
    return exact.astype(np.int64)


def blocks(vectors: DataFrame, id_column: str, vector_column: str, scale: float, size: int) -> DataFrame:
    """Blocks (block, dim, n, ids, data, norm) of ``size`` rows, each component x being floor(scale * x).

    Rows without id, and vectors that are null or hold null or non-finite components, take no part."""
    usable = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(
        f"id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity') OR abs(x * {scale}D) = double('Infinity'))"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            ids, data = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            norm = float(np.sqrt((data * data).sum(axis=1)).max(initial=0))
            return pa.RecordBatch.from_arrays([pa.array([x]) if not isinstance(x, pa.Array) else x for x in (uuid.uuid4().int >> 65, dim, pa.array([len(ids)], pa.int32()), ids.tobytes(), pack(data), norm)], names=["block", "dim", "n", "ids", "data", "norm"])

        for batch in batches:
            ids, column = np.asarray(batch.column("id")), batch.column("v")
            widths = np.diff(np.asarray(column.offsets))
            flat = np.floor(scale * np.asarray(column.flatten()))
            starts = np.cumsum(widths) - widths
            for dim in np.unique(widths):
                rows = np.flatnonzero(widths == dim)
                data = flat[starts[rows][:, None] + np.arange(dim)]
                for lo in range(0, len(rows), size):
                    mine = held.setdefault(int(dim), [])
                    mine.append((ids[rows[lo : lo + size]], data[lo : lo + size]))
                    if sum(len(r[0]) for r in mine) >= size:
                        yield block(int(dim), held.pop(int(dim)))
        for dim, rows in held.items():
            yield block(dim, rows)

    return usable.mapInArrow(run, "block long, dim long, n int, ids binary, data binary, norm double")


def _over_pairs(asked: DataFrame, stored: DataFrame, buckets: int, work: Callable[[], object], schema: str) -> DataFrame:
    """Send each block of queries to every bucket of stored blocks, and feed the pairs to a worker made by ``work``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = work()
        for batch in batches:
            for row in batch.to_pylist():
                yield from worker.pair(row)
        yield from worker.rest()

    sent = asked.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    kept = stored.select("bucket", "dim", F.col("n").alias("vn"), F.col("ids").alias("vids"), F.col("data").alias("vdata"))
    return sent.join(kept.hint("merge"), ["bucket", "dim"]).drop("bucket", "dim").mapInArrow(run, schema)


class _Counter:
    """Adds up histograms of a few query blocks at a time."""

    names = ("qblock", "qpos", "bin", "n")

    def __init__(self, most: int = 4):
        self.most, self.held = most, {}

    def pair(self, row: dict) -> Iterator[pa.RecordBatch]:
        key = row["qblock"]
        if key not in self.held:
            if len(self.held) >= self.most:
                yield self.flush(next(iter(self.held)))
            state = row["state"]
            pos = np.array([s["qpos"] for s in state])
            self.held[key] = (pos, np.array([s["lo"] for s in state]), (state[0]["width"], state[0]["span"]), np.array([s["rank"] for s in state]), np.frombuffer(row["ids"], np.int64)[pos], unpack(row["data"], row["n"])[pos], np.zeros((len(pos), BINS), np.int64))
        pos, lo, (width, span), _, qids, queries, counts = self.held[key]
        vids = np.frombuffer(row["vids"], np.int64)
        s = scored(queries, unpack(row["vdata"], row["vn"]))
        s -= lo[:, None]
        fit = (s >= 0) & (s < span) & (qids[:, None] != vids[None, :])
        where = (s // width + np.arange(len(pos))[:, None] * BINS)[fit]
        counts += np.bincount(where, minlength=counts.size).reshape(counts.shape)

    def flush(self, key: int) -> pa.RecordBatch:
        pos, _, _, rank, _, _, counts = self.held.pop(key)
        down = counts[:, ::-1]
        above = np.cumsum(down, axis=1) - down
        q, b = np.nonzero((down > 0) & (above < rank[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), key)), pa.array(pos[q].astype(np.int32)), pa.array((BINS - 1 - b).astype(np.int64)), pa.array(down[q, b])], names=self.names)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for key in list(self.held):
            yield self.flush(key)


class _Collector:
    """Returns the scores that reach a query's k-th, of each block at most k a query."""

    names = ("qblock", "qpos", "query_id", "vec_id", "score")

    def __init__(self, k: int):
        self.k = k

    def pair(self, row: dict) -> Iterator[pa.RecordBatch]:
        pos = np.array([s["qpos"] for s in row["state"]])
        least = np.array([s["lo"] for s in row["state"]])
        qids, vids = np.frombuffer(row["ids"], np.int64)[pos], np.frombuffer(row["vids"], np.int64)
        s = scored(unpack(row["data"], row["n"])[pos], unpack(row["vdata"], row["vn"]))
        q, v = np.nonzero((s >= least[:, None]) & (qids[:, None] != vids[None, :]))
        order = np.lexsort((vids[v], -s[q, v], q))
        q, v = q[order], v[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        q, v = q[place < self.k], v[place < self.k]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row["qblock"])), pa.array(pos[q].astype(np.int32)), pa.array(qids[q]), pa.array(vids[v]), pa.array(s[q, v])], names=self.names)

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0, query_block: int = 1024, vector_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the ``k`` rows of greatest integer inner product, ties to smaller ids.

    A row never answers a query of its own id. Rows that repeat count each, as queries and as answers; a query with fewer
    than k candidates gets them all. A query meets vectors of its own length only. Empty tables give an empty result.
    Components that are infinite once scaled are non-finite, and take no part; scores beyond ``LARGEST`` raise an error.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    stored = common.staged(blocks(vectors, id_column, vector_column, scale, vector_block), "vector-blocks")
    asked = common.staged(blocks(queries, id_column, vector_column, scale, query_block).withColumnRenamed("block", "qblock"), "query-blocks")
    n_blocks, norm = stored.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    # Few enough blocks a bucket to buffer one bucket, and at least as many buckets as partitions.
    buckets = max(1, min(n_blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 64)))
    stored = stored.withColumn("bucket", F.pmod(F.col("block"), F.lit(buckets)).cast("int"))
    top = int(min(float(LARGEST), norm * asked.agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0] * (1 + 1e-9))) + 1
    span = 2 * top + 1
    width = -(-span // BINS)
    state = asked.select("qblock", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("qpos")).withColumns({"lo": F.lit(-top).cast("long"), "rank": F.lit(k).cast("long"), "all": F.lit(False)})
    while True:
        open_ones = state.filter(~F.col("all")).withColumns({"width": F.lit(width).cast("long"), "span": F.lit(span).cast("long")})
        rows = open_ones.groupBy("qblock").agg(F.collect_list(F.struct("qpos", "lo", "width", "span", "rank")).alias("state"))
        counts = _over_pairs(asked.select("qblock", "dim", "n", "ids", "data").join(rows, "qblock"), stored, buckets, _Counter, "qblock long, qpos int, bin long, n long")
        summed = counts.groupBy("qblock", "qpos", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("qblock", "qpos").orderBy(F.desc("bin")))
        found = state.join(summed.withColumn("upto", upto), ["qblock", "qpos"], "left")
        hit = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))
        picked = F.max(F.when(hit, F.struct(F.col("bin"), (F.col("upto") - F.col("n")).alias("above"))))
        state = found.groupBy("qblock", "qpos", "lo", "rank", "all").agg(picked.alias("hit")).select(
            "qblock", "qpos",
            F.when(F.col("all") | F.col("hit").isNull(), F.lit(-top)).otherwise(F.col("lo") + F.col("hit.bin") * width).cast("long").alias("lo"),
            F.coalesce(F.col("rank") - F.col("hit.above"), F.col("rank")).alias("rank"),
            (F.col("all") | F.col("hit").isNull()).alias("all"),
        )
        state = common.staged(state, "top-k-state")
        if width == 1:
            break
        span, width = width, -(-width // BINS)
    rows = state.groupBy("qblock").agg(F.collect_list(F.struct("qpos", "lo")).alias("state"))
    reached = _over_pairs(asked.select("qblock", "dim", "n", "ids", "data").join(rows, "qblock"), stored, buckets, lambda: _Collector(k), "qblock long, qpos int, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("qblock", "qpos").orderBy(F.desc("score"), "vec_id"))
    return reached.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every fiftieth vector among all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
           FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
