from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import same
from waveloom.llm import common, topk, warc


def plain_top(vectors, queries, k):
    def whole(v):
        return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * x)) for x in v]

    stored = [(i, whole(v)) for i, v, *_ in vectors if i is not None and whole(v) is not None]
    out = Counter()
    for q, v in [(i, whole(v)) for i, v, *_ in queries if i is not None and whole(v) is not None]:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in stored if i != q and len(w) == len(v))
        for rank, (s, i) in enumerate(scores[:k], 1):
            out[q, rank, i, -s] += 1
    return out


def test_topk(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=8).round(2).tolist(), "x") for i in range(120)]
    vectors += [(i, [0.5] * 8, "x") for i in range(200, 260)]  # ties
    vectors += [(300, None, "x"), (301, [1.0, None] * 4, "x"), (302, [float("nan")] * 8, "x"), (303, [float("inf")] * 8, None), (None, [1.0] * 8, "x"), (304, [1.0] * 3, "x"), (305, [2.0] * 3, "x"), (306, [], "x"), (0, [1e6] * 8, "x"), (7, [0.25] * 8, "x"), (7, [0.25] * 8, "x")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string").repartition(4)
    queries = df.filter(F.col("vec_id") % 7 == 0)
    picked = [v for v in vectors if v[0] is not None and v[0] % 7 == 0]
    for k, sizes in ((5, {}), (3, {"query_block": 4, "vector_block": 9}), (500, {})):
        out = topk.exact_top_k(df, queries, k, **sizes).select("query_id", "rank", "vec_id", "score")
        assert Counter(tuple(r) for r in out.collect()) == plain_top(vectors, picked, k)
    assert topk.exact_top_k(df.limit(0), queries, 5).count() == 0
    assert topk.exact_top_k(df, queries.limit(0), 5).count() == 0


def test_scores_beyond_doubles():
    big = np.array([[2.0**40, 1.0]])
    assert topk.scored(big, np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 1
    with pytest.raises(OverflowError):
        topk.scored(big, np.array([[2.0**40, 1.0]]))


PAGES = "page_id long, url string, html string, digest string, key int"


def test_warc(spark):
    rows = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 300_000), (6, "u", "only"), (6, "u", "only"), (None, "u", "alone"), (None, "u", "<p>é</p>"), (7, "u", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "zz", 1) for r in rows], PAGES).repartition(3)
    folder = common.new_folder(spark, "w")
    index = warc.write_archives(pages, folder, roll_bytes=2000)
    out = warc.read_records(index, folder, chunk_bytes=1000).collect()
    assert len(out) == len(rows) and index.count() == len(rows)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        head = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        revisit = head is not None and i != head
        want[i, len(data), warc.payload_digest(data), "revisit" if revisit else "response", head if revisit else None] += 1
    assert got == want
    some = index.filter("page_id IN (1, 5)")
    assert {r["page_id"] for r in warc.read_records(some, folder).collect()} == {1, 5}
    whole = warc.write_archives(pages, folder, min_revisit_bytes=100)
    assert warc.read_records(whole, folder).filter("record_type = 'revisit'").count() == 0
    assert warc.write_archives(pages.limit(0), folder).count() == 0


def test_ranges_join_neighbours():
    assert list(warc.ranges([0, 10, 30, 500], [10, 10, 10, 10], 10, 1000)) == [(0, 3), (3, 4)]
    assert list(warc.ranges([0, 10, 20], [10, 10, 10], 0, 20)) == [(0, 2), (2, 3)]


@pytest.mark.parametrize("name", ["op1_topk", "op2_phrases", "op4_warc", "op5_decontaminate", "op7_suffixes"])
def test_oracles(spark, sf_dir, duck, name):
    from waveloom.llm import queries

    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())
