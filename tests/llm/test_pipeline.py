"""The five stages against plain Python, on the smallest tables and on awkward rows."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_near_copies import plain as near_copies_of
from waveloom.llm import pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, items):
    """rows: (doc_id, text)"""
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    lost = near_copies_of(rows)
    rows = [(d, t) for d, t in rows if d not in lost]
    words = [(d, t, [m.span() for m in WORD.finditer(t)]) for d, t in rows]
    first = {}
    for d, t, w in words:
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(t[a:b] for a, b in w[i : i + 50])
                first[k] = min(d, first.get(k, d))
    rows = []
    for d, t, w in words:
        gone = {k for i in range(len(w) - 49) if d is not None and first[tuple(t[a:b] for a, b in w[i : i + 50])] < d for k in range(i, i + 50)}
        drop = {c for k in gone for c in range(*w[k])}
        left = "".join(c for i, c in enumerate(t) if i not in drop)
        if left.split() or not gone:
            rows.append((d, left))

    def shingles(t):
        x = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
        return {" ".join(x[i : i + 5]) for i in range(len(x) - 4)}

    wanted = [s for s in map(shingles, items) if s]
    leaked = {d for d, t in rows if d is not None for s in wanted if len(s & shingles(t)) >= 0.8 * len(s) - 1e-9}
    out = Counter()
    sp = pieces.encoder(pieces.model_path()).library
    for d, t in rows:
        if d not in leaked:
            ids = sp.encode(t)
            out[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    return out


def test_against_plain(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == plain(docs, items)


def test_awkward_rows(spark, docs, rows, sf_dir, tmp_path):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs.drop("a.b").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain([(r[0], r[1]) for r in rows], items)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name


def test_no_rows(spark, no_docs, sf_dir):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
