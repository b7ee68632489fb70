import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import same
from waveloom.llm import common, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, n int, m int, bag string, `a.b` int"


def plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k):
    cut = [(i, plain_terms(x)) for i, x in docs]
    cut = [(i, Counter(t), len(t)) for i, t in cut if t]
    n_docs, n_terms = len(cut), sum(n for *_, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = Counter()
    for item_id, text in items:
        scored = []
        for doc_id, c, n in cut:
            m, score = 100 - 75 + (75 * n * n_docs) // n_terms, 0
            for t in plain_terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        ties = defaultdict(list)
        for rank, (s, _, doc_id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            ties[s].append((rank, doc_id))
            out[item_id, rank, doc_id, -s] += 1
    return out


def test_terms():
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(chr(r.choice([r.randrange(128), r.randrange(128), r.randrange(128, 900), 0x1F600, 0x130, 0xA0])) for _ in range(20))
        assert [t.decode() for t in lexical.terms(text.encode())] == plain_terms(text)


def test_query(spark, rows, docs, tmp_path):
    r = random.Random(8)
    texts = [x[1] for x in rows]
    long = texts[11].split()
    items = [(1, "one two"), (2, None), (3, ""), (4, " ".join(long[:40])), (5, texts[3]), (6, "AB ab Ab ab ZZ"), (7, "日本 é É 12"), (None, "end start"), (5, texts[3]), (5, "one"), (8, "!!! --"), (9, " ".join(r.choices(long, k=3000)))]
    table = spark.createDataFrame([(*i, 1, 2, 3, "b", None) for i in items], ITEMS)
    more = docs.select("doc_id", "text").union(spark.range(2000, 2400).select("id", F.lit("one x")))  # one class of many documents
    flat = [(x[0], x[1]) for x in rows] + [(i, "one x") for i in range(2000, 2400)]
    for k, size in ((10, 1 << 20), (3, 9000)):
        out = lexical.search(more, table, k, size)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(tuple(x) for x in out.collect()) == plain(flat, items, k)
    assert lexical.search(docs.limit(0), table).count() == 0
    assert lexical.search(docs, table.limit(0)).count() == 0
    assert lexical.search(docs.filter("doc_id IN (6, 7, 8)"), table).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert Counter(tuple(x) for x in lexical.op13_lexical(spark, str(tmp_path)).collect()) == plain(flat[: len(rows)], items, 10)


def test_classes_are_scored_once(spark, docs):
    kept = lexical.bags(docs.filter("doc_id IN (4, 5, 14, 9, 10)"), {b"one": 0})
    by_id = {}
    for x in kept.collect():
        by_id.setdefault(x.doc_id, x.bag)
    assert by_id[9] == by_id[10] == np.array([[0, 1]], "<u4").tobytes() and by_id[4] == by_id[5] == b""


def test_sums_beyond_doubles():
    weights = np.array([2_000_000, 3], np.int64)
    items = [[0] * 5000 + [1], [1, 1]]
    found = lexical._Postings(items, weights)
    assert not found.exact_in_doubles and lexical._Postings([[1]], weights).exact_in_doubles
    rows, term, occurrences, m = np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([10**6, 3, 1]), np.array([25, 400])
    got = found.scores(rows, term, occurrences, m)
    def part(t, o, x):
        return int(weights[t]) * ((10**9 * o) // (1000 * o + 8 * x))

    assert got.tolist() == [[5000 * part(0, 10**6, 25) + part(1, 3, 25), 2 * part(1, 3, 25)], [part(1, 1, 400), 2 * part(1, 1, 400)]]


def test_steps_agree(monkeypatch):
    rng = np.random.default_rng(3)
    weights = rng.integers(0, 9000, 50)
    found = lexical._Postings([rng.integers(0, 50, 30).tolist() for _ in range(40)], weights)
    rows = np.sort(rng.integers(0, 60, 900))
    term, occurrences, m = rng.integers(0, 50, 900), rng.integers(1, 99, 900), rng.integers(25, 999, 60)
    whole = found.scores(rows, term, occurrences, m)
    monkeypatch.setattr(lexical, "STEP", 100)
    assert (found.scores(rows, term, occurrences, m) == whole).all()


def test_sql(spark, sf_dir, duck):
    common.ready(spark)
    same(lexical.op13_lexical(spark, sf_dir).toPandas(), duck.sql(lexical.ORACLE_SQL).df())
