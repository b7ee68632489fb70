import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from waveloom.llm import components, simhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(y >> b & 1 for y in h) > len(h))


def joined(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_against_plain(docs, rows):
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    known = sorted({f for d, f in fps if d is not None})
    of = joined([(a, b) for a in known for b in known if (a ^ b).bit_count() <= 3], known)
    least = {}
    for d, f in fps:
        if d is not None:
            least[of[f]] = min(d, least.get(of[f], d))
    want = Counter((d, f"{f:016x}", None if d is None else least[of[f]]) for d, f in fps)
    out = simhash.near_components(docs).select("doc_id", simhash.hex_fingerprint(), "component_id")
    assert Counter(tuple(r) for r in out.collect()) == want


def test_many_small_trees(spark):
    """Hot blocks cut into tiny trees give the same components."""
    r = random.Random(5)
    values = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(60):
            v = base
            for _ in range(r.randint(0, 5)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for size in (4096, 7):
        links = simhash.near_links(fps, 3, size)
        pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in links.collect()]
        want = joined([(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3], values)
        assert joined(pairs, values) == want


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]
    got = {a: b for a, b in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == joined(pairs, nodes)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(docs, no_docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r[0] for r in kept.select("doc_id").collect())
    lost = {r[0] for r in simhash.near_components(docs).filter("doc_id != component_id").collect()}
    assert {5, 7, 8, 10} <= lost and ids == Counter(d for d in (r[0] for r in docs.select("doc_id").collect()) if d not in lost)
    assert simhash.keep_one(no_docs).count() == 0


def test_bits_of_many_shingles():
    text = " ".join(f"w{i}" for i in range(70_000)).encode()
    assert simhash.fingerprints([text, None, b"A b"])[1:].tolist() == [0, plain_fingerprint("A b")]
    assert np.uint64(plain_fingerprint(text.decode())) == simhash.fingerprints([text])[0]


def test_radius_is_inclusive(spark):
    fps = spark.createDataFrame([(0,), (7,), (15,)], "fp long")
    assert simhash.near_links(fps).filter((F.col("a") == 7) | (F.col("b") == 7)).count() >= 1


def test_links_are_near(spark):
    """Each link itself is within the radius, not only joined to it by others."""
    values = [sum(1 << (3 * k + i) for i in range(3)) for k in range(8)] + [0, *(sum(1 << i for i in range(n)) for n in range(6, 40, 3))]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in set(values)], "fp long")).collect()
    assert links and all((a ^ b).bit_count() <= 3 for a, b in links)
