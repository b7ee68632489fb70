"""The near-copy stage against plain Python: five-word shingles, Jaccard of 0.8 or more."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.conftest import phrase
from tests.llm.test_simhash import FOLD, joined
from waveloom.llm import near_copies


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain(rows):
    """The doc_ids that go."""
    least = {}
    for d, t in rows:
        if d is not None:
            s = shingles(t)
            least[s] = min(d, least.get(s, d))
    sets = list(least)
    of = joined([(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and similar(sets[i], sets[j])], range(len(sets)))
    top = {}
    for i, s in enumerate(sets):
        top[of[i]] = min(least[s], top.get(of[i], least[s]))
    return {d for d, t in rows if d is not None and top[of[sets.index(shingles(t))]] != d}


def left(spark, docs):
    return Counter(r[0] for r in corpus_pipeline.drop_near_copies(spark, docs, None).select("doc_id").collect())


def test_awkward_rows(spark, docs, no_docs, rows):
    lost = plain([(r[0], r[1]) for r in rows])
    assert {5, 16, 17} <= lost
    assert left(spark, docs) == Counter(r[0] for r in rows if r[0] not in lost)
    assert corpus_pipeline.drop_near_copies(spark, docs, None).columns == docs.columns
    assert not left(spark, no_docs)


def test_similarity_decides(spark):
    """Copies with a word replaced in many places, on both sides of 0.8, and a group of copies of copies."""
    rows = []
    for k in range(12):
        words = phrase(100 + k, 300).split()
        rows.append((1000 * k, " ".join(words)))
        for j, n in enumerate((1, 3, 5, 6, 7, 8, 12)):
            for i in range(n):
                words[(i + 1) * 300 // (n + 1)] = f"x{j}y{i}"
            rows.append((1000 * k + 1 + j, " ".join(words)))
            words = phrase(100 + k, 300).split()
    words = phrase(200, 200).split()
    for k in range(60):
        words[(37 * k) % 200] = f"z{k}"
        rows.append((50_000 + k, " ".join(words)))
    lost = plain(rows)
    assert {1, 2, 3} <= lost and 7 not in lost
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert left(spark, docs) == Counter(d for d, _ in rows if d not in lost)


def test_open_pairs_are_cut_in_blocks():
    rng = np.random.default_rng(1)
    rows = np.stack([rng.integers(0, 5, 80), rng.integers(50, 90, 80), np.zeros(80, np.int64), np.arange(80), rng.integers(0, 9, 80), *np.ones((3, 80), np.int64)])
    rows = rows[:, np.lexsort(rows[[3, 1, 0]])]
    want = {tuple(sorted((rows[3, i], rows[3, j]))) for j in range(80) for i in range(j) if rows[0, i] == rows[0, j] and rows[4, i] != rows[4, j] and 9 * min(rows[1, i], rows[1, j]) >= 4 * (rows[1, i] + rows[1, j])}
    for block in (1, 7, 1 << 20):
        got = [p for b in near_copies.open_pairs(rows, block) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert set(got) == want


def test_sketches_let_no_similar_pair_go():
    """Sketches of sets differ in no more bits than the sets differ in shingles, and the filter keeps every similar pair."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - k], rng.integers(0, 1 << 63, k // 2).astype(np.uint64)])) for k in range(0, 200, 4)]
    sketches = [near_copies.parity_sketch(s) for s in sets]
    n = np.array([len(s) for s in sets])
    rows = np.concatenate([np.zeros((1, len(sets)), np.int64), n[None], np.zeros((1, len(sets)), np.int64), np.arange(len(sets))[None], np.arange(len(sets))[None], np.stack(sketches, axis=1)])
    a, b = np.triu_indices(len(sets), 1)
    for i, j in zip(a, b):
        assert np.bitwise_count((sketches[i] ^ sketches[j]).astype(np.uint64)).sum() <= len(np.setxor1d(sets[i], sets[j]))
    kept = {p for batch in near_copies._pairs(rows, a, b) for p in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    similar = {(i, j) for i, j in zip(a.tolist(), b.tolist()) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert similar <= kept and len(kept) < len(a)


def test_cells_bring_all_pairs_together(spark):
    """A large group is cut into cells of a bounded size, and each pair within the sizes that 0.8 allows meets in one, and is seen once there."""
    rng = np.random.default_rng(2)
    posts = [(h, int(n), 0, c, c) for h, size in ((1, 300), (2, 7), (3, 20)) for c, n in enumerate(rng.integers(1, 400, size).tolist())]
    df = spark.createDataFrame(posts, "h long, n long, place long, cls long, component long")
    rows = near_copies.celled(df, 20).select("cell", "n", "place", "cls", "component", "in_i", "same", "low", "h").collect()
    sizes = Counter(r.cell for r in rows)
    assert max(sizes.values()) <= 8 * 20 and sizes.total() > len(posts)
    ordered = np.array(sorted(tuple(r)[:8] for r in rows), np.int64)
    ordered = ordered[np.lexsort((ordered[:, 3], ordered[:, 1], ordered[:, 0]))].T
    met = {p for b in near_copies.open_pairs(ordered, 50) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    want = {tuple(sorted((p[3], q[3]))) for i, p in enumerate(posts) for q in posts[:i] if p[0] == q[0] and 5 * min(p[1], q[1]) >= 4 * max(p[1], q[1])}
    allowed = {tuple(sorted((p[3], q[3]))) for i, p in enumerate(posts) for q in posts[:i] if p[0] == q[0]}
    assert want <= met <= allowed


def test_posts_stream():
    rng = np.random.default_rng(3)
    cls = rng.integers(0, 30, 200)
    rows = np.stack([rng.integers(0, 60, 200), cls % 4 + 1, rng.integers(0, 3, 200), cls])
    rows = rows[:, np.lexsort(rows[[3, 1, 0]])]
    once = {tuple(r[[0, 1, 3]]) for r in rows.T}
    groups = Counter(h for h, _, _ in once)
    want = {r for r in once if groups[r[0]] > 1}
    whole = [p for b in near_copies.neighbour_pairs(iter([rows])) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    for size in (1, 2, 7, 200):
        parts = [rows[:, i : i + size] for i in range(0, 200, size)]
        got = [p for b in near_copies.shared_posts(iter(parts)) for p in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
        assert {p for b in near_copies.neighbour_pairs(iter(parts)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)} == set(whole)


def test_fingerprints_link_near_copies(spark, monkeypatch):
    """With the exact search switched off, BK-trees over fingerprints alone still find near copies."""
    rows = []
    for k in range(20):
        words = phrase(300 + k, 300).split()
        rows.append((100 * k, " ".join(words)))
        for j in range(1, 4):
            words[97 * j] = f"x{k}y{j}"
            rows.append((100 * k + j, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(near_copies, "neighbour_pairs", lambda batches: iter(()))
    monkeypatch.setattr(near_copies, "open_pairs", lambda rows: iter(()))
    lost = plain(rows)
    assert len(lost) == 60 and left(spark, docs) == Counter(d for d, _ in rows if d not in lost)


def test_fingerprint_pairs(spark):
    """Pairs connect the classes of a shingle whose fingerprints are within the radius, small trees only their own members; equal fingerprints are one."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 6)
    fps = np.unique([int(b) ^ sum(1 << int(i) for i in rng.choice(62, rng.integers(0, 9), replace=False)) for b in base for _ in range(30)])
    prints = [(int(c), int(f)) for c, f in enumerate(np.concatenate([fps, fps[:10]]))]
    posts = [(h, c) for c, _ in prints for h in (c % 2, 7)]
    of = dict(prints)
    frames = spark.createDataFrame(posts, "h long, cls long"), spark.createDataFrame(prints, "cls long, fp long")
    for radius, size in ((6, 1000), (16, 1000), (6, 8)):
        got = [tuple(r) for r in near_copies.fingerprint_pairs(*frames, radius, size).collect()]
        assert len(got) == len(set(got)) and all(a < b and (of[a] ^ of[b]).bit_count() <= radius for a, b in got)
        near = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= (radius if size == 1000 else 0)]
        joint = joined(got, of)
        assert all(joint[a] == joint[b] for a, b in near)
        assert size == 1000 or len(got) > 10
