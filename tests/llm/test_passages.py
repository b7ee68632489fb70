"""Phrase automata and suffix arrays against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import phrase
from waveloom.llm import common, passages, phrases, suffixes


def plain(rows):
    """What both operators return: (doc_id, n_words, n_removed, digest) of each row."""
    words = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    out = []
    for d, w in words:
        gone = {k for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("operator", [phrases.without_repeats, suffixes.without_repeats])
def test_against_plain(docs, rows, operator):
    assert Counter(tuple(r) for r in passages.digests(operator(docs)).collect()) == plain(rows)


@pytest.mark.parametrize("operator", [phrases.without_repeats, suffixes.without_repeats])
def test_empty(no_docs, operator):
    assert operator(no_docs).count() == 0


def test_cut_keeps_the_rest(docs, rows):
    out = suffixes.cut_repeats(docs)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    assert (1, texts[1]) in got and (6, None) in got and (8, texts[8]) in got and (24, texts[24]) in got
    assert not {d for d, _ in got} & {4, 5}  # nothing was left
    cut = next(t for d, t in got if d == 2)
    assert cut.startswith(texts[2].split("\n")[0] + "\n") and cut.endswith(texts[2].split("\t")[1]) and len(cut.split()) == 30
    assert out.filter("doc_id = 2 AND n_chars = length(text)").count() == 1
    assert out.filter(F.col("`a.b`").isNotNull()).count() == 0


def near_copies(seed, n):
    """Documents that share passages in many ways: copies with words replaced, parts, parts of parts, and a hot passage."""
    import random

    r = random.Random(seed)
    base = [phrase(1000 * seed + k, 120).split() for k in range(5)]
    hot = phrase(1000 * seed + 99, 57).split()
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        cut = r.randrange(0, 60)
        w = w[cut : cut + r.randrange(50, 120)]
        if r.random() < 0.4:
            at = r.randrange(len(w))
            w = w[:at] + hot + w[at:]
        if r.random() < 0.2:
            w += w[:70]
        rows.append((r.randrange(n), " ".join(w), None))
    return rows


@pytest.mark.parametrize("operator", [phrases.without_repeats, suffixes.without_repeats])
def test_many_ways(spark, operator, monkeypatch):
    """Small shards, cells, pieces and chunks, so that every border is crossed."""
    monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
    monkeypatch.setattr(phrases, "CELL_DOCS", 20)
    monkeypatch.setattr(phrases, "PIECE_WORDS", 60)
    rows = near_copies(1, 200) + near_copies(2, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string").withColumns({"cut": F.lit(1), "z": F.lit(2), "k": F.lit(3), "found": F.lit(4)}).repartition(4)
    assert Counter(tuple(r) for r in passages.digests(operator(docs)).collect()) == plain(rows)


def test_neighbours_in_chunks(monkeypatch):
    """One group of suffixes that is larger than a chunk, and groups that borders cut: chunks of any size find the same windows."""
    import pyarrow as pa

    rows = []
    for d, text, _ in near_copies(3, 60):
        words = text.encode().split()
        h = common.word_hashes(words)
        for at, g in zip(*(x.tolist() for x in suffixes.selected(h)), strict=True):
            rows.append((b" ".join([*words[at : at + 50], b""]), b" ".join([*words[max(0, at - 34) : at][::-1], b""]), d, g >> 1, int(suffixes.contexts(h)[at] >> 1)))
    rows = sorted(rows)
    context = {r[3:]: (r[1].split()[::-1] + r[0].split(), len(r[1].split())) for r in rows}

    def found(chunk, large):
        monkeypatch.setattr(suffixes, "CHUNK", chunk)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
        columns.append(pa.array([large] * len(rows), pa.bool_()))
        whole = pa.RecordBatch.from_arrays(columns, names=["suffix", "left", "doc_id", "g", "c", "large"])
        out = [x for b in suffixes.compare_neighbours(iter([whole.slice(i, 7) for i in range(0, len(rows), 7)])) for x in b.to_pylist()]
        bits = {(x["g"], x["c"], o) for x in out if x["mask"] for o in range(35) if x["mask"] >> o & 1}
        first = {}
        for x in out:
            if x["o"] is not None:
                first[x["w1"], x["w2"]] = min(x["doc_id"], first.get((x["w1"], x["w2"]), x["doc_id"]))
        bits |= {(x["g"], x["c"], x["o"]) for x in out if x["o"] is not None and first[x["w1"], x["w2"]] < x["doc_id"]}
        return {tuple(words[n - o : n - o + 50]) for g, c, o in bits for words, n in [context[g, c]]}

    want = found(1 << 15, True)
    assert want and all(found(c, large) == want for c in (1, 10, 100, 1 << 15) for large in (True, False))


def test_one_doc_id_with_two_texts(spark):
    """Passages of either text of document 1 go from a later document."""
    p, q = phrase(1, 60), phrase(2, 60)
    rows = [(1, f"a {p} b"), (1, f"{phrase(3, 70)} {q}"), (2, f"x {p} {phrase(4, 9)} {q} y"), (3, f"{q} z"), (1, f"{q} {p}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for operator in (phrases.without_repeats, suffixes.without_repeats):
        assert Counter(tuple(r) for r in passages.digests(operator(docs)).collect()) == plain(rows)


def test_automaton_finds_words_only():
    automaton = phrases.compiled({b"b c": (2, 1), b"c": (1, 5)})
    assert sorted(phrases.occurrences(automaton, b"b c bc b c".split(), 3)) == [(0, 2), (3, 2)]
    assert sorted(phrases.occurrences(automaton, b"b c".split(), 9)) == [(0, 2), (1, 1)]
    assert phrases.occurrences(automaton, b"b c".split(), 1) == []
