"""Language, pieces, token files, LM scores and decontamination."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tests.llm.conftest import phrase
from waveloom.llm import common, decontaminate, language, lm, pieces, token_files


def test_cross_parsing():
    def phrases(x, ref):
        n = i = 0
        while i < len(x):
            j = i + 1
            while j < len(x) and x[i : j + 1] in ref:
                j += 1
            n, i = n + 1, j + (j < len(x) and x[j : j + 1] not in ref) if x[i : i + 1] in ref else i + 1
        return n

    model = language.LanguageModel.of({"a": "abracadabra", "b": "bcdbcdbcd"})
    for x in (b"abrbcd", b"bcdbcdz", b"zz", b"a", b"dabrazabra"):
        want = [phrases(x, ref) * math.log2(len(ref) + 1) / len(x) for ref in (b"abracadabra", b"bcdbcdbcd")]
        assert model.entropies([x])[:, 0] == pytest.approx(want)


def test_language(docs, no_docs, rows):
    model = language.fit(docs)
    out = language.identify(docs, model).collect()
    assert len(out) == len(rows)
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und"}
    assert {6, 7, 8, 20} <= und and all(0 <= r["score"] <= 1 for r in out)
    assert language.keep_identified(docs, model).columns == docs.columns
    assert language.identify(docs, language.fit(no_docs)).filter("lang_pred != 'und'").count() == 0
    assert language.identify(no_docs, model).count() == 0


def test_letters():
    model = language.LanguageModel.of({"a": "abc", "b": "xyz"})
    texts = ["²", "½ ²", "Ⅷ", "12_3 ٣", "", None, "²a", "ª", "日本", "1 é"]
    assert [x[0] == "und" for x in model.predict(texts)] == [not (t and any(c.isalpha() for c in t)) for t in texts]


def test_sample_is_whole_and_bounded(spark, docs):
    rows = [(i, f"{phrase(i, 30)} end{i}", "xx") for i in range(300)] + [(1000 + i, phrase(i, 900), "yy") for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    language.LanguageModel.of, old = lambda texts: seen.update(texts), language.LanguageModel.of
    try:
        language.fit(table.union(table.limit(9)), sample_docs=6, usual_chars=400)
    finally:
        language.LanguageModel.of = old
    by_text = {t: (i, lang) for i, t, lang in rows}
    for lang in ("xx", "yy"):
        parts = seen[lang].strip("\n").split("\n")
        assert {by_text[p][1] for p in parts} == {lang} and all(zlib.crc32(str(by_text[p][0]).encode()) % 3 != 1 for p in parts)
        assert len(parts) == 6 or lang == "yy" and len(parts) == sum(zlib.crc32(str(1000 + i).encode()) % 3 != 1 for i in range(5))


def test_long_texts_are_parsed_in_stretches():
    """Phrases end where a stretch does: a long text's entropy is that of its stretches, by their phrases."""
    model = language.LanguageModel.of({"a": "abracadabra", "b": "bcdbcdbcd"})
    text = (b"abrbcdzabracad" * 300)[: 3 * language.STRETCH + 17]
    parts = [text[i : i + language.STRETCH] for i in range(0, len(text), language.STRETCH)]
    want = sum(model.entropies([p])[:, 0] * len(p) for p in parts) / len(text)
    assert model.entropies([text])[:, 0] == pytest.approx(want)


def test_language_on_held_out(spark, sf_dir):
    out = language.op8_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_pieces(docs, no_docs, rows):
    sp = pieces.encoder(pieces.model_path()).library
    want = Counter()
    for r in rows:
        ids = sp.encode(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in pieces.digests(pieces.encode_decode(docs, pieces.model_path())).collect()) == want
    assert pieces.encode_decode(no_docs, pieces.model_path()).count() == 0


def test_pieces_fuzz():
    import random

    enc = pieces.encoder(pieces.model_path())
    r = random.Random(3)
    parts = ["a", "th", "e", " ", "  ", "\n", "é", "▁", ".", "日", "😀", "ing", "12", "<s>", "\x00", "--", "tion", "ABC", "\t"]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(enc.encode(s), "u2").tolist() == enc.library.encode(s), s


def test_token_files(spark, docs, no_docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    folder = common.new_folder(spark, "t")
    index = token_files.write_token_files(docs, path, folder, roll_bytes=2000)
    assert index.select("file").distinct().count() > 1
    out = token_files.read_token_files(token_files.with_starts(index), folder, chunk_bytes=500).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    some = token_files.with_starts(index).filter("offset > 0")
    assert token_files.read_token_files(some, folder).count() == some.count()
    assert token_files.with_starts(token_files.write_token_files(no_docs, path, folder)).count() == 0


def test_token_files_with_added_tokens(spark):
    """<|endoftext|> in a text is one id, as the library has it by default; later documents start after it."""
    from tokenizers import Tokenizer

    path, mark = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    t = Tokenizer.from_file(path)
    texts = [f"{mark}a b", f"a{mark}b", f"a b{mark}", f"one {mark} two\n{mark}{mark}  x {mark}\n", mark, "<|endoftext |>", "plain text after", None, f"é日{mark}😀"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = common.new_folder(spark, "t")
    out = token_files.read_token_files(token_files.with_starts(token_files.write_token_files(docs, path, folder)), folder).orderBy("doc_id").collect()
    at = 0
    for text, r in zip(texts, out, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        at += len(ids)


def test_damage_is_found():
    data = token_files.frame(b"payload")
    assert token_files.unframe(data) == b"payload"
    for k in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            token_files.unframe(bytes(broken))


def plain_scores(texts, good, strength=50):
    """Scores by plain counting; texts are lists of words."""
    size = len({w for ws in texts for w in ws}) + 1

    def model(which):
        pairs = Counter(p for k in which for p in zip(["<s>", *texts[k]], texts[k]))
        single, seen = Counter(), Counter()
        for (a, b), n in pairs.items():
            single[b] += n
            seen[a] += n
        total = single.total()
        return lambda a, b: -math.log((pairs[a, b] + strength * (single[b] + 1) / (total + size)) / (seen[a] + strength))

    target, background = model(good), model(range(len(texts)))
    return [sum(target(*p) - background(*p) for p in zip(["<s>", *ws], ws)) / len(ws) if ws else None for ws in texts]


def test_lm(spark, docs, no_docs, rows, monkeypatch):
    """Awkward rows, among them texts of 30,000 words, in blocks of many sizes."""
    monkeypatch.setattr(lm, "BUCKET_BYTES", 30_000)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2_000)
    target = spark.createDataFrame([(1,), (2,), (2,), (None,), (999,)], "doc_id long")
    out = lm.cross_entropy_difference(docs, target).collect()
    texts = [(r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split() for r in rows]
    scores = plain_scores(texts, [k for k, r in enumerate(rows) if r[0] in (1, 2)])
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    want = sorted(((r[0], len(t), s) for r, t, s in zip(rows, texts, scores)), key=order)
    got = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in out), key=order)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == [None if x[2] is None else pytest.approx(x[2], abs=1e-9) for x in want]
    assert lm.cross_entropy_difference(no_docs, target).count() == 0
    assert lm.cross_entropy_difference(docs, target.limit(0)).count() == len(rows)


def test_lm_knows_rare_words(spark, monkeypatch):
    """Documents that differ only in words beyond the 2000 most frequent ones; the models of plain counting."""
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1000)
    common_words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(common_words * 3), *(f"w0 w1 rare{k % 2} w2 Rare{k % 2} w3" for k in range(6))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, spark.createDataFrame([(1,), (3,)], "doc_id long")).collect()}
    words = [t.lower().split() for t in texts]
    for d, want in enumerate(plain_scores(words, [1, 3])):
        assert out[d]["score"] == pytest.approx(want, abs=1e-9) and out[d]["n_tokens"] == len(words[d])
    assert abs(out[1]["score"] - out[2]["score"]) > 0.01


def test_decontamination(spark, docs, no_docs):
    item = phrase(50, 24)
    w = item.split()
    texts = {100: f"{phrase(51, 4000)} {item.upper()} {phrase(52, 4000)}", 101: " ".join(w[:19] + ["zz"] + w[19:]), 102: " ".join(w[:15]), 103: item, 104: " ".join(w[:20]), 105: phrase(53, 40)}
    more = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    texts |= {106: "QUITE  short", 107: f"{phrase(55, 9)} is quite short\tand {phrase(56, 700)}", 108: "quite shorter than a quite, short one", 109: "quite"}
    more = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "quite Short"), (3, None), (None, item), (4, item), (5, phrase(54, 400)), (6, " \n"), (7, "a quite, short one")], "item_id long, text string")

    def shingles(t):
        x = (t or "").lower().split()
        return {" ".join(x[i : i + 5]) for i in range(len(x) - 4)}

    want = {(d, i) for d, t in texts.items() for i in (1, 4) if len(shingles(t) & shingles(item)) >= 0.8 * len(shingles(item))} | {(106, 2), (107, 2), (108, 7)}
    everything = docs.unionByName(more, allowMissingColumns=True)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(everything, items).collect()}
    assert got == want and {100, 101, 103} <= {d for d, _ in want} and 102 not in {d for d, _ in want}
    old, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, 0
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(everything, items).collect()} == want
    finally:
        decontaminate.BROADCAST_ROWS = old
    kept = decontaminate.drop_contaminated(everything, items)
    assert kept.count() == everything.count() - len({d for d, _ in want}) and kept.columns == everything.columns
    assert decontaminate.contained(no_docs, items).count() == 0 and decontaminate.contained(docs, items.limit(0)).count() == 0


def learned(monkeypatch, docs, **sizes):
    """What ``fit`` learns from, and the model."""
    seen, of = {}, language.LanguageModel.of
    monkeypatch.setattr(language.LanguageModel, "of", lambda texts: (seen.update(texts), of(texts))[1])
    return language.fit(docs, **sizes), seen


def test_language_sample_is_bounded_in_characters(spark, monkeypatch):
    rows = [(3 * i, "abc " * (10 + i), "en") for i in range(60)] + [(i, "xyz " * 9000, "de") for i in range(60)] + [(200 + i, "pq " * 40, "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, seen = learned(monkeypatch, docs, sample_docs=20, usual_chars=300, sample_chars=1000)
    assert 700 <= len(seen["en"]) <= 1000 + 20 and len(seen["de"]) == 1001 and 880 <= len(seen["fr"]) <= 1000 + 20
    monkeypatch.setattr(language, "MODEL_BYTES", 1 << 12)
    with pytest.raises(ValueError):
        language.LanguageModel.of({"a": "abcdefgh" * 99})


def test_language_against_substring_search(spark, sf_dir, monkeypatch):
    """Choice and score of whole documents, many of them longer than a stretch, by looking phrases up in the learned text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, texts = learned(monkeypatch, docs, sample_docs=5)
    data = {x: language.folded(t) for x, t in texts.items()}
    rows = [r for r in docs.filter("doc_id % 5 = 0").select("doc_id", "text").collect() if r.text and any(c.isalpha() for c in r.text) and len(r.text) < 6000]
    assert sum(len(r.text) > 1100 for r in rows) > 5

    def phrases(text, known):
        n = 0
        for lo in range(0, len(text), language.STRETCH):
            part, at = text[lo : lo + language.STRETCH], 0
            while at < len(part):
                size = 0
                while at + size < len(part) and part[at : at + size + 1] in known:
                    size += 1
                # A letter that the language never showed ends the phrase that it stands in.
                size += at + size < len(part) and part[at + size : at + size + 1] not in known
                n, at = n + 1, at + size
        return n

    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    for r in rows:
        text = language.folded(r.text)
        bits = {x: phrases(text, known) * np.log2(len(known) + 1) / len(text) for x, known in data.items()}
        first, second = sorted((b, x) for x, b in bits.items())[:2]
        assert got[r.doc_id][0] == first[1] and got[r.doc_id][1] == pytest.approx(min(1, max(0, 1 - first[0] / second[0])))
