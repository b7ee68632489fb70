import pytest

#: Rows of every awkward kind: nulls in any column, empty and white-space texts, ties, repeated rows, clashing extra columns.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, start int, n int, h long, fp long, attached string, `a.b` string"


def doc(i, text, lang="en", source="s", extra=1):
    return (i, text, lang, source, None if text is None else len(text), extra, extra, extra, extra, extra, "x", None)


def phrase(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    p, q = phrase(1, 60), phrase(2, 55)
    long = phrase(3, 30_000)
    return [
        doc(1, f"start {p} end"), doc(2, f"{phrase(4, 20)}\n{p}\t{phrase(5, 10)}"), doc(3, f"{phrase(6, 9)} {p}"), doc(4, p), doc(5, p),
        doc(6, None), doc(7, ""), doc(8, " \n\t "), doc(9, "one"), doc(10, "one"), doc(11, "One two"), doc(12, long), doc(13, f"{long} {q}"), doc(14, q), doc(14, q), doc(14, f"{q} {p}"),
        doc(None, p), doc(None, None), doc(15, f"{phrase(7, 49)}"), doc(16, f"{phrase(7, 49)}"), doc(17, f"{phrase(7, 49)} more", None), doc(18, "ab " * 200, "de", None), doc(19, "ab " * 180, None), doc(20, "12 34 !!"),
        doc(21, " ".join(p.split()[5:] + q.split())), doc(22, f"x {' '.join(q.split()[:50])} y"), doc(23, f"x {' '.join(q.split()[:49])} y"), doc(24, "é ü ñ 日本 😀\x00 <s> ▁▁ \x1c a\xa0b  c"),
    ]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
