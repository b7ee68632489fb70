"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut into the longest phrases that the
language's text contains; a text of that language needs few of them. The number of phrases, times the bits that point
into the language's text, by the text's length, estimates the cross-entropy; the least wins.

Walking a suffix automaton from its root needs forward steps only, so the automata are dense tables over bytes and many
stretches of text are stepped at once. Texts are parsed whole, in stretches of ``STRETCH`` bytes; a phrase ends where a
stretch does, in every language alike. A letter that a language never showed ends the phrase that it stands in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

STRETCH = 1024
UNKNOWN = "und"
#: Bytes of the table of automata at most; its entries are 32-bit offsets, which such a table never exceeds.
MODEL_BYTES = 1 << 29


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``data``; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def folded(text: str) -> bytes:
    return text.lower().encode()


@dataclass
class LanguageModel:
    """Automata of all languages in one table. An entry is the offset of the next state, or its complement where a phrase ends."""

    languages: list[str]
    bits: np.ndarray
    roots: np.ndarray
    classes: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, texts: dict[str, str]) -> LanguageModel:
        languages = sorted(texts)
        data = [folded(texts[x]) for x in languages]
        seen = sorted(set(b"".join(data)))
        # Class 0 is for bytes that no language showed, the last class for padding behind a stretch.
        classes = np.zeros(256, np.uint8 if len(seen) < 254 else np.int16)
        classes[seen] = np.arange(1, len(seen) + 1)
        width, tables, roots, base = len(seen) + 2, [], [], 0
        for x in data:
            step = suffix_automaton(x)
            if 4 * (base + len(step) * width) > MODEL_BYTES:
                raise ValueError(f"the automata of {len(languages)} languages take more than {MODEL_BYTES} bytes: learn from less text")
            t = np.full((len(step), width), -1, np.int64)
            for s, to in enumerate(step):
                for c, q in to.items():
                    t[s, classes[c]] = base + q * width
            start = np.where(t[0] >= 0, t[0], base)
            t = np.where(t >= 0, t, ~start)
            t[:, -1] = base + np.arange(len(step)) * width
            roots.append(base)
            base += t.size
            tables.append(t.astype(np.int32).ravel())
        bits = np.array([np.log2(len(x) + 1) for x in data])
        return cls(languages, bits, np.array(roots, np.int32), classes, np.concatenate(tables) if tables else np.empty(0, np.int32))

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """Bits a byte for each language (rows) and text (columns)."""
        owner, stretches = [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), STRETCH):
                owner.append(i)
                stretches.append(t[at : at + STRETCH])
        counts = np.zeros((len(self.languages), len(texts)))
        if not owner:
            return counts
        pad = int(self.classes.max()) + 1
        order = np.argsort([-len(s) for s in stretches], kind="stable")
        owner_of = np.array(owner)
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            longest = len(stretches[part[0]])
            grid = np.full((len(part), longest), pad, self.classes.dtype)
            for row, k in enumerate(part):
                grid[row, : len(stretches[k])] = self.classes[np.frombuffer(stretches[k], np.uint8)]
            state = np.repeat(self.roots[:, None], len(part), axis=1)
            ended = np.zeros(state.shape, np.int32)
            for column in np.ascontiguousarray(grid.T):
                state = self.table[state + column]
                sign = state >> 31
                ended -= sign
                state ^= sign
            ended += state != self.roots[:, None]
            for row in range(len(self.languages)):
                counts[row] += np.bincount(owner_of[part], ended[row], len(texts))
        return counts * self.bits[:, None] / np.maximum(1, [len(t) for t in texts])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and how far it leads, from 0 to 1. Texts without letters, and null, are ``und``."""
        use = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        found = self.entropies([folded(texts[i]) for i in use])
        for i, column in zip(use, found.T, strict=True):
            best = int(column.argmin())  # the first of equals: languages are sorted
            rest = np.delete(column, best)
            second = rest.min() if len(rest) else np.inf
            out[i] = self.languages[best], float(min(1.0, max(0.0, 1 - column[best] / second))) if second > 0 else 0.0
        return out


def held_out(doc_id="doc_id"):
    """Whether a document takes no part in learning; false where doc_id is null, which takes no part either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = 24, usual_chars: int = 1500, sample_chars: int = 100_000) -> LanguageModel:
    """Learn from a bounded sample of documents: of each language ``sample_docs`` labelled ones, those of at most
    ``usual_chars`` characters first, in an order that their doc_id's hash gives, then the shortest of the longer ones, as
    far as they have ``sample_chars`` characters together. Documents count whole; only of a language whose shortest is longer
    than that, its first ``sample_chars`` characters are learned from. Texts to be identified are never cut.

    Documents held out, and those without text, lang or doc_id, are not used; rows that repeat count once, and an empty
    table gives a model that knows no language. So the driver gets ``sample_chars`` characters a language at most, whatever the
    number of rows and their lengths; a model beyond ``MODEL_BYTES`` (very many languages) raises ValueError.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    # First within many cuts of each language, then among what those leave: a language may hold most of the rows.
    order = "chars", F.xxhash64("doc_id"), "doc_id", "key"
    some = usable.select("doc_id", "lang", F.greatest(F.length("text"), F.lit(usual_chars)).alias("chars"), F.length("text").alias("size"), F.xxhash64("text").alias("key")).distinct().withColumn("cut", F.pmod(F.hash("doc_id"), F.lit(64)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "cut").orderBy(*order))).filter(F.col("place") <= sample_docs)
    ordered = Window.partitionBy("lang").orderBy(*order)
    chosen = some.select("doc_id", "lang", "key", F.row_number().over(ordered).alias("place"), F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    chosen = chosen.filter((F.col("place") <= sample_docs) & ((F.col("place") == 1) | (F.col("upto") <= sample_chars))).drop("upto")
    # At most sample_docs rows and sample_chars characters a language.
    rows = usable.select("doc_id", "lang", F.xxhash64("text").alias("key"), "text").join(F.broadcast(chosen), ["doc_id", "lang", "key"]).select("lang", "place", F.substring("text", 1, sample_chars).alias("text")).distinct().collect()
    texts: dict[str, str] = {}
    for lang, _, text in sorted(rows):
        texts[lang] = texts.get(lang, "") + text + "\n"
    return LanguageModel.of(texts)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``lang_pred`` and ``score`` of each row of ``docs`` (doc_id, text); only the text is looked at, other columns are ignored.

    Rows are independent: null doc_ids stay, rows that repeat give rows that repeat, texts of any length are parsed whole, and
    an empty table gives an empty result. Null and empty texts, and those without letters, are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, limit=4 << 20):
            found = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is recognised: those that are not ``und``. Nulls, repeats, very long
    texts and empty tables as in ``identify``; columns may have any names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the columns are called
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, text, 4 << 20):
            found = shared.value.predict(batch.column(text).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN for lang, _ in found], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
