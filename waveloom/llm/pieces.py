"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A sequence of pieces is what merging would give if and only if each piece merges to itself and each two neighbours,
merged again as one string, come back as those two. So the encoder walks a text with longest matches from an
Aho-Corasick automaton, checks each neighbour pair by re-merging (remembered), falls back to the longest shorter prefix
piece, and marks positions from which no valid rest exists in a bitfield so that none is tried twice.

Two letters that stand side by side in no piece are never merged over, so a text is cut there first; what repeats is
looked up. Decoding is the library's.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The mark that stands for a space, and that the library puts before a text.
SPACE = "▁"
#: Characters of the longest text that an encoder remembers; with the number of entries this bounds its memory in bytes.
CACHED_CHARS = 64


class PieceEncoder:
    """Encodes as the sentencepiece library does for merge-type models with byte fallback and identity normalisation."""

    def __init__(self, path: str, limit: int = 400_000):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: sp.get_score(i) for t, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(sp.is_unknown(i) for i in self.byte):
            raise ValueError("the model has no byte fallback")
        self.pairs = {t[k : k + 2] for t in self.id for k in range(len(t) - 1)}
        if any(p[1] == SPACE and p[0] != SPACE for p in self.pairs):
            raise ValueError("the model has pieces that cross a space")
        # Letters that occur only inside longer pieces take part in merges; left over, they are written as bytes.
        for c in sorted({c for t in self.id for c in t} - self.id.keys()):
            self.text[len(self.text) + n] = c
            self.id[c] = len(self.text) + n - 1
        self.usable = {i for t, i in self.id.items() if len(t) == 1 or self.merged(t) == [t]}
        self.length = {i: len(t) for i, t in self.text.items()}
        self.shorter = {}
        self.automaton = ahocorasick.Automaton()
        for i in self.usable:
            t = self.text[i]
            self.shorter[i] = next((j for k in range(len(t) - 1, 0, -1) if (j := self.id.get(t[:k])) in self.usable), -1)
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.size, self.limit = n, limit
        self.fits: dict[tuple[int, int], bool] = {}
        self.atoms: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.code = "H" if n <= 1 << 16 else "I"

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, a: int, b: int) -> bool:
        key = (a, b)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= self.limit:
                self.fits.clear()
            x, y = self.text[a], self.text[b]
            found = self.fits[key] = x[-1] + y[0] not in self.pairs or self.merged(x + y) == [x, y]
        return found

    def encode_atom(self, s: str) -> list[int]:
        """Backtracking over one stretch of letters that could merge."""
        n, length, shorter, fit = len(s), self.length, self.shorter, self._fit
        longest = [-1] * n
        for end, token in self.automaton.iter(s):
            longest[end - length[token] + 1] = token  # ends ascend, so the longest stays
        if longest[0] < 0:
            return [self.byte[b] for b in s.encode()]
        open_at = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        pos, token = 0, longest[0]
        while True:
            while token >= 0:
                end = pos + length[token]
                if open_at[end] and (not tokens or fit(tokens[-1], token)):
                    break
                token = shorter[token]
            if token < 0:
                open_at[pos] = 0
                token = tokens.pop()
                pos -= length[token]
                token = shorter[token]
                continue
            tokens.append(token)
            pos = end
            if pos == n:
                break
            token = longest[pos]
        if max(tokens) < self.size:
            return tokens
        return [j for i in tokens for j in ([i] if i < self.size else [self.byte[b] for b in self.text[i].encode()])]

    def _chunk(self, key: str) -> bytes:
        s = SPACE + key.replace(" ", SPACE)
        pairs, atoms, start, out = self.pairs, self.atoms, 0, []
        for k in range(1, len(s) + 1):
            if k == len(s) or s[k - 1 : k + 1] not in pairs:
                atom = s[start:k]
                found = atoms.get(atom)
                if found is None:
                    found = array(self.code, self.encode_atom(atom)).tobytes()
                    if len(atom) <= CACHED_CHARS:
                        if len(atoms) >= self.limit:
                            atoms.clear()
                        atoms[atom] = found
                out.append(found)
                start = k
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed in native order."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        keys = text.split(" ")
        if "" in keys:  # runs of spaces belong together
            import re

            keys = [c[1:] for c in re.findall(" +[^ ]*", " " + text)]
        chunks, out = self.chunks, []
        for key in keys:
            found = chunks.get(key)
            if found is None:
                found = self._chunk(key)
                if len(key) <= CACHED_CHARS:
                    if len(chunks) >= self.limit:
                        chunks.clear()
                    chunks[key] = found
            out.append(found)
        return b"".join(out)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each model file and Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids and decoded text of each row of ``docs`` (doc_id, text); null texts are empty, other columns are ignored.

    Rows are independent: nothing is shuffled, and rows that repeat give rows that repeat.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in common.text_slices(batches, limit=4 << 20):
            packed = [np.frombuffer(enc.encode(t or ""), f"u{array(enc.code).itemsize}") for t in batch.column("text").to_pylist()]
            decoded = [enc.library.decode(p.tolist()) if len(p) else "" for p in packed]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(packed).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """One row of counts and digests for each row of ``encode_decode``, whose ids and texts are never null."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document through the SentencePiece model and back."""
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path()))
