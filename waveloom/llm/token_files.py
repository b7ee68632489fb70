"""Token-ID / binary output: length-delimited binary records with masked checksums and a separate offset index.

A file is a run of frames. A frame is ``u64 length | u32 masked crc of the length | payload | u32 masked crc of the
payload``, little-endian; a payload is ``i64 doc_id | u8 has_id | u8 width | u32 count`` and then ``count`` ids of
``width`` bytes each (2 where the vocabulary allows it, else 4). The checksum is CRC-32 as zlib computes it, rotated by
15 bits and offset, so that a checksum stored among data that are themselves checksummed stays sound. The index is a
Parquet table of (part, file, offset, length, start_in_part, n_tokens): shuffled reads need it and nothing else.

Writers name files by attempt and only the index, which Spark commits atomically, names the files that count: a lost
executor leaves at most an unreferenced file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FRAME_HEAD = "<QI"
FRAME_TAIL = "<I"
PAYLOAD_HEAD = "<qBBI"
#: Added to a rotated checksum; a fixed value of the masking rule.
MASK_DELTA = 0xA282EAD8
INDEX_SCHEMA = "part int, file string, offset long, length long, start_in_part long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(FRAME_TAIL, masked(length)) + payload + struct.pack(FRAME_TAIL, masked(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame; raises if a length or checksum disagrees."""
    length, crc = struct.unpack_from(FRAME_HEAD, data)
    if crc != masked(data[:8]) or length != len(data) - 16:
        raise ValueError("a record's length is damaged")
    payload = data[12:-4]
    if struct.unpack(FRAME_TAIL, data[-4:])[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


#: Characters of the longest text that an encoder remembers.
CACHED_CHARS = 64


class WordCachedEncoder:
    """Encodes whole texts with the tokenizers library, asking it once for each distinct piece of text.

    A byte-level pre-tokenizer always starts anew at a space between two visible characters, where a Latin letter is
    followed by punctuation, and on either side of a line end between visible characters. So what lies between such
    places encodes on its own. Other text is not cut. Both caches are emptied at ``limit`` entries and take no text of
    more than ``CACHED_CHARS`` characters, which bounds a worker's memory in bytes.

    A text that holds an added token, such as <|endoftext|>, goes to the library whole: the library takes such tokens out
    of the text before it pre-tokenizes, with what white space around them they may claim.
    """

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True
        #: Added tokens as the library finds them in a text; those that it normalizes first may be spelt in other ways.
        added = self.tokenizer.get_added_tokens_decoder().values()
        assert self.tokenizer.normalizer is None or not any(t.normalized for t in added)
        self.added = "|".join(re.escape(t.content) for t in added)
        self.limit = limit
        #: Packed ids by the text between two spaces, with a space before it; None where the spaces are no place to cut.
        self.stretches: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}
        self.spaces = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")
        self.open_end = re.compile(r"\A(?![!-~\w])|[^!-~\w]\Z")
        self.inside = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[^\w\s'])|(?<=[!-~À-ɏ])(?=\n[!-~À-ɏ])|(?<=[!-~À-ɏ]\n)(?=[!-~À-ɏ])")

    def _packed(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that encode on their own."""
        cut = [self.inside.split(t) for t in texts]
        new = list(set().union(*cut) - self.pieces.keys())
        if len(self.pieces) + len(new) > self.limit // 2:
            self.pieces = {}
            new = list(set().union(*cut))
        # A space and letters always make a first token with that space and others without: such pieces go in one string.
        words = [p for p in new if p[:1] == " " and p[1:].isalpha()]
        rows = [words[i : i + 100] for i in range(0, len(words), 100)]
        alone = [p for p in new if not (p[:1] == " " and p[1:].isalpha())]
        for row, found in zip(rows, self.tokenizer.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.code)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(row):
                alone += row
                continue
            data, ends = ids.tobytes(), (starts * ids.itemsize).tolist()
            for piece, a, b in zip(row, ends, [*ends[1:], len(data)], strict=True):
                self.pieces[piece] = data[a:b]
        for piece, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.pieces[piece] = array(self.code, found.ids).tobytes()
        get = self.pieces.__getitem__
        out = [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cut]
        for piece in new:
            if len(piece) > CACHED_CHARS:
                del self.pieces[piece]
        return out

    def _learn(self, here: list[str]) -> list[bytes | None]:
        """What is known of each of these distinct stretches, after asking for those that are new."""
        known = self.stretches
        new = [p for p in here if p not in known]
        if len(known) + len(new) > self.limit:  # what these texts use is likely to come again
            known = self.stretches = {k: known[k] for k in here if k in known}
        if new:
            shut = [p for p in new if not self.open_end.search(p)]
            known.update(dict.fromkeys(new))
            known.update(zip(shut, self._packed([" " + p for p in shut]), strict=True))
        out = list(map(known.__getitem__, here))
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, packed in native little-endian order."""
        if not self.added or not len(texts):
            return self._encode_plain(texts)
        holds = np.asarray(pc.match_substring_regex(texts, self.added))
        if not holds.any():
            return self._encode_plain(texts)
        whole = self.tokenizer.encode_batch_fast(texts.filter(pa.array(holds)).to_pylist(), add_special_tokens=False)
        whole, rest = iter(whole), iter(self._encode_plain(texts.filter(pa.array(~holds))))
        return [array(self.code, next(whole).ids).tobytes() if held else next(rest) for held in holds.tolist()]

    def _encode_plain(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts without added tokens.

        The stretches of all texts are told apart and put together again by Arrow; Python sees each distinct one once."""
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        codes, distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()
        offsets = offsets - offsets[0]
        found = self._learn(distinct)
        is_open = np.array([f is None for f in found])[codes]
        unusual = np.logical_or.reduceat(is_open, offsets[:-1])
        # The first stretch of a text has no space before it, so it is looked up as it stands.
        heads = self._packed([distinct[c] if not odd else "" for c, odd in zip(codes[offsets[:-1]].tolist(), unusual.tolist(), strict=True)])
        codes = codes.astype(np.int64)
        codes[offsets[:-1]] = len(distinct) + np.arange(len(texts))
        joined = pa.array([f or b"" for f in found] + heads, pa.binary()).take(pa.array(codes))
        ends = np.asarray(pa.Array.from_buffers(pa.int32(), len(joined) + 1, [None, joined.buffers()[1]], offset=joined.offset))[offsets]
        data = joined.buffers()[2]
        data = data.to_pybytes() if data is not None else b""
        out = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        odd = np.flatnonzero(unusual).tolist()
        cuts = [self.spaces.split(texts[i].as_py()) for i in odd]
        rest = iter(self._packed([c for cut in cuts for c in cut]))
        for i, cut in zip(odd, cuts, strict=True):
            out[i] = b"".join(next(rest) for _ in cut)
        return out


_encoders: dict[str, WordCachedEncoder] = {}


def encoder(path: str) -> WordCachedEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordCachedEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, roll_bytes: int = 256 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into record files in ``folder``; returns the offset index.

    The parts of the index are in doc_id order, and so are the records of a part. Null texts are empty, rows that share
    a doc_id are ordered by their text's hash, rows without doc_id come first. Other columns are ignored.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.opened(folder)
        part, sink, name, at, total = TaskContext.get().partitionId(), None, "", 0, 0
        enc = encoder(tokenizer_path)
        width = 2 if enc.code == "H" else 4
        end = array(enc.code, [end_id]).tobytes()
        for batch in common.text_slices(batches):
            ids, rows = batch.column("doc_id").to_pylist(), []
            texts = pc.fill_null(batch.column("text"), "")
            frames = []
            for doc_id, packed in zip(ids, enc.encode(texts), strict=True):
                packed += end
                n = len(packed) // width
                data = frame(struct.pack(PAYLOAD_HEAD, doc_id or 0, doc_id is not None, width, n) + packed)
                if sink is None or at >= roll_bytes:
                    if sink is not None:
                        sink.write(b"".join(frames))
                        frames.clear()
                        sink.close()
                    fs.create_dir(root, recursive=True)
                    name, at = f"tokens-{part:06d}-{uuid.uuid4().hex}.rec", 0
                    sink = fs.open_output_stream(f"{root}/{name}")
                frames.append(data)
                rows.append((part, name, at, len(data), total, n))
                at += len(data)
                total += n
            sink.write(b"".join(frames))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "offset", "length", "start_in_part", "n_tokens"])
        if sink is not None:
            sink.close()

    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return common.staged(ordered.select("doc_id", "text").mapInArrow(write, INDEX_SCHEMA), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``, the count of all ids before a record: a running sum over the parts, one row each, then the place in the part."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # One row for each written part: a few bytes a task, whatever the tasks wrote.
    return index.join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def read_token_files(index: DataFrame, folder: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Read the records that ``index`` (with ``start``) lists; neighbours are fetched by one read of ``chunk_bytes`` or so.

    Every length and checksum is verified. Returns doc_id, start, n_tokens and the CRC-32 of the ids as 32-bit integers;
    a record as often as it is listed, null doc_ids as null, nothing for an empty index. Other columns are ignored. Files
    are dealt to tasks by their bytes, not by the few bytes that the index has of them.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.opened(folder)
        for batch in batches:
            files, offsets, lengths, starts = (batch.column(c).to_pylist() for c in ("file", "offset", "length", "start"))
            rows, i = [], 0
            while i < len(files):
                j = i + 1
                while j < len(files) and files[j] == files[i] and offsets[j] == offsets[j - 1] + lengths[j - 1] and offsets[j] + lengths[j] - offsets[i] <= chunk_bytes:
                    j += 1
                with fs.open_input_file(f"{root}/{files[i]}") as source:
                    data = source.read_at(offsets[j - 1] + lengths[j - 1] - offsets[i], offsets[i])
                for k in range(i, j):
                    at = offsets[k] - offsets[i]
                    payload = unframe(data[at : at + lengths[k]])
                    doc_id, has_id, width, n = struct.unpack_from(PAYLOAD_HEAD, payload)
                    ids = np.frombuffer(payload, f"<u{width}", n, struct.calcsize(PAYLOAD_HEAD))
                    rows.append((doc_id if has_id else None, starts[k], n, zlib.crc32(ids.astype("<u4").tobytes())))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = common.tasks_for(index.sparkSession, index.agg(F.sum("length")).first()[0] or 0, 4 * chunk_bytes)
    placed = index.select("file", "offset", "length", "start", F.expr(f"offset div {chunk_bytes}").alias("chunk")).repartition(tasks, "file", "chunk").sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document through the byte-level tokenizer into record files, and back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.new_folder(spark, "token-files")
    index = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(with_starts(index), folder)
