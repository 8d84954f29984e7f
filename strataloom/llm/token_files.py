"""Token ids in directly addressable codes.

Method: an id is split into chunks of a few bits, lowest first.  Level 0 holds the first
chunk of every id and a bitmap that says which ids go on; level 1 holds the next chunk of
those, and so on.  A rank directory over each bitmap (ones before every 512 bits) leads
from a place in one level to the place in the next, so any id is read without decoding
its neighbours.

Files are segments in a Parquet container, which any store takes: one row a segment with
the ids of consecutive documents in id order, their directory and the encoded image.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._util import RUN_BYTES, lean_batches, materialize, planes, run_count, text_bytes, unplanes

MAGIC = b"DAC1"
_BLOCK = 512
#: Distinct words whose ids a Python worker remembers; then it starts anew.
CACHE_WORDS = 800_000
_SEGMENT = 1 << 20  # ids a segment holds, about


def dac_encode(ids: np.ndarray, bits: int = 8) -> bytes:
    """Image of ids (unsigned 32-bit): magic, chunk bits, levels, count; for each level its length, chunks, bitmap, ranks."""
    ids = np.ascontiguousarray(ids, np.uint32)
    levels = []
    rest = ids
    while True:
        more = (rest >> np.uint32(bits)) > 0
        chunks = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8 if bits <= 8 else np.uint16)
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.cumsum(ones, dtype=np.uint32) - ones
        levels.append(struct.pack("<Q", len(rest)) + chunks.tobytes() + bitmap.tobytes() + ranks.astype("<u4").tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(bits)
    return MAGIC + struct.pack("<BBQ", bits, len(levels), len(ids)) + b"".join(levels)


class Dac:
    """Reader of an image; nothing is decoded until asked for."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.bits, n_levels, self.n = struct.unpack_from("<BBQ", image, 4)
        at, kind = 14, np.uint8 if self.bits <= 8 else np.dtype("<u2")
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", image, at)
            at += 8
            chunks = np.frombuffer(image, kind, n, at)
            at += chunks.nbytes
            bitmap = np.frombuffer(image, np.uint8, -(-n // 8), at)
            at += bitmap.nbytes
            ranks = np.frombuffer(image, "<u4", -(-n // _BLOCK), at)
            at += ranks.nbytes
            self.levels.append((n, chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The id at place i: one chunk and at most one 512-bit rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for _, chunks, bitmap, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            lo = i // _BLOCK * _BLOCK
            bits = int.from_bytes(bitmap[lo >> 3 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - lo)) - 1)
            i = int(ranks[i // _BLOCK]) + bits.bit_count()
            shift += self.bits
        return out

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many ids of a level before each place go on: a rank of the directory, and the bits of at most one block."""
        n, _, bitmap, ranks = self.levels[level]
        out = np.empty(len(at), np.int64)
        for k, i in enumerate(at.tolist()):
            lo = min(i, n - 1) // _BLOCK * _BLOCK if n else 0
            bits = int.from_bytes(bitmap[lo >> 3 : (i + 7) >> 3].tobytes(), "little") & ((1 << (i - lo)) - 1)
            out[k] = (int(ranks[lo // _BLOCK]) if n else 0) + bits.bit_count()
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids from place a up to b: of each level only the part that they use."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        parts, bounds = [], np.array([a, b], np.int64)
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            x, y = bounds.tolist()
            more = np.unpackbits(bitmap[x >> 3 : (y + 7) >> 3], bitorder="little")[x & 7 : (x & 7) + y - x].astype(bool)
            parts.append((chunks[x:y], more))
            if not more.any():
                break
            bounds = self._rank(level, bounds)
        out = None
        for chunks, more in reversed(parts):
            part = chunks.astype(np.uint32)
            if out is not None:
                part[more] |= out << np.uint32(self.bits)
            out = part
        return out if out is not None else np.zeros(0, np.uint32)

    def all(self) -> np.ndarray:
        out = None
        for n, chunks, bitmap, _ in reversed(self.levels):
            part = chunks.astype(np.uint32)
            if out is not None:
                part[np.unpackbits(bitmap, count=n, bitorder="little").astype(bool)] |= out << np.uint32(self.bits)
            out = part
        return out


# Characters for which lower case, composition and white space are the same in
# every library, so that words may be looked up one by one.
_PLAIN = re.compile("[\t\n\r -~¡-įı-ɏ]*")


_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The pre-tokens of the tokenizers' pattern, spelt for lower-cased text of those characters.
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[0-9²³¹¼½¾]|(?:[^\\w\\s]|_)+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


_BYTES = byte_alphabet()


def _types(spec) -> list[str]:
    """Names of the steps of a normalizer or pre-tokenizer, in order."""
    if not spec:
        return []
    inner = spec.get("normalizers") or spec.get("pretokenizers")
    return [t for x in inner for t in _types(x)] if inner else [spec["type"]]


class WordEncoder:
    """Ids of whole texts, each distinct word encoded once.

    Holds for tokenizers that lower-case, then split by the fixed pattern and go on in bytes:
    no match of the pattern crosses white space.  All other tokenizers, and texts with
    special strings or rarer characters, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        spec = json.loads(self.tok.to_str())
        before = spec["pre_tokenizer"] or {}
        steps = before.get("pretokenizers", [])
        byte_level = any(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in steps)
        known = byte_level and any(x.get("pattern", {}).get("Regex") == _PATTERN for x in steps)
        lowers = _types(spec["normalizer"])
        #: whether words may be looked up one by one
        self.splits = known and "Lowercase" in lowers and set(lowers) <= {"NFC", "Replace", "Lowercase"}
        self.special = re.compile("|".join(re.escape(x.content) for x in self.tok.get_added_tokens_decoder().values()) or "(?!)")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, pre: str) -> bytes:
        """Ids of one pre-token: the library's model alone, without its text handling."""
        chars = pre if pre.isascii() else "".join(map(_BYTES.__getitem__, pre.encode()))
        ids = [x.id for x in self.tok.model.tokenize(chars)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list = [None] * len(texts)
        split, whole = {}, []
        for i, t in enumerate(texts):
            if self.splits and _PLAIN.fullmatch(t) and not self.special.search(t):
                split[i] = t.lower().split()
            else:
                whole.append(i)
        for i in whole:
            (out[i],) = self._library([texts[i]])
        every = set().union(*split.values()) if split else set()
        new = [w for w in every if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(every)
        # A word with punctuation is put together from its pre-tokens, so the model sees each of those once.
        for w in new:
            parts = _PRE.findall(w)
            for x in parts:
                if x not in self.known:
                    self.known[x] = self._piece(x)
            if len(parts) != 1 or parts[0] != w:
                self.known[w] = b"".join(map(self.known.__getitem__, parts))
        for i, words in split.items():
            out[i] = b"".join(map(self.known.__getitem__, words))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The Python worker's encoder of this file; its cache lasts over tasks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_FILE = "part int, segment int, before long, n_tokens long, doc_ids binary, ends binary, image binary"


def encode_files(docs: DataFrame, path: str, end_id: int, bits: int = 8, run_bytes: int = 2 * RUN_BYTES) -> DataFrame:
    """Segments (part, segment, before, n_tokens, doc_ids, ends, image) of docs in ascending id order; before: the tokens of the part's earlier ones.

    doc_id must not be null.  Null text is empty; every document gets end_id.  Rows that
    share an id stand together, by text; parts are ranges of id and of the first bytes of the
    text (short, as Spark samples them on the driver), so many texts of one id are dealt to
    several parts, but for those that begin alike.
    """
    base = text_bytes(docs.select("doc_id", "text"))
    n = run_count(base, "text", run_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = word_encoder(path), struct.pack("<I", end_id)
        part, segment, before, ids, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in held], dtype=np.int64)
            image = dac_encode(np.frombuffer(b"".join(held), "<u4"), bits)
            row = (part, segment, before, int(ends[-1]), planes(np.array(ids, np.int64)), planes(ends), image)
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3))], names=[x.split()[0] for x in _FILE.split(", ")])

        def flush(docs_now: list, texts: list):
            nonlocal size
            for d, x in zip(docs_now, enc.encode(texts)):
                ids.append(d)
                held.append(x + end)
                size += len(x) // 4 + 1

        for batch in batches:
            texts, now, big = [], [], 0
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.append(x.as_py().decode("utf-8", "replace"))
                now.append(d)
                big += len(texts[-1])
                if big >= 1 << 20:
                    flush(now, texts)
                    texts, now, big = [], [], 0
                    if size >= _SEGMENT:
                        yield close()
                        segment, before, ids, held, size = segment + 1, before + size, [], [], 0
            flush(now, texts)
        if held:
            yield close()

    return base.repartitionByRange(n, "doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text").mapInArrow(lean_batches(encode), _FILE)


def read_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit).

    Each document's ids are fetched by place through the directories; no segment is decoded, and nothing is shuffled.
    """
    # One number for each part of the files; a part is a partition of the writer, however many documents it has.
    total, at = {}, 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        total[part] = at
        at += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for part, before, docs, ends, image in zip(*(t[c] for c in ("part", "before", "doc_ids", "ends", "image"))):
                code, e = Dac(image.as_py()), unplanes(ends.as_py(), np.int64)
                s = np.r_[0, e[:-1]]
                yield pa.record_batch({
                    "doc_id": pa.array(unplanes(docs.as_py(), np.int64)), "start": pa.array(s + total[part.as_py()] + before.as_py()), "n_tokens": pa.array(e - s),
                    "ids": pa.array([code.slice(x, y).astype("<u4").tobytes() for x, y in zip(s.tolist(), e.tolist())], pa.binary()),
                })

    return files.mapInArrow(lean_batches(read), "doc_id long, start long, n_tokens long, ids binary")


def read_documents(files: DataFrame, doc_ids: list[int]) -> DataFrame:
    """The same for some documents (a bounded list): only their ids are fetched from the segments that hold them."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for docs, ends, image in zip(t["doc_ids"], t["ends"], t["image"]):
                own, e = unplanes(docs.as_py(), np.int64), unplanes(ends.as_py(), np.int64)
                hit = np.flatnonzero(np.isin(own, wanted))
                if len(hit):
                    code, s = Dac(image.as_py()), np.r_[0, e[:-1]]
                    yield pa.record_batch({"doc_id": pa.array(own[hit]), "ids": pa.array([code.slice(int(s[i]), int(e[i])).astype("<u4").tobytes() for i in hit], pa.binary())})

    return files.mapInArrow(lean_batches(read), "doc_id long, ids binary")


def token_digest(docs: DataFrame, path: str, end_id: int = 2, bits: int = 8) -> DataFrame:
    """Write the ids of docs, read the files back: doc_id, start, n_tokens, ids_crc32.

    Rows with a null id come before all others and return a null id.  An empty table writes
    no segment and returns no row.  Repeated rows are written each; texts of any length are
    whole; extra columns are ignored.
    """
    null = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null)).alias("doc_id"), "text")
    out = read_files(materialize(encode_files(ids, path, end_id, bits), "tokens"))
    return out.select(F.expr(f"nullif(doc_id, {null + 1} - 1L)").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
