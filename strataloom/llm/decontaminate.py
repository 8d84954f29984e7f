"""Benchmark decontamination on a distributed positional inverted index.

Method: all training tokens are stored as postings, one index shard for each block of
documents (the index is partitioned by document, as search engines do, so hot words
spread over all shards).  A search joins the terms asked for to the index, so only their
postings move.  A phrase is found by intersecting the offset-adjusted postings of its
words, from the rarest on; the phrases of a shard are intersected together, and a phrase
with a word that the shard lacks costs nothing.  Proximity search uses the same postings.

Words: A-Z lowered, runs of ASCII letters, digits and non-ASCII characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._util import RUN_BYTES, lean, lean_batches, materialize, planes, text_bytes, unplanes, words_of

WINDOW = 10
#: Words of queries searched for at once; larger query sets are searched in blocks of this size.
BLOCK_WORDS = 1_000_000
#: Candidate places intersected at once in a shard.
AT_ONCE = 1 << 21

_INDEX = "shard long, term binary, n long, postings binary"


def _index_shard(shard: int, docs: list[tuple]) -> pa.RecordBatch:
    """Rows of one shard: postings of each term, and one row without a term that lists the documents (id, mark, text).

    Positions count through the shard with a gap between documents, so no phrase runs across two.
    """
    own: dict[bytes, int] = {}
    codes, starts, at = [], [], 0
    for _, _, text in docs:
        words = words_of(text)
        starts.append(at)
        at += len(words) + 1
        codes += [own.setdefault(w, len(own)) for w in words]
        codes.append(-1)
    code = np.array(codes, np.int64)
    pos = np.flatnonzero(code >= 0)
    # by term, then by position
    both = np.sort(code[pos] << 32 | pos)
    pos, count = both & 0xFFFFFFFF, np.bincount(both >> 32, minlength=len(own))
    first = np.r_[0, np.cumsum(count)]
    delta = np.diff(pos, prepend=0)
    delta[first[:-1]] = pos[first[:-1]]
    ends = pa.py_buffer((4 * first).astype(np.int32).tobytes())
    postings = pa.Array.from_buffers(pa.binary(), len(own), [None, ends, pa.py_buffer(delta.astype("<u4").tobytes())])
    listing = b"".join(planes(np.array(x, np.int64)) for x in ([d for d, _, _ in docs], [m for _, m, _ in docs], [*starts, at]))
    terms = pa.concat_arrays([pa.array([None], pa.binary()), pa.array(list(own), pa.binary())])
    n = 1 + len(own)
    return pa.record_batch({"shard": pa.array(np.full(n, shard)), "term": terms, "n": pa.array(np.r_[len(docs), count]), "postings": pa.concat_arrays([pa.array([listing], pa.binary()), postings])})


def build_index(docs: DataFrame, shard_bytes: int = RUN_BYTES) -> DataFrame:
    """Positional index of docs (doc_id, text[, mark]), written as a table (shard, term, n, postings).

    A shard's row without a term lists its documents, a number of the caller's for each (mark)
    and where each begins.  Null text and documents without words are listed too; doc_id must
    not be null.  Postings are deltas of positions in the shard, little-endian unsigned 32-bit.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                if held and size + len(text) > shard_bytes:
                    yield _index_shard(shard, held)
                    shard, held, size = shard + 1, [], 0
                held.append((doc, mark, text))
                size += len(text)
        if held:
            yield _index_shard(shard, held)

    mark = F.col("mark") if "mark" in docs.columns else F.lit(0).cast("long").alias("mark")
    rows = text_bytes(docs.select("doc_id", mark, "text")).filter("doc_id is not null").mapInArrow(lean_batches(build), _INDEX)
    return materialize(rows, "index")  # numbers of shards are those of the tasks that wrote them


def postings_of(index: DataFrame, terms: list[bytes]) -> DataFrame:
    """The index rows of some terms (a bounded list), and the listings of all shards."""
    asked = index.sparkSession.createDataFrame([(bytearray(w),) for w in terms], "term binary")
    return index.join(F.broadcast(asked), "term", "left_semi").unionByName(index.filter("term is null"))


class Shard:
    """One shard's postings in memory, of the terms asked for."""

    def __init__(self, t: pa.Table, codes: dict[bytes, int]):
        terms, ns, blobs = t["term"].to_pylist(), t["n"].to_pylist(), t["postings"].to_pylist()
        self.count = np.zeros(len(codes), np.int64)
        lists: dict[int, np.ndarray] = {}
        for term, n, blob in zip(terms, ns, blobs):
            if term is None:
                self.docs, self.marks, self.starts = (unplanes(blob[8 * n * k : 8 * n * (k + 1) + (8 if k == 2 else 0)], np.int64) for k in range(3))
            elif term in codes:
                lists[codes[term]] = np.cumsum(np.frombuffer(blob, "<u4"), dtype=np.int64)
                self.count[codes[term]] = n
        self.span = int(self.starts[-1]) + WINDOW + 1
        order = sorted(lists)
        self.first = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(self.count, out=self.first[1:])
        self.flat = np.concatenate([lists[c] for c in order]) if order else np.zeros(0, np.int64)
        # one sorted array for all terms: the term's code, then the position
        self.keys = self.flat + np.repeat(np.arange(len(codes)), self.count) * self.span if order else self.flat

    def phrases(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of the phrases in the rows of p (term codes): (row, first position)."""
        n = self.count[p]
        alive = np.flatnonzero(n.min(axis=1) > 0) if len(p) else np.zeros(0, np.int64)
        rank = np.argsort(n[alive], axis=1, kind="stable")
        places = np.cumsum(self.count[p[alive, rank[:, 0]]]) if len(alive) else np.zeros(0, np.int64)
        rows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(alive):  # so many phrases that their rarest terms have about AT_ONCE places
            end = max(at + 1, int(np.searchsorted(places, (places[at - 1] if at else 0) + AT_ONCE, side="right")))
            row, start = self._meet(p[alive[at:end]], rank[at:end])
            rows.append(alive[at:end][row])
            starts.append(start)
            at = end
        return np.concatenate(rows), np.concatenate(starts)

    def _meet(self, p: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of phrases whose terms all occur: the rarest term's places, met with those of the others in turn."""
        code = p[np.arange(len(p)), rank[:, 0]]
        times = self.count[code]
        row = np.repeat(np.arange(len(p)), times)
        within = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        start = self.flat[self.first[code][row] + within] - rank[row, 0]
        ok = start >= 0
        row, start = row[ok], start[ok]
        for x in range(1, p.shape[1]):
            if not len(row):
                break
            o = rank[row, x]
            key = p[row, o] * self.span + start + o
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == key
            row, start = row[ok], start[ok]
        return row, start

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, pos, side="right") - 1


def _windows(items: list[tuple[str, list[bytes]]], window: int):
    """Distinct windows of the items, by length: {length: (codes, for each window its items)}, and the codes of the terms."""
    codes: dict[bytes, int] = {}
    by: dict[int, dict[tuple, set]] = {}
    for name, words in items:
        c = [codes.setdefault(w, len(codes)) for w in words]
        for i in range(max(1, len(c) - window + 1) if c else 0):
            w = tuple(c[i : i + window])
            by.setdefault(len(w), {}).setdefault(w, set()).add(name)
    return {n: (np.array(list(x), np.int64).reshape(-1, n), [sorted(s) for s in x.values()]) for n, x in by.items()}, codes


def search_windows(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> DataFrame:
    """Exact phrase search: for each document (shard, slot, doc_id, mark, n_words) the hit word ranges (begins, ends) and the items."""
    windows, codes = _windows(items, window)

    def search(t):
        shard = Shard(t, codes)
        hits = []
        for n, (p, names) in windows.items():
            row, start = shard.phrases(p)
            hits.append((np.full(len(row), n), start, shard.doc_of(start), [names[r] for r in row.tolist()]))
        begins: list[list] = [[] for _ in shard.docs]
        ends: list[list] = [[] for _ in shard.docs]
        found: list[set] = [set() for _ in shard.docs]
        for size, start, doc, names in hits:
            for n, s, d, x in zip(size.tolist(), (start - shard.starts[doc]).tolist(), doc.tolist(), names):
                begins[d].append(s)
                ends[d].append(s + n)
                found[d].update(x)
        n_words = np.diff(shard.starts) - 1
        merged = [merge_spans(b, e) for b, e in zip(begins, ends)]
        return pa.table({
            "shard": pa.array([t["shard"][0].as_py()] * len(n_words), pa.int64()), "slot": pa.array(range(len(n_words)), pa.int64()), "doc_id": pa.array(shard.docs), "mark": pa.array(shard.marks),
            "n_words": pa.array(n_words), "begins": pa.array([b for b, _ in merged], pa.list_(pa.int64())), "ends": pa.array([e for _, e in merged], pa.list_(pa.int64())),
            "items": pa.array([sorted(x) for x in found], pa.list_(pa.string())),
        })

    schema = "shard long, slot long, doc_id long, mark long, n_words long, begins array<long>, ends array<long>, items array<string>"
    return postings_of(index, list(codes)).groupBy("shard").applyInArrow(lean(search), schema)


def merge_spans(begins: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    b, e = [], []
    for x, y in sorted(zip(begins, ends)):
        if e and x <= e[-1]:
            e[-1] = max(e[-1], y)
        else:
            b.append(x)
            e.append(y)
    return b, e


def near(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """Proximity search: documents where all terms stand within so many words: (doc_id, begin, end), the shortest span from each start."""
    words = [w for t in terms for w in words_of(t.encode())]
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}

    def search(t):
        shard = Shard(t, codes)
        rows = []
        if len(codes) and shard.count.min() > 0:
            pos = shard.flat
            term = np.repeat(np.arange(len(codes)), shard.count)
            order = np.argsort(pos, kind="stable")
            last: dict[int, int] = {}
            for p, c in zip(pos[order].tolist(), term[order].tolist()):
                last[c] = p
                if len(last) == len(codes):
                    lo = min(last.values())
                    d, e = shard.doc_of(np.array([lo, p])).tolist()
                    if d == e and p - lo < within:
                        rows.append((int(shard.docs[d]), lo - int(shard.starts[d]), p + 1 - int(shard.starts[d])))
        cols = list(zip(*rows)) if rows else [[], [], []]
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("doc_id", "begin", "end"), cols)})

    return postings_of(index, list(codes)).groupBy("shard").applyInArrow(lean(search), "doc_id long, begin long, end long")


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, in blocks of block_words words; the driver holds one block at a time."""
    block: list = []
    size = 0
    for item, text in text_bytes(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")).toLocalIterator():
        words = words_of(bytes(text))
        if words and item is not None:
            if block and size + len(words) > block_words:
                yield block
                block, size = [], 0
            block.append((item, words))
            size += len(words)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_bytes: int = RUN_BYTES, rows: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is so many consecutive words of an item (all of a shorter one); words inside an
    occurrence are hit.  Items are the stated query set: they are searched against all
    documents in blocks of block_words words.  Null text has no words; a null doc_id gives a
    row with a null doc_id, counted like any other; items without id or words match nothing;
    repeated rows are judged one by one; an empty benchmark hits nothing, an empty table gives
    an empty result; texts of any length are indexed whole; extra columns are ignored.

    rows adds mark, a hash of the text.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("mark")
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), mark, "text")
    index = build_index(ids, shard_bytes)
    parts: list[DataFrame] = []
    for block in _blocks(benchmark, block_words):
        # an earlier block's result is written before the next one is read
        parts = [*parts[:-1], *(materialize(x, "found") for x in parts[-1:]), search_windows(index, block, window)]
    found = parts[0]
    if len(parts) > 1:
        for x in parts[1:]:
            found = found.unionByName(x)
        found = found.groupBy("shard", "slot").agg(
            F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("begins")).alias("begins"),
            F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            hit = []
            for b, e in zip(t["begins"].to_pylist(), t["ends"].to_pylist()):
                b, e = merge_spans(b, e) if len(b) > 1 else (b, e)
                hit.append(sum(e) - sum(b))
            items = t["items"].to_pylist()
            doc = [None if x == -(1 << 63) else x for x in t["doc_id"].to_pylist()]
            yield pa.record_batch({
                "doc_id": pa.array(doc, pa.int64()), "n_words": t["n_words"], "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), "contaminated": pa.array([h > 0 for h in hit]), "mark": t["mark"],
            })

    out = found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, mark long")
    return out if rows else out.drop("mark")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs whose text holds no benchmark window, as they are.

    Only the rows judged so go, not others of their id; null ids, null and empty texts stay;
    an empty benchmark drops nothing; columns of any name come along.
    """
    bad = contamination(docs, benchmark, rows=True).filter("contaminated").select(F.col("doc_id").alias("_bad"), F.col("mark").alias("_mark")).distinct()
    mark = F.xxhash64(F.coalesce(docs["text"].cast("binary"), F.lit(b"")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (mark == bad["_mark"]), "left_anti")
