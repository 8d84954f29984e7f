"""Suffix-array dedup: remove text that an earlier document already holds.

Method: a common-prefix-aware distributed merge sort of suffixes.

A byte is removed if a 50-byte string that covers it also starts in a document with
a smaller id.  Every 50-byte string contains an anchor, the position of the least
hash among its 24-byte substrings, so only suffixes that start at anchors (one in
about fourteen) need sorting; the bytes left of the anchor ride along.  The steps:

1. Distributed duplicate detection (how the sort bounds the prefixes it exchanges):
   every run of documents sends the sorted hashes of its anchors to hash buckets,
   which answer with a few bits each: does another document hold this anchor, and do
   very many runs hold it?
2. Each run sorts the suffixes at shared anchors, collapses equal ones (so a passage
   counts once a run, however many copies there are) and sends front-coded sorted
   runs, one for each bucket.  Windows at an anchor that very many runs hold go to a
   bucket of their own each, so contexts of one common string never meet in one task.
3. Each bucket merges its runs with a loser tree whose entries keep their common
   prefix with the last winner.  A match compares those lengths first and characters
   only beyond them.  The merged suffix array and its common prefixes, with those of
   the bytes to the left, give the strings that suffixes share: for each of the windows
   at an anchor the suffixes that agree on it are a block in both orders, and the
   bucket answers with the smallest document id of the block.
4. The runs mark the bytes and cut them out.

Runs are hash groups of documents, buckets hash groups of anchors; both counts follow
the input, so groups stay bounded; messages between them go over a grid (exchange.py),
so their number doesn't follow the square.  No state outlives a task: a lost executor
costs a recomputed task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._util import RUN_BYTES, lean, lean_batches, planes, run_count, text_bytes, unplanes
from .exchange import MESSAGE, deliver, letters, pack, received, unpack, width

WINDOW = 50
KGRAM = 24
#: An anchor that more runs hold is sent window by window.
HOT_RUNS = 512
_BITS = 42  # of an anchor's hash; the low bits hold a position while minima are taken
_POS = 64 - _BITS
_PIECE = 1 << 15  # bytes of text hashed at a time: the arrays stay in the processor's cache
_B = 0x9E3779B97F4A7C15 | 1
_LEFT = WINDOW - KGRAM  # bytes left of an anchor that its windows reach
_KEY = WINDOW + _LEFT + 2  # right part, left part backwards, their lengths plus one


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    return np.ndarray(max(0, len(b) - 7), "<u8", np.ascontiguousarray(b), 0, (1,)).copy()


def _kgram_hash(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of b[i:i+k] for every i; k is 8 at least."""
    w, n = _words(b), len(b) - k + 1
    out = np.full(n, k, np.uint64)
    for x, at in enumerate([*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]):
        out += w[at : at + n] * np.uint64(pow(_B, 2 * x + 1, 1 << 64))
    return _mix(out)


def _window_min(v: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (n - size)], v[n - size :]) if size < n else v


def anchors(buf: np.ndarray, offs: np.ndarray):
    """Groups of window starts with one anchor: first start, last start, anchor, hash, and the document of each.

    buf holds the documents' bytes one after the other, offs their bounds.
    """
    low = np.uint64((1 << _POS) - 1)
    parts = []
    long = offs[1:] - offs[:-1] >= WINDOW
    # a window may start where its end is in the same document
    start_of = np.ones(max(0, len(buf) - WINDOW + 1), bool)
    for x, y in zip(np.maximum(offs[:-1], offs[1:] - WINDOW + 1).tolist(), offs[1:].tolist()):
        start_of[x:y] = False
    for lo in range(0, len(start_of) if long.any() else 0, _PIECE):
        ok = start_of[lo : lo + _PIECE]
        h = _kgram_hash(buf[lo : lo + len(ok) + WINDOW - 1], KGRAM)
        v = (h >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
        m = _window_min(v, WINDOW - KGRAM + 1)
        new = ok.copy()
        new[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
        last = ok.copy()
        last[:-1] &= new[1:] | ~ok[1:]
        new, last = np.flatnonzero(new), np.flatnonzero(last)
        if len(new):
            w = m[new]
            parts.append((new + lo, last + lo, (w & low).astype(np.int64) + lo, w >> np.uint64(_POS)))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), z
    i0, i1, p, g = (np.concatenate(x) for x in zip(*parts))
    g = _mix(g * np.uint64(0xA24BAED4963EE407)) >> np.uint64(_POS)
    return i0, i1, p, g, np.searchsorted(offs, i0, side="right") - 1


def _squeeze(b: bytes) -> bytes:
    """b by zstd, after its length."""
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def _unsqueeze(b: bytes) -> bytes:
    return pa.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def _bundled(schema: pa.Schema):
    """Rows by their run, as compressed Arrow streams: a row for each run of a batch."""

    def run(batches):
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            t = pa.Table.from_batches([batch])
            runs = t["run"].to_numpy()
            order = np.argsort(runs, kind="stable")
            t, names = t.drop_columns("run").take(pa.array(order)).combine_chunks(), np.unique(runs)
            edge = np.searchsorted(runs[order], names).tolist() + [len(runs)]
            for r, x, y in zip(names.tolist(), edge, edge[1:]):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, t.schema, options=how) as w:
                    w.write_table(t.slice(x, y - x))
                yield pa.record_batch([pa.array([r], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], schema)

    return run


def _docs_of(t: pa.Table):
    """Rows of one run by id and text, an order that every reader of the run gets: ids, text buffer, offsets, table."""
    t = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in t["rows"]])
    ids = t["doc_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        order = pc.sort_indices(t.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")]).to_numpy()
    ids = ids[order]
    t = t.combine_chunks().take(pa.array(order)).combine_chunks()
    texts = t["text"].combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], t.schema.field("text").type)
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    offs = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return ids, buf, offs - offs[0], t


def _edges(g: np.ndarray, nb: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes; buckets are equal ranges of them."""
    edges = np.searchsorted(g, (np.arange(nb + 1, dtype=np.uint64) * np.uint64(1 << _BITS)) // np.uint64(nb))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in range(nb) if edges[b + 1] > edges[b]]


def _bucket_of(g: np.ndarray, nb: int) -> np.ndarray:
    edges = (np.arange(1, nb, dtype=np.uint64) * np.uint64(1 << _BITS)) // np.uint64(nb)
    return np.searchsorted(edges, g, side="right")


def _pack_sorted(g: np.ndarray) -> bytes:
    d = np.diff(g, prepend=np.uint64(0))
    wide = d.max() >> np.uint64(32) > 0
    return bytes([8 if wide else 4]) + planes(d.astype(np.uint64 if wide else np.uint32))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b[1:], np.uint64 if b[0] == 8 else np.uint32).astype(np.uint64))


def _by_hash(g, of):
    """Unique hashes of a run, whether documents of several ids hold each, and the slot of each anchor."""
    if len(g) >> _POS:
        order = np.argsort(g, kind="stable")
    else:  # numbers sort faster than places
        order = (np.sort((g << np.uint64(_POS)) | np.arange(len(g), dtype=np.uint64)) & np.uint64((1 << _POS) - 1)).astype(np.int64)
    s, d = g[order], of[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    slot = np.cumsum(new) - 1
    multi = np.zeros(int(new.sum()), bool)
    if len(s):
        multi[slot[1:][(~new[1:]) & (d[1:] != d[:-1])]] = True
    back = np.empty(len(g), np.int64)
    back[order] = slot
    return s[new], multi, back


def _hashes(nb: int, wide: int):
    def run(key, t):
        ids, buf, offs, _ = _docs_of(t)
        *_, g, doc = anchors(buf, offs)
        u, multi, _ = _by_hash(g, ids[doc])
        return letters(key[0].as_py(), [(b, pack([(y - x, _pack_sorted(u[x:y])), (0, np.packbits(multi[x:y]).tobytes())])) for b, x, y in _edges(u, nb)], wide)

    return run


def _shared(wide: int, hot_runs: int):
    """A bucket tells each run two bits for each of its hashes: held by documents of several ids; held by very many runs."""

    def bucket(key, t):
        runs, gs, ms = [], [], []
        for src, body in received(t):
            (n, hashes), (_, multi) = unpack(body)
            runs.append(src)
            gs.append(_unpack_sorted(hashes))
            ms.append(np.unpackbits(np.frombuffer(multi, np.uint8), count=n).astype(bool))
        every, times = np.unique(np.concatenate(gs), return_counts=True)
        held = times > 1
        for g, m in zip(gs, ms):
            held[np.searchsorted(every, g[m])] = True
        hot = held & (times > hot_runs)
        out = []
        for r, g in zip(runs, gs):
            at = np.searchsorted(every, g)
            if held[at].any():
                out.append((r, np.packbits(np.r_[held[at], hot[at]]).tobytes()))
        return letters(key[0].as_py(), out, wide)

    return bucket


class _Suffixes:
    """Distinct suffixes of a run at its shared anchors, by bucket, sorted; and where each occurs, by document."""

    def __init__(self, ids, buf, offs, nb: int, bits: dict[int, bytes]):
        i0, i1, p, g, doc = anchors(buf, offs)
        u, _, slot = _by_hash(g, ids[doc])
        held, hot = np.zeros(len(u), bool), np.zeros(len(u), bool)
        for b, x, y in _edges(u, nb):
            if b in bits:
                both = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=2 * (y - x)).astype(bool)
                held[x:y], hot[x:y] = both[: y - x], both[y - x :]
        sel = np.flatnonzero((held & ~hot)[slot])
        each = np.flatnonzero(hot[slot])
        left, self.p, right = (p - i0)[sel], p[sel], (i1 - p)[sel] + WINDOW
        bucket, self.of = _bucket_of(g[sel], nb), ids[doc[sel]]
        if len(each):  # windows of common anchors stand for themselves
            n = (i1 - i0)[each] + 1
            start = np.repeat(i0[each] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            h = np.concatenate([_kgram_hash(buf[lo : lo + _PIECE + WINDOW - 1], WINDOW) for lo in range(0, len(buf) - WINDOW + 1, _PIECE)])[start]
            left, self.p, right = np.r_[left, np.zeros(len(start), np.int64)], np.r_[self.p, start], np.r_[right, np.full(len(start), WINDOW)]
            bucket, self.of = np.r_[bucket, _bucket_of(h >> np.uint64(_POS), nb)], np.r_[self.of, np.repeat(ids[doc[each]], n)]
        keys = _keys(buf, self.p, right, left)
        order = np.argsort(keys.view(f"S{_KEY}").reshape(-1), kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        self.p, self.of, keys, bucket = self.p[order], self.of[order], keys[order], bucket[order]
        lcp = _common(keys)
        new = np.r_[True, (lcp[1:] < _KEY) | (bucket[1:] != bucket[:-1])] if len(order) else np.zeros(0, bool)
        #: first occurrence of each entry, and the end
        self.first = np.r_[np.flatnonzero(new), len(order)]
        at = self.first[:-1]
        self.keys, self.lcp, self.bucket = keys[at], lcp[at], bucket[at]
        # entries of each bucket stand together
        self.begin = np.searchsorted(self.bucket, np.arange(nb + 1))


def _keys(buf: np.ndarray, p: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A fixed-width row for each suffix: right bytes from the anchor on, left bytes going back, zeros beyond, the lengths plus one."""
    padded = np.r_[np.zeros(_LEFT, np.uint8), buf, np.zeros(WINDOW, np.uint8)]
    view = np.lib.stride_tricks.sliding_window_view(padded, _LEFT + WINDOW)
    out = np.empty((len(p), _KEY), np.uint8)
    for x in range(0, len(p), 1 << 15):
        y = slice(x, x + (1 << 15))
        got = view[p[y]]
        out[y, :WINDOW] = np.where(np.arange(WINDOW) < right[y, None], got[:, _LEFT:], 0)
        out[y, WINDOW : WINDOW + _LEFT] = np.where(np.arange(_LEFT) < left[y, None], got[:, _LEFT - 1 :: -1], 0)
    out[:, -2], out[:, -1] = left + 1, right + 1
    return out


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of each row's common prefix with the one before; 0 for the first, all of it for equal rows."""
    n, k = rows.shape
    out = np.zeros(n, np.int64)
    for x in range(1, n, 1 << 15):
        y = min(n, x + (1 << 15))
        differ = rows[x:y] != rows[x - 1 : y - 1]
        out[x:y] = np.where(differ.any(axis=1), differ.argmax(axis=1), k)
    return out


def front_code(keys: np.ndarray, lcp: np.ndarray) -> list[bytes]:
    """Common prefixes with the row before, and the bytes beyond them."""
    lcp = np.r_[0, lcp[1:]] if len(lcp) else lcp
    return [lcp.astype(np.uint8).tobytes(), keys[np.arange(keys.shape[1]) >= lcp[:, None]].tobytes()]


def front_decode(lcps: bytes, rest: bytes, size: int) -> bytes:
    """The rows of front_code(), one after the other."""
    out, last, at = [], b"", 0
    for h in lcps:
        last = last[:h] + rest[at : at + size - h]
        at += size - h
        out.append(last)
    return b"".join(out)


def merge_runs(runs: list[tuple[np.ndarray, list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of distinct keys with a loser tree.

    A run is its keys as a matrix of bytes, all runs of one width, and each key's common prefix
    with the one before.  Returns, in merged order, the run of each key and its common prefix
    with the key before.  Every entry in the tree knows its common prefix with the last winner,
    so a longer one is the smaller key without looking at characters, and equal ones are
    compared only from that prefix on, eight bytes at a time.
    """
    k = len(runs)
    if not k:
        return [], []
    size = runs[0][0].shape[1]
    per = -(-size // 8)
    words, lcps = [], [x for _, x in runs]
    for m, _ in runs:
        full = np.zeros((len(m), 8 * per), np.uint8)
        full[:, :size] = m
        words.append(full.view(">u8").reshape(-1).tolist())
    count = [len(x) for x in lcps]
    base, lcp = [0] * k, [0 if n else -1 for n in count]  # first word of the key; -1: nothing left
    tree = [-1] * k  # losers; tree[0] is unused

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two with the same common prefix; the loser's becomes that with the winner."""
        h = lcp[a]
        if h < 0:
            return a, b
        x, y, i, j = words[a], words[b], base[a], base[b]
        for w in range(h >> 3, per):
            u, v = x[i + w], y[j + w]
            if u != v:
                h = 8 * w + ((64 - (u ^ v).bit_length()) >> 3)
                if u < v:
                    lcp[b] = h
                    return a, b
                lcp[a] = h
                return b, a
        if a > b:
            a, b = b, a
        lcp[b] = size
        return a, b

    at = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = at[2 * node], at[2 * node + 1]
        if lcp[a] != lcp[b]:
            at[node], tree[node] = (a, b) if lcp[a] > lcp[b] else (b, a)
        else:
            at[node], tree[node] = play(a, b)
    win = at[1] if k > 1 else 0
    place = [0] * k
    out, common = [], []
    own = lcp[win]
    while own >= 0:
        out.append(win)
        common.append(own)
        i = place[win] = place[win] + 1
        base[win] += per
        own = lcp[win] = lcps[win][i] if i < count[win] else -1
        node = (win + k) >> 1
        while node:
            o = tree[node]
            x = lcp[o]
            if x >= own:
                if x > own:
                    tree[node], win, own = win, o, x
                elif x >= 0:
                    win, tree[node] = play(win, o)
                    own = lcp[win]
            node >>= 1
    return out, common


def _send(nb: int, wide: int):
    def run(key, t, said):
        if not t.num_rows or not said.num_rows:
            return letters(0, [], wide)
        ids, buf, offs, _ = _docs_of(t)
        s = _Suffixes(ids, buf, offs, nb, dict(received(said)))
        out = []
        if len(s.of):
            for b in np.unique(s.bucket).tolist():
                x, y = s.begin[b], s.begin[b + 1]
                u, v = s.first[x], s.first[y]
                said = (*front_code(s.keys[x:y], s.lcp[x:y]), planes(np.diff(s.first[x : y + 1]).astype(np.uint32)), planes(s.of[u:v]), planes(s.p[u:v].astype(np.uint32)))
                out.append((b, _squeeze(pack([(0, z) for z in said]))))
        return letters(t["run"][0].as_py(), out, wide)

    return run


def _windows(keys: np.ndarray, h: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which windows of sorted distinct suffixes a document holds first: spans (key, from, to, smallest id).

    h: common prefixes; low: the smallest id of each suffix.  A window is named by its number of bytes left of the anchor.
    """
    n = len(keys)
    left, right = keys[:, -2].astype(np.int64) - 1, keys[:, -1].astype(np.int64) - 1
    first, last = WINDOW - right, left
    alone = np.r_[h[1:] < KGRAM, True] & (h < KGRAM)
    spans = [(np.flatnonzero(alone), first[alone], last[alone], low[alone])]
    some = np.flatnonzero(~alone)
    if len(some):
        h, low, first, last = np.minimum(h[some], WINDOW), low[some], first[some], last[some]
        m = len(some)
        group = np.cumsum(h < KGRAM)
        back = np.ascontiguousarray(keys[some, WINDOW : WINDOW + _LEFT])
        order = np.lexsort((back.view(f"S{_LEFT}").reshape(-1), group))
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        lh = _common(back[order])
        lh[np.r_[True, group[order][1:] != group[order][:-1]]] = -1
        h = np.where(h < KGRAM, -1, h)
        near_right, near_left = np.maximum(h, np.r_[h[1:], -1]), np.maximum(lh, np.r_[lh[1:], -1])[rank]
        who = np.repeat(low[:, None], _LEFT + 1, axis=1)
        for j in range(_LEFT + 1):
            i = np.flatnonzero((first <= j) & (last >= j) & (near_right >= WINDOW - j) & (near_left >= j))
            if len(i):
                # suffixes that agree on the window are a block of the one order and of the other
                code = np.cumsum(h < WINDOW - j)[i] * (m + 1) + np.cumsum(lh < j)[rank[i]]
                o = np.argsort(code, kind="stable")
                new = np.flatnonzero(np.r_[True, code[o][1:] != code[o][:-1]])
                least = np.minimum.reduceat(low[i[o]], new)
                who[i[o], j] = np.repeat(least, np.diff(np.r_[new, len(o)]))
        j = np.arange(_LEFT + 1)
        valid = (j >= first[:, None]) & (j <= last[:, None])
        step = np.zeros(valid.shape, bool)
        step[:, 1:] = who[:, 1:] != who[:, :-1]
        begins = valid & (step | (j == first[:, None]))
        ends = valid.copy()
        ends[:, :-1] &= begins[:, 1:] | ~valid[:, 1:]
        a, x = np.nonzero(begins)
        _, y = np.nonzero(ends)
        spans.append((some[a], x, y, who[a, x]))
    return tuple(np.concatenate(x) for x in zip(*spans))


def _spread(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of n numbers from starts on: the range of each, and the number."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) + np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n)


def _answers(wide: int):
    """A bucket merges its runs; it tells each run the passages that a smaller document holds."""

    def bucket(key, t):
        runs, keys, lcps, counts, ids, places = [], [], [], [], [], []
        for src, body in received(t):
            h, rest, n, of, p = (x for _, x in unpack(_unsqueeze(body)))
            runs.append(src)
            keys.append(np.frombuffer(front_decode(h, rest, _KEY), np.uint8).reshape(-1, _KEY))
            lcps.append(list(h))
            counts.append(unplanes(n, np.uint32).astype(np.int64))
            ids.append(unplanes(of, np.int64))
            places.append(unplanes(p, np.uint32))
        run, h = (np.array(x) for x in merge_runs(list(zip(keys, lcps))))
        row = np.empty(len(run), np.int64)  # among the runs one after the other, for each merged place
        row[np.argsort(run, kind="stable")] = np.arange(len(run))
        count, ids, places = np.concatenate(counts), np.concatenate(ids), np.concatenate(places).astype(np.int64)
        first = np.r_[0, np.cumsum(count)[:-1]]
        new = np.flatnonzero(h < _KEY)
        low = np.minimum.reduceat(np.minimum.reduceat(ids, first)[row], new)
        top = np.maximum.reduceat(np.maximum.reduceat(ids, first)[row], new)
        k, x, y, m = _windows(np.concatenate(keys)[row[new]], h[new], low)
        use = top[k] > m
        k, x, y, m = k[use], x[use], y[use], m[use]
        # each suffix has a copy in some runs, each copy its occurrences
        span, at = _spread(new[k], np.diff(np.r_[new, len(run)])[k])
        copy, q = _spread(first[row[at]], count[row[at]])
        span = span[copy]
        use = ids[q] > m[span]
        q, span = q[use], span[use]
        r = run[at][copy[use]]
        o = np.argsort(r, kind="stable")
        r, start, size = r[o], (places[q] - y[span])[o], (y - x)[span][o] + WINDOW
        edge = np.searchsorted(r, np.arange(len(runs) + 1))
        out = []
        for i, src in enumerate(runs):
            a, b = edge[i], edge[i + 1]
            if b > a:
                out.append((src, planes(start[a:b].astype(np.uint32)) + size[a:b].astype(np.uint8).tobytes()))
        return letters(key[0].as_py(), out, wide)

    return bucket


def _gone(buf: np.ndarray, said: pa.Table) -> np.ndarray:
    """Which bytes of a run go."""
    cover = np.zeros(len(buf) + 1, np.int32)
    for _, body in received(said):
        n = len(body) // 5
        start = unplanes(body[: 4 * n], np.uint32).astype(np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + np.frombuffer(body, np.uint8, n, 4 * n), -1)
    return np.cumsum(cover[:-1], dtype=np.int32) > 0


def _whole_characters(gone: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """gone, less the bytes of characters of which a byte stays."""
    character = np.cumsum((buf & 0xC0) != 0x80)
    stays = np.zeros(int(character[-1]) + 1 if len(character) else 1, bool)
    stays[character[~gone]] = True
    return gone & ~stays[character]


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags each document has."""
    out = np.zeros(len(offs) - 1, np.int64)
    some = np.flatnonzero(offs[1:] > offs[:-1])
    if len(some):
        out[some] = np.add.reduceat(flags.view(np.uint8), offs[some], dtype=np.int64)
    return out


def _cut(with_text: bool):
    def run(key, t, said):
        ids, buf, offs, t = _docs_of(t)
        gone = _gone(buf, said)

        def cut(gone):
            return np.r_[0, np.cumsum(_sums(gone, offs))], memoryview(buf[~gone].tobytes())

        before, rest = cut(gone)
        at = (offs - before).tolist()
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        edge = offs[:-1][offs[1:] > offs[:-1]]
        starts[edge] = gone[edge]
        cols = {
            "doc_id": pa.array(ids), "n_bytes": pa.array(np.diff(offs)), "n_removed": pa.array(np.diff(before)), "n_spans": pa.array(_sums(starts, offs)),
            "kept_sha256": pa.array([hashlib.sha256(rest[x:y]).hexdigest() for x, y in zip(at, at[1:])], pa.string()),
        }
        if with_text:
            before, rest = cut(_whole_characters(gone, buf))
            at = (offs - before).tolist()
            kept = [None if no else bytes(rest[x:y]).decode("utf-8", "replace") for x, y, no in zip(at, at[1:], t["missing"].to_pylist())]
            cols["kept"] = pa.array(kept, pa.string())
            cols["rest"] = t["rest"]
        return pa.table(cols)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, run_bytes: int = 2 * RUN_BYTES, hot_runs: int = HOT_RUNS, direct: int | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty.  Rows that share a doc_id don't shorten one another; copies in them
    are cut by smaller ids only.  A null doc_id neither cuts nor is cut: its text stays whole.
    Other columns are ignored, whatever their names.  An empty table gives an empty result.
    Texts of any length are judged whole.  The figures and the digest are of bytes.  With
    with_text two more columns come along: kept, the text that is left, cut at whole
    characters only (a character of which a byte stays is kept; null for a null text), and rest, a struct
    of the other columns of docs.

    hot_runs, direct: see HOT_RUNS and exchange.DIRECT.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.col("text").isNull().alias("missing"), F.struct(*(others or [F.lit(True).alias("_")])).alias("rest")] if with_text else []
    base = text_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest))
    n = run_count(base, "text", run_bytes)
    nb = max(8, n)
    wide = width(nb, direct)
    some = base.filter("doc_id is not null").withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    # A partition has about one run or bucket, whatever the size: the sorts before the groups stay in memory.
    dealt = lambda df, key: df.repartition(nb, key)
    some = dealt(some.mapInArrow(lean_batches(_bundled(pa.schema([("run", pa.int32()), ("rows", pa.binary())]))), "run int, rows binary"), "run")
    hashes = dealt(deliver(some.groupBy("run").applyInArrow(lean(_hashes(nb, wide)), MESSAGE), wide), "dst")
    held = dealt(deliver(hashes.groupBy("dst").applyInArrow(lean(_shared(wide, hot_runs)), MESSAGE), wide), "dst")
    sent = dealt(deliver(some.groupBy("run").cogroup(held.groupBy("dst")).applyInArrow(lean(_send(nb, wide)), MESSAGE), wide), "dst")
    answers = dealt(deliver(sent.groupBy("dst").applyInArrow(lean(_answers(wide)), MESSAGE), wide), "dst")
    schema = StructType([StructField(c, LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType())])
    whole = [F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")]
    if with_text:
        schema = schema.add("kept", StringType()).add(base.schema["rest"])
        whole += [F.when(~F.col("missing"), F.expr("make_valid_utf8(cast(text as string))")).alias("kept"), "rest"]
    out = some.groupBy("run").cogroup(answers.groupBy("dst")).applyInArrow(lean(_cut(with_text)), schema)
    return out.unionByName(base.filter("doc_id is null").select("doc_id", *whole))
