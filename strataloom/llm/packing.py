"""Best-fit packing of documents into sequences of several permitted lengths.

Method: variable-capacity best fit.  Pieces go, longest first, into the open bin that
they fill best.  If none has room, a bin is opened whose size is chosen jointly with the
pieces still to come: for every permitted length the filling that the remaining pieces
would give is worked out (longest that fits, again and again, less what open bins can
take), and the length with the least cost per token held is opened.  In the end every bin
shrinks to the least permitted length that holds its contents.  A group is packed so with
every choice of the permitted lengths, and its cheapest packing stays.  The cost of a length
counts a fixed share for each sequence, its tokens, and the attention over it.

Documents are dealt at random to groups of a bounded total length and packed group by
group; a group leaves at most a few bins part-filled.  The result is the sequences
themselves: token ids with the bounds of their documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._util import lean, text_bytes

#: Permitted sequence lengths, in tokens.
CAPACITIES = (2048, 8192, 32768)
#: Tokens a group holds, about.
GROUP_TOKENS = 1 << 23
#: Id of the end token; ids below it are the bytes of the text.
END = 256


def bin_cost(capacity: int, fixed: float = 64.0, attention: float = 1 / 65536) -> float:
    """Cost of a sequence: a fixed share, its tokens, and attention that grows with the square."""
    return fixed + capacity + attention * capacity * capacity


def filling(lengths: list[int], sums: list[int], at: int, space: int) -> int:
    """Tokens that go into a space if the longest remaining piece that fits is taken again and again.

    lengths: in descending order, those from at on remain; sums: their sums from the first on.
    """
    held, n = 0, len(lengths)
    while at < n and space >= lengths[-1]:
        at = bisect_left(lengths, -space, at, key=lambda x: -x)  # first that fits
        if at == n:
            break
        end = bisect_left(sums, sums[at] + space + 1, at) - 1  # so many fit in a row
        got = sums[end] - sums[at]
        held, space, at = held + got, space - got, end
    return held


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int]]:
    """Bins of pieces of the given lengths, in descending order and each at most the largest capacity.

    Every choice of some of the permitted lengths that holds the longest piece is packed, and
    the cheapest packing stays (of equal ones that of more lengths), so it is never dearer
    than that of any single length.  Returns (bin, offset) of each piece and the length of
    each bin, which may be any permitted one.
    """
    sizes = sorted(capacities)
    longest = int(lengths[0]) if len(lengths) else 0
    best, least = ([], [], []), float("inf")
    for n in range(len(sizes), 0, -1):
        for some in combinations(sizes, n):
            if some[-1] >= longest:
                found = _pack(lengths, list(some), sizes, cost)
                total = sum(cost(c) * k for c, k in Counter(found[2]).items())
                if total < least:
                    best, least = found, total
    return best


def _pack(lengths: np.ndarray, sizes: list[int], permitted: list[int], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """The packing that opens bins of some sizes only; in the end every bin shrinks to the least permitted length."""
    costs = [cost(c) for c in sizes]
    every = lengths.tolist()
    sums = [0, *np.cumsum(lengths).tolist()]
    bins, offsets, used = [], [], []
    free: list[tuple[int, int]] = []  # (space, bin) of the open bins, sorted
    spare = 0  # space in them

    def price(c: int, k: float, n: int, after: int) -> float:
        """Cost per token of opening length c for a piece of n."""
        held = n + min(filling(every, sums, after, c - n), max(0, sums[-1] - sums[after] - spare))
        small = bisect_left(sizes, held)
        return costs[small] / held if sizes[small] < c else k / held

    for i, n in enumerate(every):
        at = bisect_left(free, (n, -1))
        if at < len(free):
            space, b = free.pop(at)
            spare -= space
        else:
            fit = [(c, k) for c, k in zip(sizes, costs) if c >= n]
            space = (fit[0] if len(fit) == 1 else min(fit, key=lambda x: price(*x, n, i + 1)))[0]
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if space > n:
            insort(free, (space - n, b))
            spare += space - n
    return bins, offsets, [permitted[bisect_left(permitted, u)] for u in used]


def byte_ids(text: bytes) -> np.ndarray:
    """Ids of a byte-level model: the bytes, then the end token."""
    return np.append(np.frombuffer(text, np.uint8).astype("<u2"), np.uint16(END))


_BINS = "bin_group long, bin long, bin_length long, bin_used long, doc_ids array<long>, pieces array<long>, starts array<long>, lengths array<long>, ids binary"


def pack_sequences(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Sequences of the texts of docs (doc_id, text): a row for each bin.

    bin_group, bin: its number; bin_length: the permitted length; bin_used: tokens in it;
    doc_ids, pieces, starts, lengths: for each piece in order its document, number, first
    token in the document and tokens; ids: the tokens one after the other, as little-endian
    unsigned 16-bit numbers (bytes of the text, and END after each document).

    A document longer than the largest capacity is cut into full pieces and a rest; nothing
    is dropped.  Null and empty texts are the end token alone; null ids are packed like any
    other; rows that share an id are packed each, ties go by id; an empty table gives an
    empty result; extra columns are ignored.
    """
    most = max(capacities)
    some = text_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("n", F.octet_length("text").cast("long") + 1)
    n_groups = max(1, -(-int(some.agg(F.sum("n")).first()[0] or 0) // group_tokens))
    # Very long documents are dealt out piece by piece; the end token is in the last.
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}")))
    pieces = some.withColumn("piece", piece).select("doc_id", "piece", F.expr(f"n <= (piece + 1) * {most}").alias("last"), F.expr(f"substring(text, int(piece * {most} + 1), {most})").alias("text"))

    def group(key, t):
        length = np.array([len(x) for x in t["text"].to_pylist()], np.int64) + t["last"].to_numpy().astype(np.int64)
        t = t.append_column("length", pa.array(length)).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = t["length"].to_numpy()
        bins, offsets, sizes = pack(length, capacities)
        order = np.lexsort((offsets, bins))
        edge = np.searchsorted(np.array(bins)[order], np.arange(len(sizes) + 1))
        ids = [byte_ids(x) if e else byte_ids(x)[:-1] for x, e in zip(t["text"].to_pylist(), t["last"].to_pylist())]
        rows = [order[x:y] for x, y in zip(edge, edge[1:])]
        lists = {c: t[d].combine_chunks() for c, d in (("doc_ids", "doc_id"), ("pieces", "piece"), ("lengths", "length"))}
        take = pa.array(order)
        flat = {c: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), x.take(take)) for c, x in lists.items()}
        flat["starts"] = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(t["piece"].to_numpy()[order] * most))
        out = {"bin_group": pa.array([key[0].as_py()] * len(sizes), pa.int64()), "bin": pa.array(range(len(sizes)), pa.int64()), "bin_length": pa.array(sizes, pa.int64())}
        out["bin_used"] = pa.array([int(length[r].sum()) for r in rows], pa.int64())
        return pa.table(out | {c: flat[c] for c in ("doc_ids", "pieces", "starts", "lengths")} | {"ids": pa.array([np.concatenate([ids[i] for i in r]).tobytes() for r in rows], pa.binary())})

    return pieces.groupBy(F.pmod(F.xxhash64("doc_id", "piece", "text"), F.lit(n_groups)).alias("bin_group")).applyInArrow(lean(group), _BINS)


def packed_pieces(sequences: DataFrame) -> DataFrame:
    """A row for each piece of pack_sequences(): doc_id, piece, start, length, bin_group, bin, offset, bin_used, bin_length, ids_crc32 (of its ids, read from the sequence)."""
    before = F.aggregate(F.slice("lengths", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x)
    some = sequences.select("*", F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts", "lengths")).alias("i", "p")).withColumn("offset", before)
    own = F.expr("substring(ids, int(2 * offset + 1), int(2 * p.lengths))")
    return some.select(
        F.col("p.doc_ids").alias("doc_id"), F.col("p.pieces").alias("piece"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), "bin_group", "bin", "offset", "bin_used", "bin_length",
        F.crc32(own).alias("ids_crc32"),
    )
