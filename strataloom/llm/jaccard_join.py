"""Near-duplicate join: documents whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Method: chosen-path join.  A document's shingle set is sketched by 64 minima, the sampled
shared tokens.  In each run a document starts at a root and follows every sketch token
that a hash of the path and the token chooses, about one over the threshold of them; two
sets of similarity J share a chosen token for each of J/0.8 on average.  Buckets of one
path that are small are compared by brute force, large ones are split again on further
chosen tokens.  Runs come in batches, repeated until the recall wanted is reached: from how
many runs found each of a sample of pairs the number that no run found is estimated, and
the share of the others is the recall.  (In theory a run of one level misses a pair at the
threshold with probability 1/e, so eight runs miss one in three thousand.)

Equal sets are joined first and stand as one row.  Before a large bucket is split, its
members are compared with a pivot, and those very near it leave the recursion as its
family (Jaccard distance is a metric: whatever is linked to them is a candidate of the
pivot as well).  What stays large at the last level is compared in blocks of pairs of
chunks; what leaves a bucket is the stars of its candidate components, never the pairs.  The components of these
forests are the groups in which every pair is then verified on the whole shingle sets,
again in chunks bounded in rows and in bytes; this finds the links that the buckets missed
inside a group, too.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._util import lean, lean_batches, materialize, text_bytes, words_of
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 64
#: Runs of a batch, the estimated recall that ends them, and batches after which a recall below it is an error.
RUNS, RECALL, BATCHES = 8, 0.999, 16
#: One of so many pairs is in the sample from which recall is estimated; a sample of fewer than LEAST_SAMPLE is replaced by all pairs.
SAMPLED, LEAST_SAMPLE = 16, 50
DEPTH = 3
#: Members of a bucket or group compared in one piece; larger ones in pairs of chunks of this size.
SMALL = 512
#: Bytes of text in a chunk of a verified group, and rows or bytes that one call takes, about.
CHUNK_BYTES, CALL_ROWS, CALL_BYTES = 4 << 20, 20_000, 16 << 20
#: A sketch estimate this far below the threshold (five standard deviations) rules a pair out.
SLACK = 0.3
#: Members of a large bucket that agree so much with its pivot leave the recursion, linked to it.  What is
#: linked to such a member has a true similarity of 0.65 or more with the pivot, so it is a candidate too.
FAMILY = 0.85

_M = np.uint64(0x9E3779B97F4A7C15)
_log = logging.getLogger(__name__)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; word hashes are remembered."""

    def __init__(self, size: int = SHINGLE, cache: int = 500_000):
        from xxhash import xxh3_64_intdigest

        self.size, self.cache, self.hash, self.known = size, cache, xxh3_64_intdigest, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.cache:
            self.known.clear()
        known, new = self.known, self.hash
        h = np.array([known.get(w) or known.setdefault(w, new(w)) for w in words], np.uint64)
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, min(len(h), self.size), np.uint64)
        for i in range(min(self.size, len(h))):
            out = out * _M + h[i : i + n]
        return np.unique(_mix(out))


_A = _mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * _M) | np.uint64(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value of each of the hash functions over the set."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[at : at + 4096, None] * _A[None, :]).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def row_mark(text: str = "text") -> Column:
    """Hash of a text; with the doc_id it tells rows apart whose ids are the same."""
    return F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_bytes, key, sketch): key is a 128-bit digest of the set, null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shingles = Shingler()
        for t in batches:
            rows: list[list] = [[], [], []]
            for x in t.column(2):
                text = x.as_py()
                s = shingles(text)
                rows[0].append(len(text))
                rows[1].append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                rows[2].append(sketch(s).tobytes() if len(s) else None)
            yield pa.record_batch({"doc_id": t.column(0), "mark": t.column(1), "n_bytes": pa.array(rows[0], pa.int64()), "key": pa.array(rows[1], pa.binary()), "sketch": pa.array(rows[2], pa.binary())})

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_mark().alias("mark"), "text")
    return text_bytes(some).mapInArrow(lean_batches(run), "doc_id long, mark long, n_bytes long, key binary, sketch binary")


def _chosen(paths: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that each (path, sketch) row chooses: (row, child path)."""
    with np.errstate(over="ignore"):
        token = sigs.astype(np.uint64) | (np.arange(SKETCH, dtype=np.uint64) << np.uint64(32))
        h = _mix(_mix(token * _M) ^ _mix(paths.astype(np.uint64))[:, None])
        row, col = np.nonzero(h < np.uint64(int(2**64 / (THRESHOLD * SKETCH))))
        return row, _mix(h[row, col] + np.uint64(1)).view(np.int64)


def _walk(nodes: DataFrame, roots: range | None = None) -> DataFrame:
    """Children (path, run, rep) of nodes (rep, sketch[, path, run]); roots: the runs that start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(0, t.num_rows, 4096):
                part = t.slice(at, 4096)
                rep = part.column(0).to_numpy(zero_copy_only=False)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(-1, SKETCH)
                if roots is None:
                    starts = [(part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False))]
                else:
                    starts = [(np.full(len(rep), -1 - r, np.int64), np.full(len(rep), r, np.int32)) for r in roots]
                for p, r in starts:
                    row, child = _chosen(p.view(np.uint64), sig)
                    yield pa.record_batch({"path": pa.array(child), "run": pa.array(r[row], pa.int32()), "rep": pa.array(rep[row])})

    return nodes.mapInArrow(lean_batches(run), "path long, run int, rep long")


def _chunked(df: DataFrame, chunks: Column, member: str) -> DataFrame:
    """A row for each cell of df's groups: a group of one chunk is one cell, another has a cell for each pair of chunks.

    Columns cell_a, cell_b (chunks) and chunk (of the member) are added.
    """
    out = df.withColumn("_q", F.greatest(F.lit(1), chunks).cast("int")).withColumn("chunk", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_q")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)))
    return out.withColumn("cell_a", F.least("chunk", "_o")).withColumn("cell_b", F.greatest("chunk", "_o")).drop("_o", "_q")


def _calls(df: DataFrame, chunks: Column, size: Column, most: int) -> int:
    """How many calls of most the rows of df make, each of a size and as often as its group has chunks."""
    return max(1, int(df.agg(F.sum(F.greatest(F.lit(1), chunks).cast("long") * size)).first()[0] or 0) // most)


def _pairs(chunk: np.ndarray, a: int, b: int):
    """Rows and columns to compare in a cell, in blocks; in a cell of two chunks only across, in one of one only within."""
    rows = np.flatnonzero(chunk == a)
    cols = rows if a == b else np.flatnonzero(chunk == b)
    for at in range(0, len(rows), 64):
        yield rows[at : at + 64], cols


class _Forest:
    """Stars of the components of all pairs that one call finds, whatever bucket they come from."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        return [(c, x) for x in list(self.up) if (c := self.find(x)) != x]


def _sampled(a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    x = _mix(a.astype(np.uint64) * _M ^ _mix(b.astype(np.uint64)))
    return x % np.uint64(share) == 0


def _candidates(t, share: int = SAMPLED):
    """Stars of the pairs whose sketches agree enough, in the buckets of one call (run null), and a sample (one in `share`) of the likely links."""
    need = int(SKETCH * (THRESHOLD - SLACK))
    t = t.combine_chunks()
    path, run, ca, cb, chunk, rep = (t[c].to_numpy(zero_copy_only=False) for c in ("path", "run", "cell_a", "cell_b", "chunk", "rep"))
    order = np.lexsort((rep, cb, ca, path))
    path, run, ca, cb, chunk, rep = (x[order] for x in (path, run, ca, cb, chunk, rep))
    found = []

    def link(i: np.ndarray, j: np.ndarray, agree: np.ndarray) -> None:
        forest.add(rep[i], rep[j])
        u, v = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
        k = (u != v) & (agree >= SKETCH * THRESHOLD) & _sampled(u, v, share)
        if k.any():
            found.append((u[k], v[k], run[i][k]))

    sig = np.frombuffer(b"".join(t["sketch"].to_pylist()), "<u4").reshape(-1, SKETCH)[order]
    new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])]) if len(path) else []
    forest = _Forest()
    for x, y in zip(new, np.r_[new[1:], len(path)] if len(path) else []):
        if y - x == 2:
            if (ca[x] == cb[x] or chunk[x] != chunk[x + 1]) and (n := (sig[x] == sig[x + 1]).sum()) >= need:
                link(np.array([x]), np.array([x + 1]), np.array([n]))
            continue
        s = sig[x:y]
        for rows, cols in _pairs(chunk[x:y], ca[x], cb[x]):
            agree = (s[rows][:, None, :] == s[cols][None, :, :]).sum(axis=2)
            i, j = np.nonzero(agree >= need)
            link(x + rows[i], x + cols[j], agree[i, j])
    stars = forest.edges()
    a, b = zip(*stars) if stars else ((), ())
    u, v, r = (np.concatenate(z) for z in zip(*found)) if found else ((), (), ())
    return pa.table({"a": pa.array([*a, *u], pa.int64()), "b": pa.array([*b, *v], pa.int64()), "run": pa.array([None] * len(a) + list(map(int, r)), pa.int32())})


def _pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets with whether they are candidates of the pivot, and of its family."""
    for t in batches:
        own, of = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u4").reshape(-1, SKETCH) for c in ("sketch", "pivot_sketch"))
        agree = (own == of).sum(axis=1)
        keep = t.select(["path", "run", "rep", "sketch", "n", "pivot"])
        yield keep.append_column("near", pa.array(agree >= int(SKETCH * (THRESHOLD - SLACK)))).append_column("family", pa.array(agree >= SKETCH * FAMILY))


def _verify(t):
    """Links of each member of each cell, counted on whole sets, and stars of the links."""
    t = t.combine_chunks()
    comp, ca, cb, chunk, rep = (t[c].to_numpy(zero_copy_only=False) for c in ("component", "cell_a", "cell_b", "chunk", "rep"))
    order = np.lexsort((rep, cb, ca, comp))
    comp, ca, cb, chunk, rep = (x[order] for x in (comp, ca, cb, chunk, rep))
    texts, keys = t["text"], t["key"].to_pylist()
    new = np.flatnonzero(np.r_[True, (comp[1:] != comp[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])]) if len(comp) else []
    shingles = Shingler()
    from xxhash import xxh3_128_digest

    rows: list[tuple] = []
    forest = _Forest()
    for x, y in zip(new, np.r_[new[1:], len(comp)] if len(comp) else []):
        own, at = [], []
        for r in range(x, y):
            s = shingles(texts[int(order[r])].as_py())
            if xxh3_128_digest(s.tobytes()) == keys[order[r]]:  # another text may share id and mark
                own.append(s)
                at.append(r)
        if len(own) < 2:
            continue
        at = np.array(at)
        size = np.array([len(s) for s in own])
        flat = np.concatenate(own)
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        who = np.repeat(np.arange(len(own)), size)
        common = times[code] > 1
        who, code = who[common], code[common]
        o = np.argsort(code, kind="stable")
        who, code = who[o], np.cumsum(np.r_[0, np.diff(code[o]) > 0]) if len(o) else code
        links = np.zeros(len(own), np.int64)
        cols = np.flatnonzero(chunk[at] == cb[x])
        rws = np.flatnonzero(chunk[at] == ca[x])
        both = np.zeros((len(rws), len(cols)), np.float32)
        place_r, place_c = np.full(len(own), -1), np.full(len(own), -1)
        place_r[rws], place_c[cols] = np.arange(len(rws)), np.arange(len(cols))
        n_codes = int(code[-1]) + 1 if len(code) else 0
        for lo in range(0, n_codes, 4096):  # shared shingles in slices, so memory stays bounded
            u, v = np.searchsorted(code, (lo, lo + 4096))
            w, c = who[u:v], code[u:v] - lo
            left, right = np.zeros((len(rws), 4096), np.float32), np.zeros((len(cols), 4096), np.float32)
            left[place_r[w[place_r[w] >= 0]], c[place_r[w] >= 0]] = 1
            right[place_c[w[place_c[w] >= 0]], c[place_c[w] >= 0]] = 1
            both += left @ right.T
        near = both >= THRESHOLD * (size[rws][:, None] + size[cols][None, :] - both) - 1e-6
        i, j = np.nonzero(near)
        i, j = rws[i], cols[j]
        i, j = i[i != j], j[i != j]
        if ca[x] == cb[x]:
            np.add.at(links, i, 1)
        else:
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
        forest.add(rep[at[i]], rep[at[j]])
        rows += [(int(rep[at[m]]), None, int(links[m])) for m in np.flatnonzero(links)]
    rows += [(a, b, 0) for a, b in forest.edges()]
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b", "links"), cols)})


def _batch(reps: DataFrame, roots: range, small: int, share: int = SAMPLED) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
    """Candidate edges of some runs; how often sampled pairs were found (a, b, run); sets that were in large buckets."""
    known = reps.select(F.col("node").alias("rep"), "sketch")
    nodes = _walk(known, roots)
    edges, hits, crowds = [], [], []
    for depth in range(1, DEPTH + 1):
        nodes = materialize(nodes.distinct(), "paths")
        n = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
        met = materialize(nodes.join(n, "path").join(known, "rep"), "buckets")
        now = met.filter(F.col("n") <= small).drop("pivot")
        large = met.filter(F.col("n") > small)
        more = large.limit(1).count() > 0
        if more:
            crowds.append(large.select("rep"))
            pivots = known.select(F.col("rep").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
            large = materialize(large.join(pivots, "pivot").mapInArrow(lean_batches(_pivot), "path long, run int, rep long, sketch binary, n long, pivot long, near boolean, family boolean"), "large")
            edges.append(large.filter("near and pivot <> rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
            large = large.filter("not family").select("path", "run", "rep", "sketch", "n")
            if depth == DEPTH:
                now, more = now.unionByName(large.select(*now.columns)), False
        chunks = F.ceil(F.col("n") / small)
        calls = _calls(now, chunks, F.lit(1), CALL_ROWS)
        cells = _chunked(now, chunks, "rep").groupBy(F.pmod(F.xxhash64("path", "cell_a", "cell_b"), F.lit(calls)).alias("g"))
        found = materialize(cells.applyInArrow(lean(lambda t: _candidates(t, share)), "a long, b long, run int"), "candidates")
        edges.append(found.filter("run is null").select("a", "b"))
        hits.append(found.filter("run is not null"))
        if not more:
            break
        nodes = _walk(large.select("rep", "sketch", "path", "run"))
    return edges, reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, crowds).distinct() if crowds else None


def _times(hits: DataFrame, crowd: DataFrame | None) -> dict[int, int]:
    """How many of the sampled links each number of runs found.

    Members of large buckets are left out: a pivot stands for their pairs, which so meet by chance only.
    """
    if crowd is not None:
        for side in ("a", "b"):
            hits = hits.join(crowd.select(F.col("rep").alias(side)), side, "left_anti")
    times = hits.groupBy("a", "b").agg(F.count_distinct("run").alias("k")).groupBy("k").count()
    return {r["k"]: r["count"] for r in times.collect()}  # a row for each number of runs at most


def _estimate(times: dict[int, int], runs: int) -> float:
    """Share of the links that some run found (the Chao estimate of the unseen)."""
    seen = sum(times.values())
    unseen = (runs - 1) / runs * times.get(1, 0) ** 2 / (2 * max(1, times.get(2, 0)))
    return seen / (seen + unseen) if seen else 1.0


def _recall(hits: DataFrame, crowd: DataFrame | None, runs: int) -> float:
    return _estimate(_times(hits, crowd), runs)


def candidates(reps: DataFrame, runs: int = RUNS, small: int = SMALL, recall: float = RECALL, batches: int = BATCHES) -> tuple[DataFrame, float]:
    """Candidate edges (a, b) of reps (node, sketch), from batches of runs until the recall wanted; and the estimated recall.

    Recall is estimated from a sample of the pairs, or, where that would be a few pairs only,
    from all of them.  An estimate still below `recall` after so many batches is an error.
    """
    edges, hits, crowd = [], None, None
    for batch in range(batches):
        done = (batch + 1) * runs
        more, own, many = _batch(reps, range(done - runs, done), small)
        edges += more
        hits = own if hits is None else hits.unionByName(own)
        crowd = many if crowd is None else crowd if many is None else crowd.unionByName(many)
        times = _times(hits, crowd)
        if sum(times.values()) < LEAST_SAMPLE:  # few links outside large buckets: take them all
            calm = reps if crowd is None else reps.join(crowd.select(F.col("rep").alias("node")), "node", "left_anti")
            times = _times(_batch(calm, range(done), small, 1)[1], None)
        found = _estimate(times, done)
        _log.info("after %d runs the estimated recall is %.5f", done, found)
        if found >= recall:
            return reduce(DataFrame.unionByName, edges), found
    raise RuntimeError(f"after {batches * runs} runs the estimated recall is {found:.4f}, not {recall}: allow more batches")


def _nodes(keyed: DataFrame) -> DataFrame:
    """(key, rep, mark, n_bytes, sketch, node): a row for each distinct set; rep and mark name its first row, node its place in the graph.

    node is rep, but for sets of which several have their least id in common: all but one get a number below all ids.
    """
    first = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "mark", "n_bytes")).alias("least"), F.first("sketch").alias("sketch"))
    reps = materialize(first.select("key", F.col("least.doc_id").alias("rep"), "least.mark", "least.n_bytes", "sketch"), "reps")
    again = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("first_key")).filter("c > 1")
    if not again.limit(1).count():
        return reps.withColumn("node", F.col("rep"))
    other = reps.join(again, "rep", "left").withColumn("node", F.when(F.coalesce(F.col("key") == F.col("first_key"), F.lit(True)), F.col("rep")).otherwise(F.expr("-4611686018427387904 - (xxhash64(key) & 4611686018427387903)")))
    return materialize(other.drop("c", "first_key"), "reps")


def near_duplicates(docs: DataFrame, runs: int = RUNS, small: int = SMALL, chunk_bytes: int = CHUNK_BYTES, rows: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, set_id, class_id, n_links.

    set_id is the least id with the same shingle set, class_id the least id reachable over
    links (pairs of sets with similarity 0.8 or more), n_links the number of other sets
    linked to the row's.  A text of fewer than five words is one shingle; a text without
    words or of null is in a class of its own without links; so is a row with a null id,
    whose class_id is null.  Repeated rows share their class; different texts under one id
    are judged each.  Texts of any length are compared whole; an empty table gives an empty
    result; extra columns are ignored.

    rows adds mark (see row_mark) and first: whether the row is its class's first, by id and mark.
    """
    some = materialize(sets(docs), "sets")
    reps = _nodes(some.filter("doc_id is not null and key is not null"))
    edges, _ = candidates(reps, runs, small)
    groups = connected_components(edges).withColumnRenamed("node", "rep_node")
    members = groups.join(reps.select(F.col("node").alias("rep_node"), "key", "rep", "mark", "n_bytes"), "rep_node").withColumnRenamed("rep_node", "node")
    per = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"))
    members = materialize(members.join(per, "component"), "members")
    chunks = F.greatest(F.ceil(F.col("n") / small), F.ceil(F.col("bytes") / chunk_bytes))
    calls = _calls(members, chunks, F.col("n_bytes") + 64, CALL_BYTES)
    texts = text_bytes(docs.select(F.col("doc_id").cast("long").alias("rep"), row_mark().alias("mark"), "text")).join(members.select("rep", "mark"), ["rep", "mark"], "left_semi").dropDuplicates(["rep", "mark"])
    cells = _chunked(members.join(texts, ["rep", "mark"]).select("component", F.col("node").alias("rep"), "key", "text", "n", "bytes"), chunks, "rep")
    said = materialize(cells.groupBy(F.pmod(F.xxhash64("component", "cell_a", "cell_b"), F.lit(calls)).alias("g")).applyInArrow(lean(_verify), "a long, b long, links long"), "links")
    links = said.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    linked = connected_components(said.filter("b is not null").select("a", "b")).join(reps.select("node", "rep", "mark"), "node")
    classes = linked.join(linked.groupBy("component").agg(F.min(F.struct("rep", "mark")).alias("least")), "component").select("node", "least")
    known = reps.select("key", "node", F.col("rep").alias("set_id"), F.struct("rep", "mark").alias("own")).join(classes, "node", "left").join(links, "node", "left")
    out = some.select("doc_id", "mark", F.expr("if(doc_id is null, null, key)").alias("key")).join(known.drop("node"), "key", "left")
    least = F.coalesce("least", "own")
    cols = ["doc_id", F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce(least["rep"], "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    if rows:
        cols += ["mark", F.coalesce((least["rep"] == F.col("doc_id")) & (least["mark"] == F.col("mark")), F.lit(True)).alias("first")]
    return out.select(*cols)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies, as it is: the first by id and then by a hash of the text.

    Rows with a null id, or without words, are each their own class and stay.  Equal rows
    (id and text) are one: one of them stays.  Columns of any name come along.
    """
    found = near_duplicates(docs, rows=True)
    gone = found.filter("not first").select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    kept = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_gone")) & (row_mark() == F.col("_mark")), "left_anti")
    again = found.filter("first and doc_id is not null").groupBy("doc_id", "mark").count().filter("count > 1").limit(1)
    if not again.count():
        return kept
    whole = kept.filter("doc_id is not null").withColumn("_mark", row_mark()).dropDuplicates(["doc_id", "_mark"]).drop("_mark")
    return whole.unionByName(kept.filter("doc_id is null"))
