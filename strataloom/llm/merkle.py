"""A Merkle manifest of a dataset: a digest of every row, a tree for each source, a root over the sources, proofs of inclusion.

Method: Merkle traversal scheduling.  The leaves of a source are cut into aligned blocks of
3**LEVELS.  In a block, a traversal goes leaf by leaf and keeps only the current run of each
level; a treehash stack for each level builds the run that comes next, and each step gives
the stacks a fixed number of leaves, the stack with the lowest open node first, so that all
stacks together stay logarithmic.  The block's root is a leaf of the tree above, which is
traversed in the same way; its path is appended to the path of every leaf of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._util import lean, lean_batches, materialize
from .ranks import ranked

#: Nodes of a run, and levels of a block: a task holds about a block of 3**8 leaves.
RUN, LEVELS = 3, 8

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def join_nodes(nodes: list[bytes]) -> bytes:
    """Digest of a run; digests are hex text."""
    return sha256(b"".join(nodes)).hexdigest().encode()


def height(n: int, most: int) -> int:
    """Levels above n nodes, at most so many."""
    h = 0
    while n > 1 and h < most:
        n, h = -(-n // RUN), h + 1
    return h


class Treehash:
    """The nodes of one level over leaves start to end, built from a stack that takes a leaf at a time."""

    def __init__(self, level: int, start: int, end: int):
        self.level, self.at, self.end = level, start, end
        self.stack: list[tuple[int, bytes]] = []

    def low(self) -> int:
        """Height of the lowest open node; a large number once done."""
        return 99 if self.at >= self.end else self.stack[-1][0] if self.stack else self.level

    def _merge(self, least: int) -> None:
        """Replace the last nodes of equal height, at least so many, by their digest, as long as they are below the level."""
        stack = self.stack
        while stack and (h := stack[-1][0]) < self.level:
            i = len(stack)
            while i and stack[i - 1][0] == h:
                i -= 1
            if len(stack) - i < least:
                return
            stack[i:] = [(h + 1, join_nodes([x for _, x in stack[i:]]))]

    def take(self, leaves: list[bytes]) -> None:
        self.stack.append((0, leaves[self.at]))
        self.at += 1
        if self.level:
            self._merge(RUN)
            if self.at == self.end:
                self._merge(1)  # the last run may be shorter


class Traversal:
    """Paths of a block's leaves, in order.

    root: of the block, after `levels` levels.  most: the most nodes that all stacks held at
    once; late: how often a run was due before its stack was done and had to be finished on the spot.
    """

    def __init__(self, leaves: list[bytes], levels: int):
        self.leaves, self.levels, self.most, self.late = leaves, levels, 0, 0
        self.runs: list[list[bytes]] = []
        row = leaves
        for _ in range(levels):  # the first run of every level
            self.runs.append(row[:RUN])
            row = [join_nodes(row[i : i + RUN]) for i in range(0, len(row), RUN)]
        self.root = row[0]
        self.next = [self._stack(j, 1) for j in range(levels)]

    def _stack(self, level: int, run: int) -> Treehash:
        wide = RUN ** (level + 1)
        n = len(self.leaves)
        return Treehash(level, min(n, run * wide), min(n, (run + 1) * wide))

    def __iter__(self) -> Iterator[tuple[bytes, list[bytes]]]:
        """(turns, siblings) of each leaf: for every level, RUN times its place in the run and the number of siblings; the siblings of all levels, left to right."""
        leaves, levels, stacks = self.leaves, self.levels, self.next
        places = [0] * levels
        for i in range(len(leaves)):
            turns, siblings = bytearray(levels), []
            for j in range(levels):
                p, run = places[j], self.runs[j]
                turns[j] = RUN * p + len(run) - 1
                siblings += run[:p]
                siblings += run[p + 1 :]
            yield bytes(turns), siblings
            for _ in range(levels):
                s = min(stacks, key=Treehash.low)
                if s.at >= s.end:
                    break
                s.take(leaves)
            self.most = max(self.most, sum(len(s.stack) for s in stacks))
            for j in range(levels):  # on to the next leaf
                if (i + 1) % RUN**j:
                    break
                places[j] += 1
                if places[j] == RUN:
                    places[j] = 0
                    self.late += stacks[j].at < stacks[j].end
                    while stacks[j].at < stacks[j].end:
                        stacks[j].take(leaves)
                    self.runs[j] = [x for _, x in stacks[j].stack]
                    stacks[j] = self._stack(j, (i + 1) // RUN ** (j + 1) + 1)


def fold(leaf: bytes, turns: bytes, siblings: bytes) -> bytes:
    """Root that a leaf and its path give; leaf, siblings (one after the other) and root as hex text."""
    at = 0
    for turn in turns:
        place, n = divmod(turn, RUN)
        cut, end = at + 64 * place, at + 64 * n
        leaf, at = sha256(siblings[at:cut] + leaf + siblings[cut:end]).hexdigest().encode(), end
    return leaf


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row's fields, 32 bytes: each field as its UTF-8 byte count, a colon and its value; a hyphen where null."""
    fields = [F.col(c).cast("string") for c in FIELDS]
    if text is not None:
        fields[-1] = text
    one = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in fields]
    return F.unhex(F.sha2(F.concat(*one).cast("binary"), 256))


def _blocks(t: pa.Table, wide: int) -> Iterator[tuple[str | None, int, int, list[bytes], pa.Table]]:
    """(tree, block, nodes of its tree, digests in hex, rows) of each block of a group."""
    t = t.sort_by([("tree", "ascending"), ("pos", "ascending")])
    keys = list(zip(t["tree"].to_pylist(), (x // wide for x in t["pos"].to_pylist())))
    sizes, i = t["n"], 0
    for j in range(1, len(keys) + 1):
        if j == len(keys) or keys[j] != keys[i]:
            rows = t.slice(i, j - i)
            yield *keys[i], sizes[i].as_py(), [x.hex().encode() for x in rows["digest"].to_pylist()], rows
            i = j


def _bucketed(nodes: DataFrame, block: Column, parts: int) -> DataFrame:
    return nodes.groupBy(F.pmod(F.xxhash64("tree", block), F.lit(parts)))


def _parts(nodes: DataFrame, levels: int) -> int:
    return max(1, -(-nodes.count() // RUN**levels))


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """Roots of the blocks as nodes of the trees above: (tree, pos, n, digest)."""
    wide = RUN**levels

    def step(t: pa.Table) -> pa.Table:
        rows = []
        for tree, block, n, leaves, _ in _blocks(t, wide):
            one = Treehash(height(n, levels), 0, len(leaves))
            for _ in leaves:
                one.take(leaves)
            (_, root), = one.stack
            rows.append((tree, block, -(-n // wide), bytes.fromhex(root.decode())))
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate((("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())))})

    return materialize(_bucketed(nodes, F.expr(f"pos div {wide}"), _parts(nodes, levels)).applyInArrow(lean(step), "tree string, pos long, n long, digest binary"), "tops")


def _paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """nodes with turns, siblings and the columns top, which above has for each block (tree, pos, turns, siblings, top)."""
    parts, wide = _parts(nodes, levels), RUN**levels
    kept = [f for f in nodes.schema.fields if f.name not in ("tree", "pos", "n")]
    names = [f.name for f in kept]
    tops = [f for f in above.schema.fields if f.name not in ("tree", "pos", "turns", "siblings")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [nodes.schema["tree"], nodes.schema["pos"], *kept, *tops]) + ", turns binary, siblings binary"

    def step(t: pa.Table, up: pa.Table) -> pa.Table:
        upper = {(r["tree"], r["pos"]): r for r in up.to_pylist()}
        out = []
        for tree, block, n, leaves, rows in _blocks(t, wide):
            more = upper[tree, block]
            turns, siblings = [], []
            for x, y in Traversal(leaves, height(n, levels)):
                turns.append(x + more["turns"])
                siblings.append(bytes.fromhex(b"".join(y).decode()) + more["siblings"])
            one = rows.select(["tree", "pos", *names])
            for f in tops:
                one = one.append_column(f.name, pa.array([more[f.name]] * len(leaves), up.schema.field(f.name).type))
            out.append(one.append_column("turns", pa.array(turns, pa.binary())).append_column("siblings", pa.array(siblings, pa.binary())))
        return pa.concat_tables(out)

    block = F.expr(f"pos div {wide}")
    return _bucketed(nodes, block, parts).cogroup(_bucketed(above, F.col("pos"), parts)).applyInArrow(lean(step), schema)


def _above(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, turns, siblings, top) of each block of the trees: its path to the tree's root, and the root."""
    tops = _tops(nodes, levels)
    if (tops.agg(F.max("n")).first()[0] or 1) > 1:
        return materialize(_paths(tops, _above(tops, levels), levels).drop("digest"), "paths")
    return tops.select("tree", "pos", F.lit(b"").alias("turns"), F.lit(b"").alias("siblings"), F.col("digest").alias("top"))


def _sources(above: DataFrame, levels: int) -> DataFrame:
    """(source, up_turns, up_siblings, root) of each source: the path of its subroot, and the root over all; above: _above() of the sources' leaves."""
    some = materialize(above.filter("pos = 0").select(F.col("tree").alias("source"), F.col("top").alias("digest")), "subroots")
    nodes = materialize(ranked(some, [], ["source"]).select(F.lit(None).cast("string").alias("tree"), "pos", F.col("n_rows").alias("n"), "digest", "source"), "nodes")
    return _paths(nodes, _above(nodes, levels), levels).select("source", F.col("turns").alias("up_turns"), F.col("siblings").alias("up_siblings"), F.col("top").alias("root"))


def _leaves(docs: DataFrame, carry: dict[str, Column]) -> DataFrame:
    rows = docs.select("doc_id", F.col("source").cast("string").alias("tree"), leaf_digest().alias("digest"), *(c.alias(k) for k, c in carry.items()))
    rows = ranked(materialize(rows, "leaves"), ["tree"], ["doc_id", "digest"]).withColumnRenamed("n_rows", "n")
    return materialize(rows, "nodes")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(source, n_rows, subroot, root) of docs (doc_id, source, lang, n_chars, text); digests in hex.  An empty table gives none."""
    nodes = _leaves(docs, {})
    above = _above(nodes, levels)
    size = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n_rows"))
    some = above.filter("pos = 0").join(size.withColumnRenamed("tree", "_t"), F.col("tree").eqNullSafe(F.col("_t"))).join(_sources(above, levels), F.col("tree").eqNullSafe(F.col("source")))
    return some.select("source", "n_rows", F.lower(F.hex("top")).alias("subroot"), F.lower(F.hex("root")).alias("root"))


def inclusion_proofs(docs: DataFrame, carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """A row for each row of docs (doc_id, source, lang, n_chars, text): doc_id, source, leaf, subroot, root, turns, siblings; digests as bytes.

    Leaves of a source ascend by doc_id (null first; rows of one id by digest), sources by
    name (null first).  turns: a byte for each level, three times the place in the run and
    the number of siblings; siblings: their digests, from the leaf's level up to the root's.
    A source of one row has its leaf as subroot, a table of one source the subroot as root.
    carry: further columns made of docs'.  Rows equal in all fields have equal leaves but
    paths of their own.  An empty table gives an empty result.
    """
    carry = carry or {}
    nodes = _leaves(docs, carry)
    above = _above(nodes, levels)
    up = _sources(above, levels)
    above = above.join(up, F.col("tree").eqNullSafe(F.col("source"))).select(
        "tree", "pos", F.concat("turns", "up_turns").alias("turns"), F.concat("siblings", "up_siblings").alias("siblings"), F.col("top").alias("subroot"), "root"
    )
    out = _paths(nodes, materialize(above, "above"), levels)
    return out.select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "subroot", "root", "turns", "siblings", *carry)


def check_proofs(proofs: DataFrame) -> DataFrame:
    """Fold the digests found with the proofs' paths; proofs: inclusion_proofs() with a further column found (32 bytes).

    Returns doc_id, leaf, subroot, root, proof_sha256 (digest of the siblings as hex text),
    folded_root and verified, digests as lowercase hex.
    """
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, subroot, root = ([x.hex() for x in b.column(c).to_pylist()] for c in names[:3])
            siblings = [x.hex().encode() for x in b.column("siblings").to_pylist()]
            folded = [fold(x.hex().encode(), y, z).decode() for x, y, z in zip(b.column("found").to_pylist(), b.column("turns").to_pylist(), siblings)]
            columns = [leaf, subroot, root, [sha256(x).hexdigest() for x in siblings], folded, [x == y for x, y in zip(folded, root)]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns)], ["doc_id", *names, "verified"])

    kind = proofs.schema["doc_id"].dataType.simpleString()
    return proofs.mapInArrow(lean_batches(step), f"doc_id {kind}, {', '.join(f'{c} string' for c in names)}, verified boolean")


def newlines_deleted() -> Column:
    """Digest of the row as found after tampering: where 2 divides the crc32 of the decimal doc_id, the text has lost its newlines.

    A null text, a text without newlines and a row without an id stay as they are.
    """
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return F.when(hit, leaf_digest(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf_digest())


def tamper_audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """check_proofs() of every row of docs after newlines_deleted()."""
    return check_proofs(inclusion_proofs(docs, {"found": newlines_deleted()}, levels))
