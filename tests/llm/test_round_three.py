"""Sharding, spelling variants and the Merkle manifest against brute force, on nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import jaccard_join as jj, merkle as mk, packing as pk, ranks, sharding as sh, spelling as sp, toxicity as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, pos int, word string, n int"


def _texts():
    r = random.Random(11)
    stems = ["statement", "Überraschung", "économie", "reaction", "aaaaaaaa", "étéétéété", "abcabcabc"]
    out = []
    for i in range(60):
        words = []
        for _ in range(r.randint(0, 60)):
            w = r.choice(stems)
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = [w[:k] + w[k + 1 :], w[:k] + r.choice("aexé") + w[k:], w[:k] + r.choice("aexé") + w[k + 1 :]][r.randrange(3)]
            words.append(w)
        out.append(r.choice([" ", "\n", "-", "1"]).join(words))
    return out + [out[3], out[3], None, "", "", "×÷" * 5 + " " + "ÿ" * 9, "z" * 30_000, "z" * 30_001, "z" * 30_000 + " " + "z" * 30_001, "no\nnew\n\nline\n"]


@pytest.fixture(scope="module")
def rows():
    t = [(i * 7 % 83, x, f"s{i % 5}" if i % 9 else None) for i, x in enumerate(_texts())]
    return t + [t[5], t[5], (None, t[3][1], "s1"), (None, None, None), (4, "alone", "only")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else None, s, 1, 1, 1, "r", 1) for d, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Ranks


def test_positions_are_gapless_in_groups_of_any_size(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("x"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 < 9, None).otherwise("c").alias("g")).repartition(5)
    got = ranks.ranked(df, ["g"], ["x"], range_rows=300).collect()
    for g in ("hot", None, "c"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["pos"])
        assert [r["pos"] for r in own] == list(range(len(own)))
        assert [r["x"] for r in own] == sorted(r["x"] for r in own)
        assert {r["n_rows"] for r in own} == {len(own)}


# Sharding


def _differencing(sizes, k):
    """The textbook form: partial partitions as lists of sets."""
    parts = [(s, -i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    made = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[0], p[1]), reverse=True)
        (_, _, a), (_, _, b), *rest = parts
        c = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        c.sort(key=lambda x: x[0], reverse=True)
        parts = [*rest, (c[0][0] - c[-1][0], -made, c)]
        made += 1
    return [s for s, _ in parts[0][2]]


@pytest.mark.parametrize("k", [2, 3, 8])
def test_differencing_follows_the_textbook(k):
    r = random.Random(k)
    for sizes in ([5], [8, 7, 6, 5, 4], [1] * 17, [r.randint(1, 10**6) for _ in range(300)], [10**9] + [r.randint(1, 1000) for _ in range(50)]):
        at = sh.differencing(sizes, k)
        sums = [sum(s for s, p in zip(sizes, at) if p == i) for i in range(k)]
        assert sorted(sums, reverse=True) == _differencing(sizes, k)
    assert sh.differencing([], k) == []


def test_differencing_beats_largest_first():
    r = np.random.default_rng(3)
    sizes = np.sort(r.lognormal(8, 1.5, 20_000).astype(np.int64))[::-1]
    ours = sh.spread(sizes, np.array(sh.differencing(sizes.tolist(), 8)), 8)
    sums = np.zeros(8, np.int64)
    for s in sizes:
        sums[sums.argmin()] += s
    assert ours <= 1 and ours <= sums.max() - sums.min()


def test_shards_keep_groups_and_balance(docs, rows, none):
    got = sh.assign_shards(docs, bundles=16).collect()  # few bundles: both kinds of items occur
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert all(len({r.shard for r in got if (r["size"], r.text_crc32) == k}) == 1 for k in {(r["size"], r.text_crc32) for r in got})
    for k in range(8):
        own = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [(r.doc_id is not None, r.doc_id or 0) for r in own] == sorted((r.doc_id is not None, r.doc_id or 0) for r in own)
    assert sh.assign_shards(none).count() == 0


def test_shards_are_near_equal_although_one_group_is_large(spark):
    r = random.Random(5)
    docs = [(i, "copy of a text " * 20) for i in range(300)] + [(i, "x" * r.randint(1, 4000) + str(i)) for i in range(300, 2500)]
    got = sh.assign_shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shards=4, bundles=512).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 64 and got[got.doc_id < 300].shard.nunique() == 1


def test_written_shards_hold_every_column(spark, docs, tmp_path):
    with pytest.raises(ValueError, match="another name"):
        sh.write_shards(docs, f"{tmp_path}/no")
    sh.write_shards(docs, f"{tmp_path}/out", name="part_of", bundles=16)
    back = spark.read.parquet(f"{tmp_path}/out")
    key = lambda df: sorted(map(repr, df.select(docs.columns).collect()))
    assert key(back) == key(docs)
    assert back.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("part_of").alias("c")).filter("c > 1").count() == 0


# Spelling


def _words(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def _is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))) if len(b) < 100 else len(b) == len(a) + 1 and set(a) == set(b) and len(set(a)) == 1


def _variants(rows):
    count = _words(rows)
    near = {w: [v for v in count if v != w and abs(len(v) - len(w)) < 2 and _is_near(v, w)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, count[w], len(near[w]), count.get(form[w])


def test_variants_equal_brute_force(docs, rows, none):
    want = sorted(_variants(rows))
    got = sorted(map(tuple, sp.spelling_variants(docs).collect()))
    assert got == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(len(w) == 30_000 for w, *_ in want)
    assert sp.spelling_variants(none).count() == 0


def test_forms_are_followed_to_the_last(spark):
    text = " ".join(["colouring"] * 500 + ["colourinx"] * 40 + ["colourixx"] * 3 + ["zolouring"] * 60)
    docs = spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string")
    got = {r.word: r for r in sp.spelling_variants(docs).collect()}
    assert got["colourixx"].root == "colouring" and got["colourixx"].form == "colourinx"
    assert got["zolouring"].form is None and got["zolouring"].root == "zolouring"  # 5,000 < 10 * 600
    assert sorted(map(tuple, got.values())) == sorted(_variants([(i, text) for i in range(10)]))


def test_keys_are_hashes_of_the_remainders():
    words = ["aabbccdd", "abbccdd", "é" * 9, "x" * 3000, "bcdefgh"]
    row, place, first, key = sp.deletion_keys(words)
    rest = [w if p < 0 else w[:p] + w[p + 1 :] for w, p in ((words[r], p) for r, p in zip(row, place))]
    by = {}
    for k, t in zip(key.tolist(), rest):
        by.setdefault(t, set()).add(k)
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)
    assert all(f == (p <= 0 or words[r][p] != words[r][p - 1]) for r, p, f in zip(row, place, first))


def test_colliding_keys_are_told_apart_by_their_strings(spark):
    docs = [(i, " ".join(["bananas", "bananax", "bandanas", "oranges", "orange", "apricots", "apricot", "melonen"] * 2)) for i in range(9)]
    words = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(sorted(_words(docs).items()))], "id long, word string, n long")
    got = {r["word"]: r["n_near"] for r in words.join(sp._near(words, bits=2), "id", "left").collect()}
    assert {w: n or 0 for w, n in got.items()} == {w: k for w, _, _, _, k, _ in _variants(docs)}


# Merkle


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def _climb(nodes):
    """Root, and for each node its siblings and (place, run) level by level."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for k, below in enumerate(own[i : i + 3]):
                for x in below:
                    paths[x].append((k, run[:k], run[k + 1 :]))
            up.append(H(*run))
            held.append([x for b in own[i : i + 3] for x in b])
        nodes, own = up, held
    return nodes[0], paths


def _audit(full):
    """Rows of the query, by brute force; full: rows with all columns."""
    src = lambda r: (r[3] is not None, (r[3] or "").encode())
    ordered = sorted(full, key=lambda r: (src(r), r[0] is not None, r[0] or 0, _leaf(r, r[1])))
    trees = [list(g) for _, g in groupby(ordered, key=src)]
    tops = [_climb([_leaf(r, r[1]) for r in t]) for t in trees]
    root, upper = _climb([t[0] for t in tops])
    for t, (subroot, paths), up in zip(trees, tops, upper):
        for r, path in zip(t, paths):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node, proof = _leaf(r, text), ""
            for _, left, right in path + up:
                node, proof = H(*left, node, *right), proof + "".join(left + right)
            yield r[0], _leaf(r, r[1]), subroot, root, H(proof), node, node == root


def _same(got, want):
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_audit_equals_brute_force(docs, none, levels):  # with few levels, trees of several storeys
    full = [tuple(r) for r in docs.collect()]
    got = mk.tamper_audit(docs, levels).collect()
    _same(got, list(_audit(full)))
    assert {r.verified for r in got} == {True, False}
    assert mk.tamper_audit(none, levels).count() == 0
    assert {(r.subroot, r.root) for r in mk.manifest(docs, levels).collect()} == {(r.subroot, r.root) for r in got}


def test_many_sources_and_one_row(spark):
    for n in (1, 2, 40):
        docs = spark.createDataFrame([(i, f"t{i}\n", "en", f"s{i}", 1) for i in range(n)], SCHEMA.split(", shard")[0])
        _same(mk.tamper_audit(docs).collect(), list(_audit([tuple(r) for r in docs.collect()])))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82, 700])
def test_traversal_gives_every_path(n):
    leaves = [H(str(i)).encode() for i in range(n)]
    root, paths = _climb([x.decode() for x in leaves])
    t = mk.Traversal(leaves, mk.height(n, 8))
    assert t.root.decode() == root
    for x, path, (turns, siblings) in zip(leaves, paths, t):
        assert [s.decode() for s in siblings] == [s for _, left, right in path for s in left + right]
        assert mk.fold(x, turns, b"".join(siblings)).decode() == root


def test_stacks_stay_logarithmic_and_in_time():
    for levels in (4, 6, 7):
        t = mk.Traversal([H(str(i)).encode() for i in range(3**levels)], levels)
        for _ in t:
            pass
        assert t.most <= 5 * levels and t.late == 0


# Recall of the join, and few labels


def _near_pairs(n, r):
    for i in range(n):
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
        yield 2 * i, " ".join(w)
        w[r.randrange(60)] = "changed"
        yield 2 * i + 1, " ".join(w)


def test_recall_follows_its_formula(spark):
    rows = [(a, a + 1, run) for a, runs in ((1, 3), (10, 1), (20, 1), (30, 2), (40, 1)) for run in range(runs)]
    hits = spark.createDataFrame(rows, "a long, b long, run int")
    f1, f2, seen, runs = 3, 1, 5, 8
    assert jj._recall(hits, None, runs) == pytest.approx(seen / (seen + (runs - 1) / runs * f1**2 / (2 * f2)))
    crowd = spark.createDataFrame([(10,), (21,)], "rep long")
    assert jj._recall(hits, crowd, runs) == pytest.approx(3 / (3 + 7 / 8 * 1 / 2))


def test_few_links_are_all_counted_and_missed_recall_is_an_error(spark, monkeypatch):
    r = random.Random(6)
    docs = spark.createDataFrame(list(_near_pairs(40, r)), "doc_id long, text string")
    reps = jj._nodes(jj.sets(docs))
    _, every, _ = jj._batch(reps, range(8), jj.SMALL, 1)
    assert every.select("a", "b").distinct().count() > jj._batch(reps, range(8), jj.SMALL)[1].select("a", "b").distinct().count()
    edges, found = jj.candidates(reps)
    assert found >= jj.RECALL and edges.distinct().count() >= 40
    with pytest.raises(RuntimeError, match="allow more batches"):
        jj.candidates(reps, runs=1, recall=1.1, batches=2)
    seen = []
    monkeypatch.setattr(jj, "_estimate", lambda times, runs: seen.append(runs) or (1.0 if len(seen) > 2 else 0.5))
    jj.candidates(reps, runs=2)
    assert seen == [2, 4, 6]  # goes on until it is reached


def test_toxicity_with_hardly_any_labels(spark):
    docs = [(i, "you are an idiot" if i % 3 == 0 else f"a fine day number {i}") for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    learned = [i for i in range(12) if zlib.crc32(str(i).encode()) % 5]
    inside = [i for i in learned if zlib.crc32(str(i).encode(), 9) % 2 == 0]  # lexicons are found on these
    for ids in ([], learned[:1], inside[:1], inside[:2], inside[:3], learned):
        labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids], "doc_id long, toxic int")
        for some in (frame, frame.filter(F.col("doc_id").isin(ids))):
            got = tx.score_toxicity(some, labels).collect()
            assert len(got) == some.count() and all(0 <= x.score <= 1 for x in got)
            assert tx.keep_clean(some, labels).columns == some.columns


# Packing


@pytest.mark.parametrize("draw", ["lognormal", "equal", "halves", "thirds", "short"])
def test_a_mix_is_never_dearer_than_one_length(draw):
    r = np.random.default_rng(7)
    lengths = {
        "lognormal": lambda: np.minimum(r.lognormal(6.5, 1.2, 3000).astype(np.int64) + 1, 32768), "equal": lambda: np.full(2000, 1100), "halves": lambda: r.integers(1400, 2048, 2000),
        "thirds": lambda: r.integers(2500, 3500, 1500), "short": lambda: r.integers(1, 60, 4000),
    }[draw]()
    lengths = np.sort(lengths)[::-1]
    price = lambda found: sum(map(pk.bin_cost, found[2]))
    mixed = pk.pack(lengths)
    for c in pk.CAPACITIES:
        if c >= lengths[0]:
            assert price(mixed) <= price(pk.pack(lengths, (c,)))
    held = np.bincount(mixed[0], weights=lengths)
    assert (held <= mixed[2]).all() and set(mixed[2]) <= set(pk.CAPACITIES)
    assert pk.pack(np.zeros(0, np.int64)) == ([], [], [])
