"""Spelling variants: words that differ by one code point, and the frequent form of each.

Method: rolling-hash deletions.  Prefix and suffix sums of a polynomial hash give, for every
word and place, the 64-bit hash of the word without the code point there, in whole NumPy
arrays.  These keys and the words' own go to tasks by their leading digits (radix) and are
sorted there; only keys that meet another one are kept.  For those the strings themselves
are compared: words of equal remainder and place differ by a replaced code point, a word
that equals another's remainder by a deleted one.

A remainder and a place are shared by no more words than the alphabet has letters, and a
word is the remainder of at most that many for each place, so no group grows with the
corpus.  In a group each word gets the number of the others and the most frequent of them,
not a row for every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import lean, lean_batches, materialize

#: Code points of a run: Latin letters up to U+00FF, with the two signs between them.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many (document, run) loses a code point.
SPOILED = 31
#: Keys that one task sorts, about.
RADIX_KEYS = 1 << 18

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): distinct spoiled runs of docs (doc_id, text) of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    Null texts have no runs; a null id counts as an empty one.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))  # a shorter run has no word
    some = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", upper, upper.lower()))
    some = some.select(low.alias("run"), F.crc32(F.concat("id", F.lit(":"), low).cast("binary")).alias("h"))
    some = some.select(F.when(F.col("h") % SPOILED == 0, without("run", F.col("h") % F.length("run"))).otherwise(F.col("run")).alias("word"))
    return some.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def without(word: str, place: Column) -> Column:
    """word without the code point at a place (from 0)."""
    at = place.cast("int")
    return F.concat(F.substr(F.col(word), F.lit(1), at), F.substr(F.col(word), at + 2))


def _mixed(keys: np.ndarray) -> np.ndarray:
    """keys with every bit dependent on all."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, first, key) of each word's own key (place -1) and of its deletions.

    first: no equal code point stands before the place; deletions elsewhere in a stretch of
    equal code points leave the same string.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    length = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(length)
    row = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(points)) - np.repeat(end - length, length)
    powers = np.cumprod(np.full(int(length.max(initial=0)), _BASE, np.uint64))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * powers[place])])  # wraps around
    start = upto[end - length]
    own = upto[end] - start
    cut = (upto[:-1] - start[row]) + (upto[end][row] - upto[1:]) * _BACK  # prefix, and suffix moved down by one
    salt = np.uint64(0xD6E8FEB86659FD93)
    own, cut = _mixed(own + length.astype(np.uint64) * salt), _mixed(cut + (length[row] - 1).astype(np.uint64) * salt)
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    return np.concatenate([np.arange(len(words)), row]), np.concatenate([np.full(len(words), -1), place]), np.concatenate([np.ones(len(words), bool), first]), np.concatenate([own, cut])


def meeting(key: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, alike, apart) of the keys that meet others: at the same place, or a word's own key with first deletions."""
    order = np.lexsort((place, key))
    key, place, first = key[order], place[order], first[order]
    n = len(key)
    if not n:
        return order, np.zeros(0, bool), np.zeros(0, bool)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    run = np.cumsum(new) - 1
    cell = np.cumsum(new | np.concatenate([[True], place[1:] != place[:-1]])) - 1
    alike = (place >= 0) & (np.bincount(cell)[cell] > 1)
    is_own = place < 0
    met = (np.bincount(run, weights=is_own) > 0) & (np.bincount(run, weights=first & ~is_own) > 0)
    apart = met[run] & first
    keep = alike | apart
    return order[keep], alike[keep], apart[keep]


def _near(words: DataFrame, bits: int = 64) -> DataFrame:
    """(id, n_near, best): words near others, best: struct(-n, word) of the most frequent; words: (id, word, n).

    bits: how many leading bits of the keys are used; the result is the same for any number.
    """
    used = np.uint64((1 << 64) - (1 << (64 - bits)))
    keys = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(1, -(-int(keys) // RADIX_KEYS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, place, first, key = deletion_keys(b.column("word").to_pylist())
            key &= used
            radix = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            yield pa.RecordBatch.from_pydict({
                "radix": pa.array(radix.astype(np.int32)), "key": pa.array(key.view(np.int64)), "id": b.column("id").take(pa.array(row)), "place": pa.array(place.astype(np.int32)), "first": pa.array(first),
            })

    def meet(t: pa.Table) -> pa.Table:
        at, alike, apart = meeting(t["key"].to_numpy().view(np.uint64), t["place"].to_numpy(), t["first"].to_numpy(zero_copy_only=False))
        return t.select(["id", "place"]).take(pa.array(at)).append_column("alike", pa.array(alike)).append_column("apart", pa.array(apart))

    keyed = words.select("id", "word").mapInArrow(lean_batches(emit), "radix int, key long, id long, place int, first boolean")
    met = materialize(keyed.groupBy("radix").applyInArrow(lean(meet), "id long, place int, alike boolean, apart boolean"), "met")
    rest = F.when(F.col("place") < 0, F.col("word")).otherwise(without("word", F.col("place")))
    some = met.join(words, "id").withColumn("rest", rest).withColumn("self", F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))).select("id", "rest", "place", "alike", "apart", "self").repartition("rest")
    # Replaced: all words of a remainder and place are near one another.
    cell = Window.partitionBy("rest", "place")
    line = cell.orderBy("self")
    other = F.when(F.row_number().over(line) == 1, F.lead("self").over(line)).otherwise(F.first("self").over(line))
    swapped = some.filter("alike").select("id", (F.count(F.lit(1)).over(cell) - 1).alias("c"), other.alias("best"))
    # Deleted: the word that is the remainder comes first, if there is one.
    cell = Window.partitionBy("rest")
    line = cell.orderBy(F.col("place") >= 0, "self")
    owned, own = F.first("place").over(line) < 0, F.col("place") < 0
    dropped = some.filter("apart").select(
        "id", F.when(own, F.count(F.lit(1)).over(cell) - 1).when(owned, 1).otherwise(0).alias("c"), F.when(own, F.lead("self").over(line)).when(owned, F.first("self").over(line)).alias("best")
    )
    return swapped.unionByName(dropped).filter("c > 0").groupBy("id").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): the last form of each word of links (word, form).

    Each round doubles the forms followed; a form has ten times the occurrences of its word, so a few rounds do.
    """
    now = materialize(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.filter("moved").limit(1).count():
        hop = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(hop, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """A row for each word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Words are those of vocabulary().  n_near: words that differ by exactly one inserted,
    deleted or replaced code point.  form: the most frequent of these (ties: the smallest in
    code-point order), if it has at least RATIO times the occurrences, with its count form_n;
    else null.  root: where the forms end; the word itself if it has none.  Words of any
    length are compared whole.  An empty table, or one of null and short texts, gives an
    empty result; repeated rows count as often as they stand there; extra columns are ignored.
    """
    words = materialize(vocabulary(docs).withColumn("id", F.monotonically_increasing_id()), "words")
    found = words.join(_near(words), "id", "left")
    formed = -F.col("best.less") >= RATIO * F.col("n")
    found = materialize(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
    ), "forms")
    roots = _roots(found.filter("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
