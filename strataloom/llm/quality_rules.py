"""Quality rules with thresholds that adapt to language and source.

Method: each ratio of a document (word length, symbols, repeated lines, repeated words)
is summarised by a mergeable quantile sketch for each language and source: counts of bins
whose bounds grow by a fixed factor, so a quantile is known to half that factor, and two
sketches merge by adding counts.  The sketches hold no chance: every run gives the same
fences.  Sketches of a language merge into one for it, those into one for all.  A fence
far outside the middle half of the group's distribution replaces a fixed cutoff; small
groups use the next wider one.  The fences are joined back and the documents outside them
fail.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import materialize

# White space of the rules: space, tab, newline, vertical tab, form feed, carriage return.
_SPACE = r"[ \t-\r]+"
_SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
#: Documents a group needs for fences of its own.
LEAST_GROUP = 200
#: Factor between the bounds of a sketch's bins.
BIN = 1.02
#: How many middle-half widths beyond the middle half a fence stands.
REACH = 3.0
#: Ratio: (least width of the middle half, whether low values fail too).
RATIOS = {"word_length": (0.5, True), "symbol_ratio": (0.02, False), "dup_line_ratio": (0.04, False), "repeat_ratio": (0.04, False)}


def with_counts(docs: DataFrame) -> DataFrame:
    """docs (with text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for s in _SYMBOLS:
        bare = F.replace(bare, F.lit(s))
    x = docs.withColumn("_words", F.array_remove(F.split(text, _SPACE), ""))
    x = x.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda v: v.rlike(r"[^ \t-\r]")))
    x = x.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    x = x.withColumn("n_symbols", (F.length(text) - F.length(bare)).cast("long"))
    x = x.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Hashes of windows of 1, 2, 4 and 8 words, each from two of half the length.
    x = x.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    for n in (1, 2, 4):
        h, size = F.col(f"_h{n}"), F.greatest(F.size(f"_h{n}") - n, F.lit(0))
        x = x.withColumn(f"_h{2 * n}", F.zip_with(F.slice(h, F.lit(1), size), F.slice(h, F.lit(n + 1), size), lambda a, b: F.xxhash64(a, b)))
    repeats = F.size(F.array_distinct("_h8")) < F.size("_h8")
    x = x.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    same = lambda v, j: (F.get(s, j - 1)["h"] == v["h"]) | (F.get(s, j + 1)["h"] == v["h"])
    x = x.withColumn("_at", F.when(s.isNotNull(), F.sort_array(F.transform(F.filter(s, lambda v, j: F.coalesce(same(v, j), F.lit(False))), lambda v: v["i"]))))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + REPEAT_WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + REPEAT_WINDOW).alias("end")), lambda acc: acc["n"],
    )
    x = x.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return x.drop(*(c for c in x.columns if c.startswith("_")))


def _ratios() -> dict[str, Column]:
    n = F.nullif(F.col("n_words").cast("double"), F.lit(0.0))  # without words there is no ratio
    return {"word_length": F.col("word_chars") / n, "symbol_ratio": F.col("n_symbols") / n, "dup_line_ratio": F.col("n_dup_lines") / n, "repeat_ratio": F.col("n_repeat_words") / n}


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bin, n): counts of the rows in each bin of each ratio; bin null holds values of 0."""
    values = F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v")) for r in RATIOS])
    long = counted.select("lang", "source", F.inline(values)).filter("v is not null")
    place = F.when(F.col("v") > 0, F.floor(F.ln("v") / math.log(BIN)))
    return long.groupBy("lang", "source", "ratio", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, ratio, rows, q1, q3) of sketches merged by keys: the middle of the bin in which a quarter and three quarters of the rows are reached."""
    merged = sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "ratio")  # a row a bin: as many as the bins, whatever the rows
    run = merged.withColumn("rows", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(F.pow(F.lit(BIN), F.col("bin") + 0.5))
    q = [F.min(F.when(F.col("upto") >= share * F.col("rows"), value)).alias(name) for name, share in (("q1", 0.25), ("q3", 0.75))]
    return run.groupBy(*keys, "ratio").agg(F.first("rows").alias("rows"), *q)


def fences(counted: DataFrame) -> DataFrame:
    """(lang, source, <ratio>_low, <ratio>_high) from sketches of the rows that pass the base rules."""
    sketch = materialize(sketches(counted), "sketches")
    own = _quartiles(sketch, "lang", "source")
    lang = _quartiles(sketch, "lang").select(F.col("lang").alias("_lang"), F.col("ratio").alias("_ratio"), *[F.col(c).alias(f"lang_{c}") for c in ("rows", "q1", "q3")])
    every = _quartiles(sketch).select(F.col("ratio").alias("_every"), *[F.col(c).alias(f"all_{c}") for c in ("q1", "q3")])
    out = own.join(lang, own["lang"].eqNullSafe(lang["_lang"]) & (own["ratio"] == lang["_ratio"])).join(F.broadcast(every), F.col("ratio") == F.col("_every"))  # a row a ratio
    q1, q3 = (F.when(F.col("rows") >= LEAST_GROUP, F.col(c)).when(F.col("lang_rows") >= LEAST_GROUP, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}")) for c in ("q1", "q3"))
    out = out.select("lang", "source", "ratio", q1.alias("q1"), q3.alias("q3"))
    cols = []
    for r, (least, low) in RATIOS.items():
        mine = F.col("ratio") == r
        width = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        cols += [F.max(F.when(mine, F.col("q1") - width if low else F.lit(float("-inf")))).alias(f"{r}_low"), F.max(F.when(mine, F.col("q3") + width)).alias(f"{r}_high")]
    return out.groupBy("lang", "source").agg(*cols)


def judge_quality(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text, lang, source): doc_id, n_words, the four counts, base_failed, kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows.  kept is
    false then, else whether every ratio is inside its group's fences.  Null text has no
    words and fails; a null language or source is a group like any other; null ids and
    repeated rows are kept as rows; ties in a ratio share a bin; texts of any length are
    counted whole; an empty table gives an empty result; extra columns are ignored.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text").withColumn("base_failed", base)
    counted = materialize(counted, "counts")
    for r, c in _ratios().items():
        counted = counted.withColumn(r, c)
    limits = materialize(fences(counted.filter("not base_failed")), "fences")
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = counted.join(limits, counted["lang"].eqNullSafe(limits["_lang"]) & counted["source"].eqNullSafe(limits["_source"]), "left")
    inside = F.lit(True)
    for r in RATIOS:
        inside = inside & F.coalesce(F.col(r).between(F.col(f"{r}_low"), F.col(f"{r}_high")), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
