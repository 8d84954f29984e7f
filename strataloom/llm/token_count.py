"""Token counts without token ids.

Method: a text falls into pre-tokens that no piece of the vocabulary crosses, so its
count is the sum over its pre-tokens.  Each distinct pre-token of the corpus is encoded
once; documents keep only how often each occurs.  The join on pre-tokens runs packed:
every run of documents sends its distinct pre-tokens to hash buckets (each once, however
frequent), a bucket encodes each distinct one and answers every run with the counts.
Messages between runs and buckets go over a grid (exchange.py).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._util import RUN_BYTES, lean, planes, run_count, text_bytes, unplanes
from .exchange import MESSAGE, deliver, letters, pack, received, unpack, width

MARK = "▁"  # stands for a space in this vocabulary
_UNITS = re.compile(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text: a newline or the spaces before a word, with that word.

    A word with a single space before it is given bare; others begin with the newline or
    with the spaces as marks.  The text gets the vocabulary's leading space.
    """
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " " or " \n" in text:
        units = _UNITS.findall(MARK + text.replace(" ", MARK))
        return [u[1:] if u[0] == MARK and len(u) > 1 and u[1] != MARK else u for u in units]
    if text[0] == "\n":
        return [MARK, *text.replace("\n", " \n").split(" ")[1:]]
    return text.replace("\n", " \n").split(" ")


_ENCODERS: dict = {}


def encoder(model: str):
    """Counts of pieces of pre-tokens; a Python worker loads the model once."""
    if model not in _ENCODERS:
        _ENCODERS[model] = _encoder(model)
    return _ENCODERS[model]


def _encoder(model: str):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    inside = [p for p in map(sp.id_to_piece, range(len(sp))) if re.search(f"[^{MARK}]{MARK}|\n", p) or re.match(f"{MARK}{MARK}+[^{MARK}]", p)]
    if inside:
        raise ValueError(f"pieces of this vocabulary cross pre-tokens: {inside[:5]}")

    def counts(units: list[str]) -> list[int]:
        texts, less = [], []
        for u in units:
            if u[0] == MARK:
                texts.append(u[1:].replace(MARK, " "))
                less.append(-1 if len(u) == 1 else 0)
            else:
                texts.append(u)
                less.append(1 if u[0] == "\n" else 0)
        return [len(x) - y for x, y in zip(sp.encode(texts, num_threads=1), less)]

    return counts


def _often(t: pa.Table) -> list[Counter]:
    """How often each pre-token occurs in each text."""
    return [Counter(pre_tokens(x.as_py().decode("utf-8", "replace"))) for x in t["text"]]


def _vocabulary(often: list[Counter], nb: int) -> dict[int, list[bytes]]:
    """Distinct pre-tokens of a run, sorted, by bucket."""
    by: dict[int, list[bytes]] = {}
    for u in set().union(*often):
        raw = u.encode("utf-8", "surrogatepass")
        by.setdefault(zlib.crc32(raw) % nb, []).append(raw)
    return {b: sorted(x) for b, x in by.items()}


def _send(nb: int, wide: int):
    def run(key, t):
        out = []
        for b, words in _vocabulary(_often(t), nb).items():
            raw = b"".join(words)
            sizes = planes(np.array([len(w) for w in words], np.uint32))
            out.append((b, pack([(len(sizes), sizes), (len(raw), pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")])))
        return letters(key[0].as_py(), out, wide)

    return run


def _answer(model: str, wide: int):
    def bucket(key, t):
        count = encoder(model)
        known: dict[bytes, int] = {}
        out = []
        for src, body in received(t):
            (_, sizes), (n, raw) = unpack(body)
            raw = pa.decompress(raw, n, codec="zstd", asbytes=True) if n else b""
            ends = np.cumsum(unplanes(sizes, np.uint32), dtype=np.int64).tolist()
            own = [raw[x:y] for x, y in zip([0, *ends], ends)]
            new = [w for w in own if w not in known]
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                known.update(zip(part, count([w.decode("utf-8", "surrogatepass") for w in part])))
            out.append((src, planes(np.array([known[w] for w in own], np.uint32))))
        return letters(key[0].as_py(), out, wide)

    return bucket


def _sum(nb: int):
    def run(key, t, said):
        often = _often(t)
        words = _vocabulary(often, nb)
        pieces: dict[str, int] = {}
        for b, counts in received(said):
            pieces.update(zip((w.decode("utf-8", "surrogatepass") for w in words[b]), unplanes(counts, np.uint32).tolist()))
        total = [sum(map(int.__mul__, map(pieces.__getitem__, x), x.values())) for x in often]
        return pa.table({"doc_id": t["doc_id"], "n_bytes": pc.binary_length(t["text"]).cast(pa.int64()), "n_tokens": pa.array(total, pa.int64())})

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096, run_bytes: int = 2 * RUN_BYTES, direct: int | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    model: path of a sentencepiece model, on every executor; a vocabulary whose pieces cross
    pre-tokens is refused.  Null text is empty and has no tokens; null ids and repeated rows
    are kept (rows of one id and one text are counted in one task); extra columns are ignored;
    texts of any length are counted whole; an empty table gives an empty result.

    direct: see exchange.DIRECT.
    """
    base = text_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = run_count(base, "text", run_bytes)
    nb = max(8, n)
    wide = width(nb, direct)
    some = base.withColumn("run", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    sent = deliver(some.groupBy("run").applyInArrow(lean(_send(nb, wide)), MESSAGE), wide)
    said = deliver(sent.groupBy("dst").applyInArrow(lean(_answer(model, wide)), MESSAGE), wide)
    out = some.groupBy("run").cogroup(said.groupBy("dst")).applyInArrow(lean(_sum(nb)), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
