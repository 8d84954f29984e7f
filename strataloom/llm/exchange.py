"""Messages between groups: every source group sends a blob to some of the destination groups.

With few groups a message is a row.  A row for each pair of groups would grow with the
square of the input, so beyond DIRECT groups messages travel over a grid in two hops: a
source packs what goes to one column of destinations into a row, a relay (a column and a
block of sources) packs anew by destination.  n groups then make about n**1.5 rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._util import lean

#: Up to so many groups a message is a row of its own.
DIRECT = 512

MESSAGE = "dst int, src int, body binary"


def width(n: int, direct: int | None = None) -> int:
    """Destinations in a column of the grid; 1 if messages go straight."""
    return 1 if n <= (DIRECT if direct is None else direct) else int(np.ceil(np.sqrt(n)))


def pack(items: list[tuple[int, bytes]]) -> bytes:
    """(number, blob) pairs as one blob."""
    head = np.array([len(items), *(k for k, _ in items), *(len(b) for _, b in items)], "<i8")
    return head.tobytes() + b"".join(b for _, b in items)


def unpack(blob: bytes) -> list[tuple[int, bytes]]:
    n = int.from_bytes(blob[:8], "little")
    head = np.frombuffer(blob, "<i8", 2 * n, 8).tolist()
    out, at = [], 8 * (2 * n + 1)
    for k, size in zip(head[:n], head[n:]):
        out.append((k, blob[at : at + size]))
        at += size
    return out


def letters(src: int, out: list[tuple[int, bytes]], wide: int) -> pa.Table:
    """Rows of a source's messages (destination, blob)."""
    if wide > 1:
        by: dict[int, list] = {}
        for dst, body in out:
            by.setdefault(dst // wide, []).append((dst, body))
        out = [(hi, pack(x)) for hi, x in by.items()]
    return pa.table({
        "dst": pa.array([d for d, _ in out], pa.int32()), "src": pa.array([src] * len(out), pa.int32()), "body": pa.array([b for _, b in out], pa.binary()),
    })


def deliver(rows: DataFrame, wide: int) -> DataFrame:
    """rows of letters(), by their destination."""
    if wide == 1:
        return rows

    def relay(t: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for src, body in zip(t["src"].to_pylist(), t["body"].to_pylist()):
            for dst, x in unpack(body):
                by.setdefault(dst, []).append((src, x))
        return pa.table({
            "dst": pa.array(list(by), pa.int32()), "src": pa.array([-1] * len(by), pa.int32()), "body": pa.array([pack(x) for x in by.values()], pa.binary()),
        })

    return rows.groupBy("dst", F.expr(f"src div {wide}")).applyInArrow(lean(relay), MESSAGE)


def received(t: pa.Table) -> list[tuple[int, bytes]]:
    """(source, blob) of the messages of one destination, in order."""
    out = []
    for src, body in zip(t["src"].to_pylist(), t["body"].to_pylist()):
        out += [(src, body)] if src >= 0 else unpack(body)
    return sorted(out, key=lambda x: x[0])
