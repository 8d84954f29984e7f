"""Tasks of one barrier stage that take steps together: each is connected to every other, so a step needs no job of its own."""

from __future__ import annotations

import hmac
import secrets
import socket
import struct
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np

#: Seconds after which a silent peer is taken for lost; the task fails and Spark repeats the stage.
PATIENCE = 1800


class Alone:
    """A task without peers."""

    rank, size, order = 0, 1, None

    def exchanged(self, out: list) -> list[bytes]:
        """What each peer has for this one, from what this one has for each."""
        return [bytes(memoryview(x).cast("B")) for x in out]

    def named(self, ids: np.ndarray) -> np.ndarray:
        """All points' ids in order, from each task's own; from then on points() follows it."""
        every = np.concatenate([np.frombuffer(x, np.int64) for x in self.exchanged([ids] * self.size)])
        self.order = np.argsort(every, kind="stable")
        return every[self.order]

    def points(self, own: np.ndarray) -> np.ndarray:
        """The coordinates of all points, in the order of their ids."""
        if self.size == 1:
            return own if self.order is None else own[self.order]
        own = np.ascontiguousarray(own)
        return np.concatenate([np.frombuffer(x).reshape(-1, own.shape[1]) for x in self.exchanged([own] * self.size)])[self.order]

    def shared(self, n: int, work: Callable[[int], np.ndarray]) -> list[np.ndarray]:
        """work(0) to work(n - 1), each done by one task, for all."""
        own = [work(c) for c in range(n) if c % self.size == self.rank]
        if self.size == 1:
            return own
        head = np.array([len(x) for x in own], np.int64)
        mine = np.concatenate([[len(own)], head, *own]).astype(float)
        got = []
        for x in self.exchanged([mine] * self.size):
            x = np.frombuffer(x)
            k = int(x[0])
            got.append(np.split(x[1 + k :], np.cumsum(x[1 : 1 + k]).astype(int)[:-1]) if k else [])
        return [got[c % self.size][c // self.size] for c in range(n)]

    def close(self) -> None:
        pass


class Mesh(Alone):
    """The tasks of a barrier stage."""

    def __init__(self, context):
        self.rank = context.partitionId()
        hosts = [i.address.rsplit(":", 1)[0] for i in context.getTaskInfos()]
        self.size = len(hosts)
        own = hosts[self.rank]
        family = socket.AF_INET6 if own.startswith("[") else socket.AF_INET
        with socket.socket(family) as door:
            door.bind((own.strip("[]"), 0))
            door.listen(self.size)
            door.settimeout(PATIENCE)
            secret = secrets.token_hex(16)
            places = [x.split() for x in context.allGather(f"{own.strip('[]')} {door.getsockname()[1]} {secret}")]
            self.to: dict[int, socket.socket] = {}
            for k in range(self.rank):
                s = socket.create_connection((places[k][0], int(places[k][1])), PATIENCE)
                s.sendall(places[k][2].encode() + struct.pack("<q", self.rank))
                self.to[k] = s
            while len(self.to) < self.size - 1:
                s, _ = door.accept()
                s.settimeout(PATIENCE)
                try:
                    hello = _read(s, len(secret) + 8)
                except OSError:
                    s.close()
                    continue
                if hmac.compare_digest(bytes(hello[:-8]), secret.encode()):
                    self.to[struct.unpack("<q", hello[-8:])[0]] = s
                else:
                    s.close()
        for s in self.to.values():
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.pool = ThreadPoolExecutor(1)

    def exchanged(self, out: list) -> list[bytes]:
        around = [(self.rank + k) % self.size for k in range(1, self.size)]

        def send():
            for k in around:
                x = memoryview(out[k]).cast("B")
                self.to[k].sendall(struct.pack("<q", x.nbytes))
                self.to[k].sendall(x)

        sent = self.pool.submit(send)
        got: list = [None] * self.size
        got[self.rank] = memoryview(out[self.rank]).cast("B")
        for k in reversed(around):
            got[k] = _read(self.to[k], struct.unpack("<q", _read(self.to[k], 8))[0])
        sent.result()
        return got

    def close(self) -> None:
        self.pool.shutdown(wait=False)
        for s in self.to.values():
            s.close()


def _read(s: socket.socket, n: int) -> bytearray:
    out = bytearray(n)
    view = memoryview(out)
    while len(view):
        k = s.recv_into(view)
        if not k:
            raise ConnectionError("a peer is gone")
        view = view[k:]
    return out
