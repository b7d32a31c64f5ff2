"""Sums over all tasks of a barrier stage.

Tasks of a barrier stage start together and know each other's hosts.  They form
a binary tree of sockets: sums go up, the total comes down, and every task gets
the same bytes.  (The stage's own message exchange takes most of a second a
round, so it only tells the ports.)  When a task is lost its neighbours fail as
well, and Spark starts the whole stage anew.
"""

from __future__ import annotations

import os
import re
import socket

import numpy as np

# Seconds after which a silent neighbour counts as lost.
PATIENCE = 600


def stage_tasks(context, most: int) -> int:
    """Tasks that a barrier stage asks for: the session's parallelism up to ``most``,
    and no more than a session on one machine can run at once."""
    tasks = min(most, context.defaultParallelism)
    local = re.fullmatch(r"local(?:\[(\d+|\*)(?:\s*,\s*\d+)?\])?", context.master)
    if local:
        tasks = min(tasks, (os.cpu_count() or 1) if local[1] == "*" else int(local[1] or 1))
    return max(1, tasks)


def _take(connection: socket.socket, size: int) -> bytes:
    held = bytearray()
    while len(held) < size:
        part = connection.recv(min(size - len(held), 1 << 20))
        if not part:
            raise ConnectionError("a task of the stage went away")
        held += part
    return bytes(held)


class TreeSum:
    """``total(vector)`` adds up the vectors of all tasks; every task must call it alike."""

    def __init__(self, context, token: bytes) -> None:
        tasks = context.getTaskInfos()
        self.rank, self.tasks = context.partitionId(), len(tasks)
        children = [c for c in (2 * self.rank + 1, 2 * self.rank + 2) if c < self.tasks]
        listener = socket.create_server(("", 0), backlog=4) if children else None
        ports = context.allGather(str(listener.getsockname()[1] if listener else 0))
        self.parent = None
        if self.rank:
            above = (self.rank - 1) // 2
            host = tasks[above].address.rsplit(":", 1)[0]
            self.parent = self._ready(socket.create_connection((host, int(ports[above])), timeout=PATIENCE))
            self.parent.sendall(token + self.rank.to_bytes(8, "little"))
        met: dict[int, socket.socket] = {}
        while len(met) < len(children):
            listener.settimeout(PATIENCE)
            connection = self._ready(listener.accept()[0])
            if _take(connection, len(token)) == token:
                met[int.from_bytes(_take(connection, 8), "little")] = connection
        if listener:
            listener.close()
        self.children = [met[c] for c in children]

    @staticmethod
    def _ready(connection: socket.socket) -> socket.socket:
        connection.settimeout(PATIENCE)
        connection.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return connection

    def total(self, vector: np.ndarray) -> np.ndarray:
        total = np.array(vector, dtype=float)
        for child in self.children:
            total += np.frombuffer(_take(child, total.nbytes))
        if self.parent:
            self.parent.sendall(total.tobytes())
            total = np.frombuffer(_take(self.parent, total.nbytes)).copy()
        for child in self.children:
            child.sendall(total.tobytes())
        return total

    def close(self) -> None:
        for connection in (*self.children, *([self.parent] if self.parent else [])):
            connection.close()
