"""Messages from many senders to the owners of hash ranges, and answers back, over hops of bounded fan-out.

Were every sender to write to every owner, messages would grow with the square of the input. A sender writes to at most
FAN ranges instead. Where more ranges are needed, a hop takes in what a group of as many senders has sent to one range,
merges it, and writes on to the parts of that range. A hop thus holds about as much as a sender, and each level
has at most FAN messages a sender. Answers go back the same way: a hop keeps nothing, it reads what was sent to it again.
Where a hop costs more than many messages do, as with strings, a sender may write to more ranges than FAN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slotscope.llm import golomb
from slotscope.llm.words import mix

#: Ranges that a sender or a hop writes to.
FAN = 128
MESSAGE = "sender long, to long, part long, blob binary"
REPLY = "sender long, part long, reply binary"


@dataclass(frozen=True)
class Routes:
    fan: int
    #: Groups of senders at each hop; there is one level more than there are hops.
    groups: tuple[int, ...]

    @property
    def levels(self) -> int:
        return len(self.groups) + 1

    def cuts(self, sorted_values: np.ndarray, level: int, of: int = 0) -> np.ndarray:
        """Where the parts begin that the range `of` of the level above has at this level, and the end."""
        first = of * self.fan
        return np.searchsorted(golomb.owners(sorted_values, self.fan**level), np.arange(first, first + self.fan + 1))

    def place(self, hop: int, level: int) -> tuple[int, int]:
        """A hop's group and range."""
        return divmod(hop, self.fan**level)

    def messages(self, sender: int, group: int, level: int, parts: list[int], blobs: list[bytes]) -> pa.Table:
        """What a sender of a group writes at a level: to the parts themselves at the last one, to hops before it."""
        to = parts
        if level < self.levels:
            then = int(mix(np.array([group], np.uint64))[0]) % self.groups[level - 1]
            to = [then * self.fan**level + p for p in parts]
        n = len(parts)
        return pa.table({"sender": pa.array([sender] * n, pa.int64()), "to": pa.array(to, pa.int64()), "part": pa.array(parts, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def plan_routes(senders: int, ranges: int, widest: int = 0) -> Routes:
    """Routes of as many levels as keep the fan-out within bounds, FAN or what is widest; of one level, there are FAN ranges at least."""
    levels, fan = 1, max(FAN, widest)
    while fan**levels < ranges:
        levels += 1
    if levels == 1:
        fan = max(FAN, ranges)
    while levels > 1 and (fan - 1) ** levels >= ranges:
        fan -= 1
    return Routes(fan, tuple(-(-max(1, senders) // fan**k) for k in range(1, levels)))


def exchange(messages: DataFrame, routes: Routes, merge: Callable, answer: Callable, forward: Callable, level: int = 1) -> DataFrame:
    """Replies (sender, part, reply) to the messages.

    merge(level) gives a function from a hop's messages to those it writes on, answer one from a range's messages to replies,
    forward(level) one from a hop's messages and the replies to it to replies to its own senders.
    """
    met = messages.groupBy("to")
    if level == routes.levels:
        return met.applyInArrow(answer, REPLY)
    replies = exchange(met.applyInArrow(merge(level), MESSAGE), routes, merge, answer, forward, level + 1)
    return met.cogroup(replies.groupBy("sender")).applyInArrow(forward(level), REPLY)


def gather(messages: DataFrame, routes: Routes, merge: Callable, finish: Callable, schema: str) -> DataFrame:
    """What finish makes of each range's messages."""
    for level in range(1, routes.levels):
        messages = messages.groupBy("to").applyInArrow(merge(level), MESSAGE)
    return messages.groupBy("to").applyInArrow(finish, schema)


def in_order(replies: pa.Table, column: str = "reply") -> list[bytes]:
    """The replies to one sender, by part."""
    parts = replies.column("part").to_numpy()
    blobs = replies.column(column).to_pylist()
    return [blobs[i] for i in np.argsort(parts, kind="stable")]
