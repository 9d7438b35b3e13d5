"""New identifiers on the driver: ULIDs that always grow."""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable

from ledgerloom.functions.scalars import ALPHABET

MOST_MS = 2**48 - 1


def encode(ms: int, random: int) -> str:
    if not (0 <= ms <= MOST_MS and 0 <= random < 2**80):
        raise ValueError("out of range")
    value = ms << 80 | random
    return "".join(ALPHABET[value >> 5 * i & 31] for i in reversed(range(26)))


class Ulids:
    """A generator. A clock that goes back is held at its last time; within a millisecond the random part counts up, and
    one that is used up moves on to the next millisecond."""

    def __init__(self, now: Callable[[], int] = lambda: time.time_ns() // 1_000_000, draw: Callable[[], int] = lambda: secrets.randbits(80)) -> None:
        self._now, self._draw = now, draw
        self._last, self._random = -1, 0

    def next(self) -> str:
        ms = self._now()
        if not 0 <= ms <= MOST_MS:
            raise ValueError("the clock is out of range")
        if ms > self._last:
            self._last, self._random = ms, self._draw()
        elif self._random + 1 < 2**80:
            self._random += 1
        else:
            self._last, self._random = self._last + 1, self._draw()
        return encode(self._last, self._random)
