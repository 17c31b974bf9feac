"""A worker's memory of what it made lately, bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable
from sys import getsizeof

#: Bytes of both generations of a memory together, with keys and bookkeeping.
MOST_BYTES = 128 << 20
#: Texts of more characters are made anew each time.
LONGEST = 64
#: Bytes of bookkeeping that an entry costs.
ENTRY = 120


class Lately:
    """Values by text in two generations: a full one becomes the older, and what was in that is forgotten.

    size: the bytes of a value.
    """

    def __init__(self, size: Callable = getsizeof, most: int = MOST_BYTES, longest: int = LONGEST):
        self.size, self.half, self.longest = size, most // 2, longest
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0
        self.guests: list[str] = []

    def look_up(self, wanted: set[str], make: Callable[[list[str]], list]) -> dict:
        """A mapping with the values of all wanted texts; it may change with the next call.
        make gives the values of a list of texts that aren't known."""
        for x in self.guests:
            del self.young[x]
        self.guests = []
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        missing = wanted - young.keys()
        again = missing & old.keys()
        new = list(missing - again)
        found = {x: old[x] for x in again}
        if new:
            found |= zip(new, make(new))
        young |= found
        self.guests = [x for x in found if len(x) > self.longest]
        self.held += sum(map(getsizeof, found)) + sum(map(self.size, found.values())) + ENTRY * len(found)
        return young
