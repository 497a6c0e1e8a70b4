"""A table of distinct chunks: each is encoded once, and its ids are joined back by position."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import filterfalse

#: Entries that a worker's table keeps, and the longest chunk that it keeps.
ENTRIES, LONGEST = 400_000, 64


class ChunkTable(dict):
    """chunk -> its ids as little-endian bytes.

    encode gets a list of distinct chunks and returns their bytes in order. The table stops growing at
    `entries`; further chunks are then encoded once a call (for all texts of a piece of an Arrow batch)
    instead of once a worker, with equal results.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], entries: int = ENTRIES):
        super().__init__()
        self.encode, self.entries = encode, entries

    def joined_all(self, lists: list[list[str]], distinct: set[str] | None = None) -> list[bytes]:
        """The bytes of each list's chunks in turn; what the table lacks is encoded once for all lists. distinct: all their chunks, if known."""
        fresh = [*filterfalse(self.__contains__, set().union(*lists) if distinct is None else distinct)]
        if not fresh:
            return [b"".join(map(self.__getitem__, own)) for own in lists]
        room = self.entries - len(self)
        self.update(zip(fresh, self.encode(fresh), strict=True))
        out = [b"".join(map(self.__getitem__, own)) for own in lists]
        drop = [c for c in fresh if len(c) > LONGEST] + [c for c in fresh if len(c) <= LONGEST][room:] if room > 0 else fresh
        for c in drop:
            del self[c]
        return out

    def joined(self, chunks: list[str]) -> bytes:
        return self.joined_all([chunks])[0]
