"""Ids of distinct strings, encoded once a worker and gathered for every place where a string stands."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

MOST_STRINGS, MOST_IDS = 250_000, 4_000_000


def flattened(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after another, and how many each list has."""
    widths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(widths.sum())), widths


def runs(ids: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` from ``starts`` on, one after another."""
    ends = np.cumsum(widths)
    return ids[np.repeat(starts - (ends - widths), widths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Pool:
    """Id lists by string, kept between slices. A pool that has grown beyond its bounds starts anew with the next slice.

    ``encode`` gives the ids of strings one after another and how many each has; ``check``, from the same, one flag for each string.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind=np.uint32, check: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray] | None = None):
        self.encode, self.kind, self.check = encode, kind, check
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=self.kind)
        self.bounds = np.zeros(1, dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)  # by slot, what ``check`` said

    def look_up(self, strings: list[str]) -> np.ndarray:
        """The slot of each of the distinct ``strings``; slots hold until the next call."""
        if len(self.slots) > MOST_STRINGS or self.bounds[-1] > MOST_IDS:
            self.clear()
        fresh = [s for s in strings if s not in self.slots]
        if fresh:
            ids, widths = self.encode(fresh)
            self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh)), strict=True))
            self.ids = np.concatenate((self.ids, ids.astype(self.kind)))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(widths)))
            if self.check:
                self.good = np.concatenate((self.good, self.check(fresh, ids, widths)))
        return np.fromiter(map(self.slots.__getitem__, strings), dtype=np.int64, count=len(strings))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``slots`` one after another, and how many each has."""
        widths = self.bounds[slots + 1] - self.bounds[slots]
        return runs(self.ids, self.bounds[slots], widths), widths


def per_row(bounds: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Sums of ``widths`` between successive ``bounds``."""
    return np.diff(np.concatenate(([0], np.cumsum(widths)))[bounds])


def strings_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column without nulls."""
    return column.to_numpy(zero_copy_only=False).tolist()
