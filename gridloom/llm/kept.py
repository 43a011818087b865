"""A bounded memory of results by name, for use inside a task."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from itertools import repeat

import numpy as np


class Runs:
    """Runs of numbers by slot, in one growing array."""

    def __init__(self, dtype: str) -> None:
        self.ids, self.at, self.sizes = np.zeros(0, dtype=dtype), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.at)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these slots one after the other, and how many of each."""
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.at[slots] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


class Kept:
    """Slots by name, and their runs; when there are more than ``limit``, the half used last stays."""

    def __init__(self, limit: int, dtype: str = "<u4"):
        self.limit, self.runs = limit, Runs(dtype)
        # In order of slots; when each slot was used last.
        self.index: dict[Hashable, int] = {}
        self.used, self.clock = np.zeros(0, dtype=np.int32), 0

    def _forget(self) -> None:
        keep = np.sort(np.argsort(self.used, kind="stable")[-(self.limit // 2 + 1) :])
        names, runs = list(self.index), Runs(self.runs.ids.dtype.str)
        runs.add(*self.runs.take(keep))
        self.index, self.used, self.runs = {names[i]: k for k, i in enumerate(keep.tolist())}, self.used[keep], runs

    def slots(self, names: list[Hashable], learn: Callable[[list[Hashable]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The slot of each of these distinct names; ``learn`` gives numbers and sizes of those not known."""
        if len(self.index) > self.limit:
            self._forget()
        slots = np.fromiter(map(self.index.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        unmet = np.flatnonzero(slots < 0)
        if len(unmet):
            new, base = [names[i] for i in unmet.tolist()], len(self.index)
            slots[unmet] = base + np.arange(len(new))
            self.index.update(zip(new, range(base, base + len(new))))
            self.used = np.concatenate((self.used, np.zeros(len(new), dtype=np.int32)))
            self.runs.add(*learn(new))
        self.clock += 1
        self.used[slots] = self.clock
        return slots
