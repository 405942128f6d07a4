"""A bounded memory of a function's values."""

from __future__ import annotations

from collections.abc import Callable

LONGEST_KEY = 256


class Cache(dict):
    """Values of `compute` by key, for at most two generations of `size` keys.

    When the younger generation is full it becomes the older one, whose keys move back as they are
    used; what is not used goes with the next change. Values in `fixed` always stay, and keys over
    256 units long are not kept, so memory is bounded whatever the texts.
    """

    def __init__(self, compute: Callable, size: int, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.compute, self.size, self.fixed, self.older = compute, size, fixed or {}, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.size + len(self.fixed):
                self.older = dict(self)
                self.clear()
                self.update(self.fixed)
            self[key] = value
        return value
