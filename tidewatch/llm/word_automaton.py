"""Word deduplication by suffix automata: words under 35-word windows that start anywhere else too.

Repeated windows are found as in `passages`. The reference of a shard, all passages that share an
anchor with different ones, becomes one suffix automaton whose states know how often their strings
occur. The passages stream through it for their matching statistics; a window whose state occurs
twice or more is repeated. The corpus is its own reference and grows with itself, so its automata
are not broadcast: a passage goes to the one shard whose automaton can match it.

Words are parted by ASCII white space and compared by 64-bit hashes. Null and empty texts have no
words; texts under 35 words keep all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.hashing import mixed, word_hashes
from tidewatch.llm.passages import REPEATED, WANTED, Block, Scheme, without_repeats

WINDOW, GRAM = 35, 8
_RUNS = 2048  # looked through at a time


class Automaton:
    """A suffix automaton of some sequences, with the number of occurrences of each state's strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def add(self, sequence: list, times: int) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            self.count[last] += times

    def _extend(self, last: int, symbol) -> int:
        next_, link, length = self.next, self.link, self.length
        known = next_[last].get(symbol)
        if known is not None and length[known] == length[last] + 1:
            return known
        new = known if known is not None else self._state(length[last] + 1)
        state = last
        if known is None:
            while state >= 0 and symbol not in next_[state]:
                next_[state][symbol] = new
                state = link[state]
            if state < 0:
                link[new] = 0
                return new
        target = next_[state][symbol]
        if known is None and length[target] == length[state] + 1:
            link[new] = target
            return new
        copy = self._state(length[state] + 1, target)
        link[target] = copy
        while state >= 0 and next_[state].get(symbol) == target:
            next_[state][symbol] = copy
            state = link[state]
        if known is not None:
            return copy
        link[new] = copy
        return new

    def close(self) -> None:
        """Counts of states include those of the longer strings that end in them."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def windows_that_occur_twice(self, sequence: list, size: int) -> np.ndarray:
        """For every window of `size` symbols whether the sequences hold it twice or more."""
        found = np.zeros(max(len(sequence) - size + 1, 0), bool)
        state = matched = 0
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            while self.length[self.link[state]] >= size:  # the shortest state that still holds a window
                state = self.link[state]
            matched = min(matched, self.length[state])
            if matched >= size:
                found[i - size + 1] = self.count[state] > 1
        return found


class RepeatedWords(Scheme):
    """Windows of words that start at another place too."""

    window, span = WINDOW, WINDOW - GRAM + 1

    def symbols(self, texts):
        begins, words = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
        ends = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
        return words, np.concatenate([[0], ends[:-1]]), ends

    def grams(self, values):
        n = len(values) - GRAM + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        found = values[:n].copy()
        for j in range(1, GRAM):
            found = found * np.uint64(0xD6E8FEB86659FD93) + values[j : n + j]
        return mixed(found)

    def repeats_within(self, values, anchors, begins, behind):
        grams = self.grams(values)
        times = np.zeros(len(anchors), np.int64)
        for at in range(0, len(anchors), _RUNS):
            part = slice(at, at + _RUNS)
            sizes = behind[part] - begins[part] + self.span - 1
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(begins[part], sizes)
            times[part] = np.add.reduceat(grams[places] == np.repeat(anchors[part], sizes), ends - sizes)
        return times > 1

    def judge(self, group, passage, docs, counts, again):
        heads = np.diff(passage, prepend=-1) != 0
        kinds = np.bincount(group[heads]) if len(group) else np.zeros(0, np.int64)
        held = np.bincount(passage, weights=counts)[passage] if len(group) else np.zeros(0)
        repeated = held > 1
        searched = heads & ((kinds[group] > 1) | (again & ~repeated))
        return np.where(repeated, REPEATED, 0) | np.where(searched, WANTED, 0), np.minimum(held, 2).astype(np.int64)

    def answers(self, block, flags, numbers):
        return (flags & REPEATED) > 0

    def shared(self, passages, numbers):
        sequences = [np.frombuffer(p, np.uint64).tolist() for p in passages]
        automaton = Automaton()
        for sequence, times in zip(sequences, numbers.tolist()):
            automaton.add(sequence, times)
        automaton.close()
        return [automaton.windows_that_occur_twice(s, WINDOW) for s in sequences]

    def result(self, block: Block, removed: np.ndarray) -> pa.Table:
        texts = []
        for text, a, b in zip(block.texts, block.starts.tolist(), block.ends.tolist()):
            words, gone = text.split(), removed[a:b]
            texts.append(b" ".join([w for w, x in zip(words, gone.tolist()) if not x] if gone.any() else words))
        gone = np.concatenate([[0], np.cumsum(removed)])
        return pa.table(
            {
                "doc_id": block.ids,
                "n_words": block.ends - block.starts,
                "n_removed": gone[block.ends] - gone[block.starts],
                "kept": pa.array(texts, pa.binary()),
            }
        )


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the kept words, joined by blanks."""
    return without_repeats(docs, RepeatedWords(), "doc_id long, n_words long, n_removed long, kept binary")
