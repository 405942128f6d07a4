"""Repeated windows of a corpus, found without comparing documents with each other.

A window is a fixed number of consecutive symbols of one document. Its anchor is the least hash of
the k-grams in it, so equal windows have equal anchors. Neighbouring windows mostly share theirs: a
run is a maximal row of windows of one document with one anchor, and its passage is all they cover.
A window belongs to one run only, and equal windows only to runs of the same anchor. So

1. blocks of documents send every distinct (anchor, passage hash) to the shard of the anchor,
   once however often the block holds it;
2. a shard tells the blocks which passages others hold too, and asks one holder of each passage
   whose anchor stands in several different passages for its text;
3. those texts, each distinct passage once, form the shard's reference: an index over it tells which
   of their windows are shared, and only the one block that asked learns of it.

An anchor with very many copies thus costs a row a block, never a row a copy. Subclasses say what
symbols are, when a passage counts as repeated, and which index searches the reference.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tidewatch.llm.blocks import documents_of, dump, load, pack, release_memory, released, shuffle_partitions
from tidewatch.llm.hashing import mixed

BLOCK_BYTES = 4 << 20
SLICE = 1 << 18  # symbols for which 64-bit numbers are held at a time
SHARDS_PER_PARTITION = 2  # each shard is a task of its own
REPEATED, WANTED = 1, 2
_BASE = 0x9E3779B97F4A7C15
_ANSWER = StructType(
    [StructField("block", LongType()), StructField("shard", IntegerType()), StructField("payload", BinaryType())]
)


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    powers = np.full(SLICE + 1, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def range_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, plain=lambda values: values) -> np.ndarray:
    """64-bit hashes of ranges of some symbols, `plain` of which are 64-bit numbers.

    Begins and ends both ascend; the symbols are taken in slices of at most `SLICE`.
    """
    powers, back, modulus = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64)), 1 << 64
    found = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        low = int(begins[at])
        behind = int(np.searchsorted(ends, low + SLICE, "right"))
        if behind > at:
            part = plain(values[low : int(ends[behind - 1])])
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * powers[: len(part)], out=sums[1:])
            begin, end = begins[at:behind] - low, ends[at:behind] - low
            found[at:behind] = (sums[end] - sums[begin]) * back[begin]
        else:  # one range longer than a slice
            behind, total = at + 1, 0
            for place in range(low, int(ends[at]), SLICE):
                part = plain(values[place : min(place + SLICE, int(ends[at]))])
                total += int((part * powers[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, place - low, modulus)
            found[at] = total % modulus
        at = behind
    return mixed(found + (ends - begins).astype(np.uint64))


def _sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every `span` neighbouring values."""
    least, width = values, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (span - width)], least[span - width :]) if width < span else least


def owned_runs(values: np.ndarray, span: int, window: int, starts: np.ndarray, ends: np.ndarray, grams=lambda values: values):
    """Runs of windows with one least k-gram: anchors, first and behind-last window, and document.

    `grams` gives a hash for every k-gram of some symbols, a window holds `span` of them; documents are
    the symbols from `starts` to `ends`. Windows are taken in slices; runs go on from one to the next.
    """
    count = len(values) - window + 1
    empty = np.zeros(0, np.int64)
    if count <= 0:
        return np.zeros(0, np.uint64), empty, empty, empty
    opened = starts[(starts < count) & (ends > starts)]
    anchors, begins, last = [], [], None
    for low in range(0, count, SLICE):
        high = min(low + SLICE, count)
        least = _sliding_least(grams(values[low : high + window - 1]), span)[: high - low]
        new = np.empty(high - low, bool)
        new[0] = last is None or least[0] != last
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[opened[np.searchsorted(opened, low) : np.searchsorted(opened, high)] - low] = True
        at, last = np.flatnonzero(new), least[-1]
        anchors.append(least[at])
        begins.append(at + low)
    anchors, begins = np.concatenate(anchors), np.concatenate(begins)
    behind = np.append(begins[1:], count)
    doc = np.searchsorted(ends, begins, side="right")
    behind = np.minimum(behind, ends[doc] - window + 1)
    kept = behind > begins
    return anchors[kept], begins[kept], behind[kept], doc[kept]


class Block:
    """The symbols, runs and distinct passages of a block of documents."""

    def __init__(self, scheme: Scheme, payload, shards: int):
        self.ids, self.texts = documents_of(payload)
        self.values, self.starts, self.ends = scheme.symbols(self.texts)
        anchors, self.begins, self.behind, self.doc = owned_runs(
            self.values, scheme.span, scheme.window, self.starts, self.ends, scheme.grams
        )
        stops = self.behind + scheme.window - 1
        passages = range_hashes(self.values, self.begins, stops, scheme.plain) >> np.uint64(16)
        again = scheme.repeats_within(self.values, anchors, self.begins, self.behind)
        order = np.lexsort((self.ids[self.doc], passages, anchors))
        new = np.ones(len(order), bool)
        new[1:] = (anchors[order][1:] != anchors[order][:-1]) | (passages[order][1:] != passages[order][:-1])
        self.entry = np.empty(len(order), np.int64)  # of every run
        self.entry[order] = np.cumsum(new) - 1
        self.holder = order[new]  # the run of the least document that holds an entry's passage
        self.anchors, self.passages = anchors[self.holder], passages[self.holder]
        self.counts = np.bincount(self.entry, minlength=len(self.holder))
        self.again = again[self.holder]
        self.shard = (self.anchors % np.uint64(shards)).astype(np.int32)
        self.window = scheme.window

    def entries_of(self, shard: int) -> np.ndarray:
        return np.flatnonzero(self.shard == shard)

    def runs_like_holders(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All runs of some entries in their least document, each with the number of its entry."""
        order = np.argsort(self.entry, kind="stable")
        first = np.searchsorted(self.entry[order], entries)
        for k in range(int(self.counts[entries].max()) if len(entries) else 0):
            which = np.flatnonzero(self.counts[entries] > k)
            run = order[first[which] + k]
            same = self.ids[self.doc[run]] == self.ids[self.doc[self.holder[entries[which]]]]
            yield run[same], which[same]

    def covered(self, begins: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Which symbols the windows from `begins` to before `behind` cover."""
        change = np.zeros(len(self.values) + 1, np.int32)
        np.add.at(change, begins, 1)
        np.add.at(change, behind + self.window - 1, -1)
        return np.cumsum(change[:-1], out=change[:-1]) > 0


class Scheme:
    """What windows are made of. Instances travel to the tasks, so they hold plain values only."""

    window: int
    span: int  # k-grams in a window

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols, and where each document's begin and end."""
        raise NotImplementedError

    def grams(self, values: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def plain(self, values: np.ndarray) -> np.ndarray:
        """Symbols as 64-bit numbers."""
        return values

    def repeats_within(self, values, anchors, begins, behind) -> np.ndarray:
        """Which runs may hold a window twice, if that counts."""
        return np.zeros(len(anchors), bool)

    def judge(self, group: np.ndarray, passage: np.ndarray, docs: np.ndarray, counts: np.ndarray, again: np.ndarray):
        """Verdicts on a shard's entries, sorted by `group` (of an anchor) and `passage`: flags and a number each."""
        raise NotImplementedError

    def shared(self, passages: list[bytes], numbers: np.ndarray) -> list[np.ndarray]:
        """For each passage of a shard's reference the windows that count as repeated, as a mask."""
        raise NotImplementedError

    def result(self, block: Block, removed: np.ndarray) -> pa.Table:
        raise NotImplementedError

    def answers(self, block: Block, run_flags: np.ndarray, run_numbers: np.ndarray) -> np.ndarray:
        """Which runs are removed as a whole, by their entry's verdict."""
        raise NotImplementedError


def _split(scheme: Scheme, shards: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                block = Block(scheme, payload.as_buffer(), shards)
                rows = []
                for shard in np.unique(block.shard).tolist():
                    at = block.entries_of(shard)
                    low, high = block.passages[at] & np.uint64(0xFFFFFFFF), block.passages[at] >> np.uint64(32)
                    table = pa.table(
                        {
                            "anchor": (block.anchors[at] >> np.uint64(32)).astype(np.uint32),
                            "low": low.astype(np.uint32),
                            "high": high.astype(np.uint16),
                            "doc": block.ids[block.doc[block.holder[at]]],
                            "count": np.minimum(block.counts[at], 255).astype(np.uint8),
                            "again": block.again[at].astype(np.uint8),
                        }
                    )
                    rows.append((number, shard, dump(table)))
                yield _answer(rows)

    return split


def _answer(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([r[0] for r in rows], pa.int64()),
            "shard": pa.array([r[1] for r in rows], pa.int32()),
            "payload": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def _judge(scheme: Scheme):
    def judge(rows: pa.Table) -> pa.Table:
        tables = [load(p.as_buffer()) for p in rows.column("payload")]
        sizes = [t.num_rows for t in tables]
        column = lambda name: np.concatenate([t.column(name).to_numpy() for t in tables])
        anchor, low, high, docs = column("anchor"), column("low"), column("high"), column("doc")
        counts, again = column("count").astype(np.int64), column("again").astype(bool)
        passage = (high.astype(np.uint64) << np.uint64(32)) | low
        blocks = np.repeat(rows.column("block").to_numpy(), sizes)
        order = np.lexsort((blocks, docs, passage, anchor))
        new = np.ones(len(order), bool)
        new[1:] = anchor[order][1:] != anchor[order][:-1]
        other = new.copy()
        other[1:] |= passage[order][1:] != passage[order][:-1]
        flags, numbers = np.zeros(len(order), np.uint8), np.zeros(len(order), np.int64)
        flags[order], numbers[order] = scheme.judge(np.cumsum(new) - 1, np.cumsum(other) - 1, docs[order], counts[order], again[order])
        found, begun = [], 0
        for number, shard, size in zip(rows.column("block").to_pylist(), rows.column("shard").to_pylist(), sizes):
            at = np.flatnonzero(flags[begun : begun + size])
            if len(at):
                table = {"at": at.astype(np.uint32), "flag": flags[begun : begun + size][at], "number": numbers[begun : begun + size][at]}
                found.append((number, shard, dump(pa.table(table))))
            begun += size
        return pa.Table.from_batches([_answer(found)])

    return judge


def _verdicts(block: Block, rows: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Flags and numbers of a block's entries."""
    flags, numbers = np.zeros(len(block.holder), np.uint8), np.zeros(len(block.holder), np.int64)
    for row in rows or []:
        table = load(row["payload"])
        at = block.entries_of(row["shard"])[table.column("at").to_numpy()]
        flags[at], numbers[at] = table.column("flag").to_numpy(), table.column("number").to_numpy()
    return flags, numbers


def _send(scheme: Scheme, shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["verdicts"]:
                    continue
                block, found = Block(scheme, row["payload"], shards), []
                flags, numbers = _verdicts(block, row["verdicts"])
                wanted = np.flatnonzero(flags & WANTED)
                for shard in np.unique(block.shard[wanted]).tolist():
                    at = wanted[block.shard[wanted] == shard]
                    run = block.holder[at]
                    stops = block.behind[run] + scheme.window - 1
                    texts = [block.values[a:b].tobytes() for a, b in zip(block.begins[run], stops)]
                    table = {"at": at, "text": pa.array(texts, pa.binary()), "number": numbers[at]}
                    found.append((row["block"], shard, dump(pa.table(table))))
                yield _answer(found)

    return send


def _search(scheme: Scheme):
    def search(rows: pa.Table) -> pa.Table:
        tables = [load(p.as_buffer()) for p in rows.column("payload")]
        texts = [t for table in tables for t in table.column("text").to_pylist()]
        numbers = np.concatenate([t.column("number").to_numpy() for t in tables])
        masks = scheme.shared(texts, numbers)
        found, begun = [], 0
        for number, shard, table in zip(rows.column("block").to_pylist(), rows.column("shard").to_pylist(), tables):
            at, begins, behind = [], [], []
            for entry, mask in zip(table.column("at").to_pylist(), masks[begun : begun + table.num_rows]):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                at += [entry] * (len(edges) // 2)
                begins += edges[::2].tolist()
                behind += edges[1::2].tolist()
            begun += table.num_rows
            if at:
                table = pa.table({"at": pa.array(at, pa.int64()), "begin": pa.array(begins, pa.int64()), "behind": pa.array(behind, pa.int64())})
                found.append((number, shard, dump(table)))
        del tables, texts, masks
        release_memory()
        return pa.Table.from_batches([_answer(found)])

    return search


def _finish(scheme: Scheme, shards: int):
    def finish(rows: pa.Table, spans: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            block = Block(scheme, row["payload"], shards)
            flags, numbers = _verdicts(block, row["verdicts"])
            whole = scheme.answers(block, flags[block.entry], numbers[block.entry])
            begins, behind = [block.begins[whole]], [block.behind[whole]]
            if spans.num_rows:
                found = pa.concat_tables([load(p.as_buffer()) for p in spans.column("payload")])
                begin, stop = found.column("begin").to_numpy(), found.column("behind").to_numpy()
                for run, which in block.runs_like_holders(found.column("at").to_numpy()):
                    begins.append(block.begins[run] + begin[which])
                    behind.append(block.begins[run] + stop[which])
            out.append(scheme.result(block, block.covered(np.concatenate(begins), np.concatenate(behind))))
        release_memory()
        return pa.concat_tables(out)

    return finish


def without_repeats(docs: DataFrame, scheme: Scheme, schema: str) -> DataFrame:
    """`scheme.result` of every block of `docs`, given the symbols that repeated windows cover."""
    shards = SHARDS_PER_PARTITION * shuffle_partitions(docs)
    blocks = pack(docs, BLOCK_BYTES)
    entries = blocks.mapInArrow(released(_split(scheme, shards)), _ANSWER)
    verdicts = entries.repartitionById(shards, "shard").groupBy("shard").applyInArrow(_judge(scheme), _ANSWER)
    by_block = verdicts.groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias("verdicts"))
    judged = blocks.join(by_block, "block", "left")
    wanted = judged.mapInArrow(released(_send(scheme, shards)), _ANSWER)
    spans = wanted.repartitionById(shards, "shard").groupBy("shard").applyInArrow(_search(scheme), _ANSWER)
    return judged.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_finish(scheme, shards), schema)
