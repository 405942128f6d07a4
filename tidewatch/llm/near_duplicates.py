"""Near-duplicates by order min-hash, verified by banded alignment.

Documents are sequences of words (parted by ASCII white space, ASCII case ignored). Their k-mers are
`K` words long and labelled with their occurrence, so repeats count. A sketch takes the `L` least
k-mers under one hash function and keeps them in the order of the text: sketches agree for texts
that are alike in content and in order. Two documents are near-duplicates if their edit similarity,
1 - distance / length of the longer, is at least 0.8; only distances within that band are computed.
At similarity 0.8 with words replaced at random, 3-mers have a Jaccard similarity of 0.34: a pair is
missed as a candidate by all of 96 sketches of two 3-mers with probability 6e-6; with every fifth
word replaced, Jaccard 0.25, with 0.2 %. Those are the only links that can be lost: texts of at most
`SHORT` words have keys that miss none (see `short_keys`), and every pair of documents with a common
key is decided.

Exact copies are folded into their least id first, so copies are never paired. Each document then is
compared with one pivot: each of its groups of equal keys offers the document whose groups hold most
documents, and it takes the one it shares most keys with; where that leaves it apart, with a second. That leaves groups of equal keys that hold documents of different components.
A passage of many documents makes many such groups of nearly the same documents; so groups are united in which the same document has
the least hash, as likely as they overlap, and a document stands once in each union. In those, all pairs from different components
are compared, linked or not: by length and by a lower bound of the distance from counts of hashed words, first in few bins, then in
more, in blocks of documents of like length, then those within the bound by alignment, the closest first, so that what they connect
needs no more comparing. Classes are the connected components of all verified links.

The block step is exact and grows with the square of the number of documents of like length in a
group that are in different components, as in groups formed by a passage that many documents hold.

Null and empty texts are exact copies of each other. Documents are told apart by id and text: texts of
one id are classed each by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import id_and_text, released
from tidewatch.llm.hashing import mixed, word_hashes
from tidewatch.session import checkpointed

K, L, SKETCHES = 3, 2, 96
#: Words up to which a text has `short_keys`; from 0.8 times that on it has sketches.
SHORT = 40
PIVOT_ROUNDS = 2
#: Counts of hashed words that bound a distance, at first and for what that leaves, and documents of a block.
BINS, FINE, BLOCK = 256, 1024, 512
_SEEDS = np.random.default_rng(17).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _labelled(kmers: np.ndarray) -> np.ndarray:
    """k-mer hashes joined with the number of the occurrence."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = np.flatnonzero(new)
    occurrence = np.empty(len(kmers), np.uint64)
    occurrence[order] = np.arange(len(kmers)) - first[np.cumsum(new) - 1]
    return mixed(kmers + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketches(words: np.ndarray) -> np.ndarray:
    """The sketches of a text of at least one word, given by the hashes of its words."""
    n = len(words)
    if n < K:
        kmers = mixed(np.array([sum((int(w) * (i + 1) for i, w in enumerate(words)), n) % (1 << 64)], np.uint64))
    else:
        kmers = words[: n - K + 1].copy()
        for j in range(1, K):
            kmers = kmers * np.uint64(0x100000001B3) + words[j : n - K + 1 + j]
        kmers = _labelled(mixed(kmers))
    most = 1 << 20
    out = np.empty(SKETCHES, np.uint64)
    for a in range(0, SKETCHES, max(1, most // len(kmers))):
        seeds = _SEEDS[a : a + max(1, most // len(kmers))]
        values = (kmers[None, :] ^ seeds[:, None]) * _FACTOR
        values ^= values >> np.uint64(32)
        values *= _FACTOR
        rows = np.arange(len(seeds))
        least = []
        for _ in range(min(L, len(kmers))):
            at = values.argmin(axis=1)
            least.append(at)
            values[rows, at] = np.uint64((1 << 64) - 1)
        at = np.sort(np.stack(least), axis=0)
        found = np.zeros(len(seeds), np.uint64)
        for place in at:
            found = mixed(found * np.uint64(3) + kmers[place])
        out[a : a + len(seeds)] = found
    return out


def short_keys(words: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a short text of which two texts of that edit similarity share one.

    With at most d edits and n words in the longer, they share n - 1 - 2 d word pairs, labelled with
    their occurrence; so the first ones of both in any order, here that of the hashes, have one in
    common, if as many are taken as a text can lack, plus one.
    """
    n = len(words)
    most = int((1 - similarity) * n + 1e-9)
    if n < 2 or int((1 - similarity) * (n / similarity) + 1e-9) == 0:
        return mixed(np.array([sum((int(w) * (i + 1) for i, w in enumerate(words)), n) % (1 << 64)], np.uint64))
    return np.sort(_labelled(mixed(words[:-1] * np.uint64(0x100000001B3) + words[1:])))[: 2 * most + 2]


def keys_of(words: np.ndarray, similarity: float) -> np.ndarray:
    """The keys of a text of at least one word."""
    found = []
    if len(words) <= SHORT:
        found.append(mixed(short_keys(words, similarity) ^ np.uint64(len(_SEEDS))))
    if len(words) >= similarity * SHORT:
        found.append(mixed(sketches(words) ^ _SEEDS))
    return np.unique(np.concatenate(found))


def word_counts(words: np.ndarray) -> bytes:
    """How many words have each hash below `FINE`, at most 255. An edit changes two counts by one."""
    return np.minimum(np.bincount((words & np.uint64(FINE - 1)).astype(np.int64), minlength=FINE), 255).astype(np.uint8).tobytes()


def _least_distances(counts: np.ndarray, sizes: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    """Lower bounds of the distances of one text, by its counts of hashed words and its length, to others."""
    common = np.minimum(counts, own).sum(axis=1, dtype=np.int64)
    sums = np.maximum(counts.sum(axis=1, dtype=np.int64), own.sum(dtype=np.int64))
    return np.maximum(sums - common, np.abs(sizes - size))


def distance_within(a: list, b: list, most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`: bit-parallel over the diagonals
    that a distance of `most` can reach."""
    if abs(len(a) - len(b)) > most:
        return None
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    a, b = a[begin:], b[begin:]
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    bags = Counter(a)
    bags.subtract(b)
    if max(sum(n for n in bags.values() if n > 0), -sum(n for n in bags.values() if n < 0)) > most:
        return None
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    band = min(most, len(a) - 1)  # the distance is at most len(a)
    width = 2 * band + 1
    mask = (1 << width) - 1
    # Bit r of a column's vectors is row j - band + r; `up` and `down` hold where distances rise and
    # fall from row to row. The score follows the lowest diagonal down to the last row, then that row.
    up, down, score, row_bit = ((1 << (band + 1)) - 1) << band, 0, band, 1 << (width - 1)
    for j, x in enumerate(b):
        eq = places.get(x, 0)
        eq = (eq >> (j - band) if j >= band else eq << (band - j)) & mask
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp = down | ~(d0 | up)
        hn = d0 & up
        if j < len(a) - band:
            score += not d0 & row_bit
        else:
            row_bit >>= 1
            score += bool(hp & row_bit) - bool(hn & row_bit)
        d0 = (d0 & mask) >> 1
        up = (hn | ~(d0 | hp)) & mask
        down = d0 & hp & mask
    if score > band:
        score = len(a)
    return score if score <= most else None


def _groups(rows: DataFrame) -> DataFrame:
    """(key, doc_id, weight) of the rows (key, doc_id) whose key several documents hold; a document's weight is how many its groups hold."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = checkpointed(rows.join(sizes, "key"))
    weights = rows.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    return rows.join(weights, "doc_id").select("key", "doc_id", "weight")


def _best_pivots(groups: DataFrame, labels: DataFrame | None, tested: DataFrame | None) -> DataFrame:
    """(doc_id, pivot), the greater first: for each document the pivot it shares most keys with, the least of equals, among
    those of other components (`labels`: node, label). Pairs in `tested` are known to be unlike or linked."""
    head = F.max(F.struct("weight", (-F.col("doc_id")).alias("back"))).alias("head")
    pivot = (-F.col("head.back")).alias("pivot")
    if tested is None:
        pairs = groups.select("key", "doc_id").join(groups.groupBy("key").agg(head).select("key", pivot), "key").where("doc_id != pivot")
    else:
        rows = groups.join(labels.withColumnRenamed("node", "doc_id"), "doc_id")
        head = F.max(F.struct("weight", (-F.col("doc_id")).alias("back"), "label")).alias("head")
        heads = rows.groupBy("key").agg(head, F.min("label").alias("lo"), F.max("label").alias("hi"))
        heads = heads.where("lo < hi").select("key", pivot, F.col("head.label").alias("other"))
        pairs = rows.join(heads, "key").where("label != other")
    pairs = pairs.groupBy("doc_id", "pivot").agg(F.count(F.lit(1)).alias("n"))
    if tested is not None:
        known = tested.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
        known = known.union(known.select("b", "a")).toDF("doc_id", "pivot")
        pairs = pairs.join(known, ["doc_id", "pivot"], "left_anti")
    best = pairs.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("pivot")).alias("back"))).alias("head")).select("doc_id", pivot)
    return best.select(F.greatest("doc_id", "pivot").alias("doc_id"), F.least("doc_id", "pivot").alias("pivot")).distinct()


def _meet_before(key: int, keys: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which members of two blocks share a key below `key`; `keys` has each side's member ends and sorted keys."""
    sides = []
    for ends, flat in keys:
        owner = np.searchsorted(ends, np.arange(len(flat)), "right")
        below = flat < key
        sides.append((len(ends), owner[below], flat[below]))
    met = np.zeros((sides[0][0], sides[1][0]), bool)
    common = np.intersect1d(sides[0][2], sides[1][2])
    for begun in range(0, len(common), 2048):
        part, held = common[begun : begun + 2048], []
        for n, owner, flat in sides:
            at = np.searchsorted(part, flat)
            known = part[np.minimum(at, len(part) - 1)] == flat
            held.append(np.zeros((n, len(part)), np.float32))
            held[-1][owner[known], at[known]] = 1
        met |= held[0] @ held[1].T > 0
    return met


def _within_bound(blocks: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, pivot, bound): the pairs of different components in two blocks, or in one, whose edit
    distance can be within the band, and its lower bound as a share of the longer.

    Pairs that meet under several keys are compared under the least of them.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, others, bounds = [], [], []
            for row in range(batch.num_rows):
                side, keys = [], []
                for name in ("", "other_"):
                    column = batch.column(name + "members")
                    members = column.values.slice(column.offsets[row].as_py(), column.offsets[row + 1].as_py() - column.offsets[row].as_py())
                    ids, labels, sizes = (members.field(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "label", "n"))
                    fine = np.frombuffer(b"".join(members.field("counts").to_pylist()), np.uint8).reshape(-1, FINE)
                    counts = np.minimum(fine.reshape(-1, FINE // BINS, BINS).sum(axis=1, dtype=np.uint16), 255).astype(np.uint8)
                    lists = members.field("keys")
                    side.append((ids, labels, sizes, counts, fine))
                    keys.append((np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()))
                (ids, labels, sizes, counts, fine), (ids2, labels2, sizes2, counts2, fine2) = side
                if min(labels.min(), labels2.min()) == max(labels.max(), labels2.max()):
                    continue
                same = batch.column("same")[row].as_py()
                apart = ~_meet_before(batch.column("key")[row].as_py(), keys)
                for i in np.flatnonzero(apart.any(axis=1)).tolist():
                    longer = np.maximum(sizes2, sizes[i])
                    most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
                    at = apart[i] & (labels2 != labels[i]) & (np.abs(sizes2 - sizes[i]) <= most)
                    if same:
                        at &= ids2 > ids[i]
                    at = np.flatnonzero(at)
                    at = at[_least_distances(counts2[at], sizes2[at], counts[i], sizes[i]) <= most[at]]
                    if not len(at):
                        continue
                    least = _least_distances(fine2[at], sizes2[at], fine[i], sizes[i])
                    fits = least <= most[at]
                    at = at[fits]
                    docs.append(np.maximum(ids2[at], ids[i]))
                    others.append(np.minimum(ids2[at], ids[i]))
                    bounds.append(least[fits] / longer[at])
            flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((docs, np.int64), (others, np.int64), (bounds, np.float64))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["doc_id", "pivot", "bound"])

    return blocks.mapInArrow(released(compare), "doc_id long, pivot long, bound double")


def _block_pairs(groups: DataFrame, labels: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(key, members, other_members, same): blocks of documents of united groups, of which some pair may be alike
    and is in different components `labels` (doc_id, label). Every such pair is in some row. `key` is from here
    on the document of the least hash in each of the groups united."""
    rows = groups.select("key", "doc_id").join(labels, "doc_id")
    found = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.expr("bit_xor(xxhash64(doc_id))").alias("set"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.expr("min(struct(xxhash64(doc_id, 11), doc_id)).doc_id").alias("least"),
    )
    # Groups of the same documents need comparing once.
    open_keys = found.where("lo < hi").groupBy("size", "set").agg(F.min(F.struct("key", "least")).alias("one")).select("one.*")
    # Texts whose lengths differ by no more than the band are in one class of lengths or in two next ones.
    level = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    rows = rows.join(open_keys, "key").select(F.col("least").alias("key"), "doc_id", "label").distinct()
    rows = checkpointed(rows.join(words.select("doc_id", level.alias("level")), "doc_id"))
    keys = rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    sizes = rows.groupBy("key", "level").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    below = sizes.select("key", (F.col("level") + 1).alias("level"), F.col("blocks").alias("blocks_below"))
    sizes = sizes.join(below, ["key", "level"], "left")
    rows = rows.join(sizes, ["key", "level"]).withColumn("block", F.expr("pmod(xxhash64(doc_id, 5), blocks)").cast("int"))
    rows = rows.join(words.select("doc_id", "n", "counts"), "doc_id").join(keys, "doc_id")
    blocks = rows.groupBy("key", "level", "block").agg(
        F.collect_list(F.struct("doc_id", "label", "n", "counts", "keys")).alias("members"), F.first("blocks").alias("blocks"), F.first("blocks_below").alias("below")
    )
    blocks = checkpointed(blocks)
    meets = (
        "concat(transform(sequence(0, block), b -> struct(level, b AS block)),"
        " if(below IS NULL, array(), transform(sequence(0, coalesce(below, 1) - 1), b -> struct(level - 1 AS level, b AS block))))"
    )
    others = blocks.select("key", F.col("level").alias("own"), F.col("block").alias("own_block"), F.col("members").alias("other_members"), F.explode(F.expr(meets)).alias("at"))
    others = others.select("key", "at.level", "at.block", "own", "own_block", "other_members")
    pairs = blocks.select("key", "level", "block", "members").join(others, ["key", "level", "block"])
    same = (F.col("own") == F.col("level")) & (F.col("own_block") == F.col("block"))
    return pairs.select("key", "members", "other_members", same.alias("same")).where("NOT same OR size(members) > 1")


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (doc_id, pivot) whose edit similarity reaches `similarity`."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column("words").to_pylist(), batch.column("pivot_words").to_pylist())):
                a, b = np.frombuffer(x, "<u4").tolist(), np.frombuffer(y, "<u4").tolist()
                longer = max(len(a), len(b))
                if distance_within(a, b, int((1 - similarity) * longer + 1e-9)) is not None:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept, pa.int64())), batch.column("pivot").take(pa.array(kept, pa.int64()))], ["doc_id", "pivot"])

    pivots = words.select(F.col("doc_id").alias("pivot"), F.col("words").alias("pivot_words"))
    joined = pairs.join(words.select("doc_id", "words"), "doc_id").join(pivots, "pivot").select("doc_id", "pivot", "words", "pivot_words")
    return joined.mapInArrow(released(align), "doc_id long, pivot long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the least node that links (a, b) connect each of `nodes` (node) to.

    Every round each node steps to its least neighbour, and on to that one's, if those are less; the
    links are then drawn between the places reached, and only those between different places stay.
    """
    labels = nodes.select("node", F.col("node").alias("label"))
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("to"))
        first = checkpointed(first)
        second = first.select(F.col("a").alias("to"), F.col("to").alias("further"))
        steps = checkpointed(first.join(second, "to").select("a", F.col("further").alias("to")))
        labels = labels.join(steps.select(F.col("a").alias("label"), "to"), "label", "left")
        labels = checkpointed(labels.select("node", F.coalesce("to", "label").alias("label")))
        moved = edges.join(steps.withColumnRenamed("to", "x"), "a").select("x", "b")
        moved = moved.join(steps.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        edges = checkpointed(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return labels


def _text_key(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _text_classes(docs: DataFrame, similarity: float) -> DataFrame:
    """Per distinct (doc_id, text_key): class_id, copy_of and kept. Texts are what is compared, whatever their ids."""
    rows = id_and_text(docs).withColumn("text_key", _text_key("text"))
    keyed = rows.select("doc_id", "text_key").distinct()
    # Every distinct text is a node; the number is written, so it stays. From here on `doc_id` is that number.
    least = keyed.groupBy("text_key").agg(F.min("doc_id").alias("copy_of"))
    firsts = checkpointed(least.withColumn("node", F.monotonically_increasing_id()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                _, words = word_hashes(np.frombuffer(text, np.uint8), ignore_case=True)
                if len(words):
                    held.append(i)
                    found.append(keys_of(words, similarity))
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            held = pa.array(held, pa.int64())
            columns = [batch.column("doc_id").take(held), batch.column("text_key").take(held), keys]
            yield pa.RecordBatch.from_arrays(columns, ["copy_of", "text_key", "keys"])

    sketched = rows.mapInArrow(released(sketch), "copy_of long, text_key binary, keys array<long>").join(firsts, ["copy_of", "text_key"])
    sketched = sketched.dropDuplicates(["copy_of", "text_key"])
    groups = checkpointed(_groups(sketched.select(F.col("node").alias("doc_id"), F.explode("keys").alias("key"))))
    paired = groups.select("doc_id").distinct()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_hashes(np.frombuffer(t, np.uint8), True)[1] for t in batch.column("text").to_pylist()]
            columns = {"words": pa.array([w.astype("<u4").tobytes() for w in found], pa.binary()), "n": pa.array(map(len, found), pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns, "counts": pa.array(map(word_counts, found), pa.binary())})

    wanted = firsts.join(paired.withColumnRenamed("doc_id", "node"), "node", "left_semi")
    texts = rows.join(wanted.withColumnRenamed("copy_of", "doc_id"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    texts = texts.select(F.col("node").alias("doc_id"), "text")
    words = checkpointed(texts.mapInArrow(released(words_of), "doc_id long, words binary, n long, counts binary"))

    nodes = checkpointed(paired.select(F.col("doc_id").alias("node")))
    links, tested, found = None, None, nodes.select("node", F.col("node").alias("label"))
    for _ in range(PIVOT_ROUNDS):  # these join most of each family; all that still stands apart is compared group by group
        near = checkpointed(_best_pivots(groups, found, tested))
        if near.isEmpty():
            break
        tested = near if tested is None else tested.union(near)
        kept = checkpointed(_verified(near, words, similarity))
        links = kept if links is None else links.union(kept)
        found = components(nodes, links.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))
    pairs = _block_pairs(groups, found.select(F.col("node").alias("doc_id"), "label"), words, similarity)
    left = _within_bound(pairs, similarity).groupBy("doc_id", "pivot").agg(F.min("bound").alias("bound"))
    left = checkpointed(left if tested is None else left.join(tested, ["doc_id", "pivot"], "left_anti"))
    for share in (0.5, 0.75, None):  # the closest first; the last round takes all that is left
        own, other = found.select(F.col("node").alias("doc_id"), F.col("label").alias("x")), found.select(F.col("node").alias("pivot"), F.col("label").alias("y"))
        left = checkpointed(left.join(own, "doc_id").join(other, "pivot").where("x != y").drop("x", "y"))
        near = left if share is None else left.where(F.col("bound") <= share * (1 - similarity))
        if near.isEmpty():
            continue
        kept = checkpointed(_verified(near.select("doc_id", "pivot"), words, similarity))
        links = kept if links is None else links.union(kept)
        found = components(nodes, links.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))
        left = left.join(near, ["doc_id", "pivot"], "left_anti")

    labelled = checkpointed(firsts.join(found, "node", "left").select("text_key", "copy_of", F.coalesce("label", "node").alias("label")))
    heads = labelled.groupBy("label").agg(F.min(F.struct("copy_of", "text_key")).alias("head"))
    of_text = labelled.join(heads, "label").select("text_key", "copy_of", "head")
    return keyed.join(of_text, "text_key").select(
        "doc_id", "text_key", F.col("head.copy_of").alias("class_id"), "copy_of",
        ((F.col("doc_id") == F.col("head.copy_of")) & (F.col("text_key") == F.col("head.text_key"))).alias("kept"),
    )


def find_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Per document: doc_id, class_id (the least id of its class), copy_of (the least id with the same
    text) and kept (whether it is its class's document).

    An id with several texts has one row: its least class and copy, kept if any of its texts is.
    """
    found = _text_classes(docs, similarity).groupBy("doc_id")
    return found.agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of"), F.bool_or("kept").alias("kept"))


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stand for their class of near-duplicates, one a class, all columns kept.

    Rows are told apart by id and text, so a repeated id loses no text that is the only one of its class.
    """
    kept = _text_classes(docs, similarity).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*docs.columns).alias("rest"), F.col("doc_id").cast("long").alias("row_id"), text.alias("row_text"))
    rows = rows.withColumn("row_key", _text_key("row_text")).drop("row_text")
    found = rows.join(kept, (F.col("row_id") == F.col("kept_id")) & (F.col("row_key") == F.col("kept_key")), "left_semi")
    return found.dropDuplicates(["row_id", "row_key"]).select(*[F.col("rest").getField(c).alias(c) for c in docs.columns])
