"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations alone.

A shingle is five words; words are runs of letters and digits, lower-cased. A document window as
long as a benchmark item (in words) matches it if the weighted Jaccard similarity of their shingles,
weights being counts, is at least 0.8. A document of fewer words than the item is one window.

1. Windows. A window of that similarity shares at least 8/9 of its shingles with the item; moved on
   to the first of them (or to the document's end) it is no less similar. So only windows that begin
   at a shingle of an item of that length, or at the last place that holds the window, and that hold
   enough such shingles are formed. No similar window is lost. A shorter document is formed whole, for
   the items of each length, if it has that share of their shingles.
2. Fingerprints. Each window and item gets a 64-bit SimHash of its shingles.
3. Multi-index search. Fingerprints are cut into 8 blocks of 8 bits. Two fingerprints that differ in
   at most 23 bits differ in at most 2 bits within some block, so items are listed under every value
   within 2 bits of each block, and windows look up their own blocks, among items of their length:
   all pairs within the radius are found. At similarity 0.8 fingerprints differ in 9.7 bits on
   average with a deviation of 2.9, so a radius of 23 leaves out two pairs in a million at worst.
4. Verification. The similarity of the candidates is computed exactly from the shingles' counts.

Items of fewer than five words have no shingle and match nothing; null and empty texts, and empty
tables, give no rows. Rows with the same id and text count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
#: Shingles of the benchmark (16 bytes each) up to which they are broadcast; more are joined by shuffling.
BROADCAST_SHINGLES = 1_000_000


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _with_shingles(rows: DataFrame) -> DataFrame:
    """`rows` with `n` words and the hashes of all five-word shingles, in order.

    The words are bound as the element of a one-element array: wherever the optimizer moves the
    expression, a text is split once and not once a shingle.
    """
    args = ", ".join(f"ws[i + {k}]" for k in range(1, WORDS))
    made = f"transform(slice(ws, 1, greatest(size(ws) - {WORDS - 1}, 0)), (w, i) -> xxhash64(w, {args}))"
    rows = rows.withColumn("bound", F.array(_words("text")))
    rows = rows.withColumn("both", F.expr(f"transform(bound, ws -> struct(size(ws) AS n, {made} AS shingles))[0]"))
    return rows.withColumns({"n": F.col("both.n"), "shingles": F.col("both.shingles")}).drop("bound", "both", "text")


def _fingerprint(shingles: str) -> Column:
    """The blocks of the SimHash: bit b is set where most shingles, counted with repeats, have it set."""
    bit = f"aggregate({shingles}, 0, (a, h) -> a + 2 * int(getbit(h, b)) - 1) > 0"
    block = f"aggregate(sequence(0, {BLOCK_BITS - 1}), 0, (v, k) -> v + if(bits[{BLOCK_BITS} * j + k], shiftleft(1, k), 0))"
    return F.expr(
        f"transform(array(transform(sequence(0, {BLOCKS * BLOCK_BITS - 1}), b -> {bit})),"
        f" bits -> transform(sequence(0, {BLOCKS - 1}), j -> {block}))[0]"
    )


def _similarity() -> Column:
    common = (
        "aggregate(array_distinct(window), 0, (a, x) -> a + least(size(filter(window, y -> y = x)),"
        " size(filter(item, y -> y = x))))"
    )
    return F.expr(f"transform(array({common}), c -> c / (size(window) + size(item) - c))[0]")


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Pairs of a document and an item it holds: doc_id, item_id, similarity, start_word, n_words.

    One row a pair: the most similar window, the first of equals, over all texts of the id.
    """
    best = _matching_windows(docs, benchmark, similarity).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"),
        (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"),
    )


def _matching_windows(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """doc_id, text_key, item_id and `best` (similarity, back, n_words) of all windows that match an item."""
    share = similarity / (1 + similarity)  # of a window's and an item's shingles, in common at that similarity
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), _text_key("text").alias("text_key"), "text"
    )
    items = _with_shingles(benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")).where(F.col("n") >= WORDS)
    known = items.select(F.explode("shingles").alias("shingle"), F.col("n").alias("length")).distinct()
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)

    places = _with_shingles(texts).select("doc_id", "text_key", "n", F.posexplode_outer("shingles").alias("place", "shingle"))
    enough = F.col("n") - WORDS + 1 >= F.lit(similarity) * (F.col("length") - WORDS + 1) - 1e-9
    hits = places.join(known, "shingle").where(enough)
    hits = hits.groupBy("doc_id", "text_key", "n", "length").agg(F.sort_array(F.collect_set("place")).alias("p"))
    hits = hits.withColumn("t", F.ceil(F.lit(share) * (F.least("n", "length") + F.col("length") - 2 * (WORDS - 1)) - 1e-9).cast("int"))
    begin = f"filter(p, (x, i) -> x <= n - length AND get(p, i + t - 1) <= x + length - {WORDS})"
    last = "if(size(p) >= t AND p[size(p) - t] >= n - length, array(n - length), array())"
    whole = "if(size(p) >= t, array(0), array())"
    hits = hits.withColumn("starts", F.expr(f"if(n < length, {whole}, array_distinct(concat({begin}, {last})))")).where("size(starts) > 0")

    held = _with_shingles(texts.join(hits.select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_semi"))
    held = held.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "shingles")
    windows = held.join(hits.select("doc_id", "text_key", "length", "starts"), ["doc_id", "text_key"])
    windows = windows.withColumn("start", F.explode("starts")).select(
        "doc_id", "text_key", "length", "start", F.expr(f"slice(shingles, start + 1, length - {WORDS - 1})").alias("window")
    )
    windows = windows.withColumn("print", _fingerprint("window"))

    items = items.select("item_id", F.col("n").alias("length"), F.col("shingles").alias("item"), _fingerprint("shingles").alias("item_print"))
    near = [v for v in range(1 << BLOCK_BITS) if v.bit_count() <= RADIUS // BLOCKS]
    listed = items.select("*", F.posexplode("item_print").alias("block", "own")).withColumn(
        "value", F.explode(F.transform(F.array(*map(F.lit, near)), lambda v: v.bitwiseXOR(F.col("own"))))
    )
    looked = windows.select("*", F.posexplode("print").alias("block", "value"))
    pairs = looked.join(listed, ["length", "block", "value"])
    apart = "aggregate(zip_with(print, item_print, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)"
    pairs = pairs.where(F.expr(f"{apart} <= {RADIUS}"))
    # A pair found under several blocks is verified once: under the first block that lists it.
    first = f"array_position(zip_with(print, item_print, (x, y) -> bit_count(x ^ y) <= {RADIUS // BLOCKS}), true) - 1"
    pairs = pairs.where(F.expr(f"block = {first}")).withColumn("similarity", _similarity())
    best = F.struct("similarity", (-F.col("start")).alias("back"), (F.size("window") + WORDS - 1).alias("n_words"))
    return pairs.where(F.col("similarity") >= similarity).select("doc_id", "text_key", "item_id", best.alias("best"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item, all columns kept.

    Every row is judged by its own text, also where an id has several.
    """
    found = _matching_windows(docs, benchmark, similarity).select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")
    ).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("rest"), F.col("doc_id").cast("long").alias("row_id"), _text_key("text").alias("row_key"))
    clean = rows.join(found, (F.col("row_id") == F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")), "left_anti")
    return clean.select(*[F.col("rest").getField(c).alias(c) for c in docs.columns])


#: The same result for DuckDB: every window that begins at an item's shingle, or ends the text, compared in full; a shorter text whole.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
ds AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 3),
       lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) AS s FROM dw WHERE len(w) >= 5),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) AS len, list_transform(range(1, len(w) - 3),
       lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) AS s FROM bw WHERE len(w) >= 5),
known AS (SELECT DISTINCT item_id, len, unnest(s) AS g FROM bs),
dp AS (SELECT doc_id, n, unnest(s) AS g, unnest(range(0, len(s))) AS place FROM ds),
c AS (SELECT DISTINCT doc_id, item_id, len, least(n, len) AS size, greatest(least(place, n - len), 0) AS start FROM dp JOIN known USING (g)),
wg AS (SELECT doc_id, item_id, len, size, start, unnest(ds.s[start + 1 : start + size - 4]) AS g FROM c JOIN ds USING (doc_id)),
wc AS (SELECT doc_id, item_id, len, size, start, g, count(*) AS a FROM wg GROUP BY ALL),
ig AS (SELECT item_id, unnest(s) AS g FROM bs),
ic AS (SELECT item_id, g, count(*) AS b FROM ig GROUP BY ALL),
m AS (SELECT doc_id, wc.item_id, len, size, start, sum(least(a, b)) AS common FROM wc JOIN ic ON ic.item_id = wc.item_id AND ic.g = wc.g GROUP BY ALL),
sim AS (SELECT *, common / (size + len - 8.0 - common) AS similarity FROM m)
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(start AS BIGINT) AS start_word, CAST(size AS BIGINT) AS n_words
FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
