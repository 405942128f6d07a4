"""Entity mentions by gazetteer or by a tagger hook, and entity figures.

A gazetteer has the columns `phrase` and `label`; a phrase may have any number of blank-separated
words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import text as T
from tidewatch.session import checkpointed

TAGGER_BATCH = 64  # texts a tagger gets at a time
MENTION_SCHEMA = "text string, label string, start_char int, end_char int"
_EDGE = " \t\n.,;:!?"
MAX_NAMES = 200_000  # phrases a trie holds


def tagged_text(posts: DataFrame) -> DataFrame:
    """Post id and the text that offsets refer to: hashtags dropped, case kept."""
    text = T.ner_text(T.decode_entities(T.without_hashtags(F.col("original_text"))))
    return posts.select("post_id", text.alias("text"))


def _trimmed(phrase: Column) -> Column:
    return F.btrim(phrase, F.lit(_EDGE))


def phrase_trie(names: list[tuple[str, str]]) -> dict:
    """Phrases by their words: a node maps the next word to its node, and None to the labels of a phrase that ends."""
    root: dict = {}
    for key, label in names:
        if key != key.strip(_EDGE):
            continue  # mentions never begin or end with a mark
        node = root
        for word in key.split(" "):
            node = node.setdefault(word, {})
        node.setdefault(None, []).append(label)
    return root


def gazetteer_candidates(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Every word run that is a gazetteer phrase, overlaps included.

    Texts are walked through a trie of the phrases, in Arrow batches, where they lie. The trie is
    broadcast; a gazetteer of more than `MAX_NAMES` phrases is cut into several by a hash of the phrases' first
    words, and the texts are walked once for each.
    """
    names = gazetteer.where("phrase IS NOT NULL").select(
        F.lower(T.collapse_space(F.col("phrase"))).alias("key"), "label"
    ).distinct()
    names = checkpointed(names)
    parts = max(1, -(-names.count() // MAX_NAMES))
    part = F.pmod(F.xxhash64(F.substring_index("key", " ", 1)), F.lit(parts))
    kind = dict(texts.dtypes)["post_id"]
    # Null texts are passed over by the walk: a filter would compute the texts a second time to test them.
    shown = texts.select("post_id", "text", F.lower("text").alias("lowered"))
    found = None
    for number in range(parts):
        rows = names.where(part == number).collect()  # some MAX_NAMES phrases
        trie = texts.sparkSession.sparkContext.broadcast(phrase_trie([(r["key"], r["label"]) for r in rows]))
        walked = shown.mapInArrow(_walk(trie), f"post_id {kind}, {MENTION_SCHEMA}")
        found = walked if found is None else found.union(walked)
    return found


def _walk(trie):
    """The function of a task. It refers to nothing of this package, so that workers need not find it."""

    def candidates(root: dict, text: str, lowered: str) -> list[tuple[str, str, int, int]]:
        """(text, label, start, end) of every run of words that is a phrase: its first word without the
        marks before it, its last without those behind it."""
        words, lower, found, begun = text.split(" "), lowered.split(" "), [], 0
        if len(words) != len(lower):
            return found
        for i, word in enumerate(words):
            start = begun + len(word) - len(word.lstrip(_EDGE))
            node, end, j, token = root, begun + len(word), i, lower[i].lstrip(_EDGE)
            while True:
                ends = node.get(token.rstrip(_EDGE))
                if ends and None in ends:
                    stop = end - (len(words[j]) - len(words[j].rstrip(_EDGE)))
                    found += [(text[start:stop], label, start, stop) for label in ends[None]]
                node, j = node.get(token), j + 1
                if not node or j == len(words):
                    break
                end, token = end + 1 + len(words[j]), lower[j]
            begun += len(word) + 1
        return found

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (text, lowered) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lowered").to_pylist())):
                found = [] if text is None else candidates(trie.value, text, lowered)
                at += [i] * len(found)
                rows += found
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("post_id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["post_id", "text", "label", "start_char", "end_char"],
            )

    return walk


def longest_matches(candidates: DataFrame) -> DataFrame:
    """Left to right, the longest candidate that starts after the last one taken.

    Labels of one span are kept together. The candidates of one post are few: each is a name in it.
    """
    spans = candidates.groupBy("post_id", "start_char", "end_char").agg(
        F.array_sort(F.collect_set(F.struct("label", "text"))).alias("names")
    )
    entry = F.struct(
        "start_char", (-F.col("end_char")).alias("minus_end"), "end_char", "names"
    )
    ordered = spans.groupBy("post_id").agg(F.array_sort(F.collect_list(entry)).alias("spans"))
    kind = "array<struct<start_char:int,end_char:int,names:array<struct<label:string,text:string>>>>"
    taken = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("taken")),
        lambda s, e: F.when(
            e["start_char"] >= s["free"],
            F.struct(
                e["end_char"].alias("free"),
                F.concat(
                    s["taken"],
                    F.array(
                        F.struct(
                            e["start_char"].alias("start_char"),
                            e["end_char"].alias("end_char"),
                            e["names"].alias("names"),
                        )
                    ),
                ).alias("taken"),
            ),
        ).otherwise(s),
        lambda s: s["taken"],
    )
    return (
        ordered.select("post_id", F.explode(taken).alias("e"))
        .select("post_id", "e.start_char", "e.end_char", F.explode("e.names").alias("n"))
        .select("post_id", "n.text", "n.label", "start_char", "end_char")
    )


def accepted_mentions(found: DataFrame) -> DataFrame:
    """Mentions that pass the entity rules, each (key, label, start) once."""
    text = _trimmed(T.collapse_space(F.col("text")))
    cased = found.withColumns({"text": text, "normalized_text": F.lower(text)})
    all_lower = (F.col("text") == F.lower("text")) & (F.col("text") != F.upper("text"))
    kept = cased.where(
        F.col("label").isin(*V.ENTITY_LABELS)
        & (F.length("text") >= 2)
        & ~F.col("normalized_text").isin(*V.GENERIC_ENTITIES)
        & ~((F.col("label") == "PERSON") & all_lower)
        & F.col("text").rlike(r"\p{L}")
    )
    return kept.select(
        "post_id", "text", "normalized_text", "label", "start_char", "end_char"
    ).dropDuplicates(["post_id", "normalized_text", "label", "start_char"])


def gazetteer_mentions(posts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Accepted mentions of the posts."""
    return accepted_mentions(
        longest_matches(gazetteer_candidates(tagged_text(posts), gazetteer))
    )


def tag_with(posts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple]]]]) -> DataFrame:
    """Accepted mentions of any tagger that gets up to 64 texts at a time and returns a list of
    (text, label, start, end) for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = load()
        for frame in frames:
            rows = []
            for a in range(0, len(frame), TAGGER_BATCH):
                part = frame.iloc[a : a + TAGGER_BATCH]
                for post_id, mentions in zip(part["post_id"], tagger(part["text"].tolist())):
                    rows += [(post_id, *mention) for mention in mentions]
            names = ["post_id", "text", "label", "start_char", "end_char"]
            yield pd.DataFrame(rows, columns=names)

    key = dict(posts.dtypes)["post_id"]
    found = tagged_text(posts).mapInPandas(run, f"post_id {key}, {MENTION_SCHEMA}")
    return accepted_mentions(found)


def entity_table(mentions: DataFrame) -> DataFrame:
    """Frequency per (normalized text, label); shown as first seen in time.

    `mentions` carries `timestamp`.
    """
    return mentions.groupBy("normalized_text", "label").agg(
        F.min_by("text", F.struct("timestamp", "post_id", "start_char")).alias("text"),
        F.count(F.lit(1)).alias("frequency"),
    )


def totals_by_label(entities: DataFrame) -> DataFrame:
    """Frequency sum per label over all entities, whatever label a listing shows."""
    return entities.groupBy("label").agg(F.sum("frequency").alias("frequency"))


def mention_counts(entities: DataFrame, post_entities: DataFrame, posts: DataFrame) -> DataFrame:
    """Mentions per entity within the given posts. `entity_id` links the first two tables."""
    counted = (
        post_entities.join(posts.select("post_id"), "post_id", "left_semi")
        .groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    return counted.join(entities.select("entity_id", "text", "label"), "entity_id").select(
        "entity_id", "text", "label", "frequency"
    )
