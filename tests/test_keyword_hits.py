"""Terms counted within a document, against plain loops; marks, white space and vectors without numbers."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators.keywords import _hits
from tidewatch.operators.topics import discover_topics

TERMS = ["aaa", "bbb ccc", "ddd", "aaa aaa"]


def plain(words):
    found = [w for w in words if w in TERMS] + [f"{a} {b}" for a, b in zip(words, words[1:]) if f"{a} {b}" in TERMS]
    return {t: found.count(t) for t in found}


def test_hits_of_a_document_are_counted_once_a_term():
    rng = random.Random(3)
    words = ["aaa", "bbb", "ccc", "ddd"]
    tokens = [[rng.choice(words) for _ in range(rng.randrange(7))] for _ in range(50)]
    raw = ["x ".join(rng.choice(words) + rng.choice([" ", "\x1c", "\n ", "　"]) for _ in range(rng.randrange(7))) for _ in range(50)]
    whole = pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array([r.encode() for r in raw], pa.binary())], ["tokens", "raw"])
    for batch in (whole, whole.slice(7, 20), whole.slice(0, 0)):
        found = next(_hits(TERMS)(iter([batch])))
        assert found.num_rows == batch.num_rows
        for i in range(batch.num_rows):
            assert {h["term"]: h["n"] for h in found["hits"][i].as_py()} == plain(batch["tokens"][i].as_py())
            assert {h["term"]: h["n"] for h in found["raw_hits"][i].as_py()} == plain(batch["raw"][i].as_py().decode().split())


def test_marks_and_white_space(spark):
    assert T.MENTION.startswith("@") and T.HASHTAG.startswith("#")
    texts = ["@a x@b _@c é@d (@f) @g-h @é @@i", "#a x#b _#c é#d (#f) ##g", "a \n b　\x1cc  d\te\xa0 "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", T.extract_mentions(F.col("t")), T.extract_hashtags(F.col("t")), T._single_blanks(F.col("t"))).orderBy("i").collect()
    assert found[0][1] == ["a", "f", "g", "i"] and found[1][2] == ["a", "f", "g"] and found[2][3] == "a b c d e "


def test_vectors_without_numbers_are_outliers(spark):
    """Null vectors lie among others of their batch and get no cell; the others keep theirs."""
    vectors = [[1.0, 0.0], [0.0, 1.0]] * 40
    rows = [(i, None if i % 10 == 3 else [0.0, 0.0] if i % 10 == 4 else v) for i, v in enumerate(vectors)]
    found = discover_topics(spark.createDataFrame(rows, "post_id int, embedding array<float>")).collect()
    topics = {r["post_id"]: r["topic_index"] for r in found}
    assert len(topics) == len(rows) and {t for i, t in topics.items() if i % 10 in (3, 4)} == {-1}
    sides = [{t for i, t in topics.items() if i % 2 == side and i % 10 not in (3, 4)} for side in (0, 1)]
    assert all(len(s) == 1 for s in sides) and sides[0] != sides[1] and -1 not in sides[0] | sides[1]
