import hashlib
import html
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import text as T
from tidewatch.functions.naming import topic_name
from tidewatch.plans.preprocess import preprocess, preprocessing_summary


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*columns).first()


def test_tags_keep_the_first_casing(spark):
    row = one(spark, "#AI and #ai #ML mail@x.org @Bob @BOB a#no", T.extract_hashtags(F.col("text")), T.extract_mentions(F.col("text")))
    assert row[0] == ["AI", "ML"] and row[1] == ["Bob"]


def test_urls(spark):
    text = "see https://a.org/x(1), http://a.org/x. www.b.com/y! again https://a.org/x(1) and c.io/z d.io/zz"
    assert one(spark, text, T.extract_urls(F.col("text")))[0] == ["https://a.org/x(1)", "http://a.org/x", "www.b.com/y", "d.io/zz"]
    assert one(spark, "no link here", T.extract_urls(F.col("text")))[0] == []


def test_representations(spark):
    text = "Tom &amp; @Jerry LOVE #Cheese!!!!! see https://t.co/a\n\n now"
    decoded = T.decode_entities(F.col("text"))
    row = one(spark, text, T.cleaned(decoded), T.sentiment_ready(decoded), T.ner_text(decoded))
    assert row[0] == "tom & love cheese! see now"
    assert row[1] == "Tom & @user LOVE #Cheese! see http now"
    assert row[2] == "Tom & @Jerry LOVE Cheese! see now"


def test_long_junk_stays_cheap(spark):
    """Unclosed and repeated parentheses, and punctuation without an end."""
    for text in ("http://" + "!" * 40000, "http://" + "(a)" * 15000, "http://" + "((" * 20000):
        assert one(spark, text, F.size(T.extract_urls(F.col("text"))))[0] <= 1


def test_patterns_against_python(spark):
    """Random texts through the reference semantics written with Python's `re`."""
    random.seed(5)
    pieces = ["@", "#", "ab", "AB", "é", "_", "1", " ", "x" * 30, "\n", "-", "@user", "#Tag", " ", " ", "!!!", "..."]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 14))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", T.extract_mentions(F.col("text")).alias("m"), T.collapse_space(F.col("text")).alias("c"), T.text_hash(F.col("text")).alias("h"),
        T.collapse_punctuation(F.col("text")).alias("p"), T.import_hashtags(F.col("text")).alias("i"),
    )
    for r in frame.collect():
        names, seen = [], set()
        for m in re.findall(r"(?<!\w)@([a-zA-Z0-9_]{1,50})\b", r["text"]):
            if m.lower() not in seen:
                names.append(m)
                seen.add(m.lower())
        assert r["m"] == names
        assert r["c"] == re.sub(r"\s+", " ", r["text"]).strip()
        assert r["p"] == re.sub(r"([!?.,;])\1{2,}", r"\1", r["text"])
        assert r["i"] == [m.lower() for m in re.findall(r"#(\w+)", r["text"])]
        canonical = re.sub(r"\s+", " ", r["text"].strip().lower())
        assert r["h"] == hashlib.sha256(canonical.encode()).hexdigest()


def test_entities_decode_like_python(spark):
    texts = ["a &lt;b&gt; &eacute; &#8364; &copy &unknown; &amp;amp;", "no mark", "", None]
    pick = random.Random(4)
    parts = ["&", "&amp", ";", "&#", "x", "X", "0", "00", "41", "8364", "128512", "D800", "110000", "99999999999", "fdd0", "129", "1", "13", "lt", "&notit;",
             "&NotEqualTilde;", "&copy", "&ampere", " ", "\n", "é", "#", "&#x80;", "&#11;", "&#127;", "&#xFFFE;", "&#x1F600", "&nbsp;", "&acE;", "&fjlig;"]
    texts += ["".join(pick.choice(parts) for _ in range(pick.randint(1, 9))) for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
    rows = frame.select("id", T.decode_entities(F.col("text")).alias("d")).collect()
    for r in rows:
        assert r["d"] == (None if texts[r["id"]] is None else html.unescape(texts[r["id"]])), texts[r["id"]]


def test_keyword_tokens(spark):
    row = one(spark, "The quick été abc'def foo_bar it 3d x2y", T.keyword_tokens(F.col("text")), T.topic_tokens(F.col("text")))
    assert row[0] == ["quick", "abc", "def"]
    assert row[1] == ["quick", "été", "abc", "def", "foo_bar", "3d", "x2y"]


def test_preprocessing(spark):
    rows = [
        (1, "Great #AI news by @researcher https://ai.org !!!!", "2026-01-01 00:00:00", ["ai"]),
        (2, "great  #ai NEWS by @researcher https://ai.org !!!!", "2026-01-02 00:00:00", None),
        (3, None, "2026-01-03 00:00:00", None),
    ]
    posts = spark.createDataFrame(rows, "post_id int, original_text string, t string, hashtags array<string>").withColumn(
        "timestamp", F.to_timestamp("t")
    )
    done = {r["post_id"]: r for r in preprocess(posts).collect()}
    assert done[1]["hashtags"] == ["ai", "AI"] and done[1]["mentions"] == ["researcher"]
    assert done[1]["urls"] == ["https://ai.org"] and done[1]["cleaned_text"] == "great ai news by !"
    assert [done[i]["is_duplicate"] for i in (1, 2, 3)] == [False, True, False]
    assert done[3]["cleaned_text"] == "" and done[1]["preprocessing_meta"]["version"] == "1.0.0"
    summary = preprocessing_summary(preprocess(posts)).first()
    assert (summary["posts_processed"], summary["duplicates_count"], summary["total_hashtags"]) == (3, 1, 2)
    again = preprocess(preprocess(posts)).select("post_id", "cleaned_text", "hashtags").collect()
    assert {r["post_id"]: (r["cleaned_text"], r["hashtags"]) for r in again} == {
        i: (r["cleaned_text"], r["hashtags"]) for i, r in done.items()
    }


@pytest.mark.parametrize(
    "words, index, expected",
    [
        (["solar", "panel"], 1, "Renewable Energy"),
        (["bitcoin", "price"], 2, "Crypto Markets"),
        (["crypto", "sec_rules"], 2, "Crypto Regulation"),
        (["olympics"], 3, "Sports Competition"),
        (["disease outbreak"], 3, "Public Health Crisis"),
        (["vaccine"], 3, "Public Health"),
        (["neural nets"], 4, "AI Model Development"),
        (["global warming"], 4, "Climate Change"),
        (["cats", "cat", "big-dogs", "bird"], 4, "Cats · Big Dogs"),
        (["they're"], 4, "They'Re"),
        ([], 7, "Topic 7"),
        (["solar"], -1, "Unclassified (Outliers)"),
    ],
)
def test_topic_names(spark, words, index, expected):
    frame = spark.createDataFrame([(words, index)], "words array<string>, i int")
    assert frame.select(topic_name(F.col("words"), F.col("i"))).first()[0] == expected


def test_urls_are_sought_between_blanks_and_hits_found_once(spark):
    text = "a  b\t\n c see\u00a0https://a.org/x(1) (www.b.com/y) d.io/zz!  -c.io/z #Ab #aB @Me @ME e.org/ http:// x "
    expected = ["https://a.org/x(1)", "www.b.com/y", "d.io/zz", "c.io/z"]
    row = one(spark, text, T.extract_urls(F.col("text")), T.collapse_space(F.col("text")), T.extract_hashtags(F.col("text")), T.extract_mentions(F.col("text")))
    assert row[0][:3] == expected[:3] and row[2] == ["Ab"] and row[3] == ["Me"]
    assert row[1] == re.sub(r"\s+", " ", text).strip()
    whole = F.regexp_extract_all(F.col("text"), F.lit(T.URL), F.lit(0))
    assert row[0] == list(dict.fromkeys(one(spark, text, whole)[0]))
    assert one(spark, text, T.ner_text(F.col("text")))[0] == re.sub(r"\s+", " ", one(spark, text, F.regexp_replace("text", T.URL, " "))[0].replace("#", "")).strip()
    posts = spark.createDataFrame([(text,)], "text string")
    for use in (T.extract_hashtags, T.extract_mentions, T.cleaned):
        plan = posts.select(use(F.concat("text", F.lit("x"))).alias("found")).where("true")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("concat(") == 1


def test_blanks_of_any_runs(spark):
    """Runs of white space become one blank, whatever stands beside them; visible characters stay."""
    pick = random.Random(8)
    letters = [*V.SPACES, " ", " ", " ", "\n", "a", "!", "~", "é", "\x7f", "\x00", "​", "漢", "😀"]
    texts = ["", " ", "　", " \n", "a b", "a  b", "a\xa0b", *("".join(pick.choices(letters, k=pick.randint(1, 12))) for _ in range(400))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T._single_blanks(F.col("t")).alias("t"))
    assert {r.i: r.t for r in rows.collect()} == {i: re.sub(f"[{re.escape(V.SPACES)}]+", " ", t) for i, t in enumerate(texts)}
