import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.fixed_values import STOP_WORDS
from tidewatch.operators import entities as E
from tidewatch.operators import evaluation, filters, keywords, sentiment, topics
from tidewatch.plans import analysis, dashboard, enrichment, search
from tidewatch.plans import topics as topic_plans
from tidewatch.plans import trends as trend_plans
from tidewatch.plans.preprocess import preprocess
from tidewatch.sources import post_index
from tidewatch.sources.store import Store, dataset_listing

START = datetime(2026, 3, 2)


# --- keywords and hashtags ---
def brute_keywords(texts, top_n, max_features):
    import re

    docs = []
    for t in texts:
        words = [w for w in re.findall(r"\b[a-zA-Z]{3,}\b", t.lower()) if w not in STOP_WORDS]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    total = sum(docs, Counter())
    vocabulary = sorted(total, key=lambda w: (-total[w], w))[:max_features]
    df = {w: sum(w in d for d in docs) for w in vocabulary}
    mean = dict.fromkeys(vocabulary, 0.0)
    for d in docs:
        weights = {w: d[w] * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w in vocabulary if d[w]}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        for w, x in weights.items():
            mean[w] += x / norm / len(docs)
    raw = Counter()
    for t in texts:
        parts = t.split()
        raw.update(parts)
        raw.update(f"{a} {b}" for a, b in zip(parts, parts[1:]))
    best = sorted(vocabulary, key=lambda w: (-round(mean[w], 10), w))[:top_n]
    return [(w, "ngram" if " " in w else "keyword", raw.get(w, 1), round(mean[w], 4)) for w in best]


@pytest.mark.parametrize("features", [3, 12, 100, 5000])
def test_keywords_against_brute_force(spark, features):
    random.seed(features)
    common = ["solar", "energy", "the", "of", "quantum", "chip", "été", "ab", "new", "grid"]
    texts = [" ".join(random.choice(common + [f"w{chr(97 + i % 26)}x"]) for _ in range(random.randint(0, 30))) for i in range(120)]
    texts += ["solar energy grid"] * 60 + ["", "  "]
    found = keywords.extract_keywords(spark.createDataFrame([(t,) for t in texts], "text string"), 20, features)
    assert [tuple(r) for r in found.collect()] == brute_keywords(texts, 20, features)


def test_keyword_fallbacks(spark):
    assert keywords.extract_keywords(spark.createDataFrame([("",), (" ",), (None,)], "text string")).count() == 0
    rows = keywords.extract_keywords(spark.createDataFrame([("été12 été12 été34 abc1",)], "text string")).collect()
    assert [(r["keyword"], r["frequency"], r["tfidf_score"]) for r in rows] == [
        ("été12", 2, 0.1), ("abc1", 1, 0.1), ("été34", 1, 0.1),
    ]


def test_hashtag_growth(spark):
    tags = [["AI"], ["AI", "ml"], ["AI", "ai"], ["AI", "ai", ""]]
    rows = [(i, START + timedelta(days=i), t) for i, t in enumerate(tags)]
    posts = spark.createDataFrame(rows, "post_id int, timestamp timestamp, hashtags array<string>")
    early = F.col("post_id") < 2
    found = {r["hashtag"]: (r["frequency"], r["growth_rate"]) for r in keywords.hashtag_counts(posts, early).collect()}
    assert found == {"AI": (4, 0.0), "ai": (2, 1.0), "ml": (1, -1.0)}
    assert {r["growth_rate"] for r in keywords.hashtag_counts(posts).collect()} == {None}


# --- evaluation and sentiment ---
def test_evaluation(spark):
    pairs = [("positive", "positive"), ("negative", "Negative"), ("NEUTRAL", "positive"), ("positive", "positive"), (None, "neutral"), ("", "x")]
    frame = spark.createDataFrame(pairs, "truth string, label string")
    row = evaluation.evaluation_summary(frame).first()
    assert (row["accuracy"], row["sample_count"]) == (0.75, 4)
    assert row["macro_f1"] == round((1 + 0 + 0.8) / 3, 4) and row["weighted_f1"] == round((1 + 2 * 0.8) / 4, 4)
    scores = {r["label"]: tuple(r)[1:] for r in evaluation.class_scores(frame).collect()}
    assert scores["positive"] == (0.6667, 1.0, 0.8, 2) and scores["neutral"] == (0.0, 0.0, 0.0, 1)
    assert evaluation.evaluation_summary(frame.where("truth IS NULL")).first() is None
    foreign = frame.union(spark.createDataFrame([("other", "other")], frame.schema))
    assert evaluation.evaluation_summary(foreign).first()["accuracy"] == 0.0


def test_label_ties_and_hook(spark):
    texts = spark.createDataFrame([(1, "good day"), (2, "bad"), (3, " "), (4, "even")], "post_id int, original_text string").withColumn(
        "sentiment_ready_text", F.lit("")
    )

    def load():
        def scorer(batch):
            table = {"good day": (0.9, 0.05, 0.05), "bad": (0.1, 0.2, 0.7), "neutral": (0.1, 0.8, 0.1)}
            return pd.DataFrame([table.get(t, (0.4, 0.4, 0.2)) for t in batch], columns=["positive", "neutral", "negative"])

        return scorer

    found = {r["post_id"]: r for r in sentiment.score_with(sentiment.sentiment_input(texts), load).collect()}
    assert [found[i]["label"] for i in (1, 2, 3, 4)] == ["positive", "negative", "neutral", "positive"]
    assert found[1]["confidence"] == 0.9
    empty = sentiment.sentiment_breakdown(sentiment.score_with(sentiment.sentiment_input(texts.limit(0)), load)).collect()
    assert {(r["label"], r["count"], r["percentage"]) for r in empty} == {(s, 0, 0.0) for s in ("positive", "neutral", "negative")}


def test_trained_scorer_learns(spark):
    rows = [(i, "lovely great day" if i % 2 else "awful bad mess", "positive" if i % 2 else "negative") for i in range(40)]
    texts = spark.createDataFrame(rows, "post_id int, text string, truth string")
    model = sentiment.train_scorer(texts)
    found = {r["post_id"]: r for r in sentiment.score_trained(texts, model).collect()}
    assert all(found[i]["label"] == rows[i][2] for i in range(40))
    assert {r["score_neutral"] for r in found.values()} == {0.0}
    with pytest.raises(ValueError):
        sentiment.train_scorer(texts.where("truth = 'none'"))


# --- topics ---
THEMES = {
    "solar": "solar panel energy renewable power grid turbine",
    "sport": "football league goal striker match stadium coach",
    "coins": "bitcoin wallet ledger token exchange miner hash",
}


def themed(n):
    random.seed(1)
    rows = []
    for i in range(n):
        theme = list(THEMES.values())[i % 3].split()
        rows.append((i, " ".join(random.sample(theme, 5))))
    return rows


def test_topics_are_found_without_a_count(spark):
    texts = spark.createDataFrame(themed(150) + [(1000, "zebra qwerty"), (1001, "")], "post_id int, text string")
    found = topics.discover_topics(topics.encode_hashed(texts))
    by_topic = {r["post_id"]: r["topic_index"] for r in found.collect()}
    groups = [{by_topic[i] for i in range(150) if i % 3 == k} for k in range(3)]
    assert all(len(g - {-1}) == 1 for g in groups) and len(set.union(*groups) - {-1}) == 3
    assert by_topic[1000] == by_topic[1001] == -1


def test_hot_copies_form_one_heavy_cell(spark):
    """A third of all posts are the same text."""
    rows = [(i, "breaking news storm coast") for i in range(600)] + [(1000 + i, t) for i, t in themed(1200)]
    found = topics.discover_topics(topics.encode_hashed(spark.createDataFrame(rows, "post_id int, text string")))
    by_topic = {r["post_id"]: r["topic_index"] for r in found.collect()}
    assert len({by_topic[i] for i in range(600)}) == 1 and by_topic[0] >= 0


def test_cluster_sizes():
    assert topics.cluster_sizes(90) == (8, 3) and topics.cluster_sizes(900) == (18, 3)
    assert topics.cluster_sizes(6) == (2, 2) and topics.cluster_sizes(20) == (5, 3)


def test_small_corpus_topics(spark):
    rows = [(i, f"{t} {t}") for i, t in enumerate(w for w in THEMES.values() for _ in range(2))]
    found = topics.discover_topics(topics.encode_hashed(spark.createDataFrame(rows, "post_id int, text string")))
    labels = [r["topic_index"] for r in found.orderBy("post_id").collect()]
    assert labels[0] == labels[1] and labels[2] == labels[3] and labels[4] == labels[5] and len(set(labels)) == 3


def test_embeddings_are_unit_vectors(spark):
    texts = spark.createDataFrame(themed(9) + [(99, "")], "post_id int, text string")
    for vectors in (
        topics.encode_hashed(texts),
        topics.encode_with(texts, lambda: lambda batch: np.ones((len(batch), 384)) * (batch.str.len() > 0).to_numpy()[:, None], 4),
    ):
        for r in vectors.collect():
            assert len(r["embedding"]) == 384
            assert np.linalg.norm(r["embedding"]) == pytest.approx(0 if r["post_id"] == 99 else 1, abs=1e-5)


def test_complete_link_merging(spark):
    def at(degrees):
        return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]

    rows = [(0, at(0), 10), (1, at(20), 8), (2, at(40), 9), (3, at(200), 5)]
    centers = spark.createDataFrame(rows, "topic_index int, centroid array<double>, posts long")
    # 0-1 and 1-2 are within the limit, 0-2 is not: no chaining.
    assert topics.merge_groups(centers) == [[0, 1], [2], [3]]
    vectors = [(i * 10 + j, at(a), i) for i, a in enumerate((0, 20, 40, 200)) for j in range(3 + i)]
    assigned = spark.createDataFrame(vectors + [(99, at(90), -1)], "post_id int, embedding array<float>, topic_index int")
    merged = topics.consolidate(assigned)
    sizes = {r["topic_index"]: r["n"] for r in merged.groupBy("topic_index").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 7, 1: 6, 2: 5, -1: 1}
    strong = topics.assignment_strength(merged, topics.centroids(merged)).collect()
    assert all(0 <= r["probability"] <= 1 for r in strong)
    assert {r["probability"] for r in strong if r["topic_index"] == -1} == {0.0}


def test_topic_terms_against_brute_force(spark):
    random.seed(8)
    words = ["sun", "sea", "sky", "cat", "dog", "oak", "elm", "the", "of", "x"]
    rows = [(i % 3, " ".join(random.choice(words[i % 3 :]) for _ in range(12))) for i in range(90)]
    found = topics.topic_terms(spark.createDataFrame(rows, "topic_index int, text string"), 10).collect()
    counts = {t: Counter() for t in range(3)}
    for t, text in rows:
        kept = [w for w in text.split() if len(w) >= 2 and w not in STOP_WORDS]
        counts[t].update(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])
    mean = sum(sum(c.values()) for c in counts.values()) // 3
    every = sum(counts.values(), Counter())
    for t, c in counts.items():
        length = sum(c.values())
        score = {w: n / length * math.log(1 + mean / every[w]) for w, n in c.items()}
        best = sorted(score, key=lambda w: (-round(score[w], 10), w))[:10]
        mine = [(r["word"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["topic_index"] == t]
        assert [m[0] for m in mine] == best
        assert np.allclose([m[1] for m in mine], [score[w] for w in best], atol=1e-4)


# --- entities ---
GAZETTEER = [
    ("OpenAI", "ORG"), ("Google", "ORG"), ("Sam Altman", "PERSON"), ("Paris", "GPE"), ("New York", "GPE"),
    ("New York City", "GPE"), ("City Hall", "ORG"), ("crypto", "ORG"), ("ten dollars", "MONEY"), ("Paris", "PERSON"),
]


def test_gazetteer_mentions(spark):
    posts = spark.createDataFrame(
        [
            (1, "Sam Altman, of OpenAI! left #Paris for New York City Hall. In paris crypto &amp; ten dollars"),
            (2, "sam altman (openai)"),
            (3, ""),
            (4, "Paris"),
        ],
        "post_id int, original_text string",
    )
    gazetteer = spark.createDataFrame(GAZETTEER, "phrase string, label string")
    texts = {r["post_id"]: r["text"] for r in E.tagged_text(posts).collect()}
    rows = E.gazetteer_mentions(posts, gazetteer).collect()
    found = sorted((r["post_id"], r["start_char"], r["text"], r["label"]) for r in rows)
    assert [f[0] for f in found].count(1) == 4
    assert [(f[2], f[3]) for f in found if f[0] == 1] == [
        ("Sam Altman", "PERSON"), ("OpenAI", "ORG"), ("New York City", "GPE"), ("paris", "GPE"),
    ]
    assert [(f[2], f[3]) for f in found if f[0] == 4] == [("Paris", "GPE"), ("Paris", "PERSON")]
    assert not [f for f in found if f[0] == 2]
    for r in rows:
        assert texts[r["post_id"]][r["start_char"] : r["end_char"]] == r["text"]


def test_long_text_offsets_against_brute_force(spark):
    """Names across block borders of long texts, found by plain search."""
    random.seed(3)
    words = ["alpha", "New", "York", "City", "Berlin.", "(Rome)", "lorem,", "new"]
    texts = [(i, " ".join(random.choice(words) for _ in range(n))) for i, n in enumerate((1, 15, 16, 17, 333, 2000))]
    names = {"new york", "new york city", "berlin", "city"}
    gazetteer = spark.createDataFrame([(n, "GPE") for n in names], "phrase string, label string")
    frame = spark.createDataFrame(texts, "post_id int, text string")
    rows = E.longest_matches(E.gazetteer_candidates(frame, gazetteer)).collect()
    expected = set()
    for i, text in texts:
        parts, at, starts = text.split(" "), 0, []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        free = 0
        for k in range(len(parts)):
            for n in range(min(5, len(parts) - k), 0, -1):
                raw = " ".join(parts[k : k + n])
                clean = raw.strip(" \t\n.,;:!?")
                begin = starts[k] + len(raw) - len(raw.lstrip(" \t\n.,;:!?"))
                if clean.lower() in names and begin >= free:
                    expected.add((i, begin, clean))
                    free = begin + len(clean)
                    break
    assert {(r["post_id"], r["start_char"], r["text"]) for r in rows} == expected


def test_tagger_hook(spark):
    posts = spark.createDataFrame([(1, "Visit Rome"), (2, "ab")], "post_id int, original_text string")

    def load():
        def tag(texts):
            assert isinstance(texts, list) and len(texts) <= 64
            return [[(t[6:], "GPE", 6, len(t)), (t, "OTHER", 0, 2)] if len(t) > 3 else [] for t in texts]

        return tag

    rows = E.tag_with(posts, load).collect()
    assert [(r["text"], r["label"], r["start_char"]) for r in rows] == [("Rome", "GPE", 6)]
    many = spark.range(200).selectExpr("id AS post_id", "concat('Visit Rome', id) AS original_text").coalesce(1)
    assert E.tag_with(many, load).count() == 200


def test_names_of_many_words(spark):
    text = "The University of California at Los Angeles met the United Nations High Commissioner for Refugees and the World Bank."
    posts = spark.createDataFrame([(1, text), (2, "w " * 40 + text)], "post_id int, original_text string")
    names = ["University of California at Los Angeles", "the United Nations High Commissioner for Refugees", "World Bank"]
    gazetteer = spark.createDataFrame([(n, "ORG") for n in names], "phrase string, label string")
    rows = E.gazetteer_mentions(posts, gazetteer).collect()
    assert sorted((r["post_id"], r["text"]) for r in rows) == sorted((i, n) for i in (1, 2) for n in names)


# --- filters ---
def test_filters(spark):
    posts = spark.createDataFrame(
        [(1, "Literal 100% AI_", None, datetime(2026, 1, 2, 23, 59, 59, 999999)), (2, "Literal 100x AIs", "100% ai_", datetime(2026, 1, 3))],
        "post_id int, original_text string, cleaned_text string, timestamp timestamp",
    )
    assert posts.where(filters.containing("100% AI_")).count() == 2
    assert [r["post_id"] for r in posts.where(filters.containing("literal 100%")).collect()] == [1]
    assert posts.where(filters.containing("  ")).count() == 2
    assert [r["post_id"] for r in posts.where(filters.between_dates(None, date(2026, 1, 2))).collect()] == [1]
    assert posts.where(filters.between_dates(date(2026, 1, 2), date(2026, 1, 3))).count() == 2
    with pytest.raises(ValueError):
        filters.between_dates(date(2026, 1, 3), date(2026, 1, 2))


# --- whole runs ---
GROWING, FLAT = "solar panel energy renewable power grid", "football league goal striker match stadium"


@pytest.fixture(scope="module")
def two_runs(spark, tmp_path_factory):
    """A growing theme (2, 6, 12 posts a day) and a flat one (4), on two platforms; two runs."""
    store = Store(spark, str(tmp_path_factory.mktemp("runs")))
    rows = []
    for day, n in enumerate((2, 6, 12)):
        for i in range(n + 4):
            text = GROWING if i < n else FLAT
            rows.append((len(rows) + 1, f"{text} OpenAI number{i} #Tag{day}", START + timedelta(days=day, hours=i), "twitter" if i % 2 else "reddit", i))
    schema = "post_id int, original_text string, timestamp timestamp, platform string, likes int"
    posts = spark.createDataFrame(rows, schema).withColumns(
        {"dataset_id": F.lit("d"), "comments": F.lit(None).cast("int"), "shares": F.lit(None).cast("int"),
         "hashtags": F.lit(None).cast("array<string>")}
    )
    store.import_posts(posts, "d")
    store.register_dataset("d", "Demo", "imported", {})
    labels = spark.createDataFrame([(r[0], "positive" if "solar" in r[1] else "negative") for r in rows], "post_id int, truth string")
    gazetteer = spark.createDataFrame(GAZETTEER, "phrase string, label string")
    first = analysis.run_analysis(store, "d", analysis.Models(labels=labels, gazetteer=gazetteer), "r1")

    def neutral():
        return lambda batch: pd.DataFrame({"positive": 0.1, "neutral": 0.8, "negative": 0.1}, index=range(len(batch)))

    second = analysis.run_analysis(store, "d", analysis.Models(scorer=neutral), "r2")
    return store, first, second


def test_run_end_to_end(spark, two_runs):
    store, first, second = two_runs
    t = analysis.load_run(store, first, "d")
    assert t["posts"].count() == 32
    names = {r["display_name"]: r["post_count"] for r in t["topics"].where("NOT is_outlier").collect()}
    assert names == {"Renewable Energy": 20, "Sports Competition": 12}
    assert t["trend_snapshots"].where("volume_current > 0").agg(F.sum("volume_current")).first()[0] == 32
    ranked = trend_plans.ranked_trends(t["hourly_rollup"]).collect()
    assert ranked[0]["volume_current"] == 12 and ranked[0]["trend_score"] > ranked[1]["trend_score"]
    parts = dashboard.dashboard(t, t["hourly_rollup"])
    assert parts["totals"].first()["total_posts"] == 32 and parts["totals"].first()["total_topics"] == 2
    assert [tuple(r)[1:] for r in parts["top_entities"].collect()] == [("OpenAI", "ORG", 32)]
    without = dashboard.dashboard({k: v for k, v in t.items() if k != "posts_rollup"}, t["hourly_rollup"])
    for part in ("totals", "platforms", "sentiment", "top_entities", "top_hashtags", "top_keywords"):
        for view in (parts, without)[: 1 if part == "totals" else 2]:  # texts are read once, before; the clock may be read again
            assert "original_text" not in view[part]._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, parts[part].collect())) == sorted(map(tuple, without[part].collect()))
    assert post_index.is_indexed(store, "d")
    found = search.search_run(store, first, "d", 5, 20)
    scanned = search.search_posts(t["posts"], t["sentiment"], t["post_topics"], t["topics"], 5, 20)
    assert [r["post_id"] for r in found.collect()] == [r["post_id"] for r in scanned.collect()]
    total = search.search_total_of_run(store, first, "d", query="solar", label="positive").first()["total"]
    assert total == search.search_total(t["posts"], t["sentiment"], t["post_topics"], query="solar", label="positive").first()["total"] > 0
    line = dashboard.run_timeline(t["posts"], t["sentiment"])
    assert [r["total_volume"] for r in line.orderBy("window_start").collect()] == [6, 10, 16]


def test_runs_do_not_mix(spark, two_runs):
    store, first, second = two_runs
    one, two = (analysis.load_run(store, r, "d") for r in (first, second))
    page = lambda t: search.search_posts(t["posts"], t["sentiment"], t["post_topics"], t["topics"], 50)
    assert {r["sentiment"] for r in page(one).collect()} == {"positive", "negative"}
    assert {r["sentiment"] for r in page(two).collect()} == {"neutral"} and page(two).count() == 32
    assert two["entities"].count() == 0
    assert '"degraded": true' in store.run(second)["model_info"] and '"degraded": false' in store.run(first)["model_info"]
    summary = enrichment.sentiment_summary(store.run(second))
    assert summary["neutral_count"] == 32 and summary["evaluation_metrics"] is None
    assert enrichment.sentiment_summary(store.run(first))["evaluation_metrics"]["accuracy"] == 1.0
    assert '"reused_canonical": true' in store.run(second)["stats"]


def test_keys_are_unique(spark, two_runs):
    store, first, _ = two_runs
    t = analysis.load_run(store, first, "d")
    for name, keys in (
        ("sentiment", ["post_id"]), ("topics", ["topic_index"]), ("post_topics", ["post_id", "topic_id"]),
        ("entities", ["normalized_text", "label"]), ("trend_snapshots", ["topic_id", "window_start"]),
    ):
        assert t[name].groupBy(*keys).count().where("count > 1").isEmpty()


def test_search_pages(spark, two_runs):
    store, first, _ = two_runs
    t = analysis.load_run(store, first, "d")
    args = (t["posts"], t["sentiment"], t["post_topics"], t["topics"])
    pages = [[r["post_id"] for r in search.search_posts(*args, limit=5, offset=o, query="SOLAR").collect()] for o in (0, 5, 10, 15)]
    ids = [i for p in pages for i in p]
    assert len(ids) == len(set(ids)) == 20
    assert search.search_total(*args[:3], query="solar", platform="Twitter", label="positive").first()["total"] == 10
    assert search.search_total(*args[:3], label="negative").first()["total"] == 12
    with pytest.raises(ValueError):
        search.search_posts(*args, limit=201)


def test_topic_views(spark, two_runs):
    store, first, _ = two_runs
    t = analysis.load_run(store, first, "d")
    ranked = trend_plans.ranked_trends(t["hourly_rollup"], platform="twitter")
    listed = topic_plans.list_topics(t["topics"], ranked, query="ENERGY", platform="twitter").collect()
    assert [r["display_name"] for r in listed] == ["Renewable Energy"]
    topic = listed[0]["topic_id"]
    parts = topic_plans.topic_dossier(t, topic)
    assert parts["post_count"].first()["post_count"] == 20
    assert parts["sentiment_distribution"].first()["positive_pct"] == 100.0
    engagement = parts["avg_engagement"].first()
    assert engagement["avg_likes"] == round((0 + 1 + sum(range(6)) + sum(range(12))) / 20, 2) and engagement["avg_shares"] is None
    assert [r["volume_current"] for r in parts["trend_history"].orderBy("window_start").collect()] == [2, 6, 12]
    assert parts["sample_posts"].count() == 10 and parts["timeline"].count() == 3


def test_run_context(spark, two_runs):
    store, first, _ = two_runs
    assert store.run(None) is None
    with pytest.raises(LookupError):
        store.run("missing")
    with pytest.raises(ValueError):
        store.run(first, "other")
    store.write_run("r9", "d", "running", {}, {}, {})
    with pytest.raises(RuntimeError):
        store.run("r9")
    assert store.run("r9", completed=False)["status"] == "running"
    with pytest.raises(RuntimeError):
        store.delete_dataset("d")
    with pytest.raises(ValueError):
        analysis.run_analysis(store, "d", analysis.Models())
    with pytest.raises(RuntimeError):
        filters.require_posts(store.posts("d"), "mapped")


def test_no_data_view(spark):
    parts = dashboard.no_data(spark)
    assert parts["totals"].first()["status"] == "no_data"
    assert tuple(parts["classifications"].first()) == (0, 0, 0, 0) and parts["sentiment"].count() == 3


# --- runs over meagre data ---
def _dataset(spark, store, name, texts):
    rows = [(k + 1, t, START + timedelta(hours=k), "reddit", k) for k, t in enumerate(texts)]
    posts = spark.createDataFrame(rows, "post_id int, original_text string, timestamp timestamp, platform string, likes int").withColumns(
        {"dataset_id": F.lit(name), "comments": F.lit(None).cast("int"), "shares": F.lit(None).cast("int"), "hashtags": F.lit(None).cast("array<string>")}
    )
    store.import_posts(posts, name)
    store.register_dataset(name, name, "imported", {})


def _even():
    def load():
        return lambda batch: pd.DataFrame({"positive": 0.2, "neutral": 0.5, "negative": 0.3}, index=range(len(batch)))

    return load


MEAGRE = {
    "no_names": [f"solar panel energy grid number{k % 3}" for k in range(24)],
    "random_words": [" ".join(random.Random(k).choice("abcdefghij") * 4 + str(k) for _ in range(6)) for k in range(40)],
    "digits": ["1 2 3", "4 5", "6"],
    "three_posts": ["first thing here", "second matter there", "third affair elsewhere"],
}


@pytest.mark.parametrize("name", MEAGRE)
def test_runs_survive_empty_stages(spark, tmp_path, name):
    store = Store(spark, str(tmp_path))
    _dataset(spark, store, name, MEAGRE[name])
    gazetteer = spark.createDataFrame(GAZETTEER, "phrase string, label string")
    run = analysis.run_analysis(store, name, analysis.Models(scorer=_even(), gazetteer=gazetteer))
    t = analysis.load_run(store, run, name)
    assert t["posts"].count() == t["sentiment"].count() == t["post_topics"].count() == len(MEAGRE[name])
    assert t["post_entities"].count() == t["entities"].count() == 0
    assert t["topics"].agg(F.sum("post_count")).first()[0] == len(MEAGRE[name])
    for table in ("keywords", "trend_snapshots", "hourly_rollup"):
        assert t[table].count() >= 0
    assert store.dataset(name)["status"] == "preprocessed"
    dashboard.dashboard(t, t["hourly_rollup"])["totals"].collect()


def test_counts_of_a_selection(spark):
    posts = spark.createDataFrame(
        [(1, "X", ["a", "b"]), (2, None, None), (3, "X", ["a", None, ""]), (4, "", [])], "post_id long, platform string, hashtags array<string>"
    )
    labels = spark.createDataFrame([(1, "positive"), (2, "positive"), (9, "negative")], "post_id long, label string")
    found = {(r["kind"], r["value"]): r["n"] for r in dashboard.selection_counts(posts, labels).collect()}
    assert found == {
        ("platform", "X"): 2, ("platform", None): 1, ("platform", ""): 1, ("hashtag", "a"): 2, ("hashtag", "b"): 1,
        ("hashtag", None): 1, ("hashtag", ""): 1, ("sentiment", "positive"): 2,
    }
    assert dashboard.selection_counts(posts.where("false"), labels).count() == 0


def test_failed_runs_are_recorded(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    _dataset(spark, store, "d", MEAGRE["digits"])

    def broken():
        raise OSError("no such model")

    with pytest.raises(Exception, match="no such model"):
        analysis.run_analysis(store, "d", analysis.Models(scorer=broken), "r1")
    failed = store.run("r1", completed=False)
    assert failed["status"] == "failed" and "no such model" in failed["error"] and failed["created_at"] < failed["completed_at"]
    with pytest.raises(RuntimeError):
        analysis.load_run(store, "r1")
    with pytest.raises(ValueError):
        analysis.load_run(store, None)
    with pytest.raises(LookupError):
        analysis.run_analysis(store, "unknown", analysis.Models(scorer=_even()))
    store.set_status("d", "failed")
    with pytest.raises(RuntimeError):
        analysis.run_analysis(store, "d", analysis.Models(scorer=_even()))
    store.delete_dataset("d")
    assert store.datasets().count() == 0


def test_views_of_a_run(spark, two_runs):
    store, first, _ = two_runs
    t = analysis.load_run(store, first, "d")
    for window, platform in (("daily", None), ("hourly", "twitter"), ("weekly", "reddit")):
        read = dashboard.run_timeline(t["posts"], t["sentiment"], window, platform)
        stored = dashboard.stored_timeline(t, window, platform)
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, read.collect()))
    topic = t["topics"].where("NOT is_outlier").first()["topic_id"]
    read = dashboard.run_timeline(t["posts"], t["sentiment"], "daily", None, t["post_topics"], topic)
    assert sorted(map(tuple, dashboard.stored_timeline(t, "daily", None, topic).collect())) == sorted(map(tuple, read.collect()))
    plan = dashboard.stored_timeline(t)._jdf.queryExecution().executedPlan().toString()
    assert "canonical_posts" not in plan and "Join" not in plan
    view = dashboard.dashboard_of_run(store, first, dataset_id="d")
    header = view["run"].first()
    assert (header["dataset_name"], header["status"]) == ("Demo", "completed") and "hashed word counts" in header["model_info"]
    empty = dashboard.dashboard_of_run(store, None)
    assert set(empty) == set(view) and empty["top_trends"].count() == empty["run"].count() == 0
    listed, totals = enrichment.entity_listing(t["entities"], "ORG", 5)
    assert listed.count() == 1 and {(r["label"], r["frequency"], r["total_entities"]) for r in totals.collect()} == {("ORG", 32, 1)}
    page, number = dataset_listing(store.datasets(), 10, 0)
    assert page.count() == number == 1


def test_preprocessing_keeps_other_meta(spark):
    posts = spark.createDataFrame(
        [(1, "Some #Text", START, {"source": "export", "version": "0"})],
        "post_id int, original_text string, timestamp timestamp, preprocessing_meta map<string,string>",
    ).withColumn("hashtags", F.lit(None).cast("array<string>"))
    meta = preprocess(posts).first()["preprocessing_meta"]
    assert meta["source"] == "export" and meta["version"] == "1.0.0" and meta["hashtag_count"] == "1"


def test_gazetteer_of_several_tries(spark, monkeypatch):
    """Cut by first words into several tries, the mentions are the same, without a shuffle of words."""
    random.seed(9)
    words = ["red", "Blue,", "green.", "(deep)", "sea", "Sea!", "...", "sky"]
    texts = [(i, " ".join(random.choice(words) for _ in range(60))) for i in range(30)] + [(99, ""), (100, None)]
    names = [("red sea", "GPE"), ("deep sea", "GPE"), ("sea", "ORG"), ("sea", "GPE"), ("blue, green", "ORG"), ("sky ... red", "ORG"), (None, "ORG"), (", x", "ORG")]
    frame = spark.createDataFrame(texts, "post_id int, text string")
    gazetteer = spark.createDataFrame(names, "phrase string, label string")
    one = E.gazetteer_candidates(frame, gazetteer)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    whole = sorted(tuple(r) for r in one.collect())
    monkeypatch.setattr(E, "MAX_NAMES", 2)
    assert sorted(tuple(r) for r in E.gazetteer_candidates(frame, gazetteer).collect()) == whole
    keys, expected = {n for n, _ in names if n}, set()
    for i, text in texts:
        parts = (text or "").split(" ")
        for a in range(len(parts)):
            for b in range(a + 1, min(a + 4, len(parts) + 1)):
                raw = " ".join(parts[a:b])
                clean = raw.strip(" \t\n.,;:!?")
                begin = len(" ".join(parts[:a])) + (a > 0) + len(raw) - len(raw.lstrip(" \t\n.,;:!?"))
                expected |= {(i, clean, label, begin, begin + len(clean)) for n, label in names if clean and clean.lower() == n}
    assert set(whole) == expected and len(expected) > 100


def test_tagged_texts_are_computed_once(spark):
    """Null texts have no names, and no filter computes the texts a second time to find them."""
    names = spark.createDataFrame([("Ada Byron", "PERSON")], "phrase string, label string")
    posts = spark.createDataFrame([(1, "met Ada Byron"), (2, None), (3, "")], "post_id long, original_text string")
    texts = posts.select("post_id", F.regexp_replace("original_text", "^met ", "saw ").alias("text"))
    found = E.gazetteer_candidates(texts, names)
    assert [(r.post_id, r.text, r.start_char) for r in found.collect()] == [(1, "Ada Byron", 4)]
    assert found._jdf.queryExecution().executedPlan().toString().count("^met ") == 1
