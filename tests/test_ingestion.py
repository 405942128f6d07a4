import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.timestamps import parse_standard, parse_timestamp
from tidewatch.operators import columns, normalize, validation
from tidewatch.plans import ingest
from tidewatch.session import shared_dir
from tidewatch.sources import csv_blocks
from tidewatch.sources.csv_scan import preview, scan_csv
from tidewatch.sources.store import Store, posts_preview

LIFECYCLE = (
    "body,when,network,likes,id\n"
    "First valid post,2026-01-01T10:00:00Z,Twitter,0,001\n"
    "First valid post,2026-01-02T10:00:00Z,Twitter,10,002\n"
    "Another #Topic post,2026-01-03 10:00:00,Reddit,5,003\n"
    ",2026-01-03,Reddit,1,004\n"
    "Bad time,not-a-date,Reddit,1,005\n"
)
MAPPING = {"text": "body", "timestamp": "when", "platform": "network", "likes": "likes", "external_id": "id"}


def put(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("2026-07-15T14:30:00Z", datetime(2026, 7, 15, 14, 30)),
        ("2026-07-15T14:30:00.250Z", datetime(2026, 7, 15, 14, 30, 0, 250000)),
        ("2026-07-15T10:30:00-04:00", datetime(2026, 7, 15, 14, 30)),
        ("2026-07-15 10:30:00.5+0530", datetime(2026, 7, 15, 5, 0, 0, 500000)),
        ("2026-07-15 10:30", datetime(2026, 7, 15, 10, 30)),
        ("2026-07-15", datetime(2026, 7, 15)),
        ("07/04/2026 14:30:00", datetime(2026, 7, 4, 14, 30)),
        ("25/12/2026", datetime(2026, 12, 25)),
        ("15.07.2026 14:30:00", datetime(2026, 7, 15, 14, 30)),
        ("Wed Jul 15 14:30:00 -0400 2026", datetime(2026, 7, 15, 18, 30)),
        ("1752589800", datetime(2025, 7, 15, 14, 30)),
        ("1752589800999", datetime(2025, 7, 15, 14, 30)),
        ("999999999999", None),
        ("2026-02-30", None),
        ("not-a-date", None),
        ("  ", None),
    ],
)
def test_standard_timestamps(spark, raw, expected):
    row = spark.createDataFrame([(raw,)], "raw string").select(parse_standard(F.col("raw"))).first()
    assert row[0] == expected


def test_free_form_timestamps(spark):
    raws = ["July 15, 2026 2:30 PM", "2026-07-15T14:30", "20260715", "25/12/2024 10:30", "nonsense", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    found = {r["i"]: r["t"] for r in rows.select("i", parse_timestamp(F.col("raw")).alias("t")).collect()}
    assert found == {
        0: datetime(2026, 7, 15, 14, 30), 1: datetime(2026, 7, 15, 14, 30), 2: datetime(2026, 7, 15),
        3: datetime(2024, 12, 25, 10, 30), 4: None, 5: None,
    }


def test_more_free_forms(spark):
    half_past_two = datetime(2026, 7, 15, 14, 30)
    expected = {
        "Wed, 15 Jul 2026 14:30:00 GMT": half_past_two, "Wednesday, July 15, 2026 2:30:00 p.m.": half_past_two,
        "15-Jul-2026 10:30 -04:00": half_past_two, "jul. 15 2026 2:30pm": half_past_two, "2026/07/15 14:30": half_past_two,
        "15 july 2026": datetime(2026, 7, 15), "15.07.2026 14:30": half_past_two, "July 15, 2026 12:05 AM": datetime(2026, 7, 15, 0, 5),
        "2026-07-15T14:30Z": half_past_two, "July 35, 2026": None, "July 15, 2026 25:00": None, "July 15, 2026 13:00 PM": None, "Foo 15, 2026": None,
        "20261301": None, "14:30": None, "": None,
    }
    rows = spark.createDataFrame([(t,) for t in expected], "raw string").select("raw", parse_timestamp(F.col("raw")).alias("t")).collect()
    assert {r["raw"]: r["t"] for r in rows} == expected
    plan = spark.createDataFrame([("x",)], "raw string").select(parse_timestamp(F.col("raw")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_detection_prefers_canonical_names():
    found = columns.detect_columns(["Tweet Text", "created-at", "likes", "body"])
    assert found.mapping["text"] == "Tweet Text" and found.confidence["text"] == pytest.approx(0.9)
    assert found.mapping["timestamp"] == "created-at"
    assert found.ambiguous == ["text"]
    found = columns.detect_columns(["favorite_count", "reply_count", "retweet_count"])
    assert [found.mapping[f] for f in ("likes", "comments", "shares")] == [
        "favorite_count", "reply_count", "retweet_count",
    ]
    assert not any(columns.detect_columns(["x", "y"]).mapping.values())
    assert columns.detect_columns(["num_retweets"]).confidence["shares"] == pytest.approx(0.7)


def test_mapping_checks():
    names = ["a", "b"]
    for bad in ({"text": "a"}, {"text": "a", "timestamp": "c"}, {"text": "a", "timestamp": "a"}):
        with pytest.raises(ValueError):
            columns.check_mapping(bad, names)
    columns.check_mapping({"text": "a", "timestamp": "b", "likes": None}, names)


def test_csv_keeps_strings(spark, tmp_path):
    path = put(tmp_path, "a.csv", '﻿text, id \n"two\nlines, ""q""",007\nNA,\n  padded ,1e5\n')
    rows = scan_csv(spark, path).orderBy("row_index").collect()
    assert [(r["text"], r["id"], r["row_index"]) for r in rows] == [
        ('two\nlines, "q"', "007", 0), ("NA", "", 1), ("  padded ", "1e5", 2),
    ]
    with pytest.raises(ValueError):
        preview(scan_csv(spark, path), 101)


def test_csv_windows_1252(spark, tmp_path):
    path = put(tmp_path, "w.csv", b"text,created_at\ncaf\xe9 \x93q\x94 \x80,2026-01-01\n")
    assert scan_csv(spark, path).first()["text"] == "café “q” €"


@pytest.mark.parametrize(
    "content", [b"", b"a,b\n", b"a,a\n1,2\n", b"a, \n1,2\n", b"a\x00,b\n1,2\n", b"a,b\n\x81,\xe9\n"]
)
def test_csv_refusals(spark, tmp_path, content):
    with pytest.raises(ValueError):
        scan_csv(spark, put(tmp_path, "bad.csv", content))
    with pytest.raises(ValueError):
        scan_csv(spark, put(tmp_path, "bad.txt", b"a,b\n1,2\n"))


def test_row_numbers_within_many_files(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i in range(12):
        put(folder, f"{i}.csv", "text,t\n" + "".join(f"r{j},x\n" for j in range(i + 1)))
    rows = scan_csv(spark, str(folder)).collect()
    assert all(r["text"] == f"r{r['row_index']}" for r in rows) and len(rows) == 78


@pytest.fixture
def small_blocks(spark):
    """Splits of some 300 bytes, so that records cross them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def scanned(spark, path, **kwargs):
    names = ("text", "id", "n", "row_index", "source_file")
    return sorted(tuple(r[c] for c in names) for r in scan_csv(spark, path, **kwargs).collect())


def random_csv(rng, end, last_end, regular=True):
    """A file of 40 records with quotes, commas, newlines and empty lines; some records have two or four cells."""
    bits = ["a", "é", " ", ",", '""', "\n", "\r\n", "\n\n", "long words here ", "'"]

    def cell():
        if rng.random() < 0.4:
            return '"' + "".join(rng.choice(bits) for _ in range(rng.randrange(12))) + '"'
        return rng.choice(["", "NA", " x ", "word", "007", "1e5"] + ([] if regular else ['5" pipe', '"a" b', ' "c"']))

    records = ["text,id,n"]
    for _ in range(40):
        records.append(",".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))))
        if rng.random() < 0.1:
            records.append("")
    return end.join(records) + (end if last_end else "")


@pytest.mark.parametrize("seed, end, last_end", [(1, "\n", True), (2, "\n", False), (3, "\r\n", True), (4, "\r\n", False)])
def test_blocks_read_what_whole_files_read(spark, tmp_path, small_blocks, seed, end, last_end):
    path = put(tmp_path, "r.csv", random_csv(random.Random(seed), end, last_end))
    assert csv_blocks.records(spark, path, "utf-8") is not None
    in_blocks = scanned(spark, path, split_bytes=0)
    assert in_blocks == scanned(spark, path)
    assert sorted(r[3] for r in in_blocks) == list(range(len(in_blocks)))


def test_blocks_of_several_files_and_another_encoding(spark, tmp_path, small_blocks):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i in range(3):
        put(folder, f"{i}.csv", random_csv(random.Random(10 + i), "\n", i != 1).encode("cp1252"))
    path = str(folder)
    assert csv_blocks.records(spark, path, "windows-1252") is not None
    assert scanned(spark, path, split_bytes=0) == scanned(spark, path)


def test_a_cell_over_many_blocks(spark, tmp_path, small_blocks):
    cell = "line, with ""\n" * 100
    path = put(tmp_path, "c.csv", f'text,id,n\nx,1,2\n"{cell}",2,3\n\ny,3,4\n')
    assert scanned(spark, path, split_bytes=0) == scanned(spark, path)
    assert [r["text"] for r in scan_csv(spark, path, 0).orderBy("row_index").collect()] == ["x", cell, "y"]


@pytest.mark.parametrize("content", ['text,id,n\n5" pipe,1,2\nb,2,3\n6" pipe,3,4\n', 'text,id,n\n"a" b,1,2\nc,2,3\n', 'text,id,n\r\na,1,2\nb,2,3\n', 'text,id,n\na,1,2\n"open,2,3\n'])
def test_irregular_files_are_read_whole(spark, tmp_path, small_blocks, content):
    path = put(tmp_path, "i.csv", content)
    assert csv_blocks.records(spark, path, "utf-8") is None
    assert scanned(spark, path, split_bytes=0) == scanned(spark, path)


def test_irregular_random_files(spark, tmp_path, small_blocks):
    path = put(tmp_path, "i.csv", random_csv(random.Random(7), "\n", True, regular=False))
    assert scanned(spark, path, split_bytes=0) == scanned(spark, path)


def test_a_large_file_makes_many_tasks(spark, tmp_path):
    path = put(tmp_path, "big.csv", "text,id,n\n" + '"some\ntext",1,2\n' * 100_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 10))
    try:
        lines = csv_blocks._lines(spark, path, "utf-8")
        assert lines.rdd.getNumPartitions() > 10
        staged = scan_csv(spark, path, split_bytes=1 << 20)
        found = staged.agg(F.count("*"), F.count_distinct("row_index"), F.max("row_index"), F.min("row_index"), F.min("text"), F.max("text")).first()
        assert tuple(found) == (100_000, 100_000, 99_999, 0, "some\ntext", "some\ntext")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("content", [b"", b"a,b\n", b"a,a\n1,2\n", b"a\x00,b\n1,2\n", b"a,b\n\x81,\xe9\n"])
def test_refusals_of_blocks(spark, tmp_path, content):
    with pytest.raises(ValueError):
        scan_csv(spark, put(tmp_path, "bad.csv", content), split_bytes=0)


def test_validation_of_a_lifecycle_file(spark, tmp_path):
    staged = scan_csv(spark, put(tmp_path, "l.csv", LIFECYCLE))
    checked = ingest.validate(staged, MAPPING)
    summary = checked.summary().first()
    assert (summary["total_rows"], summary["valid_rows"], summary["invalid_rows"]) == (5, 3, 2)
    assert (summary["missing_text"], summary["invalid_timestamp"], summary["duplicate_posts"]) == (1, 1, 1)
    assert summary["earliest"] == "2026-01-01T10:00:00+00:00" and not summary["issues_truncated"]
    issues = [(r["row_index"], r["issue_type"]) for r in checked.issues().collect()]
    assert issues == [(3, "missing_text"), (4, "invalid_timestamp"), (1, "duplicate")]
    assert {r["platform"]: r["rows"] for r in checked.platforms().collect()} == {"Twitter": 2, "Reddit": 1}
    assert {r["field"]: r["missing"] for r in checked.missing().collect()} == {
        "hashtags": 5, "comments": 5, "shares": 5, "author_id": 5,
    }


def test_import_is_idempotent_and_deletable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    staged = scan_csv(spark, put(tmp_path, "l.csv", LIFECYCLE))
    assert ingest.import_dataset(store, staged, MAPPING, "d1", "One")["valid_rows"] == 3
    assert not ingest.import_dataset(store, staged, MAPPING, "d1", "One")["imported"]
    ingest.import_dataset(store, staged, MAPPING, "d2", "Two")
    rows = posts_preview(store.posts("d1"), 20).collect()
    assert [r["likes"] for r in rows] == [0, 10, 5]
    assert [r["is_duplicate"] for r in rows] == [False, True, False]
    assert rows[2]["hashtags"] == ["topic"] and rows[0]["comments"] is None
    store.delete_dataset("d1")
    assert [r["dataset_id"] for r in store.datasets().collect()] == ["d2"]
    assert store.posts("d2").count() == 3
    with pytest.raises(ValueError):
        bad = scan_csv(spark, put(tmp_path, "n.csv", "body,when\nhello,not-a-date\n"))
        ingest.import_dataset(store, bad, {"text": "body", "timestamp": "when"}, "d3", "None")


def test_validator_without_a_text_column(spark):
    rows = spark.createDataFrame([("f", 0, "2026-01-01")], "source_file string, row_index long, timestamp string")
    checked = validation.check_rows(rows)
    assert checked.first()["bad_text"]
    assert validation.validation_summary(checked.withColumn("is_duplicate", F.lit(False))).first()["missing_text"] == 1


def test_normalised_row(spark):
    columns_ = "source_file string, row_index long, text string, platform string, hashtags string, likes string, author_id string, parsed_time timestamp, is_duplicate boolean"
    row = ("f", 0, "Hello #world #World @User http://x.io/a", " X ", "#One, two|;#", "42", " ", datetime(2026, 1, 1), False)
    post = normalize.normalize_rows(spark.createDataFrame([row], columns_), "d").first()
    assert post["hashtags"] == ["one", "two", "", "world"]
    assert (post["platform"], post["likes"], post["shares"], post["author_id"]) == ("x", 42, None, None)
    assert post["mentions"] == ["User"] and post["urls"] == ["http://x.io/a"]


@pytest.mark.parametrize(
    "raw, expected",
    [("0", 0), (" 7.0 ", 7), ("1e3", 1000), ("1_000", 1000), ("5.5", None), ("-1", None), ("2147483648", None),
     ("1d", None), ("nan", None), ("", None), (None, None)],
)
def test_safe_integers(spark, raw, expected):
    row = spark.createDataFrame([(raw,)], "raw string").select(normalize.safe_int(F.col("raw"))).first()
    assert row[0] == expected


def test_hot_duplicates_against_brute_force(spark):
    """A third of all rows repeat one text; the flags equal those of a plain scan."""
    texts = ["same text" if i % 3 == 0 else f"text {i % 50}" for i in range(3000)]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "source_file string, row_index long, text string")
    from tidewatch.operators.duplicates import flag_import_duplicates

    flags = {r["row_index"]: r["is_duplicate"] for r in flag_import_duplicates(rows, ["source_file", "row_index"]).collect()}
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        expected[i] = t in seen
        seen.add(t)
    assert flags == expected


def test_an_import_that_breaks_can_be_repeated(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    staged = scan_csv(spark, put(tmp_path, "l.csv", LIFECYCLE))
    monkeypatch.setattr(Store, "register_dataset", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        ingest.import_dataset(store, staged, MAPPING, "d1", "One")
    monkeypatch.undo()
    assert store.datasets().count() == 0
    assert ingest.import_dataset(store, staged, MAPPING, "d1", "One")["imported"]
    assert store.posts("d1").count() == 3 and store.dataset("d1")["name"] == "One"


def test_scratch_tables_go_with_their_job(spark, tmp_path):
    place = shared_dir(spark).removeprefix("file:")
    store = Store(spark, str(tmp_path / "store"))
    staged = scan_csv(spark, put(tmp_path, "l.csv", LIFECYCLE))
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    ingest.import_dataset(store, staged, MAPPING, "d1", "One")
    assert set(os.listdir(place)) <= before


def test_repeats_with_colliding_short_hashes(spark, monkeypatch):
    """Texts whose 64-bit hashes collide are told apart by their full keys."""
    from tidewatch.operators import duplicates

    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "c", None, "b", "a", None, "d"])]
    frame = spark.createDataFrame(rows, "id int, t string")

    def flags():
        found = duplicates.flag_repeats(frame, duplicates.F.col("t"), ["id"], ["id"])
        return {r["id"]: r["is_duplicate"] for r in found.collect()}

    expected = {i: t is not None and t in [u for _, u in rows[:i]] for i, t in rows}
    assert flags() == expected
    monkeypatch.setattr(duplicates, "short_hash", lambda text: duplicates.F.length(text).cast("long"))
    assert flags() == expected


def test_manifest_survives_a_crash_between_its_steps(spark, tmp_path, monkeypatch):
    """A change that dies after its file is made, or half written, leaves the row before it readable."""
    from tidewatch.sources.store import Store, _line

    store = Store(spark, str(tmp_path / "w"))
    store.register_dataset("d1", "First", "ready", {"rows": 3})
    before = store.dataset("d1")
    files, place = store._files(f"{store.path('datasets')}/dataset_id=d1/v0000000002.json")
    out = files.create(place, False)  # made, nothing written
    out.close()
    assert store.dataset("d1") == before
    line = _line({"dataset_id": "d1", "name": "Cut", "status": "x", "version": 3})
    files, place = store._files(f"{store.path('datasets')}/dataset_id=d1/v0000000003.json")
    out = files.create(place, False)
    out.write(bytearray(line[: len(line) // 2].encode()))
    out.close()
    assert store.dataset("d1") == before
    store.set_status("d1", "analyzed")
    after = store.dataset("d1")
    assert after["status"] == "analyzed" and after["name"] == "First" and after["created_at"] == before["created_at"]
    assert sorted(store._versions(f"{store.path('datasets')}/dataset_id=d1")) == [1, 2, 3, 4]


def test_two_writers_take_versions_one_after_the_other(spark, tmp_path, monkeypatch):
    from tidewatch.sources.store import Store

    store = Store(spark, str(tmp_path / "w"))
    store.write_run("r1", "d1", "running", {}, {}, {})
    seen, versions = [], store._versions

    def late(folder):
        found = versions(folder)
        if not seen:
            seen.append(1)
            store.write_run("r1", "d1", "completed", {"by": "other"}, {}, {})
        return found

    monkeypatch.setattr(store, "_versions", late)
    store.write_run("r1", "d1", "failed", {"by": "this"}, {}, {}, error="x")
    rows = store.runs().collect()
    assert len(rows) == 1 and rows[0]["status"] == "failed" and rows[0]["completed_at"] is not None
    assert sorted(versions(f"{store.path('runs')}/dataset_id=d1/analysis_run_id=r1")) == [1, 2, 3]


def test_parsing_stands_once_in_a_plan(spark):
    """Checks, filters and sums on a parsed time must not write its patterns out again and again."""
    mapped = spark.createDataFrame([("f", 0, "a text", "May 5, 2024 3:07 pm", "x")], "source_file string, row_index long, text string, timestamp string, platform string")
    checked = validation.check_rows(mapped)
    counted = validation.platform_distribution(checked)
    joined = checked.join(checked.where(~F.col("is_valid")).select(*validation.ROW_KEY), list(validation.ROW_KEY), "left_anti")
    parsed = mapped.select(parse_timestamp(F.col("timestamp")).alias("t"))
    for rows in (counted, joined.select("row_index"), parsed):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") < 30 and plan.lower().count("rlike") < 100
    assert [tuple(r) for r in counted.collect()] == [("x", 1)] and joined.count() == 1
