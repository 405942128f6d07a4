"""Line rules and decontamination against plain Python, on odd documents; plans without Python."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import prose

from tidewatch.llm import decontaminate, line_rules
from tidewatch.llm.queries import importable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_figures(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def brute_rules(rows, limit):
    """`rows`: (doc_id, text, host). Rows with one id and text count as one document."""
    hosts = defaultdict(set)
    lines = {}
    for key in set(rows):
        found = [" ".join(WORD.findall(x)).lower() for x in key[1].split("\n")]
        lines[key] = [x for x in found if x]
        for x in lines[key]:
            hosts[key[2], x].add(key)
    out = []
    for key in rows:
        total = sum(len(x.split(" ")) for x in lines[key])
        spent = sum(len(x.split(" ")) for x in lines[key] if len(hosts[key[2], x]) > limit)
        figures = text_figures(key[1])
        out.append((key[0], *figures, spent, not figures[-1] and 2 * spent <= total))
    return out


def test_rules_of_odd_documents(odd, none):
    _, docs = odd
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.where("doc_id IS NOT NULL").collect()]
    found = line_rules.apply_rules(docs, max_documents=1).collect()
    assert sorted(tuple(r) for r in found) == sorted(brute_rules(rows, 1))
    assert line_rules.apply_rules(none).collect() == []


def test_frequent_lines_go_and_depleted_documents_too(spark):
    pick, rows = random.Random(2), []
    common = [prose(500 + k, 12).replace("\n", " ") for k in range(4)]
    for doc_id in range(60):
        lines = [prose(600 + doc_id * 10 + k, 15).replace("\n", " ") for k in range(pick.randint(1, 6))]
        for x in pick.sample(common, pick.randint(0, 4)):
            lines.insert(pick.randint(0, len(lines)), pick.choice([x, "  " + x.upper() + " ", x.replace(" ", "\t")]))
        rows.append((doc_id, "\n".join(lines), f"h{doc_id % 2}"))
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string, source string")
    found = line_rules.apply_rules(docs, max_documents=5).collect()
    expected = brute_rules(rows, 5)
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert len({r[-1] for r in expected if not r[-3]}) == 2  # the line rule itself decides some
    texts = {r.doc_id: r.text for r in line_rules.cleaned_texts(docs, max_documents=5).collect()}
    assert set(texts) == {r[0] for r in expected if r[-1]}
    plain = {" ".join(x.lower().split()) for x in common}
    for doc_id, text, _ in rows:
        if doc_id in texts:
            assert texts[doc_id] == "\n".join(x for x in text.split("\n") if " ".join(x.lower().split()) not in plain)


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)], len(words)


def brute_contaminated(rows, items):
    out = []
    for doc_id, text in sorted(set(rows)):
        doc, n = shingles(text)
        for item_id, item in items:
            own, size = shingles(item)
            if not own:
                continue
            best = (0, 0)
            for start in range(max(n - size, 0) + 1):  # a shorter document is one window
                window = Counter(doc[start : start + size - 4])
                common = sum((window & Counter(own)).values())
                best = max(best, (common / (window.total() + len(own) - common), -start))
            if best[0] >= 0.8:
                out.append((doc_id, item_id, round(best[0], 9)))
    return out


@pytest.fixture(scope="module")
def exam():
    items = [(k, prose(700 + k, pick)) for k, pick in enumerate([20, 25, 25, 40, 59, 17, 30, 12])]
    items += [(20, "only four words here"), (21, ""), (22, "na " * 30), (23, items[0][1])]
    pick, rows = random.Random(8), []
    for doc_id in range(90):
        words = prose(800 + doc_id, pick.randint(0, 120)).split(" ")
        item = pick.choice(items)[1].split(" ")
        edits = pick.choice([0, 0, 1, 2, 6])
        for _ in range(edits):
            item[pick.choice([0, 1, -1, -2, pick.randrange(len(item))])] = pick.choice(["zebra", "", "ibex quokka"])
        if doc_id % 3:
            at = pick.choice([0, len(words), pick.randint(0, len(words))])
            words[at:at] = [w.upper() if doc_id % 2 else w + "," for w in item]
        rows.append((doc_id, " ".join(words)))
    return rows, items


def test_contaminated_documents(spark, exam):
    rows, items = exam
    docs = importable(spark).createDataFrame([*rows, (None, items[3][1]), (300, None), rows[4]], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "x"), (30, None)], "item_id long, text string")
    found = decontaminate.find_contaminated(docs, bench).collect()
    expected = brute_contaminated(rows, items)
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in found) == sorted(expected) and len(expected) > 30
    texts = dict(rows)
    for r in found:  # the window told is one of that similarity
        doc, _ = shingles(texts[r.doc_id])
        own, _ = shingles(dict(items)[r.item_id])
        common = sum((Counter(doc[r.start_word : r.start_word + r.n_words - 4]) & Counter(own)).values())
        assert abs(common / (2 * len(own) - common) - r.similarity) < 1e-9
    left = decontaminate.without_contaminated(docs, bench)
    assert {r.doc_id for r in left.collect()} - {None} == {d for d, _ in [*rows, (300, "")]} - {e[0] for e in expected}


def test_contaminated_odd_documents(odd, none, spark):
    rows, docs = odd
    bench = importable(spark).createDataFrame([(1, prose(2, 70)), (2, prose(3, 160)), (3, "x " * 30)], "item_id long, text string")
    found = decontaminate.find_contaminated(docs, bench).collect()
    expected = brute_contaminated(rows, [(1, prose(2, 70)), (2, prose(3, 160)), (3, "x " * 30)])
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in found) == sorted(expected) and expected
    assert decontaminate.find_contaminated(none, bench).collect() == []
    assert decontaminate.find_contaminated(docs, bench.limit(0)).collect() == []


def test_documents_shorter_than_an_item(spark):
    """A document of fewer words than an item is compared with it as a whole."""
    items = [(1, prose(900, 100)), (2, prose(901, 40)), (3, prose(902, 6))]
    rows = []
    for item_id, text in items:
        words = text.split()
        for cut in range(min(len(words), 25)):
            rows += [(len(rows), " ".join(words[: len(words) - cut])), (len(rows) + 1, " ".join(words[cut:])), (len(rows) + 2, " ".join([*words[: 20 - cut], *words[20:]]))]
    expected = []
    for doc_id, text in rows:
        doc, n = shingles(text)
        for item_id, item in items:
            own, size = shingles(item)
            common = sum((Counter(doc) & Counter(own)).values())
            if n < size and common / (len(doc) + len(own) - common) >= 0.8:
                expected.append((doc_id, item_id, round(common / (len(doc) + len(own) - common), 9), 0, n))
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    sizes = {item_id: shingles(item)[1] for item_id, item in items}
    shorter = [(r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.n_words) for r in found if r.n_words < sizes[r.item_id]]
    assert sorted(shorter) == sorted(expected) and len(expected) > 40


def test_native_plans(odd, spark):
    _, docs = odd
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    for df in (line_rules.apply_rules(docs), decontaminate.find_contaminated(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_texts_of_one_id_are_judged_by_themselves(spark):
    item = prose(910, 60)
    rows = [(1, item), (1, prose(911, 60)), (2, prose(912, 30) + " " + item), (3, prose(913, 60)), (3, prose(913, 60))]
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = [tuple(r) for r in decontaminate.without_contaminated(docs, bench).collect()]
    assert sorted(left) == sorted([rows[1], rows[3], rows[4]])


def test_twin_holds_short_documents(spark):
    """The SQL twin, over documents shorter and longer than an item."""
    items = [(1, prose(900, 100)), (2, prose(901, 40)), (3, prose(902, 6))]
    rows = []
    for _, text in items:
        words = text.split()
        rows += [(len(rows) + cut, " ".join(words[cut:] + words[: cut // 2])) for cut in range(min(20, len(words)))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = con.sql(decontaminate.SQL).fetchall()
    rounded = lambda table: sorted((r[0], r[1], round(r[2], 9), r[3], r[4]) for r in table)
    assert rounded(found) == rounded(expected)
    assert sorted((r[0], r[1], round(r[2], 9)) for r in expected) == sorted(brute_contaminated(rows, items))
    assert any(r[4] < len(dict(items)[r[1]].split()) for r in expected)
