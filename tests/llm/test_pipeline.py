"""The pipeline stage by stage, and its last rows against the tokenizers library."""

import hashlib
import struct

import corpus_pipeline
import pytest
from conftest import prose, table
from test_classifiers import labelled
from test_near_duplicates import classes
from test_repeats import bytes_left
from test_rules import brute_contaminated
from tokenizers import Tokenizer

from tidewatch.llm import run_index
from tidewatch.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, marks = labelled(120)
    items = [(k, prose(900 + k, 30)) for k in range(4)]
    shared = prose(77, 60)
    rows = [(d, t + ("\n" + shared if d % 10 == 1 else "")) for d, t in rows]
    rows += [(500 + k, rows[k][1]) for k in range(0, 40, 4)]  # copies
    rows += [(600 + k, rows[k][1] + " and a tail") for k in range(1, 40, 6)]  # near copies
    rows += [(700 + k, prose(950 + k, 40) + " " + items[k % 4][1]) for k in range(8)]  # benchmark passages
    rows += [(800, None), (801, ""), (802, "one")]
    path = tmp_path_factory.mktemp("sf")
    table(spark, [(d, t, "en", "s", len(t or "")) for d, t in rows]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), [(d, t or "") for d, t in rows], items, {d: t for d, _, t in marks}


def test_stages(spark, folder):
    path, rows, items, toxic = folder
    docs = corpus_pipeline.documents(spark, path)
    columns, texts = docs.columns, dict(rows)
    seen = [texts]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        docs = corpus_pipeline.checkpointed(docs)
        found = docs.select("doc_id", "text").collect()
        seen.append({r.doc_id: r.text or "" for r in found})
        assert len(found) == len(seen[-1])
    gone = set(seen[0]) - set(seen[1])
    assert len(gone ^ {d for d in texts if toxic.get(d % 500 if 500 <= d < 540 else d - 600 if 600 <= d < 640 else d)}) <= 6
    kept = classes(sorted(seen[1].items()))
    assert set(seen[2]) == set(kept.values()) and all(seen[2][d] == seen[1][d] for d in seen[2])
    cut = {d: run_index.whole_characters(texts[d].encode(), a, b) for d, _, _, a, b in bytes_left(sorted(seen[2].items()))}
    assert seen[3] == cut and any(cut[d] != seen[2][d] for d in cut)
    leaks = {d for d, _, _ in brute_contaminated(sorted(seen[3].items()), items)}
    assert leaks and seen[4] == {d: t for d, t in seen[3].items() if d not in leaks}


def test_run(spark, folder):
    path = folder[0]
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    found = corpus_pipeline.run(spark, path).collect()
    assert found
    for r in found:
        assert r.ids == library.encode(r.decoded, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_empty_tables(spark, folder, tmp_path):
    path = folder[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
