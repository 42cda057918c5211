"""The pipeline, stage by stage and whole, against plain versions."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specdag.llm.common import materialize
from tests.llm.test_operators import JSON, edited, groups, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(20)
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    words = [f"w{i}" for i in range(300)]
    texts = [prose(i, 60, words) + "." for i in range(90)]
    junk = [" ".join(w + "%%%" for w in prose(500 + i, 50, words).split()) for i in range(40)]
    copies = [edited(texts[i % 9], r, 0.005 if i % 2 else 0.0) for i in range(30)]
    items = [prose(900 + i, 40, words) for i in range(3)]
    leaks = [f"{prose(950 + i, 30, words)} {items[i]} {prose(960 + i, 30, words)}" for i in range(3)]
    private = [f"{prose(980 + i, 40, words)} mail a{i}@b.example.com or 10.0.0.{i} today" for i in range(5)]
    every = [*texts, *junk, *copies, *leaks, *private, None, "", "short text here"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(every)] + [(None, "no id " + texts[50], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(not 90 <= i < 130), 0) for i in range(len(every)) if i % 2 == 0]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, every, items


def test_stages(spark, corpus):
    folder, every, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), "test-stage")
        after.append(docs.collect())
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.DOCUMENTS), name
    good, single, clean, redacted, pieces = after
    ids = [r["doc_id"] for r in good]
    assert not set(ids) & set(range(90, 130)) and set(range(90)) <= set(ids) and None in ids
    named = sorted((r["doc_id"], r["text"]) for r in good if r["doc_id"] is not None)
    _, comp = groups([t for _, t in named], 5)
    want = {named[i][0] for i in range(len(named)) if comp[i] == i}
    assert {r["doc_id"] for r in single} == want | {None}
    assert {r["doc_id"] for r in single} - {r["doc_id"] for r in clean} == {i for i, t in enumerate(every) if i in want and t and any(x in t for x in items)} != set()
    texts = {r["doc_id"]: r for r in redacted}
    assert set(texts) == {r["doc_id"] for r in clean}
    for i in range(5):
        own = texts[every.index(next(t for t in every if t and f"a{i}@b.example.com" in t))]
        assert own["text"].endswith("mail <EMAIL> or <IP> today") and own["n_chars"] == len(own["text"])
    same = [r for r in redacted if r["text"] and "<EMAIL>" not in r["text"]]
    assert all(r["text"] == every[r["doc_id"]] for r in same if r["doc_id"] is not None)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    for r in redacted:
        own = sorted((p["start"], p["ids"], p["ids_crc32"]) for p in pieces if p["doc_id"] == r["doc_id"])
        assert [i for _, p, _ in own for i in p] == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        assert all(crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p)) for _, p, crc in own)


def test_run(spark, corpus):
    folder, _, _ = corpus
    found = corpus_pipeline.run(spark, folder)
    assert found.groupBy("doc_id").agg(F.sum("length") == F.max("doc_tokens")).filter("NOT `(sum(length) = max(doc_tokens))`").count() == 0
    assert found.count() > 90


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _spans int, score string, _id int, component_id int, _first string, start int"


def folder_of(spark, tmp_path, docs, labels, items):
    folder = f"file://{tmp_path}"
    spark.createDataFrame(docs, EXTRA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark", "all"])
def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path, empty):
    more = (1, "x", 2, 3, "y", 4)
    docs = [(i, prose(i, 40), "en", "s", 1, *more) for i in range(12)] + [(None, None, None, None, None, *more), (20, "", None, None, None, *more)]
    labels = [(i, i % 2, 0) for i in range(12)]
    items = [(1, prose(900, 20)), (2, None)]
    folder = folder_of(spark, tmp_path, [] if empty in ("documents", "all") else docs, [] if empty in ("labels", "all") else labels, [] if empty in ("benchmark", "all") else items)
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        again = spark.createDataFrame(rows.collect(), rows.schema)
        if name != "packing":
            extra = set(EXTRA.replace(",", "").split()[::2]) - set(corpus_pipeline.DOCUMENTS)
            again = again.withColumns({c: F.lit(7) for c in sorted(extra)})  # each stage meets names that clash with its own
        rows = stage(spark, again, folder)
        assert rows.columns == list(corpus_pipeline.DOCUMENTS) or name == "packing", name
    if empty in ("documents", "all"):
        assert rows.count() == 0
    elif empty != "benchmark":  # without labels nothing is rejected
        assert {r["doc_id"] for r in rows.collect()} == {*range(12), None, 20}


def test_repeated_rows_and_ids(spark, tmp_path):
    a, b = prose(1, 60), prose(2, 60)
    more = (1, "x", 2, 3, "y", 4)
    rows = [(3, a), (3, a), (5, a), (7, b), (7, b + " tail"), (9, b), (11, ""), (11, ""), (13, None), (None, a), (None, a)]
    folder = folder_of(spark, tmp_path, [(i, t, "en", "s", 1, *more) for i, t in rows], [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(3, a), (7, b + " tail"), (11, ""), (13, None), (None, a), (None, a)], key=repr)
