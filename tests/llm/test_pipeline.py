"""Each stage of the pipeline against a brute-force version of it, on its own input."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidewheel.llm import toxicity

WORDS = [f"w{i}" for i in range(400)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    passage = " ".join(rng.choice(WORDS, 55))
    rows, labels = [], []
    for i in range(240):
        w = list(rng.choice(WORDS, rng.integers(30, 90)))
        bad = i % 8 == 0
        if bad:
            for p in rng.choice(30, 4, replace=False):
                w[p] = "worthless" if i % 16 else "moron"
        t = " ".join(w)
        if i % 10 == 3:
            t += " " + passage
        if i % 30 == 7:
            t = rows[i - 1][1]
        if i % 30 == 11:
            t = rows[i - 1][1] + " more"
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "one two", "en", "s", 7)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    if not a and not b:
        return True
    both = sum((a & b).values())
    return both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)


def test_stages(spark, tables, tmp_path):
    docs, kept = spark.read.parquet(f"{tables}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        kept.append(len(rows))
        if k < 4:
            assert after.columns == COLUMNS
        if name == "toxicity":
            scored = toxicity.toxicity(docs, spark.read.parquet(f"{tables}/labels.parquet")).where("predicted = 0").collect()
            assert {r.doc_id for r in rows} == {r.doc_id for r in scored}
            assert 190 <= len(rows) <= 225
        elif name == "exact dedup":
            want = {}
            for i in sorted(before):
                want[before[i].text or ""] = i
            assert {r.doc_id for r in rows} == set(want.values())
        elif name == "near dedup":
            ids = sorted(before)
            bags = {i: bag(before[i].text) for i in ids}
            label = {i: i for i in ids}
            for i in ids:
                for j in ids:
                    if j < i and label[i] != label[j] and alike(bags[i], bags[j]):
                        a, b = sorted((label[i], label[j]))
                        label = {x: a if y == b else y for x, y in label.items()}
            assert {r.doc_id for r in rows} == set(label.values())
        elif name == "substring dedup":
            seen, changed = set(), 0
            got = {r.doc_id: r for r in rows}
            assert set(got) == set(before)
            for i in sorted(before):
                w = re.findall(r"[^\x20\x09-\x0D]+", before[i].text or "")
                gone = set()
                for p in range(len(w) - 19):
                    if tuple(w[p : p + 20]) in seen:
                        gone.update(range(p, p + 20))
                    seen.add(tuple(w[p : p + 20]))
                want = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else before[i].text
                changed += bool(gone)
                assert got[i].text == want
                assert got[i].n_chars == (len(want) if gone else before[i].n_chars)
            assert changed > 5
        else:
            ends = Counter()
            for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
                assert r.offset == ends[r.sequence_id]
                ends[r.sequence_id] += r.length
            assert {r.doc_id for r in rows} == set(before) and max(ends.values()) <= 2048
        docs = after
    assert kept[0] > kept[1] > kept[2] == kept[3]


def test_empty_tables(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 0")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
