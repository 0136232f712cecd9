"""Null keys, repeated rows, very long texts and columns whose names clash, for each operator and for the pipeline; plain versions of the classifiers' arithmetic."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from tidewheel.llm import langid, media, minhash, packing, pieces, substrings, token_files, toxicity, warc

WORDS = [f"w{i}" for i in range(500)]
CLASHING = ["_row", "row", "node", "h", "bytes", "key", "slot", "bucket", "label", "_keep", "_kept", "kept", "_toxicity", "score", "_cut_n_removed", "piece", "ids", "gone", "at", "length", "_doc", "_text", "f1"]


def rows_with_edges():
    rng = np.random.default_rng(11)
    long = " ".join(rng.choice(WORDS, 70_000))
    plain = [" ".join(rng.choice(WORDS, 60)) for _ in range(6)]
    return [(1, plain[0]), (1, plain[0]), (2, plain[0]), (None, plain[0]), (None, plain[1]), (None, plain[1]), (3, plain[2] + " x"), (4, plain[2]), (5, long), (6, plain[3] + " " + long), (7, None), (7, None), (8, ""), (9, plain[4] + " " + plain[4]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return rows_with_edges()


def table(spark, rows):
    """doc_id, text, lang, source, n_chars and twenty columns whose names operators use inside."""
    data = [(i, t, "en", "s", None if t is None else len(t), *["?"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


def of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates(spark, rows):
    bags, label = [bag(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both >= 0.8 * (bags[i].total() + bags[j].total() - both):
                label = [label[j] if x == label[i] else x for x in label]
    least = {c: min((k for (k, _), x in zip(rows, label, strict=True) if x == c and k is not None), default=None) for c in set(label)}
    want = Counter((k, least[c], k is not None and k == least[c]) for (k, _), c in zip(rows, label, strict=True))
    assert of(minhash.near_duplicates(table(spark, rows)), "doc_id", "class_id", "kept") == want
    kept = of(minhash.drop_near_duplicates(table(spark, rows)), "doc_id")
    assert kept == Counter((k,) for (k, _), c in zip(rows, label, strict=True) if k == least[c])


def test_substrings(spark, rows):
    firsts, want = {}, Counter()
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for n, ((k, _), w) in enumerate(zip(rows, split, strict=True)):
        for p in range(len(w) - 19):
            firsts.setdefault(tuple(w[p : p + 20]), []).append((k, n, p))
    for n, ((k, _), w) in enumerate(zip(rows, split, strict=True)):
        gone = set()
        for p in range(len(w) - 19):
            others = firsts[tuple(w[p : p + 20])]
            if any((o is not None and (k is None or o < k)) or (m == n and q < p) for o, m, q in others):
                gone.update(range(p, p + 20))
        want[k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert of(substrings.substring_dedup(table(spark, rows)), "doc_id", "n_words", "n_removed", "kept_text") == want


def test_hot_groups_are_lengthened_and_salted(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 3)
    monkeypatch.setattr(substrings, "HELD", 8)
    rng = np.random.default_rng(3)
    line = " ".join(rng.choice(WORDS, 9))
    passage = " ".join(rng.choice(WORDS, 30))
    rows = [(i, " ".join([*rng.choice(WORDS, 14), line, *rng.choice(WORDS, 14), passage if i % 2 else "", *rng.choice(WORDS, 9)])) for i in range(60)]
    seen, want = set(), Counter()
    for i, t in rows:
        w = t.split()
        gone = set()
        for p in range(len(w) - 19):
            if tuple(w[p : p + 20]) in seen:
                gone.update(range(p, p + 20))
        seen |= {tuple(w[p : p + 20]) for p in range(len(w) - 19)}
        want[i, len(gone)] += 1
    assert of(substrings.substring_dedup(table(spark, rows).repartition(9)), "doc_id", "n_removed") == want


def test_tokens_and_packing(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter((k, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for k, t in rows)
    token_files.write_token_files(table(spark, rows), f"file://{tmp_path}/t", added=True)
    got = token_files.read_tokens(spark, f"file://{tmp_path}/t").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == ids
    starts = sorted((r.start, r.n_tokens) for r in token_files.read_metadata(spark, f"file://{tmp_path}/t").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    packed = packing.best_fit_pack(table(spark, rows), added=True).collect()
    assert sum(r.length for r in packed) == sum(len(i) * n for (_, i), n in ids.items())
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(k for k, _ in rows)
    held = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert held.get(r.sequence_id, 0) == r.offset
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 2048


def test_language_and_toxicity(spark, rows):
    out = langid.language_id(table(spark, rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter(k for k, _ in rows) and {r.lang_pred for r in out} <= {"en", "und"}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in out)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (5, None), (9, 0)], "doc_id long, toxic int")
    scored = toxicity.toxicity(table(spark, rows), labels).collect()
    assert Counter(r.doc_id for r in scored) == Counter(k for k, _ in rows) and all(0 <= r.score <= 1 for r in scored)
    kept = toxicity.score(table(spark, rows), toxicity.train(table(spark, rows), labels))
    assert set(kept.columns) == {*table(spark, rows).columns} and kept.count() == len(rows)


def test_media_pieces_and_pages(spark, rows):
    want = Counter((k, hashlib.sha256(media.pad((t or "").encode())).hexdigest()) for k, t in rows)
    assert of(media.media_columns(table(spark, rows)), "doc_id", "payload_sha256") == want
    digests = Counter((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    assert of(pieces.piece_digests(table(spark, rows)), "doc_id", "decoded_sha256") == digests
    decoded = pieces.decode_pieces(pieces.encode_pieces(table(spark, rows)))
    assert of(pieces.decode_pieces(decoded), "doc_id", "text") == Counter((k, t or "") for k, t in rows)
    pages = table(spark, rows).withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    got = of(warc.read_archives(warc.write_archives(pages), payloads=True), "page_id", "payload_bytes")
    assert got == Counter((k, len((t or "").encode())) for k, t in rows)


def test_pipeline(spark, rows, tmp_path):
    docs = table(spark, rows)
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns
            assert docs.where("`_toxicity` <> '?' OR `_cut_n_removed` <> '?'").count() == 0
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {None, 2, 3, 5, 8, 9}


def test_folded_convolution_is_the_direct_one():
    rng = np.random.default_rng(0)
    network = langid.fit(rng.integers(0, 256, (200, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 200), ["a", "b", "c"], epochs=2)
    windows = rng.integers(0, 256, (9, langid.WINDOW)).astype(np.uint8)
    got = langid.pool_folded(windows, *network.folded())
    for i, w in enumerate(windows):
        x = network.embedding[np.append(w, np.zeros(max(langid.WIDTHS), np.uint8))]
        direct = [max(float((x[t : t + k] * f[:, :, n]).sum()) for t in range(langid.WINDOW)) for k, f in zip(langid.WIDTHS, network.filters, strict=True) for n in range(f.shape[2])]
        assert np.allclose(got[i], np.array(direct) + network.bias, atol=1e-3)


def test_features_are_those_of_plain_python():
    texts = ["You IDIOT!! stop", "", "nice day, 10 a b c x", "ünï m0ron's you", "Hello HELLO h3llo"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), offsets, np.zeros(0, np.uint64))
    fold = bytes.maketrans(b"0134578@$", b"oieastbas")
    for t, r, x in zip(texts, raw, got, strict=True):
        low = bytes(b + 32 if 65 <= b < 91 else b for b in r).translate(fold)
        words = re.findall(rb"[a-z\x80-\xff]+", low)
        n, size = max(len(words), 1), max(len(r), 1)
        listed = sum(w.decode("utf-8", "replace") in toxicity.INSULTS for w in words)
        person = sum(w.decode("utf-8", "replace") in toxicity.SECOND_PERSON for w in words)
        upper = [65 <= b < 91 for b in r]
        assert x[0] == pytest.approx(listed / n) and x[2] == pytest.approx(math.log1p(listed)) and x[5] == pytest.approx(person / n)
        assert x[6] == pytest.approx(sum(upper) / size) and x[9] == pytest.approx(r.count(b"!") / size)
        assert x[10] == pytest.approx(sum(48 <= b < 58 for b in r) / size) and x[13] == pytest.approx(math.log1p(len(words)))
        assert x[15] == pytest.approx(sum(b >= 128 for b in r) / size), t
