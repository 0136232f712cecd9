import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tidewheel.llm import boosting, components, exact_dedup, langid, media, minhash, packing, pieces, registry, substrings, token_files, toxicity, warc
from tidewheel.llm.support import maybe_among

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(300)]


def table(spark, rows):
    """doc_id and text with columns whose names clash with those made inside."""
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, row string, n double").withColumnRenamed("row", "_row")


def texts(seed=0, n=60):
    rng = np.random.default_rng(seed)
    out = [" ".join(rng.choice(WORDS, rng.integers(0, 120))) for _ in range(n)]
    out += [out[3], out[3], out[5] + " tail", "", None, " \n\t", "one two", "one two", out[7] + " " + out[8], "ünï cödé ▁ 日本語  x", "a" * 3000, "    y\x0bz"]
    return list(enumerate(out))


EMPTY = []


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


# ---------------------------------------------------------------- exact dedup


def test_exact_dedup_against_brute_force(spark):
    rows = texts()
    got = rows_of(exact_dedup.exact_dedup(table(spark, rows), capacity=4))
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        g = groups[t or ""]
        want = (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == want
    assert exact_dedup.exact_dedup(table(spark, EMPTY)).count() == 0
    kept = exact_dedup.drop_copies(table(spark, rows))
    assert kept.count() == len(groups) and kept.columns == ["doc_id", "text", "_row", "n"]


def test_directory_splits_and_chains(spark):
    entries = spark.range(5000).select(F.xxhash64("id").alias("h"))
    slots, depth = exact_dedup.directory(entries, 100)
    assert depth >= 6 and slots.count() == 1 << depth
    placed = entries.withColumn("slot", exact_dedup._slot(F.col("h"), depth)).join(slots, "slot")
    assert placed.count() == 5000
    assert placed.groupBy("bucket_depth", "bucket").count().agg(F.max("count")).first()[0] <= 100


# ---------------------------------------------------------------- near dedup


def bag(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def jaccard(a, b):
    if not a and not b:
        return 1.0
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [list(rng.choice(WORDS, 90)) for _ in range(12)]
    out = []
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 5):
            w = list(b)
            for p in rng.choice(90, edits, replace=False):
                w[p] = "edit" + str(rng.integers(10**6))
            out.append(" ".join(w))
    rows = list(enumerate([*out, "", None, "a b", "a b", "a b c", " ".join(["z"] * 40), " ".join(["z"] * 45)]))
    got = rows_of(minhash.near_duplicates(table(spark, rows)))
    bags = [bag(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [got[i].class_id for i in range(len(rows))] == label
    assert minhash.near_duplicates(table(spark, EMPTY)).count() == 0
    assert minhash.drop_near_duplicates(table(spark, rows)).count() == len(set(label))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(40):
        e = rng.integers(0, 2**63, 200).astype(np.uint64)
        a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
        b = np.where(rng.random(200) < 0.6, a, b)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        s = [minhash.bag_min_hash(np.zeros((x > 0).sum(), int), e[x > 0], x[x > 0], 1) for x in (a, b)]
        gaps.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(gaps)) < 3 * 0.033 / math.sqrt(40)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (3, 1), (20, 1)], "a long, b long")
    assert {r.node: r.label for r in components.components(links).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 20: 1, 8: 8, 9: 8, 7: 7}
    forest = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8)], "a long, b long")
    assert {r.node: r.label for r in components.roots(forest).collect()} == {5: 1, 4: 1, 3: 1, 1: 1, 9: 8, 8: 8}
    assert components.components(links.where("false")).count() == 0


def test_maybe_among_keeps_all(spark):
    keys = spark.range(0, 1000, 7).toDF("k")
    among = maybe_among(keys, "k", bits=1 << 15)
    got = {r[0] for r in spark.range(1000).where(among(F.col("id"))).collect()}
    assert set(range(0, 1000, 7)) <= got and len(got) < 300


# ---------------------------------------------------------------- substring dedup


def brute_cut(rows, n=20):
    seen, out = set(), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone, new = set(), set()
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            if k in seen or k in new:
                gone.update(range(p, p + n))
            new.add(k)
        seen |= new
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_substring_dedup_against_brute_force(spark):
    rng = np.random.default_rng(2)
    passage, other = " ".join(rng.choice(WORDS, 60)), " ".join(rng.choice(WORDS, 25))
    out = []
    for i in range(40):
        own = [" ".join(rng.choice(WORDS, rng.integers(0, 60))) for _ in range(3)]
        out.append(" ".join([own[0], passage if i % 3 == 0 else "", own[1], other if i % 4 == 0 else "", other if i % 8 == 0 else "", own[2]]))
    rows = list(enumerate([*out, out[1], out[1], "", None, "x " * 50, "x " * 19, other]))
    want = brute_cut(rows)
    got = rows_of(substrings.substring_dedup(table(spark, rows)))
    for i, (n, gone, kept) in want.items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (n, gone, kept)
        assert sum(s.end - s.start for s in got[i].spans) == gone
    assert substrings.substring_dedup(table(spark, EMPTY)).count() == 0


# ---------------------------------------------------------------- language and toxicity


def test_language_held_out_accuracy(spark):
    out = registry.QUERIES["op3_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.join(docs, "doc_id").where("held_out")
    assert held.count() > 30
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog " * 9 if i % 2 else "la maison et le chien " * 9, "en" if i % 2 else "fr") for i in range(60)] + [(100, None, "en"), (101, "123 !", "en"), (102, "é", None), (103, "the house " * 5000, None)], "doc_id long, text string, lang string")
    got = rows_of(langid.language_id(docs))
    assert (got[100].lang_pred, got[101].lang_pred, got[100].score) == ("und", "und", 0.0)
    assert got[103].lang_pred == "en" and got[102].lang_pred in ("en", "fr")
    assert langid.language_id(docs.where("false")).count() == 0
    nothing = langid.language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_windows_cover_whole_texts():
    data = np.frombuffer(b"abcdefghij" * 70, np.uint8)
    w, of, held = langid.cut_windows(data, np.array([0, 0, 300, 700]))
    assert held.sum() == 700 and list(np.bincount(of)) == [1, 2, 2]
    assert bytes(w[1]) + bytes(w[2][: held[2]]) == bytes(data[:300])


def test_toxicity_separates(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = list(rng.choice(WORDS, 60))
        if bad:
            for p in rng.choice(60, 4, replace=False):
                w[p] = "grobulo" + str(rng.choice(["xa", "yb", "zc"])) if i % 12 else "1diot"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = table(spark, [*rows, (900, None), (901, "")])
    lab = spark.createDataFrame([*labels, (None, 1), (901, None)], "doc_id long, toxic int")
    got = rows_of(toxicity.toxicity(docs, lab))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and len(held) > 60
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert toxicity.toxicity(docs.where("false"), lab.where("false")).count() == 0


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    p = boosting.fit(x, y, trees=40).margin(x)
    assert ((p > 0) == y).mean() > 0.9
    iso = boosting.fit_isotonic(p, y)
    s = iso(np.sort(p))
    assert (np.diff(s) >= 0).all() and 0 <= s.min() and s.max() <= 1


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def all_ids(library, rows):
    return {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}


AWKWARD = [(500, "a \n b  c\t d   e"), (501, "it's  'tis \n\n  x "), (502, "<|endoftext|> y"), (503, "　  z \x0b"), (504, " lead"), (505, "trail ")]


def test_strings_of_a_column():
    import pyarrow as pa

    from tidewheel.llm import support

    texts = ["", "a", "\u00e4 \u2581", "\U0001f600", "x" * 100, "a\x00b"]
    column = pa.array(texts)
    assert support.strings(column) == texts and support.strings(column.slice(2, 3)) == texts[2:5] and support.strings(column[:0]) == []
    assert all(type(t) is str for t in support.strings(column))


def test_token_files_round_trip(spark, library, tmp_path):
    rows = texts() + AWKWARD
    want = all_ids(library, rows)
    for encoding in ("dictionary", "delta"):
        path = f"file://{tmp_path}/{encoding}"
        token_files.write_token_files(table(spark, rows).orderBy(F.rand(1)), path, encoding=encoding)
        got = rows_of(token_files.read_tokens(spark, path))
        assert {i: list(r.ids) for i, r in got.items()} == want
        at = 0
        meta = rows_of(token_files.read_metadata(spark, path))
        for i in sorted(want):
            assert (meta[i].start, meta[i].n_tokens) == (at, len(want[i]))
            at += len(want[i])
        assert token_files.read_tokens(spark, path, 3, 5).count() == 3
    with pytest.raises(ValueError):
        token_files.write_token_files(table(spark, rows), "x", encoding="other")


def test_token_query(spark, library):
    got = rows_of(registry.QUERIES["op5_token_files"](spark, SF))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    at = 0
    for i, ids in all_ids(library, docs).items():
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_a_packing(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.choice([10, 64, 2048]))
    counts = Counter(int(rng.integers(1, cap + 1)) if rng.random() < 0.5 else int(rng.integers(1, max(2, cap // 5))) for _ in range(int(rng.choice([0, 1, 50, 3000]))))
    stretches, bins = packing.plan(counts, cap)
    held, seen = {}, Counter()
    for s, a, b, first, offset in stretches:
        seen[s] += b - a
        for i in range(b - a):
            held.setdefault(first + i, []).append((offset, s))
    assert seen == counts and set(held) == set(range(bins))
    for items in held.values():
        at = 0
        for offset, s in sorted(items):
            assert offset == at
            at += s
        assert at <= cap
    if sum(counts.values()) == 3000:
        assert bins <= 1.02 * math.ceil(sum(s * n for s, n in counts.items()) / cap) + 1
    with pytest.raises(ValueError):
        packing.plan({cap + 1: 1}, cap)


def test_packing_against_ids(spark, library):
    rows = [*texts(), (200, "word " * 5000), (201, "word " * 4094)]
    want = all_ids(library, rows)
    packed = packing.best_fit_pack(table(spark, rows), ids=True)
    out = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length <= 2048
    for i, ids in want.items():
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for p in parts for x in p.ids] == ids and [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.length == 2048 for p in parts[1:])
    for items in by_sequence.values():
        at = 0
        for r in sorted(items, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == sum(map(len, want.values()))
    assert packing.best_fit_pack(table(spark, EMPTY)).count() == 0


# ---------------------------------------------------------------- SentencePiece


def plain_sizes(v, points):
    _, scores = v.arcs(points)
    n, best, last = len(points), [0.0], [0]
    for e in range(1, n + 1):
        top = max((best[e - k] + scores[k - 1, e - k], k) for k in range(1, min(v.longest, e) + 1))
        best.append(top[0])
        last.append(top[1])
    out = []
    while n:
        out.append(last[n])
        n -= last[n]
    return out[::-1]


def test_parallel_scan_equals_viterbi():
    v = pieces.Vocabulary()
    rng = np.random.default_rng(0)
    parts = ["the", "ion ", "aa", " ", "é", "\n", "x", "▁", "日本", "in", "  ", "tion", "s"]
    for n in (3, 40, 200, 700):
        points = pieces.to_points(" " + "".join(rng.choice(parts, n)))
        want = plain_sizes(v, points)
        assert pieces.solve_small(v, points, np.array([0]), np.array([len(points)])).tolist() == want
        for chunk in (16, 37, 128):
            assert pieces.solve_giant(v, points, chunk).tolist() == want


def test_scan_is_associative():
    m = np.random.default_rng(1).integers(-9, 9, (7, 4, 4)).astype(float)
    want = m[0]
    for i, product in enumerate(pieces.scan(m)):
        if i:
            want = (want[:, :, None] + m[i][None]).max(1)
        assert (product == want).all()


def test_pieces_round_trip_and_library(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rows = texts()
    decoded = rows_of(pieces.decode_pieces(pieces.encode_pieces(table(spark, rows))))
    assert all(decoded[i].text == (t or "") for i, t in rows)
    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    own = [p for p in model.pieces if p.type == 1]
    for p, s in zip(own, pieces.piece_scores(np.array([p.score for p in own])), strict=True):
        p.score = float(s)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def total(ids):
        return sum(library.get_score(int(i)) for i in ids)

    for i, t in rows[:60]:
        # ties may be cut otherwise; the sums are equal
        assert total(decoded[i].ids) == pytest.approx(total(library.encode(t)), abs=0.05)
    codec = pieces.Codec(giant=50)
    whole = pieces.Codec(giant=10**9)
    a, b = codec.encode([t or "" for _, t in rows]), whole.encode([t or "" for _, t in rows])
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


# ---------------------------------------------------------------- media and WARC


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 64 * 256, 64 * 256 + 1, 64 * 256 * 3, 200_000])
def test_media_round_trip(size):
    data = media.pad(os.urandom(size))
    made = media.write_container(data)
    (track,) = media.read_tracks(made)
    assert media.stored_payload(made, track) == data and track["duration"] == len(data) and track["codec"] == "raw"
    ranges = media.keyframe_ranges(track)
    assert len(ranges) == -(-len(data) // (64 * 256)) and all(b - a == 64 for a, b in ranges)
    assert b"".join(made[a:b] for a, b in ranges) == b"".join(data[i : i + 64] for i in range(0, len(data), 64 * 256))
    with pytest.raises(ValueError):
        list(media.walk(made[:-1]))


def test_media_query_columns(spark):
    rows = texts()
    got = rows_of(media.media_columns(table(spark, rows)))
    for i, t in rows:
        data = media.pad((t or "").encode())
        assert (got[i].payload_sha256, got[i].tail_crc32, got[i].payload_bytes) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(data))
    assert media.media_columns(table(spark, EMPTY)).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "x" * 5000), (6, "http://f", "y" * 5000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, frame string")
    manifest = warc.write_archives(pages, frame_bytes=3000, bundle_bytes=6000)
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert (got[3].record_type, got[3].refers_to, got[4].record_type) == ("revisit", 4, "response")
    assert bytes(got[2].payload) == "<p>é</p>".encode() and got[1].payload_bytes == len("<p>é</p>".encode())
    assert got[1].payload_digest == got[2].payload_digest == warc.payload_digest("<p>é</p>".encode())
    large = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, min_payload=100)).collect()}
    assert set(large.values()) == {"response"}
    assert manifest.select("frame").distinct().count() >= 1
    assert warc.write_archives(pages.where("false")).count() == 0


def test_bundle_frames_are_plain_zstandard(spark):
    import zstandard
    from pyarrow import fs

    pages = spark.createDataFrame([(i, "http://a", f"page {i} " * 200) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, frame_bytes=5000)
    path = manifest.first().bundle
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        data = f.read()
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as z:
        assert z.read().count(b"WARC/1.1\r\n") == manifest.where(F.col("bundle") == path).count()


def test_ids_are_the_unmodified_librarys(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*AWKWARD, (600, "a <|endoftext|> b"), (601, "<|endoftext|>"), (602, "x<|endoftext|><|endoftext|> y  z"), (603, "<|endoftext| >")]
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    token_files.write_token_files(table(spark, rows), f"file://{tmp_path}/t", added=True)
    assert {i: list(r.ids) for i, r in rows_of(token_files.read_tokens(spark, f"file://{tmp_path}/t")).items()} == want
    assert {r.doc_id: list(r.ids) for r in packing.best_fit_pack(table(spark, rows), ids=True, added=True).collect()} == want
    assert 50256 in want[600]


def test_memory_forgets_what_was_used_longest_ago():
    from tidewheel.llm import bpe

    small, whole = bpe.Encoder(), bpe.Encoder()
    small.memory.stretches, small.memory.signs = 40, 400
    rng = np.random.default_rng(0)
    for _ in range(30):
        part = [" ".join(rng.choice(WORDS, 20)), "always here", "　  z "]
        a, b = small.encode(part), whole.encode(part)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
        assert small.memory.known <= 40 and small.memory.held <= 400
    assert "here" in small.memory.codes


def test_a_word_is_one_stretch_whatever_follows_it():
    from tidewheel.llm import bpe

    encoder = bpe.Encoder()
    encoder.encode(["a word word. word, word\nword word!! Étude Étude. Étude\nÉtude"])
    assert sorted(encoder.memory.codes) == sorted(["\ud800a", "word", "\ud800.", "\ud800,", "\ud800\n", "\ud800word", "\ud800!!", "Étude", "\ud800Étude"])


def test_stretches_of_any_characters_have_the_librarys_ids(library):
    from tokenizers import Tokenizer

    from tidewheel.llm import bpe

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    signs = [*"abé×÷ßÿĀя日か²1'’.…_-Ã", "e\u0301", "the", "The", "'s", "'re", "***", "\r\n", "\n\n", "<|endoftext|>", "<|end", "oftext|>", "\U0001f600", *"\n\n\t\x00\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeff", *[" "] * 14, "   "]
    rng = np.random.default_rng(5)
    texts = [None, "", *("".join(rng.choice(signs, n)) for n in rng.integers(1, 40, 3000))]
    for added, own in ((True, plain), (False, library)):
        want = [[*e.ids, 0] for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        encoder = bpe.Encoder(added=added)
        encoder.memory.stretches = 500
        for a, b in ((0, 1), (0, 3), (3, 50), (50, len(texts)), (0, 50)):
            ids, sizes = encoder.encode(texts[a:b])
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want[a:b]


def test_other_split_patterns_are_cut_at_spaces_alone(library, tmp_path):
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    from tidewheel.llm import bpe

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    split = pre_tokenizers.Split(Regex(r"\s?\S+|\s+(?!\S)|\s+"), "isolated")
    other.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(f"{tmp_path}/other.json")
    text = "the.The word,word word.\nWord x"
    ids, _ = bpe.Encoder(f"{tmp_path}/other.json").encode([text, "", text])
    want = [*other.encode(text, add_special_tokens=False).ids, 0]
    assert ids.tolist() == [*want, 0, *want]


def test_token_query_joins_rows_with_offsets_once(spark):
    plan = registry.QUERIES["op5_token_files"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "strategy=broadcast" in plan


def test_codec_forgets_and_escapes():
    small, whole = pieces.Codec(), pieces.Codec()
    small.memory.stretches = 30
    rng = np.random.default_rng(0)
    for _ in range(10):
        part = [" ".join(rng.choice(WORDS, 25)), "a\U0010ffffb ▁", "  é"]
        a, b = small.encode(part), whole.encode(part)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
        assert [t.decode() for t in small.decode(*a)] == part


def test_giant_text_takes_the_scan_at_defaults(spark, monkeypatch):
    rng = np.random.default_rng(3)
    giant = " ".join(rng.choice([*WORDS, "é▁", "日本\U0010ffff", "  "], 60_000))
    assert len(giant) > 2 * pieces.BLOCK_CHUNKS * pieces.CHUNK_CHARS > pieces.GIANT_CHARS
    codec, whole = pieces.Codec(), pieces.Codec(giant=10**9)
    a, b = codec.encode([giant]), whole.encode([giant])
    assert (a[0] == b[0]).all() and codec.memory.known == 0
    rows = [(1, giant), (None, "x"), (3, None), (3, None), (4, "")]
    got = pieces.piece_digests(table(spark, rows)).collect()
    want = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert len(got) == 5 and {(r.doc_id, r.decoded_sha256) for r in got} == want
    (g,) = [r for r in got if r.doc_id == 1]
    assert (g.n_pieces, g.ids_crc32) == (len(b[0]), zlib.crc32(b[0].astype("<u4").tobytes()))
    assert pieces.piece_digests(table(spark, EMPTY)).count() == 0


def test_stretches_are_taken_apart_together(monkeypatch):
    calls, own = [], pieces.to_points
    monkeypatch.setattr(pieces, "to_points", lambda text: calls.append(text) or own(text))
    texts = ["alpha beta  gamma", " lead", "\u2581 mark \u00e4\U0001f600", "", "trail ", "beta \u00e4"]
    codec = pieces.Codec()
    ids, sizes = codec.encode(texts)
    assert len(calls) == 1
    assert codec.decode(ids, sizes) == [t.encode() for t in texts]


def test_sentencepiece_query_round_trips(spark):
    got = rows_of(registry.QUERIES["op8_sentencepiece"](spark, SF))
    ids = rows_of(pieces.encode_pieces(spark.read.parquet(f"{SF}/documents.parquet")))
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        mine = np.array(ids[r.doc_id].ids, "<u4")
        assert (got[r.doc_id].n_pieces, got[r.doc_id].ids_crc32) == (len(mine), zlib.crc32(mine.tobytes()))
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@pytest.mark.parametrize("hash_of", [lambda c: F.length(c), lambda c: F.lit(7), lambda c: F.xxhash64(c)])
def test_exact_dedup_chains_colliding_texts(spark, hash_of):
    rows = [*texts(), (None, "aa"), (None, "aa"), (5000, "aa"), (5000, "aa"), (None, "only null"), (5001, "bb")]
    docs = table(spark, rows)
    index, _, _ = exact_dedup.build_index(docs, capacity=2, hash_of=hash_of)
    groups = Counter(t or "" for _, t in rows)
    assert index.count() == len(groups)
    best = {t: max((i for i, u in rows if (u or "") == t and i is not None), default=None) for t in groups}
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, capacity=2, hash_of=hash_of).collect())
    want = Counter((i, best[t or ""], groups[t or ""], i is not None and i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert got == want
    kept = exact_dedup.drop_copies(docs, capacity=2, hash_of=hash_of).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, t) for i, t in rows if i == best[t or ""])


def test_recall_by_similarity(spark):
    rng = np.random.default_rng(9)
    rows, pairs = [], []
    for i in range(500):
        w = [f"{x}" for x in rng.integers(0, 10**6, 104)]
        v = list(w)
        for p in rng.choice(20, i % 3, replace=False) * 5 + 2:
            v[p] = "edited"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        pairs.append(jaccard(bag(rows[-1][1]), bag(rows[-2][1])))
    got = rows_of(minhash.near_duplicates(table(spark, rows)))
    linked = np.array([got[2 * i + 1].class_id == 2 * i for i in range(500)])
    pairs = np.array(pairs)
    for low, high in ((0.8, 0.85), (0.85, 0.95), (0.95, 1.01)):
        inside = (pairs >= low) & (pairs < high)
        assert inside.sum() >= 100 and linked[inside].mean() >= 0.99
    assert not linked[pairs < 0.8].any()
