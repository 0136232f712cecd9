"""Token alignment, SimHash and the source audit against plain versions, with nulls, repeats, long and empty texts, and clashing names."""

import hashlib
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tidewheel.llm import alignment, divergence, simhash, substrings, words
from tidewheel.llm.support import removed, stored

SF = "/root/testdata/sf0.001"
CLASHING = ["key", "text_", "block", "code", "codes", "n", "a", "b", "group", "print", "row", "bits", "choice", "label", "term", "docs", "p", "q", "value", "rank", "_doc"]
RNG = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(60)]


def rows_with_edges():
    plain = [" ".join(RNG.choice(WORDS, 40)) for _ in range(12)]
    long = " ".join(RNG.choice(WORDS, 60_000))
    odd = ["<s> x</s> <|endoftext|>  double  sp \n nl\n\n ", "ünï 日本 \U0001f600 ½ﬁ\x00 　 x\xa0y", "a ▁ b it was the", " lead", "tail ", "It's don't\tTab", "x" * 3000, "é" * 50]
    return [*enumerate(plain), (3, plain[3]), (3, plain[3]), (None, plain[4]), (None, "alone here"), (50, long), (51, None), (52, ""), (53, " "), (53, None), (54, " \n\t"), *((60 + i, t) for i, t in enumerate(odd)), (90, plain[5] + " more"), (91, "One two"), (92, "one TWO")]


def table(spark, rows):
    data = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", *["?"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="module")
def rows():
    return rows_with_edges()


# ---------------------------------------------------------------- alignment


def plain_alignment(texts):
    """For each text: None, or ids of both sides, links and written groups, by walking along both token lists."""
    both, out = alignment.pair(), []
    for t in texts:
        out.append(None)
        if not t:
            continue
        want = (" " + t).encode()
        ids = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
        sides = [[(i, entries[i]) for i in x] for x, entries in zip(ids, (both.a_bytes, both.b_bytes), strict=True)]
        if any(b"".join(e for _, e in side) != want for side in sides):
            continue
        ends = [np.cumsum([len(e) for _, e in side]).tolist() for side in sides]
        place = [{e: i + 1 for i, e in enumerate(x)} for x in ends]
        cuts, links, groups, at = sorted(set(ends[0]) & set(ends[1])), [], [], [0, 0]
        for cut in cuts:
            part = []
            for k in (0, 1):
                to = place[k][cut]
                part.append(ids[k][at[k] : to])
                at[k] = to
            links.append((part[0][-1], part[1][-1]))
            groups.append("|".join(",".join(map(str, p)) for p in part))
        out[-1] = (len(ids[0]), len(ids[1]), links, ";".join(groups))
    return out


@pytest.mark.parametrize("size", [200, 1 << 25])
def test_alignment_equals_plain_walk(spark, rows, size):
    plain = plain_alignment([t for _, t in rows])
    counts = Counter(x for p in plain if p for x in p[2])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for (i, _), p in zip(rows, plain, strict=True):
        if p is None:
            want[(i, 0, 0, 0, 0, 0, 0, "")] += 1
        else:
            n_a, n_b, links, groups = p
            want[(i, n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), groups)] += 1
    got = Counter(tuple(r) for r in alignment.cross_align(table(spark, rows), size=size).collect())
    assert got == want
    assert sum(p is None for p in plain) == 4  # null, null, empty and U+2581


def test_alignment_of_no_rows_and_digests(spark):
    empty = table(spark, [])
    assert alignment.cross_align(empty).count() == 0
    one = table(spark, [(7, "it was the"), (8, None)])
    texts = {r.doc_id: r.groups for r in alignment.cross_align(one).collect()}
    found = {r.doc_id: r.groups_sha256 for r in alignment.cross_align(one, groups="digest").collect()}
    assert found == {7: hashlib.sha256(texts[7].encode()).hexdigest(), 8: ""}


def test_stretches_join_to_their_text():
    for _, t in rows_with_edges():
        assert " ".join(alignment.stretches(t or "")) == (t or "")
    assert alignment.stretches("a b  c d ") == ["a", "b  c", "d "]
    assert len(alignment.byte_alphabet()) == 256 and set(alignment.byte_alphabet().values()) == set(range(256))


# ---------------------------------------------------------------- SimHash


def plain_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return label


def test_simhash_against_plain_version(spark, rows):
    prints = [plain_print(t) for _, t in rows]
    label = plain_components(prints)
    least = {c: min((k for (k, _), x in zip(rows, label, strict=True) if x == c and k is not None), default=None) for c in set(label)}
    want = Counter((k, f"{p:016x}", least[c]) for (k, _), p, c in zip(rows, prints, label, strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(table(spark, rows)).collect())
    assert got == want
    assert simhash.simhash_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("full", [5, 1024])
def test_print_links_reach_all_near_fingerprints(spark, full):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 5)]
    prints = {int(x) for x in rng.integers(0, 2**63, 200)}
    for b in base:  # crowds around some fingerprints, and chains that lead away from them
        prints |= {b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(60)}
        far = b
        for _ in range(6):
            far ^= sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
            prints.add(far)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = simhash.distance_table(spark.createDataFrame([(p,) for p in signed], "print long"))
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.print_links(table, full=full).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    label = {p: p for p in prints}
    for a, b in links:
        if label[a] != label[b]:
            old, new = label[a], label[b]
            label = {p: new if x == old else x for p, x in label.items()}
    want = plain_components(prints)
    pairs = {(label[p], w) for p, w in zip(prints, want, strict=True)}
    assert len(pairs) == len(set(label.values())) == len(set(want))


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 500).astype(np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    gap = np.abs(simhash.distances(x).astype(int) - simhash.distances(y).astype(int))
    assert (gap.max(1) <= 3).all()
    assert (np.abs(simhash.distances(x[:250]).astype(int) - simhash.distances(x[250:]).astype(int)).max(1) > 3).mean() > 0.95


# ---------------------------------------------------------------- divergence


def plain_divergence(rows, least, top):
    def split(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or c >= "\x80" else " " for c in t or "")
        return [w for w in low.split(" ") if w]

    docs = [(lang or "", source or "", split(t)) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for x, _, ws in docs if x == lang for w in set(ws))
        kept = [w for w, n in df.items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 2) // (total + 2 * len(kept)) for w in kept}

        counts = {s: Counter(w for x, y, ws in docs if (x, y) == (lang, s) for w in ws) for s in {d[1] for d in docs if d[0] == lang}}
        q, p = shares(sum(counts.values(), Counter())), {s: shares(c) for s, c in counts.items()}

        def apart(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            items = {"pair": [(sum(apart(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s], "term": [(apart(p[s][w], q[w]), w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]}
            for part, found in items.items():
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[: top if part == "term" else None])]
    return Counter(out)


@pytest.mark.parametrize(("least", "width"), [(1, 1 << 22), (3, 64), (100, 1 << 22)])
def test_divergence_equals_plain_version(spark, rows, least, width, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    data = [(t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}") for i, t in rows]
    got = Counter(tuple(r) for r in divergence.divergence(table(spark, rows).repartition(3), least=least, width=width).collect())
    assert got == plain_divergence(data, least, 10)


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(table(spark, [])).count() == 0


def test_sketch_keeps_all_frequent_terms(spark):
    tally = stored(divergence.tallies(table(spark, [(i, f"t{chr(97 + i % 7)} rare{chr(97 + i % 26)}x{chr(97 + i // 26)}") for i in range(80)])), "tally")
    kept = {r.term for r in tally.where("term IS NOT NULL").where(divergence.possible(tally.where("term IS NOT NULL"), 5, 1 << 10)).collect()}
    assert {f"t{c}" for c in "abcdefg"} <= kept and len(kept) < 40
    removed(tally)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_divergence_query_equals_its_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = divergence.op13_source_divergence(spark, SF)
    want = duckdb.sql(divergence.OP13_SQL)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


# ---------------------------------------------------------------- equal texts and long words


def colliding(n=8192):
    """Two texts without a common window whose power sums modulo 2**64 agree, whatever the base: Thue-Morse order and its opposite."""
    bit = [i.bit_count() & 1 for i in range(n // 2)]
    return [" ".join(w for i, x in enumerate(bit) for w in (f"x{x ^ flip}", f"u{i}")) for flip in (0, 1)]


def test_texts_of_colliding_sums_are_not_copies(spark):
    a, b = colliding()
    got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(table(spark, [(1, a), (2, b), (3, a)])).collect()}
    assert got == {1: 0, 2: 0, 3: 8192}


def test_long_words_of_colliding_sums_differ():
    a, b = (bytes(97 + (i.bit_count() + flip) % 2 for i in range(1024)) for flip in (0, 1))
    found = words.find(np.frombuffer(a + b" " + b, np.uint8), np.array([0, 2049]))
    assert len(found.hash) == 2 and found.hash[0] != found.hash[1]
