import re

import numpy as np
import pytest
import xxhash
from oddrows import DOCUMENTS

from spanloom.llm import simhash as S


def plain(text, k=4, seed=42):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    k = min(k, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, prints, distance):
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = top(i), top(j)
                up[a] = b
    out = []
    for i in range(len(ids)):
        out.append(min(ids[j] for j in range(len(ids)) if top(j) == top(i)))
    return out


@pytest.mark.parametrize("text", [None, "", " \t", "one", "one two three", "one Two three four", "É ß A b " * 9, "a b " * 700, "\u0000 x\u000b\u000cy z w v"])
def test_fingerprint(text):
    assert S.fingerprint(text)[0] & (1 << 64) - 1 == plain(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(map(str, range(5000)))
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "_CHUNK", 700)
    assert S.fingerprint(text) == want


def near(rng, base, n, bits):
    out = []
    for _ in range(n):
        x = base
        for b in rng.choice(64, bits, replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_links_against_brute_force(spark):
    """Chains, pairs at exactly 4 and 5 bits, large groups, and noise."""
    rng = np.random.default_rng(2)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for base in prints[:10]:
        for bits in (1, 2, 3, 4, 5):
            prints += near(rng, base, 4, bits)
    x = prints[20]
    for i in range(30):  # a chain: its ends are far apart
        x ^= 1 << (2 * i) | 1 << (2 * i + 1)
        prints.append(x)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s, [s]) for s in signed], "node long, fp array<long>")
    roots = {r.node: r.root for r in S.link(nodes).collect()}
    want = brute(signed, prints, 4)
    first = {}
    got = [first.setdefault(roots[s], w) for s, w in zip(signed, want)]
    assert got == want and len(set(roots.values())) == len(set(want))


@pytest.mark.parametrize("n", [10, 1 << 25, 1 << 30])
def test_every_width_is_exact(spark, n, monkeypatch):
    """All pairs of 4 differing bits are found by the keys of any number of fingerprints, in large components too."""
    monkeypatch.setattr(S, "LARGE", 5)
    scheme = S.exact_scheme(n)
    rng = np.random.default_rng(n)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    for base in prints[:8]:
        prints += near(rng, base, 3, 4) + near(rng, base, 3, 5) + near(rng, base, 6, 2)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = {r.node: r.root for r in S.link(spark.createDataFrame([(s, [s]) for s in signed], "node long, fp array<long>"), scheme).collect()}
    want, first = brute(signed, prints, 4), {}
    assert [first.setdefault(roots[s], w) for s, w in zip(signed, want)] == want and len(set(roots.values())) == len(set(want))


def test_parities_reject_no_similar_pair():
    """The parities of two sets differ in no more places than the sets do."""
    rng = np.random.default_rng(1)
    for common, a, b in ((80, 10, 10), (4, 1, 0), (4000, 500, 500)):
        x = rng.integers(0, 1 << 63, common + a + b).astype(np.uint64)
        one, two = (np.array(S._parity(h)) for h in (x[: common + a], np.r_[x[:common], x[common + a :]]))
        assert sum(int(v & (1 << 64) - 1).bit_count() for v in (one ^ two).tolist()) <= a + b
        assert S.alike(np.sort(x[: common + a]), [np.sort(np.r_[x[:common], x[common + a :]])])[0] == (5 * common >= 4 * (common + a + b))


@pytest.mark.parametrize("local", [0, 10, 10**6])
def test_components_against_union_find(spark, local):
    edges = [(i, i + 1) for i in range(80)] + [(1000, 1000 + i) for i in range(60)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(len, groups.values())) == [2, 60, 81]


def test_no_edges(spark):
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    rows = S.op8_simhash_neardup(spark, sf_dir).collect()
    ids, prints = [r.doc_id for r in rows], [int(r.fingerprint, 16) for r in rows]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert prints == [plain(texts[i]) for i in ids]
    assert [r.component_id for r in rows] == brute(ids, prints, 4)


def test_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in S.op8_simhash_neardup(spark, odd).collect()}
    assert rows[1].fingerprint == "0" * 16 and rows[1].component_id == rows[2].component_id == rows[3].component_id == 1
    assert rows[5].component_id == 4 and rows[None].component_id is None


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    rows, copies, i = [], set(), 0
    for _ in range(40):
        base = words(rng, 300)
        rows.append((i, " ".join(base), "en", "s", 0))
        for _ in range(3):
            i += 1
            own = list(base)
            for at in rng.choice(300, 4, replace=False):  # 20 shingles of 296 change at most: similarity 0.87 at least
                own[at] = words(rng, 1)[0]
            rows.append((i, " ".join(own), "en", "s", 0))
            copies.add(i)
        i += 1
    for _ in range(200):
        rows.append((i, " ".join(words(rng, 100)), "en", "s", 0))
        i += 1
    passage = " ".join(words(rng, 60))  # shared, but a small part of each text
    for _ in range(30):
        rows.append((i, " ".join([*words(rng, 200), passage]), "en", "s", 0))
        i += 1
    df = spark.createDataFrame(rows, DOCUMENTS)
    kept = S.keep_one(df)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and {r[0] for r in rows} - copies <= ids and len(ids & copies) <= 2


def test_keep_one_of_odd_rows(spark, odd):
    rows = S.keep_one(spark.read.parquet(f"{odd}/documents.parquet")).collect()
    # The texts without words are alike; so are 4 and both rows of 5.
    assert sorted(str(r.doc_id) for r in rows) == ["1", "4", "6", "7", "8", "None"]


@pytest.mark.parametrize("n", [0, 1, 1000, 10**6, 10**10])
def test_schemes_fit_their_words(n):
    s = S.near_scheme(n)
    assert all(x.shift + x.width <= 64 and x.word < s.words for x in s.segments)
    used = [(x.word, b) for x in s.segments for b in range(x.shift, x.shift + x.width)]
    assert len(used) == len(set(used))


def pair_of(rng, common, own):
    """Two texts whose sets of 5-word shingles have ``common`` hashes in common and ``own`` for each alone."""
    base = words(rng, common + 4)
    return [" ".join(base + words(rng, own)) for _ in range(2)]


def test_exact_similarity_decides(spark):
    """Pairs just below a similarity of 0.8 stay, pairs at it and above go, whatever chance does to their fingerprints."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(0, 480, 2):  # 240 / 300 is 0.8, 240 / 304 is 0.789
        a, b = pair_of(rng, 240, 30 if i % 4 else 32)
        rows += [(i, a, "en", "s", 0), (i + 1, b, "en", "s", 0)]
    ids = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert {i for i in range(480) if i % 2 == 0 or i % 4 == 1} <= ids
    assert len([i for i in ids if i % 4 == 3]) <= 1


@pytest.mark.parametrize("n", [10, 10**5, 10**6, 10**7, 10**9])
def test_size_changes_only_the_look_up(n):
    """The same fingerprint and limit for every size, and pairs at a similarity of 0.8 meet in a table."""
    s, small = S.near_scheme(n), S.near_scheme(0)
    assert (s.words, s.distance, s.segments) == (small.words, small.distance, small.segments)
    rng, missed = np.random.default_rng(n), 0
    bits = [[64 * s.segments[i].word + s.segments[i].shift + b for i in t for b in range(s.segments[i].width)] for t in s.tables]
    for _ in range(2000):  # in 0.1515 of the bits they differ
        differ = rng.random(64 * s.words) < 0.1515
        missed += bool(differ[np.array(bits)].any(axis=1).all())
    assert missed <= 8


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rng = np.random.default_rng(8)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(4, a, "en", "s", 0), (5, a, "en", "s", 0), (5, b, "en", "s", 0), (5, c, "en", "s", 0), (5, c, "en", "s", 0)]
    kept = S.keep_one(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(4, a), (5, b), (5, c)])
