import math
from collections import Counter, defaultdict

import pytest

from spanloom.llm import language as L

TEXTS = {"a": [b"banana bandana", b"an"], "b": [b"mississippi", "müssen".encode()], "c": [b"x"]}


def brute(text: bytes, corpus) -> float:
    seen = defaultdict(Counter)
    for x in corpus:
        for i in range(len(x)):
            for k in range(min(i, L.ORDER) + 1):
                seen[x[i - k : i]][x[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(i, L.ORDER), -2, -1):
            if k < 0:
                bits += 8
                break
            c = seen.get(text[i - k : i])
            if c and text[i] in c:
                bits -= math.log2(c[text[i]] / (c.total() + len(c)))
                break
            bits -= math.log2(len(c) / (c.total() + len(c))) if c else 0
    return bits


@pytest.mark.parametrize("text", [b"banana", b"missan ban", b"\xff\x00zz", b"x", b"bandana mississippi " * 30])
def test_code_lengths_against_trees(text):
    m = L.train(TEXTS)
    got = L.code_lengths(m, [b"an", text, b"y"])[1]
    assert got == pytest.approx([brute(text, TEXTS[x]) for x in m.languages], abs=1e-3)


def test_long_text_is_scored_in_pieces(monkeypatch):
    m = L.train(TEXTS)
    text = b"banana mississippi " * 70_000
    short = L.code_lengths(m, [text[:19 * 1000]])[0] * 70
    assert L.code_lengths(m, [text])[0] == pytest.approx(short, rel=1e-3)


def test_scoring_takes_little_memory_beside_the_texts():
    import tracemalloc

    m = L.train(TEXTS)
    texts = [b"banana mississippi " * 200] * 500 + [b"banana mississippi " * 60_000]
    tracemalloc.start()
    L.code_lengths(m, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_no_python_workers_for_the_chosen_ids(spark, odd, monkeypatch):
    """Rows given to Spark go through Python workers of a daemon of their own."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")

    def never(*_):
        raise AssertionError("rows given to Spark")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", never)
    assert L.sample(docs, L.crc32_mod(L.F.col("doc_id"), 5) != 0)
    assert L.sample(docs.where("false"), L.F.lit(True)) == {}


def test_no_letter_and_nothing_learned():
    m = L.train(TEXTS)
    assert [x[:2] for x in L.predict(m, [None, "", "12 !? 3", "\n"])] == [("und", 0.0)] * 4
    assert L.predict(L.train({}), ["abc"])[0][:2] == ("und", 0.0)


def test_held_out_accuracy(spark, sf_dir):
    rows = L.op3_language(spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_held_out_rows_are_not_learned(spark, table):
    from oddrows import DOCUMENTS

    import zlib

    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "zebra zoo", "zz", "s", 9) for i in held] + [(i, "apple pie", "aa", "s", 9) for i in free]
    got = L.op3_language(spark, table("documents", rows, DOCUMENTS)).collect()
    assert {r.lang_pred for r in got} == {"aa"}


def test_long_texts_are_learned_up_to_the_bound(spark, monkeypatch):
    """A language of long texts only, and one whose first text is long, fill their samples."""
    from oddrows import DOCUMENTS
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "SAMPLE_BYTES", 1000)
    rows = [(i, "zebra zoo " * 200, "zz", "s", 9) for i in range(3)] + [(i, "apple pie " * (90 if i % 2 else 1), "aa", "s", 9) for i in range(10, 60)]
    got = L.sample(spark.createDataFrame(rows, DOCUMENTS), F.lit(True))
    assert {lang: sum(map(len, x)) for lang, x in got.items()} == {"aa": 1000, "zz": 1000}
    assert got["zz"] == [("zebra zoo " * 100).encode()]


def test_query_against_trees(spark, table):
    """Every row of the query, its language and bits from trees of the rows that aren't held out."""
    import zlib

    from oddrows import DOCUMENTS

    said = {"aa": "banana bandana an", "bb": "mississippi missing sip", "cc": "zürich größe"}
    rows = [(i, f"{said[x]} {x}{i * 7 % 11} " * (1 + i % 3), x, "s", 9) for i, x in enumerate(["aa", "bb", "cc"] * 12)]
    rows += [(100, None, "aa", "s", 0), (101, "12 34", "bb", "s", 0), (102, "ban miss", None, "s", 0)]
    corpus = defaultdict(set)
    for i, text, lang, _, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 and text and lang:
            corpus[lang].add((i, text))
    got = {r.doc_id: r for r in L.op3_language(spark, table("documents", rows, DOCUMENTS)).collect()}
    assert len(got) == len(rows)
    for i, text, _, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not text or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        raw = text.encode()
        bits = {x: brute(raw, [t.encode() for _, t in c]) / len(raw) for x, c in corpus.items()}
        best = min(sorted(bits), key=bits.get)
        assert got[i].lang_pred == best and got[i].bits == pytest.approx(bits[best], abs=1e-3)
        assert got[i].score == pytest.approx(1 / sum(2 ** (L.SHARPNESS * (bits[best] - b)) for b in bits.values()), abs=1e-2)


def test_foreign_and_random_texts_go(spark, sf_dir):
    """Languages and scripts that no document teaches, and random letters; short odd texts stay."""
    import random

    rnd = random.Random(1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    foreign = [
        "Dlaczego nie możemy zrobić tego jutro rano, powiedział nauczyciel do uczniów przed wyjazdem.",
        "Het is vandaag mooi weer en wij gaan met de kinderen naar het strand om te zwemmen, zei zij.",
        "これは日本語の文章です。言語の識別に使います。明日は雨が降るでしょう。傘を持って行きます。",
        "Сегодня хорошая погода, и мы пойдём с детьми на пляж, а вечером вернёмся домой.",
        "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)),
    ]
    planted = spark.createDataFrame([(-1 - i, x, None, None, 0) for i, x in enumerate([*(f"{x} " * 3 for x in foreign), "A.", "token = 9dd3c8", "Q7-x9!"])], docs.schema)
    kept = {r.doc_id for r in L.keep_known(docs.unionByName(planted), L.learned(docs)).collect()}
    assert {i for i in kept if i < 0} == {-6, -7, -8}
    clean = {r.doc_id for r in docs.collect() if r.text and sum(c.isalpha() for c in r.text) > 20}
    assert clean <= kept
