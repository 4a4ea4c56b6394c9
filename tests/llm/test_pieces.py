import random

import pytest

from spanloom.llm import pieces as P


@pytest.fixture(scope="module")
def p():
    return P.Pieces(P.model_path())


TEXTS = ["", " ", "  a b  ", "\n a\tb", "▁x", "a\u0000b", "é中😀", "<s>hi</s><0x41>", "�", " \n", "a_b __x__ 2²", "don't stop; (really) \"now\"", "x" * 3000, "ab " * 5000, "▁▁ ▁", "\r\n\r\n"]


def test_against_the_library(p):
    draw = random.Random(3)
    alphabet = list("abcehnort  \n\t▁é中😀.,_²01xX\"'(){}->\u0000$%&*=/\\ ")
    made = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    for text in TEXTS + made:
        ids = p.encode(text)
        want = p.library.encode(text)
        assert ids == ",".join(map(str, want)) and p.decode(ids) == p.library.decode(want)
    p.verify()


def test_merge_alone_is_the_library(p):
    """The agenda over a whole text, without cuts."""
    for text in [t for t in TEXTS if t]:
        assert p.merge(P.MARK + text.replace(" ", P.MARK)) == p.library.encode(text)


def test_decode_of_any_ids(p):
    draw = random.Random(4)
    for _ in range(500):
        ids = [draw.randrange(3, 32000) for _ in range(draw.randint(1, 8))]
        assert p.decode(",".join(map(str, ids))) == p.library.decode(ids)


def test_tables_stay_small(p, monkeypatch):
    monkeypatch.setattr(P, "KEPT_UNITS", 10)
    own = P.Pieces(P.model_path())
    for i in range(100):
        own.encode(f"word{i} other{i}")
    own.verify()
    assert max(map(len, (own, own.old, own.fine, own.old_fine))) <= 10


def test_a_word_is_kept_in_one_table(p):
    own = P.Pieces(P.model_path())
    for text in ["word other", "word, (other) word; other!", "new. new"]:
        assert own.encode(text) == ",".join(map(str, own.library.encode(text)))
    own.verify()
    assert {"word", "other", "new"} <= own.keys()
    assert not [x for x in own.fine if x[0] == P.MARK]


def test_a_wrong_encoding_is_found(p):
    own = P.Pieces(P.model_path())
    own.merge = lambda text: [5]
    own.encode("anything")
    with pytest.raises(ValueError):
        own.verify()


def test_rows(spark, odd):
    from oddrows import ODD

    out = P.encode(spark.read.parquet(f"{odd}/documents.parquet"), P.model_path()).collect()
    texts = {r[0]: r[1] or "" for r in ODD}
    assert all(r.decoded == texts[r.doc_id].replace("▁", " ") and r.n_tokens == len(r.ids) for r in out)


def test_query_against_the_library(spark, sf_dir):
    """Both digests and the number of ids of every document, from the library's own calls over whole texts."""
    import hashlib

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.model_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = []
    for i, text in texts:
        ids = library.encode(text)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = P.op6_sentencepiece(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
