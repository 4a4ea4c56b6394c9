import pytest

import corpus_pipeline as C


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(folder / str(i)))
        out.append((docs, spark.read.parquet(str(folder / str(i)))))
        docs = out[-1][1]
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns
    assert stages[-1][1].columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_quality_goes_by_the_labels(spark, sf_dir, stages):
    kept = {r.doc_id for r in stages[0][1].collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good, bad = [r.doc_id for r in labels if r.quality == 1], [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_language_keeps_texts(stages):
    before, after = stages[1]
    gone = {r.text for r in before.collect()} - {r.text for r in after.collect()}
    assert not [t for t in gone if sum(c.isalpha() for c in t) > 20]


def test_no_near_copies_are_left(stages):
    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    before, after = ({r.doc_id: shingles(r.text) for r in d.collect()} for d in stages[2])
    alike = lambda a, b: len(a & b) / len(a | b)
    items = list(after.items())
    left = sum(alike(a, b) >= 0.8 for i, (_, a) in enumerate(items) for _, b in items[:i])
    assert left <= 1
    for i in set(before) - set(after):
        assert max(alike(before[i], s) for j, s in before.items() if j != i) >= 0.7


def test_mixing_takes_whole_documents(stages):
    from spanloom.llm import mixing

    before, after = stages[3]
    want = {r.doc_id: round(r.taken / r.size) for r in mixing.taken(before).collect()}
    got = {r.doc_id: 0 for r in before.collect()}
    for r in after.collect():
        got[r.doc_id] += 1
    assert got == want


def test_encoding(stages):
    before, after = stages[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert after.count() == before.count() and all(r.decoded == texts[r.doc_id].replace("▁", " ") for r in after.collect())


def test_run(spark, sf_dir, stages):
    assert C.run(spark, sf_dir).count() == stages[-1][1].count()
