import pytest
from oddrows import DOCUMENTS

from spanloom.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame([(i, "w " * n, "en", s, 0) for i, s, n in rows], DOCUMENTS)


def test_targets_stop_and_reshare(spark):
    rows = [(i, "a", 10) for i in range(1000)] + [(2000, "b", 100), (2001, "c", 1000)]
    out = mixing.taken(docs(spark, rows)).collect()
    by = {r.source_size: r for r in out}
    assert by[100].target == 300 and by[1000].target == 3000 and by[10_000].target == pytest.approx(11_100 - 3300)
    for size in by:
        assert sum(r.taken for r in out if r.source_size == size) == by[size].target


def test_no_document_is_taken_too_often(spark):
    rows = [(i, f"s{i % 7}", 1 + i * i % 300) for i in range(400)]
    out = mixing.taken(docs(spark, rows)).collect()
    assert len(out) == 400 and all(0 <= r.taken <= 3 * r.size for r in out)
    for size in {r.source_size for r in out}:
        group = [r for r in out if r.source_size == size]
        assert abs(sum(r.taken for r in group) - group[0].target) <= 1


def test_reruns_agree(spark):
    rows = [(i, f"s{i % 3}", i % 50) for i in range(200)]
    a, b = (sorted(map(tuple, mixing.taken(docs(spark, rows).repartition(n)).collect())) for n in (1, 5))
    assert a == b


def test_schedule_is_even_all_along(spark):
    """In every stretch of the schedule each source has about its share of the slots."""
    sizes = mixing.sized(docs(spark, [(i, "a", 500) for i in range(300)] + [(1000 + i, "b", 500) for i in range(300)]))
    slots = [r.k for r in mixing.schedule(mixing.targets(sizes)).where("slot is not null").orderBy("slot").collect()]
    for at in range(0, len(slots) - 300, 150):
        assert slots[at : at + 300].count("=a") == pytest.approx(100, abs=8)


def test_null_source_is_last(spark):
    out = mixing.taken(docs(spark, [(1, None, 100), (2, "a", 100), (3, "b", 100)])).collect()
    assert {r.doc_id: round(r.target, 6) for r in out} == {1: 150.0, 2: 50.0, 3: 100.0}


def test_mixed_rows_repeat_whole_documents(spark):
    d = docs(spark, [(1, "a", 100), (1, "a", 100), (2, "b", 900), (None, "b", 50), (3, "c", 0)])
    got = mixing.mixed_rows(d)
    assert got.columns == d.columns
    want = sorted((str(r.doc_id), round(r.taken / r.size)) for r in mixing.taken(d).collect() if r.size)
    counts = {}
    for r in got.collect():
        counts[str(r.doc_id)] = counts.get(str(r.doc_id), 0) + 1
    assert counts == {i: sum(n for j, n in want if j == i) for i in {j for j, n in want if n}}


def test_places_against_the_schedule_step_by_step(spark):
    """first_slot, slots and taken as a plain walk over the slots gives them; they hang on the points."""
    import hashlib

    rows = [(i, "abc"[i % 3], 1 + i * 37 % 200) for i in range(120)]
    got = {r.doc_id: (r.taken, r.first_slot, r.slots) for r in mixing.taken(docs(spark, rows)).collect()}
    streams = {s: [i for i, x, n in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()) if x == s for _ in range(n)] for s in "abc"}
    words = {r.source_size: r.target for r in mixing.taken(docs(spark, rows)).collect()}

    def walk(point):
        share = {}
        for s, x in streams.items():
            target, blocks = min(3 * len(x), round(words[len(x)])), -(-len(x) // 64)
            share[s] = [blocks, target % len(x), target // len(x) * blocks + -(-(target % len(x)) // 64)]
        total, at, rank, out = sum(v[2] for v in share.values()), 0, dict.fromkeys(share, 0), {}
        bands = []
        for s, v in share.items():
            bands.append((at / total, (at + v[2]) / total, s))
            at += v[2]

        def give(s, slot):
            blocks, rest, n = share[s]
            if rank[s] == n:
                return
            at = rank[s] % blocks * 64
            far = rest if rank[s] == n - 1 and rest else at + 64
            piece = streams[s][at:far]
            for i in set(piece):
                t, first, k = out.get(i, (0, -1, 0))
                out[i] = (t + piece.count(i), slot if first < 0 else first, k + 1)
            rank[s] += 1

        for slot in range(total):
            give(next(s for lo, hi, s in bands if lo <= point(slot, total) < hi), slot)
        for s in share:
            while rank[s] < share[s][2]:
                give(s, -1)
        return {i: out.get(i, (0, -1, 0)) for i, _, _ in rows}

    assert got == walk(lambda i, n: int(f"{i:052b}"[::-1], 2) / (1 << 52))
    assert got != walk(lambda i, n: i / n)


def test_mixed_rows_stand_in_slot_order(spark):
    """Equal sources of weights 1, 2 and 3 alternate all along the files, and every stretch has the shares."""
    d = docs(spark, [(i, "abc"[i % 3], 64) for i in range(600)])
    mixed = [r.source for r in mixing.mixed_rows(d).collect()]
    assert len(mixed) == 600
    for at in range(0, 540, 60):
        assert [mixed[at : at + 60].count(s) for s in "abc"] == pytest.approx([10, 20, 30], abs=3)
