import random
import re

import pytest
from oddrows import DOCUMENTS

from spanloom.llm import licenses as L

RULES = [(i, label, word, other, re.compile(x)) for i, label, word, other, x in L.rules()]


def brute(text):
    """All rules on all texts, without the prefilter on the document."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined = " " + " ".join(words) + " "
    base = [(i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for i, label, word, other, x in RULES:
        if word in joined and other in joined:
            for m in x.finditer(joined):
                start = joined[: m.start()].count(" ") - 1
                found.append((start, -(start + m.group().count(" ")), i, label))
    kept = []
    for d in sorted(found, key=lambda d: (d[2], d[0])):
        over = [x for x in kept if x[0] <= -d[1] and d[0] <= -x[1]]
        if all(x[0] >= d[0] and x[1] >= d[1] for x in over):
            kept = [x for x in kept if x not in over] + [d]
    labels = lambda xs: ",".join(sorted(set(xs)))
    starts = [i for i, _ in base]
    covered = sum(-d[1] - d[0] + 1 for d in kept)
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), labels(x for _, x in base), labels([*(x for _, x in base), *(d[3] for d in kept)]), covered / len(words) if words else 0.0)


def check(spark, folder, rows):
    texts = {r[0]: r[1] for r in rows}
    for r in L.op10_licenses(spark, folder).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6], texts[r.doc_id]
        assert r.score == pytest.approx(want[6]) and 0 <= r.score <= 1


def test_hundreds_of_rules_with_their_gates():
    assert len(RULES) > 300
    names = {n for _, _, n in L.NAMES}
    assert len(names) + len(L.NOTICES) > 180


def some_match(draw, items):
    """A string that a parsed expression matches."""
    out = ""
    for op, value in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "IN":
            kind, what = value[0]
            out += "w" if str(kind) == "NEGATE" else chr(what if str(kind) == "LITERAL" else draw.randint(*what))
        elif op == "NOT_LITERAL":
            out += "w"
        elif op == "BRANCH":
            out += some_match(draw, draw.choice(value[1]))
        elif op == "SUBPATTERN":
            out += some_match(draw, value[3])
        elif op == "MAX_REPEAT":
            out += "".join(some_match(draw, value[2]) for _ in range(draw.randint(value[0], min(value[1], value[0] + 1))))
        elif op != "ASSERT":
            raise AssertionError(op)
    return out


def test_every_match_passes_its_keywords_and_a_gate():
    from re import _parser

    draw = random.Random(4)
    for _, _, word, other, x in RULES:
        for _ in range(12):
            joined = f" {some_match(draw, _parser.parse(x.pattern))} "
            assert x.search(joined) and word in joined and other in joined and any(g in joined for g in L.GATES), (joined, word, other)


def test_made_up_texts(spark, table):
    draw = random.Random(2)
    words = ["MIT", "License", "under", "the", "Apache", "version", "2", "2.0", "CC", "BY", "NC", "SA", "4.0", "GNU", "General", "Public", "licensed", "released", "in", "public domain", "All rights reserved", "GPL", "v3", "SPDX-License-Identifier:", "BSD", "3-Clause", "é", "…"]
    phrases = [" ".join(x.replace("(?:", "").format("MIT").split("|")[0].split(")")[0:1]) for _, x in L.PHRASES]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30))), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, p, "en", "s", 0) for i, p in enumerate([*phrases, "Released under the MIT License.", "Licensed under the Apache License,\nVersion 2.0", "Licensed under CC BY-NC-SA 4.0", "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "under the MIT license under the mit license"])]
    from re import _parser

    made = [" and ".join(some_match(draw, _parser.parse(draw.choice(RULES)[4].pattern)) for _ in range(3)) for _ in range(150)]
    rows += [(2000 + i, t, "en", "s", 0) for i, t in enumerate(made)]
    check(spark, table("documents", rows, DOCUMENTS), rows)


def test_odd_rows(spark, odd):
    from oddrows import ODD

    check(spark, odd, ODD)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, sf_dir, rows)


def test_longer_name_wins(spark, table):
    rows = [(1, "Licensed under CC BY-NC-SA 4.0.", "en", "s", 0), (2, "GNU Lesser General Public License, version 3", "en", "s", 0), (3, "under the GNU General Public License, version 3", "en", "s", 0)]
    got = {r.doc_id: r.labels for r in L.op10_licenses(spark, table("documents", rows, DOCUMENTS)).collect()}
    assert got[1] == "cc-by-nc,cc-by-nc-sa" and got[3] == "gpl-3"
