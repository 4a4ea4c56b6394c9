import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import revisits as R

SCHEMA = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.org:80/a/?utm_source=x&b=2&a=1&ref=y#top", "example.org/a?a=1&b=2"),
        ("https://example.org", "example.org/"),
        ("https://example.org/?utm_medium=m", "example.org/"),
        ("example.org/A//", "example.org/A"),
        (None, None),
        ("", "/"),
    ],
)
def test_canonical(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(R.canonical(F.col("url")).alias("c")).first().c == want


def test_against_a_loop(spark):
    draw = random.Random(7)
    rows = []
    for i in range(300):
        kind = draw.choice(["response", "revisit", "revisit"])
        head = {"etag": f'"{draw.randint(0, 2)}"', "content-length": "0"} if draw.random() < 0.7 else {"last-modified": str(draw.randint(0, 1))} if draw.random() < 0.5 else {}
        rows.append((i, draw.choice(["https://a/1", "http://www.a/1#x", "https://b", None]), draw.choice([None, *range(0, 60, 3)]), kind, 200 if draw.random() < 0.8 else 404, head, str(draw.randint(0, 1))))
    same = {"https://a/1": "a/1", "http://www.a/1#x": "a/1", "https://b": "b/", None: None}
    when = lambda r: -1 if r[2] is None else r[2]
    for span in (5, 1000):
        got = {r.record_id: r for r in R.resolve(spark.createDataFrame(rows, SCHEMA), span).collect()}
        for r in rows:
            full = [x for x in rows if x[3] == "response" and x[4] == 200 and same[x[1]] == same[r[1]] and same[r[1]] and when(x) < when(r)]
            best = max(full, key=lambda x: (when(x), x[0]), default=None)
            g = got[r[0]]
            if r[3] == "response":
                assert g.outcome == "response"
            elif not same[r[1]]:
                assert g.outcome == "no url"
            elif best is None:
                assert g.outcome == "orphan"
            else:
                key = "etag" if "etag" in r[5] else "last-modified" if "last-modified" in r[5] else None
                fits = r[5][key] == best[5].get(key) if key else r[6] == best[6]
                assert (g.outcome, g.partner_id) == (("resolved", best[0]) if fits else ("mismatch", None))


def test_headers_that_stay(spark):
    rows = [
        (1, "https://a", 1, "response", 200, {"etag": '"x"', "content-length": "9", "date": "old"}, "d"),
        (2, "https://a", 2, "revisit", 304, {"etag": 'W/"x"', "content-length": "0", "connection": "close", "date": "new", "age": "1"}, None),
        (3, "https://a", 3, "revisit", 304, {}, None),
    ]
    got = {r.record_id: r for r in R.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2].headers == {"etag": 'W/"x"', "content-length": "9", "date": "new", "age": "1"} and got[2].digest == "d"
    assert got[3].outcome == "unchecked" and got[3].digest == "d"


def test_names_in_any_case_and_times_before_zero(spark):
    rows = [
        (1, "https://a", None, "response", 200, {"ETag": '"x"', "Content-Length": "9"}, "d"),
        (2, "https://a", -9 * R.SPAN, "revisit", 304, {"Etag": '"x"', "CONTENT-LENGTH": "0", "etag": '"y"'}, None),
        (3, "https://b", -5, "response", 200, {"etag": '"x"'}, "e"),
        (4, "https://b", None, "revisit", 304, {"ETAG": '"x"'}, None),
        (5, "https://b", 5, "revisit", 304, {"ETAG": '"z"'}, None),
    ]
    got = {r.record_id: r for r in R.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2].outcome, got[2].headers) == ("resolved", {"etag": '"x"', "content-length": "9"})
    assert (got[4].outcome, got[5].outcome) == ("orphan", "mismatch")


def test_records_have_all_outcomes(spark, sf_dir):
    found = {r.outcome: r["count"] for r in R.op9_revisits(spark, sf_dir).groupBy("outcome").count().collect()}
    assert all(found.get(x, 0) >= 5 for x in ("response", "resolved", "unchecked", "mismatch", "orphan"))


def test_odd_pages(spark, table):
    rows = [(1, None, None), (None, "https://a/", "x"), (2, "https://a/", ""), (3, "https://a", "x" * 300_000), (3, "https://a", "x" * 300_000)]
    got = R.op9_revisits(spark, table("pages", rows, "page_id long, url string, html string")).collect()
    assert len(got) == 20 and all(r.outcome for r in got)
