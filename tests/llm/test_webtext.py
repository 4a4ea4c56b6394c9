import pytest

from spanloom.llm import webtext as X

PAGES = "page_id long, url string, html string"


def text(html, places=()):
    return X.keep(X.blocks(html), list(places))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>One &amp; two<br>three  \n four<p>Five", "One & two three four\nFive"),
        ("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b> c</p><ul><li>x<li>y</ul></article><footer>f</footer>", "T\na b c\nx\ny"),
        ("<article><p>keep</p><div class='ad'>buy</div><aside>s</aside><form>f</form><p>also</p></article>", "keep\nalso"),
        ("<article>a</article><section id='comments'><article>c</article></section>", "a"),
        ("<body class='has-sidebar'><main><p>in</p></main><p>out</p></body>", "in"),
        ("<p>a</p><script>if (a < b) document.write('<p>x</p>')</script><style>p{}</style><p>b", "a\nb"),
        ("<!-- <p>no</p> --><p>yes &lt;b&gt; &#233;&nbsp;&eacute; &unknown; &am", "yes <b> é é &unknown; &am"),
        ("<div class='cookie-notice'>c</div><div class='header'>h</div><p hidden>x</p><p style='display: none'>y</p><p>z", "z"),
        ("<p>a < b and c", "a < b and c"),
        ("<div role=navigation>n</div><table><tr><td>1<td>2</table>", "1\n2"),
        ("<title>t</title><p>😀", "😀"),
        ("<p", "<p"),
        ("<article><header><h1>Head</h1></header><p>Body</p></article>", "Head\nBody"),
        ("<main><p>links</p><article><p>a</p></article></main>", "a"),
        ("<article class='post overflow-hidden'><div class='post-header'>h</div><p>a</p></article><article class='comment'>c</article>", "h\na"),
        ("<p>a <span class='ad'>x</span> b</p>", "a\nb"),
        ("<article><p>a</p><svg/><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><iframe src=x /><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><p><select><option>x</p><p>b</p></article>", "a\nb"),
        ("<article><svg><text>x</text><path/></svg><object><p>in place of it</p></object><canvas>c</canvas></article>", "in place of it\nc"),
        ("<article>a<textarea>x <p>y</textarea>b<noscript>n</noscript></article>", "ab"),
        ("<title>t<body><p>x", ""),
        ("<p>a<script>while (1) '<p>b'", "a"),
        ("<div class='has-sidebar'><p>x</p><article><p>a</p></article></div>", "a"),
        ("<div class='content-sidebar-wrap'><div class='related'><article>r</article></div><main>a</main></div>", "a"),
    ],
)
def test_blocks(html, want):
    assert text(html) == want


def test_very_long_page():
    assert len(text("<p>" + "word " * 300_000)) == 5 * 300_000 - 1


def page(i, body, host="h.example"):
    return (i, f"https://{host}/{i}", body)


def run(spark, table, rows):
    return {r.page_id: r for r in X.op4_webtext(spark, table("pages", rows, PAGES)).collect()}


def test_repeated_runs_go_where_markup_says_nothing(spark, table):
    chrome = "<div>Subscribe now to read all of our stories today</div>"
    rows = [page(i, f"{chrome}<div>{' '.join(f'w{i}x{j}' for j in range(20))}</div>{chrome}") for i in range(6)]
    rows.append(page(10, f"{chrome}<div>own words of another host here</div>", "other.example"))
    got = run(spark, table, rows)
    assert all("Subscribe" not in got[i].text and got[i].text.count("w") == 20 and got[i].n_repeated > 0 for i in range(6))
    assert "Subscribe" in got[10].text  # on its host it stands once


def own(i, n=20):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_covered_runs_are_cut_and_unique_ones_stay(spark, table):
    """Runs inside one block: the repeated part goes, what is before and behind it stays."""
    rows = [page(i, f"<div>{own(i)} please read our terms of use first {own(100 + i)}</div>") for i in range(5)]
    got = run(spark, table, rows)
    assert all(got[i].text == f"{own(i)} {own(100 + i)}" for i in range(5))


def test_the_array_decides(spark, table, monkeypatch):
    """Without repeats, pages with and without an article have other texts."""
    notice = "<p>Tell your friends about this site now please</p>"
    rows = [page(i, f"<article>{notice}<p>{own(i)}</p></article>") for i in range(10)]
    rows += [page(20 + i, f"<div>All the news of this town</div><div>{own(20 + i)}</div>", "other.example") for i in range(3)]
    got = {i: r.text for i, r in run(spark, table, rows).items()}
    assert got == {i: own(i) for i in [*range(10), 20, 21, 22]}
    monkeypatch.setattr(X, "repeated", lambda found: found.where("false").selectExpr("key", "n as pages", "cast(null as array<struct<place:int,n:bigint>>) as places"))
    without = {i: r.text for i, r in run(spark, table, rows).items()}
    assert all(without[i] != got[i] for i in got)


def test_text_beside_a_small_article(spark, table):
    rows = [page(i, f"<div>All the news of this town</div><article><p>one card</p></article><div>{own(i)}</div>") for i in range(3)]
    assert {i: r.text for i, r in run(spark, table, rows).items()} == {i: f"one card\n{own(i)}" for i in range(3)}


def test_suffix_array_against_sorted_suffixes():
    import numpy as np

    rng = np.random.default_rng(3)
    streams = [rng.integers(1, 3, n).astype(np.uint64) for n in (0, 1, 5, 6, 7, 30, 30, 6)]
    owner, start, prefix, first = X.suffix_array(streams)
    want = sorted((tuple(s[i : i + X.RUN].tolist()), k, i) for k, s in enumerate(streams) if len(s) for i in range(max(1, len(s) - X.RUN + 1)))
    groups, hashes = {}, {}
    for k, i, p in zip(owner.tolist(), start.tolist(), prefix.tolist()):
        run_ = tuple(streams[k][i : i + X.RUN].tolist())
        groups.setdefault(run_, []).append((k, i))
        hashes.setdefault(run_, set()).add(p)
    assert sorted((r, k, i) for r, of in groups.items() for k, i in of) == want
    assert all(len(h) == 1 for h in hashes.values()) and first.sum() == len(groups)


def test_repeats_inside_an_article_stay(spark, table):
    rows = [page(i, f"<article><p>the same long passage stands in every one of these articles</p><p>{i}</p></article>") for i in range(4)]
    assert all(r.text.startswith("the same long") for r in run(spark, table, rows).values())


def test_mirrored_pages_do_not_remove_each_other(spark, table):
    body = "<div>one two three four five six seven eight nine</div>"
    got = run(spark, table, [page(1, body), page(2, body), page(2, body)])
    assert {r.text for r in got.values()} == {"one two three four five six seven eight nine"}


def test_odd_pages(spark, table):
    rows = [(1, None, None), (2, "https://x/", ""), (None, "u", "<p>a"), (3, "https://x/", "<p>b"), (3, "https://x/", "<p>b")]
    got = X.op4_webtext(spark, table("pages", rows, PAGES)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("2", "", 0), ("3", "b", 1), ("3", "b", 1), ("None", "a", 1)]


def test_coverage_against_brute_force(spark, table):
    """Starts of runs that distinct streams of a host share, by comparing all pairs of places."""
    import random

    draw = random.Random(1)
    bodies = [" ".join(draw.choice("abc") for _ in range(draw.randint(1, 40))) for _ in range(25)]
    rows = [page(i, f"<div>{b}</div>", f"h{i % 3}") for i, b in enumerate(bodies)]
    got = {r.page_id: r.n_repeated for r in X.op4_webtext(spark, table("pages", rows, PAGES)).collect()}
    runs = lambda b: [tuple(b.split()[j : j + X.RUN]) for j in range(max(1, len(b.split()) - X.RUN + 1))]
    for i, b in enumerate(bodies):
        others = {g for k, o in enumerate(bodies) if k % 3 == i % 3 and o != b for g in runs(o)}
        assert got[i] == sum(g in others for g in runs(b))


@pytest.mark.parametrize(("url", "host"), [(None, ""), ("nothing", ""), ("HTTP://User@WWW.Example.org:80/x", "www.example.org")])
def test_host(url, host):
    assert X.host_of(url) == host


def test_articles_of_the_pages(spark, sf_dir):
    import html
    import re

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in X.op4_webtext(spark, sf_dir).collect():
        inner = re.search(r"(?s)<article>(.*)</article>", rows[r.page_id]).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)
