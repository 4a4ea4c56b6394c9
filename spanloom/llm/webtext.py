"""Main text of web pages by markup and by a suffix array of each host's pages.

A page becomes blocks of visible text. Markup decides a block if it stands in a menu,
header, footer, sidebar, notice, advert, form or comment section (it goes). What markup
leaves is judged by repetition on the page's host:

* Outside the page's article (its main element if it has no article), or anywhere on a page
  without one, the tokens run on as one stream. The streams of a host are concatenated and
  their suffixes sorted by their first ``RUN`` tokens; neighbours that agree on these on
  distinct pages are a repeated run, longer ones are the union of such. Runs on two pages
  and a tenth of the host's pages are cut out of the blocks, unique runs stay. On a page
  with an article they stay only if they are more than the article itself.
* Inside the article a block goes only if all of it stands on ``MOST_PAGES`` pages and
  ``MOST`` of the host's pages, as articles share passages.

Scale: no task gets a host. The pages that are worked on at once have one suffix array a
host, which gives one row for each distinct prefix; rows of equal host and prefix meet in
the shuffle, with partial aggregation before it, so a line that stands on every page of a
large host costs a row a task. Only repeated prefixes are joined back to their places, and
the places to their pages: by broadcast up to ``BROADCAST_PAGES``, else by a merge join.

Defined cases: null html counts as empty; a page without blocks has the empty text.
A null url has the host "". Streams that are equal as a whole count as one page, so
mirrored or repeated pages don't remove each other. White space is what Unicode calls so,
no-break space included; ``br`` is white space inside a block. Markup that is never closed
ends with its parent, but an unclosed script or style with the page. Content that stands in
for an object, a canvas, a video or an audio is text. An element whose class marks it as a
sidebar or the like is none if it holds an article. Columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, map_batches, read

RUN = 6
#: A block so covered keeps none of its unique runs shorter than ``RUN``.
COVERED = 0.8
#: The share of a host's pages, and the number of pages, on which a run outside an article and a block inside one are boilerplate.
SOME, SOME_PAGES = 0.1, 2
MOST, MOST_PAGES = 0.5, 8
#: So many pages with repeated runs, some 100 bytes each, and so many hosts are broadcast.
BROADCAST_PAGES = 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never text of the page.
RAW = "script|style|textarea|title"
DROPPED = frozenset("head nav footer aside form button dialog menu search datalist noscript template svg math iframe select textarea title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar status".split())
#: Parts of class names and ids that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget footer header masthead comment comments respond reply replies disqus share sharing social newsletter subscribe subscription signup login "
    "search related recommended recommendations pagination pager toolbar".split()
)
#: Elements that hold the article whatever their class says; an article can still be a comment or an advert.
HOLDERS = frozenset(("html", "body", "main"))
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())

_TAG_REST = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*"
_TOKEN = re.compile(rf"(?is)<!--.*?(?:-->|$)|<({RAW})\b{_TAG_REST}(?:/>|>.*?</\1\s*>)|<(?:script|style)\b{_TAG_REST}>.*|<(/?)([a-z][^\s/>]*)({_TAG_REST})>|<[!?][^>]*>|([^<]+|<)")
_ATTRIBUTE = re.compile(r"(?s)([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


#: How an element is dropped: not, unless it holds an article, or whatever it holds.
KEPT, UNLESS_ARTICLE, GONE = range(3)


def _dropped(tag: str, attributes: str, in_article: bool) -> int:
    if tag in DROPPED or tag == "header" and not in_article:
        return GONE
    out = KEPT
    if not attributes.strip() or tag in HOLDERS:
        return out
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name in ("class", "id"):
            marks = (ARTICLE_MARKS if tag == "article" else MARKS).intersection(re.split(r"[^a-z0-9]+", value))
            if "hidden" in value.split() or marks & ARTICLE_MARKS:
                return GONE
            if marks - {"header"} or marks and not in_article:
                out = UNLESS_ARTICLE
        if name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return GONE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return GONE
    return out


#: How surely an element holds the article; the surest of a page decide.
LEVELS = {"main": 1, "article": 2}


def blocks(page: str | None) -> list[tuple[str, int, bool]]:
    """The page's blocks in order: text, the level of what it stands in, dropped by its markup."""
    out: list[tuple[str, int, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []  # tag, level, how it is dropped
    level, gone = 0, KEPT

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, level, gone > KEPT))

    for m in _TOKEN.finditer(page or ""):
        text = m.group(5)
        if text is not None:
            held.append(text)
            continue
        tag = m.group(3)
        if tag is None:  # a comment, a declaration, or an element without text
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
        if m.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:  # an inline end tag doesn't end a block
                    i = -1
                    break
            else:
                i = -1
            if i >= 0:
                before = stack[i - 1][1:] if i else (0, KEPT)
                if before != (level, gone):
                    flush()
                del stack[i:]
        elif tag not in VOID and not m.group(4).endswith("/"):
            if tag in BLOCK and stack and stack[-1][0] == "p":
                stack.pop()  # a paragraph ends where a block begins
            elif tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            _, was, was_gone = stack[-1] if stack else ("", 0, KEPT)
            drop = _dropped(tag, m.group(4), was > 0)
            if not (was_gone == UNLESS_ARTICLE and tag in LEVELS):
                drop = max(drop, was_gone)
            if drop != was_gone:
                flush()
            stack.append((tag, max(was, 0 if drop else LEVELS.get(tag, 0)), drop))
        else:
            continue
        _, level, gone = stack[-1] if stack else ("", 0, KEPT)
    flush()
    return out


def top_level(found: list[tuple[str, int, bool]]) -> int:
    return max((level for _, level, gone in found if not gone), default=0)


def outside(found: list[tuple[str, int, bool]]) -> list[list[str]]:
    """The tokens, by block, that markup leaves and that don't stand in the article."""
    top = top_level(found)
    return [[] if gone or top and level == top else text.split() for text, level, gone in found]


def _hash(tokens: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.get(t) or known.setdefault(t, xxhash.xxh64_intdigest(t)) for t in tokens), np.uint64, len(tokens))


def _mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of the hashes that stand at each place, in order."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def suffix_array(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of the concatenated streams, sorted by their first ``RUN`` tokens: stream, start, prefix (a hash), and whether LCP with the one before is less.

    Only suffixes of ``RUN`` tokens take part; a shorter stream takes part as a whole. Ranks of
    one token are doubled to 2 and 4 and combined to 6.
    """
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    ends = np.cumsum(sizes + RUN)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    owner = np.repeat(np.arange(len(streams)), sizes + RUN)
    start = np.arange(len(flat)) - (ends - sizes - RUN)[owner]
    for s, end, size in zip(streams, ends, sizes):
        flat[end - size - RUN : end - RUN] = s  # behind each stream are RUN blanks
    rank = np.unique(flat, return_inverse=True)[1]
    shifted = lambda r, n: np.concatenate((r[n:], np.zeros(n, r.dtype)))[: len(r)]
    pairs = lambda a, b: np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]
    two = pairs(rank, shifted(rank, 1))
    six = pairs(pairs(two, shifted(two, 2)), shifted(two, 4))
    whole = np.flatnonzero((start <= np.maximum(sizes - RUN, 0)[owner]) & (sizes > 0)[owner])
    order = whole[np.argsort(six[whole], kind="stable")]
    prefix = _mixed([shifted(flat, j) for j in range(RUN)])[order].view(np.int64) if len(flat) else np.empty(0, np.int64)
    first = np.ones(len(order), bool)
    first[1:] = six[order][1:] != six[order][:-1]
    return owner[order], start[order], prefix, first


def keep(found: list[tuple[str, int, bool]], places: list[tuple[int, int]], pages: int = 0) -> str:
    """The page's text, given the places that other pages of the host share (see ``streams``), on how many pages, and the host's pages."""
    many = dict(places)
    parts, top = outside(found), top_level(found)
    covered = np.zeros(sum(map(len, parts)) + RUN, bool)
    for place, n in places:
        if place >= 0 and n >= max(SOME_PAGES, SOME * pages):
            covered[place : place + RUN] = True
    out, at, inside, beside = [], 0, 0, 0
    for i, ((text, level, gone), tokens) in enumerate(zip(found, parts)):
        if tokens:
            runs = _unique(tokens, covered[at : at + len(tokens)])
            at += len(tokens)
            beside += sum(map(len, runs))
            out.append((not top, " ".join(t for r in runs for t in r)))
        elif not gone and many.get(-1 - i, 0) < max(MOST_PAGES, MOST * pages):
            inside += len(text.split())
            out.append((True, text))
    return "\n".join(text for sure, text in out if text and (sure or beside > inside))


def _unique(tokens: list[str], covered: np.ndarray) -> list[list[str]]:
    """The block's runs of tokens that aren't covered."""
    edges = np.flatnonzero(np.diff(covered, prepend=True, append=True))
    runs = [tokens[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return runs if covered.sum() < COVERED * len(tokens) else [r for r in runs if len(r) >= RUN]


def _key() -> Column:
    """A hash that equal rows share."""
    return F.xxhash64("page_id", "url", "html").alias("key")


#: The prefix that stands for a host as such, which all its pages have.
HOST = 0


def streams(pages: DataFrame) -> DataFrame:
    """Rows of two kinds: a page's key, host, places and prefixes; a host's prefix with the number of pages that have it and two streams of theirs, lo and hi.

    A place is where a suffix starts in the page's stream, or -1 - i for block i of the article as a whole.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        found = [blocks(x) for x in batch.column(2).to_pylist()]
        hosts = list(map(host_of, batch.column(1).to_pylist()))
        tokens = [_hash([t for part in outside(f) for t in part]) for f in found]
        tops = [top_level(f) for f in found]
        inner = [[(-1 - i, text) for i, (text, level, gone) in enumerate(f) if top and level == top and not gone] for f, top in zip(found, tops)]
        places = [[i for i, _ in x] for x in inner]
        prefixes = [[xxhash.xxh64_intdigest(text, 1) - (1 << 63) for _, text in x] for x in inner]
        whole = [xxhash.xxh64_intdigest(t.tobytes() + b"|".join(str(p).encode() for p in ps)) - (1 << 63) for t, ps in zip(tokens, prefixes)]
        counted: list[tuple[str, int, int, int, int]] = []
        for host in dict.fromkeys(hosts):
            mine = [i for i, h in enumerate(hosts) if h == host]
            seen: dict[int, set[int]] = {HOST: set(mine)}
            for i in mine:
                for p in prefixes[i]:
                    seen.setdefault(p, set()).add(i)
            owner, start, prefix, first = suffix_array([tokens[i] for i in mine])
            edges = [*np.flatnonzero(first).tolist(), len(first)]
            for a, b in zip(edges, edges[1:]):
                seen[int(prefix[a])] = {mine[o] for o in owner[a:b].tolist()}
            for o, at, p in zip(owner.tolist(), start.tolist(), prefix.tolist()):
                places[mine[o]].append(at)
                prefixes[mine[o]].append(p)
            counted += [(host, p, len(of), min(whole[i] for i in of), max(whole[i] for i in of)) for p, of in seen.items()]
        n, m = len(found), len(counted)
        both = lambda mine, theirs, kind: pa.array([*mine, *theirs], kind)
        column = lambda i, kind: both([None] * n, [c[i] for c in counted], kind)
        return {
            "key": both(batch.column(0).to_pylist(), [None] * m, pa.int64()), "host": both(hosts, [c[0] for c in counted], pa.string()),
            "places": both(places, [None] * m, pa.list_(pa.int32())), "prefixes": both(prefixes, [None] * m, pa.list_(pa.int64())),
            "prefix": column(1, pa.int64()), "n": column(2, pa.int64()), "lo": column(3, pa.int64()), "hi": column(4, pa.int64()),
        }

    return map_batches(pages.select(_key(), "url", "html"), rows, "key long, host string, places array<int>, prefixes array<long>, prefix long, n long, lo long, hi long")


def repeated(found: DataFrame) -> DataFrame:
    """key, pages (of its host), places (with n, the pages that share it): what distinct streams of the page's host share, on enough pages to go. From ``streams``."""
    counted = found.where("key is null").groupBy("host", "prefix").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    counted = checkpoint(counted.where("lo <> hi").select("host", "prefix", "n"))
    hosts = counted.where(F.col("prefix") == HOST).select("host", F.col("n").alias("pages"))
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_PAGES else hosts
    enough = lambda least, share: F.col("n") >= F.greatest(F.lit(least), F.col("pages") * share)
    shared = counted.where(F.col("prefix") != HOST).join(hosts, "host").where(enough(SOME_PAGES, SOME))
    at = found.where("key is not null").select("key", "host", F.explode(F.arrays_zip("places", "prefixes")).alias("x")).select("key", "host", "x.*").withColumnRenamed("prefixes", "prefix")
    deciding = at.join(shared, ["host", "prefix"]).where((F.col("places") >= 0) | enough(MOST_PAGES, MOST))
    return deciding.groupBy("key").agg(F.max("pages").alias("pages"), F.collect_set(F.struct(F.col("places").alias("place"), "n")).alias("places"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (prefixes of its stream that enough pages of the host have)."""

    def finish(batch: pa.RecordBatch) -> dict:
        places = [[(p["place"], p["n"]) for p in x or []] for x in batch.column(3).to_pylist()]
        text = [keep(blocks(x), s, n or 0) for x, s, n in zip(batch.column(2).to_pylist(), places, batch.column(4).to_pylist())]
        runs = [sum(place >= 0 for place, _ in s) for s in places]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64()), "n_repeated": pa.array(runs, pa.int64())}

    # Pages are parsed twice, which costs less than keeping their text until the repeats are known.
    found = checkpoint(repeated(checkpoint(streams(pages))))
    found = F.broadcast(found) if found.count() <= BROADCAST_PAGES else found
    rows = pages.select(_key(), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    joined = rows.join(found, "key", "left").select("page_id", "url", "html", "places", "pages")
    return map_batches(joined, finish, "page_id long, url string, text string, n_chars long, n_repeated long")


def op4_webtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op4_webtext": op4_webtext}
ORACLES: dict[str, str] = {}
