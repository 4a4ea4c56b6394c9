"""Scan of texts by a bank of regular expressions, in one pass over Arrow batches.

A pattern is tried on a text only if the text holds one of the strings that each of its
matches must hold; those strings are read off the parsed expression. One automaton looks
for the strings of all patterns at once, so most patterns are decided by one pass. Where
the expression also says how far into a match a string stands, only the places before the
strings found are tried, not the whole text.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as _ops
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame

try:
    import ahocorasick
except ImportError:  # then each string is looked for by itself
    ahocorasick = None

from spanloom.catalog import Pattern, Rule

#: Letters outside ASCII that some ASCII letter equals when case is ignored.
_FOLDED = re.compile("[İıſK]")


def needed(regex: str) -> frozenset[str] | None:
    """Lower-case strings, one of which is in every match, or None if none are sure."""
    options = _options(list(_parser.parse(regex, re.IGNORECASE)))
    return frozenset(options) if options else None


def _options(items: list) -> set[str] | None:
    """The best set of alternatives that the items of a sequence give."""
    best: set[str] | None = None
    run = ""

    def offer(found: set[str] | None) -> None:
        nonlocal best
        if found and min(map(len, found)) >= 1:
            quality = lambda s: (min(map(len, s)), -len(s))
            if best is None or quality(found) > quality(best):
                best = found

    for op, value in items:
        if op is _ops.LITERAL and chr(value).isascii():
            run += chr(value).lower()
            continue
        if run:
            offer({run})
            run = ""
        if op is _ops.SUBPATTERN:
            offer(_options(list(value[3])))
        elif op is _ops.BRANCH:
            parts = [_options(list(x)) for x in value[1]]
            offer(set().union(*parts) if all(parts) else None)
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and value[0] >= 1:
            offer(_options(list(value[2])))
    if run:
        offer({run})
    return best


#: How far the places may lie apart at which a string can stand in a match.
REACH = 12


def anchors(regex: str) -> frozenset[tuple[str, int, int]] | None:
    """Lower-case strings, one of which is in every match, each with its first and last possible place in it; None if none are sure.

    A 0 stands for any digit.
    """
    options = _anchored(list(_parser.parse(regex, re.IGNORECASE)), 0, 0)
    return frozenset(options) if options else None


def _is_digit(op, value) -> bool:
    return op is _ops.LITERAL and chr(value) in "0123456789" or op is _ops.IN and list(value) in ([(_ops.CATEGORY, _ops.CATEGORY_DIGIT)], [(_ops.RANGE, (48, 57))])


def _anchored(items: list, lo: int, hi: int, run: str = "") -> set[tuple[str, int, int]] | None:
    """The best set of alternatives that the items of a sequence give, behind the string ``run`` that begins from lo to hi."""
    best: set[tuple[str, int, int]] | None = None
    at = (lo, hi)
    lo, hi = lo + len(run), hi + len(run)

    def offer(found: set[tuple[str, int, int]] | None) -> None:
        nonlocal best
        if found and max(b - a for _, a, b in found) <= REACH:
            length = lambda s: min(len(x) for x, _, _ in s)
            quality = lambda s: (min(length(s), 3), -max(b - a for _, a, b in s), length(s), -len(s))
            if best is None or quality(found) > quality(best):
                best = found

    for item in items:
        op, value = item
        digits = 1 if _is_digit(op, value) else value[0] if op is _ops.MAX_REPEAT and len(value[2]) == 1 and _is_digit(*value[2][0]) else 0
        least, most = _parser.SubPattern(_parser.State(), [item]).getwidth()
        if digits or op is _ops.LITERAL and chr(value).isascii():
            at = at if run else (lo, hi)
            run += "0" * digits or chr(value).lower()
        if run and not (least == most and (digits or op is _ops.LITERAL and chr(value).isascii())):
            offer({(run, *at)})
            behind, begins = ("", (lo, hi)) if digits else (run, at)
            run = ""
        else:
            behind, begins = "", (lo, hi)
        if op is _ops.SUBPATTERN:
            offer(_anchored(list(value[3]), *begins, behind))
        elif op is _ops.BRANCH:
            parts = [_anchored(list(x), *begins, behind) for x in value[1]]
            offer(set().union(*parts) if all(parts) else None)
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and value[0] >= 1 and not digits:
            offer(_anchored(list(value[2]), *begins, behind))
        lo, hi = lo + least, hi + most
    if run:
        offer({(run, *at)})
    return best


_ZEROS = str.maketrans("123456789", "0" * 9)
_PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(b"123456789", b"0" * 9))
_DIGIT = re.compile(r"\d")


def plain(text: str) -> str:
    """The text in lower case with a 0 for each digit, each character in its place."""
    return text.encode().translate(_PLAIN).decode() if text.isascii() else _DIGIT.sub("0", text.lower())


@dataclass(frozen=True)
class Bank:
    """Compiled patterns and rules, numbered with the patterns first; made once a worker."""

    patterns: tuple[Pattern, ...]
    rules: tuple[Rule, ...]
    regexes: tuple[re.Pattern, ...]
    #: Those that are tried on every text.
    always: tuple[int, ...]
    #: Those that have a longer string than the one that says where to try them; they are tried only where it is there too.
    gated: frozenset[int]
    #: The strings with their length and those that need one of them, each with the first and last place of the string in a match (None: somewhere); those of one character apart.
    short: tuple[tuple[str, tuple[int, tuple]], ...]
    long: object

    def places(self, low: str) -> dict[int, list[int] | None]:
        """Which are to be tried on a text, given as ``plain``, and where a match can begin (None: anywhere)."""
        out: dict[int, list[int] | None] = dict.fromkeys(self.always)
        seen = set()
        if ahocorasick:
            found = [(end - of[0] + 1, of[1]) for end, of in self.long.iter(low)]
        else:
            found = [(i, of[1]) for x, of in self.long for i in _every(low, x)]
        for x, of in self.short:
            if x in low:
                found += [(i, of[1]) for i in _every(low, x)]
        for i, of in found:
            for n, lo, hi in of:
                if lo is None:
                    if n in self.gated:
                        seen.add(n)
                    else:
                        out[n] = None
                elif lo == hi:
                    if i >= lo:
                        out.setdefault(n, []).append(i - lo)
                else:
                    out.setdefault(n, []).extend(range(max(0, i - hi), i - lo + 1))
        for n in self.gated.intersection(out) - seen:
            del out[n]
        return out


def _every(text: str, x: str) -> Iterator[int]:
    i = text.find(x)
    while i >= 0:
        yield i
        i = text.find(x, i + 1)


@lru_cache(maxsize=16)
def compiled(patterns: tuple[Pattern, ...], rules: tuple[Rule, ...]) -> Bank:
    of: dict[str, list[tuple]] = {}
    always, gated = [], set()
    zeros = lambda strings: {x.translate(_ZEROS) for x in strings or ()}
    for i, (regex, any_case) in enumerate([(p.regex, True) for p in patterns] + [(r.regex, bool(r.flags & re.IGNORECASE)) for r in rules]):
        found, strings = (anchors(regex) or (), zeros(needed(regex))) if any_case else ((), set())
        at, longest = min((len(x) for x, _, _ in found), default=0), min(map(len, strings), default=0)
        if at == 1 < longest:  # too many places
            found = ()
        elif at >= min(longest, 4):
            strings = set() if found else strings
        elif found:
            gated.add(i)
        if not found and not strings:
            always.append(i)
        for x, lo, hi in [*found, *((x, None, None) for x in strings)]:
            of.setdefault(x, []).append((i, lo, hi))
    # A string of one character is in most texts, often many times.
    short = tuple((x, (1, tuple(n))) for x, n in sorted(of.items()) if len(x) < 2)
    long = [(x, (len(x), tuple(n))) for x, n in sorted(of.items()) if len(x) > 1]
    if ahocorasick:
        automaton = ahocorasick.Automaton()
        for x, n in long or [("\0\0", (2, ()))]:  # an automaton without words can't be asked
            automaton.add_word(x, n)
        automaton.make_automaton()
        long = automaton
    regexes = [re.compile(p.regex, re.IGNORECASE) for p in patterns] + [re.compile(r.regex, r.flags) for r in rules]
    return Bank(patterns, rules, tuple(regexes), tuple(always), frozenset(gated), short, long)


def find(text: str, bank: Bank, least: float, context_boost: float = 0.0, context_window: int = 40) -> tuple[list[dict], list[dict]]:
    """The spans of at least the least score, and the rules' hits."""
    spans, hits = _find(text, bank, least, context_boost, context_window)
    return [dict(zip(_SPAN.names, x)) for x in spans], [dict(zip(_HIT.names, x)) for x in hits]


def _matches(regex: re.Pattern, text: str, starts: list[int] | None) -> list[tuple[int, int]]:
    """The spans of ``regex.finditer``, of which each begins at one of the starts."""
    if starts is None:
        return [m.span() for m in regex.finditer(text)]
    out, end = [], 0
    for i in starts if len(starts) == 1 else sorted(set(starts)):
        if i >= end and (m := regex.match(text, i)):
            end = m.end()
            out.append((i, end))
    return out


def _find(text: str, bank: Bank, least: float, context_boost: float = 0.0, context_window: int = 40) -> tuple[list[tuple], list[tuple]]:
    """The same as tuples, with the fields of ``_SPAN`` and ``_HIT`` in order."""
    places = dict.fromkeys(range(len(bank.regexes))) if not text.isascii() and _FOLDED.search(text) else bank.places(plain(text))
    near = lambda a, b, w, words: any(x.lower() in text[max(0, a - w) : b + w].lower() for x in words)
    spans, hits, n = [], [], len(bank.patterns)
    for i in sorted(places):
        for a, b in _matches(bank.regexes[i], text, places[i]):
            if i >= n:
                r = bank.rules[i - n]
                there = near(a, b, r.window, r.context)
                hits.append((i - n, a, b, r.id, r.category, r.group, min(1.0, r.confidence + r.boost) if there else r.confidence, there, r.boost_only))
            elif b > a:
                p = bank.patterns[i]
                score = min(1.0, p.score + context_boost) if context_boost and near(a, b, context_window, p.context) else p.score
                if score >= least:
                    spans.append((a, b, p.category, score, i, p.layer))
    return spans, hits


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("confidence", pa.float64()), ("ord", pa.int32()), ("layer", pa.string())])
_HIT = pa.struct([("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string()), ("category", pa.string()), ("group", pa.string()), ("confidence", pa.float64()), ("context", pa.bool_()), ("boost_only", pa.bool_())])


#: Texts of one Arrow batch that are worked on at once.
ROWS = 512


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """An array of lists of structs, from flat columns."""
    flat = [x for row in rows for x in row]
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    columns = zip(*flat) if flat else [()] * kind.num_fields
    fields = [pa.array(c, f.type) for c, f in zip(columns, kind)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores if it has fewer, as a small file does; large inputs and streams stay as they are."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that a task scans, about.
PART_ROWS = 50_000


def parts(rows: int, cores: int) -> int:
    """Into how many parts so many rows are dealt: at least one a core, so that no task grows with the table."""
    return max(cores, -(-rows // PART_ROWS))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt to tasks of about ``PART_ROWS`` rows (those of equal ``by`` to one). For short rows, which cost less to move than to scan: a file's own parts hold whole row groups, of a million rows or so."""
    return df.repartition(parts(df.count(), df.sparkSession.sparkContext.defaultParallelism), *by)


def scan(df: DataFrame, patterns: list[Pattern], rules: list[Rule] = (), text_col: str = "text", least: float = 0.0, context_boost: float = 0.0, timed: bool = False) -> DataFrame:
    """``df`` with spans, hits and error (type and message of what a row's scan raised, else null). A null text counts as empty.

    timed: also scan_ms, what the row's scan took.
    """
    return scanned(df, patterns, rules, lambda text, spans, hits: (spans, hits), (("spans", _SPAN), ("hits", _HIT)), text_col, least, context_boost, timed)


def scanned(df: DataFrame, patterns: list[Pattern], rules: list[Rule], made: Callable[[str, list, list], tuple[list, ...]], columns: Sequence[tuple[str, pa.DataType]], text_col: str = "text", least: float = 0.0, context_boost: float = 0.0, timed: bool = False) -> DataFrame:
    """``df`` with columns of lists of structs, made of a text, its spans and its hits (as tuples, like the lists), and error."""
    key = (tuple(patterns), tuple(rules))
    at, names = df.columns.index(text_col), df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", {name} array<{_spark(kind)}>" for name, kind in columns) + ", error struct<error:string,error_type:string>" + ", scan_ms double" * timed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = compiled(*key)
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, max(1, whole.num_rows), ROWS)):
            rows, errors, times = [], [], []
            for text in batch.column(at).to_pylist():
                began = time.perf_counter()
                try:
                    row = made(text or "", *_find(text or "", bank, least, context_boost))
                    error = None
                except Exception as e:  # one bad row must not stop a batch
                    row, error = ([],) * len(columns), {"error": str(e), "error_type": type(e).__name__}
                rows.append(row)
                errors.append(error)
                times.append((time.perf_counter() - began) * 1000)
            more = [_lists([row[i] for row in rows], kind) for i, (_, kind) in enumerate(columns)] + [pa.array(errors, pa.struct([("error", pa.string()), ("error_type", pa.string())]))]
            more += [pa.array(times, pa.float64())] * timed
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *(name for name, _ in columns), "error", *["scan_ms"] * timed])

    return df.mapInArrow(run, schema)


def _spark(kind: pa.StructType) -> str:
    name = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.map_(pa.string(), pa.string()): "map<string,string>"}
    return "struct<" + ",".join(f"{f.name}:{name[f.type]}" for f in kind) + ">"
