"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding holds an agenda of adjacent symbol pairs whose concatenation is a piece, the
highest score first and the leftmost on ties; each step merges the best pair that is
still there. Characters that end as no piece fall back to byte pieces.

A merge can only cross a place between two characters that stand side by side in some
piece. Texts are therefore cut into units where the vocabulary has no such piece (in
front of a word mark; between word and other characters unless one of them occurs
beside the other kind in a piece), and equal units are encoded once and kept in a table of
bounded size. The cuts are worked out from the vocabulary, not assumed.

``check=True`` (the production setting) encodes the units that are new to the table
with the sentencepiece library too, one call an Arrow batch, and raises where ids differ.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the
empty text. Each row is encoded whole and alone, so repeated rows, ties and empty tables
need nothing. Only the id and text columns are read. A piece id outside the vocabulary
raises. In decoding, bytes that form no UTF-8 become one U+FFFD each.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import map_batches, read, texts

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Units in each of the two halves of a table; what isn't asked for while a half fills up is forgotten.
KEPT_UNITS = 200_000
#: Up to so many characters the agenda is a list, beyond that a heap.
SHORT = 48
NEVER = float("inf")

codecs.register_error("replace_each", lambda e: ("�" * (e.end - e.start), e.end))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """A vocabulary; as a dict, from a unit of marked text without its first mark to its ids as decimals joined by commas."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.library, self.library.vocab_size()
        if m.normalize(" ﬁ  a ") != f"{MARK}{MARK}ﬁ{MARK}{MARK}a{MARK}":
            raise ValueError("only models without normalisation and with a dummy prefix are supported")
        self.check = check
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        special = {i for i in range(n) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i)}
        if any(m.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.ids = {m.id_to_piece(i): i for i in range(n) if i not in special}
        self.scores = {p: -m.get_score(i) for p, i in self.ids.items()}
        self.unknown = m.unk_id()
        self.shown = {str(i): bytes([b]) for b, i in self.bytes.items()}
        self.shown |= {str(i): p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.shown |= {str(i): b"" for i in special if str(i) not in self.shown} | {str(self.unknown): " ⁇ ".encode()}
        self.old: dict[str, str] = {}
        self.fine: dict[str, str] = {}
        self.old_fine: dict[str, str] = {}
        self.fresh: list[tuple[str, list[int]]] = []
        self._find_cuts()

    def _find_cuts(self) -> None:
        """Word characters that stand beside others in a piece glue the two kinds together."""
        word = re.compile(r"\w")
        glue, inner_mark = set(), False
        for p in self.ids:
            body = p.lstrip(MARK)
            inner_mark |= MARK in body
            for a, b in zip(body, body[1:]):
                if bool(word.match(a)) != bool(word.match(b)):
                    glue.add(a if word.match(a) else b)
        self.simple = not inner_mark  # a space always starts a unit
        self.coarse = re.compile(f"{MARK}+[^{MARK}]*") if not inner_mark else re.compile(r"(?s).+")
        self.glue = re.compile("[" + re.escape("".join(sorted(glue))) + "]") if glue else re.compile(r"(?!)")
        self.runs = re.compile(rf"{MARK}*(?:\w+|[^\w{MARK}]+|$)") if not inner_mark else re.compile(r"(?s).+")

    def __missing__(self, unit: str) -> str:
        found = self.old.get(unit)
        if found is None:
            marked = MARK + unit
            parts = [marked] if self.glue.search(unit) else [x for x in self.runs.findall(marked) if x]
            # A part with a mark in front is a unit of its own and kept as one, not a second time among the parts.
            found = ",".join([self[x[1:]] if x[0] == MARK else self._part(x) for x in parts]) if len(parts) > 1 else self._ids_of(marked)
        if len(self) >= KEPT_UNITS:
            self.old = dict(self)
            self.clear()
        self[unit] = found
        return found

    def _part(self, part: str) -> str:
        found = self.fine.get(part)
        if found is None:
            found = self.old_fine.get(part)
            if found is None:
                found = self._ids_of(part)
            if len(self.fine) >= KEPT_UNITS:
                self.old_fine, self.fine = self.fine, {}
            self.fine[part] = found
        return found

    def _ids_of(self, part: str) -> str:
        ids = self.merge(part)
        if self.check:
            self.fresh.append((part, ids))
        return ",".join(map(str, ids))

    def merge(self, text: str) -> list[int]:
        """The ids of marked text by the agenda of adjacent pairs."""
        out: list[int] = []
        for s in self._short(text) if len(text) <= SHORT else self._long(text):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def _short(self, text: str) -> list[str]:
        """The agenda of a short text: the pairs' scores in order of place, so the first least one is next."""
        score = self.scores.get
        symbols = list(text)
        agenda = [score(a + b, NEVER) for a, b in zip(text, text[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], NEVER)
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], NEVER)
        return symbols

    def _long(self, text: str) -> list[str]:
        """The agenda of a long text: a heap of score, place and pair, with links between the symbols."""
        scores, n = self.scores, len(text)
        symbols: list[str] = list(text)
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(scores[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in scores]
        heapq.heapify(agenda)

        def offer(i: int, joined: str) -> None:
            if joined in scores:
                heapq.heappush(agenda, (scores[joined], i, joined))

        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = ahead[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, ""
            k = ahead[i] = ahead[j]
            if k < n:
                back[k] = i
                offer(i, pair + symbols[k])
            if back[i] >= 0:
                offer(back[i], symbols[back[i]] + pair)
        return [s for s in symbols if s]

    def units(self, text: str) -> list[str]:
        """The ids of a text's units. Every unit starts with a mark, the first one with that which the model puts there."""
        if not text:
            return []
        if "  " in text or MARK in text or text[-1] == " " or not self.simple:
            return [self[x[1:]] for x in self.coarse.findall(MARK + text.replace(" ", MARK))]
        if text[0] == " ":
            first, _, rest = text[1:].partition(" ")
            return [self[MARK + first], *(map(self.__getitem__, rest.split(" ")) if _ else ())]
        return list(map(self.__getitem__, text.split(" ")))

    def encode(self, text: str) -> str:
        """The ids of a text as decimals joined by commas."""
        return ",".join(self.units(text))

    def decode(self, ids: str) -> str:
        """The text of ids given as decimals joined by commas."""
        shown = b"".join(map(self.shown.__getitem__, ids.split(","))) if ids else b""
        return (shown[1:] if shown[:1] == b" " else shown).decode("utf-8", "replace_each")

    def verify(self) -> None:
        """Hold the units encoded since the last call against the library."""
        fresh, self.fresh = self.fresh, []
        # The library puts a mark in front of any text, so a mark alone has no text that it
        # would encode to it; behind a line break, which no piece holds, a unit without a
        # mark stands alone.
        marked = [x for x in fresh if x[0][0] == MARK and x[0] != MARK]
        lone = [x for x in fresh if x[0][0] != MARK]
        skip = len(self.library.encode("\n"))
        theirs = self.library.encode([x[1:].replace(MARK, " ") for x, _ in marked], num_threads=1)
        theirs += [ids[skip:] for ids in self.library.encode(["\n" + x for x, _ in lone], num_threads=1)]
        for (unit, ours), ids in zip(marked + lone, theirs, strict=True):
            if ids != ours:
                raise ValueError(f"the library encodes {unit!r} differently")


@lru_cache(maxsize=4)
def pieces(path: str, check: bool = True) -> Pieces:
    return Pieces(path, check)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and either ids (array of int) and decoded, or the SHA-256 of both."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def lists(ids: list[str]) -> pa.Array:
        flat = np.array(",".join([x for x in ids if x]).split(","), np.int32) if any(ids) else np.empty(0, np.int32)
        ends = np.cumsum([0] + [x.count(",") + 1 if x else 0 for x in ids])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    def rows(batch: pa.RecordBatch) -> dict:
        p = pieces(path, check)
        ids = [p.encode(x) for x in texts(batch)]
        if check:
            p.verify()
        out = {"doc_id": batch.column(0), "n_tokens": pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())}
        if digests:
            return out | {"ids_sha256": pa.array(map(sha, ids), pa.string()), "decoded_sha256": pa.array([sha(p.decode(x)) for x in ids], pa.string())}
        return out | {"ids": lists(ids), "decoded": pa.array(map(p.decode, ids), pa.string())}

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), model_path(), digests=True)


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLES: dict[str, str] = {}
