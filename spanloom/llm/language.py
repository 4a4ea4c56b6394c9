"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes long. In a context seen
n times with d distinct next bytes, a byte seen c times has the code length
-log2(c / (n + d)), and any other byte costs the escape, -log2(d / (n + d)), and is then
coded in the context that is one byte shorter; behind the empty context all 256 bytes
are alike. The statistics are frozen after training, so a byte's code length depends on
the bytes before it alone. The trees of all languages are therefore merged into one
sorted table: a row for every string of up to ``ORDER`` + 1 bytes that some language has
seen, with the code length of its last byte and the escape cost of the string as a
context, in each language. A whole batch is scored by looking up all its strings, the
longest first, and the shorter ones where there was no match.

The language of least total code length is predicted; the score is its share when each
language weighs 2 to the power of minus its mean code length a byte, sharpened, so 0.5
means that another language codes the text just as well.

Training: the texts of a sample of ``SAMPLE_DOCS`` documents a language at most, those
with the smallest hash of their id, up to ``SAMPLE_BYTES`` together; the text that goes
beyond is cut there. The sample is the only bounded part; every text is scored whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0. If nothing
can be learned (no language, or an empty table) every text is ``und``. Ties go to the
language first by code point. Rows without a language or text are not learned from.
Repeated rows are scored alike. Columns beside the
named ones are ignored, and passed on as they are by ``keep_known``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, crc32_mod, map_batches, read, slices

ORDER = 4
SAMPLE_DOCS = 300
SAMPLE_BYTES = 1 << 19
SALTS = 64
#: How many bytes a mean code length counts for in the score.
SHARPNESS = 24
#: Bytes that are scored at once. Scoring takes some hundred times as much memory meanwhile, with four languages.
BATCH_BYTES = 1 << 16
#: So many bits more than ``max_bits`` a byte a text may cost in all: a few odd words don't make it foreign.
SLACK_BITS = 128


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by length of the string, sorted
    slots: list[np.ndarray]  # by length: an open table of row numbers, -1 if free
    lengths: list[np.ndarray]  # by length: a row a key, a column a language: bits of the last byte
    escapes: list[np.ndarray]  # the same: bits of leaving the string as a context, 0 if unseen
    root: np.ndarray  # bits of a byte that no language has seen


def sample(docs: DataFrame, may_learn: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, list[bytes]]:
    """The texts to learn each language from. The ids are chosen first, so that no text is shuffled."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    sizes = rows.select("lang", "h", F.octet_length("text").alias("size")).where("size > 0")
    # First inside salted parts of a language, so that a frequent one isn't ordered in one task.
    part = W.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h")
    chosen = sizes.distinct().withColumn("n", F.row_number().over(part)).where(F.col("n") <= -(-4 * SAMPLE_DOCS // SALTS))
    chosen = chosen.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= SAMPLE_DOCS)
    room = F.lit(SAMPLE_BYTES) - F.sum("size").over(W.partitionBy("lang").orderBy("n")) + F.col("size")
    chosen = chosen.withColumn("room", room).where("room > 0").withColumn("take", F.least("room", "size").cast("int"))
    # So many at most as SAMPLE_DOCS a language. From an Arrow table, as rows would start Python workers of another kind, which stay.
    ids = docs.sparkSession.createDataFrame(chosen.select("lang", "h", "take").toArrow())
    found: dict[str, dict[int, bytes]] = {}
    part_of = F.substring(F.col("text").cast("binary"), F.lit(1), F.col("take")).alias("part")
    for r in rows.join(F.broadcast(ids), ["lang", "h"]).select("lang", "h", part_of).groupBy("lang", "h").agg(F.min("part").alias("part")).collect():
        found.setdefault(r.lang, {})[r.h] = bytes(r.part)
    return {lang: [t[h] for h in sorted(t)] for lang, t in found.items()}


def _strings(data: np.ndarray, length: int) -> np.ndarray:
    """The strings of ``length`` bytes that end at each byte, as numbers; the first few have no such string."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    out = np.zeros(len(data) - length + 1, np.uint64)
    for i in range(length):
        out = (out << np.uint64(8)) | data[i : len(data) - length + 1 + i].astype(np.uint64)
    return out


def _counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For strings of 1 to ORDER + 1 bytes: those that occur, sorted, and how often. Texts don't run into each other."""
    out = []
    for length in range(1, ORDER + 2):
        parts = [_strings(np.frombuffer(t, np.uint8), length) for t in texts]
        out.append(np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64)))
    return out


def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _table(keys: np.ndarray) -> np.ndarray:
    """An open-addressing table with room for four times the keys."""
    bits = max(4, int(len(keys) * 4).bit_length())
    slots = np.full(1 << bits, -1, np.int32)
    todo, at = np.arange(len(keys)), _hash(keys, bits)
    while len(todo):
        free = slots[at] < 0
        slots[at[free]] = todo[free]
        left = slots[at] != todo
        todo, at = todo[left], (at[left] + 1) & ((1 << bits) - 1)
    return slots


def _find(keys: np.ndarray, slots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The row of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int32)
    mask = len(slots) - 1
    at = _hash(wanted, len(slots).bit_length() - 1)
    rows = slots[at]
    miss = np.flatnonzero((rows >= 0) & (keys[rows] != wanted))
    while len(miss):
        at[miss] = (at[miss] + 1) & mask
        rows[miss] = slots[at[miss]]
        miss = miss[(rows[miss] >= 0) & (keys[rows[miss]] != wanted[miss])]
    return rows


def train(texts_of: dict[str, list[bytes]]) -> Model:
    """The merged tables of the languages' context trees."""
    languages = sorted(texts_of)
    counted = [_counts(texts_of[x]) for x in languages]
    keys = [np.unique(np.concatenate([c[i][0] for c in counted])) if counted else np.empty(0, np.uint64) for i in range(ORDER + 1)]
    slots = [_table(k) for k in keys]
    lengths = [np.zeros((len(k), len(languages)), np.float32) for k in keys]
    escapes = [np.zeros((len(k), len(languages)), np.float32) for k in keys]
    root = np.zeros(len(languages), np.float32)
    for col, counts in enumerate(counted):
        # How often a string is followed by any byte, and by how many different ones.
        total, distinct = [], []
        for i, (k, c) in enumerate(counts):
            row = np.searchsorted(keys[i - 1], k >> np.uint64(8)) if i else np.zeros(len(k), np.int64)
            total.append(np.bincount(row, c, len(keys[i - 1]) if i else 1))
            distinct.append(np.bincount(row, minlength=len(keys[i - 1]) if i else 1))
        for i in range(ORDER + 1):
            n, d = total[i], distinct[i]
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, np.log2(n + d) - np.log2(d), 0.0)
            row = np.searchsorted(keys[i], counts[i][0])
            c = np.zeros(len(keys[i]))
            c[row] = counts[i][1]
            if i:
                context = np.searchsorted(keys[i - 1], keys[i] >> np.uint64(8))
                escapes[i - 1][:, col] = escape
                shorter = np.searchsorted(keys[i - 1], keys[i] & np.uint64((1 << 8 * i) - 1))
                fall = escape[context] + lengths[i - 1][shorter, col]
                base = np.log2(np.maximum(n + d, 1))[context]
            else:
                root[col] = escape[0] + 8.0
                fall, base = root[col], np.log2(np.maximum(n + d, 1))[0]
            with np.errstate(divide="ignore"):
                lengths[i][:, col] = np.where(c > 0, base - np.log2(c), fall)
    return Model(languages, keys, slots, lengths, escapes, root)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language."""
    out = np.zeros((len(texts), len(model.languages)))
    at = 0
    while at < len(texts):  # as many texts at once as make a batch
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BATCH_BYTES):
            size += len(texts[upto])
            upto += 1
        out[at:upto] = _code_lengths(model, texts[at:upto])
        at = upto
    return out


def _code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    bits = np.zeros((len(texts), len(model.languages)))
    for a in range(0, len(data), BATCH_BYTES):  # a long text is scored in pieces that know the bytes before them
        b = min(a + BATCH_BYTES, len(data))
        owner = np.searchsorted(ends, np.arange(a, b), side="right")
        depth = np.minimum(np.arange(a, b) - (ends - sizes)[owner], ORDER)  # bytes before, in the same text
        first = max(0, a - ORDER)
        near = data[first:b].astype(np.uint64)
        per_byte = np.zeros((b - a, len(model.languages)), np.float32)
        todo = np.arange(b - a)
        for i in range(ORDER, -1, -1):
            string = np.zeros(len(near), np.uint64)
            for j in range(i + 1):
                string[j:] |= near[: len(near) - j] << np.uint64(8 * j)
            here = todo[depth[todo] >= i]
            place = here + (a - first)
            row = _find(model.keys[i], model.slots[i], string[place])
            hit = row >= 0
            per_byte[here[hit]] += model.lengths[i][row[hit]]
            missed = here[~hit]
            if i and len(missed):
                context = string[place[~hit]] >> np.uint64(8)
                up = _find(model.keys[i - 1], model.slots[i - 1], context)
                per_byte[missed[up >= 0]] += model.escapes[i - 1][up[up >= 0]]
            elif len(missed):
                per_byte[missed] += model.root
            rest = np.ones(b - a, bool)
            rest[here[hit]] = False
            todo = todo[rest[todo]]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        bits[owner[starts]] += np.add.reduceat(per_byte, starts, axis=0)
    return bits


_LETTER = re.compile(r"[^\W\d_]")


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """The language, the score and the bits a byte of each text."""
    out = [("und", 0.0, 0.0)] * len(texts)
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model.languages else []
    raw = [texts[i].encode() for i in known]
    for i, t, bits in zip(known, raw, code_lengths(model, raw)):
        mean = bits / len(t)
        best = int(mean.argmin())
        out[i] = (model.languages[best], float(1 / np.exp2(SHARPNESS * (mean[best] - mean)).sum()), float(mean[best]))
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits (a byte)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> dict:
        found = predict(shared.value, batch.column(1).to_pylist())
        lang, score, bits = zip(*found)
        return {"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "bits": pa.array(bits, pa.float64())}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, "doc_id long, lang_pred string, score double, bits double")


def learned(docs: DataFrame) -> Model:
    """A model of the documents that aren't held out."""
    return train(sample(docs, crc32_mod(F.col("doc_id"), 5) != 0))


def keep_known(docs: DataFrame, model: Model, max_bits: float = 8.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are text of a learned language: not ``und``, and coded in ``max_bits`` a byte and ``SLACK_BITS`` at most.

    8 bits a byte is what a text costs without a model, so text of a learned language stays far
    below; languages and scripts not learned, and random letters, cost 10 to 20.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            found = batch.column(at).to_pylist()
            known = [x[0] != "und" and (x[2] - max_bits) * len(t.encode()) <= SLACK_BITS for t, x in zip(found, predict(shared.value, found))]
            yield batch.filter(pa.array(known, pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learned(docs)).select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "bits")


QUERIES = {"op3_language": op3_language}
ORACLES: dict[str, str] = {}
