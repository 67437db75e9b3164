"""Packing documents into token windows by non-negative least squares over a length histogram.

1. Every document is encoded, ends with an end id, and is cut into whole windows and one rest. A piece's class is
   its length in steps of ``step`` tokens, rounded up, so the histogram has ``window / step`` entries at any size
   of corpus.
2. All combinations of at most ``depth`` classes that fill a window are enumerated; non-negative least squares
   finds the repeat counts that reproduce the histogram; they are rounded, never beyond what is left of a class;
   the residual pieces are packed greedily, largest first, as patterns with repeat counts too.
3. A piece's rank within its class says which repeat of which pattern it fills. Ranks come from counts by (class,
   bucket of the document) and row numbers inside these small groups, so a length that a third of all documents
   share is spread over many tasks.

Defined cases: a null or empty text is the end id alone; equal documents get pieces of their own; an empty table
gives no rows; repeated rows are packed one by one; long texts
are encoded whole, and runs without a space in them aren't remembered. A sequence is padded to the window (``padded``), but for one whose
length is itself a power of two, which stays as it is.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from struct import Struct
from struct import pack as to_bytes
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.bpe_prefix import byte_alphabet
from tallyframe.llm.storage import claim_cache, materialize, slices

VOCABULARY = "word_bpe_49k.json"
CACHED = 900_000
#: Longer runs of non-space characters aren't remembered.
LONG = 64
GLUED = re.compile(r"(?:[^\w\s]|_)[.,]")
#: Little-endian unsigned 32-bit packers of so many ids.
PACKED = [Struct(f"<{n}I").pack for n in range(16)]
#: Words on which the model alone must agree with the whole tokenizer before it is asked alone.
PROBES = ("a", "the", "oftionnten", "straße", "éèêçñóíäöüß", "ª", "µm", "zzzzzzzzzzzzzzzzz", "don", "s", "re")
#: Marks that often follow a word; no apostrophe, which begins endings of its own.
MARKS = ".,;:!?*$%#&|-)]}>"
#: Characters that str.split() takes for space and the vocabulary's normalizer doesn't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


class WordEncoder:
    """Ids of whole texts as little-endian bytes, for a vocabulary that drops white space and joins no words over it.

    Each run of non-space characters is encoded by the tokenizers library once and then answered from a bounded
    cache (cleared when full); plain words go to its model without the steps around it. Texts with special tokens or unusual control characters are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[str, bytes] = {}
        self.letters = dict(enumerate(byte_alphabet()))
        self.direct = all(self._word(w) == self._whole(w) for w in PROBES)

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case Latin-1 word straight from the model: there is nothing to normalize or to split."""
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(text)]
        return to_bytes(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, run: str) -> bool:
        return self.direct and run.isalpha() and run.islower() and (run.isascii() or max(run) < "\u0100")

    @staticmethod
    def _runs(text: str) -> list[str] | None:
        if "<|" in text or any(c in text for c in NOT_SPACE):
            return None
        if not text.isascii() and max(text) > "\xff":
            return text.split()
        text = text.lower()  # without combining marks, lower case is the same before and after normalization
        if not GLUED.search(text):  # a full stop or comma after a letter, digit or space begins a token of its own
            text = text.replace(".", " .").replace(",", " ,")
        return text.split()

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of unknown runs. A letter and a mark after it are never one token, so a run's marks are encoded apart.

        Some letters normalize to a letter with a combining mark; that and a mark after it can be one token.
        """
        known, found = self.known, {}
        cut, parts = [], set()
        for run in new:
            head = run.rstrip(MARKS)
            if len(head) != len(run) and normalize("NFC", head[-1:].lower())[-1:].isalpha():
                marks = run[len(head) :]
                cut.append((run, head, marks))
                parts.add(head)
                parts.add(marks)
            else:
                parts.add(run)
        whole, direct, tokenize = [], self.direct, self.tokenizer.model.tokenize
        for run in parts:
            if run in known:
                found[run] = known[run]
            elif direct and run.isascii() and run.isalpha() and run.islower():
                ids = [t.id for t in tokenize(run)]
                found[run] = PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else to_bytes(f"<{len(ids)}I", *ids)
            elif self._plain(run):
                found[run] = self._word(run)
            else:
                whole.append(run)
        for at in range(0, len(whole), 4096):
            part = whole[at : at + 4096]
            for run, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[run] = to_bytes(f"<{len(got)}I", *got.ids)
        for run, head, marks in cut:
            found[run] = found[head] + found[marks]
        if len(known) + len(found) > CACHED:
            known.clear()
        known.update([(r, ids) for r, ids in found.items() if len(r) <= LONG])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        runs = [self._runs(t) for t in texts]
        found = [None if r is None else list(map(self.known.get, r)) for r in runs]
        new = {w for r, f in zip(runs, found, strict=True) if f is not None and None in f for w, ids in zip(r, f, strict=True) if ids is None}
        learned = self._learn(new) if new else {}
        out = []
        for text, words, ids in zip(texts, runs, found, strict=True):
            if words is None:
                out.append(self._whole(text))
            else:
                out.append(b"".join(ids if None not in ids else [learned[w] if i is None else i for w, i in zip(words, ids, strict=True)]))
        return out


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: whole windows, then the rest."""
    import public_tokenizers

    path = vocabulary_path or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache(("packing", path), _encoder.cache_clear)
        encoder = _encoder(path)
        for batch in slices(batches, 128):
            rows = []
            encoded = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                total = len(ids) // 4
                rows += [(doc_id, at, min(window, total - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), total) for at in range(0, total, window)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(size: int, depth: int) -> list[tuple[int, ...]]:
    """Falling lists of at most ``depth`` positive numbers that add up to ``size``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            out.append(head)
            return
        slots = depth - len(head)
        for n in range(min(most, left), 0, -1):
            if n * slots < left:
                break
            grow((*head, n), left - n, n)

    grow((), size, size)
    return out


def non_negative_least_squares(classes: np.ndarray, scale: np.ndarray, target: np.ndarray, steps: int = 1500) -> np.ndarray:
    """x >= 0 that (nearly) minimizes |scale * (a x) - target|, by accelerated projected gradients.

    ``a`` counts each class in each combination; it is given by ``classes``, a row of class places for each
    combination (filled up with len(target)), so that a step costs as much as there are entries.
    """
    n, depth = classes.shape
    weight = np.append(scale, 0.0)
    flat = classes.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, depth), len(target) + 1)[:-1] * scale

    def back(r: np.ndarray) -> np.ndarray:
        return (weight * np.append(r, 0.0))[classes].sum(1)

    v = np.ones(n)
    for _ in range(50):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    rate, t = 1 / (np.linalg.norm(forward(v)) ** 2 * 1.05), 1.0
    x = y = np.zeros(n)
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(forward(y) - target))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def plan_patterns(histogram: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(classes, repeats) patterns that hold each piece exactly once. histogram: pieces of class 1, 2, ..., the window's."""
    size = len(histogram)
    left = [0, *map(int, histogram)]
    choices = [c for c in combinations(size, depth) if all(left[k] for k in c)]
    out: list[tuple[tuple[int, ...], int]] = []
    if choices:
        classes = np.array([[k - 1 for k in c] + [size] * (depth - len(c)) for c in choices])
        scale = 1 / np.sqrt(np.maximum(1, np.asarray(histogram, float)))
        x = non_negative_least_squares(classes, scale, np.asarray(histogram, float) * scale)
        for j in np.argsort(-x, kind="stable"):
            c = choices[j]
            n = min([round(float(x[j])), *(left[k] // c.count(k) for k in set(c))])
            if n > 0:
                out.append((c, n))
                for k in c:
                    left[k] -= n
    while top := max((k for k in range(1, size + 1) if left[k]), default=0):
        taken = [0] * (size + 1)
        taken[top], pattern, room = 1, [top], size - top
        while k := max((k for k in range(1, min(room, size) + 1) if left[k] > taken[k]), default=0):
            fits = min(room // k, left[k] - taken[k])
            pattern += [k] * fits
            taken[k] += fits
            room -= k * fits
        n = min(left[k] // taken[k] for k in set(pattern))
        out.append((tuple(pattern), n))
        for k in set(pattern):
            left[k] -= n * taken[k]
    return out


def pack(pieces: DataFrame, window: int = 2048, step: int = 8, depth: int = 3, bucket_rows: int = 50_000) -> DataFrame:
    """The pieces of ``cut_documents`` with sequence_id, offset and padded. ``pieces`` is read several times: pass a stored table."""
    sized = pieces.withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    counts = sized.groupBy("class").count().collect()  # at most window / step rows
    histogram = np.zeros(window // step, np.int64)
    for r in counts:
        histogram[r["class"] - 1] = r["count"]
    patterns = plan_patterns(histogram, depth)
    first = np.concatenate([[0], np.cumsum([n for _, n in patterns])]).astype(np.int64)
    places: dict[int, list[tuple[int, int, int]]] = {}
    for p, (classes, n) in enumerate(patterns):
        for place, k in enumerate(classes):
            places.setdefault(k, []).append((int(first[p]), n, place))
    tables = {k: (np.concatenate([[0], np.cumsum([n for _, n, _ in v])]), np.array([f for f, _, _ in v]), np.array([i for _, _, i in v])) for k, v in places.items()}

    buckets = max(64, int(histogram.sum()) // bucket_rows)
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n")).select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(bases, ["class", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("base") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence, order = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int32)
            for k in np.unique(kind):
                mine = np.flatnonzero(kind == k)
                ends, firsts, at = tables[int(k)]
                entry = np.searchsorted(ends, rank[mine], "right") - 1
                sequence[mine], order[mine] = firsts[entry] + rank[mine] - ends[entry], at[entry]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(order)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])

    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place int")
    inside = Window.partitionBy("sequence_id")
    so_far = inside.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.sum("length").over(inside)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(so_far), F.lit(0)).alias("offset"), F.when(filled.bitwiseAND(filled - 1) == 0, filled).otherwise(F.lit(window)).cast("long").alias("padded")
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, vocabulary_path: str | None = None, step: int = 8, depth: int = 3) -> DataFrame:
    """Encode, cut and pack: one row for each piece."""
    return pack(materialize(cut_documents(docs, id_col, text_col, window, end_id, vocabulary_path), "pieces", keep=True), window, step, depth)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens: one row for each piece."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
