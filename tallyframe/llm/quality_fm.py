"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a vector x of three groups of inputs: its words hashed into ``buckets`` (the square root of each count,
scaled to length 1), statistics of its structure (each as the bin of a fixed scale that it falls into), and numeric metadata columns
(binned likewise). Its score is the logistic function of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

where the pair term is 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): linear in the number of inputs. Weights are
fitted by Adam over logistic loss on at most ``max_rows`` labelled rows (a parameter), those with the smallest hash of their id; their
inputs, of a fixed length whatever the text's, come to the driver. Scoring reads every whole text.

Defined cases: a null text is an empty one and gets a score; null or non-finite metadata has a bin of its own; labels that are null
or whose document is missing are skipped; of several labels of one id the larger counts, of several texts of one id the largest is the
sample's; without labels of both kinds every score is the smoothed share of label 1; repeated rows get equal scores; other columns
are never read, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.storage import WHILE_WRITING, claim_cache, materialize, scratch, settings, slices

BUCKETS = 1024
#: Words whose bucket a worker remembers; longer ones than LONG aren't.
CACHED, LONG = 300_000, 64
SYMBOLS = b"#$%&*|!"
MARKED = re.compile(r"[#$%&*|!]").search
#: Bins of a share: its edges.
SHARES = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97)
#: Bins of a length or a count: its edges.
SIZES = (0, 1, 2, 3, 5, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384)
SHARE_NAMES = ("distinct words", "repeated neighbours", "capital letters", "digits", "symbols", "full stops", "words with a symbol", "capital words", "repeated lines", "lone separators", "commonest word")
SIZE_NAMES = ("words", "lines", "mean word", "longest word", "longest repeat", "mean line")
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def _count(raw: bytes, what: bytes) -> int:
    return len(raw) - len(raw.translate(None, what))


def statistics(text: str, words: list[str], counts: Counter[str]) -> tuple[list[float], list[float]]:
    """Shares and sizes in the order of their names."""
    raw, n = text.encode(), max(1, len(words))
    chars = max(1, len(raw))
    same = list(map(eq, words, islice(words, 1, None)))
    repeats = sum(same)
    longest = run = 1
    if repeats:
        for s in same:
            run = run + 1 if s else 1
            longest = max(longest, run)
    lines = text.split("\n")
    marked = sum([k for w, k in counts.items() if not w.isalnum() and MARKED(w)])
    shares = [
        len(counts) / n,
        repeats / n,
        _count(raw, CAPITALS) / chars,
        _count(raw, DIGITS) / chars,
        _count(raw, SYMBOLS) / chars,
        _count(raw, b".") / chars,
        marked / n,
        sum([k for w, k in counts.items() if w.isupper()]) / n,
        1 - len(set(lines)) / len(lines),
        sum([counts[w] for w in ("|", "-", "*", "/", ">") if w in counts]) / n,
        max(counts.values(), default=0) / n,
    ]
    sizes = [len(words), len(lines), len(text) / n, max(map(len, counts), default=0), longest if words else 0, len(text) / len(lines)]
    return shares, sizes


def _bin(edges: tuple[float, ...], value: float | None) -> int:
    """0 for no value or one that is not finite, else 1 and up."""
    return 0 if value is None or not math.isfinite(value) else 1 + bisect_right(edges, value)


class Inputs:
    """Turns texts and metadata into rows of inputs. Words' buckets are remembered, a bounded number (cleared when full)."""

    def __init__(self, n_metadata: int, buckets: int = BUCKETS) -> None:
        self.buckets, self.n_metadata = buckets, n_metadata
        self.share_at = buckets
        self.size_at = self.share_at + len(SHARE_NAMES) * (len(SHARES) + 2)
        self.width = self.size_at + (len(SIZE_NAMES) + n_metadata) * (len(SIZES) + 2)
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            got = zlib.crc32(word.lower().encode()) % self.buckets
            if len(word) <= LONG:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[word] = got
        return got

    def row(self, text: str | None, metadata: tuple[float | None, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Places (rising) and values of the inputs that are not 0."""
        text = text or ""
        words = text.split()
        counts = Counter(words)
        hashed = np.bincount([self.bucket(w) for w in counts], weights=list(counts.values()), minlength=self.buckets) if counts else np.zeros(self.buckets)
        at = np.flatnonzero(hashed)
        value = np.sqrt(hashed[at])
        value /= np.linalg.norm(value) or 1.0
        shares, sizes = statistics(text, words, counts)
        bins = [self.share_at + i * (len(SHARES) + 2) + _bin(SHARES, s) for i, s in enumerate(shares)]
        bins += [self.size_at + i * (len(SIZES) + 2) + _bin(SIZES, s) for i, s in enumerate([*sizes, *metadata])]
        return np.concatenate([at, bins]), np.concatenate([value, np.full(len(bins), 1 / math.sqrt(len(bins)))])


class FactorisationMachine:
    """w0, a weight for each input, and a short vector for each input whose inner products weigh pairs."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.w, self.v = w0, w, v

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        """By the sum-of-squares identity, in one pass over the inputs."""
        mine = self.v[at] * value[:, None]
        return float(self.w0 + self.w[at] @ value + 0.5 * ((mine.sum(0) ** 2).sum() - (mine**2).sum()))

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        """From 0 to 1, to 9 digits."""
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(at, value))))), 9)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, rank: int = 8, epochs: int = 30, batch: int = 64, rate: float = 0.02, decay: float = 2e-5, seed: int = 5) -> FactorisationMachine:
    """Adam over mini-batches of logistic loss; ``rows`` are (places, values)."""
    dice = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    parts = [np.array([math.log(share / (1 - share))]), np.zeros(width), dice.normal(0, 0.05, (width, rank))]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(epochs):
        order = dice.permutation(len(y))
        for first in range(0, len(order), batch):
            chosen = order[first : first + batch]
            x = np.zeros((len(chosen), width))
            for i, r in enumerate(chosen):
                x[i, rows[r][0]] = rows[r][1]
            sums = x @ parts[2]
            margin = parts[0][0] + x @ parts[1] + 0.5 * ((sums**2).sum(1) - (x**2 @ parts[2] ** 2).sum(1))
            error = (1 / (1 + np.exp(-margin)) - y[chosen]) / len(chosen)
            weighted = x * error[:, None]
            grads = [np.array([error.sum()]), weighted.sum(0) + decay * parts[1], weighted.T @ sums - parts[2] * (x * weighted).sum(0)[:, None] + decay * parts[2]]
            step += 1
            for p, g, m, s in zip(parts, grads, mean, square, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(float(parts[0][0]), parts[1], parts[2])


class QualityModel:
    """Inputs and machine together; without a machine every score is ``share``."""

    def __init__(self, n_metadata: int, share: float, machine: FactorisationMachine | None) -> None:
        self.n_metadata, self.share, self.machine = n_metadata, share, machine

    def scores(self, inputs: Inputs, texts: list[str | None], metadata: list[tuple[float | None, ...]]) -> list[float]:
        if self.machine is None:
            return [self.share] * len(texts)
        return [self.machine.score(*inputs.row(t, m)) for t, m in zip(texts, metadata, strict=True)]


def _slim(docs: DataFrame, id_col: str, text_col: str, metadata_cols: tuple[str, ...]) -> DataFrame:
    numbers = [F.col(f"`{c}`").cast("double").alias(f"_m{i}") for i, c in enumerate(metadata_cols)]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *numbers)


def _metadata(batch: pa.RecordBatch) -> list[tuple[float | None, ...]]:
    columns = [c.to_pylist() for c in batch.columns[2:]]
    return list(zip(*columns, strict=True)) if columns else [()] * batch.num_rows


def input_rows(texts: DataFrame, n_metadata: int) -> DataFrame:
    """doc_id, at (32-bit places) and value (32-bit floats) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = Inputs(n_metadata)
        claim_cache("quality", inputs.known.clear)
        for batch in slices(batches):
            rows = [inputs.row(t, m) for t, m in zip(batch.column(1).to_pylist(), _metadata(batch), strict=True)]
            columns = [batch.column(0), pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "value"])

    return texts.mapInArrow(run, "doc_id long, at binary, value binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata_cols: tuple[str, ...] = (), max_rows: int = 12_000, seed: int = 3) -> QualityModel:
    """A model from ``labels``, which holds only rows that may be learned from; it is fitted on at most ``max_rows`` of them."""
    slim = _slim(docs, id_col, text_col, metadata_cols)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    with scratch(docs.sparkSession), settings(docs.sparkSession, WHILE_WRITING):
        usable = known.groupBy("doc_id").agg(F.max("y").alias("y")).join(slim.select("doc_id").distinct(), "doc_id", "left_semi")
        usable = materialize(usable, "quality-labels")
        total, good = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
        share = (good + 1) / (total + 2)
        if good in (0, total):
            return QualityModel(len(metadata_cols), share, None)
        chosen = materialize(usable.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows), "quality-sample")
        whole = ["text", *slim.columns[2:]]
        sample = slim.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max(F.struct(*whole)).alias("r"))  # at most max_rows ids
        texts = materialize(sample.select("doc_id", "r.*", "y"), "quality-texts")
        inputs = input_rows(texts.drop("y"), len(metadata_cols))
        got = sorted(inputs.join(texts.select("doc_id", "y"), "doc_id").collect(), key=lambda r: r["doc_id"])  # at most max_rows rows of bounded length
    rows = [(np.frombuffer(bytes(r["at"]), "<i4").astype(np.int64), np.frombuffer(bytes(r["value"]), "<f4").astype(np.float64)) for r in got]
    y = np.array([r["y"] for r in got], np.float64)
    return QualityModel(len(metadata_cols), share, fit(rows, y, Inputs(len(metadata_cols)).width))


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", metadata_cols: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector for each of a fixed number of inputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        inputs = Inputs(judge.n_metadata)
        claim_cache("quality", inputs.known.clear)
        for batch in slices(batches):
            scores = judge.scores(inputs, batch.column(1).to_pylist(), _metadata(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return _slim(docs, id_col, text_col, metadata_cols).mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op12_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a machine that learned from the labels outside the held-out fold: one row each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score_documents(docs, train(docs, labels, metadata_cols=("n_chars",)), metadata_cols=("n_chars",))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
