"""Toxicity by non-negative positive-unlabelled (nnPU) learning in numpy.

Confirmed toxic texts (P) and texts without regard to any label (U) train a linear classifier over how
many different words hold a character n-gram (at least 1, 2, 3 or 5: one feature each). Its risk is
``prior * R_P+ + max(0, R_U- - prior * R_P-)``: what U says about clean texts, corrected by the share of toxic ones in U;
where the corrected term falls below zero, only it is pushed back up.

Features are counted on executors: n-grams of all confirmed texts with partial sums, those that may tell P from U over
all documents. Only which n-grams are candidates (``n_candidates``) comes from a sample. The classifier is fitted on bounded
samples of the labelled rows by the hash of their id: at most ``max_positives`` confirmed ones and ``max_unlabelled``
whose label is not read. The class prior is the share of toxic rows among all labels that may be learned from, that is
of those that U is drawn from. Only the 0/1 features of sampled rows come to the driver, as bits. Scoring reads every
whole text.

Defined cases: a null or empty text has no n-grams and scores the bias; an unlabelled id and a label without
document are skipped; several labels of one document count as toxic if one says so; rows with equal ids are texts of their
own, but one of them stands for the id in a sample; a long text or run is counted in passes over classes of n-grams; without a confirmed toxic text every score is the smoothed prior; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.storage import WHILE_WRITING, claim_cache, materialize, scratch, settings, slices

LEVELS = (1, 2, 3, 5)
HEADS = range(3, 10)
INNER = (4, 6)
WORD = re.compile(r"\w+")
#: Runs whose known n-grams a worker remembers, and n-grams that it remembers while all are counted; longer runs than LONG aren't.
CACHED = 400_000
KEPT_GRAMS = 300_000
LONG = 64
#: N-grams that a task counts before it hands its sums on.
HELD = 100_000
#: Characters of different runs whose n-grams are counted at a time; a text with more takes several passes.
PASS_CHARS = 400_000
#: Ids of confirmed texts that go to every task; more are joined over a shuffle.
BROADCAST_IDS = 500_000
#: Log-likelihood gain that an n-gram must show, so that few positives don't make features of chance.
EVIDENCE = 12.0
#: Least share of toxic texts among those that hold an n-gram, as estimated from P, U and the prior.
PURITY = 0.6


def grams(run: str) -> set[str]:
    """Of each word in a run of non-space characters: itself between blanks, its beginnings after a blank, and inner n-grams."""
    out = set()
    for word in WORD.findall(run) or [run]:
        out.add(f" {word} ")
        out.update([f" {word[:n]}" for n in HEADS if n <= len(word)])
        out.update([word[i : i + n] for n in INNER for i in range(len(word) - n + 1)])
    return out


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different 0/1 rows, with the share of rows that each stands for; its last column is the bias."""
    bits, count = np.unique(np.packbits(rows.astype(bool), axis=1), axis=0, return_counts=True)
    x = np.unpackbits(bits, axis=1, count=rows.shape[1]).astype(np.float64)
    return np.hstack([x, np.ones((len(x), 1))]), count / max(1, len(rows))


def nnpu_risk(w: np.ndarray, p: tuple[np.ndarray, np.ndarray], u: tuple[np.ndarray, np.ndarray], prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(positive part, corrected clean part, their gradients) at weights w; p and u are rows and their shares. Logistic loss."""
    gp, gu = p[0] @ w, u[0] @ w
    sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    wrong = prior * (p[1] @ np.logaddexp(0, -gp))
    clean = u[1] @ np.logaddexp(0, gu) - prior * (p[1] @ np.logaddexp(0, gp))
    return wrong, clean, prior * ((p[1] * (sp - 1)) @ p[0]), (u[1] * su) @ u[0] - prior * ((p[1] * sp) @ p[0])


def nnpu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier; rows are 0/1 features. Full batches, Adam; below zero only the clean part is pushed back."""
    p, u = _distinct(positive), _distinct(unlabelled)
    w = np.zeros(p[0].shape[1])
    w[-1] = math.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        _, corrected, wrong, clean = nnpu_risk(w, p, u, prior)
        g = wrong + clean if corrected >= 0 else -clean
        g[:-1] += decay * w[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


class GramCounter:
    """How many different runs of a text hold each of the known n-grams. Runs are remembered (a bounded cache, cleared when full).

    An n-gram of a run is found as a part of its words, each between blanks, by one automaton over all known n-grams.
    """

    def __init__(self, names: list[str]) -> None:
        self.__setstate__({"ids": {g: i for i, g in enumerate(names)}})

    def __getstate__(self) -> dict:
        return {"ids": self.ids}

    def __setstate__(self, state: dict) -> None:
        self.ids: dict[str, int] = state["ids"]
        self.known: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for g, i in self.ids.items():
            self.automaton.add_word(g, i)
        self.automaton.make_automaton()

    def learn(self, run: str) -> tuple[int, ...]:
        words = "  ".join(WORD.findall(run)) or run
        got = tuple(sorted({i for _, i in self.automaton.iter(f" {words} ")})) if self.ids else ()
        if len(run) <= LONG:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[run] = got
        return got

    def counts(self, text: str | None) -> Counter[int]:
        runs = set((text or "").lower().split())
        got = list(map(self.known.get, runs))
        if None in got:
            got = [self.learn(r) if g is None else g for r, g in zip(runs, got, strict=True)]
        return Counter(chain.from_iterable(got))


class ToxicityModel:
    """Chosen (n-gram, level) features with weights, and a bias."""

    def __init__(self, weights: dict[tuple[str, int], float], bias: float) -> None:
        names = list(dict.fromkeys(g for g, _ in weights))
        self.counter, self.bias = GramCounter(names), bias
        by_level = np.zeros((len(names), len(LEVELS)))
        for (g, level), w in weights.items():
            by_level[self.counter.ids[g], level] = w
        #: What n words with the n-gram add, for n from 0 to the last level.
        self.adds = [[0.0] + [float(by_level[i, [k for k, n in enumerate(LEVELS) if n <= count]].sum()) for count in range(1, LEVELS[-1] + 1)] for i in range(len(names))]

    def score(self, text: str | None) -> float:
        counts = self.counter.counts(text)
        g = self.bias + sum([self.adds[i][min(counts[i], LEVELS[-1])] for i in sorted(counts)])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, g))))


COUNTS = [f"n{k}" for k in range(len(LEVELS))]
GRAM_SCHEMA = "gram string, " + ", ".join(f"{c} long" for c in COUNTS)


class RunGrams:
    """N-grams of runs; those of short runs are remembered, a bounded number (cleared when full)."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def of(self, run: str) -> Iterable[str]:
        got = self.known.get(run)
        if got is not None:
            return got
        if len(run) > LONG:
            return grams(run)
        got = self.known[run] = tuple(grams(run))
        self.held += len(got)
        if self.held > KEPT_GRAMS:
            self.known.clear()
            self.held = 0
        return got

    def passes(self, text: str | None, most: int) -> Iterator[Counter[str]]:
        """How many different runs of the text hold each n-gram: one counter, or, for a text with more than ``most``
        characters of different runs, one for each class of n-grams by hash, so that none grows with the text."""
        runs = set((text or "").lower().split())
        classes = 1 + sum(map(len, runs)) // most
        for c in range(classes):
            counts: Counter[str] = Counter()
            for r in runs:
                counts.update(self.of(r) if classes == 1 else [g for g in self.of(r) if hash(g) % classes == c])
            yield counts


def count_grams(texts: DataFrame, most: int = PASS_CHARS) -> DataFrame:
    """(gram, n0, n1, ...): texts in which at least LEVELS[k] different runs hold each n-gram, of all n-grams of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("grams", dict)
        of_runs = RunGrams()
        sums: list[Counter[str]] = [Counter() for _ in LEVELS]

        def hand_on() -> pa.RecordBatch:
            names = list(sums[0])
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[g] for g in names], pa.int64()) for c in sums]], ["gram", *COUNTS])
            for c in sums:
                c.clear()
            return out

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for counts in of_runs.passes(text, most):
                    sums[0].update(counts.keys())
                    several = [(g, n) for g, n in counts.items() if n > 1]
                    for c, level in zip(sums[1:], LEVELS[1:], strict=True):
                        c.update([g for g, n in several if n >= level])
                    if len(sums[0]) > HELD:
                        yield hand_on()
        yield hand_on()

    return texts.select("text").mapInArrow(run, GRAM_SCHEMA).groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])


def count_known(texts: DataFrame, names: list[str]) -> np.ndarray:
    """``count_grams`` of the named n-grams alone: a row for each name. Tasks return sums, and these are added before they are collected."""
    shared = texts.sparkSession.sparkContext.broadcast(GramCounter(names))  # at most n_candidates n-grams
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        claim_cache(("toxicity", id(counter)), counter.known.clear)
        sums = np.zeros((len(LEVELS), size), np.int64)
        for batch in slices(batches):
            found = [counter.counts(t) for t in batch.column(0).to_pylist()]
            at = np.fromiter(chain.from_iterable(found), np.int64)
            n = np.fromiter(chain.from_iterable([c.values() for c in found]), np.int64)
            for k, level in enumerate(LEVELS):
                sums[k] += np.bincount(at[n >= level], minlength=size)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(s[some]) for s in sums]], ["i", *COUNTS])

    out = np.zeros((size, len(LEVELS)), np.int64)
    counted = texts.select("text").mapInArrow(run, "i long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("i").agg(*[F.sum(c).alias(c) for c in COUNTS])
    for r in counted.collect():
        out[r["i"]] = [r[c] for c in COUNTS]
    return out


def feature_rows(texts: DataFrame, features: list[tuple[str, int]]) -> np.ndarray:
    """A row of 0/1 features for each of a bounded number of texts, sorted; packed bits come to the driver."""
    names = list(dict.fromkeys(g for g, _ in features))
    shared = texts.sparkSession.sparkContext.broadcast((GramCounter(names), features))  # the chosen features
    place = {g: i for i, g in enumerate(names)}
    grams_at, levels_at = np.array([place[g] for g, _ in features], np.int64), np.array([LEVELS[k] for _, k in features])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value[0]
        claim_cache(("toxicity", id(counter)), counter.known.clear)
        for batch in slices(batches):
            out = []
            for text in batch.column(0).to_pylist():
                held = np.zeros(len(names), np.int64)
                found = counter.counts(text)
                held[list(found)] = list(found.values())
                out.append(np.packbits(held[grams_at] >= levels_at).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["bits"])

    rows = sorted(bytes(r["bits"]) for r in texts.select("text").mapInArrow(run, "bits binary").collect())
    packed = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -(-len(features) // 8))
    return np.unpackbits(packed, axis=1, count=len(features))


def sample_ids(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` of the distinct ids: those whose hash lies below a bound that about 1.2 times as many meet, smallest first."""
    bound = min(1.0, 1.2 * most / max(1, ids.count()))
    salted = F.xxhash64(F.lit(seed), "doc_id")
    near = ids.select("doc_id", salted.alias("h")).where(F.lit(bound >= 1) | (F.abs(F.col("h") / 2.0**63) < bound)).collect()
    chosen = [(r["doc_id"],) for r in sorted(near, key=lambda r: (r["h"], r["doc_id"]))[:most]]
    return ids.sparkSession.createDataFrame(chosen, "doc_id long")


def _gain(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, prior: float, evidence: float) -> np.ndarray:
    """What a feature tells: the log-likelihood that it adds for a text of P; -1 where it says too little."""
    a, b = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
    gain = a * np.log(a / b)
    pure = prior * in_p * n_u >= PURITY * in_u * n_p
    return np.where((in_p >= 3) & pure & (n_p * gain >= evidence), gain, -1.0)


def shortlist(counted: DataFrame, sample: DataFrame, n_p: int, n_u: int, most: int) -> tuple[list[str], np.ndarray]:
    """The ``most`` n-grams whose share in P exceeds that in a sample of U the most (ties: by their hash), with their counts in P."""
    other = sample.select("gram", *[F.col(c).alias(f"u_{c}") for c in COUNTS])
    both = counted.where("n0 >= 3").join(other, "gram", "left").fillna(0)
    gains = []
    for c in COUNTS:
        a, b = (F.col(c) + 0.5) / (n_p + 1), (F.col(f"u_{c}") + 0.5) / (n_u + 1)
        gains.append(F.when(F.col(c) >= 3, a * F.log(a / b)).otherwise(-1.0))
    rated = both.select("gram", *COUNTS, F.greatest(*gains).alias("gain")).where(F.col("gain") > 0)
    rows = rated.orderBy(F.desc("gain"), F.xxhash64("gram"), "gram").limit(most).collect()  # at most ``most`` rows
    rows.sort(key=lambda r: r["gram"])
    return [r["gram"] for r in rows], np.array([[r[c] for c in COUNTS] for r in rows], np.int64).reshape(len(rows), len(LEVELS))


def one_each(texts: DataFrame) -> DataFrame:
    """One row for each id of a sample (the largest text, null least), however many rows carry it."""
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positives: int = 3000, max_unlabelled: int = 6000, n_features: int = 1200, seed: int = 7, n_candidates: int = 20_000) -> ToxicityModel:
    """Train on all of ``docs`` and ``labels``; the gradient sees at most ``max_positives`` and ``max_unlabelled`` labelled rows.

    The model has at most ``n_features`` features, chosen by exact counts over all documents among ``n_candidates`` n-grams
    that all confirmed texts and the sample of labelled rows tell apart best: both bound the model, not the data.

    ``labels`` holds only rows that may be learned from.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.5, (toxic + 1) / (total + 2))
    nothing = ToxicityModel({}, math.log(prior / (1 - prior)))
    with scratch(docs.sparkSession), settings(docs.sparkSession, WHILE_WRITING):
        labelled = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(slim.select("doc_id").distinct(), "doc_id", "left_semi")
        labelled = materialize(labelled, "labelled-ids")
        confirmed = labelled.where("toxic = 1").select("doc_id")
        if confirmed.isEmpty():
            return nothing
        few = confirmed.count() <= BROADCAST_IDS
        positive = materialize(slim.join(F.broadcast(confirmed) if few else confirmed, "doc_id", "left_semi"), "confirmed")
        chosen = sample_ids(labelled.select("doc_id"), max_unlabelled, seed)
        unlabelled = materialize(one_each(slim.join(F.broadcast(chosen), "doc_id", "left_semi")), "unlabelled")  # at most max_unlabelled ids
        n_p, n_u, n_s = positive.count(), slim.count(), unlabelled.count()
        names, in_p = shortlist(count_grams(positive), count_grams(unlabelled), n_p, n_s, n_candidates)
        if not names:
            return nothing
        gain = _gain(in_p, count_known(slim, names), n_p, n_u, prior, EVIDENCE)
        order = np.lexsort((np.arange(gain.size), -gain.ravel()))[:n_features]
        features = [(names[i // len(LEVELS)], int(i % len(LEVELS))) for i in order if gain.ravel()[i] > 0]
        if not features:
            return nothing
        seen = sample_ids(confirmed, max_positives, seed)
        x_p = feature_rows(one_each(positive.join(F.broadcast(seen), "doc_id", "left_semi")), features)  # at most max_positives ids
        w, bias = nnpu_fit(x_p, feature_rows(unlabelled, features), prior)
    return ToxicityModel({f: float(v) for f, v in zip(features, w, strict=True)}, bias)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most n_features n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        claim_cache(("toxicity", id(judge)), judge.counter.known.clear)
        for batch in slices(batches):
            scores = [judge.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        claim_cache(("toxicity", id(judge)), judge.counter.known.clear)
        for batch in slices(batches):
            yield batch.filter(pa.array([judge.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a model that learned from the labels outside the held-out fold: one row each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
