"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the other URLs.

The trees (numpy, histogram splits, logistic loss) are fitted on a bounded sample (``max_training_rows``, a
parameter; those with the smallest hashes of each label) of the different URLs that carry a label. A URL counts as often
as it occurs, and the labels have the shares that they have among all labelled rows. In ``op9_url_trees`` the labels are
what the rules say. Features: lengths, depth, digit ratio, entropy, parameter counts, and suffix statistics (how often
the last host label and the first path part were blocked among all labelled rows, smoothed). For a URL that the trees
are fitted on, these statistics leave out its own fold of FOLDS, so that no label predicts itself. The prior is that of
all labelled rows.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by
the trees on empty features; with no labelled URL, or with one label only, the score is the smoothed share of
``block``; a score of 0.5 or more is ``block``; a URL that many rows share is one training row with their weight; rows without
label are not learned from; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.storage import materialize, scratch, slices

#: The contract's rules as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
FEATURES = ("url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "host_digit_ratio", "entropy", "parameters", "query_length", "fragment", "hyphens", "upper_ratio", "secure", "suffix_blocked", "first_part_blocked")
BINS = 64
#: Labelled URLs, of all there are, from which a part has statistics of its own.
LEAST_SEEN = 5
FOLDS = 5


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path, and what follows the path."""
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host_end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[host_end:]
    path_end = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    host = "".join([chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:host_end]])
    return host, tail[:path_end], tail[path_end:]


def rule_of(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits; of equal ones the first."""
    best: tuple[str, str] | None = None
    for verdict, rule_host, rule_path in rules:
        fits = (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path)
        if fits and (best is None or len(rule_host) + len(rule_path) > len(best[1])):
            best = verdict, rule_host + rule_path
    return best


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def parts_of(host: str, path: str) -> tuple[str, str]:
    """The last host label and the first part of the path: what suffix statistics are kept for."""
    return host.rpartition(".")[2], path.split("/", 2)[1] if path.startswith("/") else ""


def lexical(url: str | None, host: str, path: str, tail: str) -> list[float]:
    """The features that the URL alone gives: all but the two statistics."""
    text = url or ""
    n = max(1, len(text))
    query = tail.split("#", 1)[0]
    return [
        len(text), len(host), len(path), host.count(".") + bool(host), path.count("/"),
        sum(c.isdigit() for c in text) / n, sum(c.isdigit() for c in host) / max(1, len(host)), _entropy(text),
        query.count("=") + query.count("&"), len(query), "#" in tail, text.count("-"), sum(c.isupper() for c in text) / n, text.startswith("https"),
    ]


def fold_of(url: str | None) -> int:
    return xxhash.xxh64_intdigest((url or "").encode(), 9) % FOLDS


PartCounts = dict[str, np.ndarray]


def count_parts(urls: list[str | None], labels: list[int], counts: list[int] | None = None) -> list[PartCounts]:
    """For each of the two kinds of parts: part -> (rows, blocked rows) in each fold."""
    out: list[PartCounts] = [{}, {}]
    for url, label, n in zip(urls, labels, counts or [1] * len(urls), strict=True):
        host, path, _ = split_url(url)
        for table, part in zip(out, parts_of(host, path), strict=True):
            if part not in table:
                table[part] = np.zeros((2, FOLDS))
            table[part][:, fold_of(url)] += n, n * label
    return out


class BoostedTrees:
    """Depth-limited regression trees on binned features, added up in log odds."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, least: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base, self.edges, self.trees = 0.0, [], []

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, label: np.ndarray, share: float, weight: np.ndarray) -> BoostedTrees:
        """``share`` is that of label 1 from which the trees start, ``weight`` what each row counts."""
        self.base = math.log(share / (1 - share))
        if len(np.unique(label)) < 2:
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = self._bins(x)
        log_odds = np.full(len(label), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-log_odds))
            gradient, curve = weight * (label - p), weight * p * (1 - p)
            node = np.zeros(len(label), np.int64)
            tree = []
            for _ in range(self.depth):
                width = 1 << len(tree)
                feature, cut = np.zeros(width, np.int64), np.full(width, BINS + 1)
                best = np.full(width, 1e-9)
                for j in range(x.shape[1]):
                    cell = node * (BINS + 1) + bins[:, j]
                    g = np.bincount(cell, gradient, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    h = np.bincount(cell, curve, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    n = np.bincount(cell, weight, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                    gain[(n < self.least) | (n[:, -1:] - n < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    feature[better], cut[better], best[better] = j, at[better], top[better]
                tree.append((feature, cut))
                node = node * 2 + (bins[np.arange(len(node)), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = np.bincount(node, gradient, leaves) / (np.bincount(node, curve, leaves) + 1) * self.rate
            self.trees.append((tree, value))
            log_odds += value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1."""
        log_odds = np.full(len(x), self.base)
        if self.trees:
            bins = self._bins(x)
            rows = np.arange(len(x))
            for tree, value in self.trees:
                node = np.zeros(len(x), np.int64)
                for feature, cut in tree:
                    node = node * 2 + (bins[rows, feature[node]] > cut[node])
                log_odds += value[node]
        return 1 / (1 + np.exp(-log_odds))


class UrlModel:
    """Suffix statistics and trees, trained from different URLs with a label and a count each; label 1 means block.

    Where these are a sample, ``totals`` (label -> rows) and ``stats`` (as ``count_parts`` gives them) are those of all
    labelled rows.
    """

    def __init__(self, urls: list[str | None], labels: list[int], counts: list[int] | None = None, totals: dict[int, int] | None = None, stats: list[PartCounts] | None = None) -> None:
        counts = counts or [1] * len(urls)
        held = {v: sum(n for n, y in zip(counts, labels, strict=True) if y == v) for v in set(labels)}
        totals = totals or held
        total = sum(totals.values())
        self.prior = (totals.get(1, 0) + 0.5) / (total + 1)
        self.stats = [{k: v for k, v in t.items() if v[0].sum() >= LEAST_SEEN} for t in stats or count_parts(urls, labels, counts)]
        scale = max((labels.count(y) / totals[y] for y in held), default=1.0)  # a URL of the scarcer label counts about 1
        weight = np.array([n * totals[y] / held[y] * scale for n, y in zip(counts, labels, strict=True)], float)
        x = self._matrix(urls, [split_url(u) for u in urls], [fold_of(u) for u in urls])
        self.trees = BoostedTrees().fit(x, np.array(labels, float), self.prior, weight)
        self.stats = [{k: v.sum(1, keepdims=True) for k, v in t.items()} for t in self.stats]

    def _matrix(self, urls: list[str | None], split: list[tuple[str, str, str]], folds: list[int] | None = None) -> np.ndarray:
        """Features of each URL; with ``folds``, a URL's statistics leave its own fold out."""
        rows, nothing = [], np.zeros((2, FOLDS))
        for i, (url, (host, path, tail)) in enumerate(zip(urls, split, strict=True)):
            known = [t.get(p, nothing) for t, p in zip(self.stats, parts_of(host, path), strict=True)]
            sums = [v.sum(1) - (v[:, folds[i]] if folds else 0) for v in known]
            rows.append([*lexical(url, host, path, tail), *[(b + 5 * self.prior) / (n + 5) for n, b in sums]])
        return np.array(rows, float).reshape(len(rows), len(FEATURES))

    def score(self, urls: list[str | None], split: list[tuple[str, str, str]]) -> np.ndarray:
        return self.trees.predict(self._matrix(urls, split))


def labelled_by_rules(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(url, label) of the URLs that a rule fits; label 1 means block."""
    chosen = rules or RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            urls, labels = [], []
            for url in batch.column(0).to_pylist():
                host, path, _ = split_url(url)
                if rule := rule_of(host, path, chosen):
                    urls.append(url)
                    labels.append(int(rule[0] == "block"))
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(labels, pa.int32())], ["url", "label"])

    return pages.select(F.col(url_col).alias("url")).mapInArrow(run, "url string, label int")


def part_statistics(counted: DataFrame) -> list[PartCounts]:
    """``count_parts`` over all rows of (url, label, n); only parts seen often enough come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            found = count_parts(*[c.to_pylist() for c in batch.columns])
            rows = [(kind, part, v[0].tolist(), v[1].tolist()) for kind, table in enumerate(found) for part, v in table.items()]
            kinds, parts, seen, blocked = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(parts, pa.string()), pa.array(seen, pa.list_(pa.float64())), pa.array(blocked, pa.list_(pa.float64()))], ["kind", "part", "n", "blocked"])

    sums = counted.select("url", "label", "n").mapInArrow(run, "kind int, part string, n array<double>, blocked array<double>")
    folds = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(FOLDS)]).alias(c)
    often = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) >= LEAST_SEEN
    out: list[PartCounts] = [{}, {}]
    for r in sums.groupBy("kind", "part").agg(folds("n"), folds("blocked")).where(often).collect():
        out[r["kind"]][r["part"]] = np.array([r["n"], r["blocked"]])
    return out


def train(labelled: DataFrame, max_training_rows: int = 20_000) -> UrlModel:
    """A model of all rows of (url, label), its trees fitted on at most ``max_training_rows`` different URLs of them.

    These are at most half for each label, those with the smallest hashes. Only URLs whose hash lies below a bound that
    about 1.2 times as many meet come to the driver.
    """
    urls: list[str | None] = []
    labels: list[int] = []
    counts: list[int] = []
    most = max_training_rows // 2
    with scratch(labelled.sparkSession):
        counted = materialize(labelled.where("label IS NOT NULL").groupBy("url", "label").agg(F.count(F.lit(1)).alias("n")), "labelled-urls")
        sizes = {r["label"]: (r["rows"], r["urls"]) for r in counted.groupBy("label").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("urls")).collect()}
        hashed = counted.select("url", "label", "n", F.xxhash64("url").alias("h"))
        for label in (0, 1):
            bound = 1.2 * most / max(1, sizes.get(label, (0, 0))[1])
            near = hashed.where((F.col("label") == label) & (F.lit(bound >= 1) | (F.abs(F.col("h") / 2.0**63) < bound)))
            rows = sorted(near.select("h", "url", "n").collect(), key=lambda r: (r["h"], r["url"] or ""))[:most]
            urls += [r["url"] for r in rows]
            labels += [label] * len(rows)
            counts += [r["n"] for r in rows]
        return UrlModel(urls, labels, counts, {v: n for v, (n, _) in sizes.items()}, part_statistics(counted))


def judge_urls(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of every URL; a rule's verdict stands."""
    chosen = rules or RULES
    shared = pages.sparkSession.sparkContext.broadcast(model)  # grows with the parts that are seen often enough
    names = ["page_id", "host", "path", "rule", "verdict", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in slices(batches, 4096):
            urls = batch.column(1).to_pylist()
            split = [split_url(u) for u in urls]
            found = [rule_of(h, p, chosen) for h, p, _ in split]
            scores = judge.score(urls, split)
            verdicts = [f[0] if f else ("block" if s >= 0.5 else "allow") for f, s in zip(found, scores, strict=True)]
            columns = [pa.array([h for h, _, _ in split], pa.string()), pa.array([p for _, p, _ in split], pa.string()), pa.array([f[1] if f else None for f in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return slim.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def op9_url_trees(spark, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by trees trained from what the rules say: one row each."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, train(labelled_by_rules(pages)))
