"""Source divergence audit: how far the word use of each source lies from the other sources of its language.

1. A count-min sketch of document frequencies of (lang, term) is filled by every task and merged. Its cells stop at
   ``min_docs``: a term whose smallest cell lies below that can't be in so many documents, and no frequency is ever
   underestimated. The merged sketch is a fixed number of cells (``SKETCH_BYTES`` of packed bits go to the tasks), so what is
   broadcast does not grow; on a corpus with very many terms it discards less, never more.
2. Terms that the sketch rules out are discarded before anything is shuffled; of the others (lang, source, term) is counted
   exactly, with sums in the tasks, and those below ``min_docs`` by the exact count go then.
3. Pairs of sources are compared sparsely. The score of a pair over all V kept terms is a base for terms that neither has, a
   correction from each source's histogram of counts, and a correction for each term that both have, from a join on the
   term whose output is summed where it arises.

All arithmetic is exact: whole numbers, decimals where a product could pass 63 bits.

Defined cases: null text, lang and source are ''; every row is a document, also one that repeats; a text without terms gives
its group a row in the result if there is another source; a lang without kept terms has V = 0 and pairs of value 0; ties go
to the smaller item by UTF-8 bytes; long texts and long terms are counted whole (a task hands its sums on by number and by
bytes); other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.line_dedup import mix
from tallyframe.llm.storage import WHILE_WRITING, claim_cache, materialize, scratch, settings, slices

ROWS, WIDTH = 3, 1 << 22
#: Packed bits of the merged sketch.
SKETCH_BYTES = ROWS * WIDTH // 8
#: Cells of a piece of the sketch, the unit in which it is merged.
PIECE = 1 << 14
#: Terms, and bytes of text, that a task sums up before it hands on.
HELD, HELD_BYTES = 800_000, 48 << 20
#: A document in a sum of occurrences; a task hands on long before it has seen so many occurrences.
DOC = 1 << 40
SCALE = 1_000_000_000
SALTS = 16

#: ASCII but for letters becomes a blank, A-Z lower case; all other code points stand for themselves.
TO_TERMS = bytes([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)])


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(TO_TERMS).split()


def cells(lang: str, names: list[bytes]) -> np.ndarray:
    """Places of the terms of one language, in each row of the sketch."""
    seed = xxhash.xxh32_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in names), np.uint64, len(names))
    return np.stack([(mix(h, r) % np.uint64(WIDTH)).astype(np.int64) + r * WIDTH for r in range(ROWS)])


def add_capped(sketch: np.ndarray, at: np.ndarray, n: np.ndarray, most: int) -> None:
    """Add n[i] to cell at[i]; no cell passes ``most``."""
    order = np.argsort(at, kind="stable")
    places, starts = np.unique(at[order], return_index=True)
    sums = np.add.reduceat(np.minimum(n, most)[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    sketch[places] = np.minimum(most, sketch[places] + sums).astype(np.uint8)


def _pieces(sketch: np.ndarray) -> pa.RecordBatch:
    held = [(i, p.tobytes()) for i, p in enumerate(sketch.reshape(-1, PIECE)) if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(held), pa.int64()), pa.array([i for i, _ in held], pa.int32()), pa.array([b for _, b in held], pa.binary())], ["task", "piece", "cells"])


PIECES = "task long, piece int, cells binary"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[str, str], dict[bytes, int]]]:
    """Occurrences, and documents times DOC, of each term by (lang, source) of (text, lang, source), handed on by number and bytes."""
    groups: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)
    size = 0
    for batch in slices(batches):
        for text, lang, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            sums = groups[lang, source]
            get = sums.get
            for term, n in Counter(terms(text)).items():
                sums[term] = get(term, 0) + n + DOC
            size += len(text or "")
            if size > HELD_BYTES:
                yield groups
                groups.clear()
                size = 0
        if sum(map(len, groups.values())) > HELD:
            yield groups
            groups.clear()
            size = 0
    if groups:
        yield groups


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Counter[bytes]]]:
    """Documents of each term by lang of (text, lang), handed on likewise."""
    groups: dict[str, Counter[bytes]] = defaultdict(Counter)
    size = 0
    for batch in slices(batches):
        for text, lang in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            groups[lang].update(set(terms(text)))
            size += len(text or "")
            if size > HELD_BYTES:
                yield groups
                groups.clear()
                size = 0
        if sum(map(len, groups.values())) > HELD:
            yield groups
            groups.clear()
            size = 0
    if groups:
        yield groups


def build_sketch(texts: DataFrame, min_docs: int) -> np.ndarray:
    """Whether each cell reaches ``min_docs``, over all of (text, lang, source), as packed bits."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("divergence", dict)
        sketch = np.zeros(ROWS * WIDTH, np.uint8)
        for groups in _documents(batches):
            for lang, docs in groups.items():
                at, n = cells(lang, list(docs)), np.fromiter(docs.values(), np.int64, len(docs))
                for row in at:
                    add_capped(sketch, row, n, min_docs)
        yield _pieces(sketch)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # at most the whole sketch
        for batch in batches:
            for piece, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                new = np.frombuffer(raw.as_buffer(), np.uint8)
                held[piece] = np.minimum(held[piece] + new, min_docs).astype(np.uint8) if piece in held else new.copy()
        for piece, got in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([piece], pa.int32()), pa.array([got.tobytes()], pa.binary())], ["task", "piece", "cells"])

    tasks = texts.select("text", "lang").mapInArrow(fill, PIECES)
    some = tasks.repartition("piece", (F.col("task") % 64)).mapInArrow(merge, PIECES)  # no task merges all tasks' pieces
    bits = np.zeros(SKETCH_BYTES, np.uint8)
    for r in some.repartition("piece").mapInArrow(merge, PIECES).collect():  # at most ROWS * WIDTH cells
        full = np.packbits(np.frombuffer(bytes(r["cells"]), np.uint8) >= min_docs)
        bits[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = full
    return bits


def count_survivors(texts: DataFrame, sketch: np.ndarray) -> DataFrame:
    """lang, source, term, n, docs: exact sums of the terms that the sketch doesn't rule out."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)  # SKETCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("divergence", dict)
        bits = shared.value
        for groups in _counted(batches):
            for (lang, source), sums in groups.items():
                names = list(sums)
                may = np.ones(len(names), bool)
                for row in cells(lang, names):
                    may &= bits[row >> 3] >> (7 - (row & 7)).astype(np.uint8) & 1 == 1
                kept = [names[i] for i in np.flatnonzero(may)]
                if kept:
                    columns = [pa.array([lang] * len(kept), pa.string()), pa.array([source] * len(kept), pa.string()), pa.array([k.decode() for k in kept], pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([sums[k] % DOC for k in kept], pa.int64()), pa.array([sums[k] // DOC for k in kept], pa.int64())], ["lang", "source", "term", "n", "docs"])

    partial = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _with_p(df: DataFrame, name: str, count: Column, total: Column, kinds: Column) -> DataFrame:
    """Adds 1 + floor(SCALE * (count + 1) / (total + kinds)), exactly; a lang without kept terms asks nothing of it."""
    share = F.expr(f"(cast(_c + 1 AS decimal(20, 0)) * cast({SCALE} AS decimal(10, 0))) div cast(_t AS decimal(20, 0))")
    return df.withColumn("_c", count).withColumn("_t", F.greatest(total + kinds, F.lit(1))).withColumn(name, (share + 1).cast("long")).drop("_c", "_t")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the lang (part ``pair``), and the ``top_terms`` terms that the
    source uses most beyond its lang (part ``term``)."""
    if not 1 <= min_docs <= 127:
        raise ValueError("min_docs must be from 1 to 127: two cells of the sketch are added in 8 bits")
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    texts = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    with scratch(spark), settings(spark, WHILE_WRITING):
        counted = count_survivors(texts, build_sketch(texts, min_docs))
        one = Window.partitionBy("lang", "term")  # at most a row for each source
        known = counted.withColumn("all_docs", F.sum("docs").over(one)).withColumn("lang_n", F.sum("n").over(one)).withColumn("first", (F.min("source").over(one) == F.col("source")).cast("long"))
        kept = materialize(known.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"), "kept-terms")
        totals = kept.groupBy("lang").agg(F.sum("first").alias("V"), F.sum("n").alias("lang_total"))
        own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))
        groups = texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(totals, "lang", "left").fillna(0)
        groups = materialize(_with_p(groups, "p0", F.lit(0), F.col("own_total"), F.col("V")), "groups")
        rated = _with_p(kept.join(groups, ["lang", "source"]), "p", F.col("n"), F.col("own_total"), F.col("V"))
        rated = materialize(_with_p(rated, "q", F.col("lang_n"), F.col("lang_total"), F.col("V")).select("lang", "source", "term", "p", "q", "p0"), "rated-terms")

        # (a, b): a's p against b's
        salt = F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")
        left = groups.select("lang", "source", "V", F.col("p0").alias("a0")).withColumn("salt", salt)
        right = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = left.join(right, ["lang", "salt"]).where("source <> item")
        base = pairs.select("lang", "source", "item", F.expr(f"V * {_f('a0', 'b0')}").alias("value"))
        histogram = rated.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k")).withColumn("salt", salt)
        other = right.withColumnsRenamed({"item": "other", "b0": "o0"})
        alone = histogram.join(other, ["lang", "salt"]).where("source <> other")
        as_a = alone.select("lang", "source", F.col("other").alias("item"), F.expr(f"k * ({_f('p', 'o0')} - {_f('p0', 'o0')})").alias("value"))
        as_b = alone.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.expr(f"k * ({_f('o0', 'p')} - {_f('o0', 'p0')})").alias("value"))
        a = rated.select("lang", "term", "source", "p", F.col("p0").alias("a0"))
        b = rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("p0").alias("b0"))
        shared = a.join(b, ["lang", "term"]).where("source <> item")
        both = shared.select("lang", "source", "item", F.expr(f"{_f('p', 'r')} - {_f('p', 'b0')} - {_f('a0', 'r')} + {_f('a0', 'b0')}").alias("value"))
        keys = ["lang", "source", "item"]
        sums = [c.groupBy(*keys).agg(F.sum("value").alias("value")) for c in (as_a, as_b, both)]
        valued = base.unionByName(sums[0]).unionByName(sums[1]).unionByName(sums[2]).groupBy(*keys).agg(F.sum("value").alias("value"))
        place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pair_part = valued.withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("pair"))
        above = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
        term_part = above.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
        names = ["lang", "source", "part", "item", "value", "rank"]
        return materialize(pair_part.select(names).unionByName(term_part.select(names)), "divergence", keep=True)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every lang against the others, and the terms that set it apart."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
n AS (SELECT row_number() OVER () AS i, lang, source, regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM d),
w AS (SELECT i, lang, source, translate(unnest(found), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM n),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
