"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is divided by its norm, rotated by one random orthogonal matrix, and kept as the signs of its
coordinates (packed bits) plus two scalars: its norm and the inner product of the unit vector with its code. A
query is rotated too and rounded to ``planes`` bits a coordinate, so that its inner product with a code is a sum
of popcounts. Dividing by the second scalar makes that an unbiased estimate of the true inner product, and the
scalar also bounds its error. The k best estimates are reranked with exact inner products in double precision, and
then every vector whose upper bound reaches the worst of these.

The index is a stored table: rows are dealt evenly to parts, and a part is one row with the ids, vectors, codes and
scalars of about ``part_rows`` vectors. Queries are dealt to blocks of about ``block_rows``. Every cell of a part and a block is
a row of one join and a piece of one job: it gives the block's k best in that part, and these are merged by query. Exact
copies of a vector share one code: of a group of copies only those with the smallest ids can be found, and only these (2 k at
most) are kept in a part.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components, or of another dimension
than most queries have, take no part, neither as query nor as candidate; rows with a query's own id are no candidates
for it; query rows with equal ids are one query, the one with the smallest vector that takes part; other repeated ids count as often as they occur; with fewer candidates than k all are returned; ties go to
the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.storage import materialize, scratch

#: Half-width of the error bound in standard deviations. At 3 a true neighbour is missed about once in a thousand.
EPSILON = 3.0
#: Tasks of the one job over all cells; with more cells a task takes several.
MAX_TASKS = 100_000


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack_signs(x: np.ndarray) -> np.ndarray:
    """Bits of the positive coordinates in 64-bit words, one row for each row of x."""
    bits = np.packbits(x > 0, axis=1, bitorder="little")
    short = -bits.shape[1] % 8
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, short)))).view(np.uint64)


class BitCodes:
    """Codes and scalars: packed signs, the norm, and the unit vector's inner product with its code."""

    def __init__(self, dim: int, code: np.ndarray, norm: np.ndarray, along: np.ndarray) -> None:
        self.dim, self.code, self.norm, self.along = dim, code, norm, along
        self.words = np.ascontiguousarray(self.code.T)  # a row for each 64 coordinates
        self.ones = np.bitwise_count(self.code).sum(1).astype(np.float32)
        self.spread = np.sqrt(np.maximum(0, 1 - self.along**2)) / self.along / np.sqrt(max(1, self.dim - 1))

    @classmethod
    def build(cls, vectors: np.ndarray, turn: np.ndarray) -> BitCodes:
        """Codes of the rows of ``vectors`` (no zero rows)."""
        norm = np.linalg.norm(vectors, axis=1)
        unit = (vectors / norm[:, None]) @ turn
        return cls(vectors.shape[1], pack_signs(unit), norm, np.abs(unit).sum(1) / np.sqrt(vectors.shape[1]))

    def bounds(self, query: np.ndarray, turn: np.ndarray, planes: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of one query with all rows, and the half-width of the error bound."""
        q = query @ turn
        low, high = q.min(), q.max()
        step = (high - low) / (2**planes - 1) or 1.0
        whole = np.rint((q - low) / step).astype(np.int64)
        weighted = np.zeros(len(self.code), np.int32)
        for b in range(planes):
            plane = pack_signs(((whole >> b) & 1)[None, :])[0]
            for word, mask in zip(self.words, plane, strict=True):
                weighted += np.left_shift(np.bitwise_count(word & mask), b, dtype=np.int32)
        # sum of sign_i * q_i with sign_i = 2 * bit_i - 1 and q_i = low + step * whole_i
        signed = 2 * (step * weighted + low * self.ones) - q_sum(low, step, whole)
        size = np.linalg.norm(query)
        estimate = signed / np.sqrt(self.dim) / self.along * self.norm
        # a coordinate is rounded by at most half a step; the sum of these errors has about this deviation
        rounding = step * np.sqrt(1 / 12) / self.along
        return estimate, EPSILON * self.norm * np.sqrt((self.spread * size) ** 2 + rounding**2)


def q_sum(low: float, step: float, whole: np.ndarray) -> float:
    return float(low * len(whole) + step * whole.sum())


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row summed in the same order whatever stands around it."""
    return (vectors * query).sum(1)


def _clean(ids: pa.Array, vectors: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (float64) of the rows that take part; null components become non-finite ones on the way."""
    fits = pc.and_(ids.is_valid(), pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    kept = vectors.filter(fits)
    out_ids = ids.filter(fits).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.asarray(kept.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(kept), dim)
    fine = np.isfinite(out).all(1) & (out != 0).any(1)
    return out_ids[fine], out[fine]


def _first_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those copies of a vector that no query can find; rising ids.

    Of copies with one id only k can be found, and of what is left a query passes over at most the k that have its own id, so
    2 k copies are enough.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.ravel()

    def place(keys: np.ndarray) -> np.ndarray:
        """How many rows with equal keys stand before each row."""
        by_key = np.lexsort((np.arange(len(keys)), *keys.T))
        starts = np.flatnonzero(np.append(True, (keys[by_key][1:] != keys[by_key][:-1]).any(1)))
        out = np.empty(len(keys), np.int64)
        out[by_key] = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
        return out

    kept = np.flatnonzero(place(np.column_stack([group, ids])) < k)
    kept = kept[place(group[kept][:, None]) < 2 * k]
    return ids[kept], vectors[kept]


def best_of(ids: np.ndarray, vectors: np.ndarray, codes: BitCodes, query_ids: np.ndarray, queries: np.ndarray, k: int, turn: np.ndarray) -> list[tuple[int, int, float]]:
    """(query id, id, inner product) of each query's k best among the rows, found by codes and reranked exactly.

    The rows with the k largest estimates are reranked first; their worst exact product is a floor that every other
    row's upper bound must reach to be reranked too.
    """
    if not len(ids):
        return []
    out, at = [], {}
    for i, own in enumerate(ids.tolist()):
        at.setdefault(own, []).append(i)
    for query_id, query in zip(query_ids.tolist(), queries, strict=True):
        estimate, slack = codes.bounds(query, turn)
        upper = estimate + slack
        own = at.get(query_id, [])
        estimate[own], upper[own] = -np.inf, -np.inf
        n = min(k, len(ids) - len(own))
        if not n:
            continue
        first = np.argpartition(estimate, len(estimate) - n)[len(estimate) - n :]
        floor = exact_products(vectors[first], query).min()
        hopeful = upper >= floor
        hopeful[first] = True
        near = np.flatnonzero(hopeful)
        score = exact_products(vectors[near], query)
        top = np.lexsort((ids[near], -score))[:k]
        out += zip([query_id] * len(top), ids[near[top]].tolist(), score[top].tolist(), strict=True)
    return out


def _gathered(rows: DataFrame, parts: int, dim: int, make, schema: str) -> DataFrame:
    """One row ``make(part, ids, vectors)`` for each part of (vec_id, v), dealt evenly; store it, parts are numbered by their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_clean(b.column(0), b.column(1), dim) for b in batches]
        if sum(len(h[0]) for h in held):
            row = make(TaskContext.get().partitionId(), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            yield pa.RecordBatch.from_pylist([row])

    return rows.repartition(parts).mapInArrow(run, schema)


CODES = "part int, ids binary, vectors binary, code binary, norm binary, along binary"


def build_index(rows: DataFrame, dim: int, k: int, part_rows: int = 16384) -> DataFrame:
    """The stored code table of (vec_id, v): a row for each part, with arrays as bytes."""
    turn = rotation(dim)

    def make(part: int, ids: np.ndarray, vectors: np.ndarray) -> dict:
        ids, vectors = _first_copies(ids, vectors, k)
        codes = BitCodes.build(vectors, turn)
        return {"part": np.int32(part), "ids": ids.tobytes(), "vectors": vectors.tobytes(), "code": codes.code.tobytes(), "norm": codes.norm.tobytes(), "along": codes.along.tobytes()}

    return materialize(_gathered(rows, 1 + rows.count() // part_rows, dim, make, CODES), "codes")


def search(
    rows: DataFrame,
    query_rows: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 2048,
    part_rows: int = 16384,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``rows`` with the largest inner products for each row of ``query_rows``.

    Both tables have ``id_col`` and ``vector_col``. A task holds one part and one block at a time.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = query_rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    common = asked.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None or common["dim"] < 1:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    turn, words = rotation(dim), -(-dim // 64)
    usable = F.expr(f"size(v) = {dim} AND exists(v, x -> x <> 0) AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    asked = asked.where(usable).groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack(block: int, ids: np.ndarray, vectors: np.ndarray) -> dict:
        return {"block": np.int32(block), "query_ids": ids.tobytes(), "queries": vectors.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors, code, norm, along, query_ids, queries = (c[i].as_py() for c in batch.columns)
                read = np.frombuffer
                codes = BitCodes(dim, read(code, np.uint64).reshape(-1, words), read(norm), read(along))
                found = best_of(read(ids, np.int64), read(vectors).reshape(-1, dim), codes, read(query_ids, np.int64), read(queries).reshape(-1, dim), k, turn)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["query_id", "vec_id", "score"])

    with scratch(spark):
        codes = build_index(slim, dim, k, part_rows)
        blocks = materialize(_gathered(asked, 1 + asked.count() // block_rows, dim, pack, "block int, query_ids binary, queries binary"), "queries")
        ends = [t.agg(F.coalesce(F.max(c), F.lit(-1))).first()[0] for t, c in ((codes, "part"), (blocks, "block"))]
        to = lambda last: F.explode(F.sequence(F.lit(0), F.lit(last))) if last >= 0 else F.lit(0)
        cells = codes.withColumn("block", to(ends[1])).join(blocks.withColumn("part", to(ends[0])), ["part", "block"])
        dealt = cells.repartition(max(1, min(MAX_TASKS, (ends[0] + 1) * (ends[1] + 1))))
        found = materialize(dealt.select("ids", "vectors", "code", "norm", "along", "query_ids", "queries").mapInArrow(run, "query_id long, vec_id long, score double"), "found", keep=True)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_ann_bits(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row of ``embeddings`` whose id is divisible by 20, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
