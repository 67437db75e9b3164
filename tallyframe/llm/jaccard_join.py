"""N-gram Jaccard join: size-aware, with light and heavy sets, and classes of linked documents.

Every document becomes a set of shingles (64-bit hashes of n words). Two sets link when
``den * |A and B| >= num * |A or B|``. Equal sets are one node, known by a 64-bit hash of the whole set.

- Light sets (few shingles) enumerate the subsets of the fixed size that both sets of a pair must share; sets that
  share a subset meet in its inverted list.
- Heavy sets are looked up in inverted lists. Middling ones (up to ``MIDDLE`` shingles) enter the lists of single
  shingles: of the first ones in a fixed random order, as many as it takes for sets that link to share three lists.
- For larger ones, a list of a single shingle would hold every document with a widely shared passage, so a list's key
  is a part: shingles are dealt to ``m`` parts by hash, where sets in the same size class that link differ in fewer
  than ``m`` shingles, so that parts are equal. There are more parts than that needs: ``spare`` ones, as many of which a
  set may leave out for holding too few shingles to say much (a set that has more of these enters them all), and
  ``extra`` ones, so that sets that link share at least ``1 + extra`` lists; sets that share fewer can't link.
- The boundary between light and heavy is where enumerating costs more rows than parts do (``light_limit``).

What meets in enough lists is only a candidate; every link is verified on the whole sets. Members of short lists
meet pair by pair, and their shared lists are counted before any set is read. Members of long lists (a pair that
shares one is left to it) are first verified against the smallest member of most of their lists, since components
do not need all links. Long lists whose members then still belong to several components are open. Open lists that
overlap closely are put together into one cluster where that costs less than going through each of them. Members
of a cluster or list are verified in blocks of ``BLOCK_BYTES`` whose intersections are counted at once and of which
only a spanning forest is returned. So no link between different texts is lost and no group is expanded into all its
pairs.

With links counted, no label settles a list or cluster beforehand: every pair of its members is verified, in blocks that
return a forest and a sum for each member. A pair is counted in one place only: in its cluster, or else in the first of
the long lists that it shares, or else, when it shares none, among the pairs of short lists.

Sets are made from the texts again and again: for their keys, for their lists in each of ``LIST_PASSES`` passes, and for those
that verification needs. Only the last are stored, since all of them take more disk than the texts; entries of all lists take
more than twice as much, so that a pass shuffles those of its lists only. A list that many sets of a task enter is hot: its entries are dealt by set, too, and
a mark goes to the list itself, so that its other members learn of it; hot lists are counted with partial aggregates.

Defined cases: words are runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; with fewer words than n the
whole sequence is one shingle; null or empty texts, or texts without words, have an empty set and link with
nothing; rows without id, or with equal ids, are documents like others: they link and connect, and component_id is the
smallest id there is (null where no row of a class has one); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import combinations
from math import ceil, comb, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyframe.llm.components import connected_components, spanning_forest
from tallyframe.llm.line_dedup import mix
from tallyframe.llm.storage import claim_cache, materialize, scratch, slices

CACHED = 250_000
#: Rows that a part costs, in rows that a subset costs: its list is longer and is scanned.
SCAN_COST = 4
SHORT_LIST = 16
#: Bytes that a row of a counted block takes besides its set; bounds a block's rows, and with them its matrix of pairs.
ROW_BYTES = 1024
#: A counted cluster is gone through as a whole if its pairs are at most so many times those of its lists.
TIGHT = 4
MIDDLE, MIDDLE_NEED = 64, 3
BLOCK_BYTES = 2 << 20
COLUMNS = 8192
BROADCAST_IDS = 500_000
#: Pairs are verified in so many passes at most; what is on disk for a pass goes before the next.
PASSES = 8
SALTS = 16
#: Entries of lists are shuffled in so many passes, by list; those of a pass go before the next. Each makes all sets again.
LIST_PASSES = 2
#: A list is hot in a task from HOT entries on; they are counted in COUNTERS places by hash and dealt over HOT_SALTS.
HOT, COUNTERS, HOT_SALTS = 64, 1 << 18, 1024
#: Above the shared lists that any link needs.
NEEDS = 1 << 20


class _WordHashes(dict):
    """Word -> 64-bit hash, bounded: words of up to 64 bytes are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = h
        return h


_WORDS = _WordHashes()


def shingle_set(raw: bytes | None, n: int) -> np.ndarray:
    """Distinct hashes of the text's n-word shingles, rising."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
    return np.unique(mix(out, 3))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    h = xxhash.xxh64_intdigest(shingles.tobytes(), 5)
    return h - (1 << 64) if h >> 63 else h


@dataclass(frozen=True)
class Scheme:
    """How sets of each size give list keys, for links at ``num / den``."""

    num: int
    den: int

    def partner_max(self, size: int) -> int:
        """The largest set that can link with one of ``size``."""
        return size * self.den // self.num

    def overlap(self, larger: int) -> int:
        """What a link with a set of ``larger`` shingles shares at least."""
        return -(-self.num * larger // self.den)

    def subsets(self, size: int) -> list[int]:
        """The subset sizes that a light set enumerates: what links as the smaller or as the larger set must share."""
        return sorted({self.overlap(b) for b in range(size, self.partner_max(size) + 1) if self.overlap(b) <= size})

    def differ(self, largest: int) -> int:
        """The most shingles in which linked sets of at most ``largest`` shingles differ."""
        return 2 * largest * (self.den - self.num) // (self.den + self.num)

    @property
    def light_limit(self) -> int:
        return _light_limit(self)

    def classes(self, size: int) -> list[tuple[int, int, int, int, int]]:
        """(class, parts, spare, extra, least) for which a set gives parts: its own size class, and the next if it can link into it."""
        return _classes(self, size)


@cache
def _light_limit(scheme: Scheme) -> int:
    """The largest size up to which enumerating subsets is cheaper than parts with their list scans."""
    size = 1
    while sum(comb(size + 1, c) for c in scheme.subsets(size + 1)) <= SCAN_COST * 2 * (scheme.differ(size + 1) + 1):
        size += 1
    return size


@cache
def _class_starts(scheme: Scheme, up_to: int) -> list[int]:
    starts = [max(scheme.light_limit, MIDDLE) + 1]
    while starts[-1] <= up_to:
        starts.append(scheme.partner_max(starts[-1]) + 1)
    return starts


@cache
def _classes(scheme: Scheme, size: int) -> list[tuple[int, int, int, int, int]]:
    starts = _class_starts(scheme, 1 << (scheme.partner_max(size) + 1).bit_length())
    out = []
    for k, start in enumerate(starts[:-1]):
        end = starts[k + 1] - 1
        if scheme.partner_max(size) >= start and size <= end:
            smallest = scheme.overlap(start)
            differ = scheme.differ(end)
            extra = differ // 8
            most = 1 + (differ + 1 + extra) // 3
            for least in (3, 2, 1):  # the shingles below which a part is left out, as many as parts of this size allow
                spare = 1
                for _ in range(20):
                    mean = smallest / (differ + 1 + extra + spare)
                    weak = (differ + 1 + extra + spare) * exp(-mean) * sum(mean**i / factorial(i) for i in range(least))
                    spare = min(most, 1 + ceil(weak + 4 * sqrt(weak)))
                if spare < most // 2:
                    break
            out.append((k, differ + 1 + extra + spare, spare, extra, least))
    return out


def list_keys(shingles: np.ndarray, scheme: Scheme) -> list[tuple[int, np.ndarray]]:
    """(shared lists that a link needs, keys of the inverted lists in which a set is entered)."""
    size, out = len(shingles), []
    with np.errstate(over="ignore"):
        spread = mix(shingles, 17)
        if size <= scheme.light_limit:
            total, keys = spread.sum(), []
            for c in scheme.subsets(size):
                away = [total - sum((spread[i] for i in left), np.uint64(0)) for left in combinations(range(size), size - c)]
                keys.append(mix(np.array(away, np.uint64), 1000 + c))
            out.append((1, np.unique(np.concatenate(keys))))
        if size <= MIDDLE and scheme.partner_max(size) > scheme.light_limit:
            order = np.sort(mix(shingles, 77))
            out.append((MIDDLE_NEED, mix(order[: size - scheme.overlap(size) + MIDDLE_NEED], 3000)))
        for k, parts, spare, extra, least in scheme.classes(size):
            part = (mix(shingles, 31 + k) % np.uint64(parts)).astype(np.int64)
            held = np.bincount(part, minlength=parts)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, spread)
            weak = held < least
            chosen = np.flatnonzero(~weak) if weak.sum() <= spare else np.arange(parts)
            out.append((1 + extra, mix(sums[chosen] + chosen.astype(np.uint64), 2000 + k)))
    return out


def links(a: np.ndarray, b: np.ndarray, scheme: Scheme) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return scheme.den * shared >= scheme.num * (len(a) + len(b) - shared) and shared > 0


def linked_forest(ids: list[int], sets: list[np.ndarray], groups: list[int], scheme: Scheme) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets (groups: what is known to be connected already)."""
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[place] > 1
    number = np.cumsum(count > 1) - 1
    row, column = owner[shared], number[place[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):  # so many shared shingles at a time
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[row[a:b], column[a:b] - first] = 1
        both += table @ table.T
    near = scheme.den * both >= scheme.num * (sizes[:, None] + sizes[None, :] - both) - 1e-3
    x, y = np.nonzero(np.triu(near & (both > 0), 1))
    labels = np.array(groups, np.int64)
    other = labels[x] != labels[y]
    return [(ids[i], ids[j]) for i, j in _forest_pairs(x[other], y[other], labels)]


def _forest_pairs(x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join trees, when members of a label are one tree from the start."""
    parent = {int(v): int(v) for v in np.unique(labels)}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = root(int(labels[i])), root(int(labels[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of the left sets shares with each of the right ones."""
    sizes = [np.array([len(v) for v in side], np.int64) for side in (left, right)]
    values, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *left, *right]), return_inverse=True)
    places = place[: sizes[0].sum()], place[sizes[0].sum() :]
    held = [np.bincount(at, minlength=len(values)) > 0 for at in places]
    common = held[0] & held[1]
    number = np.cumsum(common) - 1
    owners = [np.repeat(np.arange(len(n)), n) for n in sizes]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(common.sum()), COLUMNS):  # so many shared values at a time
        tables = []
        for side, at, owner in zip((left, right), places, owners, strict=True):
            inside = common[at] & (number[at] >= first) & (number[at] < first + COLUMNS)
            table = np.zeros((len(side), COLUMNS), np.float32)
            table[owner[inside], number[at[inside]] - first] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.float64)


def counted_links(left: list[tuple], right: list[tuple] | None, here: int, scheme: Scheme) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """A forest of the links between two blocks (right None: in one block), and for each key the copies it links with.

    Rows are (key, copies, set, lists). Pairs that share a list smaller than ``here`` are counted there, not here.
    """
    own = right is None
    right = left if own else right
    both = shared_counts([r[2] for r in left], [r[2] for r in right])
    sizes = [np.array([len(r[2]) for r in side], float) for side in (left, right)]
    near = (both > 0) & (scheme.den * both >= scheme.num * (sizes[0][:, None] + sizes[1][None, :] - both))
    if own:
        np.fill_diagonal(near, False)
    x, y = np.nonzero(np.triu(near) if own else near)
    keys = [r[0] for r in left] + ([] if own else [r[0] for r in right])
    shift = 0 if own else len(left)
    forest = [(keys[i], keys[j]) for i, j in _forest_pairs(x, y + shift, np.arange(len(keys)))]
    before = [[r[3][r[3] < here].view(np.uint64) for r in side] for side in (left, right)]
    near &= shared_counts(*before) == 0
    copies = [np.array([r[1] for r in side], np.int64) for side in (left, right)]
    sums = dict(zip([r[0] for r in left], (near @ copies[1]).tolist(), strict=True))
    if not own:
        sums |= dict(zip([r[0] for r in right], (near.T @ copies[0]).tolist(), strict=True))
    return forest, {k: v for k, v in sums.items() if v}


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))


def _keyed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int | None]]]:
    """A few hundred rows of ``_texts`` at a time, their sets, and the sets' keys (None for an empty set)."""
    claim_cache("shingles", _WORDS.clear)
    for batch in slices(batches, 256):
        sets = [shingle_set(r, n) for r in batch.column(1).to_pylist()]
        yield batch, sets, [set_key(s) if len(s) else None for s in sets]


def document_sets(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, key) of every row; key is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, keys in _keyed(batches, n):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "key"])

    return texts.mapInArrow(run, "doc_id long, n_shingles long, key long")


def inverted_lists(texts: DataFrame, n: int, scheme: Scheme) -> DataFrame:
    """(list, key, need, low, members): entries of all lists with two different sets or more.

    low is the smallest key of the list; need is how many lists two sets of it must share to link.
    """
    parts = [materialize(_rated_entries(texts, n, scheme, turn), "lists") for turn in range(LIST_PASSES)]
    stored = reduce(DataFrame.unionByName, parts)
    hot = materialize(stored.where("hot").select("list", "key", "need").dropDuplicates(["list", "key"]), "hot-entries")
    sums = materialize(hot.groupBy("list").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("members")).where("members > 1"), "hot-lists")
    joined = materialize(hot.join(_small(sums), "list").select("list", "key", "need", "low", "members"), "hot-lists")
    return stored.where("NOT hot").drop("hot").unionByName(joined)


def _rated_entries(texts: DataFrame, n: int, scheme: Scheme, turn: int) -> DataFrame:
    """(list, key, need, low, members, hot): entries of the lists of one pass that have other members or are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts, total = np.zeros(COUNTERS, np.int64), 0
        for _, sets, own_keys in _keyed(batches, n):
            lists, keys, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for key, shingles in zip(own_keys, sets, strict=True):
                if key is None or key in seen:
                    continue
                seen.add(key)
                if len(seen) > CACHED:
                    seen.clear()
                for need, own in list_keys(shingles, scheme):
                    lists.append(own)
                    keys.append(np.full(len(own), key, np.int64))
                    needs.append(np.full(len(own), need, np.int32))
            place, key, need = np.concatenate(lists), np.concatenate(keys), np.concatenate(needs)
            own = (place >> np.uint64(32)) % np.uint64(LIST_PASSES) == turn
            place, key, need = place[own], key[own], need[own]
            at = (place % np.uint64(COUNTERS)).astype(np.int64)
            counts += np.bincount(at, minlength=COUNTERS)
            total += len(at)
            hot = counts[at] >= HOT + 4 * total // COUNTERS
            salt = np.where(hot, 1 + (mix(key.view(np.uint64), 5) % np.uint64(HOT_SALTS)).astype(np.int32), 0).astype(np.int32)
            _, first = np.unique(place[hot], return_index=True)
            marks = np.flatnonzero(hot)[first]
            columns = [pa.array(np.concatenate([place, place[marks]]).view(np.int64)), pa.concat_arrays([pa.array(key), pa.nulls(len(marks), pa.int64())])]
            columns += [pa.array(np.concatenate([salt * NEEDS + need, need[marks]]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["list", "key", "salted"])

    entries = texts.mapInArrow(run, "list long, key long, salted int")  # salt and need in one column: this is what is shuffled
    whole = Window.partitionBy("list", "salted")
    rated = entries.repartition("list", "salted").dropDuplicates(["list", "salted", "key"]).withColumns({"salt": F.expr(f"salted DIV {NEEDS}"), "need": F.expr(f"salted % {NEEDS}").cast("int")}).withColumns({"low": F.min("key").over(whole), "members": F.count("key").over(whole), "marked": F.count(F.lit(1)).over(whole)})
    rated = rated.withColumn("hot", F.expr("salt > 0 OR marked > members")).where("key IS NOT NULL AND (members > 1 OR hot)")
    return rated.select("list", "key", "need", "low", "members", "hot")


def counted_pairs(short: DataFrame) -> DataFrame:
    """(a, b), a > b: pairs that share as many short lists as a link needs."""
    groups = short.groupBy("list", "need").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    heads = groups.select("need", "keys", F.posexplode("keys").alias("at", "b"))
    met = heads.select("need", "b", F.explode(F.slice("keys", F.col("at") + 2, F.size("keys"))).alias("a"))
    return met.groupBy("a", "b", "need").count().where("count >= need").select("a", "b").distinct()


def wanted_sets(texts: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the wanted keys, one row each. Sets are made again; only those that a table of bits lets pass are stored.

    Neither step shuffles a set: the bits (``BROADCAST_IDS`` words at most) let few unwanted keys pass, and of the rows that
    are stored, which have numbers of their own, one of each wanted key is marked by a bit.
    """
    keys = materialize(wanted.select("key").distinct(), "wanted")
    size = 64 * max(1, min(BROADCAST_IDS, keys.count() // 4))
    words = _bit_words(keys.select(F.pmod("key", F.lit(size)).alias("at"))).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 40, set()
        for _, sets, own_keys in _keyed(batches, n):
            kept = []
            for key, shingles in zip(own_keys, sets, strict=True):
                if key is not None and key not in seen and int(bits[key % size // 64]) >> (key % size % 64) & 1:
                    seen.add(key)
                    kept.append((key, shingles.tobytes()))
            if len(seen) > CACHED:
                seen.clear()
            rows = pa.array(np.arange(row, row + len(kept)))
            row += len(kept)
            yield pa.RecordBatch.from_arrays([rows, pa.array([k for k, _ in kept], pa.int64()), pa.array([r for _, r in kept], pa.binary())], ["row", "key", "shingles"])

    stored = materialize(texts.mapInArrow(run, "row long, key long, shingles binary"), "sets")
    first = stored.select("row", "key").join(keys, "key").groupBy("key").agg(F.min("row").alias("at"))
    marks = materialize(_bit_words(first), "set-rows")
    marked = stored.withColumn("word", F.expr("row DIV 64")).join(_small(marks), "word")
    return marked.where(F.expr("getbit(bits, CAST(row % 64 AS INT)) = 1")).select("key", "shingles")


def _bit_words(places: DataFrame) -> DataFrame:
    """(word, bits): bit at % 64 of word at DIV 64 is set for every ``at``."""
    return places.groupBy(F.expr("at DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` (a stored table of ids), to be broadcast if its size allows; else it is joined over a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _among(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``sets`` whose key is wanted (distinct keys) and, where these are too many to be broadcast, the few others that a table of bits lets pass."""
    keys = materialize(wanted, "among")
    if keys.count() <= BROADCAST_IDS:
        return sets.join(F.broadcast(keys), "key", "left_semi")
    place = F.pmod("key", F.lit(64 * max(1, BROADCAST_IDS)))
    words = materialize(_bit_words(keys.select(place.alias("at"))), "among")
    marked = sets.withColumn("at", place).withColumn("word", F.expr("at DIV 64")).join(F.broadcast(words), "word")
    return marked.where(F.expr("getbit(bits, CAST(at % 64 AS INT)) = 1")).select(sets.columns)


def verified(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Those of (a, b), a stored table, that link. The sets of a travel to those of b once; many pairs do so in passes, by a, one after another."""
    passes = max(1, min(PASSES, -(-pairs.count() // max(1, BROADCAST_IDS))))
    if passes > 1:
        parts = [materialize(_verified(materialize(pairs.where(F.pmod("a", F.lit(passes)) == i), "pass"), sets, scheme), "verified") for i in range(passes)]
        return reduce(DataFrame.unionByName, parts)
    return _verified(pairs, sets, scheme)


def _verified(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hit = pa.array([links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), scheme) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], ["a", "b"])

    heads = sets if pairs.count() <= BROADCAST_IDS else _among(sets, pairs.select(F.col("a").alias("key")).distinct())
    left = heads.select(F.col("key").alias("a"), F.col("shingles").alias("sa")).join(_small(pairs), "a")
    right = _among(sets, pairs.select(F.col("b").alias("key")).distinct()).select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    return left.join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _open_members(long: DataFrame, stars: DataFrame, labels: DataFrame) -> DataFrame:
    """(list, key, label): members of open lists, with closely overlapping lists put together into clusters.

    ``stars`` are the distinct (key, smallest member) pairs of the lists; they connect the same keys as the lists do. A
    cluster whose members all have one label is done. Where going through a cluster's pairs costs less than going
    through its lists' pairs, the cluster stands for its lists, and no list entry is read again.
    """
    clusters = connected_components(stars).select(F.col("node").alias("key"), F.col("label").alias("cluster"))
    per_key = long.groupBy("key").agg(F.sum("members").alias("pairs"))
    known = labels.select(F.col("node").alias("key"), "label")
    named = materialize(per_key.join(clusters, "key").join(known, "key", "left").select("key", "cluster", "pairs", F.coalesce("label", "key").alias("label")), "clusters")
    sized = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("pairs").alias("pairs"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    sized = sized.select("cluster", (F.col("n") * F.col("n") <= 4 * F.col("pairs")).alias("tight"))
    members = materialize(named.join(sized, "cluster").select("cluster", "tight", "key", "label"), "members")
    entries = long.select("list", "key").join(members.where("NOT tight").select("key", "label"), "key")
    several = entries.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("list")
    return members.where("tight").select(F.col("cluster").alias("list"), "key", "label").unionByName(entries.join(several, "list", "left_semi"))


def _dealt_blocks(entries: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """The entries of each list, dealt by a hash of their keys to blocks of about ``BLOCK_BYTES``; once for each block that theirs meets: x <= y."""
    sized = materialize(entries.join(sets.select("key", F.length("shingles").alias("bytes")), "key"), "entries")
    dealt = sized.groupBy(by).agg(F.ceil(F.sum(F.col("bytes") + F.lit(ROW_BYTES)) / F.lit(BLOCK_BYTES)).alias("blocks")).where("blocks > 1")
    blocked = sized.drop("bytes").join(_small(materialize(dealt, "blocks")), by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    met = blocked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("blocks", "other")


def _block_links(entries: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Links between components in long lists: every two blocks of a list meet in one group of bounded bytes."""

    def run(batch: pa.Table) -> pa.Table:
        rows = sorted({(k, g, s) for k, g, s in zip(batch.column("key").to_pylist(), batch.column("label").to_pylist(), batch.column("shingles").to_pylist(), strict=True)})
        found = linked_forest([r[0] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows], [r[1] for r in rows], scheme)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    entries = materialize(entries, "open-members")
    sets = _among(sets, entries.select("key").distinct())
    met = _dealt_blocks(entries, sets, ["list"]).select("list", "x", "y", "key", "label")
    return met.join(sets, "key").groupBy("list", "x", "y").applyInArrow(run, "a long, b long")


def link_components(texts: DataFrame, n: int, scheme: Scheme) -> DataFrame:
    """(node, label) of the sets of ``_texts`` that link with another set."""
    lists = inverted_lists(texts, n, scheme)
    pairs = materialize(counted_pairs(lists.where(F.col("members") <= SHORT_LIST)), "pairs")
    long = lists.where(F.col("members") > SHORT_LIST)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    sets = wanted_sets(texts, n, ends.unionByName(long.select("key")))
    votes = materialize(long.where("key <> low").groupBy(F.col("key").alias("a"), F.col("low").alias("b")).count(), "votes")
    first = votes.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    tested = materialize(pairs.unionByName(first).distinct(), "pairs")
    sure = materialize(verified(tested, sets, scheme), "verified")
    labels = connected_components(sure)
    entries = _open_members(long, votes.select("a", "b"), labels)
    more = materialize(_block_links(entries, sets, scheme), "verified")
    return labels if more.isEmpty() else connected_components(sure.unionByName(more))


def _counted_members(long: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, cluster, tight, lists, copies) of every member of a long list.

    Clusters are as in ``_open_members``, but none is done beforehand. lists are the key's long lists where its cluster
    isn't tight, so that the lists' pairs are gone through; else they are empty.
    """
    stars = materialize(long.where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct(), "stars")
    clusters = connected_components(stars).select(F.col("node").alias("key"), F.col("label").alias("cluster"))
    per_key = long.groupBy("key").agg(F.sum("members").alias("pairs"), F.array_sort(F.collect_list("list")).alias("lists"))
    named = materialize(per_key.join(clusters, "key").join(copies, "key"), "clusters")
    sized = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("pairs").alias("pairs"))
    sized = materialize(sized.select("cluster", (F.col("n") * F.col("n") <= TIGHT * F.col("pairs")).alias("tight")), "sizes")
    rows = named.join(_small(sized), "cluster")
    return materialize(rows.select("key", "cluster", "tight", F.when(F.col("tight"), F.array().cast("array<long>")).otherwise(F.col("lists")).alias("lists"), "copies"), "members")


def _block_counts(members: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b, links) over clusters and lists: links of a forest (links null), and what a key links with (b null)."""
    tight = members.where("tight").select(F.col("cluster").alias("list"), "key", "lists", "copies", "tight")
    entries = tight.unionByName(members.where("NOT tight").select(F.explode("lists").alias("list"), "key", "lists", "copies", "tight"))
    sets = _among(sets, members.select("key").distinct())
    met = _dealt_blocks(entries, sets, ["list", "tight"]).select("list", "tight", "x", "y", "block", "key", "copies", "lists")

    def run(batch: pa.Table) -> pa.Table:
        columns = [batch.column(c).to_pylist() for c in ("key", "block", "copies", "shingles", "lists")]
        rows = {k: (b, (k, c, np.frombuffer(s, np.uint64), np.array(ls, np.int64))) for k, b, c, s, ls in zip(*columns, strict=True)}
        x, y = batch.column("x")[0].as_py(), batch.column("y")[0].as_py()
        left = [r for b, r in sorted(rows.values(), key=lambda v: v[1][0]) if b == x]
        right = [r for b, r in sorted(rows.values(), key=lambda v: v[1][0]) if b == y]
        forest, sums = counted_links(left, None if x == y else right, batch.column("list")[0].as_py(), scheme)
        a, b = [p[0] for p in forest] + list(sums), [p[1] for p in forest] + [None] * len(sums)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([None] * len(forest) + list(sums.values()), pa.int64())})

    return met.join(sets, "key").groupBy("list", "tight", "x", "y").applyInArrow(run, "a long, b long, links long")


def link_counts(texts: DataFrame, n: int, copies: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(node, label) as ``link_components`` gives them, and (key, links): the documents with other sets that a set links with.

    ``copies`` has (key, copies) of all sets.
    """
    lists = inverted_lists(texts, n, scheme)
    pairs = materialize(counted_pairs(lists.where(F.col("members") <= SHORT_LIST)), "pairs")
    long = lists.where(F.col("members") > SHORT_LIST)
    sets = wanted_sets(texts, n, pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(long.select("key")))
    members = _counted_members(long, copies)
    sure = materialize(verified(pairs, sets, scheme).distinct(), "verified")
    blocks = materialize(_block_counts(members, sets, scheme), "verified")
    places = [members.select(F.col("key").alias(k), *[F.col(c).alias(c + k) for c in ("cluster", "tight", "lists")]) for k in ("a", "b")]
    placed = sure.join(places[0], "a", "left").join(places[1], "b", "left")
    elsewhere = F.expr("clustera = clusterb AND (tighta OR arrays_overlap(listsa, listsb))")
    left = placed.where(~F.coalesce(elsewhere, F.lit(False))).select("a", "b")
    ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
    apart = ends.join(copies.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key"), F.col("copies").alias("links"))
    links = apart.unionByName(blocks.where("b IS NULL").select(F.col("a").alias("key"), "links")).groupBy("key").agg(F.sum("links").alias("links"))
    return connected_components(sure.unionByName(blocks.where("b IS NOT NULL").select("a", "b"))), links


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``jaccard_classes`` with n_links, the number of other documents that a document links with."""
    return _classes_of(docs, id_col, text_col, n, Scheme(num, den), counted=True)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of every document."""
    return _classes_of(docs, id_col, text_col, n, Scheme(num, den), counted=False)


def _classed(texts: DataFrame, n: int, scheme: Scheme, counted: bool) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (doc_id, n_shingles, key) of every row, and (key, class, component_id, n_links) of the sets that link or have copies."""
    with scratch(texts.sparkSession):
        sets = materialize(document_sets(texts, n), "document-sets", keep=True)
        nodes = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        own = F.col("copies") - 1
        if counted:
            labels, links = link_counts(texts, n, materialize(nodes.select("key", "copies"), "copies"), scheme)
            nodes, own = nodes.join(links, "key", "left"), own + F.coalesce("links", F.lit(0))
        else:
            labels = link_components(texts, n, scheme)
        named = materialize(nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("n_links", own), "nodes")
        lowest = named.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("lowest"))
        moved = named.join(lowest, "label", "left").where("label IS NOT NULL OR copies > 1")
        moved = materialize(moved.select("key", F.coalesce("label", "key").alias("class"), F.coalesce("lowest", "first").alias("component_id"), "n_links"), "classes", keep=True)
    return sets, moved


def _classes_of(docs: DataFrame, id_col: str, text_col: str, n: int, scheme: Scheme, counted: bool) -> DataFrame:
    sizes, moved = _classed(_texts(docs, id_col, text_col), n, scheme, counted)
    rows = _salted_join(sizes, moved).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows if counted else rows.drop("n_links")


def _salted_join(sizes: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows with what is known of their keys, if anything; the copies of one text are spread over SALTS parts."""
    spread = moved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, ["key", "salt"], "left")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component. Rows without id stay.

    Of rows with equal ids in one component, one stays at most; rows with equal ids and empty texts link with nothing, so
    they stay.
    """
    spark = docs.sparkSession
    with scratch(spark):
        sizes, moved = _classed(_texts(docs, id_col, text_col), n, Scheme(num, den), counted=False)
        repeated = materialize(sizes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids", keep=True)
        gone = _salted_join(sizes, moved).where("component_id <> doc_id").select("doc_id").unionByName(repeated)
        gone = materialize(gone.distinct(), "near-copies", keep=True)
        moved = materialize(moved, "classes", keep=True)
    out = docs.join(_small(gone.withColumnRenamed("doc_id", id_col)), id_col, "left_anti").select(docs.columns)
    return out if repeated.isEmpty() else out.unionByName(_one_of_each_id(docs, repeated, moved, id_col, text_col, n))


def _one_of_each_id(docs: DataFrame, repeated: DataFrame, moved: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """The rows of repeated ids that stay: of each id and class one, where the class has no smaller id."""
    names = docs.columns
    own = [f"_{i}" for i in range(len(names))]
    doc_id, text = (f"_{names.index(c)}" for c in (id_col, text_col))
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)])
    rows = rows.join(_small(repeated.select(F.col("doc_id").alias(doc_id))), doc_id, "left_semi").select(own)
    at = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(r, n) for r in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], [*own, "key"])

    keyed = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("key", LongType())]))
    kept = keyed.join(moved, "key", "left").where(F.coalesce(F.col("component_id") == F.col(doc_id).cast("long"), F.lit(True)))
    whole = F.struct(*own)
    one = kept.where("key IS NOT NULL").groupBy(doc_id, F.coalesce("class", "key").alias("class")).agg(F.min_by(whole, F.xxhash64(text)).alias("row"))
    rest = kept.where("key IS NULL").select(whole.alias("row"))
    return one.select("row").unionByName(rest).select(*[F.col(f"row.{o}").alias(c) for o, c in zip(own, names, strict=True)])


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes and link counts of documents whose 3-word shingle sets reach a Jaccard similarity of 0.9: one row each."""
    return jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)
