"""Filter interaction audit by inclusion and exclusion.

Five filters (see ``failures``) give each document a set of failed ones. For every part and every one of the 32 filter
sets S, one aggregation counts the documents that fail all of S (a product of flags; the empty set counts all). From
these joint counts F alone follow, by Möbius inversion over subsets:

* survivors of a set K of applied filters: sum over S in K of (-1)^|S| F(S); a step's removed documents are a difference of two;
* documents that fail filter f only: sum over S with f of (-1)^(|S|-1) F(S);
* redundant ones at a step: F({f}) less those that the step removes;
* the Shapley value of f, times 120: the Harsanyi dividends (-1)^(|S|+1) F(S) of the sets with f, each shared evenly by its |S|
  filters, so 120 / |S| is whole.

No order of filters is ever run over documents: 80 pairs of an applied set and a next filter serve all 600 steps.

Copies are found by the text's SHA-256 and length: rows are summed by (id, text, part) first, then by text, so a group of
copies of any size is added up before it is shuffled; which id is smallest is asked of these sums. Labels are joined by id.

Defined cases: a null text is empty, a null lang the part ''; a row without id never fails E, makes no other row fail it, and
has no label; rows that share id and text are not copies of each other, each counts; several labels of one id count as 1
if one is 1; a label without document counts nothing; long texts are judged whole; other columns are never read; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = 120
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """A struct with a flag for each filter but E: under 200 words (A); under half of them different (B); more than 3 % of its
    characters A-Z (C); any of #$%&*| (D). White space is the six ASCII characters."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(
        F.array(words),
        lambda w: F.struct(
            (F.size(w) < 200).alias("A"),
            (100 * F.size(F.array_distinct(w)) < 50 * F.size(w)).alias("B"),
            (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text)).alias("C"),
            text.rlike("[#$%&*|]").alias("D"),
        ),
    )[0]


def joint_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part and three arrays of 32 counts (all, quality = 1, toxic = 1): documents that fail every filter of the set whose bits the place has."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = rows.select("doc_id", "part", F.concat_ws("-", F.length("text"), F.sha2("text", 256)).alias("digest"), failures(F.col("text")).alias("f"))
    mask = sum((F.col(f"f.{c}").cast("int") * (1 << i) for i, c in enumerate(FILTERS[:4])), F.lit(0))
    each = flags.select("doc_id", "part", "digest", mask.alias("mask")).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))

    flagged = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    # rows without id match nothing; the second key spreads them over all tasks
    known = flagged.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).withColumn("alone", F.lit(0).cast("long"))
    alone = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    judged = each.withColumn("alone", alone).join(known, ["doc_id", "alone"], "left").fillna(False, ["good", "toxic"])

    has_id = F.col("doc_id").isNotNull()
    by_text = judged.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("without_id"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first")
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))  # at most a row for each part and label
    originals = F.col("without_id") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    told = by_text.withColumn("smallest", smallest).select("part", "mask", "good", "toxic", "n", (F.col("n") - originals).alias("copies"))

    def product(subset: int, weight: Column) -> Column:
        least = F.col("copies") if subset & 16 else F.col("n")
        fails = F.lit(True)
        for i in range(4):
            if subset >> i & 1:
                fails = fails & (F.col("mask").bitwiseAND(1 << i) != 0)
        return F.coalesce(F.sum(F.when(fails & weight, least)), F.lit(0))

    small = told.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    weights = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return small.groupBy("part").agg(*[F.array(*[product(s, w) for s in range(32)]).alias(f"F_{name}") for name, w in weights.items()])


def _signed(counts: str, keep: str, factor: str = "1") -> Column:
    """Sum over the filter sets s that meet ``keep`` of (-1)^|s| * factor * counts[s]."""
    return F.expr(f"aggregate(sequence(0, 31), 0L, (sum, s) -> sum + IF({keep}, (1 - 2 * (bit_count(s) & 1)) * {factor} * {counts}[s], 0L))")


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, f (its filter's bit) and before (the bits of those applied): 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append(("".join(order), step, bit, before))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, f int, before int")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    joint = joint_failures(docs, labels, **columns)
    pairs = joint.withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("f", F.explode(F.array(*[F.lit(1 << i) for i in range(5)]))).where("before & f = 0")
    left = {c: _signed(f"F_{c}", "s & before = s") for c in COUNTS}
    after = {c: _signed(f"F_{c}", "s & (before | f) = s") for c in COUNTS}
    figures = pairs.select(
        "part",
        "before",
        "f",
        after["n"].alias("kept"),
        (left["n"] - after["n"]).alias("removed"),
        F.expr("F_n[f]").alias("failing"),
        (-_signed("F_n", "s & f = f")).alias("unique_fails"),
        (left["good"] - after["good"]).alias("good_lost"),
        (left["toxic"] - after["toxic"]).alias("toxic_lost"),
        (-_signed("F_n", "s & f = f", f"({ORDERS} div greatest(bit_count(s), 1))")).alias("shapley"),
    )
    out = figures.join(F.broadcast(steps(docs.sparkSession)), ["before", "f"])  # 600 fixed rows
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters for each lang: 600 rows each."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Every order is run here over counts of documents by the set of filters that they fail.
OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
          || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
          || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
          || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
          || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT filter_order, i AS step, filter_order[i] AS f, filter_order[:i - 1] AS before FROM o, range(1, 6) r(i)),
r AS (SELECT part, filter_order, step, f, n, g, x, contains(c.fails, f) AS bad,
        length(translate(c.fails, before, '')) < length(c.fails) AS gone, c.fails = f AS single FROM s, c),
a AS (SELECT part, filter_order, step, f, sum(n) FILTER (WHERE NOT gone AND NOT bad) AS kept, sum(n) FILTER (WHERE NOT gone AND bad) AS removed,
        sum(n) FILTER (WHERE gone AND bad) AS redundant, sum(n) FILTER (WHERE single) AS unique_fails,
        sum(g) FILTER (WHERE NOT gone AND bad) AS good_lost, sum(x) FILTER (WHERE NOT gone AND bad) AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM a
"""
