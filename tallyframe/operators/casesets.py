"""Case sets: validation, summaries, duplicates, near duplicates and the evidence gate.

Cases: case_index, smoke_only, category, difficulty, tier, and for content: fingerprint and task text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIFFICULTIES = ("easy", "medium", "hard")
TIERS = ("structured_or_exact", "mixed", "surface_text", "ungraded", "smoke_only")
NON_SURFACE = ("structured_or_exact", "mixed")
#: The gate's minimums and the near-duplicate rule.
MIN_SCORED, MIN_CATEGORY, MIN_DIFFICULTY, MIN_CELL, MIN_EVIDENCE = 100, 30, 30, 5, 5
NEAR_NUM, NEAR_DEN, MIN_TOKENS = 9, 10, 12
#: Places in which tokens are counted for the order of a set; any number gives the same pairs.
RARITY_SLOTS = 1 << 16
#: Bits of a set's sketch, and words of 64 bits in the table of ids that are verified; any numbers give the same pairs.
SKETCH_BITS, WANTED_WORDS = 1024, 500_000


def non_surface() -> Column:
    return F.col("tier").isin(*NON_SURFACE)


def summary_cube(cases: DataFrame) -> DataFrame:
    """Counts by category, by difficulty, by both, by tier and in all, from one pass over grouping sets."""
    known = cases.withColumns({"category": F.coalesce("category", F.lit("(none)")), "difficulty": F.coalesce("difficulty", F.lit("(none)"))})
    sets = known.groupingSets([["category"], ["difficulty"], ["category", "difficulty"], ["tier"], []], "category", "difficulty", "tier")
    scored = ~F.col("smoke_only")
    return sets.agg(F.count(F.lit(1)).alias("cases"), F.count_if(scored).alias("scored"), F.count_if(scored & F.col("tier").isin(*NON_SURFACE)).alias("scored_non_surface"))


def balance(cases: DataFrame, key: str) -> DataFrame:
    """Smallest and largest group of scored cases; zeros if there is none."""
    sizes = cases.where(~F.col("smoke_only") & F.col(key).isNotNull()).groupBy(key).count()
    return sizes.agg(F.coalesce(F.min("count"), F.lit(0)).alias("smallest"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"), F.count(F.lit(1)).alias("groups"))


def exact_duplicates(cases: DataFrame, fingerprint: str) -> DataFrame:
    """Groups of equal content and the cases in them."""
    groups = cases.groupBy(fingerprint).count().where("count > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("cases"))


def near_duplicate_pairs(tokens: DataFrame, num: int = NEAR_NUM, den: int = NEAR_DEN, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(a, b, shared, total): pairs of token sets with a Jaccard similarity of num / den or more.

    ``tokens``: id and its distinct tokens; rows with one id hold equal ones. Rare tokens first, each set enters the
    lists of its first k - ceil(k * num / den) + 1 tokens; sets that meet there, differ little in size and can still share
    enough from there on are verified. Any total order keeps this lossless; rarity keeps the lists short, so it need not be
    exact: it is counted in ``RARITY_SLOTS`` places by hash, and a set finds its own order. Pairs that met are first compared
    by sketches: two sets differ in at least as many tokens as their sketches in bits. Tokens are known by 64-bit hashes; list
    entries, sketches and the sets of pairs that are left are shuffled.
    """
    sized = tokens.select("id", F.size("tokens").alias("k"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows of ``min_tokens`` or more, their sizes and hashes. A condition on tokens in the plan would make them twice."""
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                batch = batch.filter(pa.array(batch.column("k").to_numpy() >= min_tokens))
                yield batch, batch.column("k").to_numpy().astype(np.int64), batch.column("h").flatten().to_numpy()

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY_SLOTS, np.int64)
        for _, _, h in large(batches):
            counts += np.bincount(h % RARITY_SLOTS, minlength=RARITY_SLOTS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["slot", "n"])

    seen = sized.mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("count")).toArrow()
    often = np.zeros(RARITY_SLOTS, np.int64)
    often[seen.column("slot").to_numpy()] = seen.column("count").to_numpy()

    def first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, h in large(batches):
            row = np.repeat(np.arange(len(k)), k)
            order = np.lexsort((h, often[h % RARITY_SLOTS], row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(k) - k, k)
            kept = place < (k - -(-k * num // den) + 1)[row]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[kept])), pa.array(k[row[kept]].astype(np.int32)), pa.array(place[kept].astype(np.int32)), pa.array(h[order][kept])], ["id", "k", "place", "token"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, h in large(batches):
            at = np.repeat(np.arange(len(k)), k) * SKETCH_BITS + h % SKETCH_BITS
            odd = (np.bincount(at, minlength=len(k) * SKETCH_BITS) & 1).astype(np.uint8)
            ends = pa.array(np.arange(len(k) + 1, dtype=np.int32) * (SKETCH_BITS // 64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), pa.ListArray.from_arrays(ends, pa.array(np.packbits(odd).view(np.int64)))], ["id", "k", "sketch"])

    kind = tokens.schema["id"].dataType.simpleString()
    entries = sized.mapInArrow(first_tokens, f"id {kind}, k int, place int, token long").repartition("token")
    left, right = (entries.select(F.col("id").alias(x), F.col("k").alias(f"k{x}"), F.col("place").alias(f"at{x}"), F.col("token").alias(f"token{x}")) for x in ("a", "b"))
    near = (F.col("ka") * den >= F.col("kb") * num) & (F.col("kb") * den >= F.col("ka") * num)
    # what the first token that they share leaves at most, against what they must share
    most = F.least(F.col("ka") - F.col("ata"), F.col("kb") - F.col("atb"))
    near &= most * (num + den) >= (F.col("ka") + F.col("kb")) * num
    met = left.join(right, F.col("tokena") == F.col("tokenb")).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    sketched = sized.mapInArrow(sketches, f"id {kind}, k int, sketch array<long>").dropDuplicates(["id"])
    sa, sb = (sketched.select(F.col("id").alias(x), F.col("k").alias(f"k{x}"), F.col("sketch").alias(f"s{x}")) for x in ("a", "b"))
    bits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    likely = met.join(sa, "a").join(sb, "b").where(bits * (num + den) <= (F.col("ka") + F.col("kb")) * (den - num)).select("a", "b").persist()
    place = F.pmod(F.xxhash64("id"), F.lit(64 * WANTED_WORDS))
    ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
    wanted = ends.select(place.alias("at")).groupBy(F.expr("at DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
    marked = sized.withColumn("at", place).withColumn("word", F.expr("at DIV 64")).join(F.broadcast(wanted), "word").where(F.expr("getbit(bits, CAST(at % 64 AS INT)) = 1"))
    sets = marked.select("id", "h").dropDuplicates(["id"])
    ta, tb = (sets.select(F.col("id").alias(x), F.col("h").alias(f"t{x}")) for x in ("a", "b"))
    shared = F.size(F.array_intersect("ta", "tb"))
    scored = likely.join(ta, "a").join(tb, "b").select("a", "b", shared.alias("shared"), (F.size("ta") + F.size("tb") - shared).alias("total"))
    return scored.where(F.col("shared") * den >= F.col("total") * num)


def near_duplicate_counts(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).join(ends.agg(F.count_distinct("id").alias("cases")))


def violations(cases: DataFrame) -> DataFrame:
    """(case_index, rule) of every broken rule; an empty result means that the cases are valid."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    copies = F.count(F.lit(1)).over(Window.partitionBy("id"))
    rules = {
        "duplicate_id": F.col("copies") > 1,
        "blank_id": blank("id"),
        "blank_task": blank("task"),
        "unbounded_category": ~F.coalesce(F.length("category").between(1, 200), F.lit(True)),
        "unknown_difficulty": ~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(True)),
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]))
    return cases.withColumn("copies", copies).select("case_index", F.explode(broken).alias("rule"))


def gate_statistics(cases: DataFrame, duplicate_groups: int = 0, near_pairs: int = 0) -> DataFrame:
    """One row with all counts that the gate's rules read."""
    s = cases.where(~F.col("smoke_only"))
    cell = s.groupBy("category", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.count_if(non_surface()).alias("ns"))
    by_category = cell.where("category IS NOT NULL").groupBy("category").agg(F.sum("n").alias("n"), F.sum("ns").alias("ns"), *[F.sum(F.when(F.col("difficulty") == d, F.col("n")).otherwise(0)).alias(d) for d in DIFFICULTIES])
    eligible = F.col("n") >= MIN_CATEGORY
    per_category = by_category.agg(
        F.count(F.lit(1)).alias("categories"),
        F.count_if(~eligible).alias("small_categories"),
        F.count_if(eligible & (F.least(*DIFFICULTIES) < MIN_CELL)).alias("thin_cells"),
        F.count_if(eligible & (F.col("ns") < MIN_EVIDENCE)).alias("surface_categories"),
    )
    per_difficulty = cell.agg(*[F.coalesce(F.sum(F.when(F.col("difficulty") == d, F.col(x))), F.lit(0)).alias(f"{x}_{d}") for d in DIFFICULTIES for x in ("n", "ns")])
    total = cases.agg(
        F.count_if(~F.col("smoke_only")).alias("scored"),
        F.count_if(F.col("smoke_only")).alias("smoke"),
        F.count_if(~F.col("smoke_only") & F.col("category").isNull()).alias("uncategorized"),
        F.count_if(~F.col("smoke_only") & F.col("difficulty").isNull()).alias("no_difficulty"),
        *[F.count_if(~F.col("smoke_only") & (F.col("tier") == t)).alias(f"tier_{t}") for t in TIERS],
    )
    joined = total.join(per_category).join(per_difficulty)
    return joined.withColumns({"duplicate_groups": F.lit(duplicate_groups), "near_pairs": F.lit(near_pairs)})


def gate_findings(stats: DataFrame, intended_use: str, manifest: str | None, requested: bool) -> DataFrame:
    """(severity, ordinal, code): the rules that fire on the one-row statistics, in the fixed order of the rules."""
    c = F.col
    thin = F.least(*[c(f"n_{d}") for d in DIFFICULTIES])
    clear = (c("no_difficulty") == 0) & (thin >= MIN_DIFFICULTY)
    evidence = c("tier_structured_or_exact") + c("tier_mixed")
    hmac_used = F.lit(requested and manifest == "hmac-sha256")
    blockers = [
        ("not_holdout", F.lit(intended_use != "holdout")),
        ("manifest_absent_for_this_assessment", F.lit(not requested)),
        ("manifest_hash_algorithm_unknown", F.lit(requested and manifest is None)),
        ("holdout_manifest_requires_hmac", F.lit(requested and manifest == "sha256" and intended_use == "holdout")),
        ("too_few_scored_cases", c("scored") < MIN_SCORED),
        ("no_scored_categories", c("categories") == 0),
        ("uncategorized_scored_cases", c("uncategorized") > 0),
        ("category_underpowered", c("small_categories") > 0),
        ("missing_scored_case_difficulty", c("no_difficulty") > 0),
        ("difficulty_underpowered", thin < MIN_DIFFICULTY),
        ("category_difficulty_coverage_underpowered", clear & (c("thin_cells") > 0)),
        ("ungraded_scored_cases", c("tier_ungraded") > 0),
        ("insufficient_non_surface_grader_evidence", (c("scored") > 0) & (evidence < MIN_EVIDENCE)),
        ("difficulty_non_surface_grader_evidence_underpowered", clear & (F.least(*[c(f"ns_{d}") for d in DIFFICULTIES]) < MIN_EVIDENCE)),
        ("category_non_surface_grader_evidence_underpowered", c("surface_categories") > 0),
        ("duplicate_scored_case_content", c("duplicate_groups") > 0),
        ("near_duplicate_scored_case_content", c("near_pairs") > 0),
    ]
    warnings = [
        ("no_spend_case_set_only", F.lit(True)),
        ("smoke_only_cases_excluded", c("smoke") > 0),
        ("surface_text_grader_evidence_present", c("tier_surface_text") > 0),
        ("mechanical_grader_evidence_present", evidence > 0),
        ("private_auditor_verifiable_only", hmac_used),
        ("hmac_structural_metadata_visible", hmac_used),
    ]
    rows = [F.when(cond, F.struct(F.lit(kind).alias("severity"), F.lit(i).alias("ordinal"), F.lit(code).alias("code"))) for kind, rules in (("blocker", blockers), ("warning", warnings)) for i, (code, cond) in enumerate(rules)]
    return stats.select(F.explode(F.array_compact(F.array(*rows))).alias("f")).select("f.*")


def tier_profile(cases: DataFrame, key: str | None = None) -> DataFrame:
    """Counts of each tier among scored cases, the one that leads (null on a tie), its share, the mix and small cells."""
    groups = [key] if key else []
    counts = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in TIERS[:4]]
    s = cases.where(~F.col("smoke_only")).groupBy(*groups).agg(F.count(F.lit(1)).alias("cases"), *counts)
    columns = [F.col(f"n_{t}") for t in TIERS[:4]]
    top = F.greatest(*columns)
    leaders = sum([(c == top).cast("int") for c in columns], F.lit(0))
    leader = F.when(leaders == 1, F.element_at(F.array(*[F.lit(t) for t in TIERS[:4]]), F.array_position(F.array(*columns), top).cast("int")))
    kinds = sum([(c > 0).cast("int") for c in columns], F.lit(0))
    share = F.floor(top / F.nullif(F.col("cases"), F.lit(0)) * 1e4 + 0.5) / 1e4
    small = F.greatest(*[(c > 0) & (c < 5) for c in columns])
    mix = F.when(F.col("cases") == 0, "no_scored_cases").when(kinds <= 1, "single_tier").otherwise("mixed_tiers")
    return s.select(*groups, "cases", *[f"n_{t}" for t in TIERS[:4]], leader.alias("dominant_tier"), share.alias("dominant_share"), mix.alias("profile_mix"), small.alias("small_cell"))
