"""Blind pairwise judging: counterbalanced verdicts, panels, tallies and knockout tournaments.

Votes: doc_id (task), judge, order (1: the challenger is shown as A) and verdict (A, B or TIE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def side(order: Column, verdict: Column) -> Column:
    """Who won: the challenger, the baseline or none."""
    return F.when(verdict == "TIE", "tie").when((order == 1) == (verdict == "A"), "challenger").otherwise("baseline")


def counterbalanced(votes: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict of each judge: a side wins only if it wins in both orders."""
    won = side(F.col("order"), F.col("verdict"))
    both = votes.groupBy(*keys, "judge").agg(F.min(won).alias("lo"), F.max(won).alias("hi"), F.count(F.lit(1)).alias("n"))
    return both.select(*keys, "judge", F.when((F.col("lo") == F.col("hi")) & (F.col("n") == 2), F.col("lo")).otherwise("tie").alias("outcome"))


def panel(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """The side that more than half of the judges chose, else a tie."""
    wins = lambda s: F.count_if(F.col("outcome") == s)
    half = F.count(F.lit(1)) / 2
    return outcomes.groupBy(*keys).agg(F.when(wins("challenger") > half, "challenger").when(wins("baseline") > half, "baseline").otherwise("tie").alias("outcome"), F.count(F.lit(1)).alias("judges"))


def tally(outcomes: DataFrame, key: str) -> DataFrame:
    """Wins, losses and ties of the challenger, and their shares in percent of what was judged."""
    n = F.count(F.lit(1))
    counts = {"wins": "challenger", "losses": "baseline", "ties": "tie"}
    return outcomes.groupBy(key).agg(n.alias("judged"), *[F.count_if(F.col("outcome") == s).alias(c) for c, s in counts.items()], *[(F.count_if(F.col("outcome") == s) * 100.0 / n).alias(f"{c}_pct") for c, s in counts.items()])


def round_pairs(pool: DataFrame, group: str, round_index: int) -> DataFrame:
    """(group, match, a, b): neighbours meet; who is shown as A alternates with round + match; of an odd pool the last has no b.

    Pool: group, place (from 0), entry.
    """
    # dealt anew in each round: else all rounds run in one task, each with a sort, and every round is played again for each later one
    dealt = pool.withColumn("match", F.floor(F.col("place") / 2).cast("int")).repartition(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "match")
    two = dealt.groupBy(group, "match").agg(F.min_by("entry", "place").alias("first"), F.max_by("entry", "place").alias("second"), F.count(F.lit(1)).alias("n"))
    swap = (F.col("match") + round_index) % 2 == 1
    return two.select(group, "match", F.when(swap & (F.col("n") == 2), F.col("second")).otherwise(F.col("first")).alias("a"), F.when(F.col("n") == 2, F.when(swap, F.col("first")).otherwise(F.col("second"))).alias("b"))


def tournament(pool: DataFrame, group: str, most: int, better) -> tuple[DataFrame, DataFrame]:
    """Single elimination in every group at once: (winners, matches of all rounds).

    The largest pool, measured first, says how many rounds there are; ``most`` is the size that is expected at least.
    ``better(a, b)`` gives the winner's column from the struct columns of both sides; where it gives null, a wins.
    """
    played, index = None, 0
    most = max(most, 2, 1 + (pool.agg(F.max("place")).first()[0] or 0))
    while 1 << index < most:
        matches = round_pairs(pool, group, index).withColumn("round", F.lit(index))
        rows = matches.where("b IS NOT NULL").withColumn("winner", F.coalesce(better(F.col("a"), F.col("b")), F.col("a")))
        played = rows if played is None else played.unionByName(rows)
        pool = matches.select(group, F.col("match").alias("place"), F.when(F.col("b").isNull(), F.col("a")).otherwise(F.coalesce(better(F.col("a"), F.col("b")), F.col("a"))).alias("entry"))
        index += 1
    return pool.select(group, F.col("entry").alias("winner")), played


def unparseable_share(votes: DataFrame, parsed: Column) -> DataFrame:
    return votes.agg(F.count(F.lit(1)).alias("matches"), (F.count_if(parsed.isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("unparseable_share"))


def arm_means(rows: DataFrame, arm: str, values: list[str]) -> DataFrame:
    """Mean of each value by arm, as sum over count."""
    return rows.groupBy(arm).agg(*[(F.sum(v) / F.count(F.lit(1))).alias(f"mean_{v}") for v in values])


def judgeable(pairs: DataFrame, answers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pairs (a, b) whose two answers are not blank."""
    full = answers.where(F.trim("answer") != "").select(id_col)
    return pairs.join(full.select(F.col(id_col).alias("a")), "a", "left_semi").join(full.select(F.col(id_col).alias("b")), "b", "left_semi")


def pool_of(rows: DataFrame, group: str, order: list[str], entry: list[str]) -> DataFrame:
    """(group, place, entry) with entries as structs, placed by ``order``."""
    return rows.select(group, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).alias("place"), F.struct(*entry).alias("entry"))
