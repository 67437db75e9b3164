"""What must not be published: paths of private or generated artifacts, and which refuted findings a report may name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import path_tokens

# Fixed values.
FORBIDDEN_SEQUENCES = (
    "private-holdout", "holdout", "private-report", "eval-result", "eval-public", "eval-preflight", "model-snapshot", "run-provenance", "price-snapshot", "provider-routing", "provider-slug", "raw-prompt", "raw-answer",
)
FORBIDDEN_NAMES = ("models.json",)
NAMED_FALSE_POSITIVES = 8
# End of the fixed values.


def path_problems(path: Column, case_files: tuple[str, ...] = (), manifests: tuple[str, ...] = ()) -> Column:
    """Codes of what a path breaks: case files and manifests that aren't on their list, and private or generated artifacts.

    Forbidden are whole token sequences, not letters: one alternation over the path's tokens finds any of them. A null path breaks nothing.
    """
    low = F.lower(path)
    joined = F.concat(F.lit("-"), F.array_join(path_tokens(path), "-"), F.lit("-"))
    private = joined.rlike(f"-({'|'.join(FORBIDDEN_SEQUENCES)})-") | F.element_at(F.split(low, "/"), -1).isin(*FORBIDDEN_NAMES)
    unlisted = lambda ending, known: low.endswith(ending) & ~(path.isin(*known) if known else F.lit(False))
    rules = [("unapproved_case_file", unlisted(".jsonl", case_files)), ("unapproved_manifest", unlisted(".manifest.json", manifests)), ("private_artifact", private)]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def shown_path(path: Column) -> Column:
    """A path of more than two parts without what lies between the first and the last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 2, path).otherwise(F.concat(parts[0], F.lit("/.../"), F.element_at(parts, -1)))


def first_refuted(findings: DataFrame, keys: list[str], order_cols: list[str], verdict_col: str = "verdict", most: int = NAMED_FALSE_POSITIVES) -> DataFrame:
    """The first ``most`` findings of each group that were judged and not confirmed, with their place; a null verdict is none.

    Spark keeps the first rows of each group in every task before it shuffles them, so a group of any size stays small.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols))
    return findings.where(F.col(verdict_col) != "confirmed").withColumn("place", place).where(F.col("place") <= most)
