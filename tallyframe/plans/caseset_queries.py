"""Case-set queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import structured as S
from tallyframe.operators import casesets as C
from tallyframe.plans import proxy as P


def _pairs(spark, d):
    """Pairs of different texts, each known by the smallest doc_id that has it. A 64-bit hash stands for a text, so that no text is shuffled."""
    texts = P.table(spark, d, "documents").where("text IS NOT NULL").select(F.xxhash64("text").alias("id"), "doc_id", "text")
    pairs = C.near_duplicate_pairs(texts.select("id", S.words()("text").alias("tokens")))
    names = texts.groupBy("id").agg(F.min("doc_id").alias("name"))
    na, nb = (names.select(F.col("id").alias(x), F.col("name").alias(f"n{x}")) for x in ("a", "b"))
    return pairs.join(na, "a").join(nb, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "shared", "total")


def _raw_cases(spark, d):
    """Customers as case rows with a few broken rules."""
    k = F.col("c_custkey")
    return P.table(spark, d, "customer").select(
        k.alias("case_index"), F.when(k % 97 == 0, "same").when(k % 89 == 0, " ").otherwise(F.col("c_name")).alias("id"), F.when(k % 50 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("task"),
        F.when(k % 70 == 0, "").otherwise("cat").alias("category"), F.when(k % 60 == 0, "extreme").when(k % 3 == 0, None).otherwise("easy").alias("difficulty"),
    )


NEAR_SQL = """WITH t AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
k AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS s FROM t),
b AS (SELECT id, s, len(s) AS n FROM k WHERE len(s) >= 12),
p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.s, y.s)) AS shared, x.n + y.n AS m FROM b x JOIN b y ON x.id < y.id AND x.n * 10 >= y.n * 9 AND y.n * 10 >= x.n * 9),
pairs AS (SELECT a, b, CAST(shared AS INT) AS shared, CAST(m - shared AS INT) AS total FROM p WHERE shared * 10 >= (m - shared) * 9)"""
STATS_SQL = (
    P.CASES_SQL
    + """,
sc AS (SELECT * FROM cases WHERE NOT smoke_only),
bc AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE tier IN ('structured_or_exact', 'mixed')) AS ns, count(*) FILTER (WHERE difficulty = 'easy') AS e, count(*) FILTER (WHERE difficulty = 'medium') AS m, count(*) FILTER (WHERE difficulty = 'hard') AS h FROM sc GROUP BY category),
g AS (SELECT (SELECT count(*) FROM sc) AS scored, (SELECT count(*) FROM cases WHERE smoke_only) AS smoke, (SELECT count(*) FROM sc WHERE difficulty IS NULL) AS nd,
  (SELECT count(*) FROM bc WHERE n < 30) AS small, (SELECT count(*) FROM bc WHERE n >= 30 AND least(e, m, h) < 5) AS thin, (SELECT count(*) FROM bc WHERE n >= 30 AND ns < 5) AS surf,
  least((SELECT sum(e) FROM bc), (SELECT sum(m) FROM bc), (SELECT sum(h) FROM bc)) AS td, (SELECT count(*) FROM sc WHERE tier = 'ungraded') AS ug, (SELECT count(*) FROM sc WHERE tier IN ('structured_or_exact', 'mixed')) AS ev,
  (SELECT count(*) FROM sc WHERE tier = 'surface_text') AS st)"""
)
GATE_SQL = f"""WITH {STATS_SQL}
SELECT severity, CAST(ordinal AS INT) AS ordinal, code FROM g, LATERAL (VALUES
('blocker', 0, 'not_holdout', true), ('blocker', 1, 'manifest_absent_for_this_assessment', true), ('blocker', 4, 'too_few_scored_cases', scored < 100), ('blocker', 7, 'category_underpowered', small > 0),
('blocker', 8, 'missing_scored_case_difficulty', nd > 0), ('blocker', 9, 'difficulty_underpowered', td < 30), ('blocker', 10, 'category_difficulty_coverage_underpowered', nd = 0 AND td >= 30 AND thin > 0),
('blocker', 11, 'ungraded_scored_cases', ug > 0), ('blocker', 12, 'insufficient_non_surface_grader_evidence', scored > 0 AND ev < 5), ('blocker', 14, 'category_non_surface_grader_evidence_underpowered', surf > 0),
('blocker', 15, 'duplicate_scored_case_content', true), ('warning', 0, 'no_spend_case_set_only', true), ('warning', 1, 'smoke_only_cases_excluded', smoke > 0), ('warning', 2, 'surface_text_grader_evidence_present', st > 0), ('warning', 3, 'mechanical_grader_evidence_present', ev > 0)) v(severity, ordinal, code, fires) WHERE fires"""
_NS = "count(*) FILTER (WHERE NOT smoke_only AND tier IN ('structured_or_exact', 'mixed'))"

QUERIES = {
    "case_summary_cube": (
        lambda s, d: C.summary_cube(P.cases(s, d)),
        f"WITH {P.CASES_SQL}, k AS (SELECT * REPLACE (coalesce(category, '(none)') AS category, coalesce(difficulty, '(none)') AS difficulty) FROM cases) SELECT category, difficulty, tier, count(*) AS cases, count(*) FILTER (WHERE NOT smoke_only) AS scored, {_NS} AS scored_non_surface FROM k GROUP BY GROUPING SETS ((category), (difficulty), (category, difficulty), (tier), ())",
    ),
    "category_balance": (lambda s, d: C.balance(P.cases(s, d), "category"), f"WITH {P.CASES_SQL}, z AS (SELECT category, count(*) AS n FROM cases WHERE NOT smoke_only AND category IS NOT NULL GROUP BY 1) SELECT coalesce(min(n), 0) AS smallest, coalesce(max(n), 0) AS largest, count(*) AS groups FROM z"),
    "difficulty_coverage": (lambda s, d: C.balance(P.cases(s, d), "difficulty"), f"WITH {P.CASES_SQL}, z AS (SELECT difficulty, count(*) AS n FROM cases WHERE NOT smoke_only AND difficulty IS NOT NULL GROUP BY 1) SELECT coalesce(min(n), 0) AS smallest, coalesce(max(n), 0) AS largest, count(*) AS groups FROM z"),
    "exact_duplicates": (
        lambda s, d: C.exact_duplicates(P.table(s, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("fp")), "fp"),
        "WITH z AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS cases FROM z",
    ),
    "near_duplicate_pairs": (_pairs, f"{NEAR_SQL} SELECT * FROM pairs"),
    "near_duplicate_counts": (lambda s, d: C.near_duplicate_counts(_pairs(s, d)), f"{NEAR_SQL} SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM pairs UNION ALL SELECT b FROM pairs) u) AS cases"),
    "violations": (
        lambda s, d: C.violations(_raw_cases(s, d)),
        """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 97 = 0 THEN 'same' WHEN c_custkey % 89 = 0 THEN ' ' ELSE c_name END AS id FROM customer), n AS (SELECT k, id, count(*) OVER (PARTITION BY id) AS c FROM r)
SELECT k AS case_index, rule FROM n, LATERAL (VALUES ('duplicate_id', c > 1), ('blank_id', trim(id) = ''), ('blank_task', k % 50 = 0), ('unbounded_category', k % 70 = 0), ('unknown_difficulty', k % 60 = 0)) v(rule, broken) WHERE broken""",
    ),
    "case_gate_findings": (lambda s, d: C.gate_findings(C.gate_statistics(P.cases(s, d), duplicate_groups=1), "development", None, False), GATE_SQL),
    "tier_profile": (
        lambda s, d: C.tier_profile(P.cases(s, d), "category"),
        f"""WITH {P.CASES_SQL}, z AS (SELECT category, count(*) AS cases, count(*) FILTER (WHERE tier = 'structured_or_exact') AS a, count(*) FILTER (WHERE tier = 'mixed') AS b, count(*) FILTER (WHERE tier = 'surface_text') AS c, count(*) FILTER (WHERE tier = 'ungraded') AS e FROM cases WHERE NOT smoke_only GROUP BY category),
y AS (SELECT *, greatest(a, b, c, e) AS t FROM z)
SELECT category, cases, a AS n_structured_or_exact, b AS n_mixed, c AS n_surface_text, e AS n_ungraded, CASE WHEN (a = t)::INT + (b = t)::INT + (c = t)::INT + (e = t)::INT = 1 THEN CASE t WHEN a THEN 'structured_or_exact' WHEN b THEN 'mixed' WHEN c THEN 'surface_text' ELSE 'ungraded' END END AS dominant_tier,
  floor(t / cases * 1e4::DOUBLE + 0.5) / 1e4::DOUBLE AS dominant_share, CASE WHEN (a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (e > 0)::INT <= 1 THEN 'single_tier' ELSE 'mixed_tiers' END AS profile_mix,
  a BETWEEN 1 AND 4 OR b BETWEEN 1 AND 4 OR c BETWEEN 1 AND 4 OR e BETWEEN 1 AND 4 AS small_cell FROM y""",
    ),
}
