"""Manifests of a case set made of all documents, and net win intervals of judged documents, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import manifest as M
from tallyframe.operators import resample as B
from tallyframe.plans import pairwise_queries as W
from tallyframe.plans import proxy as P

USE = "public_sample"


def _cases(s, d) -> DataFrame:
    """Whole documents as cases: the text is the task, the source a constraint, every tenth is a smoke case."""
    c = F.col
    k = c("doc_id")
    grader = F.struct(F.when(k % 4 == 1, "x").alias("exact"), F.when(k % 4 == 2, F.array(F.lit("b"), F.lit("a"))).alias("mustInclude"), F.when(k % 4 == 3, (k % 50).cast("int")).alias("minLength"))
    raw = F.to_json(F.struct(F.when(k % 4 > 0, grader).alias("grader")))
    rows = P.table(s, d, "documents").select(
        k.alias("case_index"), (k + 1).alias("line"), F.concat(F.lit("doc-"), k).alias("id"), F.coalesce("text", F.lit("")).alias("task"), F.array("source").alias("constraints"), c("lang").alias("category"),
        F.when(k % 7 > 0, F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (k % 3 + 1).cast("int"))).alias("difficulty"), (k % 10 == 0).alias("smoke_only"),
        F.when(k % 10 == 0, "smoke_only").when(k % 4 == 0, "ungraded").when(k % 4 == 1, "structured_or_exact").otherwise("surface_text").alias("tier"), F.when(k % 4 > 0, 1).otherwise(0).alias("checks"), raw.alias("raw"),
    )
    return M.canonical_cases(rows)


def _set_digest(s, d):
    head, tail = '{"cases":[', f'],"fingerprintVersion":"{M.FINGERPRINT}","intendedUse":"{USE}"}}'
    return M.streamed_digest(_cases(s, d), "case_index", "canonical", head, tail)


def _rows(s, d):
    return M.manifest_rows(_cases(s, d), labels=True, ids=True).withColumns({c: F.concat_ws(",", F.coalesce(c, F.array().cast("array<string>"))) for c in ("graderKinds", "ignoredSmokeOnlyGraderKinds")})


def _net_win(s, d):
    sign = F.when(F.col("outcome") == "challenger", 1).when(F.col("outcome") == "baseline", -1).otherwise(0)
    return B.net_win_intervals(W._panel(s, d).withColumn("value", sign), ["source"], "doc_id", "value", NET_SAMPLES)


NET_SAMPLES = 200

_TEXT = "coalesce(text, '')"
_GRADER = """CASE doc_id % 4 WHEN 1 THEN '{"exact":"x"}' WHEN 2 THEN '{"mustInclude":["b","a"]}' WHEN 3 THEN '{"minLength":' || (doc_id % 50) || '}' ELSE 'null' END"""
_LEVEL = "CASE WHEN doc_id % 7 > 0 THEN ['easy', 'medium', 'hard'][CAST(doc_id % 3 AS INT) + 1] END"
_QUOTED = "coalesce('\"' || {} || '\"', 'null')"
CASES_SQL = f"""cs AS (SELECT doc_id AS case_index, doc_id + 1 AS line, 'doc-' || doc_id AS id, lang AS category, {_LEVEL} AS difficulty, doc_id % 10 = 0 AS smoke,
  CASE WHEN doc_id % 4 > 0 THEN '{{"grader":' || ({_GRADER}) || '}}' ELSE '{{}}' END AS raw,
  CASE doc_id % 4 WHEN 1 THEN 'exact' WHEN 2 THEN 'mustInclude' WHEN 3 THEN 'length' ELSE '' END AS kinds,
  CASE WHEN doc_id % 10 = 0 THEN 'smoke_only' WHEN doc_id % 4 = 0 THEN 'ungraded' WHEN doc_id % 4 = 1 THEN 'structured_or_exact' ELSE 'surface_text' END AS tier,
  '{{"category":' || {_QUOTED.format("lang")} || ',"constraintsCount":1,"constraintsHash":"' || sha256('["' || source || '"]') || '","difficulty":' || {_QUOTED.format("(" + _LEVEL + ")")} || ',"grader":' || ({_GRADER})
  || ',"id":"doc-' || doc_id || '","smokeOnly":' || (doc_id % 10 = 0)::VARCHAR || ',"taskHash":"' || sha256({_TEXT}) || '","taskLength":' || (length({_TEXT}) + length(regexp_replace({_TEXT}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) || '}}' AS canonical FROM documents)"""
SET_SQL = f"""WITH {CASES_SQL} SELECT sha256('{{"cases":[' || string_agg(canonical, ',' ORDER BY case_index) || '],"fingerprintVersion":"{M.FINGERPRINT}","intendedUse":"{USE}"}}') AS digest FROM cs"""
ROWS_SQL = f"""WITH {CASES_SQL} SELECT case_index, line, format('case_{{:04d}}', case_index + 1) AS "publicId", smoke AS "smokeOnly", CASE WHEN smoke THEN '' ELSE kinds END AS "graderKinds", tier AS "graderEvidenceTier",
  CASE WHEN smoke THEN kinds ELSE '' END AS "ignoredSmokeOnlyGraderKinds", sha256(canonical) AS "canonicalRowSha256", sha256(raw) AS "rawLineSha256", id, category FROM cs"""
_COUNT = "count(*) FILTER (WHERE {})"
_FIGURES = {
    "cases": "true", "scored_cases": "NOT smoke", "smoke_cases": "smoke", "uncategorized": "category IS NULL", "scored_uncategorized": "NOT smoke AND category IS NULL", "scored_no_difficulty": "NOT smoke AND difficulty IS NULL", "smoke_no_difficulty": "smoke AND difficulty IS NULL",
    **{f"difficulty_{x}": f"difficulty = '{x}'" for x in ("easy", "medium", "hard")}, **{f"scored_difficulty_{x}": f"NOT smoke AND difficulty = '{x}'" for x in ("easy", "medium", "hard")},
    **{f"kind_{k}": f"NOT smoke AND kinds = '{k}'" for k in M.KINDS}, **{f"ignored_{k}": f"smoke AND kinds = '{k}'" for k in M.KINDS}, **{f"tier_{t}": f"tier = '{t}'" for t in ("structured_or_exact", "surface_text", "mixed", "smoke_only", "ungraded")},
    "ignored_cases": "smoke AND kinds <> ''", "checks": "NOT smoke AND kinds <> ''", "ignored_checks": "smoke AND kinds <> ''",
}
COUNTS_SQL = f"""WITH {CASES_SQL}, z AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE NOT smoke) AS s FROM cs WHERE category IS NOT NULL GROUP BY category),
b AS (SELECT count(*) AS categories, coalesce(min(n), 0) AS least, coalesce(max(n), 0) AS most, count(*) FILTER (WHERE s > 0) AS scored_categories, coalesce(min(s) FILTER (WHERE s > 0), 0) AS scored_least, coalesce(max(s), 0) AS scored_most FROM z)
SELECT * FROM (SELECT {", ".join(f'{_COUNT.format(cond)} AS "{name}"' for name, cond in _FIGURES.items())} FROM cs), b"""

#: The stream is walked step by step here.
NET_SQL = f"""WITH RECURSIVE {W.JUDGED_SQL},
o AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, CASE outcome WHEN 'challenger' THEN 1 WHEN 'baseline' THEN -1 ELSE 0 END) - 1 AS BIGINT) AS ordinal, CASE outcome WHEN 'challenger' THEN 1 WHEN 'baseline' THEN -1 ELSE 0 END AS value FROM p),
n AS (SELECT source, count(*) AS tasks FROM o GROUP BY source),
g AS (SELECT 0::BIGINT AS place, 987654321::BIGINT AS state UNION ALL SELECT place + 1, CAST(state::DOUBLE * 1103515245::DOUBLE + 12345::DOUBLE AS BIGINT) & 2147483647 FROM g WHERE place < (SELECT max(tasks) * {NET_SAMPLES} FROM n)),
x AS (SELECT n.source, n.tasks, (g.place - 1) // n.tasks AS sample, least(n.tasks - 1, CAST(floor(g.state / 2147483647::DOUBLE * n.tasks) AS BIGINT)) AS ordinal FROM n JOIN g ON g.place BETWEEN 1 AND n.tasks * {NET_SAMPLES}),
m AS (SELECT x.source, x.tasks, sample, CAST(sum(value) AS BIGINT) / x.tasks::DOUBLE AS net FROM x JOIN o ON o.source = x.source AND o.ordinal = x.ordinal GROUP BY x.source, x.tasks, sample),
l AS (SELECT source, tasks, list_sort(list(net)) AS v FROM m GROUP BY source, tasks)
SELECT source, tasks, v[{int(NET_SAMPLES * 0.025) + 1}] AS low, v[{int(NET_SAMPLES * 0.975) + 1}] AS high FROM l"""

QUERIES = {
    "manifest_set_digest": (_set_digest, SET_SQL),
    "manifest_document_rows": (_rows, ROWS_SQL),
    "manifest_counts": (lambda s, d: M.header_counts(_cases(s, d)), COUNTS_SQL),
    "boot_net_win": (_net_win, NET_SQL),
}
