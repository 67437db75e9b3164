"""Hygiene of paths made of all page URLs, and the refuted findings that a report names, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import hygiene as H
from tallyframe.plans import proxy as P

LISTED = ("examples/cases.jsonl",)


def _paths(s, d):
    """Every URL's path; every tenth ends like an artifact."""
    k = F.col("page_id") % 10
    ends = {1: "/eval-results/x", 2: "/Eval_Result/2024", 3: "/cases.jsonl", 4: "/models.json", 5: "/holdouts", 6: "/a/Raw.Answer.txt", 7: "/x.manifest.json"}
    tail = F.lit("")
    for at, end in ends.items():
        tail = F.when(k == at, end).otherwise(tail)
    path = F.when(k == 8, LISTED[0]).otherwise(F.concat(F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+://", ""), tail))
    rows = P.table(s, d, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", F.concat_ws(",", H.path_problems(F.col("path"), LISTED)).alias("problems"), H.shown_path(F.col("path")).alias("shown"))


PATHS_SQL = """WITH p AS (SELECT page_id, CASE WHEN page_id % 10 = 8 THEN 'examples/cases.jsonl' ELSE regexp_replace(coalesce(url, ''), '^[a-z]+://', '') || (CASE page_id % 10 WHEN 1 THEN '/eval-results/x' WHEN 2 THEN '/Eval_Result/2024'
  WHEN 3 THEN '/cases.jsonl' WHEN 4 THEN '/models.json' WHEN 5 THEN '/holdouts' WHEN 6 THEN '/a/Raw.Answer.txt' WHEN 7 THEN '/x.manifest.json' ELSE '' END) END AS path FROM pages),
t AS (SELECT *, list_filter(string_split(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-'), lambda x: x <> '') AS tokens, string_split(path, '/') AS parts FROM p),
f AS (SELECT unnest(['private-holdout', 'holdout', 'private-report', 'eval-result', 'eval-public', 'eval-preflight', 'model-snapshot', 'run-provenance', 'price-snapshot', 'provider-routing', 'provider-slug', 'raw-prompt', 'raw-answer']) AS f),
h AS (SELECT DISTINCT page_id FROM t, f WHERE list_contains(list_transform(range(1, len(tokens) + 1), lambda i: array_to_string(tokens[i:i + len(string_split(f, '-')) - 1], '-')), f))
SELECT t.page_id, array_to_string(list_filter([CASE WHEN ends_with(lower(path), '.jsonl') AND path <> 'examples/cases.jsonl' THEN 'unapproved_case_file' END, CASE WHEN ends_with(lower(path), '.manifest.json') THEN 'unapproved_manifest' END,
  CASE WHEN h.page_id IS NOT NULL OR lower(parts[-1]) = 'models.json' THEN 'private_artifact' END], lambda x: x IS NOT NULL), ',') AS problems,
  CASE WHEN len(parts) <= 2 THEN path ELSE parts[1] || '/.../' || parts[-1] END AS shown FROM t LEFT JOIN h USING (page_id)"""


def _refuted(s, d):
    rows = P.table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "confirmed").when(F.col("l_quantity") < 5, None).otherwise("refuted").alias("verdict"), F.col("l_returnflag").alias("why"))
    return H.first_refuted(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "why"]).select("l_suppkey", "l_orderkey", "l_linenumber", "why", "place")


REFUTED_SQL = """SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag AS why, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag) AS INTEGER) AS place FROM lineitem WHERE l_linestatus <> 'O' AND l_quantity >= 5
QUALIFY place <= 8"""

QUERIES = {"path_hygiene": (_paths, PATHS_SQL), "first_refuted_findings": (_refuted, REFUTED_SQL)}
