"""Grading queries over documents, orders and events as answers, and their SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyframe.functions import structured as S
from tallyframe.functions import text as T
from tallyframe.operators import grading as G
from tallyframe.plans.proxy import table

TERMS = ["the", "and", "Und"]
SCHEMA = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 99}}, "required": ["k"], "additionalProperties": False}
_SP = r"[\t-\r    -     　﻿]"
NORM = f"lower(regexp_replace(regexp_replace({{0}}, '^{_SP}+|{_SP}+$', '', 'g'), '{_SP}+', ' ', 'g'))"


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("case_index"), F.coalesce("text", F.lit("")).alias("answer"), "lang", "source")


def _terms():
    return F.array(*[F.lit(t) for t in TERMS])


def _one(spark, d, **graders):
    """The graded documents with the names and results of their checks as one text."""
    rows = G.grade(_docs(spark, d).withColumns(graders))
    return rows.select("case_index", "passed", F.concat_ws(",", F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), c["passed"].cast("string")))).alias("checks"))


def _answers_sql(checks: str, passed: str) -> str:
    return f"SELECT doc_id AS case_index, {passed} AS passed, {checks} AS checks FROM (SELECT doc_id, coalesce(text, '') AS a FROM documents) t"


def _list_sql(name: str, tests: list[str]) -> str:
    parts = [f"'{name}=' || ({t})" for t in tests]
    too_long = "length(a) > 20000"
    return f"SELECT doc_id AS case_index, NOT ({too_long}) AND {' AND '.join(f'({t})' for t in tests)} AS passed, CASE WHEN {too_long} THEN 'answer_size=false' ELSE {' || chr(44) || '.join(parts)} END AS checks FROM (SELECT doc_id, coalesce(text, '') AS a FROM documents) t"


INCLUDES = [f"contains(lower(a), '{t.lower()}')" for t in TERMS]


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("case_index"), F.col("props").alias("answer"))


def _json_grades(spark, d):
    spec = {"requireValid": True, "requiredPaths": ["k", "missing"], "equals": {"k": 8}, "schemaSubset": SCHEMA}
    rows = G.grade(_events(spark, d).withColumn("json_spec", F.lit(json.dumps(spec))))
    return rows.select("case_index", "passed", F.concat_ws(",", F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), c["passed"].cast("string")))).alias("checks"))


def _choice(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_index"), F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" ")).alias("answer"))
    allowed = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))
    rows = G.grade(o.withColumns({"choice_expected": F.lit("1-URGENT"), "choice_allowed": allowed}))
    return rows.select("case_index", "passed", F.concat_ws(",", F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), F.coalesce(c["details"], F.lit("ok"))))).alias("checks"))


def _number(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_index"), F.concat(F.lit("total="), (F.floor(F.col("o_totalprice"))).cast("string"), F.lit(" USD")).alias("answer"))
    value = F.col("n.value")
    rows = o.withColumn("n", G.number_result(F.col("answer"))).select("case_index", value.alias("value"), F.col("n.reason").alias("reason"), (F.abs(value - 150000) <= 50000).alias("expected_ok"), (value >= 1000).alias("min_ok"))
    return rows


def _number_checks(spark, d):
    """Number graders through ``grade``: no number, one found by a pattern, and bounds around it."""
    i = F.col("o_orderkey")
    text = F.when(i % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("v1 total="), F.floor("o_totalprice").cast("string")))
    o = table(spark, d, "orders").select(i.alias("case_index"), text.alias("answer"))
    rows = G.grade(o.withColumns({"number_expected": F.lit(150000.0), "number_tolerance": F.lit(50000.0), "number_min": F.lit(1000.0), "number_max": F.when(F.col("case_index") % 3 == 0, F.lit(180000.0)), "number_regex": F.lit("total=([0-9]+)")}))
    return rows.select("case_index", "passed", F.concat_ws(",", F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), c["passed"].cast("string"), F.lit("/"), F.coalesce(c["details"], F.lit(""))))).alias("checks"))


NUMBER_SQL = """WITH t AS (SELECT o_orderkey AS k, floor(o_totalprice) AS v FROM orders), c AS (SELECT k, k % 5 = 0 AS gone, v BETWEEN 100000 AND 200000 AS near, v >= 1000 AS low, k % 3 <> 0 OR v <= 180000 AS high FROM t)
SELECT k AS case_index, NOT gone AND near AND low AND high AS passed, CASE WHEN gone THEN 'number_found=false/number_not_found' ELSE 'number_expected=' || near || '/absolute_tolerance,number_min=' || low || '/' || CASE WHEN k % 3 = 0 THEN ',number_max=' || high || '/' ELSE '' END END AS checks FROM c"""


def _citations(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name", (F.col("s_nationkey") % 5).alias("x"), (F.col("s_suppkey") % 4).alias("y"))
    body = F.concat(F.col("s_name"), F.lit(" grew [S"), F.col("x").cast("string"), F.lit("]. It fell [S"), F.col("y").cast("string"), F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(F.lit("].")))
    spec = {"allowedSourceIds": ["S0", "S1", "S2"], "requiredSourceIds": ["S1"], "minCitedSources": 2}
    rows = G.grade(s.select(F.col("k").alias("case_index"), body.alias("answer")).withColumn("citation_spec", F.lit(json.dumps(spec))))
    return rows.select("case_index", "passed", F.concat_ws(",", F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), c["passed"].cast("string")))).alias("checks"))


CITATIONS_SQL = """WITH t AS (SELECT s_suppkey AS case_index, s_suppkey % 7 = 0 AS bad, s_nationkey % 5 AS x, s_suppkey % 4 AS y FROM supplier),
c AS (SELECT case_index, NOT bad AND x <= 2 AND y <= 2 AS ok, x = 1 OR (NOT bad AND y = 1) AS req, (x <= 2)::INT + (NOT bad AND y <= 2 AND y <> x)::INT >= 2 AS enough FROM t)
SELECT case_index, ok AND req AND enough AS passed, 'citation_allowed_sources=' || ok || ',citation_required_source=' || req || ',citation_min_sources=' || enough AS checks FROM c"""


def _verdict_texts(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pick = F.col("doc_id") % 8
    texts = [" A ", "B) clear", "The better response is B", "Response A is better than B", "a", "tie", "a good answer"]
    out = F.col("text")
    for i, x in enumerate(texts):
        out = F.when(pick == i, F.lit(x)).otherwise(out)
    return t.select("doc_id", out.alias("answer"))


def _verdict_sql(expr: str, name: str) -> str:
    cases_ = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate([" A ", "B) clear", "The better response is B", "Response A is better than B", "a", "tie", "a good answer"]))
    strip = f"regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g')"
    return f"WITH v AS (SELECT doc_id, CASE doc_id % 8 {cases_} ELSE coalesce(text, '') END AS x FROM documents), s AS (SELECT doc_id, {strip} AS t FROM v) SELECT doc_id, {expr} AS {name} FROM s"


def _redacted(spark, d):
    """Made-up secrets before and after the whole text; one row carries them in nested columns, too."""
    t = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    key = F.concat(F.lit("key sk-or-v1-"), F.col("doc_id").cast("string"), F.lit("_x and bearer  tok."), F.col("source"), F.lit("/9 end "))
    body = F.concat(key, F.col("text"), F.lit(" OPENROUTER_API_KEY = "), F.col("source"), F.lit("! done OTHER_API_KEY = kept"))
    nested = T.redact_table(t.select("doc_id", body.alias("text"), F.struct(F.array(key).alias("list"), F.create_map(F.lit("Bearer k"), key).alias("map")).alias("deep")))
    return nested.select("doc_id", F.md5("text").alias("digest"), F.right("text", F.lit(60)).alias("tail"), F.to_json("deep").alias("deep"))


_REDACT_SQL = f"regexp_replace(regexp_replace(regexp_replace({{0}}, 'sk-or-v1-[A-Za-z0-9_-]+', '[REDACTED]', 'g'), 'bearer{_SP}+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'gi'), '(OPENROUTER_API_KEY{_SP}*={_SP}*)[^{_SP[1:]}+', '\\1[REDACTED]', 'gi')"
REDACTED_SQL = f"""WITH t AS (SELECT doc_id, 'key sk-or-v1-' || doc_id || '_x and bearer  tok.' || source || '/9 end ' || coalesce(text, '') || ' OPENROUTER_API_KEY = ' || source || '! done OTHER_API_KEY = kept' AS body FROM documents),
r AS (SELECT doc_id, {_REDACT_SQL.format('body')} AS x FROM t)
SELECT doc_id, md5(x) AS digest, right(x, 60) AS tail, '{{"list":["key [REDACTED] and Bearer [REDACTED] end "],"map":{{"Bearer k":"key [REDACTED] and Bearer [REDACTED] end "}}}}' AS deep FROM r"""


def _configured(spark, d):
    i = F.col("case_index")
    rows = _docs(spark, d).select("case_index").withColumns(
        {
            "smoke_only": i % 10 == 0,
            "exact": F.when(i % 3 == 0, F.lit("x")),
            "must_include": F.when(i % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")),
            "contains_any": F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 == 1, F.array(F.lit("q"))),
            "min_length": F.when(i % 7 == 0, F.lit(3)),
            "choice_expected": F.when(i % 11 == 0, F.lit("y")),
        }
    )
    return rows.select("case_index", G.configured_checks(rows).cast("long").alias("checks"), G.tier(rows).alias("tier"))


def _cited_claims(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Revenue rose 12% "), F.repeat(F.lit("."), (F.col("n_nationkey") * 8).cast("int")), F.lit("[S1] and margin [S2]")).alias("answer"))
    return n.select("n_nationkey", S.claim_is_cited("revenue ROSE 12%", "S1", False)("answer").alias("in_window"), S.claim_is_cited("revenue rose 12%", "S1", True)("answer").alias("immediate"))


QUERIES = {
    "grade_exact": (lambda s, d: _one(s, d, exact=F.lit("x")), _list_sql("exact", ["a = 'x'"])),
    "grade_exact_normalized": (lambda s, d: _one(s, d, exact_normalized=F.when(F.col("case_index") % 3 == 0, "other").otherwise(F.concat(F.lit(" "), F.col("answer"), F.lit("\t")))), _list_sql("exact_normalized", ["doc_id % 3 <> 0"])),
    "normalized_text": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.normalize_text(F.coalesce("text", F.lit("")))).alias("digest")),
        f"SELECT doc_id, md5({NORM.format(chr(99) + 'oalesce(text, chr(32))')}) AS digest FROM documents",
    ),
    "grade_must_include": (lambda s, d: _one(s, d, must_include=_terms()), _list_sql("must_include", INCLUDES)),
    "grade_contains_any": (lambda s, d: _one(s, d, contains_any=_terms()), _list_sql("contains_any", ["(" + " OR ".join(INCLUDES) + ")"])),
    "grade_must_not_include": (lambda s, d: _one(s, d, must_not_include=_terms()), _list_sql("must_not_include", [f"NOT {t}" for t in INCLUDES])),
    "grade_regex": (lambda s, d: _one(s, d, regex=F.array(F.lit("th[ae] on"))), _list_sql("regex", ["regexp_matches(a, 'th[ae] on', 'i')"])),
    "grade_length": (lambda s, d: _one(s, d, min_length=F.lit(100), max_length=F.lit(3000)), _list_sql("min_length", ["length(a) >= 100"]).replace("'min_length=' || (length(a) >= 100)", "'min_length=' || (length(a) >= 100) || ',max_length=' || (length(a) <= 3000)").replace("AND (length(a) >= 100)", "AND length(a) BETWEEN 100 AND 3000")),
    "grade_choice": (
        _choice,
        """SELECT o_orderkey AS case_index, lower(o_orderpriority) = '1-urgent' AS passed, CASE WHEN lower(o_orderpriority) IN ('1-urgent', '2-high', '3-medium') THEN 'choice_valid=ok' ELSE 'choice_valid=choice_not_allowed' END
|| CASE WHEN lower(o_orderpriority) = '1-urgent' THEN ',choice_expected=ok' WHEN lower(o_orderpriority) IN ('2-high', '3-medium') THEN ',choice_expected=wrong_choice' ELSE ',choice_expected=choice_not_allowed' END AS checks FROM orders""",
    ),
    "grade_number": (_number, "SELECT o_orderkey AS case_index, CAST(floor(o_totalprice) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS reason, abs(floor(o_totalprice) - 150000) <= 50000 AS expected_ok, floor(o_totalprice) >= 1000 AS min_ok FROM orders"),
    "grade_number_checks": (_number_checks, NUMBER_SQL),
    "grade_json_paths": (
        _json_grades,
        "WITH t AS (SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT) AS k FROM events) SELECT event_id AS case_index, false AS passed, 'json_valid=true,json_required_path=true,json_required_path=false,json_equals=' || (k = 8) || ',json_schema_subset=' || (k BETWEEN 0 AND 99) AS checks FROM t",
    ),
    "grade_json_schema": (lambda s, d: _events(s, d).select("case_index", S.schema_match(SCHEMA | {"properties": {"k": {"type": "integer", "maximum": 50}}})("answer").alias("matches")), "SELECT event_id AS case_index, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT) <= 50 AS matches FROM events"),
    "grade_citations": (_citations, CITATIONS_SQL),
    "grade_claims": (_cited_claims, "SELECT n_nationkey, n_nationkey * 8 + 1 < 160 AS in_window, n_nationkey = 0 AS immediate FROM nation"),
    "configured_check_counts": (
        lambda s, d: _configured(s, d).select("case_index", "checks"),
        "SELECT doc_id AS case_index, CAST((doc_id % 3 = 0)::INT + 2 * (doc_id % 4 = 0)::INT + (doc_id % 5 = 1)::INT + (doc_id % 7 = 0)::INT + 2 * (doc_id % 11 = 0)::INT AS BIGINT) AS checks FROM documents",
    ),
    "tier_classification": (
        lambda s, d: _configured(s, d).select("case_index", "tier"),
        """WITH t AS (SELECT doc_id, doc_id % 10 = 0 AS smoke, doc_id % 3 = 0 OR doc_id % 11 = 0 AS x, doc_id % 4 = 0 OR doc_id % 5 = 1 OR doc_id % 7 = 0 AS y FROM documents)
SELECT doc_id AS case_index, CASE WHEN smoke THEN 'smoke_only' WHEN x AND y THEN 'mixed' WHEN x THEN 'structured_or_exact' WHEN y THEN 'surface_text' ELSE 'ungraded' END AS tier FROM t""",
    ),
    "check_kind_counts": (
        lambda s, d: G.check_kind_counts(G.grade(_docs(s, d).withColumns({"must_include": _terms(), "min_length": F.lit(5)}))),
        "SELECT CASE WHEN length(text) > 20000 THEN 'answer_size' ELSE k END AS kind, count(DISTINCT doc_id) AS cases FROM documents, (VALUES ('must_include'), ('min_length')) v(k) GROUP BY 1",
    ),
    "verdict_parse_ab": (
        lambda s, d: _verdict_texts(s, d).select("doc_id", T.verdict_ab(F.col("answer")).alias("verdict")),
        _verdict_sql("CASE WHEN t = 'A' OR t LIKE 'A.%' OR t LIKE 'A)%' OR upper(t) = 'A' THEN 'A' WHEN t = 'B' OR t LIKE 'B.%' OR t LIKE 'B)%' OR upper(t) = 'B' THEN 'B' WHEN len(list_distinct(regexp_extract_all(t, '\\b([AB])\\b', 1))) = 1 THEN regexp_extract(t, '\\b([AB])\\b', 1) END", "verdict"),
    ),
    "verdict_parse_tie": (lambda s, d: _verdict_texts(s, d).select("doc_id", T.verdict_tie(F.col("answer")).alias("verdict")), _verdict_sql("coalesce(nullif(regexp_extract(upper(t), '\\b(A|B|TIE)\\b', 1), ''), 'TIE')", "verdict")),
    "redacted_text": (_redacted, REDACTED_SQL),
    "model_scrub": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.scrub(F.coalesce("text", F.lit("")), ["the", "Tion"])).alias("digest")),
        "SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), 'tion', '[MODEL_REDACTED]', 'gi'), 'the', '[MODEL_REDACTED]', 'gi')) AS digest FROM documents",
    ),
    "retention_truncation": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"), F.length(T.truncate(F.col("text"), 500, "...")).alias("kept")),
        "SELECT doc_id, CAST(length(text) AS INT) AS chars, sha256(text) AS sha, CAST(CASE WHEN length(text) > 500 THEN 503 ELSE length(text) END AS INT) AS kept FROM documents",
    ),
    "path_tokens": (
        lambda s, d: table(s, d, "pages").select("page_id", F.concat_ws("|", T.path_tokens(F.coalesce("url", F.lit("")))).alias("tokens")),
        "SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(lower(coalesce(url, '')), '[^a-z0-9]+', '-', 'g'), '-'), lambda x: x <> ''), '|') AS tokens FROM pages",
    ),
    "none_answers": (lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.says_none(F.coalesce("text", F.lit(""))).alias("none")), f"SELECT conv_id, turn, regexp_replace(upper(coalesce(text, '')), '[^A-Z]', '', 'g') = 'NONE' OR regexp_replace(coalesce(text, ''), '^{_SP}+|{_SP}+$', '', 'g') = '' AS none FROM conversations"),
}
