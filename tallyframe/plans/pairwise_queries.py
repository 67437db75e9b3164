"""Pairwise queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import pairwise as W
from tallyframe.plans import proxy as P

JUDGED_SQL = (
    P.VOTES_SQL
    + """,
w AS (SELECT doc_id, source, judge, CASE WHEN verdict = 'TIE' THEN 'tie' WHEN ("order" = 1) = (verdict = 'A') THEN 'challenger' ELSE 'baseline' END AS s FROM votes),
j AS (SELECT doc_id, source, judge, CASE WHEN count(DISTINCT s) = 1 AND count(*) = 2 THEN min(s) ELSE 'tie' END AS outcome FROM w GROUP BY ALL),
p AS (SELECT doc_id, source, CASE WHEN count(*) FILTER (WHERE outcome = 'challenger') > count(*) / 2 THEN 'challenger' WHEN count(*) FILTER (WHERE outcome = 'baseline') > count(*) / 2 THEN 'baseline' ELSE 'tie' END AS outcome, count(*) AS judges FROM j GROUP BY ALL)"""
)
KEYS = ["doc_id", "source"]


def _panel(s, d):
    return W.panel(W.counterbalanced(P.votes(s, d), KEYS), KEYS)


def _pools(s, d):
    return W.pool_of(P.table(s, d, "documents").select("source", "doc_id", "n_chars", F.floor(F.col("doc_id") / 640).alias("heat")).withColumn("grp", F.concat_ws("/", "source", "heat")), "grp", ["doc_id"], ["doc_id", "n_chars"])


def _more_chars(a, b):
    """The longer text wins; of equal ones the lower id."""
    key = lambda x: F.struct(x["n_chars"], -x["doc_id"])
    return F.when(key(a) >= key(b), a).otherwise(b)


GROUPS_SQL = "g AS (SELECT source || '/' || (doc_id // 640) AS grp, doc_id, n_chars FROM documents)"

QUERIES = {
    "counterbalanced_verdicts": (lambda s, d: W.counterbalanced(P.votes(s, d), KEYS), f"WITH {JUDGED_SQL} SELECT doc_id, source, judge, outcome FROM j"),
    "panel_majority": (_panel, f"WITH {JUDGED_SQL} SELECT doc_id, source, outcome, judges FROM p"),
    "pair_tally": (
        lambda s, d: W.tally(_panel(s, d), "source"),
        f"""WITH {JUDGED_SQL}, c AS (SELECT source, count(*) AS judged, count(*) FILTER (WHERE outcome = 'challenger') AS wins, count(*) FILTER (WHERE outcome = 'baseline') AS losses, count(*) FILTER (WHERE outcome = 'tie') AS ties FROM p GROUP BY source)
SELECT *, wins * 100.0::DOUBLE / judged AS wins_pct, losses * 100.0::DOUBLE / judged AS losses_pct, ties * 100.0::DOUBLE / judged AS ties_pct FROM c""",
    ),
    "tournament_winner": (
        lambda s, d: W.tournament(_pools(s, d), "grp", 640, _more_chars)[0].select("grp", "winner.doc_id"),
        f"WITH {GROUPS_SQL} SELECT grp, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM g GROUP BY grp",
    ),
    "tournament_rounds": (
        lambda s, d: W.tournament(_pools(s, d), "grp", 640, _more_chars)[1].groupBy("grp").agg(F.count(F.lit(1)).alias("matches")),
        f"WITH {GROUPS_SQL} SELECT grp, count(*) - 1 AS matches FROM g GROUP BY grp HAVING count(*) > 1",
    ),
    "first_round_pairs": (
        lambda s, d: W.round_pairs(_pools(s, d), "grp", 0).select("grp", "match", F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")),
        f"""WITH {GROUPS_SQL}, p AS (SELECT grp, doc_id, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS place FROM g),
m AS (SELECT grp, CAST(place // 2 AS INT) AS match, min(doc_id) AS f, max(doc_id) AS l, count(*) AS n FROM p GROUP BY ALL)
SELECT grp, match, CASE WHEN n = 2 AND match % 2 = 1 THEN l ELSE f END AS a, CASE WHEN n = 2 THEN CASE WHEN match % 2 = 1 THEN f ELSE l END END AS b FROM m""",
    ),
    "unparseable_share": (
        lambda s, d: W.unparseable_share(P.votes(s, d), T.verdict_ab(F.col("verdict"))),
        f"WITH {P.VOTES_SQL} SELECT count(*) AS matches, count(*) FILTER (WHERE verdict = 'TIE') / count(*) AS unparseable_share FROM votes",
    ),
    "arm_means": (
        lambda s, d: W.arm_means(P.attempts(s, d), "config_id", ["cost_micro", "latency_ms"]),
        f"WITH {P.ATTEMPTS_SQL} SELECT config_id, CAST(sum(cost_micro) AS BIGINT) / count(*) AS mean_cost_micro, CAST(sum(latency_ms) AS BIGINT) / count(*) AS mean_latency_ms FROM attempts GROUP BY config_id",
    ),
    "judgeable_pairs": (
        lambda s, d: W.judgeable(P.table(s, d, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")), P.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("answer"))),
        "WITH f AS (SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '') SELECT doc_id AS a, doc_id + 1 AS b FROM f WHERE doc_id + 1 IN (SELECT doc_id FROM f)",
    ),
}
