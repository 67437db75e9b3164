"""Candidate blinding: candidates in an order that the task's hash decides, with aliases for them and for their claims, and back.

A request's row holds its few candidates; ledgers may name claims in any list, and all lists are mapped alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.rng import fnv1a
from tallyframe.operators.planning import blinded_order

LISTS = ("consensus", "adopted", "unique_adopted", "rejected")


def _mapped(pairs: Column, items: Column, source: str, target: str) -> Column:
    """Each id by its alias, or the other way; an id that no candidate has stays. Of repeated ids the first counts."""
    known = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p[source]), m).otherwise(F.map_concat(m, F.create_map(p[source], p[target]))))
    return F.transform(F.array(known), lambda m: F.transform(items, lambda i: F.coalesce(m[i], i)))[0]


def blind(requests: DataFrame) -> DataFrame:
    """``requests`` with seed, aliases (alias, model_id, id_digest), blinded candidates, claim_map (claim_id, alias) and mapped ledger lists.

    Requests: request, task, candidates (array of candidate_id, model_id, claims: array of claim_id, text) and any of LISTS (claim ids).
    The order is kept for an even hash of the task and reversed for an odd one. Null candidates or claims are none.
    """
    own = "array<struct<candidate_id:string,model_id:string,claims:array<struct<claim_id:string,text:string>>>>"
    seeded = requests.withColumn("seed", fnv1a(F.col("task"))).withColumn("ordered", blinded_order(F.coalesce("candidates", F.array().cast(own)), F.col("seed")))
    alias = lambda i: F.concat(F.lit("candidate_"), i + 1)
    claim = lambda i, j: F.concat(F.lit("candidate_"), i + 1, F.lit("_claim_"), j + 1)
    claims = lambda c: F.coalesce(c["claims"], F.array().cast("array<struct<claim_id:string,text:string>>"))
    named = F.transform("ordered", lambda c, i: F.struct(alias(i).alias("alias"), c["model_id"].alias("model_id"), F.sha2(c["candidate_id"], 256).alias("id_digest")))
    blinded = F.transform("ordered", lambda c, i: F.struct(alias(i).alias("candidate_id"), F.transform(claims(c), lambda x, j: F.struct(claim(i, j).alias("claim_id"), x["text"].alias("text"))).alias("claims")))
    pairs = F.flatten(F.transform("ordered", lambda c, i: F.transform(claims(c), lambda x, j: F.struct(x["claim_id"].alias("claim_id"), claim(i, j).alias("alias")))))
    out = seeded.withColumns({"aliases": named, "blinded": blinded, "claim_map": pairs}).drop("ordered", "candidates")
    return out.withColumns({c: _mapped(F.col("claim_map"), F.col(c), "claim_id", "alias") for c in LISTS if c in requests.columns})


def unblind(rows: DataFrame) -> DataFrame:
    """Ledger lists of ``blind`` by the claims' own ids again."""
    return rows.withColumns({c: _mapped(F.col("claim_map"), F.col(c), "alias", "claim_id") for c in LISTS if c in rows.columns})
