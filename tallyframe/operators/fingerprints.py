"""Canonical digests of cases and case sets, keyed or not, and manifests that bind a report to its cases."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import structured as S


def case_digests(cases: DataFrame, json_col: str = "case_json") -> DataFrame:
    """(case_index, canonical_sha256) of each case's canonical JSON."""
    return cases.withColumn("canonical", S.canonical()(F.col(json_col))).select("case_index", F.sha2("canonical", 256).alias("canonical_sha256"))


def content_fingerprint(task: Column, constraints: Column, smoke_only: Column | None = None, grader: Column | None = None) -> Column:
    """What a model sees and how it is graded: ids, categories and difficulties don't count."""
    parts = [constraints.alias("constraints"), task.alias("task")]
    parts += [c.alias(n) for c, n in ((smoke_only, "smoke_only"), (grader, "grader")) if c is not None]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def manifest_rows(cases: DataFrame, key: bytes | None = None, domain: str = "manifest-hmac-v1", labels: bool = False) -> DataFrame:
    """line, public_id and row digest of each case; with a key the digests are HMACs, and labels are refused then."""
    if key is not None and labels:
        raise ValueError("a keyed manifest shows no labels")
    canonical = cases.withColumn("canonical", S.canonical()(F.col("case_json")))
    digest = S.hmac_of(key, domain, "canonical-row")(F.col("canonical")) if key is not None else F.sha2("canonical", 256)
    kept = ["case_index", "smoke_only", "tier"] + (["category"] if labels else [])
    return canonical.select(*kept, F.format_string("case_%04d", F.col("case_index") + 1).alias("public_id"), digest.alias("row_digest"))


def binding(manifest: dict, cases_digest: str, key_given: bool) -> str | None:
    """Why a manifest doesn't bind to the cases; null if it does."""
    keyed = manifest.get("algorithm") == "hmac-sha256"
    if keyed and not key_given:
        return "hmac_key_required"
    if not keyed and key_given:
        return "hmac_key_not_allowed"
    if not keyed and manifest.get("intendedUse") == "holdout":
        return "sha256_holdout_rejected"
    return None if manifest.get("digest") == cases_digest else "digest_mismatch"


def locate_mismatches(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """public_id and what differs, row by row."""
    a = manifest.select("public_id", F.col("row_digest").alias("was"))
    b = current.select("public_id", F.col("row_digest").alias("now"))
    both = a.join(b, "public_id", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("public_id", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("difference"))


def config_digest(config: dict, modes: list[str]) -> str:
    """Digest of the configuration fields that the evaluated modes use."""
    used = {k: v for k, v in config.items() if k != "modes"} | {"modes": {m: config.get("modes", {}).get(m) for m in sorted(modes)}}
    return hashlib.sha256(S.canonical_json(json.loads(json.dumps(used))).encode()).hexdigest()
