"""Provenance of runs: each supplier stands for one, its key says which modes ran and what is wrong with its prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import provenance as V
from tallyframe.plans import proxy as P

CONTENT = "resolved-run-config-v2"


def runs(s, d) -> DataFrame:
    k, lit = F.col("s_suppkey").cast("long"), F.lit
    bits = F.array_compact(F.array(*[F.when(k.bitwiseAND(1 << i) != 0, lit(c)) for i, c in enumerate(P.CONFIGS)]))
    configs = F.when(k % 13 == 0, F.concat(bits, F.array(lit("direct")))).otherwise(bits)
    heat = lambda t: F.struct(lit(t).alias("temperature"), lit(1).alias("topP"))
    order = F.when(k % 5 == 0, F.array(lit("acme/fast"))).when(k % 5 == 1, F.array(lit("acme"))).when(k % 5 == 2, F.array(lit("acme/fast"), lit("b"))).when(k % 5 == 3, F.array().cast("array<string>"))
    config = F.struct(
        F.concat(lit("run-"), k).alias("configId"), lit("p1").alias("promptVersion"), lit("dormant").alias("privateNote"),
        F.struct(F.concat(lit("m/d"), k % 5).alias("directModelId"), F.concat(lit("m/d"), k % 5).alias("selfReviewModelId"), lit("m/r").alias("repeatedModelId"), F.array(lit("m/c"), F.concat(lit("m/b"), k % 3)).alias("candidateModels"), lit("m/z").alias("aggregatorModelId")).alias("models"),
        F.struct((k % 4 * 0.25).alias("maxCostUsd"), lit(45000).alias("maxLatencyMs"), lit(2).alias("maxCandidates"), lit(900).alias("maxCompletionTokens"), lit(1).alias("maxRepairRounds")).alias("budget"),
        F.struct(F.when(k % 3 == 0, False).when(k % 3 == 1, k % 2 == 0).alias("allow_fallbacks"), order.alias("order")).alias("provider"),
        F.struct(lit(1729).alias("rootSeed"), lit(False).alias("sendSeeds"), heat(0.25).alias("direct"), heat(0.25).alias("selfReviewDraft"), heat(0.125).alias("selfReviewFinal"), heat(0.75).alias("repeatedSample"), heat(0.5).alias("fusionCandidate"), heat(0.125).alias("aggregator")).alias("sampling"),
        lit(False).alias("retainRawPrompt"), (k % 2 == 1).alias("retainOutputs"), lit(False).alias("retainProviderIds"),
    )
    return P.table(s, d, "supplier").select(k.alias("run_id"), configs.alias("configs"), F.to_json(config).alias("config"))


def prices(s, d) -> DataFrame:
    """What a run's modes need, but: one missing, one too many, one given twice, one given twice with another figure."""
    k, lit = F.col("run_id"), F.lit
    needed = V.required_models(runs(s, d)).where(~((k % 7 == 3) & (F.col("model_id") == "m/z")))
    more = runs(s, d).where(k % 11 == 4).select("run_id", lit("m/x").alias("model_id"))
    each = needed.unionByName(more).withColumn("copy", F.explode(F.when((k % 9 == 2) | (k % 9 == 5), F.array(lit(0), lit(1))).otherwise(F.array(lit(0)))))
    price = F.when((k % 9 == 2) & (F.col("copy") == 1), lit(0.5)).otherwise(lit(0.25))
    return each.select(
        "run_id", F.col("model_id").alias("modelId"), F.concat(lit("name of "), "model_id").alias("name"), lit(None).cast("string").alias("provider"), F.array(lit("top_p"), lit("seed")).alias("supportedParameters"),
        price.alias("promptPriceUsdPerToken"), lit(1.0).alias("completionPriceUsdPerToken"), lit("2026-01-01T00:00:00Z").alias("fetchedAt"), lit("s").alias("source"),
    )


_HEAT = """'{{"temperature":{},"topP":1}}'"""
_HAS = "list_contains(configs, '{}')"
_LIST = "'[' || array_to_string([{}], ',') || ']'"


def _object(fields: dict[str, tuple[str, str]]) -> str:
    """SQL of a JSON object: key -> (condition, SQL of its JSON text), keys in order."""
    items = ", ".join(f"CASE WHEN {cond} THEN '\"{key}\":' || {value} END" for key, (cond, value) in sorted(fields.items()))
    return f"'{{' || array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',') || '}}'"


_D, _S, _R, _F = (_HAS.format(c) for c in P.CONFIGS)
_MODELS = _object({"directModelId": (f"{_D} OR {_S}", "'\"m/d' || k % 5 || '\"'"), "selfReviewModelId": (_S, "'\"m/d' || k % 5 || '\"'"), "repeatedModelId": (_R, "'\"m/r\"'"), "candidateModels": (_F, "'[\"m/c\",\"m/b' || k % 3 || '\"]'"), "aggregatorModelId": (f"{_R} OR {_F}", "'\"m/z\"'")})
_SAMPLING = _object({
    "rootSeed": ("true", "'1729'"), "sendSeeds": ("true", "'false'"), "direct": (_D, _HEAT.format("0.25")), "selfReviewDraft": (_S, _HEAT.format("0.25")), "selfReviewFinal": (_S, _HEAT.format("0.125")), "repeatedSample": (_R, _HEAT.format("0.75")),
    "fusionCandidate": (_F, _HEAT.format("0.5")), "aggregator": (f"{_R} OR {_F}", _HEAT.format("0.125")),
})
_PROVIDER = _object({"allow_fallbacks": ("allowed IS NOT NULL", "allowed::VARCHAR"), "order": ("slugs IS NOT NULL", "'[' || array_to_string(list_transform(slugs, lambda x: '\"' || x || '\"'), ',') || ']'")})
_MODES = "'[' || array_to_string(list_transform(configs, lambda x: '\"' || x || '\"'), ',') || ']'"
_PRICE = """'{"completionPriceUsdPerToken":1,"fetchedAt":"2026-01-01T00:00:00Z","modelId":"' || m || '","name":"name of ' || m || '","promptPriceUsdPerToken":0.25,"source":"s","supportedParameters":["seed","top_p"]}'"""
PROVENANCE_SQL = f"""WITH b AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier),
c AS (SELECT k, list_concat(list_filter([{", ".join(f"CASE WHEN k & {1 << i} <> 0 THEN '{c}' END" for i, c in enumerate(P.CONFIGS))}], lambda x: x IS NOT NULL), CASE WHEN k % 13 = 0 THEN ['direct'] ELSE [] END) AS configs,
  CASE k % 3 WHEN 0 THEN false WHEN 1 THEN k % 2 = 0 END AS allowed, CASE k % 5 WHEN 0 THEN ['acme/fast'] WHEN 1 THEN ['acme'] WHEN 2 THEN ['acme/fast', 'b'] WHEN 3 THEN []::VARCHAR[] END AS slugs FROM b),
t AS (SELECT *, '{{"config":{{"budget":{{"maxCandidates":2,"maxCompletionTokens":900,"maxCostUsd":' || ['0', '0.25', '0.5', '0.75'][CAST(k % 4 AS INT) + 1] || ',"maxLatencyMs":45000,"maxRepairRounds":1}},"configId":"run-' || k || '","models":' || {_MODELS}
  || ',"promptVersion":"p1","provider":' || {_PROVIDER} || ',"retention":{{"retainOutputs":' || (k % 2 = 1)::VARCHAR || ',"retainProviderIds":false,"retainRawPrompt":false}},"sampling":' || {_SAMPLING} || '}},"content":"{CONTENT}","evaluatedConfigs":' || {_MODES} || ',"fingerprintVersion":"{V.FINGERPRINT}"}}' AS text,
  list_sort(list_distinct(list_concat(CASE WHEN {_D} OR {_S} THEN ['m/d' || k % 5] ELSE [] END, CASE WHEN {_R} THEN ['m/r', 'm/z'] ELSE [] END, CASE WHEN {_F} THEN ['m/c', 'm/b' || k % 3, 'm/z'] ELSE [] END))) AS needed FROM c),
p AS (SELECT *, list_sort(list_filter([CASE WHEN len(configs) = 0 THEN 'no_config' WHEN len(list_distinct(configs)) < len(configs) THEN 'repeated_config' END, CASE WHEN k % 7 = 3 AND list_contains(needed, 'm/z') THEN 'missing_price' END,
  CASE WHEN k % 11 = 4 THEN 'unexpected_price' END, CASE WHEN k % 9 = 2 AND len(list_filter(needed, lambda m: NOT (k % 7 = 3 AND m = 'm/z'))) > 0 THEN 'conflicting_price' END], lambda x: x IS NOT NULL)) AS problems FROM t)
SELECT k AS run_id, CASE WHEN len(problems) = 0 THEN sha256(text) END AS config_digest,
  CASE WHEN len(problems) = 0 THEN sha256('{{"content":"{V.PRICE_CONTENT}","entries":[' || array_to_string(list_transform(needed, lambda m: {_PRICE}), ',') || '],"evaluatedConfigs":' || {_MODES} || ',"fingerprintVersion":"{V.FINGERPRINT}"}}') END AS price_digest,
  CASE WHEN len(problems) = 0 THEN CAST(len(needed) AS INT) END AS models,
  CASE WHEN coalesce(allowed, true) THEN 'fallbacks_allowed' WHEN coalesce(len(slugs), 0) = 0 THEN 'not_configured' WHEN len(slugs) > 1 THEN 'multiple_provider_endpoints_allowed' WHEN contains(slugs[1], '/') THEN 'single_provider_endpoint_pinned' ELSE 'base_provider_slug_only' END AS pinning,
  CAST(coalesce(len(slugs), 0) AS INT) AS slugs, CAST(coalesce(len(list_filter(slugs, lambda x: contains(x, '/'))), 0) AS INT) AS full_slugs, array_to_string(problems, ',') AS problems FROM p"""

QUERIES = {"run_provenance": (lambda s, d: V.provenance(runs(s, d), prices(s, d), CONTENT), PROVENANCE_SQL)}
