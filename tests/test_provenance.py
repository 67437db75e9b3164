import copy
import hashlib
import json

from tallyframe.functions.structured import canonical_json
from tallyframe.operators import artifact as A
from tallyframe.operators import provenance as V

CONFIG = {
    "configId": "c", "promptVersion": "p", "secret": "x", "models": {"directModelId": "d/m", "selfReviewModelId": "d/m", "repeatedModelId": "d/m", "candidateModels": ["c/b", "c/a"], "aggregatorModelId": "a/m"},
    "budget": {"maxCostUsd": 0.05, "maxLatencyMs": 45000, "maxCandidates": 2, "maxCompletionTokens": 900, "maxRepairRounds": 1}, "provider": {"allow_fallbacks": False, "order": ["acme/fast"], "zdr": False},
    "sampling": {"rootSeed": 1729, "sendSeeds": False, "direct": {"temperature": 0.2, "topP": 1}, "aggregator": {"temperature": 1e-7}}, "retainRawPrompt": False, "retainOutputs": False, "retainProviderIds": False,
}
PRICES = "run_id int, modelId string, name string, provider string, supportedParameters array<string>, promptPriceUsdPerToken double, completionPriceUsdPerToken double, fetchedAt string, source string"


def _price(run, model, cost=1e-7, params=("b", "a")):
    return (run, model, None, None, list(params), cost, 2e-6, "2026-01-01T00:00:00Z", "s")


def _sha(value):
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def test_digests_cover_what_the_modes_use(spark):
    dormant, budget = copy.deepcopy(CONFIG), copy.deepcopy(CONFIG)
    dormant["secret"], dormant["models"]["aggregatorModelId"], dormant["sampling"]["aggregator"] = "other", "z/z", None
    budget["budget"]["maxCostUsd"] = 0.06
    runs = [(0, ["direct"], CONFIG), (1, ["direct"], dormant), (2, ["direct"], budget), (3, ["fusion", "direct"], CONFIG)]
    table = spark.createDataFrame([(i, c, json.dumps(x)) for i, c, x in runs], "run_id int, configs array<string>, config string")
    assert sorted((r["run_id"], r["model_id"]) for r in V.required_models(table).where("run_id = 3").collect()) == [(3, "a/m"), (3, "c/a"), (3, "c/b"), (3, "d/m")]
    prices = spark.createDataFrame([_price(i, "d/m") for i in range(4)] + [_price(3, m) for m in ("a/m", "c/a", "c/b")] + [_price(0, "d/m", params=("a", "b"))], PRICES)
    got = {r["run_id"]: r for r in V.provenance(table, prices, "resolved-acme-config-v2").collect()}
    assert all(r["problems"] == "" for r in got.values()) and got[0]["config_digest"] == got[1]["config_digest"] != got[2]["config_digest"]
    config = {
        "configId": "c", "promptVersion": "p", "models": {"directModelId": "d/m"}, "budget": CONFIG["budget"], "provider": CONFIG["provider"], "retention": {k: False for k in V.RETENTION},
        "sampling": {"rootSeed": 1729, "sendSeeds": False, "direct": {"temperature": 0.2, "topP": 1}},
    }
    assert got[0]["config_digest"] == _sha({"fingerprintVersion": V.FINGERPRINT, "content": "resolved-acme-config-v2", "evaluatedConfigs": ["direct"], "config": config})
    entry = lambda m: {"modelId": m, "supportedParameters": ["a", "b"], "promptPriceUsdPerToken": 1e-7, "completionPriceUsdPerToken": 2e-6, "fetchedAt": "2026-01-01T00:00:00Z", "source": "s"}
    assert got[3]["price_digest"] == _sha({"fingerprintVersion": V.FINGERPRINT, "content": V.PRICE_CONTENT, "evaluatedConfigs": ["fusion", "direct"], "entries": [entry(m) for m in ("a/m", "c/a", "c/b", "d/m")]})
    assert (got[0]["pinning"], got[0]["slugs"], got[0]["full_slugs"], got[3]["models"]) == ("single_provider_endpoint_pinned", 1, 1, 4)


def test_problems_leave_no_digest(spark):
    text = json.dumps(CONFIG)
    rows = [(0, ["direct"], text), (1, ["direct"], text), (2, ["direct"], text), (3, [], text), (4, ["direct", "direct"], text), (5, ["odd"], text), (6, ["direct"], "{"), (7, None, text)]
    table = spark.createDataFrame(rows, "run_id int, configs array<string>, config string")
    prices = spark.createDataFrame([_price(1, "d/m"), _price(1, "x/x"), _price(2, "d/m"), _price(2, "d/m", 0.5), _price(4, "d/m"), _price(6, "d/m")], PRICES)
    got = {r["run_id"]: r for r in V.provenance(table, prices, "resolved-acme-config-v2").collect()}
    assert {i: r["problems"] for i, r in got.items()} == {0: "missing_price", 1: "unexpected_price", 2: "conflicting_price", 3: "no_config", 4: "repeated_config", 5: "unknown_config", 6: "malformed_config,unexpected_price", 7: "no_config"}
    assert all(r["config_digest"] is None and r["price_digest"] is None and r["models"] is None for r in got.values())
    assert V.provenance(table.limit(0), prices, "c").collect() == []


def test_documents(spark):
    digest = {"algorithm": "sha256", "sha256": "0" * 64, "digestDisclosure": "private_report_only"}
    sound = {
        "schemaVersion": "acme-run-provenance-v2", "fingerprintVersion": V.FINGERPRINT, "canonicalization": V.CANONICAL, "evaluatedConfigs": ["direct", "fusion"],
        "providerRouting": {"status": "private_report_bound", "content": A.ROUTING_CONTENT, "providerEndpointPinning": "base_provider_slug_only", "allowFallbacks": False, "orderedProviderSlugs": ["acme"], "orderSlugCount": 1, "fullEndpointSlugCount": 0, "detailDisclosure": "private_report_only"},
        "config": {"status": "private_report_bound", "sourceKind": "config_file", "content": "resolved-acme-config-v2", "resolvedConfigDigest": digest, "pathDisclosure": "omitted"},
        "modelPriceSnapshot": {"status": "private_report_bound", "sourceKind": "models_file", "content": V.PRICE_CONTENT, "effectiveModelCount": 2, "effectivePriceSnapshotDigest": digest, "pathDisclosure": "omitted"},
    }
    docs = [sound, sound | {"evaluatedConfigs": ["direct", "direct"]}, sound | {"providerRouting": sound["providerRouting"] | {"orderedProviderSlugs": ["acme/fast"]}}, sound | {"invocation": {}}, sound | {"config": sound["config"] | {"path": "/x"}}]
    table = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "run_id int, body string")
    got = sorted(map(tuple, V.document_findings(table).collect()))
    assert got[0] == (1, "evaluatedConfigs", "broken_rule") and got[1] == (2, "providerRouting", "broken_rule") and got[-1] == (4, "config.path", "unknown_key")
    assert {g[1:] for g in got if g[0] == 3} == {(f"invocation.{k}", "missing_key") for k, _, _ in V.INVOCATION.fields}
