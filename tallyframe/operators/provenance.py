"""Run provenance: which models a run's modes use, what they cost, and digests that bind a report to both.

Runs: run_id, configs (the evaluated modes in order) and config (the resolved configuration as JSON text). Prices: run_id and
the columns of ``PRICE``. A digest covers only what the evaluated modes use: dormant keys, and roles and sampling of other
modes, don't count. All of a run's rows are few (its roles), so they meet in one row of its own.

Model ids are ordered by code points. Ids of other runs never meet; a run without prices has all of its models missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import structured as S
from tallyframe.operators import artifact as A
from tallyframe.operators.shapes import BOOL, COUNT, Shape, array, findings, nullable, obj, text

# Fixed values.
FINGERPRINT, CANONICAL, PRICE_CONTENT = A.PROVENANCE_FINGERPRINT, A.CANONICAL, A.PRICE_CONTENT
#: Role of a model -> modes that use it; and sampling settings -> modes that use them.
ROLES = {"directModelId": ("direct", "self_review"), "selfReviewModelId": ("self_review",), "repeatedModelId": ("repeated",), "candidateModels": ("fusion",), "aggregatorModelId": ("repeated", "fusion")}
SAMPLING = {
    "direct": ("direct",), "selfReviewDraft": ("self_review",), "selfReviewFinal": ("self_review",), "repeatedSample": ("repeated",), "fusionCandidate": ("fusion",), "aggregator": ("repeated", "fusion"),
}
PRICE = ("modelId", "name", "provider", "supportedParameters", "promptPriceUsdPerToken", "completionPriceUsdPerToken", "fetchedAt", "source")
BUDGET = ("maxCostUsd", "maxLatencyMs", "maxCandidates", "maxCompletionTokens", "maxRepairRounds")
PROVIDER = ("allow_fallbacks", "require_parameters", "data_collection", "zdr", "order")
RETENTION = ("retainRawPrompt", "retainOutputs", "retainProviderIds")
FULL_SLUG = "^[a-z0-9][a-z0-9_-]*/[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)*$"
SLUG = "^[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)*$"
# End of the fixed values.


def _uses(modes: tuple[str, ...]) -> Column:
    return F.arrays_overlap("configs", F.array(*map(F.lit, modes)))


def _get(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col("v"), f"$.{path}", kind)


def _parsed(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "configs", F.try_parse_json("config").alias("v"))


def config_problem(configs: Column) -> Column:
    """Why a list of modes can't be evaluated: empty, unknown or repeated ones; null if it can."""
    known = F.forall(configs, lambda c: F.coalesce(c.isin(*A.CONFIGS), F.lit(False)))
    return F.when(F.coalesce(F.size(configs), F.lit(0)) <= 0, "no_config").when(~known, "unknown_config").when(F.size(F.array_distinct(configs)) < F.size(configs), "repeated_config")


def required_models(runs: DataFrame) -> DataFrame:
    """(run_id, model_id): the different models that a run's modes use."""
    one = lambda role: F.array_compact(F.array(_get(f"models.{role}", "string")))
    many = lambda role: F.coalesce(_get(f"models.{role}", "array<string>"), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    ids = F.concat(*[F.when(_uses(modes), many(role) if role == "candidateModels" else one(role)).otherwise(none) for role, modes in ROLES.items()])
    return _parsed(runs).select("run_id", F.explode(F.array_distinct(ids)).alias("model_id"))


def canonical_prices(prices: DataFrame) -> DataFrame:
    """run_id, model_id and entry: a price as JSON with its parameters sorted; absent fields are left out."""
    fields = [F.sort_array("supportedParameters").alias("supportedParameters") if c == "supportedParameters" else F.col(c) for c in PRICE]
    return prices.select("run_id", F.col("modelId").alias("model_id"), S.canonical()(F.to_json(F.struct(*fields))).alias("entry"))


def price_problems(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """(run_id, model_id, problem): prices missing, unexpected, or given twice with different figures."""
    given = canonical_prices(prices).groupBy("run_id", "model_id").agg(F.min("entry").alias("least"), F.max("entry").alias("most"))
    both = required_models(runs).withColumn("needed", F.lit(True)).join(given, ["run_id", "model_id"], "full_outer")
    problem = F.when(F.col("needed").isNull(), "unexpected_price").when(F.col("least").isNull(), "missing_price").when(F.col("least") != F.col("most"), "conflicting_price")
    return both.select("run_id", "model_id", problem.alias("problem")).where("problem IS NOT NULL")


def resolved_config(runs: DataFrame, content: str) -> DataFrame:
    """run_id and config_text, the text whose digest names the configuration. ``content`` names its schema."""
    pick = lambda head, keys: F.struct(*[_get(f"{head}{k}").alias(k) for k in keys])
    roles = F.struct(*[F.when(_uses(modes), _get(f"models.{role}")).alias(role) for role, modes in ROLES.items()])
    settings = lambda k: F.when(_get(f"sampling.{k}").isNotNull(), pick(f"sampling.{k}.", ("temperature", "topP", "seed")))
    sampling = F.struct(_get("sampling.rootSeed").alias("rootSeed"), _get("sampling.sendSeeds").alias("sendSeeds"), *[F.when(_uses(modes), settings(k)).alias(k) for k, modes in SAMPLING.items()])
    config = F.struct(
        _get("configId").alias("configId"), _get("promptVersion").alias("promptVersion"), roles.alias("models"), pick("budget.", BUDGET).alias("budget"), pick("provider.", PROVIDER).alias("provider"),
        sampling.alias("sampling"), pick("", RETENTION).alias("retention"),
    )
    whole = F.struct(F.lit(FINGERPRINT).alias("fingerprintVersion"), F.lit(content).alias("content"), F.col("configs").alias("evaluatedConfigs"), config.alias("config"))
    return _parsed(runs).select("run_id", S.canonical()(F.to_json(whole)).alias("config_text"))


def pinning(allow_fallbacks: Column, order: Column) -> Column:
    """How far routing is bound to one provider's endpoint."""
    n = F.coalesce(F.size(order), F.lit(0))
    return (
        F.when(~F.coalesce(allow_fallbacks == F.lit(False), F.lit(False)), "fallbacks_allowed")
        .when(n <= 0, "not_configured")
        .when(n > 1, "multiple_provider_endpoints_allowed")
        .when(F.get(order, F.lit(0)).rlike(FULL_SLUG), "single_provider_endpoint_pinned")
        .otherwise("base_provider_slug_only")
    )


def provenance(runs: DataFrame, prices: DataFrame, content: str) -> DataFrame:
    """A row for each run: config_digest, price_digest, models, pinning, slugs, full_slugs and problems (sorted codes).

    Digests are null for a run with a problem: nothing is bound to a configuration or to prices that don't fit.
    """
    order = _get("provider.order", "array<string>")
    base = _parsed(runs).select(
        "run_id", "configs", pinning(_get("provider.allow_fallbacks", "boolean"), order).alias("pinning"), F.coalesce(F.size(order), F.lit(0)).alias("slugs"),
        F.coalesce(F.size(F.filter(order, lambda s: s.rlike(FULL_SLUG))), F.lit(0)).alias("full_slugs"), F.when(F.col("v").isNull(), "malformed_config").otherwise(config_problem(F.col("configs"))).alias("config_problem"),
    )
    wrong = price_problems(runs, prices).groupBy("run_id").agg(F.collect_set("problem").alias("price_problems"))  # three codes at most
    needed = required_models(runs).join(canonical_prices(prices).distinct(), ["run_id", "model_id"])
    entries = needed.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("model_id", "entry"))).alias("e"))  # the run's roles
    head = F.concat(F.lit('{"content":"' + PRICE_CONTENT + '","entries":['), F.concat_ws(",", F.transform("e", lambda x: x["entry"])), F.lit('],"evaluatedConfigs":'), F.to_json("configs"), F.lit(f',"fingerprintVersion":"{FINGERPRINT}"}}'))
    rows = base.join(resolved_config(runs, content), "run_id").join(entries, "run_id", "left").join(wrong, "run_id", "left")
    problems = F.array_sort(F.array_compact(F.concat(F.coalesce("price_problems", F.array().cast("array<string>")), F.array("config_problem"))))
    sound = F.size(problems) == 0
    return rows.select(
        "run_id", F.when(sound, F.sha2("config_text", 256)).alias("config_digest"), F.when(sound, F.sha2(head, 256)).alias("price_digest"), F.when(sound, F.size("e")).alias("models"), "pinning", "slugs", "full_slugs",
        F.concat_ws(",", problems).alias("problems"),
    )


_DIGEST = obj(algorithm=text("sha256"), sha256=text(pattern="^[a-f0-9]{64}$"), digestDisclosure=text("private_report_only"))
_BOUND, _OMITTED = text("private_report_bound"), text("omitted")
INVOCATION = obj(
    assertion=text("self_reported_private_metadata"), content=text("normalized-cli-invocation-v1"), interface=text("cli_eval"), command=text("eval"), rawArgvDisclosure=_OMITTED, pathDisclosure=_OMITTED,
    environmentDisclosure=_OMITTED, caseSource=obj(sourceKind=text("jsonl_file"), pathDisclosure=_OMITTED),
)
ROUTING = obj(
    "routing", status=_BOUND, content=text(A.ROUTING_CONTENT), providerEndpointPinning=text(*A.PINNINGS), allowFallbacks=nullable(BOOL), orderedProviderSlugs=array(text(pattern=SLUG)), orderSlugCount=COUNT, fullEndpointSlugCount=COUNT,
    detailDisclosure=text("private_report_only"),
)
DOCUMENT = obj(
    "", ("invocation", "openRouterRequestPolicy"), schemaVersion=text(pattern=A.PROVENANCE_VERSION), fingerprintVersion=text(FINGERPRINT), canonicalization=text(CANONICAL), evaluatedConfigs=array(text(*A.CONFIGS), least=1),
    invocation=INVOCATION, openRouterRequestPolicy=Shape("any"), providerRouting=ROUTING,
    config=obj(status=_BOUND, sourceKind=text("default_config", "config_file", "caller_provided"), content=text(pattern=A.CONFIG_CONTENT), resolvedConfigDigest=_DIGEST, pathDisclosure=_OMITTED),
    modelPriceSnapshot=obj(status=_BOUND, sourceKind=text("models_file", "caller_provided"), content=text(PRICE_CONTENT), effectiveModelCount=COUNT, effectivePriceSnapshotDigest=_DIGEST, pathDisclosure=_OMITTED),
)


def routing_sound(v: Column) -> Column:
    """The stated pinning and counts are those of the stated slugs."""
    get = lambda p, t: F.try_variant_get(v, f"$.{p}", t)
    slugs = get("orderedProviderSlugs", "array<string>")
    full = F.size(F.filter(slugs, lambda s: s.rlike(FULL_SLUG)))
    return (get("providerEndpointPinning", "string") == pinning(get("allowFallbacks", "boolean"), slugs)) & (get("orderSlugCount", "double") == F.size(slugs)) & (get("fullEndpointSlugCount", "double") == full)


def document_findings(documents: DataFrame, id_col: str = "run_id", body_col: str = "body") -> DataFrame:
    """run_id, path, code of every departure of a provenance document from its shape, its routing from its slugs, and repeated modes."""
    rows = documents.select(F.col(f"`{id_col}`").alias("run_id"), F.try_parse_json(F.col(f"`{body_col}`")).alias("v"), F.array().cast("array<string>").alias("keys"))
    named = F.try_variant_get("v", "$.evaluatedConfigs", "array<string>")
    repeated = rows.where(F.size(F.array_distinct(named)) < F.size(named)).select("run_id", F.lit("evaluatedConfigs").alias("path"), F.lit("broken_rule").alias("code"))
    return findings(rows, DOCUMENT, "run_id", "v", "keys", {"routing": routing_sound}).unionByName(repeated)
