"""Case-set manifests: canonical rows, one digest over all of them in order, header, rows, readiness, and their shape.

The digest of a set is that of one long canonical JSON text. It is never held: rows are range-partitioned by case and
sorted, and one task runs over the partitions in order and updates the hash, a batch at a time. SHA-256 itself has no
parallel form; what passes through that task is the canonical rows, in which texts are digests.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import structured as S
from tallyframe.operators import artifact as A
from tallyframe.operators.shapes import BOOL, COUNT, Shape, array, findings, nullable, obj, record, text

# Fixed values.
FINGERPRINT, CANONICAL, CONTENT = A.FINGERPRINT, A.CANONICAL, A.MANIFEST_CONTENT
USES = ("dev", "public_sample", "holdout")
KINDS = ("exact", "exactNormalized", "mustInclude", "containsAny", "mustNotInclude", "regex", "length", "choice", "json", "number", "citations")
READINESS = (
    "This manifest freezes case-set identity only; it does not prove benchmark validity.",
    "No-spend validation cannot prove that prompts, models, or graders were not tuned against this case set.",
)
# End of the fixed values.


def utf16_length(x: Column) -> Column:
    """UTF-16 units of a string."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("long")


def canonical_cases(cases: DataFrame) -> DataFrame:
    """case_index and canonical: a case's identity as canonical JSON, with digests of its texts and its whole grader.

    ``cases`` as ``read_cases`` gives them: id, task, constraints, category, difficulty, smoke_only and raw, the case's own line.
    """
    listed = F.coalesce("constraints", F.array().cast("array<string>"))
    texts = S.canonical()(F.to_json(listed))
    base = F.to_json(
        F.struct(
            "id", F.sha2("task", 256).alias("taskHash"), utf16_length(F.col("task")).alias("taskLength"), F.sha2(texts, 256).alias("constraintsHash"), F.size(listed).alias("constraintsCount"),
            "category", "difficulty", F.coalesce("smoke_only", F.lit(False)).alias("smokeOnly"),
        ),
        {"ignoreNullFields": "false"},
    )
    grader = F.coalesce(F.to_json(F.expr("try_variant_get(try_parse_json(raw), '$.grader', 'variant')")), F.lit("null"))
    whole = F.concat(F.expr("'{'"), F.expr("'\"grader\":'"), grader, F.lit(","), base.substr(F.lit(2), F.length(base)))
    return cases.select("*", S.canonical()(whole).alias("canonical"))


def _hash(key: bytes | None, purpose: str, domain: str):
    """An object with update and hexdigest: SHA-256, or HMAC-SHA-256 over domain, purpose and text, parted by NUL."""
    if key is None:
        return hashlib.sha256()
    if len(key) < 32:
        raise ValueError("the key has fewer than 32 bytes")
    return hmac.new(key, b"\0".join([domain.encode(), purpose.encode(), b""]), hashlib.sha256)


def streamed_digest(rows: DataFrame, order_col: str, text_col: str, head: str, tail: str, key: bytes | None = None, domain: str = "manifest-hmac-v1", purpose: str = "canonical-case-set") -> DataFrame:
    """One row with ``digest`` of head, the texts in order parted by commas, and tail.

    Rows are sorted in ranges; one task reads these in order and holds a batch. No row at all gives head and tail.
    """
    _hash(key, purpose, domain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = _hash(key, purpose, domain)
        h.update(head.encode())
        first = True
        for batch in batches:
            for value in batch.column(0).to_pylist():
                h.update(value.encode() if first else b"," + value.encode())
                first = False
        h.update(tail.encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], ["digest"])

    return rows.orderBy(order_col).select(text_col).coalesce(1).mapInArrow(run, "digest string")


def set_digest(canonical: DataFrame, intended_use: str | None = None, key: bytes | None = None, domain: str = "manifest-hmac-v1") -> str:
    """The digest of the set ``canonical_cases`` gives; without intended use that of its bare fingerprint."""
    use = "" if intended_use is None else f',"intendedUse":"{intended_use}"'
    head, tail = '{"cases":[', f'],"fingerprintVersion":"{FINGERPRINT}"{use}}}'
    found = streamed_digest(canonical, "case_index", "canonical", head, tail, key, domain).first()
    if found is None:
        h = _hash(key, "canonical-case-set", domain)
        h.update((head + tail).encode())
        return h.hexdigest()
    return found["digest"]


def grader_kinds() -> Column:
    """Kinds of deterministic checks that a case's grader configures, in their fixed order; from the case's own line."""
    g = lambda p, t="variant": F.expr(f"try_variant_get(try_parse_json(raw), '$.grader.{p}', '{t}')")
    there = lambda p: g(p).isNotNull()
    some = lambda p: F.coalesce(F.size(g(p, "array<variant>")) > 0, F.lit(False))
    filled = lambda p: F.coalesce(F.size(g(p, "map<string,variant>")) > 0, F.lit(False))
    tests = {
        "exact": there("exact"), "exactNormalized": there("exactNormalized"), **{k: some(k) for k in ("mustInclude", "containsAny", "mustNotInclude", "regex")}, "length": there("minLength") | there("maxLength"), "choice": there("choice.expected"),
        "json": F.coalesce(g("json.requireValid", "boolean"), F.lit(False)) | some("json.requiredPaths") | filled("json.equals") | filled("json.includes") | filled("json.arrayMinLength") | there("json.schemaSubset"),
        "number": there("number.expected") | there("number.min") | there("number.max"), "citations": there("citations"),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


def manifest_rows(cases: DataFrame, labels: bool = False, ids: bool = False, key: bytes | None = None, domain: str = "manifest-hmac-v1") -> DataFrame:
    """Rows of a manifest: case_index, line, publicId, smokeOnly, graderKinds, graderEvidenceTier, digests, and, where asked for, id and category.

    ``cases``: ``canonical_cases`` with line and tier. A keyed manifest shows neither ids nor labels.
    """
    if key is not None and (labels or ids):
        raise ValueError("a keyed manifest shows no ids and no labels")
    suffix = "Sha256" if key is None else "HmacSha256"
    digest = (lambda c, _: F.sha2(c, 256)) if key is None else (lambda c, purpose: S.hmac_of(key, domain, purpose)(c))
    kinds, none = grader_kinds(), F.array().cast("array<string>")
    return cases.select(
        "case_index", "line", F.format_string("case_%04d", F.col("case_index") + 1).alias("publicId"), F.col("smoke_only").alias("smokeOnly"), F.when(F.col("smoke_only"), none).otherwise(kinds).alias("graderKinds"),
        F.col("tier").alias("graderEvidenceTier"), F.when(F.col("smoke_only") & (F.size(kinds) > 0), kinds).alias("ignoredSmokeOnlyGraderKinds"), digest(F.col("canonical"), "canonical-row").alias(f"canonicalRow{suffix}"),
        digest(F.col("raw"), "raw-line").alias(f"rawLine{suffix}"), *([F.col("id")] if ids else []), *([F.col("category")] if labels else []),
    )


def header_counts(cases: DataFrame) -> DataFrame:
    """One row with the counts of a manifest's summary. ``cases``: smoke_only, category, difficulty, tier, checks and raw."""
    scored = ~F.col("smoke_only")
    kinds = grader_kinds()
    one = lambda k: F.count_if(scored & F.array_contains("kinds", k)).alias(f"kind_{k}")
    ignored = lambda k: F.count_if(~scored & F.array_contains("kinds", k)).alias(f"ignored_{k}")
    levels = [F.count_if(F.col("difficulty") == d).alias(f"difficulty_{d}") for d in ("easy", "medium", "hard")] + [F.count_if(scored & (F.col("difficulty") == d)).alias(f"scored_difficulty_{d}") for d in ("easy", "medium", "hard")]
    whole = cases.withColumn("kinds", kinds).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(scored).alias("scored_cases"), F.count_if(~scored).alias("smoke_cases"), F.count_if(F.col("category").isNull()).alias("uncategorized"), F.count_if(scored & F.col("category").isNull()).alias("scored_uncategorized"),
        F.count_if(scored & F.col("difficulty").isNull()).alias("scored_no_difficulty"), F.count_if(~scored & F.col("difficulty").isNull()).alias("smoke_no_difficulty"), *levels, *[one(k) for k in KINDS], *[ignored(k) for k in KINDS],
        *[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in A.TIERS], F.count_if(~scored & (F.size("kinds") > 0)).alias("ignored_cases"),
        F.coalesce(F.sum(F.when(scored, F.col("checks"))), F.lit(0)).alias("checks"), F.coalesce(F.sum(F.when(~scored, F.col("checks"))), F.lit(0)).alias("ignored_checks"),
    )
    sizes = cases.where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(scored).alias("s"))
    of = lambda f, c: F.coalesce(f(c), F.lit(0))
    some = F.when(F.col("s") > 0, F.col("s"))
    balance = sizes.agg(F.count(F.lit(1)).alias("categories"), of(F.min, "n").alias("least"), of(F.max, "n").alias("most"), F.count(some).alias("scored_categories"), of(F.min, some).alias("scored_least"), of(F.max, some).alias("scored_most"))
    return whole.join(balance)  # one row each


def readiness(counts: dict, intended_use: str, keyed: bool) -> list[str]:
    """Codes of a manifest's warnings, in their order: what its figures do not support."""
    surface, structured = counts["tier_surface_text"] + counts["tier_mixed"], counts["tier_structured_or_exact"] + counts["tier_mixed"]
    rules = [
        ("identity_only", True), ("tuning_not_excluded", True), ("not_a_holdout", intended_use != "holdout"), ("holdout_needs_process_evidence", intended_use == "holdout"), ("fewer_than_100_scored", counts["scored_cases"] < 100),
        ("difficulty_missing", counts["scored_no_difficulty"] > 0), ("difficulty_below_floor", min(counts[f"scored_difficulty_{d}"] for d in ("easy", "medium", "hard")) < 30), ("surface_text_evidence", surface > 0),
        ("mechanical_evidence", structured > 0), ("keyed_digests_need_the_key", keyed), ("structure_stays_visible", keyed),
    ]
    return [code for code, fires in rules if fires]


_HEX = text(pattern="^[0-9a-f]{64}$")
_ROW = {"line": COUNT, "publicId": text(pattern="^case_[0-9]{4,}$"), "smokeOnly": BOOL, "graderKinds": array(text(*KINDS)), "graderEvidenceTier": text(*A.TIERS), "ignoredSmokeOnlyGraderKinds": array(text(*KINDS), least=1)}


def shape(keyed: bool) -> Shape:
    """What a manifest document must look like, sha256 or keyed. Its summary is checked for its counts, not for its sums."""
    counts = lambda *names: obj(**{n: COUNT for n in names})
    levels, kinds, free = counts("easy", "medium", "hard"), counts(*KINDS), ("categoryCounts", "scoredCategoryCounts", "scoredCategoryNonSurfaceGraderEvidenceCounts")
    summary = obj(
        "", free, caseCount=COUNT, scoredCaseCount=COUNT, smokeOnlyCaseCount=COUNT, categoryBalance=counts("categoryCount", "minCasesPerCategory", "maxCasesPerCategory", "uncategorizedCaseCount"),
        scoredCategoryBalance=counts("categoryCount", "minScoredCasesPerCategory", "maxScoredCasesPerCategory", "scoredUncategorizedCaseCount"),
        difficultyCoverage=obj(difficultyCounts=levels, scoredDifficultyCounts=levels, scoredCasesMissingDifficultyCount=COUNT, smokeOnlyCasesMissingDifficultyCount=COUNT), casesWithGraderKind=kinds,
        graderEvidence=obj(
            version=text(A.TIER_VERSION), tierCounts=counts(*A.TIERS), smokeOnlyCasesWithConfiguredGraderCount=COUNT, ignoredSmokeOnlyConfiguredGraderKindCounts=kinds, ignoredSmokeOnlyConfiguredCheckCount=COUNT
        ),
        totalConfiguredChecks=COUNT, **{n: Shape("any") for n in free},
    )
    kind = "HmacSha256" if keyed else "Sha256"
    privacy = {"includesCaseIds": BOOL, "includesCategoryLabels": BOOL, "rowHashesCanLinkPublicCases": BOOL, "rowHashesIncludeGraderValues": BOOL, "rowHashesAreUnsalted": BOOL}
    if keyed:
        privacy |= {"rowHashesAreKeyed": BOOL, "hashPrivacy": text("private_audit_hmac_sha256"), "structuralMetadataVisible": BOOL}
    row = _ROW | {f"canonicalRow{kind}": _HEX, f"rawLine{kind}": _HEX} | ({} if keyed else {"id": text(), "category": text()})
    source = {f"rawFile{kind}": _HEX} | ({} if keyed else {"path": text()})
    return obj(
        schemaVersion=text(pattern=A.MANIFEST_VERSION), fingerprintVersion=text(FINGERPRINT), intendedUse=text(*USES), source=obj("", tuple(source), **source),
        fingerprint=obj(algorithm=text("hmac-sha256" if keyed else "sha256"), canonicalization=text(CANONICAL), content=text(CONTENT), **{f"canonical{kind}": _HEX}), privacy=obj(**privacy), summary=summary,
        claimReadiness=obj(status=text("requires_private_audit", "not_claim_ready"), warnings=array(text())), rows=array(obj("", ("ignoredSmokeOnlyGraderKinds", f"rawLine{kind}", "id", "category"), **row)),
    )


def shape_findings(documents: DataFrame, keyed: bool = False, id_col: str = "manifest_id", body_col: str = "body") -> DataFrame:
    """manifest_id, path, code of every departure of a manifest document from its shape."""
    rows = documents.select(F.col(f"`{id_col}`").alias("manifest_id"), F.expr(f"try_parse_json(`{body_col}`)").alias("v"), F.array().cast("array<string>").alias("keys"))
    return findings(rows, shape(keyed), "manifest_id", "v", "keys")


def header(cases: DataFrame, intended_use: str, version: str, key: bytes | None = None, domain: str = "manifest-hmac-v1") -> dict:
    """A manifest's header: all but its rows, which ``manifest_rows`` gives as a table. ``version`` names the schema.

    ``cases``: ``canonical_cases`` with tier and checks. A SHA-256 manifest of a holdout is refused: its digests could be linked.
    """
    if intended_use not in USES:
        raise ValueError(f"intended use is one of {', '.join(USES)}")
    if intended_use == "holdout" and key is None:
        raise ValueError("a holdout's manifest must be keyed")
    n = header_counts(cases).first().asDict()
    keyed = key is not None
    levels = lambda p: {d: n[f"{p}difficulty_{d}"] for d in ("easy", "medium", "hard")}
    kinds = lambda p: {k: n[f"{p}_{k}"] for k in KINDS}
    privacy = {"includesCaseIds": False, "includesCategoryLabels": False, "rowHashesCanLinkPublicCases": not keyed, "rowHashesIncludeGraderValues": True, "rowHashesAreUnsalted": not keyed}
    if keyed:
        privacy |= {"rowHashesAreKeyed": True, "hashPrivacy": "private_audit_hmac_sha256", "structuralMetadataVisible": True}
    return {
        "schemaVersion": version, "fingerprintVersion": FINGERPRINT, "intendedUse": intended_use, "source": {},
        "fingerprint": {"algorithm": "hmac-sha256" if keyed else "sha256", "canonicalization": CANONICAL, "content": CONTENT, f"canonical{'Hmac' if keyed else ''}Sha256": set_digest(cases, intended_use, key, domain)},
        "privacy": privacy,
        "summary": {
            "caseCount": n["cases"], "scoredCaseCount": n["scored_cases"], "smokeOnlyCaseCount": n["smoke_cases"],
            "categoryBalance": {"categoryCount": n["categories"], "minCasesPerCategory": n["least"], "maxCasesPerCategory": n["most"], "uncategorizedCaseCount": n["uncategorized"]},
            "scoredCategoryBalance": {"categoryCount": n["scored_categories"], "minScoredCasesPerCategory": n["scored_least"], "maxScoredCasesPerCategory": n["scored_most"], "scoredUncategorizedCaseCount": n["scored_uncategorized"]},
            "difficultyCoverage": {"difficultyCounts": levels(""), "scoredDifficultyCounts": levels("scored_"), "scoredCasesMissingDifficultyCount": n["scored_no_difficulty"], "smokeOnlyCasesMissingDifficultyCount": n["smoke_no_difficulty"]},
            "casesWithGraderKind": kinds("kind"),
            "graderEvidence": {"version": A.TIER_VERSION, "tierCounts": {t: n[f"tier_{t}"] for t in A.TIERS}, "smokeOnlyCasesWithConfiguredGraderCount": n["ignored_cases"], "ignoredSmokeOnlyConfiguredGraderKindCounts": kinds("ignored"), "ignoredSmokeOnlyConfiguredCheckCount": n["ignored_checks"]},
            "totalConfiguredChecks": n["checks"],
        },
        "claimReadiness": {"status": "requires_private_audit" if intended_use == "holdout" else "not_claim_ready", "warnings": readiness(n, intended_use, keyed)},
    }
