"""Functions without a faithful built-in: strict JSON, schema subset, canonical JSON, HMAC, citations, NFKC tokens.

All are plain Python functions on one value plus Arrow-batched UDFs made from them.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import re
import unicodedata
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

#: Bounds of graded JSON and of schema subsets, citation ids and the claim window.
MAX_NODES, MAX_DEPTH, MAX_STRING = 2000, 20, 10_000
SCHEMA_DEPTH, SCHEMA_NODES, SCHEMA_PROPERTIES, SCHEMA_ENUM = 10, 200, 100, 50
CITATION_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,63}")
CLAIM_WINDOW = 160
PATH = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*(?:\[\d+\])*(?:\.[A-Za-z_][A-Za-z0-9_-]*(?:\[\d+\])*)*")
#: Fixed value: what may stand around a JSON answer.
OUTER_SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
UNSAFE_KEYS = ("__proto__", "prototype", "constructor")


class Missing:
    """What a path leads to where there is nothing (null is something)."""


def vectorized(function: Callable[..., Any], kind: DataType):
    """An Arrow-batched UDF that applies ``function`` to the rows of its columns."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*columns, strict=True)], dtype=object)

    if isinstance(kind, StructType):
        names = kind.names

        def run_struct(*columns: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([function(*row) for row in zip(*columns, strict=True)], columns=names, dtype=object)

        run_struct.__annotations__ = {}
        return F.pandas_udf(_typed(run_struct, True), kind)
    return F.pandas_udf(_typed(run, False), kind)


def _typed(function: Callable, frame: bool) -> Callable:
    def batches(iterator):
        for columns in iterator:
            yield function(*columns) if isinstance(columns, tuple) else function(columns)

    from collections.abc import Iterator

    batches.__annotations__ = {"iterator": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame] if frame else Iterator[pd.Series]}
    return batches


def parse_json(text: str | None) -> tuple[bool, str | None, Any]:
    """(valid, reason, value): strict JSON, the last of equal keys wins, within the bounds on nodes, depth, strings and finite numbers."""
    if text is None:
        return False, "json_parse_failed", None

    def reject(_: str) -> None:
        raise ValueError("not a JSON number")

    try:
        value = json.loads(text.strip(OUTER_SPACE), parse_constant=reject, parse_int=lambda s: int(s) if len(s) <= 308 else float(s))
    except (ValueError, RecursionError):
        return False, "json_parse_failed", None
    nodes, stack = 0, [(value, 0)]
    while stack:
        item, depth = stack.pop()
        nodes += 1
        if nodes > MAX_NODES or depth > MAX_DEPTH or isinstance(item, str) and len(item) > MAX_STRING or isinstance(item, float) and not math.isfinite(item):
            return False, "json_too_large", None
        if isinstance(item, dict):
            stack += [(x, depth + 1) for x in item.values()]
        elif isinstance(item, list):
            stack += [(x, depth + 1) for x in item]
    return True, None, value


def path_valid(path: str) -> bool:
    steps = path_steps(path)
    return len(path) <= 120 and PATH.fullmatch(path) is not None and len(steps) <= 12 and not any(s in UNSAFE_KEYS or isinstance(s, int) and s > 1000 for s in steps)


def path_steps(path: str) -> list[str | int]:
    return [int(i) if i else k for k, i in re.findall(r"([A-Za-z_][A-Za-z0-9_-]*)|\[(\d+)\]", path)]


def resolve(value: Any, path: str) -> Any:
    for step in path_steps(path):
        if isinstance(step, int) and isinstance(value, list) and step < len(value):
            value = value[step]
        elif isinstance(step, str) and isinstance(value, dict) and step in value:
            value = value[step]
        else:
            return Missing
    return value


def same_primitive(left: Any, right: Any) -> bool:
    """Equal and of one type, where all numbers are one type."""
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    if number(left) and number(right):
        return float(left) == float(right)
    return type(left) is type(right) and not isinstance(left, dict | list) and left == right


def _is_type(value: Any, kind: str) -> bool:
    numeric = isinstance(value, int | float) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool),
        "null": value is None, "number": numeric and math.isfinite(value), "integer": numeric and math.isfinite(value) and float(value).is_integer(),
    }.get(kind, False)


def matches_schema(value: Any, schema: dict) -> bool:
    """Type, enum, bounds, required, properties, additional properties and items."""
    if "type" in schema and not _is_type(value, schema["type"]):
        return False
    if "enum" in schema and not any(same_primitive(value, x) for x in schema["enum"]):
        return False
    if _is_type(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])):
            return False
        if schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(matches_schema(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list) and "items" in schema:
        return all(matches_schema(v, schema["items"]) for v in value)
    return True


def schema_problems(schema: Any) -> list[str]:
    """What makes a schema subset unacceptable; empty if nothing does."""
    allowed = {"type", "properties", "required", "additionalProperties", "items", "enum", "minimum", "maximum"}
    out, nodes, stack = [], 0, [(schema, 1)]
    while stack:
        item, depth = stack.pop()
        nodes += 1
        if nodes > SCHEMA_NODES or depth > SCHEMA_DEPTH:
            return [*out, "schema_too_large"]
        if not isinstance(item, dict):
            out.append("schema_not_object")
            continue
        if set(item) - allowed:
            out.append("unknown_keyword")
        properties = item.get("properties", {})
        if len(properties) > SCHEMA_PROPERTIES or any(k in UNSAFE_KEYS for k in properties):
            out.append("bad_properties")
        if item.get("type") == "object" and not isinstance(item.get("additionalProperties"), bool):
            out.append("additional_properties_not_explicit")
        if len(item.get("enum", [0])) not in range(1, SCHEMA_ENUM + 1):
            out.append("bad_enum")
        if item.get("minimum", -math.inf) > item.get("maximum", math.inf):
            out.append("bad_bounds")
        stack += [(x, depth + 1) for x in properties.values()] + ([(item["items"], depth + 1)] if "items" in item else [])
    return out


def _number_text(x: float) -> str:
    """A double as ECMAScript prints it."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(x).partition("e")
    if not exponent:
        return digits
    e, sign = int(exponent), "-" if x < 0 else ""
    mantissa = digits.lstrip("-").replace(".", "")
    if -7 < e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{mantissa}"
    return f"{digits}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical_json(value: Any) -> str:
    """Keys sorted by UTF-16 units, no spaces, numbers as ECMAScript has them; non-finite numbers are refused."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number is not finite")
        return _number_text(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return _number_text(float(value)) if abs(value) > 2**53 else str(value)
    return json.dumps(value, ensure_ascii=False)


def keyed_digest(key: bytes, domain: str, purpose: str, text: str) -> str:
    """HMAC-SHA-256 over domain, purpose and text, parted by NUL; keys under 32 bytes are refused."""
    if len(key) < 32:
        raise ValueError("the key has fewer than 32 bytes")
    return hmac.new(key, b"\0".join([domain.encode(), purpose.encode(), text.encode()]), hashlib.sha256).hexdigest()


def citations(answer: str) -> tuple[list[tuple[str, int, int]], bool]:
    """((id, start, end) of each bracket citation, whether brackets are malformed)."""
    spans, malformed, at = [], False, 0
    for found in re.finditer(r"\]|\[([^\]]*)(\]?)", answer):
        if found.start() < at:
            continue
        body, closed = found.group(1), found.group(2)
        if body is None or not closed:
            malformed = True
        elif CITATION_ID.fullmatch(body):
            spans.append((body, found.start(), found.end()))
        else:
            malformed = True
        at = found.end()
    return spans, malformed


def claim_cited(answer: str, claim: str, source: str, immediate: bool) -> bool:
    """Whether an occurrence of the claim has a citation of the source after it: next to it, or starting within the window."""
    spans, low, word = [s for s in citations(answer)[0] if s[0] == source], answer.lower(), claim.lower()
    at = low.find(word)
    while at >= 0 and word:
        end = at + len(claim)
        for _, start, _ in spans:
            if start >= end and (not answer[end:start].strip() if immediate else start < end + CLAIM_WINDOW):
                return True
        at = low.find(word, at + len(word))
    return False


def word_set(text: str | None) -> list[str]:
    """Distinct runs of letters and numbers after NFKC and lower-casing, in order of appearance."""
    plain = unicodedata.normalize("NFKC", text or "").lower()
    runs = "".join([c if unicodedata.category(c)[0] in "LN" else " " for c in plain])
    return list(dict.fromkeys(runs.split()))


STRINGS = ArrayType(StringType())
CHECK = StructType([StructField("name", StringType()), StructField("passed", BooleanType()), StructField("details", StringType())])


def strict_json():
    """text -> (valid, reason, canonical)."""

    def run(text: str | None) -> tuple:
        valid, reason, value = parse_json(text)
        return valid, reason, canonical_json(value) if valid else None

    return vectorized(run, StructType([StructField("valid", BooleanType()), StructField("reason", StringType()), StructField("canonical", StringType())]))


def schema_match(schema: dict):
    return vectorized(lambda text: (lambda p: p[0] and matches_schema(p[2], schema))(parse_json(text)), BooleanType())


def canonical():
    return vectorized(lambda text: canonical_json(json.loads(text)) if text is not None else None, StringType())


def hmac_of(key: bytes, domain: str, purpose: str):
    """The key stays in the closure; it is no column, no part of a plan and not logged."""
    return vectorized(lambda text: None if text is None else keyed_digest(key, domain, purpose, text), StringType())


def words():
    return vectorized(word_set, STRINGS)


def citation_spans():
    kind = StructType([StructField("ids", STRINGS), StructField("starts", ArrayType(IntegerType())), StructField("malformed", BooleanType())])

    def run(answer: str | None) -> tuple:
        spans, malformed = citations(answer or "")
        return [s[0] for s in spans], [s[1] for s in spans], malformed

    return vectorized(run, kind)


def claim_is_cited(claim: str, source: str, immediate: bool):
    return vectorized(lambda answer: claim_cited(answer or "", claim, source, immediate), BooleanType())


def json_checks():
    """(answer, grader's json part as JSON text) -> checks, in the fixed order of the families."""

    def run(answer: str | None, spec_text: str | None) -> list | None:
        if spec_text is None:
            return []
        spec, (valid, reason, value), out = json.loads(spec_text), parse_json(answer), []
        paths, equals = spec.get("requiredPaths") or [], spec.get("equals") or {}
        includes, lengths = spec.get("includes") or {}, spec.get("arrayMinLength") or {}
        add = lambda name, ok, why=None: out.append({"name": name, "passed": ok, "details": why})
        if spec.get("requireValid") is True:
            add("json_valid", valid, reason)
        if not valid:
            for _ in range(len(paths) + len(equals) + len(includes) + len(lengths)):
                add("json_check", False, reason)
            if spec.get("schemaSubset") is not None:
                add("json_schema_subset", False, reason)
            return out
        for path in paths:
            add("json_required_path", resolve(value, path) is not Missing)
        tests = [
            ("json_equals", equals, lambda got, want: same_primitive(got, want)),
            ("json_includes", includes, lambda got, want: isinstance(got, str) and want.lower() in got.lower()),
            ("json_array_min_length", lengths, lambda got, want: isinstance(got, list) and len(got) >= want),
        ]
        for name, wanted, test in tests:
            for path, want in wanted.items():
                got = resolve(value, path)
                add(name, got is not Missing and test(got, want), "path_missing" if got is Missing else None)
        if spec.get("schemaSubset") is not None:
            ok = matches_schema(value, spec["schemaSubset"])
            add("json_schema_subset", ok, None if ok else "schema_subset_mismatch")
        return out

    return vectorized(run, ArrayType(CHECK))


def citation_checks():
    """(answer, grader's citation part as JSON text) -> checks: allowed, required, enough, claims."""

    def run(answer: str | None, spec_text: str | None) -> list | None:
        if spec_text is None:
            return []
        spec, answer = json.loads(spec_text), answer or ""
        spans, malformed = citations(answer)
        cited = [s[0] for s in spans]
        allowed = spec.get("allowedSourceIds") or []
        out: list[dict] = []
        add = lambda name, ok, why: out.append({"name": name, "passed": ok, "details": None if ok else why})
        strange = [c for c in cited if c not in allowed]
        add("citation_allowed_sources", not malformed and not strange, "malformed_citation" if malformed else "unknown_source")
        for source in spec.get("requiredSourceIds") or []:
            add("citation_required_source", source in cited, "missing_required_source")
        if spec.get("minCitedSources") is not None:
            add("citation_min_sources", len({c for c in cited if c in allowed}) >= spec["minCitedSources"], "too_few_sources")
        for claim in spec.get("requiredClaims") or []:
            add("citation_required_claim", claim_cited(answer, claim["text"], claim["sourceId"], claim.get("citationPlacement") == "immediate"), "claim_not_immediately_cited" if claim.get("citationPlacement") == "immediate" else "claim_not_cited")
        return out

    return vectorized(run, ArrayType(CHECK))
