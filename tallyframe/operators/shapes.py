"""JSON artifacts matched against a declared shape: one tree of nodes, walked over a Variant column to (path, code) rows.

A shape is data: objects with their exact keys, arrays, records keyed by the artifact's own configurations, choices by the
value of one key, and leaves. ``findings`` compiles it to one nested expression, so that a document stays one row until its
findings are known; its nodes are no rows, but for objects with a rule, and a path is put together for these and findings only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    kind: str
    fields: tuple[tuple[str, Shape, bool], ...] = ()
    item: Shape | None = None
    values: tuple[str, ...] = ()
    pattern: str = ""
    nullable: bool = False
    least: int = 0
    key: str = ""
    options: tuple[tuple[str, Shape], ...] = ()
    #: Name of a rule over the whole object, see ``findings``.
    rule: str = ""


COUNT, POSITIVE, NUMBER, BOOL, ANY = (Shape(k) for k in ("count", "positive", "number", "bool", "any"))


def text(*values: str, pattern: str = "") -> Shape:
    """A string; one of ``values`` or one that matches ``pattern``, where given."""
    return Shape("text", values=values, pattern=pattern)


def number(value: float) -> Shape:
    return Shape("number", values=(repr(float(value)),))


def flag(value: bool) -> Shape:
    return Shape("bool", values=(str(value).lower(),))


def nullable(shape: Shape) -> Shape:
    return replace(shape, nullable=True)


def obj(rule: str = "", optional: tuple[str, ...] = (), **fields: Shape) -> Shape:
    """An object with exactly these keys; those of ``optional`` may be absent."""
    return Shape("object", tuple((k, s, k not in optional) for k, s in fields.items()), rule=rule)


def array(item: Shape, least: int = 0) -> Shape:
    return Shape("array", item=item, least=least)


def exactly(*values: str) -> Shape:
    """An array of exactly these strings."""
    return Shape("exact", values=values)


def record(item: Shape, keys: tuple[str, ...] = ()) -> Shape:
    """An object with a value for each of the artifact's configurations; with ``keys``, for any of these."""
    return Shape("partial" if keys else "record", item=item, values=keys)


def choice(key: str, default: Shape, **options: Shape) -> Shape:
    """The shape that the value of ``key`` names, else ``default``."""
    return Shape("choice", (), default, key=key, options=tuple(options.items()))


_NONE = "CAST(NULL AS STRUCT<path:STRING,code:STRING,rule:STRING,v:VARIANT>)"
_EMPTY = "CAST(array() AS ARRAY<STRUCT<path:STRING,code:STRING,rule:STRING,v:VARIANT>>)"
_LEAVES = ("text", "bool", "number", "count", "positive", "any")


def _lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: tuple[str, ...]) -> str:
    return f"CAST(array({', '.join(map(_lit, values))}) AS ARRAY<STRING>)"


@dataclass(frozen=True)
class _Place:
    """A node of the walk: the SQL of its Variant, its path as SQL texts to be joined, and how deep it lies, for names of lambda variables."""

    v: str
    path: tuple[str, ...] = ()
    level: int = 0

    def key(self, key: str) -> tuple[str, ...]:
        return (*self.path, "'.'", key) if self.path else (key,)

    def row(self, code: str, path: tuple[str, ...] | None = None) -> str:
        path = self.path if path is None else path
        joined = f"concat({', '.join(path)})" if path else "''"
        return f"named_struct('path', {joined}, 'code', '{code}', 'rule', CAST(NULL AS STRING), 'v', CAST(NULL AS VARIANT))"

    def rows(self, when: str, code: str) -> str:
        return f"IF({when}, array({self.row(code)}), {_EMPTY})"

    def ruled(self, rule: str) -> str:
        """A row that the rule is yet to judge."""
        return f"array(named_struct('path', concat({', '.join(self.path) or _lit('')}), 'code', CAST(NULL AS STRING), 'rule', {_lit(rule)}, 'v', {self.v}))"


def _let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` is the value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _mistyped(shape: Shape, v: str) -> str:
    """Of a value that has not the type of ``shape``: whether that is a finding, which a null in a nullable place is not."""
    return f"NOT is_variant_null({v})" if shape.nullable else "true"


def _leaf(shape: Shape, at: _Place, missing: str = _NONE) -> str:
    """The finding of a leaf, or null; ``missing`` where there is no value. The usual case, a sound value, is decided first."""
    v, sound = at.v, []
    t, word, x = f"schema_of_variant({v})", f"try_variant_get({v}, '$', 'string')", f"try_variant_get({v}, '$', 'double')"
    if shape.kind == "any":
        typed = f"({v} IS NOT NULL AND {_mistyped(shape, v)})"
    elif shape.kind in ("text", "bool"):
        typed = f"({t} = '{'STRING' if shape.kind == 'text' else 'BOOLEAN'}')"
        if shape.values:
            sound.append(f"{word} IN ({', '.join(map(_lit, shape.values))})")
        if shape.pattern:
            sound.append(f"{word} RLIKE {_lit(shape.pattern)}")
    else:
        typed = f"({t} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)')"
        if shape.kind != "number":
            sound += [f"{x} = floor({x})", f"{x} >= {0 if shape.kind == 'count' else 1}"]
        elif shape.values:
            sound.append(f"{x} = CAST({_lit(shape.values[0])} AS DOUBLE)")
    good = " AND ".join(sound) or "true"
    return f"CASE WHEN {typed} AND {good} THEN {_NONE} WHEN {v} IS NULL THEN {missing} WHEN {typed} AND NOT ({good}) THEN {at.row('wrong_value')} WHEN NOT {typed} AND {_mistyped(shape, v)} THEN {at.row('wrong_type')} END"


def _object(shape: Shape, at: _Place) -> str:
    """Findings of an object, a record or a record of any of some keys."""
    m, k, e, down = f"m{at.level}", f"k{at.level}", f"e{at.level}", at.level + 1
    strange = lambda keys: f"transform({keys}, {k} -> {at.row('unknown_key', at.key(k))})"
    if shape.kind == "object":
        leaves, out = [], []
        for name, s, must in shape.fields:
            child = _Place(f"{m}[{_lit(name)}]", at.key(_lit(name)), down)
            missing = child.row("missing_key") if must else _NONE
            if s.kind in _LEAVES:
                leaves.append(_leaf(s, child, missing))
            else:
                out.append(f"IF({child.v} IS NULL, array_compact(array({missing})), {_found(s, child)})")
        if leaves:
            out.append(f"array_compact(array({', '.join(leaves)}))")
        known = ", ".join(_lit(name) for name, _, _ in shape.fields)
        out.append(strange(f"filter(map_keys({m}), {k} -> {k} NOT IN ({known}))" if known else f"map_keys({m})"))
    else:
        allowed = f"coalesce(keys, map_keys({m}))" if shape.kind == "record" else _list(shape.values)
        own = f"filter(map_entries({m}), {e} -> array_contains({allowed}, {e}.key))"
        out = [strange(f"array_except(map_keys({m}), {allowed})"), _each(shape.item, own, e, _Place(f"{e}.value", at.key(f"{e}.key"), down))]
        if shape.kind == "record":
            out.append(f"transform(array_except(coalesce(keys, {_list(())}), map_keys({m})), {k} -> {at.row('missing_key', at.key(k))})")
    if shape.rule:
        out.append(at.ruled(shape.rule))
    body = f"IF({m} IS NULL, {at.rows(_mistyped(shape, at.v), 'wrong_type')}, concat({', '.join(out)}))"
    return _let(m, f"try_variant_get({at.v}, '$', 'map<string,variant>')", body)


def _each(item: Shape, values: str, names: str, at: _Place) -> str:
    """Findings of all ``values`` by ``item``; ``names`` are the lambda variables that ``at`` is made of. Null if ``values`` is."""
    if item.kind in _LEAVES:
        return f"array_compact(transform({values}, {names} -> {_leaf(item, at)}))"
    return f"flatten(transform({values}, {names} -> {_found(item, at)}))"


def _array(shape: Shape, at: _Place) -> str:
    a, e, i = f"a{at.level}", f"e{at.level}", f"i{at.level}"
    if shape.kind == "exact":
        inside = at.rows(f"NOT (transform({a}, {e} -> IF(schema_of_variant({e}) = 'STRING', try_variant_get({e}, '$', 'string'), NULL)) <=> {_list(shape.values)})", "wrong_value")
    else:
        inside = _each(shape.item, a, f"({e}, {i})", _Place(e, (*at.path, "'['", f"CAST({i} AS STRING)", "']'"), at.level + 1))
        if shape.least:
            inside = f"concat({at.rows(f'size({a}) < {shape.least}', 'wrong_value')}, {inside})"
    body = f"IF({a} IS NULL, {at.rows(_mistyped(shape, at.v), 'wrong_type')}, {inside})"
    return _let(a, f"try_variant_get({at.v}, '$', 'array<variant>')", body)


def _found(shape: Shape, at: _Place) -> str:
    """SQL of the array of all findings of a value that is not missing, and of what it holds. It is text, since a document's
    shape may have hundreds of nodes, and each call for a Column costs a message to the JVM."""
    if shape.kind in _LEAVES:
        return f"array_compact(array({_leaf(shape, at)}))"
    if shape.kind == "choice":
        options = " ".join(f"WHEN {_lit(value)} THEN {_found(s, at)}" for value, s in shape.options)
        other = _found(shape.item, at)
        return f"CASE try_variant_get({at.v}, '$.{shape.key}', 'string') {options} ELSE {other} END" if options else other
    return _array(shape, at) if shape.kind in ("array", "exact") else _object(shape, at)


def findings(artifacts: DataFrame, shape: Shape, id_col: str, value_col: str, keys_col: str, rules: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(id, path, code) of everything in the Variant ``value_col`` that departs from ``shape``: missing_key, unknown_key,
    wrong_type, wrong_value, and broken_rule where a named rule, a boolean of the object's Variant, is not true.

    ``keys_col`` holds the artifact's configurations; where it is null, the keys of records are not judged. Paths read ``a.b[0].c``, the root is the empty path.
    Null values give wrong_type at the root.
    """
    rows = artifacts.select(F.col(id_col).alias("id"), F.col(keys_col).alias("keys"), F.coalesce(F.col(value_col), F.parse_json(F.lit("null"))).alias("v"))
    # outer, since the filter that Spark infers from a plain one would repeat the whole walk below it
    rows = rows.select("id", F.explode_outer(F.expr(_found(shape, _Place("v")))).alias("r")).where("r IS NOT NULL").select("id", "r.*")
    broken = F.lit(False)
    for name, rule in (rules or {}).items():
        broken = broken | ((F.col("rule") == name) & ~F.coalesce(rule(F.col("v")), F.lit(False)))
    return rows.where(F.col("code").isNotNull() | broken).select(F.col("id").alias(id_col), "path", F.coalesce("code", F.lit("broken_rule")).alias("code"))
