"""Contracts of semi-structured values, compiled to Column expressions: violations with their paths, and values made to fit.

A contract is a tree of String, Number, Flag, List and Record. violations() gives a row for each place that breaks it; coerced() gives a typed value in which
what can be read otherwise is (a number in a string, an enumerated word in another spelling, one value where a list is asked for), and a list loses only
its bad items. Both work on VARIANT within Spark; no text is parsed in Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for no value; words that stand for true.
NOTHING = ("null", "none", "n/a", "unknown")
TRUE = ("true", "yes", "oui", "1")


@dataclass(frozen=True)
class Spec:
    """What every part of a contract has: whether null is a value, and a default for what is missing."""

    nullable: bool = field(default=False, kw_only=True)
    default: object = field(default=None, kw_only=True)


@dataclass(frozen=True)
class String(Spec):
    enum: tuple[str, ...] = ()
    most: int = 4000
    sql = "string"


@dataclass(frozen=True)
class Number(Spec):
    whole: bool = False

    @property
    def sql(self) -> str:
        return "bigint" if self.whole else "double"


@dataclass(frozen=True)
class Flag(Spec):
    sql = "boolean"


@dataclass(frozen=True)
class List(Spec):
    items: Spec = String()
    most: int = 50

    @property
    def sql(self) -> str:
        return f"array<{self.items.sql}>"


@dataclass(frozen=True)
class Record(Spec):
    fields: tuple[tuple[str, Spec], ...] = ()
    required: tuple[str, ...] = ()

    @property
    def sql(self) -> str:
        return "struct<" + ",".join(f"`{name}`:{s.sql}" for name, s in self.fields) + ">"


def answer(text) -> Column:
    """The JSON object of a model's answer as VARIANT, or null: thoughts and fences go; what lies between the outermost braces is read as it is, else with control signs as spaces
    and no commas before closing brackets, else with typographic quotes as plain ones."""
    t = F.col(text) if isinstance(text, str) else text
    body = F.regexp_extract(F.regexp_replace(t, r"(?is)<think>.*?(</think>|$)|```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(F.regexp_replace(body, r"[\x00-\x1F]+", " "), r",\s*([}\]])", "$1")
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(mended), F.try_parse_json(F.translate(mended, "“”", '""')))


def _kind(v: Column) -> Column:
    """string, number, boolean, array, object or void."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), "void").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")
    )


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(spec: List, v: Column) -> Column:
    """A list's items: of one value, itself; of a string where numbers are asked for, its numbers."""
    one = F.array(v)
    if isinstance(spec.items, Number):
        numbers = F.transform(F.regexp_extract_all(_text(v), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1), lambda x: F.try_parse_json(x))
        one = F.when(_kind(v) == "string", numbers).otherwise(one)
    return F.slice(F.when(_kind(v) == "array", F.try_variant_get(v, "$", "array<variant>")).otherwise(one), 1, spec.most)


def _missing(spec: Spec, v: Column) -> Column:
    out = (_kind(v) == "void") | ((_kind(v) == "string") & (_text(v) == ""))
    return out | ((_kind(v) == "string") & F.lower(F.trim(_text(v))).isin(*NOTHING)) if spec.nullable else out


def _joined(v: Column) -> Column:
    """A string, the text of a number or truth value, or the parts of a list of such."""
    parts = F.try_variant_get(v, "$", "array<variant>")
    plain = F.forall(parts, lambda x: _kind(x).isin("string", "number")) & (F.size(parts) > 0)
    return F.when(_kind(v).isin("string", "number", "boolean"), _text(v)).when((_kind(v) == "array") & plain, F.array_join(F.transform(parts, _text), "; "))


def _spelled(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), r"[\s_-]+", "_")


def _value(spec: Spec, v: Column) -> Column:
    """The typed value of what is not missing; null where it does not fit."""
    if isinstance(spec, String):
        if spec.enum:
            names = F.create_map(*[x for e in spec.enum for x in (F.lit(e.strip().lower().replace(" ", "_").replace("-", "_")), F.lit(e))])
            return F.try_element_at(names, _spelled(F.when(_kind(v).isin("string", "number", "boolean"), _text(v))))
        return F.substring(F.trim(_joined(v)), 1, spec.most)
    if isinstance(spec, Number):
        n = F.regexp_replace(F.when(_kind(v).isin("string", "number"), _text(v)), r"[^0-9.-]", "").try_cast("double")
        n = F.when(_kind(v) == "number", F.try_variant_get(v, "$", "double")).otherwise(n)
        return F.floor(n + 0.5).cast("bigint") if spec.whole else n
    if isinstance(spec, Flag):
        return F.lower(F.coalesce(_joined(v), F.lit(""))).isin(*TRUE)
    if isinstance(spec, List):
        return F.filter(F.transform(_items(spec, v), lambda x: coerced(spec.items, x)), lambda x: x.isNotNull())
    fields = [F.coalesce(coerced(s, F.try_variant_get(v, f"$.{name}", "variant")), F.array().cast(s.sql) if isinstance(s, List) else F.lit(None).cast(s.sql)).alias(name) for name, s in spec.fields]
    whole = F.when(_kind(v) == "object", F.struct(*fields))
    for name, s in spec.fields:
        if name in spec.required and not isinstance(s, List):
            own = F.try_variant_get(v, f"$.{name}", "variant")
            whole = F.when(coerced(s, own).isNotNull() | (_missing(s, own) if s.nullable else F.lit(False)), whole)
    return whole


def coerced(spec: Spec, v: Column) -> Column:
    """The typed value that a VARIANT holds under the contract; null where it breaks it. Missing values have their default, missing lists are empty."""
    absent = F.array().cast(spec.sql) if isinstance(spec, List) and spec.default is None and not spec.nullable else F.lit(spec.default).cast(spec.sql) if not isinstance(spec, (List, Record)) else F.lit(None).cast(spec.sql)
    return F.when(_missing(spec, v), absent).otherwise(_value(spec, v))


_ROW = "array<struct<path:string,fault:string,level:string>>"


def violations(spec: Spec, v: Column, path=None, level: str = "error") -> Column:
    """(path, fault, level) of every place that breaks the contract, in order. Faults of optional fields and of items are warnings: the field is left out, the item dropped."""
    path = F.lit("$") if path is None else path
    row = lambda fault: F.array(F.struct(path.alias("path"), F.lit(fault).alias("fault"), F.lit(level).alias("level"))).cast(_ROW)
    none = F.array().cast(_ROW)
    missing = none if spec.nullable or spec.default is not None or isinstance(spec, List) else row("missing")
    bad = _value(spec, v).isNull() if not isinstance(spec, (List, Record, Flag)) else F.lit(False)
    if isinstance(spec, String):
        inner = F.when(bad, row("not one of " + "|".join(spec.enum) if spec.enum else "not a string")).otherwise(none)
    elif isinstance(spec, Number):
        inner = F.when(bad, row("not a number")).otherwise(none)
    elif isinstance(spec, List):
        inner = F.flatten(F.transform(_items(spec, v), lambda x, i: violations(spec.items, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), "warning")))
    elif isinstance(spec, Record):
        parts = [violations(s, F.try_variant_get(v, f"$.{name}", "variant"), F.concat(path, F.lit(f".{name}")), level if name in spec.required else "warning") for name, s in spec.fields]
        inner = F.when(_kind(v) == "object", F.concat(*parts) if parts else none).otherwise(row("not an object"))
    else:
        inner = none
    return F.when(_missing(spec, v), missing).otherwise(inner)
