"""Metadata filters: a small expression tree, a JSON form of it, and its compilation to Catalyst expressions.

Evaluation is total: after validation any filter gives true or false for any document. Fields are dotted paths. A field
that can't be resolved is absent; ``Eq``, ``In`` and ``IsNull`` take absent for null, ``Exists`` tells them apart (in a
VARIANT; in typed columns null is absent). Ordering needs two values of a kind; numbers compare across integer and
double. ``Ne`` and ``Nin`` are exact negations, so they hold for absent fields.

In positive position a comparison stays a bare predicate, where SQL's null means false, so that it is pushed down to the
scan; below a negation it is coalesced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.types import MAX_FILTER_DEPTH, MAX_FILTER_NODES, FilterTooComplex, ValidationError

ORDERINGS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
LEAVES = {"eq", "ne", "in", "nin", "exists", "is_null", "starts_with", "contains", *ORDERINGS}


@dataclass(frozen=True)
class Filter:
    op: str
    field: str | None = None
    value: Any = None
    children: tuple[Filter, ...] = ()

    def __and__(self, other: Filter) -> Filter:
        own = self.children if self.op == "and" else (self,)
        return Filter("and", children=(*own, *(other.children if other.op == "and" else (other,))))

    def __or__(self, other: Filter) -> Filter:
        own = self.children if self.op == "or" else (self,)
        return Filter("or", children=(*own, *(other.children if other.op == "or" else (other,))))

    def __invert__(self) -> Filter:
        return Filter("not", children=(self,))

    def node_count(self) -> int:
        return 1 + sum(c.node_count() for c in self.children)

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=0)

    def referenced_fields(self) -> list[str]:
        return sorted({*([self.field] if self.field is not None else []), *(f for c in self.children for f in c.referenced_fields())})

    def validate(self) -> Filter:
        if self.depth() > MAX_FILTER_DEPTH or self.node_count() > MAX_FILTER_NODES:
            raise FilterTooComplex(f"{self.node_count()} nodes in {self.depth()} levels; at most {MAX_FILTER_NODES} in {MAX_FILTER_DEPTH}")
        return self


def all_of(*filters: Filter) -> Filter:
    return Filter("and", children=tuple(filters))


def any_of(*filters: Filter) -> Filter:
    return Filter("or", children=tuple(filters))


def negate(f: Filter) -> Filter:
    return ~f


def eq(field: str, value: Any) -> Filter:
    return Filter("eq", field, value)


def ne(field: str, value: Any) -> Filter:
    return Filter("ne", field, value)


def gt(field: str, value: Any) -> Filter:
    return Filter("gt", field, value)


def gte(field: str, value: Any) -> Filter:
    return Filter("gte", field, value)


def lt(field: str, value: Any) -> Filter:
    return Filter("lt", field, value)


def lte(field: str, value: Any) -> Filter:
    return Filter("lte", field, value)


def in_(field: str, values) -> Filter:
    return Filter("in", field, tuple(values))


def nin(field: str, values) -> Filter:
    return Filter("nin", field, tuple(values))


def exists(field: str) -> Filter:
    return Filter("exists", field)


def is_null(field: str) -> Filter:
    return Filter("is_null", field)


def starts_with(field: str, prefix: str) -> Filter:
    return Filter("starts_with", field, prefix)


def contains(field: str, value: Any) -> Filter:
    return Filter("contains", field, value)


# The JSON form.

_OPERATORS = {"$eq": "eq", "$ne": "ne", "$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte", "$contains": "contains"}


def parse(obj: dict, depth: int = 1) -> Filter:
    """From an object: field or $operator to value; several keys are a conjunction, none matches all."""
    if not isinstance(obj, dict):
        raise ValidationError("a filter is an object")
    if depth > MAX_FILTER_DEPTH:
        raise FilterTooComplex(f"nested deeper than {MAX_FILTER_DEPTH}")
    clauses = []
    for key, value in obj.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise ValidationError("$and and $or take an array of filters")
            clauses.append(Filter(key[1:], children=tuple(parse(x, depth + 1) for x in value)))
        elif key == "$not":
            clauses.append(~parse(value, depth + 1))
        elif key.startswith("$"):
            raise ValidationError(f"unknown operator {key!r}")
        elif isinstance(value, dict):
            clauses.append(_single([_operator(key, op, x) for op, x in value.items()]))
        elif isinstance(value, list):
            raise ValidationError(f"field {key!r}: an array isn't a value; $contains tests membership")
        else:
            clauses.append(eq(key, _scalar(key, value)))
    return _single(clauses)


def _single(clauses: list[Filter]) -> Filter:
    return clauses[0] if len(clauses) == 1 else all_of(*clauses)


def _operator(field: str, op: str, value: Any) -> Filter:
    if op in _OPERATORS:
        return Filter(_OPERATORS[op], field, _scalar(field, value))
    if op in ("$in", "$nin"):
        if not isinstance(value, list):
            raise ValidationError(f"field {field!r}: {op} takes an array")
        return Filter(op[1:], field, tuple(_scalar(field, x) for x in value))
    if op == "$exists":
        return exists(field) if value else is_null(field)
    if op == "$startsWith":
        if not isinstance(value, str):
            raise ValidationError(f"field {field!r}: $startsWith takes a string")
        return starts_with(field, value)
    raise ValidationError(f"field {field!r}: unknown operator {op!r}")


def _scalar(field: str, value: Any) -> Any:
    if isinstance(value, float) and value.is_integer() and abs(value) < 9e15:
        return int(value)
    if value is None or isinstance(value, bool | int | float | str):
        return value
    raise ValidationError(f"field {field!r}: values are strings, numbers, booleans or null")


# Compilation.


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


class VariantFields:
    """Fields of a VARIANT column: absent, null and every type are told apart."""

    def __init__(self, column: Column):
        self.column = column

    def get(self, field: str) -> Column:
        segments = field.split(".")
        if any('"' in s and "'" in s for s in segments):
            return F.lit(None).cast("variant")
        path = "$" + "".join(f'["{s}"]' if "'" in s else f"['{s}']" for s in segments) if field else None
        return F.try_variant_get(self.column, path, "variant") if path else F.lit(None).cast("variant")

    def exists(self, v: Column) -> Column:
        return v.isNotNull()

    def is_null(self, v: Column) -> Column:
        return v.isNull() | F.is_variant_null(v)

    @staticmethod
    def _is(v: Column, kind: str) -> Column:
        return F.schema_of_variant(v) == kind

    @staticmethod
    def _to(v: Column, kind: str) -> Column:
        return F.try_variant_get(v, "$", kind)

    def _numeric(self, v: Column, value: int | float, test) -> Column:
        kind = F.schema_of_variant(v)
        wide = F.when((kind == "DOUBLE") | (kind == "FLOAT") | (kind == "BIGINT") | kind.startswith("DECIMAL"), test(self._to(v, "double"), F.lit(float(value))))
        return F.when(kind == "BIGINT", test(self._to(v, "bigint"), F.lit(value).cast("bigint"))).otherwise(wide) if isinstance(value, int) else wide

    def _scalar(self, v: Column, value: Any, test) -> Column | None:
        if isinstance(value, bool):
            return F.when(self._is(v, "BOOLEAN"), test(self._to(v, "boolean"), F.lit(value)))
        if _number(value):
            return self._numeric(v, value, test)
        if isinstance(value, str):
            return F.when(self._is(v, "STRING"), test(self._to(v, "string"), F.lit(value)))
        if isinstance(value, bytes | bytearray):
            return F.when(self._is(v, "BINARY"), test(self._to(v, "binary"), F.lit(bytes(value))))
        return None

    def same(self, v: Column, value: Any) -> Column:
        if value is None:
            return F.coalesce(F.is_variant_null(v), F.lit(False))
        if isinstance(value, list | tuple):
            items = self._to(v, "array<variant>")
            return reduce(lambda a, b: a & b, (F.coalesce(self.same(F.get(items, F.lit(i)), x), F.lit(False)) for i, x in enumerate(value)), F.coalesce(F.size(items) == len(value), F.lit(False)))
        if isinstance(value, dict):
            keys = self._to(v, "map<string,variant>")
            return reduce(lambda a, b: a & b, (F.coalesce(self.same(F.try_element_at(keys, F.lit(k)), x), F.lit(False)) for k, x in value.items()), F.schema_of_variant(v).startswith("OBJECT") & (F.size(keys) == len(value)))
        return self._scalar(v, value, lambda a, b: a == b)

    def among(self, v: Column, values: list) -> Column:
        """Whether v equals one of these booleans, numbers and strings: one switch on its kind."""
        flags, texts = [x for x in values if isinstance(x, bool)], [x for x in values if isinstance(x, str)]
        whole = [x for x in values if isinstance(x, int) and not isinstance(x, bool)]
        real = [x for x in values if isinstance(x, float)]
        kind, no = F.schema_of_variant(v), F.lit(False)
        wide = self._to(v, "double").isin([float(x) for x in whole + real]) if whole or real else no
        exact = self._to(v, "bigint").isin(whole) if whole else no
        narrow = exact | self._to(v, "double").isin(real) if real else exact
        found = F.when(kind == "STRING", self._to(v, "string").isin(texts) if texts else no).when(kind == "BIGINT", narrow)
        found = found.when(kind == "BOOLEAN", self._to(v, "boolean").isin(flags) if flags else no)
        return found.when((kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"), wide)

    def order(self, v: Column, value: Any, test) -> Column:
        found = self._scalar(v, value, test)
        return F.lit(False) if found is None else found

    def starts_with(self, v: Column, prefix: str) -> Column:
        return F.when(self._is(v, "STRING"), self._to(v, "string").startswith(prefix))

    def contains(self, v: Column, value: Any) -> Column:
        return F.exists(self._to(v, "array<variant>"), lambda x: F.coalesce(self.same(x, value), F.lit(False)))


class TypedFields:
    """Fields that are columns, or nested in struct columns; null is absent, and a comparison of two kinds is false."""

    def __init__(self, schema: T.StructType, alias: str | None = None):
        self.schema, self.alias = schema, alias

    def get(self, field: str) -> tuple[Column | None, T.DataType | None]:
        kind: T.DataType = self.schema
        column = None
        for name in field.split("."):
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return None, None
            kind = kind[name].dataType
            column = (F.col(f"{self.alias}.`{name}`" if self.alias else f"`{name}`")) if column is None else column.getField(name)
        return column, kind

    def exists(self, v) -> Column:
        return F.lit(False) if v[0] is None else v[0].isNotNull()

    def is_null(self, v) -> Column:
        return F.lit(True) if v[0] is None else v[0].isNull()

    def _scalar(self, v, value: Any, test) -> Column | None:
        column, kind = v
        if isinstance(value, bool):
            return test(column, F.lit(value)) if isinstance(kind, T.BooleanType) else None
        if _number(value):
            if isinstance(kind, T.IntegralType):
                fits = isinstance(value, int)
                return test(column, F.lit(value)) if fits else test(column.cast("double"), F.lit(value))
            return test(column if isinstance(kind, T.DoubleType) else column.cast("double"), F.lit(float(value))) if isinstance(kind, T.NumericType) else None
        if isinstance(value, str):
            return test(column, F.lit(value)) if isinstance(kind, T.StringType) else None
        if isinstance(value, bytes | bytearray):
            return test(column, F.lit(bytes(value))) if isinstance(kind, T.BinaryType) else None
        return None

    def same(self, v, value: Any) -> Column:
        column, kind = v
        if column is None:
            return F.lit(value is None)
        if value is None:
            return column.isNull()
        if isinstance(value, list | tuple) and isinstance(kind, T.ArrayType):
            return reduce(lambda a, b: a & b, (F.coalesce(self.same((F.get(column, F.lit(i)), kind.elementType), x), F.lit(False)) for i, x in enumerate(value)), F.size(column) == len(value))
        if isinstance(value, dict) and isinstance(kind, T.MapType):
            return reduce(lambda a, b: a & b, (F.coalesce(self.same((F.try_element_at(column, F.lit(k)), kind.valueType), x), F.lit(False)) for k, x in value.items()), F.size(column) == len(value))
        if isinstance(value, dict) and isinstance(kind, T.StructType):
            if not set(value) <= set(kind.names):
                return F.lit(False)
            return reduce(lambda a, b: a & b, (F.coalesce(self.same((column.getField(f.name), f.dataType), value.get(f.name)), F.lit(False)) for f in kind.fields), column.isNotNull())
        found = self._scalar(v, value, lambda a, b: a == b)
        return F.lit(False) if found is None else found

    def order(self, v, value: Any, test) -> Column:
        found = None if v[0] is None else self._scalar(v, value, test)
        return F.lit(False) if found is None else found

    def starts_with(self, v, prefix: str) -> Column:
        return v[0].startswith(prefix) if isinstance(v[1], T.StringType) else F.lit(False)

    def contains(self, v, value: Any) -> Column:
        if not isinstance(v[1], T.ArrayType):
            return F.lit(False)
        return F.exists(v[0], lambda x: F.coalesce(self.same((x, v[1].elementType), value), F.lit(False)))


def _leaf(f: Filter, fields) -> Column:
    v = fields.get(f.field)
    if f.op == "exists":
        return fields.exists(v)
    if f.op == "is_null":
        return fields.is_null(v)
    if f.op in ORDERINGS:
        if isinstance(f.value, float) and math.isnan(f.value):
            return F.lit(False)
        return fields.order(v, f.value, ORDERINGS[f.op])
    if f.op == "starts_with":
        return fields.starts_with(v, f.value)
    if f.op == "contains":
        return fields.contains(v, f.value)
    return fields.is_null(v) if f.value is None else fields.same(v, f.value)


def compile_filter(f: Filter | dict | None, fields, positive: bool = True) -> Column:
    """A boolean Column. positive: it stands where null means false; otherwise it is never null."""
    if f is None:
        return F.lit(True)
    f = (parse(f) if isinstance(f, dict) else f).validate()
    return _compile(f, fields, positive)


def _compile(f: Filter, fields, positive: bool) -> Column:
    if f.op == "and":
        return reduce(lambda a, b: a & b, (_compile(c, fields, positive) for c in f.children)) if f.children else F.lit(True)
    if f.op == "or":
        return reduce(lambda a, b: a | b, (_compile(c, fields, positive) for c in f.children)) if f.children else F.lit(False)
    if f.op == "not":
        return ~_compile(f.children[0], fields, False)
    if f.op == "ne":
        return ~_compile(eq(f.field, f.value), fields, False)
    if f.op in ("in", "nin"):
        positive = positive and f.op == "in"
        plain = [x for x in f.value if isinstance(x, bool | str) or _number(x) and x == x and -(1 << 63) <= x < 1 << 63]
        if len(plain) > 1 and hasattr(fields, "among"):
            own = fields.among(fields.get(f.field), plain)
            rest = [eq(f.field, x) for x in f.value if not any(x is p for p in plain)]
            found = own if positive else F.coalesce(own, F.lit(False))
            found = found | _compile(any_of(*rest), fields, positive) if rest else found
        else:
            found = _compile(any_of(*(eq(f.field, x) for x in f.value)), fields, positive)
        return found if f.op == "in" else ~found
    if f.op not in LEAVES:
        raise ValidationError(f"unknown predicate {f.op!r}")
    found = _leaf(f, fields)
    return found if positive else F.coalesce(found, F.lit(False))
