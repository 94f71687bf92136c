"""Replies of a model as JSON: decoded only if they are exactly what was asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweave.functions.text import BLANKS, strip

# Fixed value: what begins and ends a fenced block.
FENCE = "```"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def strip_code_fence(reply: Column) -> Column:
    """Without blanks at its ends, and, where it begins with a fence, without its first line and without the fence at its
    end. A fence without a line after it stays."""

    def inner(body: Column) -> Column:
        return bound(strip_end(body), lambda x: F.when(F.endswith(x, F.lit(FENCE)), strip_end(F.left(x, F.char_length(x) - len(FENCE)))).otherwise(body))

    def opened(clean: Column) -> Column:
        line = F.instr(clean, "\n")
        body = F.when(line > 0, F.substr(clean, line + 1)).otherwise(clean)
        return F.when(F.startswith(clean, F.lit(FENCE)), bound(body, inner)).otherwise(clean)

    return bound(strip(reply), opened)


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def fits(value: Column, wanted: T.DataType) -> Column:
    """Whether a variant is of a type: an object has all fields that can't be null, none that are not asked for, and each
    of its type; whole numbers are no fractions, numbers no strings. Null is only what a field may be."""
    kind = _kind(value)
    if isinstance(wanted, T.StructType):
        def whole(as_map: Column) -> Column:
            keys = F.map_keys(as_map)
            known = F.size(F.array_except(keys, F.array(*map(F.lit, wanted.names)))) == 0
            parts = []
            for f in wanted.fields:
                none = lambda inner: inner.isNull() | F.is_variant_null(inner)
                parts.append(bound(F.element_at(as_map, F.lit(f.name)), lambda inner: F.when(none(inner), F.lit(f.nullable)).otherwise(fits(inner, f.dataType))))  # noqa: B023 called at once
            return reduce(lambda a, b: a & b, parts, known)

        return F.when(F.startswith(kind, F.lit("OBJECT")), bound(F.variant_get(value, "$", "map<string,variant>"), whole)).otherwise(F.lit(False))
    if isinstance(wanted, T.ArrayType):
        each = F.transform(F.variant_get(value, "$", "array<variant>"), lambda v: fits(v, wanted.elementType))
        return F.when(F.startswith(kind, F.lit("ARRAY")), F.forall(each, lambda ok: F.coalesce(ok, F.lit(False)))).otherwise(F.lit(False))
    if isinstance(wanted, T.StringType):
        return kind == "STRING"
    if isinstance(wanted, T.BooleanType):
        return kind == "BOOLEAN"
    if isinstance(wanted, T.IntegralType):
        return kind == "BIGINT"
    return (kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))


def parsed(text: Column) -> Column:
    """The text as a variant, or null. The parser stops behind the first value; what follows it would break one of the two
    brackets that are put around it here, or make it a second value."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = (F.size(F.variant_get(listed, "$", "array<variant>")) == 1) & (F.size(F.map_keys(F.variant_get(named, "$", "map<string,variant>"))) == 1)
    return F.when(one, F.try_parse_json(text))


def reply_error(reply: Column, schema: T.StructType) -> Column:
    """Why a reply is refused: json (no JSON, or with a name twice), fields (another type, a field too few or too many); null where it is
    taken. A null reply is no JSON."""
    error = lambda value: F.when(value.isNull(), "json").when(~F.coalesce(fits(value, schema), F.lit(False)), "fields")
    return bound(strip_code_fence(reply), lambda clean: bound(parsed(clean), error))


def taken(reply: Column, error: Column, schema: T.StructType) -> Column:
    """The reply as a struct of the schema where there is no error."""
    return F.when(error.isNull(), F.from_json(strip_code_fence(reply), schema, {"mode": "PERMISSIVE"}))


def decode(reply: Column, schema: T.StructType) -> Column:
    """The reply as a struct of the schema, or null where anything is off."""
    return taken(reply, reply_error(reply, schema), schema)
