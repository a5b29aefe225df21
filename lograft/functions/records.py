"""Parsing records and reaching, testing, changing and printing what is in them.

Two views of a record are served: a struct with a declared or discovered schema (``schema_of`` gives
it), and a variant for records of any shape. All functions are plain column expressions but ``compact_json_text``.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft.functions.paths import Path, parse_path, pointer_tokens, variant_path

_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


# -- parsing -------------------------------------------------------------------------------------


def parse_variant(text: Column | str) -> Column:
    """The record as a variant, null where the text is none."""
    return F.try_parse_json(_col(text))


def parse_struct(text: Column | str, schema: T.DataType | str) -> Column:
    """The record as a struct of ``schema``; fields that are missing or of another type are null."""
    return F.from_json(_col(text), schema, _STRICT)


def struct_of(v: Column | str, schema: T.DataType) -> Column:
    """A parsed variant as a struct of ``schema``, so that the text is not parsed again; fields that are missing or of another type are null."""
    return _col(v).try_cast(schema)


def discover_schema(df: DataFrame, column: str = "clean") -> T.DataType:
    """The merged schema of all records of a text column: one pass, one small row to the driver.

    Where a field has unlike types it becomes a variant, so nothing of it is lost. Records that are
    arrays give an array type, objects beside arrays a variant; no records give a struct without fields.
    """
    row = df.agg(F.expr(f"schema_of_variant_agg(try_parse_json(`{column}`))").alias("s")).first()
    return T.DataType.fromDDL(_ddl(row["s"])) if row["s"] and row["s"] != "VOID" else T.StructType()


#: A quoted name, a plain name, or one of the two words for types that DDL has not.
_TYPE = re.compile(r"`(?:[^`]|``)*`|[A-Za-z_]\w*(?=: )|OBJECT<|\bVOID\b")


def _ddl(text: str) -> str:
    def put(m: re.Match) -> str:
        word = m[0]
        if word[0] == "`" or text.startswith(": ", m.end()):
            return word if word[0] == "`" else f"`{word}`"
        return "STRUCT<" if word == "OBJECT<" else "STRING"

    return _TYPE.sub(put, text)


# -- reaching fields -----------------------------------------------------------------------------


def type_at(schema: T.DataType, path: Path) -> T.DataType | None:
    """The type at a path, None where the schema has no such field."""
    for p in path:
        if isinstance(p, int) and isinstance(schema, T.ArrayType):
            schema = schema.elementType
        elif isinstance(schema, T.StructType) and str(p) in schema.names:
            schema = schema[str(p)].dataType
        elif isinstance(schema, T.VariantType):
            return schema
        else:
            return None
    return schema


def field(record: Column | str, schema: T.DataType, path: str | Path) -> Column:
    """The field at a path of a struct or variant record; null where it, or what leads to it, is missing.

    ``schema`` is the type of the record in this and all functions below. In a variant, or where a
    schema ends in one, every path may be there, and an explicit null is null.
    """
    at, col = parse_path(path), _col(record)
    if type_at(schema, at) is None:
        return F.lit(None).cast("string")
    kind: T.DataType = schema
    for k, p in enumerate(at):
        if isinstance(kind, T.VariantType):
            return variant_field(col, at[k:], "variant")
        col = F.get(col, p) if isinstance(p, int) else col.getField(p)
        kind = type_at(kind, (p,))
    return F.when(~F.is_variant_null(col), col) if isinstance(kind, T.VariantType) else col


def variant_field(v: Column | str, path: str | Path, kind: str = "string") -> Column:
    """The field at a path of a variant record as ``kind``; an explicit null is null."""
    got = F.try_variant_get(_col(v), variant_path(parse_path(path)), kind)
    return F.when(~F.is_variant_null(got), got) if kind == "variant" else got


def json_pointer(v: Column | str, pointer: str) -> Column:
    """The value at an RFC 6901 pointer as a variant: an explicit null is a variant null, a missing value null.

    A number is an index of an array or a name of an object, whichever is there.
    """
    tokens = pointer_tokens(pointer)
    if tokens is None:
        return F.lit(None).cast("variant")
    if not tokens:
        return _col(v)
    ways = [[t, int(t)] if t.isdigit() and (t == "0" or t[0] != "0") and len(t) < 10 else [t] for t in tokens]
    return F.coalesce(*(F.try_variant_get(_col(v), variant_path(w), "variant") for w in product(*ways)))


def json_pointer_at(v: Column | str, pointer: Column) -> Column:
    """``json_pointer`` with a pointer of each row: its tokens are walked one by one, with the value reached as state.

    A pointer that is null or begins with no slash reaches nothing, an empty one the whole record.
    """
    tokens = F.transform(F.split(F.substring(pointer, 2, (1 << 31) - 1), "/"), lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))

    def step(at: Column, token: Column) -> Column:
        place = F.when(token.rlike("^(0|[1-9][0-9]{0,8})$"), token.cast("int"))
        members, items = F.try_variant_get(at, "$", "map<string,variant>"), F.try_variant_get(at, "$", "array<variant>")
        return F.coalesce(F.try_element_at(members, token), F.get(items, place))

    return F.when(pointer == "", _col(v)).when(F.startswith(pointer, F.lit("/")), F.aggregate(tokens, _col(v), step))


def entries(df: DataFrame, variant: str = "v") -> DataFrame:
    """A row per key and value of each object: ``pos, key, value`` beside the other columns."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(variant).outer()))


def json_kind(v: Column | str) -> Column:
    """object, array, string, value or null."""
    return bound(F.schema_of_variant(_col(v)), lambda s: (
        F.when(s.isNull() | (s == "VOID"), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string").otherwise("value")
    ))


def as_text(col: Column, kind: T.DataType | None, pretty: bool = False) -> Column:
    """A value as it is printed: strings bare, scalars as text, objects and arrays as JSON."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return to_pretty_json(col, kind) if pretty else to_compact_json(col, kind)
    if isinstance(kind, T.VariantType):

        def told(v: Column) -> Column:
            text = to_pretty_json(v, kind) if pretty else to_compact_json(v, kind)
            return F.when(~F.is_variant_null(v), F.when(json_kind(v).isin("object", "array"), text).otherwise(F.try_variant_get(v, "$", "string")))

        return bound(col, told)
    return col.cast("string")


def first_of(record: Column | str, schema: T.DataType, *options: str) -> Column:
    """The text of the first option that is not null."""
    return F.coalesce(*(as_text(field(record, schema, o), type_at(schema, parse_path(o))) for o in options))


def which_of(record: Column | str, schema: T.DataType, *options: str) -> Column:
    """The name of the first option that is not null."""
    return F.coalesce(*(F.when(field(record, schema, o).isNotNull(), F.lit(o)) for o in options))


# -- testing -------------------------------------------------------------------------------------


def truthy_value(col: Column, kind: T.DataType | None) -> Column:
    """False for null, empty text, false, 0, NaN, and objects and arrays without a value."""
    if kind is None:
        out = F.lit(False)
    elif isinstance(kind, T.StringType):
        out = col != ""
    elif isinstance(kind, T.BooleanType):
        out = col
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = (col != 0) & ~F.isnan(col)
    elif isinstance(kind, T.NumericType):
        out = col != 0
    elif isinstance(kind, T.StructType):
        out = F.lit(False)
        for n in kind.names:
            out = out | col.getField(n).isNotNull()
    elif isinstance(kind, T.ArrayType):
        out = F.exists(col, lambda x: x.isNotNull())
    elif isinstance(kind, T.VariantType):
        out = bound(col, truthy_variant)
    else:
        out = col.isNotNull()
    return F.coalesce(out, F.lit(False))


def truthy_variant(v: Column | str) -> Column:
    v = _col(v)
    s = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    held = F.exists(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: x.isNotNull() & ~F.is_variant_null(x))
    items = F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: x.isNotNull() & ~F.is_variant_null(x))
    out = (
        F.when(s.startswith("OBJECT"), held).when(s.startswith("ARRAY"), items)
        .when(s == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(s == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(s == "VOID", F.lit(False)).otherwise((number != 0) & ~F.isnan(number))
    )
    return F.coalesce(out, F.lit(False))


def has_key(record: Column | str, schema: T.DataType, *options: str) -> Column:
    """Whether any option is there and not null; empty and zero values count."""
    out = F.lit(False)
    for o in options:
        out = out | field(record, schema, o).isNotNull()
    return out


def truthy(record: Column | str, schema: T.DataType, *options: str) -> Column:
    """Whether the first option that is not null is truthy."""
    out: Column | None = None
    for o in options:
        col = field(record, schema, o)
        test = truthy_value(col, type_at(schema, parse_path(o)))
        out = F.when(col.isNotNull(), test) if out is None else out.when(col.isNotNull(), test)
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def any_truthy(record: Column | str, schema: T.DataType, *options: str) -> Column:
    """Whether any option is truthy."""
    out = F.lit(False)
    for o in options:
        out = out | truthy_value(field(record, schema, o), type_at(schema, parse_path(o)))
    return out


def is_empty_json(col: Column | str, kind: T.DataType) -> Column:
    """Whether a value is null, empty text, or an object or array without a value."""
    col = _col(col)
    if isinstance(kind, (T.StringType, T.StructType, T.ArrayType)):
        return ~truthy_value(col, kind)
    if isinstance(kind, T.VariantType):
        return json_kind(col).isin("object", "array", "string", "null") & ~truthy_variant(col)
    return col.isNull()


# -- changing ------------------------------------------------------------------------------------

Used = dict[Path, Column]


def without(col: Column, kind: T.DataType, used: Used, at: Path = ()) -> Column:
    """The value with every path of ``used`` null where its condition holds. Slots of arrays keep their place."""
    inner = {p for p in used if p[: len(at)] == at and len(p) > len(at)}
    if at in used:
        out = without(col, kind, {p: c for p, c in used.items() if p != at}, at)
        return F.when(~F.coalesce(used[at], F.lit(False)), out)
    if not inner:
        return col
    if isinstance(kind, T.StructType):
        parts = [without(col.getField(f.name), f.dataType, used, (*at, f.name)).alias(f.name) for f in kind.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.VariantType):
        return _variant_without(col, used, at, inner)
    if isinstance(kind, T.ArrayType):
        slots = sorted({p[len(at)] for p in inner if isinstance(p[len(at)], int)})

        def slot(x: Column, i: Column) -> Column:
            out = x
            for n in slots:
                out = F.when(i == n, without(x, kind.elementType, used, (*at, n))).otherwise(out)
            return out

        return F.transform(col, slot) if slots else col
    return col


_NULL = "parse_json('null')"


def _variant_without(col: Column, used: Used, at: Path, inner: set[Path]) -> Column:
    """``without`` for a variant: whatever else it holds stays, objects and arrays are taken apart only along the paths."""
    heads = {p[len(at)] for p in inner}
    none = F.expr(_NULL)

    def part(x: Column, head: str | int) -> Column:
        return F.coalesce(without(x, T.VariantType(), used, (*at, head)), none)

    def name(k: Column, x: Column) -> Column:
        out = x
        for h in (h for h in heads if isinstance(h, str)):
            out = F.when(k == h, part(x, h)).otherwise(out)
        return out

    def slot(x: Column, i: Column) -> Column:
        out = x
        for h in (h for h in heads if isinstance(h, int)):
            out = F.when(i == h, part(x, h)).otherwise(out)
        return out

    members, items = F.try_variant_get(col, "$", "map<string,variant>"), F.try_variant_get(col, "$", "array<variant>")
    out = F.when(members.isNotNull(), F.to_variant_object(F.transform_values(members, name)))
    return out.when(items.isNotNull(), F.to_variant_object(F.transform(items, slot))).otherwise(col)


def drop_field(record: Column | str, schema: T.DataType, *paths: str) -> Column:
    """The record with the fields or slots at ``paths`` set to null."""
    return without(_col(record), schema, {parse_path(p): F.lit(True) for p in paths})


def set_field(record: Column | str, name: str, value: Column, schema: T.DataType | None = None) -> Column:
    """The record with a field put in or replaced; dotted names reach into objects.

    A variant record needs its type as ``schema``; ``value`` is then a variant, and objects on the way
    that are missing are made.
    """
    if not isinstance(schema, T.VariantType):
        return _col(record).withField(name, value)

    def put(col: Column, rest: list[str]) -> Column:
        if not rest:
            return value
        members = F.coalesce(F.try_variant_get(col, "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
        other = F.map_filter(members, lambda k, _: k != rest[0])
        return F.to_variant_object(F.map_concat(other, F.create_map(F.lit(rest[0]), put(F.get(F.map_values(F.map_filter(members, lambda k, _: k == rest[0])), F.lit(0)), rest[1:]))))

    return put(_col(record), name.split("."))


def set_parsed(record: Column | str, name: str, text: Column | str, schema: T.DataType | str) -> Column:
    """``set_field`` with a parsed object or array."""
    return set_field(record, name, parse_struct(text, schema))


def update_at(record: Column | str, schema: T.DataType, path: str, change) -> Column:
    """The record with the value at ``path`` replaced by ``change`` of it; paths that are not there change nothing."""

    def walk(col: Column, kind: T.DataType, rest: Path) -> Column:
        if not rest:
            return change(col)
        head = rest[0]
        if isinstance(head, int) and isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x, i: F.when(i == head, walk(x, kind.elementType, rest[1:])).otherwise(x))
        if isinstance(kind, T.VariantType):
            members, items = F.try_variant_get(col, "$", "map<string,variant>"), F.try_variant_get(col, "$", "array<variant>")
            inside = lambda x: F.coalesce(walk(x, kind, rest[1:]), F.expr(_NULL))
            if isinstance(head, int):
                return F.when(items.isNotNull(), F.to_variant_object(F.transform(items, lambda x, i: F.when(i == head, inside(x)).otherwise(x)))).otherwise(col)
            return F.when(members.isNotNull(), F.to_variant_object(F.transform_values(members, lambda k, x: F.when(k == head, inside(x)).otherwise(x)))).otherwise(col)
        if isinstance(kind, T.StructType) and head in kind.names:
            return F.when(col.isNotNull(), col.withField(head, walk(col.getField(head), kind[head].dataType, rest[1:])))
        return col

    return walk(_col(record), schema, parse_path(path))


# -- printing ------------------------------------------------------------------------------------


def has_content(col: Column, kind: T.DataType, used: Used, at: Path = ()) -> Column:
    """Whether anything is left to print once ``used`` is left out: some field that is neither null nor used.

    Objects and arrays are looked into only on the way to a used path; others count where they are
    not null, also without a value inside.
    """
    if at in used:
        return ~F.coalesce(used[at], F.lit(False)) & has_content(col, kind, {p: c for p, c in used.items() if p != at}, at)
    if at and not any(p[: len(at)] == at for p in used):
        return ~F.is_variant_null(col) & col.isNotNull() if isinstance(kind, T.VariantType) else col.isNotNull()
    if isinstance(kind, T.StructType):
        out = F.lit(False)
        for f in kind.fields:
            out = out | has_content(col.getField(f.name), f.dataType, used, (*at, f.name))
        return out
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(without(col, kind, used, at), lambda x: x.isNotNull()), F.lit(False))
    if isinstance(kind, T.VariantType):
        return truthy_value(without(col, kind, used, at), kind)
    return col.isNotNull()


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A null of an array, or a name with its null.
_NONE = rf"(?:{_STRING}:)?+null(?![^,}}\]])"
#: Nulls behind a bracket go with the comma after them, others with the one before; texts are passed over whole.
_NONES = rf"([{{\[])(?:{_NONE},?+)++|(?:,{_NONE})++|({_STRING})"


def without_nulls(text: Column) -> Column:
    """Compact JSON text without the nulls of its objects and arrays, at any depth, in one pass of one expression.

    Nothing depends on depth, and texts that hold no such letters are passed on.
    """
    clean = lambda t: F.regexp_replace(t, _NONES, "$1$2")
    return bound(text, lambda t: F.when(~F.contains(t, F.lit("null")) | (t == "null"), t).otherwise(clean(t)))


def pruned(col: Column, kind: T.DataType) -> Column:
    """Without the nulls in its arrays; those in objects are left out when printed, in variants here, at any depth."""
    if isinstance(kind, T.VariantType):
        return F.parse_json(without_nulls(F.to_json(col)))
    if isinstance(kind, T.ArrayType):
        none = lambda x: x.isNotNull() & ~F.is_variant_null(x) if isinstance(kind.elementType, T.VariantType) else x.isNotNull()
        inner = F.filter(col, none)
        return F.transform(inner, lambda x: pruned(x, kind.elementType)) if _has_array(kind.elementType) else inner
    if isinstance(kind, T.StructType) and _has_array(kind):
        return F.when(col.isNotNull(), F.struct(*(pruned(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    return col


def _has_array(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.VariantType)) or isinstance(kind, T.StructType) and any(_has_array(f.dataType) for f in kind.fields)


def to_compact_json(col: Column | str, kind: T.DataType) -> Column:
    """One line of JSON without nulls."""
    if isinstance(kind, T.VariantType):
        return without_nulls(F.to_json(_col(col)))
    return F.to_json(pruned(_col(col), kind))


class _Odd(ValueError):
    """Text that plain reading would print otherwise than a variant does."""


def _refuse(token: str) -> None:
    raise _Odd


def _integer(token: str) -> int:
    if len(token) > 17 or token == "-0":
        raise _Odd
    return int(token)


def _items(values: list) -> list:
    return [_items(x) if x.__class__ is list else x for x in values if x is not None]


def _members(pairs: list[tuple]) -> dict:
    held = dict(pairs)
    if len(held) != len(pairs):
        raise _Odd
    for name, x in pairs:
        if x is None:
            del held[name]
        elif x.__class__ is list:
            held[name] = _items(x)
    return held


_read = json.JSONDecoder(object_pairs_hook=_members, parse_float=_refuse, parse_int=_integer, parse_constant=_refuse).decode
_print = json.JSONEncoder(ensure_ascii=False, sort_keys=True, check_circular=False, separators=(",", ":")).encode


def _plain_without_nulls(text: str | None) -> str | None:
    """JSON text as a variant prints it, without nulls; none where that is not sure: fractions, long integers, names that
    repeat, written-out code points, signs beyond the basic plane, very long texts, and what is no JSON."""
    if text is None or len(text) > 1 << 20 or "\\u" in text or not text.isascii() and max(text) > "\uffff":
        return None
    collects = gc.isenabled()
    gc.disable()  # what is read holds no cycles, and is walked again and again where it is deep
    try:
        value = _read(text)
        return _print(_items(value) if value.__class__ is list else value)
    except (ValueError, RecursionError):
        return None
    finally:
        if collects:
            gc.enable()


def compact_json_text(text: Column | str) -> Column:
    """``to_compact_json`` of the variant that JSON text holds; plain text is read and printed row by row, nulls left out as it is read.

    The rest, and what is no JSON (an error), goes the way of variants, so results are the same. A variant is printed
    with a new generator for every name and string, which takes most of the time on deep records.
    """
    plain = F.udf(_plain_without_nulls, T.StringType(), useArrow=True)(_col(text))
    return F.coalesce(plain, to_compact_json(F.parse_json(_col(text)), T.VariantType()))


def to_pretty_json(col: Column | str, kind: T.DataType) -> Column:
    """Indented JSON without nulls."""
    return F.to_json(pruned(_col(col), kind), {"pretty": "true"})


def indent_by(text: Column, n: int) -> Column:
    """The text moved right by ``n`` blanks, all its lines."""
    return text if not n else F.concat(F.lit(" " * n), F.replace(text, F.lit("\n"), F.lit("\n" + " " * n)))
