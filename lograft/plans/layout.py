"""Layouts: what to print for a record, built in Python as one column expression.

A layout is a list of pieces: text, ``arg`` (the first option that is there), ``whole`` (the record),
``rest`` (what has not been printed so far on this row), ``when_key`` and ``when_if`` (branches), and
``ref`` (a named layout). Building runs once, on the driver; rows only meet built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft.functions import records as R
from lograft.functions.paths import Path, parse_path
from lograft.operators.normalize import LEVEL, MESSAGE, TIMESTAMP

WHOLE, REST = ".", ".."


@dataclass(frozen=True)
class Arg:
    options: tuple[str, ...]
    compact: bool | None = None
    indent: int = 0


@dataclass(frozen=True)
class Ref:
    """Named layouts; several must each be one list of options, which are joined."""

    names: tuple[str, ...]
    compact: bool | None = None
    indent: int = 0


@dataclass(frozen=True)
class Cond:
    """Branches tried in order: (kind, options, pieces); the first that holds is printed, else ``otherwise``."""

    branches: tuple[tuple[str, tuple[str | Ref, ...], tuple], ...]
    otherwise: tuple = ()

    def else_key(self, options: str | list, *then) -> Cond:
        return replace(self, branches=(*self.branches, ("key", _options(options), then)))

    def else_if(self, options: str | list, *then) -> Cond:
        return replace(self, branches=(*self.branches, ("if", _options(options), then)))

    def else_any(self, options: str | list, *then) -> Cond:
        return replace(self, branches=(*self.branches, ("any", _options(options), then)))

    def else_(self, *then) -> Cond:
        return replace(self, otherwise=then)


Piece = str | Arg | Ref | Cond
Layouts = Mapping[str, list]


def _options(options) -> tuple:
    return (options,) if isinstance(options, (str, Ref)) else tuple(options)


def arg(*options: str, compact: bool | None = None, indent: int = 0) -> Arg:
    """The first option that is not null; nothing (but its indent) where all are."""
    return Arg(options, compact, indent)


def whole(compact: bool | None = None, indent: int = 0) -> Arg:
    return Arg((WHOLE,), compact, indent)


def rest(compact: bool | None = None, indent: int = 0) -> Arg:
    return Arg((REST,), compact, indent)


def ref(*names: str, compact: bool | None = None, indent: int = 0) -> Ref:
    return Ref(names, compact, indent)


def when_key(options, *then) -> Cond:
    """A branch taken where an option is there and not null."""
    return Cond((("key", _options(options), then),))


def when_if(options, *then) -> Cond:
    """A branch taken where the first option that is not null is truthy."""
    return Cond((("if", _options(options), then),))


def when_any(options, *then) -> Cond:
    """A branch taken where any option is truthy."""
    return Cond((("any", _options(options), then),))


def layout_switch(on: bool, then: list, otherwise: list = ()) -> list:
    """A choice made once, when the layout is built."""
    return list(then if on else otherwise)


def named_layouts(*layers: Layouts) -> dict[str, list]:
    """Layers of named layouts merged, later ones over earlier ones."""
    out: dict[str, list] = {}
    for layer in layers:
        out.update(layer)
    return out


#: What the default layout prints: a name for each part, to be overridden, and its fields.
PARTS: Layouts = {
    "time": [arg(*TIMESTAMP)],
    "level": [arg(*LEVEL)],
    "message": [arg(*MESSAGE)],
    "data": [rest()],
}


def default_layout(parts: Layouts | None = None, compact: bool = True) -> list:
    """Time, level and message, each with a blank after it where it is there, then all other fields.

    A part with fields shows where one of them is there, so it may say more than the field; one without
    always shows. The other fields follow on a line of their own unless ``compact``.
    """
    named, out, heads = named_layouts(PARTS, parts or {}), [], []
    for name in ("time", "level", "message"):
        fields = [o for p in named[name] if isinstance(p, Arg) for o in p.options]
        after = [] if name == "message" else [" "]
        heads += fields
        out += [when_key(fields, *named[name], *after)] if fields else named[name]
    gap = [when_key(heads, " " if compact else "\n")] if heads else []
    return [*out, *gap, *named["data"]]


@dataclass
class _Builder:
    record: Column
    schema: T.DataType
    layouts: Layouts
    compact: bool
    omit_empty_rest: bool
    #: Gives the outcome of a test on one field, by the name of the test; the column computes it.
    flag: Callable[[tuple[str, str], Column], Column]
    used: dict[Path, Column] = field(default_factory=dict)

    def there(self, option: str) -> Column:
        return self.flag(("there", option), R.field(self.record, self.schema, option).isNotNull())

    def true(self, option: str) -> Column:
        col = R.field(self.record, self.schema, option)
        return self.flag(("true", option), R.truthy_value(col, R.type_at(self.schema, parse_path(option))))

    def splice(self, names: tuple[str, ...], seen: tuple[str, ...] = ()) -> Arg | list | None:
        """One list of options from several named layouts; empty layouts vanish."""
        found = []
        for n in names:
            if n in seen:
                raise ValueError(f"layout {n!r} refers to itself")
            pieces = [p for p in self.layouts[n] if p != ""]
            if len(names) == 1 and (len(pieces) != 1 or not isinstance(pieces[0], (Arg, Ref))):
                return list(pieces) or None
            if len(pieces) > 1:
                raise ValueError(f"layout {n!r} is more than a list of fields")
            for p in pieces:
                p = self.splice(p.names, (*seen, n)) if isinstance(p, Ref) else p
                if p is not None and not isinstance(p, Arg):
                    raise ValueError(f"layout {n!r} is more than a list of fields")
                if p is not None:
                    found.append(p)
        if not found:
            return None
        options = tuple(o for p in found for o in p.options)
        return replace(found[0], options=options) if len(found) > 1 else found[0]

    def options(self, given: tuple) -> tuple[str, ...]:
        out: list[str] = []
        for o in given:
            got = self.splice(o.names) if isinstance(o, Ref) else Arg((o,))
            if got is not None and not isinstance(got, Arg):
                raise ValueError("a condition takes fields only")
            out += got.options if got else ()
        return tuple(out)

    def test(self, kind: str, given: tuple) -> Column:
        options = self.options(given)
        if not options:
            return F.lit(False)
        if REST in options:
            return F.lit(True) if kind == "key" else R.has_content(self.record, self.schema, self.used)
        if WHOLE in options:
            return F.lit(True) if kind == "key" else R.truthy_value(self.record, self.schema)
        if kind != "if":
            return reduce(Column.__or__, map(self.there if kind == "key" else self.true, options))
        first = F.when(self.there(options[0]), self.true(options[0]))
        return reduce(lambda out, o: out.when(self.there(o), self.true(o)), options[1:], first).otherwise(F.lit(False))

    def value(self, a: Arg, active: Column | None) -> Column:
        compact = self.compact if a.compact is None else a.compact
        if a.options == (WHOLE,):
            out = R.as_text(self.record, self.schema, pretty=not compact)
        elif a.options == (REST,):
            left = R.without(self.record, self.schema, self.used)
            out = R.as_text(left, self.schema, pretty=not compact)
            if self.omit_empty_rest:
                out = F.when(R.has_content(self.record, self.schema, self.used), out)
        else:
            texts, earlier = [], F.lit(False)
            for o in a.options:
                at = parse_path(o)
                col, kind = R.field(self.record, self.schema, o), R.type_at(self.schema, at)
                texts.append(R.as_text(col, kind, pretty=not compact))
                if kind is not None:
                    chosen = self.there(o) & ~earlier if active is None else active & self.there(o) & ~earlier
                    self.used[at] = self.used[at] | chosen if at in self.used else chosen
                    earlier = earlier | self.there(o)
            out = F.coalesce(*texts)
        return R.indent_by(F.coalesce(out, F.lit("")), a.indent)

    def build(self, pieces, active: Column | None = None, seen: tuple[str, ...] = ()) -> Column:
        out: list[Column] = []
        for p in pieces:
            if isinstance(p, Ref):
                for n in p.names:
                    if n in seen:
                        raise ValueError(f"layout {n!r} refers to itself")
                got = self.splice(p.names)
                if isinstance(got, Arg):
                    p = replace(got, compact=got.compact if p.compact is None else p.compact, indent=p.indent or got.indent)
                elif got is None:
                    continue
                else:
                    out.append(self.build(got, active, (*seen, *p.names)))
                    continue
            if isinstance(p, str):
                out.append(F.lit(p))
            elif isinstance(p, Arg):
                out.append(self.value(p, active))
            else:
                out.append(self.branch(p, active, seen))
        return F.concat(*out) if out else F.lit("")

    def branch(self, cond: Cond, active: Column | None, seen: tuple[str, ...]) -> Column:
        done, out = F.lit(False), None
        for kind, given, then in cond.branches:
            test = self.test(kind, given)
            here = test & ~done if active is None else active & test & ~done
            text = self.build(then, here, seen)
            out = F.when(test, text) if out is None else out.when(test, text)
            done = done | test
        last = ~done if active is None else active & ~done
        return out.otherwise(self.build(cond.otherwise, last, seen))


def layout_column(
    record: Column | str, schema: T.DataType, pieces: list, layouts: Layouts | None = None,
    compact: bool = True, omit_empty_rest: bool = False,
) -> Column:
    """The text of each record; null where the record is.

    Tests on fields of a variant are long expressions that branches and what is left over refer to again and again,
    so each is computed once, into an array of outcomes. Tests on a struct are short and stay in place.
    """
    col = F.col(record) if isinstance(record, str) else record

    def text(flag: Callable[[tuple[str, str], Column], Column]) -> Column:
        return _Builder(col, schema, layouts or {}, compact, omit_empty_rest, flag).build(pieces)

    if not isinstance(schema, T.VariantType):
        return F.when(col.isNotNull(), text(lambda _, test: test))
    tests: dict[tuple[str, str], Column] = {}
    text(lambda name, test: tests.setdefault(name, test))
    place = {name: k for k, name in enumerate(tests)}
    outcomes = F.array(*tests.values()) if tests else F.array(F.lit(False))
    return F.when(col.isNotNull(), R.bound(outcomes, lambda got: text(lambda name, _: F.get(got, F.lit(place[name])))))


def render(df: DataFrame, pieces: list, record: str = "r", layouts: Layouts | None = None, **how: bool) -> DataFrame:
    """Add ``text``, one rendered text per record of the struct or variant column ``record``.

    Of a struct the declared fields are printed, of a variant whatever the record holds, arrays too.
    """
    return df.withColumn("text", layout_column(record, df.schema[record].dataType, pieces, layouts, **how))


def default_render(df: DataFrame, record: str = "r", layouts: Layouts | None = None, compact: bool = True, **how: bool) -> DataFrame:
    """``timestamp level message``, then all other fields as JSON; ``layouts`` override the ``PARTS`` by name."""
    return render(df, default_layout(layouts, compact), record, layouts, compact=compact, **how)
