"""Layouts of random pieces on random records, against a plain evaluator of the rules; and what randomness does not reach."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft.functions import records as R
from lograft.functions.paths import parse_path
from lograft.plans import layout as L
from lograft.plans.layout import arg, ref, rest, when_any, when_if, when_key, whole

_TEXT, _LONG = T.StringType(), T.LongType()
_INNER = T.StructType().add("deep", _TEXT).add("n", _LONG)
_UNIT = T.StructType().add("id", _LONG).add("tag", _TEXT).add("slots", T.ArrayType(_TEXT)).add("inner", _INNER)
SCHEMA = T.StructType().add("zone", _TEXT).add("n", _LONG).add("up", T.BooleanType()).add("unit", _UNIT)
SCHEMA = SCHEMA.add("runs", T.ArrayType(T.StructType().add("k", _LONG).add("s", _TEXT))).add("timestamp", _TEXT).add("severity", _TEXT).add("body", _TEXT)
PATHS = ("zone", "n", "up", "unit", "unit.id", "unit.tag", "unit.slots", "unit.slots[0]", "unit.slots[2]", "unit.inner", "unit.inner.deep", "unit.inner.n", "runs", "runs[0]", "runs[1].s", "runs[1].k", "absent", "unit.absent")


# -- a plain evaluator


def at(x, path):
    for p in parse_path(path):
        if isinstance(p, int):
            x = x[p] if isinstance(x, list) and p < len(x) else None
        else:
            x = x.get(p) if isinstance(x, dict) else None
    return x


def cut_out(x, path):
    *way, last = parse_path(path)
    for p in way:
        x = x[p] if isinstance(x, list) and p < len(x) else x.get(p) if isinstance(x, dict) and isinstance(p, str) else None
        if x is None:
            return
    if isinstance(x, list) and isinstance(last, int) and last < len(x) or isinstance(x, dict) and last in x:
        x[last] = None


def no_nulls(x):
    if isinstance(x, dict):
        return {k: no_nulls(v) for k, v in x.items() if v is not None}
    return [no_nulls(v) for v in x if v is not None] if isinstance(x, list) else x


def shown(x, ordered):
    if isinstance(x, str):
        return x
    return json.dumps(no_nulls(x), separators=(",", ":"), sort_keys=ordered, ensure_ascii=False)


def holds(x):
    return any(v is not None for v in (x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else bool(x)


def said(record, pieces, ordered, used):
    out = ""
    for p in pieces:
        if isinstance(p, str):
            out += p
        elif isinstance(p, L.Cond):
            for kind, options, then in p.branches:
                values = [at(record, o) for o in options]
                there = [v for v in values if v is not None]
                if bool(there) if kind == "key" else any(map(holds, there)) if kind == "any" else bool(there) and holds(there[0]):
                    out += said(record, then, ordered, used)
                    break
            else:
                out += said(record, p.otherwise, ordered, used)
        else:
            if p.options == (L.WHOLE,):
                text = shown(record, ordered)
            elif p.options == (L.REST,):
                left = copy.deepcopy(record)
                for path in used:
                    cut_out(left, path)
                text = shown(left, ordered)
            else:
                first = next((o for o in p.options if at(record, o) is not None), None)
                text = "" if first is None else shown(at(record, first), ordered)
                used |= {first} - {None}
            out += " " * p.indent + text
    return out


# -- random input


def a_record(rng):
    maybe = lambda make: make() if rng.random() < 0.7 else None
    text = lambda: rng.choice(["", "x", "two words", 'a "quote" \\', "null", "é:null,", "0"])
    number = lambda: rng.choice([0, 1, -7, 10**12])
    some = lambda pairs: {k: v for k, v in pairs.items() if v is not None or rng.random() < 0.5}
    inner = lambda: some({"deep": maybe(text), "n": maybe(number)})
    unit = lambda: some({"id": maybe(number), "tag": maybe(text), "slots": maybe(lambda: [maybe(text) for _ in range(rng.randrange(4))]), "inner": maybe(inner)})
    runs = lambda: [maybe(lambda: some({"k": maybe(number), "s": maybe(text)})) for _ in range(rng.randrange(3))]
    return some({"zone": maybe(text), "n": maybe(number), "up": maybe(lambda: rng.random() < 0.5), "unit": maybe(unit), "runs": maybe(runs)})


def some_pieces(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if kind < 0.2:
            out.append(rng.choice(["-", " ", "{}", "'\"", "\\n", "é"]))
        elif kind < 0.6 or depth == 1:
            out.append(arg(*rng.sample(PATHS, rng.randrange(1, 4)), indent=rng.choice([0, 0, 0, 2])))
        elif kind < 0.7:
            out.append(rng.choice([whole(), rest(), rest()]))
        else:
            options = lambda: rng.sample(PATHS, rng.randrange(1, 3))
            cond = rng.choice([when_key, when_if, when_any])(options(), *some_pieces(rng, depth + 1))
            for _ in range(rng.randrange(3)):
                cond = rng.choice([cond.else_key, cond.else_if, cond.else_any])(options(), *some_pieces(rng, depth + 1))
            out.append(cond.else_(*some_pieces(rng, depth + 1)) if rng.random() < 0.6 else cond)
    return out


@pytest.mark.parametrize("view", ["struct", "variant"])
def test_random_layouts(spark, view):
    rng = random.Random(view)
    records = [a_record(rng) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i long, line string")
    df = df.select("i", F.parse_json("line").alias("r") if view == "variant" else R.parse_struct("line", SCHEMA).alias("r"))
    layouts = [some_pieces(rng) + rng.choice([[], [rest()]]) for _ in range(16 if view == "struct" else 8)]
    kind = df.schema["r"].dataType
    got = df.select("i", *(L.layout_column("r", kind, p).alias(f"t{k}") for k, p in enumerate(layouts))).collect()
    for row in got:
        for k, pieces in enumerate(layouts):
            record = records[row["i"]]
            if view == "struct":
                record = {n: record[n] for n in SCHEMA.names if n in record}
                if isinstance(record.get("unit"), dict):
                    record["unit"] = {n: record["unit"][n] for n in ("id", "tag", "slots", "inner") if n in record["unit"]}
            assert row[f"t{k}"] == said(record, pieces, view == "variant", set()), (record, pieces)


# -- what is left over, by hand


def _one(spark, line, pieces, kind=SCHEMA, **how):
    parse = F.parse_json("line") if kind == "variant" else R.parse_struct("line", kind)
    df = spark.createDataFrame([(line,)], "line string").select(parse.alias("r"))
    return L.render(df, pieces, **how).first()["text"]


def test_what_is_left(spark):
    left = [when_if(L.REST, "more").else_("none")]
    assert _one(spark, '{"n":4}', [arg("n"), *left]) == "4none" and _one(spark, '{"n":4,"zone":""}', [arg("n"), *left]) == "4more"
    assert _one(spark, '{"unit":{"id":3}}', [arg("unit.id"), *left]) == "3none"
    assert _one(spark, '{"unit":{"id":3}}', [arg("unit.id"), when_key(L.REST, "yes").else_("no"), rest()]) == '3yes{"unit":{}}'
    assert _one(spark, '{"n":4}', [arg("n"), rest()], omit_empty_rest=True) == "4"
    assert _one(spark, "{}", [when_if(L.WHOLE, "1").else_("2"), when_key(L.WHOLE, "3"), rest()]) == "23{}"
    assert _one(spark, '[7,null,["x"]]', [whole(), " ", arg("[2][0]"), " ", rest()], "variant") == '[7,["x"]] x [7,[]]'


def test_nulls_go_at_any_depth(spark):
    deep = '{"p":[null,' * 400 + '{"q":null,"s":"\\":null"}' + "]}" * 400
    kept = '{"p":[' * 400 + '{"s":"\\":null"}' + "]}" * 400
    assert _one(spark, deep, [whole()], "variant") == kept
    plans = [L.render(spark.createDataFrame([(x,)], "line string").select(F.parse_json("line").alias("r")), [whole()])._jdf.queryExecution().executedPlan().toString() for x in ("{}", deep)]
    assert abs(len(plans[0]) - len(plans[1])) < 200
    mixed = T.StructType().add("a", T.VariantType()).add("b", T.ArrayType(T.VariantType()))
    df = spark.sql("""select named_struct('a', parse_json('{"x":[null,{"y":null}]}'), 'b', array(parse_json('null'), null, parse_json('[null]'))) as r""")
    assert df.select(R.to_compact_json("r", mixed)).first()[0] == '{"a":{"x":[{}]},"b":[[]]}'
    assert json.loads(df.select(R.to_pretty_json("r", mixed)).first()[0]) == {"a": {"x": [{}]}, "b": [[]]}


def test_default_parts(spark):
    line = '{"timestamp":"T","severity":"warn","body":"low","n":5}'
    df = spark.createDataFrame([(line,)], "line string").select(R.parse_struct("line", SCHEMA).alias("r"))
    text = lambda **how: L.default_render(df, **how).first()["text"]
    assert text() == 'T warn low {"n":5}'
    assert text(layouts={"level": [], "message": ["<", arg("body"), ">"]}) == 'T <low> {"n":5,"severity":"warn"}'
    assert text(layouts={"data": [whole()]}, compact=False).startswith('T warn low\n{\n  "')
    assert L.default_render(df.limit(0)).count() == 0 and _one(spark, "{}", L.default_layout()) == "{}"


def test_pretty_and_indent(spark):
    lines = _one(spark, '{"unit":{"id":1,"tag":"a"}}', [arg("unit", indent=3)], compact=False).split("\n")
    assert len(lines) == 4 and all(x.startswith("   ") for x in lines)


def test_names_that_loop_or_hold_more(spark):
    with pytest.raises(ValueError):
        _one(spark, "{}", [ref("a")], layouts={"a": [ref("b")], "b": [ref("a")]})
    with pytest.raises(ValueError):
        _one(spark, "{}", [ref("a", "b")], layouts={"a": ["text", arg("n")], "b": [arg("n")]})
    assert _one(spark, '{"zone":"z"}', [ref("none", "n", "zone")], layouts={"none": [], "n": [arg("n")], "zone": [arg("zone")]}) == "z"


def test_variants_are_changed(spark):
    v, kind = F.parse_json(F.lit('{"a":{"b":1,"c":[1,2]},"d":null}')), T.VariantType()
    made = spark.range(1).select(
        F.to_json(R.drop_field(v, kind, "a.b", "a.c[0]")), F.to_json(R.set_field(v, "a.n", F.parse_json(F.lit('"x"')), kind)),
        F.to_json(R.set_field(v, "p.q", F.parse_json(F.lit("7")), kind)), F.to_json(R.update_at(v, kind, "a.c[1]", lambda x: F.parse_json(F.lit("9")))),
    ).first()
    assert list(made) == [
        '{"a":{"b":null,"c":[null,2]},"d":null}', '{"a":{"b":1,"c":[1,2],"n":"x"},"d":null}',
        '{"a":{"b":1,"c":[1,2]},"d":null,"p":{"q":7}}', '{"a":{"b":1,"c":[1,9]},"d":null}',
    ]


def test_no_shuffle_and_no_python(spark):
    from lograft import queries as Q

    df = Q.default_render(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert df.filter(F.col("text").isNull()).count() == 0
