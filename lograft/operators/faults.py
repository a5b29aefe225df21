"""Where and why a line is no record: an automaton over the pieces of bad lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.functions.records import bound
from lograft.operators.cleaning import BAD, computed_once

NO_RECORD = "neither an object nor an array"
ENDS_EARLY = "the line ends before the record does"
NO_NAME = "a name in quotes is missing"
NO_COLON = "a colon is missing after a name"
NO_VALUE = "a value is missing"
NOT_A_VALUE = "not a value"
OPEN_TEXT = "a text is not closed"
ODD_TEXT = "a text holds a control character or an unknown escape"
NO_COMMA_OBJECT = "a comma or a closing brace is missing"
NO_COMMA_ARRAY = "a comma or a closing bracket is missing"
EARLY_BRACE = "a brace closes where something is missing"
EARLY_BRACKET = "a bracket closes where something is missing"
#: Lines whose pieces are all in place: a name stands twice in an object, a number or the depth is too large.
OTHER = "a repeated name, or a number or depth beyond limits"

_SOUND = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"'
_CLOSED = r'"(?:[^"\\]++|\\(?s:.))*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
_PLAIN = rf"^(?:{_NUMBER}|true|false|null)$"


def _value(depth: int) -> str:
    """A sound value of at most ``depth`` levels, before a comma or the end of what holds it."""
    plain = rf"{_SOUND}|{_NUMBER}|true|false|null"
    if not depth:
        return f"(?:{plain})"
    inner = _value(depth - 1)
    return rf"(?:{plain}|{_boxed(inner)})"


def _boxed(inner: str) -> str:
    """An object or an array of values ``inner``, with nothing wrong in it."""
    members = rf'\{{\s*+(?:{_SOUND}\s*+:\s*+{inner}\s*+(?:,\s*+(?=")|(?=\}})))*+\}}'
    return members + rf"|\[\s*+(?:{inner}\s*+(?:,\s*+(?!\])|(?=\])))*+\]"


#: Sound members of an object, each with the comma behind it.
_MEMBERS = rf"(?:{_SOUND}\s*+:\s*+{_value(3)}\s*+,\s*+)++"
_NAME = rf"^{_SOUND}\s*+"
#: Pieces of a line: whole sound objects and arrays, sound members, a sound text, one that is closed, one that is not, a
#: sign, blanks, anything else. So a line has few pieces but where it is broken or deep.
_PIECE = rf'{_boxed(_value(2))}|{_MEMBERS}|{_SOUND}|{_CLOSED}|(?s:".*)|[{{}}\[\]:,]|[ \t\r\n]++|[^\s"{{}}\[\]:,]++|\s'


def _step(s: Column, piece: Column) -> Column:
    """One piece further. ``want``: v a value, a a value or the end of an array, k a name or the end of an
    object, n a name, c a colon, s a comma or an end, e nothing more; ``open``: the brackets that are open."""
    want, top = s["want"], F.substring(s["open"], -1, 1)
    head = F.substring(piece, 1, 1)
    is_text = head == '"'
    members = is_text & (F.substring(piece, -1, 1) != '"') & piece.rlike(rf"{_NAME}:")
    boxed = head.isin("{", "[") & (F.length(piece) > 1)
    said = F.when(members | piece.rlike(rf"^{_SOUND}$"), F.lit(None)).when(piece.rlike(rf"^{_CLOSED}$"), ODD_TEXT).otherwise(OPEN_TEXT)
    wants_value, wants_name = want.isin("v", "a"), want.isin("k", "n")
    closes = (head == "}") & ((want == "k") | (want == "s") & (top == "{")) | (head == "]") & ((want == "a") | (want == "s") & (top == "["))
    opens = wants_value & head.isin("{", "[")
    no_comma = F.when(top == "{", NO_COMMA_OBJECT).otherwise(NO_COMMA_ARRAY)
    value = F.when(members, no_comma).when(is_text, said).when(head == "]", EARLY_BRACKET).when(head == "}", EARLY_BRACE).when(head.isin(",", ":"), NO_VALUE).when(~piece.rlike(_PLAIN), NOT_A_VALUE)
    fault = (
        F.when(closes | opens, F.lit(None))
        .when(wants_value, value)
        .when(wants_name, F.when(is_text, said).when(head == "}", EARLY_BRACE).otherwise(NO_NAME))
        .when(want == "c", F.when(head != ":", NO_COLON))
        .otherwise(F.when(head != ",", no_comma))
    )
    # The name of members where a value is wanted is that value, and the colon behind it is the fault.
    place = s["at"] + F.when(wants_value & members, F.length(F.regexp_extract(piece, _NAME, 0))).otherwise(0)
    left = F.when(closes, F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)).when(opens & ~boxed, F.concat(s["open"], head)).otherwise(s["open"])
    after = (
        F.when(closes, F.when(F.length(s["open"]) == 1, "e").otherwise("s"))
        .when(opens & boxed, F.when(s["open"] == "", "e").otherwise("s"))
        .when(opens, F.when(head == "{", "k").otherwise("a"))
        .when(wants_value, "s").when(wants_name, F.when(members, "n").otherwise("c")).when(want == "c", "v").otherwise(F.when(top == "{", "n").otherwise("v"))
    )
    over = s["fault"].isNotNull() | (want == "e") | piece.rlike(r"^\s")
    at = (s["at"] + F.length(piece)).alias("at")
    passed = F.struct(at, *(s[n].alias(n) for n in ("want", "open", "fault", "place")))
    return F.when(over, passed).otherwise(F.struct(at, after.alias("want"), left.alias("open"), fault.alias("fault"), place.alias("place")))


def fault_of(clean: Column | str) -> Column:
    """``at, reason`` of the first fault of a line that is no record, ``at`` in characters from 0.

    A text that does not end is told at its start, a line that ends too early behind its last character.
    """
    text = F.col(clean) if isinstance(clean, str) else clean
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("at"), F.lit("v").alias("want"), F.lit("").alias("open"), none.alias("fault"), F.lit(None).cast("int").alias("place"))

    def told(s: Column) -> Column:
        early = F.when(s["want"] != "e", F.struct(s["at"].alias("at"), F.lit(ENDS_EARLY).alias("reason"))).otherwise(F.struct(F.lit(None).cast("int").alias("at"), F.lit(OTHER).alias("reason")))
        return F.when(s["fault"].isNotNull(), F.struct(s["place"].alias("at"), s["fault"].alias("reason"))).otherwise(early)

    walked = bound(F.aggregate(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), start, _step), told)
    whole = F.substring(text, 1, 1).isin("{", "[")
    return F.when(~whole, F.struct(F.lit(0).alias("at"), F.lit(NO_RECORD).alias("reason"))).otherwise(walked)


def explain_bad(classified: DataFrame) -> DataFrame:
    """Add ``error_at`` and ``error_reason``, null for records and blank lines, which are not looked at again."""
    found = computed_once(classified, fault=F.when(F.col("status").isin(*BAD), fault_of("clean")))
    return found.select(*classified.columns, F.col("fault.at").alias("error_at"), F.col("fault.reason").alias("error_reason"))


def fault_report(classified: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """Per source and reason: bad lines, the first of them, and the place of its fault."""
    bad = explain_bad(classified.filter(F.col("status").isin(*BAD)))
    group = [*(by or ["source"]), "error_reason"]
    return bad.groupBy(*group).agg(F.count("*").alias("lines"), F.min(order).alias("first_line"), F.min_by("error_at", order).alias("first_at"))

