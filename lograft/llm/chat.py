"""Chat formatting from event logs, all in DataFrame operations.

A conversation is a log of events. Partitioned by conversation and sorted by sequence, the log is
folded into final messages, which are then rendered with a loss mask. Reading the rendered text back
gives the messages again, whatever stands in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (first two) and of other common templates. Fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
#: Before a digit this sign is an escape: 0 itself, 1 inside a control string, 2 a line break of a role.
_ESC = "\u2063"


def escape(text: Column) -> Column:
    """Break every control string after its first character; the escape sign itself is marked too."""
    marked = F.replace(text, F.lit(_ESC), F.lit(_ESC + "0"))
    rests = "|".join(sorted({_quoted(c[1:]) for c in CONTROL}))
    return F.regexp_replace(marked, rf"([<\[])(?={rests})", "$1" + _ESC + "1")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "\\|[]()<>/.*+?{}^$" else c for c in s)


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESC + "1"), F.lit("")), F.lit(_ESC + "0"), F.lit(_ESC))


def _role_in(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(_ESC + "2"))


def _role_out(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(_ESC + "2"), F.lit("\n")))


def events_of(messages: DataFrame) -> DataFrame:
    """The log of a table of finished messages (conv_id, turn, role, text), as a chat service would have written it.

    Every row becomes a message of its own, also where turns repeat, and comes in pieces, so that its
    text exists only once the log is folded. By the hash of the text a message is streamed (two deltas),
    regenerated (its end as a draft, then a new start and a delta) or edited (its start twice over, an
    edit, and a delta). Texts of less than two characters have an empty first piece.
    """
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    step = lambda seq, kind, said, role=None: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), (F.col("role") if role else F.lit(None).cast("string")).alias("role"), said.alias("text"))
    way = F.pmod(F.xxhash64(text), F.lit(3))
    log = (
        F.when(way == 0, F.array(step(0, "delta", head, True), step(1, "delta", tail)))
        .when(way == 1, F.array(step(0, "delta", tail, True), step(1, "regenerate", head), step(2, "delta", tail)))
        .otherwise(F.array(step(0, "delta", F.concat(head, head), True), step(1, "edit", head), step(2, "delta", tail)))
    )
    rows = messages.select("conv_id", F.monotonically_increasing_id().alias("msg"), "turn", log.alias("log"))
    return rows.select("conv_id", "msg", "turn", F.explode("log").alias("e")).select("conv_id", "msg", "turn", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, turns``: the final messages of each conversation as an array of (msg, role, text).

    ``events`` has conv_id, msg, seq, kind, role, text, and optionally turn. Per message, in the order of
    seq: ``delta`` adds text at the end; ``edit`` and ``regenerate`` put their text in place of all
    before. Messages follow each other by turn (msg, where there is none), then by role, text and msg;
    ties of seq go by kind, role and text. The role is that of the last event that names one, else
    empty. Null text is empty, null keys are keys like any other (first in order), null and unknown
    kinds count as ``delta``. Other columns are ignored; no events, no conversations.

    The log is dealt by conversation once. Messages are folded on their own and only then gathered, so
    what was superseded is gone before a conversation comes together.
    """
    place = F.col("turn") if "turn" in events.columns else F.col("msg")
    e = events.select(
        "conv_id", "msg", place.alias("place"), "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role",
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log")
    each = e.groupBy("conv_id", "msg").agg(F.min("place").alias("place"), log)
    start = F.expr("coalesce(array_max(transform(log, (x, i) -> if(x.kind in ('edit', 'regenerate'), i, 0))), 0)")
    done = each.withColumn("start", start).select(
        "conv_id", "msg", "place",
        F.expr("coalesce(get(reverse(filter(log, x -> x.role is not null)), 0).role, '')").alias("role"),
        F.expr("array_join(transform(slice(log, start + 1, size(log)), x -> x.text), '')").alias("text"),
    )
    turn = F.struct("place", "role", "text", "msg")
    whole = done.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select("conv_id", F.expr("transform(turns, x -> struct(x.msg, x.role, x.text))").alias("turns"))


def render(folded: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss``: the rendered conversation and its loss spans.

    ``loss`` lists (start, length) in code points, one span for the text of each message whose role is
    in ``learn``; marks and roles stay outside. A conversation without messages is an empty text.
    """
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _role_in(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(*learn).alias("learn"),
        ),
    )
    tail = CLOSE + "\n"
    out = folded.select("conv_id", pieces.alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    spans = F.expr(
        "aggregate(pieces, struct(0 as at, cast(array() as array<struct<start:int,length:int>>) as spans),"
        " (a, p) -> struct("
        f"a.at + length(p.head) + length(p.body) + {len(tail)} as at,"
        " if(p.learn, array_append(a.spans, struct(a.at + length(p.head) as start, length(p.body) as length)), a.spans) as spans)).spans"
    )
    return out.select("conv_id", formatted.alias("formatted"), spans.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars`` from the rendered text alone: (role, text) per message, and all text under the loss mask."""
    marks = F.split("formatted", _quoted(OPEN))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        size = F.length(x) - F.length(role) - 1 - len(CLOSE) - 1
        return F.struct(_role_out(role).alias("role"), unescape(F.substring(x, F.length(role) + 2, size)).alias("text"))

    turns = F.transform(F.slice(marks, 2, F.size(marks)), turn)
    learned = F.array_join(F.transform("loss", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])), "")
    return rendered.select(
        "conv_id", turns.alias("turns"), unescape(learned).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def digest(read: DataFrame) -> DataFrame:
    """The digest columns of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
