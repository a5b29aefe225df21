"""Personal data: strict patterns, and boosted trees over what looser generators propose.

Generators propose overlapping spans, far more than are personal data. Trees score each by its format
and what stands around it, and a calibrated threshold per kind selects what is added to the strict
patterns. Their labels come from the strict patterns where these apply, and from values of every
kind, and of things that look like them, put into texts of the corpus.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.boosting import Trees, boost
from lograft.llm.common import in_batches

#: Kinds with a strict pattern, and one that only the trees find.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: The strict patterns, as fixed values. Where a match of one can start only at the start of a run of
#: characters, the search says so, which keeps it linear in the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The generators: groups of digits and the signs between them, an at sign in several spellings, and
#: runs of characters that keys and passwords are made of.
_GROUP = re.compile(r"[0-9]++")
_BETWEEN = re.compile(r"[\x20().\-/]{0,4}|\x20?[\[(](?:dot|\.)[\])]\x20?", re.I)
_AT = re.compile(r"(\x20?)(@|[\[(]\x20?at\x20?[\])])(\x20?)", re.I)
_RIGHT = re.compile(r"[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\x20?\.\x20?)[A-Za-z0-9-]++)*+", re.I)
_LABEL_END = re.compile(r"(?<=[A-Za-z0-9-])(?=\x20?(?:\.|[\[(]dot)|\Z)", re.I)
_KEY = re.compile(r"[A-Za-z0-9_+/=.~\-]{8,}+")
#: Words that stand near data of a kind, or near what only looks like it.
CUES = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "addr", "login", "from"),
    "card": ("card", "visa", "credit", "paid", "debit", "amex"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "secret": ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential"),
    "none": ("order", "invoice", "version", "isbn", "build", "page", "commit", "sha", "md5", "checksum", "release", "serial", "tracking", "http", "id", "no.", "row"),
}
#: Ends of host names that most addresses have.
ENDS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "it", "nl", "eu", "co")
#: How keys of widely used services begin (fixed values).
HEADS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "hf_", "pypi-", "npm_", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ")
#: An address told in words, and what says that a password or key follows, digits or not.
_SAID = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++", re.I)
_TOLD = re.compile(r"(?:token|secret|passw[a-z]{0,6}|pwd|key|auth|bearer|credentials?)[\"']?\x20?(?:[:=]|is)?\x20?[\"']?\Z", re.I)
_GOES_ON, _CAME_ON = re.compile(r"[.\-/\x20]?[0-9]"), re.compile(r"[0-9][.\-/\x20]?\Z")
_NEAR = 32

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the strict patterns find: leftmost, without overlap per kind, failing matches dropped."""
    out: list[Span] = []
    p, done = text.find("@"), 0
    while p >= 0:
        a = p
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < p and (m := _DOMAIN.match(text, p + 1)):
            out.append(("email", a, m.end()))
            done = m.end()
        else:
            done = max(done, p + 1)
        p = text.find("@", p + 1)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _numbers(text: str) -> Iterator[Span]:
    """Spans from one group of digits to another: what cards, phones and addresses may be, whatever numbers stand beside them.

    A span has at most 7 groups, so the work is linear in the text.
    """
    held: deque[tuple[int, int]] = deque()

    def first() -> Iterator[Span]:
        yield from _from_first(text, held)
        held.popleft()

    for m in _GROUP.finditer(text):
        apart = held and not (m.start() - held[-1][1] <= 9 and _BETWEEN.fullmatch(text, held[-1][1], m.start()))
        while held and (apart or len(held) == 7):
            yield from first()
        held.append(m.span())
    while held:
        yield from first()


def _from_first(text: str, groups: Iterable[tuple[int, int]]) -> Iterator[Span]:
    """Candidates that start at the first of these groups."""
    a, n, wide = -1, 0, []
    for k, (begin, end) in enumerate(groups):
        a = begin if k == 0 else a
        n += end - begin
        wide.append(end - begin)
        if n > 19:
            return
        if 13 <= n and max(wide) <= 19 and (k == 0 or min(wide) >= 3) and _luhn(_digits(text[a:end])):
            yield "card", a, end
        if 7 <= n <= 15 and k <= 5 and (k == 0 or min(wide) >= 2 or wide[0] <= 3 and min(wide[1:]) >= 2):
            first = a - 1 if a and text[a - 1] in "+(" else a
            yield "phone", first - (first > 0 and text[first] == "(" and text[first - 1] == "+"), end
        if k == 3 and max(wide) <= 3 and n >= 4:
            yield "ip", a, end


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data: far more than are. Linear in the text."""
    out = list(_numbers(text))
    low = "@" in text or ("at)" in (t := text.lower())) or ("at]" in t) or ("at )" in t) or ("at ]" in t)
    done = 0
    for m in _AT.finditer(text) if low else ():
        a = m.start()
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        done = m.end()
        if a < m.start() and (right := _RIGHT.match(text, m.end())):
            # An address has at most 320 characters; it may end after any part of its host.
            ends = [x.start() + m.end() for x in _LABEL_END.finditer(right[0][:320])]
            out += [("email", a, b) for b in (ends[1:] or [right.end()]) if b - a <= 320]
    if " dot " in text.lower():
        out += [("email", *m.span()) for m in _SAID.finditer(text) if m.end() - m.start() <= 320]
    for m in _KEY.finditer(text):
        s = m[0].rstrip(".=") if "=" in m[0] or m[0][-1] == "." else m[0]
        at = s.find("=") + 1 if 0 <= s.find("=") < len(s) - 8 else 0
        own = s[at:] if at else s
        if len(own) >= 8 and any(c.isalpha() for c in own) and (any(c.isdigit() for c in own) or _TOLD.search(text, max(0, m.start() + at - 24), m.start() + at)):
            out.append(("secret", m.start() + at, m.start() + len(s)))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format of a candidate, and what stands around it."""
    kind, a, b = span
    s = text[a:b]
    d = _digits(s)
    groups, seps = [len(x) for x in re.findall(r"[0-9]+", s)], re.findall(r"[^0-9]+", s)
    before, after = text[max(0, a - _NEAR) : a], text[b : b + _NEAR]
    near, left = before + after, before.lower()
    said = left.rstrip(" \"'`")
    host = re.split(r"@|[\[(]\x20?at\x20?[\])]|\x20at\x20", s, flags=re.I)[-1]
    dots = [x.strip() for x in re.split(r"\.|[\[(]dot[\])]|\x20dot\x20", host, flags=re.I)] if kind in ("email", "ip") else []
    counts = Counter(s)
    bits = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    sort = [any(c.islower() for c in s), any(c.isupper() for c in s), any(c.isdigit() for c in s)]
    return [
        *(kind == k for k in KINDS), len(s), len(d), len(groups), max(groups, default=0), min(groups, default=0), len(set(groups)),
        len(set(seps)), max(map(len, seps), default=0), s.count("."), s.count("-"), s.count("("), s.count(" "), s.count("/"), s.startswith("+"),
        _luhn(d) if 12 <= len(d) <= 19 else -1, max((int(x[-9:] or 0) for x in re.findall(r"[0-9]+", s)), default=-1) if kind == "ip" else -1,
        len(dots) if kind == "email" else -1, len(dots[-1]) if kind == "email" else -1, dots[-1].isalpha() if kind == "email" else -1,
        bool(before) and before[-1].isalnum(), bool(after) and after[0].isalnum(), bool(before) and before[-1] in "#$%=/._-", bool(after) and after[0] in "#$%=/_-@",
        bool(before) and before[-1] in "\"'`" and bool(after) and after[0] == before[-1], said[-1:] in ("=", ":") and bool(said),
        bool(_GOES_ON.match(after)), bool(_CAME_ON.search(before[-2:])), dots[-1].lower() in ENDS if kind == "email" else -1, kind == "email" and len(set(re.findall(r"\x20?(?:\.|[\[(]dot[\])])\x20?", s.rpartition("@")[2] if "@" in s else s))),
        bits, sum(sort), sum(c in "0123456789abcdef" for c in s) / len(s), sum(c.isalpha() for c in s) / len(s),
        sum(c.isalpha() for c in near) / max(1, len(near)), sum(c.isdigit() for c in near) / max(1, len(near)),
        s.startswith(HEADS), *(any(c in left for c in CUES[k]) for k in CUES),
    ]


def _value(kind: str, rng: random.Random) -> list[tuple[str, str, int]]:
    """Made values of a kind as (before, value, 1), and things that look like it as (before, value, 0)."""
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda k=0: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k or rng.randint(3, 9)))
    cue = lambda: rng.choice([*CUES[kind], ""]) + rng.choice([": ", " ", " = ", " is "]) if rng.random() < 0.6 else ""
    no = lambda: rng.choice([*CUES["none"]]) + rng.choice([": ", " ", " #", " "])
    if kind == "email":
        at, dot = rng.choice(["@", " @ ", "(at)", "[at]", " [at] ", " (at) "]), rng.choice([".", ".", " . ", "[dot]", " (dot) "])
        local, host, end = word() + rng.choice(["", ".", "_", n(2)]) + word(), word(), rng.choice(["com", "org", "de", "co", "net", "io"])
        return [
            (cue(), f"{local}{at}{host}{dot}{end}", 1), (cue(), f"{local} at {host} dot {end}", 1), ("", f"{word()} at {word()} dot {word(5)}", 0), (cue(), f"{local}{n(2)}{at}{host}{dot}{word()}{dot}{end}", 1), ("", f"{word()}@{n(3)}", 0), ("", f"{word()} @ {word()}", 0),
            ("", f"{word()}@{word()}", 0), ("", f"{word()} (at) {word()}", 0), (no(), f"{word()}@{n(1)}.{n(2)}.{n(1)}", 0),
        ]
    if kind == "ip":
        g = [str(rng.randint(1, 255)) for _ in range(4)]
        bad = [*g[:3], str(rng.randint(256, 999))]
        sep = rng.choice([" . ", ". ", "[.]", "(.)", "[dot]"])
        return [
            (cue(), sep.join(g), 1), (cue(), ".".join(g), 1), ("", rng.choice([".", ". "]).join(bad), 0), ("", " ".join(g), 0), ("", "-".join(g), 0),
            (no(), ".".join(str(rng.randint(0, 20)) for _ in range(4)) + "." + n(1), 0), ("", "/".join(g), 0),
        ]
    if kind == "card":
        d = next(x for x in iter(lambda: rng.choice("3456") + n(rng.choice([14, 15, 15, 15])), "") if _luhn(x))
        sep = rng.choice(["", " ", "-", ".", " - ", "/"])
        even = next(x for x in iter(lambda: n(rng.choice([13, 14, 16, 18])), "") if _luhn(x))
        split = lambda x, k: [x[i : i + k] for i in range(0, len(x), k)]
        return [
            (cue(), sep.join(split(d, 4)), 1), (f"{cue()}{n(rng.randint(1, 6))} ", sep.join(split(d, 4)), 1), (cue(), d, 1),
            (no(), even, 0), ("", " ".join(split(even, 3)), 0), (rng.choice(["0.", "$", "#", "-"]), even, 0), ("", rng.choice([" ", "-"]).join(split(even, rng.choice([5, 6]))), 0),
        ]
    if kind == "phone":
        area, a, b = n(3), n(3), n(4)
        good = rng.choice([f"({area}) {a}-{b}", f"({area}) {a} {b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"+{n(2)} {n(2)} {n(4)} {n(4)}", f"00{n(2)} {area} {a}{b}", f"+{n(1)}-{area}-{a}-{b}", f"{area} {a} {b}", f"{area}-{b}-{n(4)}", f"00{n(2)} {n(2)} {n(6)}", f"0{n(2)} {n(3)} {n(4)}"])
        return [
            (cue(), good, 1), (rng.choice(CUES[kind]) + rng.choice([": ", " "]), f"{area}{a}{b}", 1), (no(), f"{area}{a}{b}", 0), ("", n(rng.randint(7, 15)), 0),
            ("", f"20{n(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", 0), ("", f"{n(2)}.{n(2)}.20{n(2)} {n(2)}", 0), ("", f"{n(4)} {n(4)} {n(4)}", 0), ("", f"{n(3)}.{n(4)}", 0), ("$", f"{n(2)} {n(3)} {n(3)}", 0),
            (no(), f"{n(3)}-{n(1)}-{n(4)}-{n(4)}-{n(1)}", 0),
        ]
    chars = rng.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"])
    key = lambda a=20, b=48: "a1" + "".join(rng.choices(chars, k=rng.randint(a, b)))
    quote = rng.choice(['"', "'", ""])
    capital = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    known = rng.choice(["AKIA" + "".join(rng.choices(capital, k=16)), rng.choice(HEADS[3:]) + "".join(rng.choices(capital + capital.lower() + "0189", k=rng.randint(20, 40)))])
    plain = "".join(word() for _ in range(rng.randint(2, 4)))
    return [
        (rng.choice(["", "", f"{rng.choice(CUES[kind])}: "]), known, 1), (f"{rng.choice(['pwd', 'password', 'passwd', 'secret', 'passphrase', 'db_password'])}{rng.choice(['=', ': ', ' = ', ' is '])}{quote}", plain, 1),
        (f"{rng.choice(['the key ', 'a secret ', 'key: ', 'token ', 'auth '])}", word(rng.randint(8, 14)), 0), (f"{rng.choice(['name', 'id', 'title', 'user', 'path'])}{rng.choice(['=', ': '])}{quote}", plain, 0),
        (f"{rng.choice(CUES[kind])}{rng.choice([' = ', '=', ': ', ' '])}{quote}", key(), 1), (f"{rng.choice(['api_', 'my', 'X-'])}{rng.choice(CUES[kind])}{rng.choice([' = ', '=', ': '])}{quote}", key(8, 24), 1),
        (no(), key(30, 42), 0), (f"/{word()}/", key(8, 40), 0), ("", f"{word()}{n(2)}_{word()}", 0), ("", f"{word()}-{n(4)}-{word()}", 0), ("", f"{word()}{n(3)}.{word(3)}", 0), ("", word(12) + n(1), 0),
    ]


@dataclass
class Detector:
    trees: Trees
    thresholds: dict[str, float]

    def spans(self, text: str | None) -> list[tuple[str, int, int, bool, float]]:
        """Base spans, and the candidates beyond them that score above their kind's threshold, best first,
        without overlap. Every span has the score of the trees. Linear in the text but for sorting."""
        if not text:
            return []
        base = base_spans(text)
        out = [(s, True, p) for s, p in zip(base, self._scores(text, base))]
        taken = bytearray(len(text))
        for _, a, b in base:
            taken[a:b] = b"\1" * (b - a)
        new = [c for c in candidates(text) if c[0] in self.thresholds and 1 not in taken[c[1] : c[2]]]
        good = [(p, c) for p, c in zip(self._scores(text, new), new) if p >= self.thresholds[c[0]]]
        for p, c in sorted(good, key=lambda x: (-x[0], x[1][1], -x[1][2], KINDS.index(x[1][0]))):
            if 1 not in taken[c[1] : c[2]]:
                taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
                out.append((c, False, p))
        return sorted(((*c, b, p) for c, b, p in out), key=lambda s: (KINDS.index(s[0]), s[1]))

    def _scores(self, text: str, spans: list[Span]) -> list[float]:
        out: list[float] = []
        for i in range(0, len(spans), 4096):
            out += self.trees.chances(np.array([features(text, c) for c in spans[i : i + 4096]], np.float64)).tolist()
        return out


def _snippets(text: str, most: int = 6) -> list[tuple[str, int, int, str]]:
    """Parts of a text to learn from: base spans (kind), and what fails a hard rule and so is none of its kind ("").

    At most ``most`` of either, taken by hash, with what stands around them; and one place without either.
    """
    rng, base = random.Random(zlib.crc32(text.encode("utf-8", "replace"))), base_spans(text)
    cut = lambda a, b: (text[max(0, a - _NEAR) : b + _NEAR], min(a, _NEAR), min(a, _NEAR) + b - a)
    out = [(*cut(a, b), k) for k, a, b in rng.sample(base, min(most, len(base))) if b - a <= 256]
    at = rng.randrange(len(text) + 1)
    return [*out, (*cut(at, at), "")]


def _examples(snippets: list[tuple[str, int, int, str]], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, kinds and folds (0 to 2) of the base spans in snippets and of ``rounds`` made values of each kind in them."""
    rng, rows, y, kinds, folds = random.Random(5), [], [], [], []

    def add(text: str, span: Span, label: int, fold: int) -> None:
        rows.append(features(text, span)), y.append(label), kinds.append(span[0]), folds.append(fold)

    plain = [(s, a) for s, a, _, k in snippets if not k] or [("", 0)]
    for s, a, b, k in snippets:
        if k:
            fold = zlib.crc32(s.encode("utf-8", "replace")) % 3
            add(s, (k, a, b), 1, fold)
            for c in candidates(s):  # the same characters are no other kind of data
                if c[0] != k and c[1] < b and a < c[2]:
                    add(s, c, 0, fold)
    for r in range(rounds):
        s, at = plain[r % len(plain)]
        for kind in KINDS:
            for before, value, label in _value(kind, rng):
                head = s[:at] + rng.choice([" ", " ", "(", "\n", ", "]) + before
                text = head + value + rng.choice([" ", " ", ".", ")", ", ", '"']) + s[at:]
                a, b = len(head), len(head) + len(value)
                add(text, (kind, a, b), label, r % 3)
                # Parts of it, more than it, and other kinds of it.
                other = [c for c in candidates(text) if c[1] < b and a < c[2] and c != (kind, a, b)]
                for c in rng.sample(other, min(2, len(other))):
                    add(text, c, 0, r % 3)
    return np.array(rows, np.float64), np.array(y, np.float64), np.array(kinds, object), np.array(folds)


def learned(snippets: list[tuple[str, int, int, str]], rounds: int = 90, precision: float = 0.99) -> Detector:
    """Trees and thresholds from parts of texts; see ``fit``."""
    x, y, kind, fold = _examples(snippets, rounds)
    out = np.zeros(len(y))
    for f in range(3):
        out[fold == f] = boost(x[fold != f], y[fold != f]).chances(x[fold == f])
    thresholds = {}
    for k in KINDS:
        p, right = out[kind == k], y[kind == k]
        order = np.argsort(-p)
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.nonzero((share >= precision) & (p[order] > 0.5))[0]
        ranked = np.append(p[order], 0.0)  # halfway to the next lower score: nothing was seen in between
        thresholds[k] = max(0.5, float(ranked[good[-1]] + ranked[good[-1] + 1]) / 2) if len(good) else float(p.max(initial=0.5))
    return Detector(boost(x, y), thresholds)


def fit(docs: DataFrame, text_col: str = "text", sample: int = 2_000, rounds: int = 90, precision: float = 0.99) -> Detector:
    """Learn from what the strict patterns find in about ``sample`` texts, and from made values put into them.

    Texts are chosen by a hash; of each at most 7 parts of a few hundred characters come to the driver,
    at most ``4 * sample`` in all. Every kind has ``rounds`` times its made values at any size of the
    table, also of an empty one, so no kind depends on how often it stands in the sample. Each fold of
    three is scored by trees fitted to the two others, and each kind gets the least threshold from
    one half up at which ``precision`` holds over all these scores.
    """
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    text = in_batches(docs).select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & (draw < sample / max(1, docs.count())))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for t in pdf["text"] for x in _snippets(t)], columns=["part", "a", "b", "kind"])

    made = text.mapInPandas(make, "part string, a int, b int, kind string").distinct()
    got = made.orderBy(F.xxhash64("part", "a", "kind"), "part", "a", "kind").limit(4 * sample).collect()
    return learned([tuple(r) for r in got], rounds, precision)


def find(detector: Detector, text: Column | str) -> Column:
    """An array of (kind, start, end, base, score) for each whole text, in code points, end exclusive."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([detector.spans(t) for t in texts], dtype=object)

    return run(text)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` for every row of ``docs``: personal data by kind, then start.

    Null and empty texts have none. Repeated rows keep one row each, other columns are ignored, an
    empty table gives an empty one. See ``fit`` for what the trees learn from and ``Detector.spans``
    for what is added to the strict patterns.
    """
    detector = fit(docs, text_col)
    return docs.select(F.col(id_col), find(detector, F.col(text_col)).alias("spans"))


def redact(text: Column | str, spans: Column | str) -> Column:
    """Texts with every span replaced by its kind in angle brackets; overlapping spans become one."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            out = []
            for t, spans in zip(texts, lists):
                parts, at = [], 0
                for s in sorted(spans if spans is not None else (), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"<{s['kind']}>"]
                    at = max(at, s["end"])
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield pd.Series(out, dtype=object)

    return run(text, spans)
