"""Secrets, by patterns and by assignment-aware lexing.

Texts are lexed as source or configuration: every ``name = value`` becomes a pair of
the name and its literals or the names it is made of. A name is as sensitive as its
words say, and a name whose value flows into a sensitive one inherits from it, through
any number of assignments. A literal is reported when the sensitivity of its name,
times the strength of the literal itself, is high enough.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict
from itertools import pairwise

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "named")
MIN_SCORE = 0.4
#: What a name keeps of the sensitivity of the name it flows into.
INHERITED = 0.9

#: Words of names, and how much they tell.
SENSITIVE = {
    ("password",): 1.0, ("passwd",): 1.0, ("pwd",): 0.9, ("passphrase",): 1.0, ("pass",): 0.7,
    ("secret",): 1.0, ("token",): 0.9, ("credential",): 0.8, ("credentials",): 0.8, ("auth",): 0.6,
    ("api", "key"): 1.0, ("apikey",): 1.0, ("private", "key"): 1.0, ("access", "key"): 0.9,
    ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("bearer",): 0.8,
    ("mnemonic",): 0.9, ("seed", "phrase"): 0.9, ("pass", "phrase"): 1.0,
}
#: Names whose values are words with spaces between them.
PHRASES = {("passphrase",), ("mnemonic",), ("seed", "phrase"), ("pass", "phrase")}

_ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}+")
_MAY_ASSIGN = re.compile(r"[:=]|</")

_TARGET = re.compile(r"""(?<![\w$.-])([A-Za-z_$][\w$.-]*+)["']?\]?[ \t]*+(?::=|=>|=(?!=)|:(?![:/]))[ \t]*+""")
# Three quotes go before one, and may hold line feeds, as back-quotes may.
_QUOTED = re.compile(
    r'''"""((?:[^"\\]++|\\.|"(?!""))*+)"""|'{3}((?:[^'\\]++|\\.|'(?!''))*+)'{3}'''
    r'''|"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`((?:[^`\\]++|\\.)*+)`''', re.S)
#: An element that holds text alone.
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*+>")
_NAME = re.compile(r"[A-Za-z_$][\w$.]*+")
# An equals sign only ends a value (base64); inside, a=b=c would be read again and again.
_BARE = re.compile(r"""[^\s"'`,;&<>(){}\[\]=]++=*+""")
_JOIN = re.compile(r"[ \t]*+(?:\+[ \t]*+|\.[ \t]++)?")
#: Values that stand for a secret: a reference, a mask, or words that say so, and nothing else.
_PLACEHOLDER = re.compile(
    r"(?i)(?:\$\{[^{}]*\}|\$\([^()]*\)|\{\{.*\}\}|<[^<>]*>|%\(\w+\)s|%\w+%|\*{3,}|x{6,}|\.{3,}"
    r"|change[\W_]?me\W*|(?:my|your)[-_ ].*|(?:the|an?|some) .*|(?:.*[\W_])?(?:example|placeholder|dummy|redacted)(?:[\W_].*)?)", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The matches of the three fixed patterns, leftmost and without overlap per kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _name_words(name: str) -> list[tuple[str, ...]]:
    words = [w.lower() for w in _WORDS.findall(name)]
    return [*((w,) for w in words), *pairwise(words)]


def sensitivity(name: str) -> float:
    return max((SENSITIVE.get(p, 0.0) for p in _name_words(name)), default=0.0)


def strength(value: str, quoted: bool, phrase: bool = False) -> float:
    """From 0 to 1: information in bits against 40, a quarter less without a digit.

    Several words are no secret, unless the name asks for a phrase and four or more stand there.
    """
    if len(value) < 6 or _PLACEHOLDER.fullmatch(value):
        return 0.0
    words = value.split()
    if len(words) > 1 or value != "".join(words):
        if not (quoted and phrase and len(words) >= 4):
            return 0.0
    counts = Counter(value)
    bits = sum(n * math.log2(len(value) / n) for n in counts.values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    if not quoted and not mixed:
        return 0.0  # an ordinary word after a colon
    return min(1.0, bits / 40) * (1.0 if mixed else 0.75)


def lex(text: str) -> tuple[list[tuple[str, int, int, bool]], list[tuple[str, str]]]:
    """(name, start, end, quoted) of assigned literals; (name, name) of flows."""
    literals, flows = [], []
    for m in _TARGET.finditer(text):
        at, first = m.end(), True
        while at < len(text):
            if q := _QUOTED.match(text, at):
                literals.append((m[1], *q.span(q.lastindex), True))
                at = q.end()
            elif (bare := _BARE.match(text, at)) and (name := _NAME.match(text, at)) and name.end() == bare.end():
                if text[name.end() : name.end() + 1] in ("(", "["):
                    break  # a call or a lookup: its value is not written here
                flows.append((m[1], name[0]))
                if first:
                    literals.append((m[1], *bare.span(), False))
                at = name.end()
            elif bare and first:
                literals.append((m[1], *bare.span(), False))
                at = bare.end()
            else:
                break
            first = False
            joined = _JOIN.match(text, at)
            # What follows belongs to the value only after + or . or next to a quote.
            if joined.end() == at or (not joined[0].strip() and text[joined.end() : joined.end() + 1] not in ('"', "'")):
                break
            at = joined.end()
    for m in _ELEMENT.finditer(text):
        value = m[2].strip()
        if value:
            start = m.start(2) + m[2].index(value)
            literals.append((m[1], start, start + len(value), True))
    return literals, flows


def named_spans(text: str) -> list[tuple[int, int, float]]:
    """Literals whose names, directly or through other names, are sensitive."""
    if not _MAY_ASSIGN.search(text):
        return []
    literals, flows = lex(text)
    score = {name: sensitivity(name) for name in {x[0] for x in literals} | {x for f in flows for x in f}}
    into = defaultdict(list)
    for target, source in flows:
        into[target].append(source)
    open_ = sorted((n for n in score if score[n]), key=lambda n: -score[n])
    while open_:
        target = open_.pop()
        for source in into[target]:
            if score[target] * INHERITED > score[source] + 1e-9:
                score[source] = score[target] * INHERITED
                open_.append(source)
    out = {}
    for name, start, end, quoted in literals:
        phrase = bool(score[name]) and any(p in PHRASES for p in _name_words(name))
        s = score[name] * strength(text[start:end], quoted, phrase) if score[name] else 0.0
        if s >= MIN_SCORE:
            out[start, end] = max(s, out.get((start, end), 0.0))
    return [(a, b, s) for (a, b), s in sorted(out.items())]


def spans_of(text: str) -> list[tuple[int, int, int, str, float]]:
    """(start, rank of the kind, end, kind, score), sorted; a named literal inside the
    match of a fixed pattern is not listed again."""
    spans = [(a, KINDS.index(k), b, k, 1.0) for k, a, b in base_spans(text)]
    cover: list[list[int]] = []
    for a, b in sorted((x[0], x[2]) for x in spans):  # merged, so that one pass is enough
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(b, cover[-1][1])
        else:
            cover.append([a, b])
    k = 0
    for a, b, s in named_spans(text):
        while k < len(cover) and cover[k][1] < b:
            k += 1
        if not (k < len(cover) and cover[k][0] <= a):
            spans.append((a, KINDS.index("named"), b, "named", s))
    return sorted(spans)


def find(text: Column) -> Column:
    """All spans of whole texts, in code points, end exclusive; NULL counts as empty.

    An array of structs of kind, start, end and score, sorted by start, then kind in
    the order of ``KINDS``. Fixed patterns have score 1.
    """
    @F.arrow_udf("array<struct<kind: string, start: long, end: long, score: double>>")
    def scan(texts: pa.Array) -> pa.Array:
        out = [
            [{"kind": k, "start": a, "end": b, "score": s} for a, _, b, k, s in spans_of(x.as_py() or "")]
            for x in texts
        ]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        return pa.array(out, pa.list_(kind))

    return scan(text)
