"""Inline markup as runs, and the runs of right-to-left text."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import RIGHT_TO_LEFT, SCRIPTS

RUNS = "array<struct<text: string, b: boolean, i: boolean, code: boolean, url: string>>"
#: Tokens of inline markup, the first that fits; a mark that opens nothing is text, and what holds no mark is one token.
TOKEN = re.compile(r"\\(?P<escaped>[*`\[\]\\])|`(?P<code>[^`]*)`|(?P<bold>\*\*)|(?P<italic>\*)|\[(?P<label>(?:\\.|[^\]\\])*)\]\((?P<url>[^)\s]+)\)|(?P<other>[^\\`*\[]+|.)", re.S)
MARK = re.compile(r"[*`\[\]\\]")


@dataclass
class Run:
    text: str
    b: bool = False
    i: bool = False
    code: bool = False
    url: str | None = None


def _scan(text: str, literal: frozenset[str]) -> tuple[list[Run], set[str]]:
    """Runs, and the marks that are still open at the end."""
    out: list[Run] = []
    state = Run("")

    def put(piece: str) -> None:
        if out and not out[-1].code and out[-1].url is None and (out[-1].b, out[-1].i) == (state.b, state.i) and joined[0]:
            out[-1].text += piece
        else:
            out.append(replace(state, text=piece))
        joined[0] = True

    joined = [False]
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        at, kind = m.end(), m.lastgroup
        if kind == "url":  # the last group of a link
            for run in parse(m["label"]):
                out.append(replace(run, b=run.b or state.b, i=run.i or state.i, url=m["url"]))
            joined[0] = False
        elif kind == "code":
            out.append(replace(state, text=m["code"], code=True))
            joined[0] = False
        elif kind == "bold" and "b" not in literal:
            state, joined[0] = replace(state, b=not state.b), False
        elif kind in ("bold", "italic"):
            # One star at a time: two that are no bold mark are two single ones.
            at = m.start() + 1
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            if "i" not in literal and not (before if state.i else after).isspace():
                state, joined[0] = replace(state, i=not state.i), False
            else:
                put("*")
        else:
            put(m["escaped"] or m[0])
    return [r for r in out if r.text], {k for k in "bi" if getattr(state, k)}


def parse(text: str | None) -> list[Run]:
    """The runs of a marked-up text; marks that nothing closes are read as plain text."""
    if not text or not MARK.search(text):
        return [Run(text)] if text else []
    runs, open_ = _scan(text, frozenset())
    return _scan(text, frozenset(open_))[0] if open_ else runs


def plain(text: str | None) -> str:
    return "".join(r.text for r in parse(text))


def to_html(text: str | None) -> str:
    out = []
    for r in parse(text):
        x = html.escape(r.text, quote=False)
        for on, opening, closing in ((r.code, '<code dir="ltr">', "</code>"), (r.b, "<strong>", "</strong>"), (r.i, "<em>", "</em>"), (r.url, f'<a href="{html.escape(r.url or "")}">', "</a>")):
            x = f"{opening}{x}{closing}" if on else x
        out.append(x)
    return "".join(out)


# What joins a left-to-right token before or behind it, each run as a whole, and brackets.
BEFORE, AFTER = re.compile(r"(?<![+\-.#@$/~\\])[+\-.#@$/~\\]++(?=[^\W_])"), re.compile(r"(?<=[^\W_])[+#]++")
BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">", "«": "»", "‹": "›"}
BRACKET = re.compile("[" + re.escape("".join([*BRACKETS, *BRACKETS.values()])) + "]")
RTL_RANGES = [tuple(int(x, 16) for x in r.split("-")) for s in RIGHT_TO_LEFT for r in SCRIPTS[s].split()]
RTL_LETTER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in RTL_RANGES) + "]")
NEUTRAL, LEFT, RIGHT = 0, 1, 2


@cache
def kind_table() -> np.ndarray:
    """The kind of each code point, looked up for whole texts at once."""
    table = np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.uint8, 0x110000)
    for first, last in RTL_RANGES:
        table[first : last + 1] = RIGHT
    return table


def kinds_of(text: str) -> np.ndarray:
    return kind_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def bracket_pairs(text: str) -> list[tuple[int, int]]:
    """Places of brackets that belong together, by where they close. What still waits within a closed pair is dropped."""
    waiting: dict[str, list[int]] = {closing: [] for closing in BRACKETS.values()}
    pairs = []
    for m in BRACKET.finditer(text):
        i, c = m.start(), m[0]
        if c in BRACKETS:
            waiting[BRACKETS[c]].append(i)
        elif waiting.get(c):
            start = waiting[c].pop()
            pairs.append((start, i))
            for places in waiting.values():
                while places and places[-1] > start:
                    places.pop()
    return pairs


def affixes(text: str, kinds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of neutrals that are part of a left-to-right token, before or behind it."""
    for m in BEFORE.finditer(text):
        first, begin = m.span()
        edge = text[first - 1] if first else " "
        if kinds[begin] == LEFT and (edge.isspace() or edge in BRACKETS or first and kinds[first - 1] == LEFT):
            yield first, begin
    for m in AFTER.finditer(text):
        if kinds[m.start() - 1] == LEFT:
            yield m.span()


def directions(text: str) -> list[bool]:
    """For each character, whether it is laid out right to left.

    A neutral is left to right only between two left-to-right characters, as an affix of a token (C#, .NET, +963), or in a pair of
    brackets that holds no right-to-left letter and begins or ends left to right.
    """
    return _directions(text).tolist()


def _directions(text: str) -> np.ndarray:
    kinds = kinds_of(text)
    at = np.arange(len(kinds))
    last = np.maximum.accumulate(np.where(kinds > 0, at, -1))  # the nearest letter's place, from either side
    following = np.minimum.accumulate(np.where(kinds > 0, at, len(kinds))[::-1])[::-1]
    padded = np.append(kinds, np.uint8(NEUTRAL))  # no letter: places -1 and len
    out = np.where(kinds > 0, kinds == RIGHT, (padded[last] != LEFT) | (padded[following] != LEFT))
    for first, until in affixes(text, kinds):
        out[first:until] = False
    seen = np.append(0, np.cumsum(kinds == RIGHT))  # right-to-left letters before each place
    for start, end in bracket_pairs(text):
        if seen[start] == seen[end] and not (out[start] and out[end]):
            out[start : end + 1] = False
    return out


def split_rtl(text: str | None) -> list[tuple[str, bool]]:
    """Text in runs of one direction: (run, whether it is right to left)."""
    if not text:
        return []
    out = _directions(text)
    cuts = [0, *(np.flatnonzero(out[1:] != out[:-1]) + 1).tolist(), len(text)]
    return [(text[a:b], bool(out[a])) for a, b in zip(cuts, cuts[1:], strict=False)]


def _applied(function: Callable[[pd.Series], pd.Series], kind: str, c: Column | str) -> Column:
    return F.pandas_udf(function, kind)(F.col(c) if isinstance(c, str) else c)


def unmarked(c: Column) -> Column:
    """Whether a text has no inline markup at all: then it is one run, and needs no parser."""
    return ~c.rlike(r"[*`\[\]\\]")


def runs(c: Column | str) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [vars(r) for r in parse(t)])

    return _applied(each, RUNS, c)


def html_of(c: Column | str) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(to_html, na_action="ignore")

    return _applied(each, "string", c)


def plain_of(c: Column | str) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(plain, na_action="ignore")

    return _applied(each, "string", c)


def rtl_runs(c: Column | str) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": a, "rtl": r} for a, r in split_rtl(t)])

    return _applied(each, "array<struct<text: string, rtl: boolean>>", c)
