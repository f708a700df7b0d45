"""Patterns: how a request writes them, and what the engine matches.

A pattern is a bare expression, or ``/expression/flags`` with ``i`` for either case. Attribute patterns run in Spark's
own engine after translation, and so do those on price descriptions; where these use negative lookaround, they follow an
emulation with rules of its own, compiled to conditions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 200
#: Escapes of the store's dialect that Java writes otherwise: beginning and end of a word, either, neither, the very end.
_ESCAPES = {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B", "Z": r"\z"}
_WORDS = {"[[:<:]]": _ESCAPES["m"], "[[:>:]]": _ESCAPES["M"]}
#: Named classes inside brackets: in attribute patterns, which know all alphabets, and in description patterns, which
#: know ASCII.
_WIDE = {
    "alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}", "space": r"\s\x85\p{Z}",
    "blank": r" \t", "punct": r"\p{Punct}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}\p{IsAlphabetic}", "print": r"\p{Print}\p{IsAlphabetic}", "xdigit": "0-9A-Fa-f", "word": r"\p{IsAlphabetic}\p{IsDigit}_",
}
_ASCII = {
    "alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\x09-\x0D\x20", "blank": r"\x20\x09", "punct": r"!-/:-@\[-`{-~", "cntrl": r"\x00-\x1F\x7F",
    "graph": "!-~", "print": r"\x20-~", "xdigit": "0-9A-Fa-f", "word": "0-9A-Za-z_", "ascii": r"\x00-\x7F",
}


def parse(pattern: str) -> tuple[str, bool] | None:
    """The expression and whether case is ignored; None if a slash opens the pattern and none closes it."""
    if not pattern.startswith("/"):
        return pattern, False
    body, slash, flags = pattern[1:].rpartition("/")
    return (body, "i" in flags) if slash else None


def optional_prefix(body: str) -> str:
    """A leading escaped hyphen also stands for the start: the first region's values have no prefix."""
    return "(^|-)" + body[2:] if body.startswith("\\-") else body


def check_length(pattern: str) -> None:
    if len(pattern.encode()) > MAX_BYTES:
        raise ValueError(f"regular expression of more than {MAX_BYTES} bytes")


def _bracket(body: str, at: int, classes: dict[str, str]) -> tuple[str, int]:
    """The bracket expression that begins at ``at`` for Java and Python, and where it ends. Within it, signs that are
    operators there are escaped, and named classes are written out."""
    i, out = at + 1, "["
    if body[i : i + 1] == "^":
        i, out = i + 1, "[^"
    first = i
    while i < len(body):
        c = body[i]
        if c == "]" and i > first:
            return out + "]", i + 1
        if body.startswith("[:", i):
            end = body.find(":]", i + 2)
            name = body[i + 2 : end] if end > 0 else ""
            negated = name.startswith("^")
            if name.lstrip("^") not in classes or negated:
                raise ValueError(f"no class of characters: {name}")
            out, i = out + classes[name], end + 2
        elif c == "\\":
            out, i = out + body[i : i + 2], i + 2
        else:
            out, i = out + ("\\" + c if c in "[]&^" else c), i + 1
    return body[at:], len(body)  # not closed: malformed for whoever compiles it


def translated(body: str, classes: dict[str, str], end: str = r"\z", escapes: dict[str, str] | None = None) -> str:
    """The expression with $ as the very end wherever it stands, and with the dialect's classes and escapes."""
    out, i = "", 0
    while i < len(body):
        if escapes is not None and (word := body[i : i + 7]) in _WORDS:
            out, i = out + _WORDS[word], i + 7
        elif body[i] == "\\":
            pair = body[i : i + 2]
            out, i = out + (escapes or {}).get(pair[1:], pair), i + 2
        elif body[i] == "[":
            part, i = _bracket(body, i, classes)
            out += part
        else:
            out, i = out + (end if body[i] == "$" else body[i]), i + 1
    return out


def to_java(body: str, ignore_case: bool) -> str:
    """The expression of an attribute pattern for Java: a dot matches line ends, and $ only the very end."""
    return ("(?is)" if ignore_case else "(?s)") + translated(body, _WIDE, escapes=_ESCAPES)


def compiles(pattern: str) -> bool:
    """Whether Java takes the expression; asked of the session's JVM, or of Python's engine without one."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and getattr(spark, "_jvm", None) is not None:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern.replace("\\z", "\\Z"))
    except Exception:
        return False
    return True


def attribute_pattern(pattern: str) -> str | None:
    """What an attribute must match; None if the predicate is to be left out (empty, or malformed)."""
    check_length(pattern)
    found = parse(pattern)
    if found is None or not found[0]:
        return None
    try:
        return to_java(optional_prefix(found[0]), found[1])
    except ValueError:
        return None


def _groups(body: str, opening: str) -> list[tuple[int, int]]:
    """Start and end (after the parenthesis) of each group that ``opening`` begins; an unclosed one ends the list."""
    out, at = [], body.find(opening)
    while at >= 0:
        depth = 0
        for i in range(at, len(body)):
            depth += (body[i] == "(") - (body[i] == ")")
            if depth == 0 and body[i] == ")":
                break
        else:
            return out
        out.append((at, i + 1))
        at = body.find(opening, i + 1)
    return out


def _described(body: str, ignore_case: bool) -> str | None:
    """The expression of a description pattern for Java; None if it is malformed."""
    try:
        java = ("(?i)" if ignore_case else "") + translated(body, _ASCII)
    except ValueError:
        return None
    return java if compiles(java) else None


def _never(_: Column) -> Column:
    return F.lit(False)


def _ahead(body: str, ignore_case: bool) -> Callable[[Column], Column]:
    """Excluded words are plain substrings; what is left of the pattern must match, or not compile."""
    words = []
    for a, b in _groups(body, "(?!"):
        inner = body[a + 3 : b - 1].removeprefix(".*").removesuffix("$").removeprefix("(").removesuffix(")")
        words += [word for word in map(str.strip, inner.split("|")) if word]
    rest = re.sub(r"\(\?![^)]*\)", "", body).replace("(?i)", "")
    java = None if rest in ("", "^.*$", ".*") else _described(rest, ignore_case)

    def test(c: Column) -> Column:
        excluded = [F.contains(F.lower(c), F.lit(w.lower())) if ignore_case else F.contains(c, F.lit(w)) for w in words]
        return reduce(lambda x, e: x & ~e, excluded, F.lit(True) if java is None else c.rlike(java))

    return test


def _behind(body: str, ignore_case: bool) -> Callable[[Column], Column]:
    """The first match of what is left must not follow an excluded text. What comes before that match is the shortest
    prefix after which the pattern matches."""
    spans = _groups(body, "(?<!")
    excluded = [body[a + 4 : b - 1] for a, b in spans]
    for a, b in reversed(spans):
        body = body[:a] + body[b:]
    if body in ("", "$"):
        return lambda c: F.lit(True)
    java = _described(body, ignore_case)
    if java is None:
        return _never

    def test(c: Column) -> Column:
        value = F.lower(c) if ignore_case else c
        before = F.regexp_extract(value, f"^((?s:.*?))(?:{java})", 1)
        return reduce(lambda x, e: x & ~F.endswith(before, F.lit(e.lower() if ignore_case else e)), excluded, value.rlike(java))

    return test


def description_test(pattern: str) -> Callable[[Column], Column]:
    """A function from a description column to a condition; a pattern too long, malformed or invalid matches nothing."""
    found = parse(pattern)
    if found is None or len(pattern.encode()) > MAX_BYTES:
        return _never
    body, ignore_case = found
    if pattern.startswith("/"):
        body = optional_prefix(body)
        if "(?!" in body:
            return _ahead(body, ignore_case)
        if "(?<!" in body:
            return _behind(body, ignore_case)
    java = None if "(?!" in body or "(?<!" in body else _described(body, ignore_case)
    return _never if java is None else lambda c: c.rlike(java)


def rlike(column: Column, pattern: str) -> Column:
    return F.rlike(column, F.lit(pattern))
