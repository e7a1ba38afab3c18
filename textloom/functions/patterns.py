"""Scope patterns: globs compiled on the driver to one anchored regular expression, or regular expressions after ``re:``.

Globs: ``*`` and ``?`` stay within a path segment and do not match a leading dot; ``**`` as a whole segment spans
segments; ``{a,b}`` and ``{1..3}`` expand; ``[...]`` classes; ``@() +() *() ?() !()``; a leading ``!`` negates; a leading ``#`` never
matches. Besides, ``X/**`` also matches ``X`` and ``X/``. An expression after ``re:`` is one of the JVM, where it runs; an invalid one matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SAFE = re.compile(r"[A-Za-z0-9_/ -]")


@dataclass(frozen=True)
class Pattern:
    """A compiled scope pattern: a regex searched in the path, inverted if negated; None matches nothing."""

    regex: str | None
    negated: bool = False
    java: bool = False

    def column(self, path: Column) -> Column:
        if self.regex is None:
            return F.lit(False)
        found = F.coalesce(path.rlike(self.regex), F.lit(False))
        return ~found if self.negated else found

    def test(self, path: str) -> bool:
        """The same on one Python string; an expression of the JVM is asked there."""
        if self.java and (jvm := _jvm()) is not None:
            return jvm.java.util.regex.Pattern.compile(self.regex).matcher(path).find()
        return self.regex is not None and (re.search(self.regex, path) is not None) != self.negated


def braces(glob: str) -> list[str]:
    """Alternatives of the first top-level braces, expanded recursively."""
    depth, start, commas = 0, -1, []
    k = 0
    while k < len(glob):
        c = glob[k]
        if c == "\\":
            k += 1
        elif c == "{":
            if depth == 0:
                start, commas = k, []
            depth += 1
        elif c == "," and depth == 1:
            commas.append(k)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                inner = glob[start + 1 : k]
                span = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", inner)
                if span:
                    a, b = int(span[1]), int(span[2])
                    options = [str(n) for n in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
                elif commas:
                    edges = [start, *commas, k]
                    options = [glob[a + 1 : b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                else:
                    return [glob[: k + 1] + rest for rest in braces(glob[k + 1 :])]
                return [x for o in options for x in braces(glob[:start] + o + glob[k + 1 :])]
        k += 1
    return [glob]


def _segment(text: str) -> str:
    """Regex of one path segment of a glob."""
    out, k = [], 0
    guard = "(?!\\.)" if text[:1] in "*?[" or re.match(r"[@+*?!]\(", text) else ""
    while k < len(text):
        c = text[k]
        if c in "@+*?!" and text[k + 1 : k + 2] == "(":
            depth, end = 1, k + 2
            while end < len(text) and depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            if depth == 0:
                inner = "|".join(_segment(x) for x in _bars(text[k + 2 : end - 1]))
                out.append({"@": f"(?:{inner})", "+": f"(?:{inner})+", "*": f"(?:{inner})*", "?": f"(?:{inner})?", "!": f"(?!(?:{inner})(?:{_segment(text[end:]) if text[end:] else ''})$)[^/]*"}[c])
                k = end
                continue
        if c == "*":
            while text[k + 1 : k + 2] == "*":
                k += 1
            out.append("[^/]*?" if text[k + 1 :] else "[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := text.find("]", k + 2)) > 0:
            inner = text[k + 1 : end]
            inner = ("^/" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{inner}]")
            k = end
        elif c == "\\" and k + 1 < len(text):
            k += 1
            out.append(_literal(text[k]))
        else:
            out.append(_literal(c))
        k += 1
    body = "".join(out)
    if text and not text.strip("*"):
        body = "[^/]+"  # a whole-segment star needs a character
    return guard + body


def _bars(text: str) -> list[str]:
    depth, parts = 0, [""]
    for c in text:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _literal(c: str) -> str:
    return c if _SAFE.fullmatch(c) else "\\" + c if ord(c) < 128 else c


def glob_regex(glob: str) -> str:
    """Anchored regex of a glob without its leading negation."""
    options = []
    for own in braces(glob):
        segments, out = own.split("/"), ""
        for k, s in enumerate(segments):
            last = k == len(segments) - 1
            if s == "**":
                if last:
                    out += "(?!\\.)[^/]*(?:/(?!\\.)[^/]*)*"
                else:
                    out += "(?:(?!\\.)[^/]*/)*"
            else:
                out += _segment(s) + ("" if last else "/")
        options.append(out)
    return "^(?:" + "|".join(options) + ")$"


def _jvm():
    from pyspark import SparkContext

    return SparkContext._active_spark_context._jvm if SparkContext._active_spark_context is not None else None


def _valid(regex: str) -> bool:
    """Whether the JVM takes the expression; without a session Python's own opinion."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    jvm = _jvm()
    try:
        re.compile(regex) if jvm is None else jvm.java.util.regex.Pattern.compile(regex)
    except (re.error, Py4JJavaError, PySparkException):
        return False
    return True


def compile_pattern(pattern: str) -> Pattern:
    if pattern.startswith("re:"):
        return Pattern(pattern[3:], java=True) if _valid(pattern[3:]) else Pattern(None)
    if pattern.startswith("#"):
        return Pattern(None)
    bare = pattern.lstrip("!")
    if not bare:
        return Pattern("^$", bool((len(pattern) - len(bare)) % 2))
    regex = glob_regex(bare)
    negated = bool((len(pattern) - len(bare)) % 2)
    if pattern.endswith("/**") and not negated:
        stem = "".join(map(_literal, pattern[:-3]))
        regex = f"{regex}|^{stem}/?$"
    return Pattern(regex, negated)


def any_match(path: Column, patterns: list[str]) -> Column:
    """Any pattern matches; no patterns match nothing."""
    out = F.lit(False)
    for p in patterns:
        out = out | compile_pattern(p).column(path)
    return out


def in_scope(path: Column, match: list[str] | None, exclude: list[str] | None = None) -> Column:
    """"queued", "unmatched" or "excluded". No include list passes all, an empty one nothing; excludes apply after."""
    fits = F.lit(True) if match is None else any_match(path, match)
    return F.when(~fits, "unmatched").when(any_match(path, exclude or []), "excluded").otherwise("queued")


def excluding(start_path: str, exclude: list[str] | None) -> str | None:
    """The first exclude pattern that would reject the start page itself."""
    return next((p for p in exclude or [] if compile_pattern(p).test(start_path)), None)
