"""User patterns are written in RE2 syntax; Spark runs Java regular expressions.

``java_pattern`` rewrites the few constructs that differ and rejects what RE2
would not compile, so that a bad pattern is found while the plan is built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# ASCII word boundary: Java's own \b also counts non-ASCII letters.
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# One RE2 token: escape, POSIX class, group opener, possessive-looking repeat, or any character.
_TOKEN = re.compile(
    r"(?P<posix>\[:\^?\w+:\])|(?P<prop>\\[pP]\{\^?\w+\})|(?P<esc>\\[\s\S])|(?P<name>\(\?P?<(?P<label>\w+)>)"
    r"|(?P<look>\(\?(?:<?[=!]|>))|(?P<flags>\(\?[imsU-]*[:)])|(?P<double>[*+?}][*+])|(?P<ch>[\s\S])"
)
_NOT_RE2 = set("123456789ZGkXRhHVNe")


class InvalidPattern(ValueError):
    """The pattern would not compile under RE2 syntax."""


def java_pattern(pattern: str) -> str:
    out, checked = ["(?d)"], []
    in_class = False
    for m in _TOKEN.finditer(pattern):
        kind, text = m.lastgroup if m.lastgroup != "label" else "name", m.group()
        plain = text
        if kind == "posix" and in_class:
            text, plain = r"\p{" + _posix(text) + "}", "a"
        elif kind == "prop":
            plain = "a"
        elif kind == "esc":
            if text[1] in _NOT_RE2:
                raise InvalidPattern(f"unsupported escape {text} in {pattern!r}")
            if text == r"\z":
                plain = r"\Z"
            elif text == r"\b" and not in_class:
                text = WORD_EDGE
        elif in_class:
            if text == "]":
                in_class = False
            elif text.startswith("["):
                text, plain = r"\[" + text[1:], r"\[" + text[1:]
            elif text == "&":
                text = r"\&"
        elif kind == "look":
            raise InvalidPattern(f"lookaround is not supported in {pattern!r}")
        elif kind == "double" and not (text[0] == "}" and text[1] == "?"):
            raise InvalidPattern(f"repeated quantifier {text} in {pattern!r}")
        elif kind == "name":
            # Java group names take no underscore; groups are read by position instead.
            text = plain = "("
        elif text == "[":
            in_class = True
        elif text == "$" and "(?m" not in pattern:
            text = r"\z"
        out.append(text)
        checked.append(plain)
    try:
        re.compile("".join(checked))
    except re.error as err:
        raise InvalidPattern(f"{pattern!r}: {err}") from None
    return "".join(out)


def _posix(text: str) -> str:
    name = text.strip("[:]")
    if name.startswith("^"):
        raise InvalidPattern(f"negated class {text} is not supported")
    return "IsWord" if name == "word" else name.capitalize() if name not in ("ascii", "xdigit") else {"ascii": "ASCII", "xdigit": "XDigit"}[name]


def group_labels(pattern: str) -> list[str]:
    """Label of each capturing group, "" where it has none."""
    labels, in_class = [], False
    for m in _TOKEN.finditer(pattern):
        text = m.group()
        if in_class:
            in_class = text != "]"
        elif text == "[":
            in_class = True
        elif m.group("name"):
            labels.append(m.group("label"))
        elif text == "(":
            labels.append("")
    return labels


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(java_pattern(pattern))


def glob_pattern(glob: str) -> str:
    """Path glob: ``*`` and ``?`` stop at a slash."""
    out = []
    for m in re.finditer(r"\\(.)|\[\^?[^\]]+\]|[\s\S]", glob):
        text = m.group()
        if text == "*":
            out.append("[^/]*")
        elif text == "?":
            out.append("[^/]")
        elif len(text) > 1 and text[0] == "[":
            out.append(text)
        else:
            out.append(re.escape(m.group(1) or text))
    return r"(?s)\A" + "".join(out) + r"\z"


def groups(col: Column, pattern: str, count: int) -> Column:
    """All capture groups of the first match as one array, from a single pass over the text.

    ``pattern`` is Java syntax and must be anchored at the start of the text. The groups are joined
    by U+0001; a text that holds that character takes the group-by-group way.
    """
    sep = "\x01"
    whole = pattern if pattern.endswith(r"\z") else f"(?:{pattern})(?s:.*)"
    joined = F.regexp_replace(col, whole, sep.join(f"${i}" for i in range(1, count + 1)))
    one_by_one = F.array(*[F.regexp_extract(col, pattern, i) for i in range(1, count + 1)])
    return F.when(col.contains(sep), one_by_one).otherwise(F.split(joined, sep, -1))


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))
