"""Pattern files hold Python regular expressions; Spark evaluates Java ones."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_NAMED_GROUP = re.compile(r"\(\?P<(\w+)>")
_NAMED_REFERENCE = re.compile(r"\(\?P=(\w+)\)")
_COMMENT = re.compile(r"\(\?#[^)]*\)")
_GLOBAL_FLAGS = re.compile(r"\(\?([a-zA-Z]+)[):]")


@dataclass(frozen=True)
class JavaPattern:
    """A translated body, the flags that give it Python's meaning, and its groups."""

    body: str
    flags: str
    groups: dict[str, int]
    group_count: int

    @property
    def search(self) -> str:
        return f"(?{self.flags}){self.body}"

    @property
    def match(self) -> str:
        """Anchored at the start. Atomic, so what follows cannot change the match."""
        return f"(?{self.flags})\\A(?>{self.body})"


def translate(pattern: str, ignore_case: bool = False) -> JavaPattern:
    """Rewrite a Python pattern for Java, or raise where no equal form exists.

    ``d`` makes only ``\\n`` a line end and ``U`` makes ``\\d \\w \\s \\b`` Unicode-aware,
    as in Python. Named groups become numbered ones, because Java group names cannot
    hold an underscore.
    """
    compiled = re.compile(pattern)
    out: list[str] = []
    i, in_class, class_start = 0, False, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            escape = pattern[i + 1]
            if escape == "Z":
                out.append("\\z")
            elif escape == "U":
                out.append("\\x{" + pattern[i + 2 : i + 10] + "}")
                i += 8
            elif escape in "N0":
                raise ValueError(f"escape \\{escape} has no Java form: {pattern!r}")
            else:
                out.append(ch + escape)
            i += 2
            class_start = False
            continue
        if in_class:
            if ch == "]" and not class_start:
                in_class = False
                out.append(ch)
            elif ch in "[]&" or (ch == "^" and not class_start):
                out.append("\\" + ch)
            else:
                out.append(ch)
            class_start = class_start and ch == "^" and pattern[i - 1] == "["
            i += 1
            continue
        if ch == "[":
            in_class = class_start = True
            out.append(ch)
        elif ch == "{":
            quantifier = _QUANTIFIER.match(pattern, i)
            if quantifier and (quantifier[1] or quantifier[3]):
                low, comma, high = quantifier.groups()
                out.append("{" + (low or "0") + comma + high + "}")
                i = quantifier.end()
                continue
            out.append("\\{")
        elif ch == "(" and pattern.startswith("(?", i):
            named = _NAMED_GROUP.match(pattern, i)
            reference = _NAMED_REFERENCE.match(pattern, i)
            comment = _COMMENT.match(pattern, i)
            flags = _GLOBAL_FLAGS.match(pattern, i)
            if named:
                out.append("(")
                i = named.end()
                continue
            if reference:
                out.append(f"(?:\\{compiled.groupindex[reference[1]]})")
                i = reference.end()
                continue
            if comment:
                i = comment.end()
                continue
            if pattern.startswith("(?(", i) or (flags and set(flags[1]) & set("aLux")):
                raise ValueError(f"construct has no Java form: {pattern!r}")
            out.append(ch)
        else:
            out.append(ch)
        i += 1
    return JavaPattern(
        "".join(out),
        "diU" if ignore_case else "dU",
        dict(compiled.groupindex),
        compiled.groups,
    )


def translate_replacement(replacement: str, pattern: str) -> str:
    """``\\1``, ``\\g<1>`` and ``\\g<name>`` to ``$n``; everything else stays literal."""
    names = re.compile(pattern).groupindex
    out, last = [], 0
    for token in re.finditer(r"\\(?:(\d{1,2})|g<(\w+)>|(.))", replacement, re.S):
        out.append(_literal(replacement[last : token.start()], out))
        number, name, other = token.groups()
        if name and not name.isdigit():
            number = str(names[name])
        if number or name:
            out.append(f"${number or name}")
        else:
            plain = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}.get(other, "\\" + other)
            out.append(_literal(plain, out))
        last = token.end()
    out.append(_literal(replacement[last:], out))
    return "".join(out)


def _literal(text: str, before: list[str]) -> str:
    escaped = text.replace("\\", "\\\\").replace("$", "\\$")
    after_group = bool(before) and re.fullmatch(r"\$\d+", before[-1])
    return "\\" + escaped if after_group and escaped[:1].isdigit() else escaped


def quoted_any(words: list[str]) -> str:
    """A pattern true for text that contains any of the words as they stand."""
    return "|".join("\\Q" + word + "\\E" for word in words)


def matches_any(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """True where any Python pattern is found; plain patterns share one scan."""
    shared, own = [], []
    for pattern in patterns:
        alone = "(?" in pattern or re.search(r"\\\d", pattern)
        (own if alone else shared).append(translate(pattern, ignore_case))
    checks = [text.rlike(p.search) for p in own]
    if shared:
        union = "|".join(f"(?:{p.body})" for p in shared)
        checks.append(text.rlike(f"(?{shared[0].flags}){union}"))
    found = F.lit(False)
    for check in checks:
        found = found | check
    return found


def group_value(text: Column, pattern: JavaPattern, index: int) -> Column:
    """A group of the anchored match: null when the group took no part in it.

    ``regexp_extract`` answers '' both for an empty group and for an absent one. A
    back-reference to an absent group fails in Java, which tells the two apart.
    """
    value = F.regexp_extract(text, pattern.match, index)
    took_part = text.rlike(f"{pattern.match}\\{index}")
    return F.when(value != "", value).when(took_part, F.lit(""))
