"""Regular expressions that mean the same in Spark (Java) and in RE2.

Patterns are written once: ``\\s`` stands for all Unicode white space, ``\\b``
for an ASCII word boundary, ``\\z`` for the end of the text.
"""

from __future__ import annotations

import re
from functools import cache

#: White space beyond the ASCII kind, as code points or ranges of them.
_WIDE = ["00A0", "1680", "2000-200A", "2028", "2029", "202F", "205F", "3000", "FEFF"]
_JAVA_SPACE = r"\t\n\x0B\f\r " + "".join("-".join(f"\\u{c}" for c in w.split("-")) for w in _WIDE)
_RE2_SPACE = r"\t\n\x0B\f\r " + "".join("-".join(f"\\x{{{c}}}" for c in w.split("-")) for w in _WIDE)
#: All white space as a string.
SPACE = "\t\n\x0b\f\r " + "".join(chr(c) for w in _WIDE for c in range(int(w.split("-")[0], 16), int(w.split("-")[-1], 16) + 1))
#: A boundary before a word's first character, and one after its last.
_JAVA_BEFORE, _JAVA_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _spelled(pattern: str, space: str, before: str, after: str) -> str:
    """``\\b`` is one before a word at the begin of a pattern, group or alternative, else one after a word."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(space if inside else f"[{space}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{space}]")
        elif two == r"\b":
            head = pattern[:i]
            out.append(before if not head or head.endswith("(?i)") or head[-1] in "(|" or re.search(r"\(\?=\[[^\]]*\]\)\Z", head) else after)
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def _closing(pattern: str, i: int) -> int:
    """Where the group that opens at ``i`` closes."""
    depth, inside = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i
        i += 1
    return len(pattern)


def _alternatives(pattern: str) -> list[str]:
    """The parts between bars that stand in no group."""
    parts, begin, i, inside = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            i = _closing(pattern, i)
        elif c == "|":
            parts.append(pattern[begin:i])
            begin = i + 1
        i += 1
    return [*parts, pattern[begin:]]


def _firsts(part: str) -> set[str] | None:
    """The letters that a match of ``part`` may begin with; None if that isn't told by letters alone."""
    part = part.removeprefix("(?i)").removeprefix(r"\b")
    if part.startswith("(?:"):
        end = _closing(part, 0)
        sets = [_firsts(x) for x in _alternatives(part[3:end])]
        rest = part[end + 1 :]
        found = None if None in sets else set().union(*sets)
    elif part[:1].isalpha() or part[:1] > "\x7f":
        found, rest = {part[0]}, part[1:]
    else:
        return None
    if found is None or rest[:1] in ("*", "{"):
        return None
    if rest[:1] == "?":
        after = _firsts(rest[1:])
        return None if after is None else found | after
    return found


def _hinted(pattern: str) -> str:
    """Each alternative behind a look at its first letter, so that nothing else is tried where no match can begin."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    parts = _alternatives(pattern.removeprefix(flag))
    heads = [_firsts(p) for p in parts]
    return flag + "|".join(p if h is None else f"(?=[{''.join(sorted(h))}]){p}" for p, h in zip(parts, heads))


def _element(pattern: str, i: int) -> tuple[set[str] | None, bool, int]:
    """The element at ``i``: what it stands for (strings one of which a match of it holds), whether it is one character, and where it ends."""
    c = pattern[i]
    if c == "(":
        end = _closing(pattern, i)
        head = re.match(r"\((?:\?(?:[a-z]*:|(<?[=!])))?", pattern[i:])
        return None if head[1] else _held(pattern[i + head.end() : end]), False, end + 1
    if c == "[":
        end = i + 1
        while pattern[end] != "]":
            end += 2 if pattern[end] == "\\" else 1
        inside = pattern[i + 1 : end].replace(r"\x22", '"')
        return set(inside.lower()) if len(inside) <= 3 and not set(inside) & set("^\\-") else None, False, end + 1
    if c == "\\":
        if pattern[i + 1] == "x":
            return {chr(int(pattern[i + 2 : i + 4], 16))}, True, i + 4
        if pattern[i + 1] in "pP":
            return None, False, pattern.index("}", i) + 1
        return (None, False, i + 2) if pattern[i + 1].isalnum() else ({pattern[i + 1]}, True, i + 2)
    return (None, False, i + 1) if c in ".^$" else ({c.lower()}, True, i + 1)


def _worth(strings: set[str]) -> tuple[int, int]:
    return min(len(x.encode()) for x in strings), -len(strings)


def _held(pattern: str) -> set[str] | None:
    """Lower-case strings one of which each match holds; None if there are none to tell."""
    found: set[str] = set()
    for part in _alternatives(pattern):
        sets, run, i = [], "", 0
        while i < len(part):
            strings, single, i = _element(part, i)
            many = re.match(r"(?:([?*])|\+|\{(\d+)(?:,\d*)?\})[?+]?", part[i:])
            i += many.end() if many else 0
            least = 1 if not many else 0 if many[1] else int(many[2] or 1)
            if single and least:
                run += min(strings) * least
            if not single or many:
                sets += [{run}] if run else []
                run = ""
            if strings and not single and least:
                sets.append(strings)
        sets += [{run}] if run else []
        if not sets:
            return None
        found |= max(sets, key=_worth)
    return found


@cache
def needles(pattern: str) -> tuple[str, ...]:
    """Strings one of which the lower-cased text holds wherever ``pattern`` matches; none if that isn't told by strings.

    Lower-casing leaves no letter of a match out: patterns mean ASCII letters in either case.  A pattern for the text's
    begin has none: it is tried at one place anyway.
    """
    body = pattern.removeprefix("(?i)")
    found = set() if body.startswith(r"\A") else _held(body) or set()
    return tuple(sorted(x for x in found if not any(y in x for y in found - {x})))


def java(pattern: str) -> str:
    for script in ("Greek", "Hebrew"):
        pattern = pattern.replace(rf"\p{{{script}}}", rf"\p{{Is{script}}}")
    return _spelled(_hinted(pattern), _JAVA_SPACE, _JAVA_BEFORE, _JAVA_AFTER)


def re2(pattern: str) -> str:
    """As the inside of an SQL string."""
    return _spelled(pattern, _RE2_SPACE, r"\b", r"\b").replace("'", "''")


def glance(pattern: str) -> str:
    """An RE2 expression, tried fast, that matches in any text that ``pattern`` matches, or matches once its white space is collapsed: without its ends and boundaries, counts open, letters in either case."""
    body = pattern.replace("(?i)", "").replace(r"\A", "").replace(r"\z", "").replace(r"\b", "")
    body = re.sub(r"\{(\d+)(?:,\d*)?\}\??", lambda m: "+" if int(m[1]) else "*", body).replace(" ", r"\s+")
    # such things at the begin or the end tell little
    empty = r"(?:\\s\*|\(\[\^\\n\]\+\)|\[\^\\n\]\+|\[[.!?]+\]\?|\\\.\?)+"
    body = re.sub(rf"\A{empty}|{empty}\Z", "", body)
    # a dot may have met a line's end that is a blank once collapsed
    return f"(?is:{_spelled(body, _RE2_SPACE, '', '')})"
