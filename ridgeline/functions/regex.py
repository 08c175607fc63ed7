"""Patterns in RE2 syntax, as java.util.regex understands them."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: What Unicode counts as white space, as a class of java.util.regex.
BLANK = r"[\s\x{85}\p{Z}]"


class PatternError(ValueError):
    """A pattern that cannot be translated."""


@dataclass(frozen=True)
class Pattern:
    """A translated pattern and the number of each named group; of equal names the last counts."""

    java: str
    groups: dict[str, int]


def translate(pattern: str) -> Pattern:
    r"""Named groups become numbered ones, \s leaves out \v, \z and \C are mapped, lines end at \n only."""
    out, groups, number, i, in_class = [], {}, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            if d == "s":
                out.append(r"\t\n\f\r " if in_class else r"[\t\n\f\r ]")
            elif d == "S" and not in_class:
                out.append(r"[^\t\n\f\r ]")
            elif d == "Q":
                end = pattern.find(r"\E", i)
                end = len(pattern) if end < 0 else end
                out.append(re.escape(pattern[i + 2 : end]))
                i = end
            elif d.isdigit() and d != "0":
                raise PatternError(f"backreference in {pattern!r}")
            else:
                out.append(c + d)
            i += 2
            continue
        if in_class:
            if c == "[" and not pattern.startswith("[:", i):
                out.append(r"\[")
            elif pattern.startswith("[:", i):
                end = pattern.index(":]", i)
                name = pattern[i + 2 : end]
                out.append(("\\P" if name[0] == "^" else "\\p") + "{" + {"word": "Alnum}_", "alnum": "Alnum}", "alpha": "Alpha}", "digit": "Digit}", "lower": "Lower}", "upper": "Upper}", "space": "Space}", "punct": "Punct}", "xdigit": "XDigit}", "blank": "Blank}", "cntrl": "Cntrl}", "graph": "Graph}", "print": "Print}", "ascii": "ASCII}"}[name.lstrip("^")])
                i = end + 2
                continue
            elif c == "&" and pattern.startswith("&&", i):
                out.append(r"\&")
            else:
                in_class = c != "]" or pattern[i - 1] == "[" or pattern[i - 2 : i] == "[^"
                out.append(c if in_class or c == "]" else c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
        elif c == "(":
            named = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if named:
                number += 1
                groups[named[1]] = number
                out.append("(")
                i += named.end()
                continue
            if pattern.startswith("(?", i):
                if re.match(r"\(\?(<?[=!]|>)", pattern[i:]):
                    raise PatternError(f"look-around in {pattern!r}")
                flags = re.match(r"\(\?([imsU]*)(-[imsU]+)?([:)])", pattern[i:])
                if not flags or "U" in flags[0]:
                    raise PatternError(f"flags in {pattern!r}")
            else:
                number += 1
            out.append(c)
        else:
            out.append(c)
        i += 1
    if in_class:
        raise PatternError(f"open class in {pattern!r}")
    java = "(?d)" + "".join(out)
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}", "x", re.sub(r"\(\?P?<\w+>", "(", pattern)).replace(r"\z", r"\Z").replace(r"\C", "."))
    except re.error as e:
        raise PatternError(f"{pattern!r}: {e}") from e
    return Pattern(java, groups)


def template(replacement: str, groups: dict[str, int]) -> str:
    """A replacement with $1, ${name} and $name, as Java reads it: the longest name counts, unknown ones are empty."""

    def put(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        if name is None:
            return r"\$"
        number = int(name) if name.isdigit() else groups.get(name)
        return "" if number is None else f"${number}"

    out = re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|\$", put, replacement.replace("\\", "\\\\"))
    return out
