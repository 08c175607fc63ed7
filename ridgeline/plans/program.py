"""The line-program language: programs over texts, compiled to one map-side expression.

A program has an instruction on each line: SKIP_UNTIL, SKIP_LINES, SKIP_BLANK, STOP_AT, FILTER,
REJECT, SPLIT, REGEX, REPLACE, SET, EMIT, SECTION, REPEAT_FOR. Its rows are an array of structs
computed from the text column with array functions, whatever its mode; so a program needs neither
a shuffle nor a window, sections meet by index inside the row, and blocks nest as arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.regex import BLANK, PatternError, template, translate

TRIM = ("SKIP_UNTIL", "SKIP_LINES", "SKIP_BLANK", "STOP_AT", "FILTER", "REJECT")
TAKES_PATTERN = ("SKIP_UNTIL", "STOP_AT", "FILTER", "REJECT", "REGEX", "REPEAT_FOR")
VERBS = (*TRIM, "SPLIT", "REGEX", "REPLACE", "SET", "EMIT", "SECTION", "REPEAT_FOR")


class ProgramError(ValueError):
    """A program that cannot run, with the number of the line that is wrong."""


@dataclass(frozen=True)
class Instruction:
    verb: str
    args: tuple[str, ...]
    rest: str  # what follows the verb
    line: int


@dataclass(frozen=True)
class Rows:
    """An array of structs and the names in them. hidden: names in rows that are no columns."""

    array: Column
    names: list[str]
    mode: str
    hidden: list[str] = field(default_factory=list)


def tokens(text: str) -> list[str]:
    """Words, where quotes hold blanks together and go; an empty pair of quotes is an empty word."""
    out, word, quote, open_ = [], "", "", False
    for c in text:
        if quote:
            if c == quote:
                quote = ""
            else:
                word += c
        elif c in "\"'":
            quote, open_ = c, True
        elif c.isspace():
            if word or open_:
                out.append(word)
            word, open_ = "", False
        else:
            word += c
    if word or open_:
        out.append(word)
    return out


def parse(program: str) -> list[Instruction]:
    out = []
    for number, line in enumerate(program.split("\n"), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        verb, _, rest = line.partition(" ") if " " in line else line.partition("\t")
        verb, rest = verb.upper(), rest.strip()
        args = ((rest,) if rest else ()) if verb in TAKES_PATTERN else tuple(tokens(rest))
        out.append(Instruction(verb, args, rest, number))
    return out


def validate(program: str) -> list[Instruction]:
    """The program's instructions; raises ProgramError for what could not run."""
    found = parse(program)
    if not found:
        raise ProgramError("empty program")
    least = {"SPLIT": 1, "REPLACE": 2, "SET": 2, "SKIP_LINES": 1} | dict.fromkeys(TAKES_PATTERN, 1)
    for x in found:
        if x.verb not in VERBS:
            raise ProgramError(f"line {x.line}: unknown verb {x.verb}")
        if len(x.args) < least.get(x.verb, 0):
            raise ProgramError(f"line {x.line}: {x.verb} needs {least[x.verb]} or more arguments")
        if x.verb in TAKES_PATTERN or x.verb == "REPLACE":
            try:
                translate(x.args[0])
            except PatternError as e:
                raise ProgramError(f"line {x.line}: {e}") from e
        if x.verb == "SKIP_LINES" and not x.args[0].isdigit():
            raise ProgramError(f"line {x.line}: SKIP_LINES needs a number")
        if x.verb == "SPLIT" and not all(a.startswith("$") and len(a) > 1 for a in x.args):
            raise ProgramError(f"line {x.line}: SPLIT needs $names")
        if x.verb == "SET" and not x.args[0].startswith("$"):
            raise ProgramError(f"line {x.line}: SET needs a $name")
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^\s\x{{85}}\p{{Z}}]")


def fields(line: Column) -> Column:
    """Words of a line, parted by Unicode white space; none for a blank line."""
    return F.filter(F.split(line, BLANK + "+", -1), lambda w: w != "")


def _last(found: list[Instruction], verb: str) -> Instruction | None:
    return next((x for x in reversed(found) if x.verb == verb), None)


def _matches(x: Instruction) -> Callable[[Column], Column]:
    pattern = translate(x.args[0]).java
    return lambda line: line.rlike(pattern)


def _first(lines: Column, test: Callable[[Column], Column]) -> Column:
    """Place (from 1) of the first line that passes; 0 if none does."""
    return F.array_position(F.transform(lines, test), F.lit(True)).cast("int")


def _from(lines: Column, start: Column | int) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.slice(lines, start, F.greatest(F.size(lines) - start + 1, F.lit(0)))


def trimmed(found: list[Instruction], lines: Column) -> Column:
    """The lines that the trimming instructions keep. Of repeated ones the last counts."""
    until, stop, skip = _last(found, "SKIP_UNTIL"), _last(found, "STOP_AT"), _last(found, "SKIP_LINES")
    if until:
        lines = let(lines, lambda ls: let(_first(ls, _matches(until)), lambda p: F.when(p > 0, _from(ls, p + 1)).otherwise(F.slice(ls, 1, 0))))
    if stop:
        lines = let(lines, lambda ls: let(_first(ls, _matches(stop)), lambda p: F.when(p > 0, F.slice(ls, F.lit(1), p - 1)).otherwise(ls)))
    if until and skip:
        n = int(skip.args[0])
        lines = let(lines, lambda ls: _from(ls, n + 1))
    tests = []
    if _last(found, "SKIP_BLANK"):
        tests.append(lambda line: ~is_blank(line))
    if x := _last(found, "FILTER"):
        tests.append(_matches(x))
    if x := _last(found, "REJECT"):
        reject = _matches(x)
        tests.append(lambda line: ~reject(line))
    for test in tests:
        lines = F.filter(lines, test)
    return lines


def replaced(found: list[Instruction], text: Column) -> Column:
    for x in found:
        if x.verb == "REPLACE":
            p = translate(x.args[0])
            text = F.regexp_replace(text, F.lit(p.java), F.lit(template(x.args[1], p.groups)))
    return text


def _unquote(s: str) -> str:
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'":
        out, i, body = "", 0, s[1:-1]
        known = {"\\": "\\", "n": "\n", "t": "\t", '"': '"', "'": "'"}
        while i < len(body):
            if body[i] == "\\" and body[i + 1 : i + 2] in known and i + 1 < len(body):
                out, i = out + known[body[i + 1]], i + 2
            else:
                out, i = out + body[i], i + 1
        return out
    return s


def _value(s: str, row: dict[str, Column]) -> Column:
    """A $name's column, or a literal; what a row does not have is empty."""
    s = _unquote(s)
    if s.startswith("$"):
        return F.coalesce(row[s[1:]], F.lit("")) if s[1:] in row else F.lit("")
    return F.lit(s)


def _top_level(s: str, c: str) -> int:
    """Place of a character outside of quotes and parentheses; -1 if there is none."""
    depth, quote, i = 0, "", 0
    while i < len(s):
        if quote:
            if s[i] == "\\":
                i += 1
            elif s[i] == quote:
                quote = ""
        elif s[i] in "\"'":
            quote = s[i]
        elif s[i] in "()":
            depth += 1 if s[i] == "(" else -1
        elif s[i] == c and not depth:
            return i
        i += 1
    return -1


def _condition(s: str, row: dict[str, Column], line: int) -> Column:
    s = s.strip()
    if s.startswith("REGEX_MATCH(") and s.endswith(")"):
        name, comma, pattern = s[12:-1].partition(",")
        if not comma:
            raise ProgramError(f"line {line}: REGEX_MATCH needs a value and a pattern")
        return _value(name.strip(), row).rlike(translate(_unquote(pattern.strip())).java)
    for op in ("==", "!="):
        left, found, right = s.partition(f" {op} ")
        if found:
            same = _value(left.strip(), row) == _value(right.strip(), row)
            return same if op == "==" else ~same
    raise ProgramError(f"line {line}: condition {s!r}")


def assigned(found: list[Instruction], row: dict[str, Column]) -> dict[str, Column]:
    """The row after its SET instructions, in order."""
    row = dict(row)
    for x in found:
        if x.verb != "SET":
            continue
        name = x.args[0].removeprefix("$")
        expr = x.rest.split(None, 1)[1].strip()
        if expr.startswith("(") and expr.endswith(")"):
            expr = expr[1:-1].strip()
        q = _top_level(expr, "?")
        if q > 0:
            c = _top_level(expr[q + 1 :], ":")
            if c < 0:
                raise ProgramError(f"line {x.line}: no ':' after '?'")
            yes, no = expr[q + 1 : q + 1 + c], expr[q + 2 + c :]
            row[name] = F.when(_condition(expr[:q], row, x.line), _value(yes.strip(), row)).otherwise(_value(no.strip(), row))
        else:
            row[name] = F.concat(*(_value(a, row) for a in x.args[1:]))
    return row


def _sets(found: list[Instruction]) -> list[str]:
    return list(dict.fromkeys(x.args[0].removeprefix("$") for x in found if x.verb == "SET"))


def _struct(row: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(n) for n, c in row.items()))


def _only(found: list[Instruction], verbs: tuple[str, ...]) -> None:
    for x in found:
        if x.verb not in verbs:
            raise ProgramError(f"line {x.line}: unknown verb {x.verb}")


def _table(found: list[Instruction], lines: Column, compat: bool) -> Rows:
    _only(found, (*TRIM, "REPLACE", "SPLIT", "SET", "EMIT", "REGEX"))
    split = list(dict.fromkeys(a.removeprefix("$") for a in _last(found, "SPLIT").args))
    names = split + [n for n in _sets(found) if n not in split]
    taken = names if compat else split

    def row(words: Column) -> Column:
        own = {n: F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i, n in enumerate(taken[:-1])}
        own[taken[-1]] = F.array_join(_from(words, len(taken)), " ")
        return _struct({n: assigned(found, own)[n] for n in names})

    kept = F.filter(F.transform(trimmed(found, lines), lambda x: replaced(found, x)), lambda x: ~is_blank(x))
    return Rows(F.transform(F.transform(kept, fields), row), names, "table")


def _extracted(found: list[Instruction], value: Callable[[Instruction, str, int], Column]) -> dict[str, Column]:
    """Named groups of every REGEX; of equal names the later one that matched counts."""
    row: dict[str, Column] = {}
    for x in found:
        if x.verb == "REGEX":
            p = translate(x.args[0])
            for name, number in p.groups.items():
                c = value(x, p.java, number)
                row[name] = F.coalesce(c, row[name]) if name in row else c
    return row


def _record(found: list[Instruction], lines: Column, compat: bool) -> Rows:
    _only(found, (*TRIM, "REPLACE", "REGEX", "SET", "EMIT"))
    kept = trimmed(found, lines)
    if _last(found, "REPLACE"):
        kept = F.split(replaced(found, F.array_join(kept, "\n")), "\n", -1)
    sets = _sets(found)

    def rows(ls: Column) -> Column:
        own = _extracted(found, lambda x, java, n: F.regexp_extract(F.get(F.filter(ls, lambda line: line.rlike(java)), F.lit(0)), java, n))
        one = F.array(_struct(assigned(found, own)))
        some = [c.isNotNull() for c in own.values()]
        if sets or not some:
            return one
        any_ = some[0]
        for c in some[1:]:
            any_ = any_ | c
        return F.when(any_, one).otherwise(F.slice(one, 1, 0))

    groups = list(dict.fromkeys(n for x in found if x.verb == "REGEX" for n in translate(x.args[0]).groups))
    names = groups + [n for n in sets if n not in groups]
    if not names:
        return Rows(F.array().cast("array<struct<_none:string>>"), [], "record")
    return Rows(let(kept, rows), groups if compat else names, "record", [n for n in names if n not in groups] if compat else [])


def _regex_table(found: list[Instruction], lines: Column, compat: bool) -> Rows:
    _only(found, (*TRIM, "REPLACE", "REGEX", "SET", "EMIT"))
    tests = [translate(x.args[0]).java for x in found if x.verb == "REGEX"]

    def row(line: Column) -> Column:
        own = _extracted(found, lambda x, java, n: F.when(line.rlike(java), F.regexp_extract(line, java, n)))
        return _struct(assigned(found, own))

    def hit(line: Column) -> Column:
        out = line.rlike(tests[0])
        for t in tests[1:]:
            out = out | line.rlike(t)
        return out & ~is_blank(line)

    groups = list(dict.fromkeys(n for x in found if x.verb == "REGEX" for n in translate(x.args[0]).groups))
    names = groups + [n for n in _sets(found) if n not in groups]
    kept = F.filter(F.transform(trimmed(found, lines), lambda x: replaced(found, x)), hit)
    return Rows(F.transform(kept, row), names, "table")


def _repeat(found: list[Instruction], lines: Column, compat: bool) -> Rows:
    at = next(i for i, x in enumerate(found) if x.verb == "REPEAT_FOR")
    before, head, after = found[:at], found[at], found[at + 1 :]
    own = [x for x in before if x.verb in ("STOP_AT", "REJECT")]
    p = translate(head.args[0])
    inner: list[Rows] = []

    def block(b: Column) -> Column:
        child = _rows(after, b["body"], compat, nested=True)
        inner.append(child)
        parent = {n: F.regexp_extract(b["line"], p.java, i) for n, i in p.groups.items()}
        if not child.names and not child.hidden:
            return F.array().cast("array<struct<_none:string>>")

        def merge(r: Column) -> Column:
            theirs = {n: r[n] for n in [*child.names, *child.hidden]}
            return _struct({n: F.coalesce(theirs[n], c) if n in theirs else c for n, c in parent.items()} | {n: c for n, c in theirs.items() if n not in parent})

        return F.transform(child.array, merge)

    def blocks(ls: Column) -> Column:
        def parts(heads: Column) -> Column:
            return F.transform(heads, lambda h, k: F.struct(F.get(ls, h).alias("line"), F.slice(ls, h + 2, F.coalesce(F.get(heads, k + 1), F.size(ls)) - h - 1).alias("body")))

        heads = F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(p.java), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(let(heads, parts), block))

    array = let(trimmed(own, lines), blocks)
    child = inner[0]
    return Rows(array, list(p.groups) + [n for n in child.names if n not in p.groups], "table", child.hidden)


def _rows(found: list[Instruction], lines: Column, compat: bool, nested: bool = False) -> Rows:
    verbs = {x.verb for x in found}
    if "REPEAT_FOR" in verbs:
        return _repeat(found, lines, compat)
    if "SPLIT" in verbs:
        return _table(found, lines, compat)
    if {"FILTER", "REGEX"} <= verbs:
        return _regex_table(found, lines, compat)
    return _record(found, lines, compat)


def _sections(parts: list[list[Instruction]], lines: Column, compat: bool) -> Rows:
    """Sections side by side by row number; a later section's value wins where both have one."""
    done = []
    for part in parts:
        _only(part, tuple(v for v in VERBS if v != "REPEAT_FOR"))
        done.append(_table(part, lines, compat) if any(x.verb == "SPLIT" for x in part) else _record(part, lines, compat))
    names = list(dict.fromkeys(n for d in done for n in [*d.names]))

    def rows(all_: Column) -> Column:
        arrays = [all_[f"s{i}"] for i in range(len(done))]
        n = F.greatest(*(F.size(a) for a in arrays)) if len(arrays) > 1 else F.size(arrays[0])

        def row(i: Column) -> Column:
            return _struct({name: F.coalesce(*(F.get(a, i)[name] for a, d in reversed(list(zip(arrays, done, strict=True))) if name in d.names)) for name in names})

        return F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), row)

    return Rows(let(F.struct(*(d.array.alias(f"s{i}") for i, d in enumerate(done))), rows), names, "table")


def compile_program(program: str, text: Column, compat: bool = False) -> Rows:
    """The rows of a program over a text column (null: empty).

    compat: in SPLIT programs the rest of a line goes to the last new SET name instead of the last
    SPLIT name, and SET names of records are no columns.
    """
    found = parse(program)
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    parts: list[list[Instruction]] = [[]]
    for x in found:
        if x.verb == "SECTION":
            parts.append([])
        else:
            parts[-1].append(x)
    parts = [p for p in parts if p]
    if not parts:
        raise ProgramError("empty program")
    if len(parts) > 1:
        return _sections(parts, lines, compat)
    return _rows(parts[0], lines, compat)


def run(df: DataFrame, program: str, text_col: str, keys: list[str], compat: bool = False) -> DataFrame:
    """keys, row_no (from 0) and the program's columns, a row for each that a text gives."""
    rows = compile_program(program, F.col(text_col), compat)
    out = df.select(*keys, F.posexplode(rows.array).alias("row_no", "_row"))
    return out.select(*keys, "row_no", *(F.col("_row")[n].alias(n) for n in rows.names))
