"""Many names, or many rules, against many texts: one automaton finds what may be there, in one pass over a text (JOIN-04, JOIN-13, SPL-04, CLS-08)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from re import _constants as ops
from re import _parser

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of names in one automaton, about. More names make more parts, and as many passes.
PART = 1 << 22
_built: dict[str, object] = {}


def _once(name: str, build) -> object:
    """What build() gives, made once in each worker; only the latest is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = build()
    return _built[name]


def automaton(words: list[str], values: list | None = None) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w, v in zip(words, values or words, strict=True):
        found.add_word(w, v)
    found.make_automaton()
    return found


def _parts(names: DataFrame, name: str) -> Iterator[list[str]]:
    """The distinct names, lower-cased and not empty, in lists of bounded length."""
    own = names.select(F.lower(F.col(name)).alias("n")).where("n <> ''").distinct()
    total = own.agg(F.sum(F.length("n") + 16)).first()[0] or 0
    parts = -(-total // PART)
    for p in range(parts):
        yield [r.n for r in own.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == p).collect()]  # about PART characters


def mentions(texts: DataFrame, keys: list[str], text: Column, names: DataFrame, name: str) -> DataFrame:
    """keys, mention: each name, lower-cased, that a lower-cased text contains, once for a text.

    Names are parted by their length in all, each part becomes one automaton, and texts are read once for
    each part; no piece of a text is made. Null texts and names contain nothing; empty names are left out.
    """
    kinds = [texts.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("mention", T.StringType())])
    own = texts.select(*keys, F.lower(text).alias("_text"))
    out = texts.sparkSession.createDataFrame([], schema)
    for words in _parts(names, name):
        held, label = texts.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, label=label) -> Iterator[pa.RecordBatch]:
            found = _once(label, lambda: automaton(held.value))
            for batch in batches:
                at, said = [], []
                for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                    for w in sorted({w for _, w in found.iter(t)} if t else ()):
                        at.append(i)
                        said.append(w)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(keys))), pa.array(said, pa.string())], names=[*keys, "mention"])

        out = out.union(own.mapInArrow(run, schema))
    return out


def factor(pattern: str) -> str:
    """The longest text that whatever a pattern matches must contain, case folded; empty if none is known."""

    def runs(items) -> Iterator[str]:
        run = ""
        for op, value in items:
            if op is ops.LITERAL:
                run += chr(value)
                continue
            yield run
            run = ""
            if op is ops.SUBPATTERN:
                yield from runs(value[3])
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] > 0:
                yield from runs(value[2])
        yield run

    try:
        return max((r.casefold() for r in runs(_parser.parse(pattern))), key=len, default="")
    except Exception:  # a syntax that only the other engine knows: the pattern is tried on every text
        return ""


def _compiled(pattern: str | None):
    """A pattern whose $ and \\z are the end of the text; null and empty ones match all."""
    if not pattern:
        return None
    pattern = pattern.replace(r"\z", r"\Z")
    return regex.compile(pattern[:-1] + r"\Z" if pattern.endswith("$") and not pattern.endswith(r"\$") else pattern)


class Rules:
    """Rules (id, vendor, content, model, os) with an automaton of what their content patterns need."""

    def __init__(self, rows: list[tuple]):
        needs: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = []
        for i, (number, vendor, content, model, os) in enumerate(sorted(rows)):
            self.rules.append((number, vendor, *map(_compiled, (content, model, os)), 2 * bool(model) + bool(os)))
            need = factor(content or "")
            (needs.setdefault(need, []) if need else self.always).append(i)
        self.found = automaton(list(needs), list(needs.values())) if needs else None

    def best(self, vendor: str, content: str, model: str, os: str) -> tuple[int | None, int | None]:
        """The rule of the highest score, of equal ones of the least id, and its score."""
        some = set(self.always)
        if self.found is not None and content:
            for _, own in self.found.iter(content.casefold()):
                some.update(own)
        best = None
        for i in sorted(some):
            number, of, test, on_model, on_os, score = self.rules[i]
            if of != vendor or best and best[0] >= score:
                continue
            if (test is None or test.search(content)) and (on_model is None or on_model.search(model)) and (on_os is None or on_os.search(os)):
                best = score, number
        return (best[1], best[0]) if best else (None, None)


def best_rules(rows: DataFrame, keys: list[str], rules: DataFrame, vendor: str, model: str, os: str, content: str, most: int = 200_000) -> DataFrame:
    """keys, rule, score: the most specific of the rules that a row meets, null without one (CLS-08, JOIN-13).

    rules: id (int), vendor, content, model, os: patterns; null or empty ones match all. A model
    pattern counts 2, an os pattern 1; of equal ones the least id. Rules are data: the plan does not grow with
    them. A text is searched once for the literal parts of all patterns, and only rules whose part
    it holds, or that have none, are tried. More than `most` rules are refused, as they are broadcast.
    """
    if (n := rules.count()) > most:
        raise ValueError(f"{n} rules are more than {most}")
    held = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in rules.select("id", "vendor", "content", "model", "os").collect()])
    label = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _once(label, lambda: Rules(held.value))
        for batch in batches:
            own = [batch.column(len(keys) + k).to_pylist() for k in range(4)]
            found = [known.best(v, *(x or "" for x in rest)) for v, *rest in zip(*own, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *(pa.array([f[k] for f in found], pa.int32()) for k in (0, 1))], names=[*keys, "rule", "score"])

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("rule", T.IntegerType()), T.StructField("score", T.IntegerType())])
    return rows.select(*keys, F.col(vendor).alias("_v"), F.col(content).alias("_c"), F.col(model).alias("_m"), F.col(os).alias("_o")).mapInArrow(run, schema)
