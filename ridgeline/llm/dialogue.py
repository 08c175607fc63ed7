"""Repair of conversations: the cheapest edits after which roles follow (s?(ua)+)?.

Turns are kept, get another role, are deleted or are put in; a Viterbi search over the four states of
that pattern says at what cost. It runs from the last turn to the first, so that the least of equally
cheap edit strings can be read off from the front.

Long conversations are cut into chunks of CHUNK turns that run at the same time. A chunk does not know the
costs behind it and begins with a guess. Costs that differ by one number in every state give the
same edits, so a chunk is run again only if what the next one found differs from the guess by more,
until no chunk has to: the states' ranks converge within a few turns, and a chunk is seldom run
again. For the way back each chunk's edits are read for each state it may be entered in, and the
chunks' states are then chained.

A turn takes part as one letter for its role and its fault; texts are shuffled once, at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.manifest import CRC_SQL, crc_sql
from ridgeline.operators.ordering import numbered
from ridgeline.session import cut

CHUNK = 4096
RETYPE, DELETE, INSERT, SHORT = 3, 4, 3, 3
#: Letters of turns: of role s, u, a or another, without a fault, truncated, blank, repeated.
LETTERS = "abcdefghijklmnop"
#: States: nothing yet, after s, after u, after a. What u or a leads to, whichever may follow.
PAIRED = (2, 2, 3, 2)
#: Costs behind the last turn: what has to be put in.
DONE = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
BLANK = r"[\x20\x09-\x0D]"


def _moves(letter: str) -> tuple[tuple[int, ...], int, int]:
    """Of a letter: the state that keeping it leads to from each state (-1: none), and what keeping and retyping cost."""
    fault, role = divmod(LETTERS.index(letter), 4)
    keep = {0: (1, -1, -1, -1), 1: (2, 2, -1, 2), 2: (-1, -1, 3, -1), 3: (-1, -1, -1, -1)}[role]
    if fault > 1:
        return (-1, -1, -1, -1), FAR, FAR
    extra = SHORT if fault else 0
    return keep, extra, RETYPE + extra


MOVES = {x: _moves(x) for x in LETTERS}


def before(letter: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs in each state before a turn, from those behind it."""
    keep, kept, retyped = MOVES[letter]
    raw = [min(DELETE + after[s], retyped + after[PAIRED[s]], kept + after[keep[s]] if keep[s] >= 0 else FAR) for s in range(4)]
    u, a = min(raw[2], INSERT + raw[3]), min(raw[3], INSERT + raw[2])
    return min(raw[0], INSERT + u), min(raw[1], INSERT + u), u, a


def costs(letters: str, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs before each turn and behind the last."""
    out = [after]
    for x in reversed(letters):
        out.append(before(x, out[-1]))
    return out[::-1]


def levelled(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """A vector with its least cost taken off, and that cost."""
    least = min(vector)
    return tuple(x - least for x in vector), least


def edits(letters: str, found: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """The least of the cheapest edit strings from a state, and the state it ends in."""
    out, i = [], 0
    while i < len(letters) or last and found[i][state]:
        left = found[i][state]
        if i < len(letters) and DELETE + found[i + 1][state] == left:
            out.append("D")
        elif INSERT + found[i][PAIRED[state]] == left:
            out.append("I")
            state = PAIRED[state]
            continue
        else:
            keep, kept, _ = MOVES[letters[i]]
            if keep[state] >= 0 and kept + found[i + 1][keep[state]] == left:
                out.append("K")
                state = keep[state]
            else:
                out.append("R")
                state = PAIRED[state]
        i += 1
    return "".join(out), state


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text of conversations with some turns damaged, by the CRC-32 of conv_id and turn.

    A null in the key, the role or the text is one space. conv is conv_id as text.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(text_of("conv_id").alias("conv"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    kind = F.crc32(F.concat("conv", F.lit(":"), text_of("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    hit = own.withColumn("kind", kind).where("kind <> 0")
    return hit.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def lettered(rows: DataFrame) -> DataFrame:
    """conv, turn, index, count, letter of conv, turn, role, text, in order of turn (null first), role and the text's digest."""
    blank = ~F.col("text").rlike(BLANK.replace("[", "[^", 1))
    short = ~F.col("text").rlike(rf"[.!?]{BLANK}*\z")
    own = rows.select("conv", "turn", "role", _digest(), F.when(blank, 2).when(short, 1).otherwise(0).alias("fault"))
    placed = cut(numbered(own, "conv", ["turn", "role", "digest"]))
    # Each turn is joined by its own place, so that a text that very many turns repeat is no hot key.
    first = placed.groupBy("conv", "role", "digest").agg(F.min("index").alias("index")).select("conv", "index", F.lit(True).alias("first"))
    fault = F.when(F.col("fault") == 2, 2).when(F.col("first").isNull(), 3).otherwise(F.col("fault"))
    start = F.substring("role", 1, 1)
    role = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    joined = placed.join(first, ["conv", "index"], "left")
    return joined.select("conv", "turn", "index", "count", F.substring(F.lit(LETTERS), fault * 4 + role + 1, F.lit(1)).alias("letter"))


def _chunks(turns: DataFrame) -> DataFrame:
    """conv, chunk, last, letters, illegal: each chunk's turns as one string, and its adjacent roles that may not be."""
    size = F.floor((F.max("count") - 1) / CHUNK)
    chunk = F.floor(F.col("index") / CHUNK)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "letter"))), lambda x: x["letter"]), "")
    own = turns.groupBy("conv", chunk.alias("chunk")).agg(text.alias("letters"), size.alias("last_chunk"))
    behind = F.lag(F.substring("letters", -1, 1)).over(Window.partitionBy("conv").orderBy("chunk"))  # a row for CHUNK turns
    return own.select("conv", "chunk", (F.col("chunk") == F.col("last_chunk")).alias("last"), F.coalesce(behind, F.lit("")).alias("behind"), "letters")


def _backward(chunks: DataFrame, due: str) -> DataFrame:
    """chunks with right, the costs behind them that were taken, left, those before them less the least, and that as least; run where `due` (an array) is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            right, left, least = (columns[c].to_pylist() for c in ("right", "left", "least"))
            for i, (x, new) in enumerate(zip(columns["letters"].to_pylist(), columns[due].to_pylist(), strict=True)):
                if new is not None:
                    vector = tuple(new)
                    for letter in reversed(x):
                        vector = before(letter, vector)
                    levelled_left, least[i] = levelled(vector)
                    right[i], left[i] = new, list(levelled_left)
            vectors = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in names[:5]), pa.array(right, vectors), pa.array(left, vectors), pa.array(least, pa.int64())], names=names)

    names = ["conv", "chunk", "last", "behind", "letters", "right", "left", "least"]
    schema = "conv string, chunk long, last boolean, behind string, letters string, right array<long>, left array<long>, least long"
    return chunks.select(*names, due).mapInArrow(run, schema)


def _settled(chunks: DataFrame) -> DataFrame:
    """Chunks whose costs behind them are those that the next one found, but for one number."""
    none = F.lit(None).cast("array<long>")
    guess = F.array(*(F.lit(x).cast("long") for x in DONE))
    found = cut(_backward(chunks.withColumns({"right": none, "left": none, "least": F.lit(None).cast("long"), "due": guess}), "due"))
    next_left = F.lead("left").over(Window.partitionBy("conv").orderBy("chunk"))  # a row for CHUNK turns
    while True:
        many = found.where("chunk > 0 or not last").withColumn("next", next_left)
        stale = cut(many.where("not last and next <> right").select("conv", "chunk", F.col("next").alias("due")))
        if stale.isEmpty():
            return found
        found = cut(_backward(found.join(stale, ["conv", "chunk"], "left"), "due"))


def _traced(chunks: DataFrame) -> DataFrame:
    """conv, chunk, cost, illegal, audits, ends: a chunk's edits and last state for each state it may be entered in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(c).to_pylist() for c in ("letters", "right", "last", "behind", "chunk", "left", "least")}
            audits, ends, cost, illegal = [], [], [], []
            for k, x in enumerate(own["letters"]):
                vectors = costs(x, tuple(own["right"][k]))
                found = [edits(x, vectors, s, own["last"][k]) if s == 0 or own["chunk"][k] else ("", 0) for s in range(4)]
                audits.append([f[0] for f in found])
                ends.append([f[1] for f in found])
                cost.append(own["least"][k] + (own["left"][k][0] if own["chunk"][k] == 0 else 0))
                roles = [LETTERS.index(c) % 4 for c in own["behind"][k] + x]
                illegal.append(sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(roles, roles[1:], strict=False)))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()), pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=["conv", "chunk", "cost", "illegal", "audits", "ends"])

    return chunks.mapInArrow(run, "conv string, chunk long, cost long, illegal long, audits array<string>, ends array<int>")


def audited(turns: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of lettered turns."""
    fault = lambda a, b: F.count_if(F.col("letter").between(a, b))
    distinct = F.count_distinct("turn")
    gaps = F.when(distinct > 0, F.max("turn") - F.min("turn") + 1 - distinct).otherwise(0).cast("long")
    counts = turns.groupBy("conv").agg(gaps.alias("gaps"), fault("i", "l").alias("blank"), fault("m", "p").alias("duplicate"), fault("e", "h").alias("truncated"))
    traced = _traced(_settled(_chunks(turns)))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "audits", "ends")))  # a row for CHUNK turns
    whole = traced.groupBy("conv").agg(parts.alias("parts"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    entered = F.aggregate("parts", F.array(F.lit(0)), lambda s, p: F.concat(s, F.array(F.get(p["ends"], F.element_at(s, -1)))))
    audit = F.array_join(F.zip_with("parts", F.slice("entered", 1, F.size("parts")), lambda p, s: F.get(p["audits"], s)), "")
    whole = whole.withColumn("entered", entered).select("conv", audit.alias("audit"), "cost", "illegal")
    return counts.join(whole, "conv")


HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order: in one task, read as a stream."""
    nothing = lambda kind: F.lit(None).cast(kind)
    turns = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", _digest(), "text", nothing("string").alias("audit"), *(nothing("long").alias(c) for c in HEAD))
    turn = nothing(rows.schema["turn"].dataType)
    heads = audits.select("conv", F.lit(0), turn, nothing("string"), nothing("binary"), nothing("string"), "audit", *HEAD)
    both = turns.union(heads)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").select("conv", "kind", "role", "text", "audit", *HEAD)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, tuple[str, str, str] | None]]:
    """The heads of conversations (first), and behind each its repaired turns: edit, role, text."""
    audit, at, state = "", 0, 0

    def put_in():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = PAIRED[state]
            at += 1
            yield None, ("I", "user" if state == 2 else "assistant", "")

    for batch in batches:
        kinds, roles, texts = (batch.column(c).to_pylist() for c in ("kind", "role", "text"))
        for i, kind in enumerate(kinds):
            if kind == 0:
                yield from put_in()
                audit, at, state = batch.column("audit")[i].as_py(), 0, 0
                yield {c: batch.column(c)[i].as_py() for c in ("conv", "audit", *HEAD)}, None
                continue
            yield from put_in()
            edit, role = audit[at], roles[i]
            at += 1
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                yield None, ("K", role, texts[i])
            elif edit == "R":
                state = PAIRED[state]
                yield None, ("R", "user" if state == 2 else "assistant", texts[i])
    yield from put_in()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, place, edit, role, text: the turns of the repaired conversations, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out = None, 0, []
        for head, turn in _walk(batches):
            if head is not None:
                conv, place = head["conv"], 0
                continue
            out.append((conv, place, *turn))
            place += 1
            if len(out) == 1024:
                yield _batch(out, kinds)
                out = []
        yield _batch(out, kinds)

    kinds = {"conv": pa.string(), "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
    return _replayed(rows, audits).mapInArrow(run, "conv string, place long, edit string, role string, text string")


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def digested(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """audits with repaired_sha256, the digest of the repaired turns as role:text, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, empty, out = None, None, True, []

        def close():
            if head is not None:
                out.append((*(head[c] for c in names[:-1]), digest.hexdigest()))

        for new, turn in _walk(batches):
            if new is not None:
                close()
                head, digest, empty = new, hashlib.sha256(), True
                if len(out) >= 1024:
                    yield _batch(out, kinds)
                    out.clear()
                continue
            digest.update((("" if empty else "\n") + turn[1] + ":" + turn[2]).encode())
            empty = False
        close()
        yield _batch(out, kinds)

    names = ["conv", "audit", *HEAD, "repaired_sha256"]
    kinds = {c: pa.int64() if c in HEAD else pa.string() for c in names}
    return _replayed(rows, audits).mapInArrow(run, ", ".join(f"{c} {'long' if c in HEAD else 'string'}" for c in names))


def checked(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of damaged() conversations.

    One row for each conv_id of rows (null too), also where no turn is left: zeros, an empty audit and the digest of nothing.
    Turns of equal number go by role and the digest of the text; turns that are equal in all are
    repeats. A role that begins with none of s, u and a is given another or deleted. Further columns do not count.
    """
    broken = damaged(rows)
    audits = audited(cut(lettered(broken)))
    ids = rows.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    found = digested(broken, cut(audits))
    out = ids.join(found, "conv", "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in HEAD), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_STEP = ", ".join(
    f"least({DELETE} + b[{s + 1}], CASE WHEN gone THEN {FAR} ELSE t + {RETYPE} + b[{PAIRED[s] + 1}] END, CASE WHEN gone THEN {FAR} {keep} ELSE {FAR} END)"
    for s, keep in enumerate(("WHEN role[1] = 's' THEN t + b[2] WHEN role[1] = 'u' THEN t + b[3]", "WHEN role[1] = 'u' THEN t + b[3]", "WHEN role[1] = 'a' THEN t + b[4]", "WHEN role[1] = 'u' THEN t + b[3]"))
)
ORACLE = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc_table),
e AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE k <> 0),
r AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM e),
f AS (SELECT *, NOT regexp_matches(text, '{BLANK.replace("[", "[^", 1)}') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?]{BLANK}*$') AS short, lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] AS pair FROM r),
c AS MATERIALIZED (SELECT conv, turn, role, text, i, blank OR again AS gone, blank, NOT blank AND again AS again, NOT blank AND NOT again AND short AS short, CASE WHEN short THEN {SHORT} ELSE 0 END AS t, pair FROM f),
g AS MATERIALIZED (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE short) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv),
v AS (SELECT conv, n + 1 AS i, {list(DONE)}::BIGINT[] AS b FROM g
  UNION ALL SELECT conv, i, [least(w[1], {INSERT} + w[3], {2 * INSERT} + w[4]), least(w[2], {INSERT} + w[3], {2 * INSERT} + w[4]), least(w[3], {INSERT} + w[4]), least(w[4], {INSERT} + w[3])]
  FROM (SELECT v.conv, c.i, [{_STEP}] AS w FROM v JOIN c ON c.conv = v.conv AND c.i = v.i - 1)),
vm AS MATERIALIZED (SELECT * FROM v),
z AS (SELECT conv, 1::BIGINT AS i, 0 AS s, '' AS audit, '' AS said, 0 AS m FROM g
  UNION ALL SELECT conv, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' THEN CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE p END, audit || e,
    CASE WHEN e = 'D' THEN said ELSE said || CASE WHEN m > 0 THEN chr(10) ELSE '' END || CASE WHEN e = 'K' THEN role WHEN p = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END, CASE WHEN e = 'D' THEN m ELSE m + 1 END
  FROM (SELECT z.*, c.role, c.text, {list(PAIRED)}[z.s + 1] AS p,
      CASE WHEN c.i IS NOT NULL AND {DELETE} + y.b[z.s + 1] = x.b[z.s + 1] THEN 'D' WHEN {INSERT} + x.b[{list(PAIRED)}[z.s + 1] + 1] = x.b[z.s + 1] THEN 'I'
        WHEN NOT c.gone AND (z.s IN (0, 1, 3) AND c.role[1] = 'u' AND c.t + y.b[3] = x.b[z.s + 1] OR z.s = 0 AND c.role[1] = 's' AND c.t + y.b[2] = x.b[1] OR z.s = 2 AND c.role[1] = 'a' AND c.t + y.b[4] = x.b[3]) THEN 'K' ELSE 'R' END AS e
    FROM z JOIN vm x ON x.conv = z.conv AND x.i = z.i LEFT JOIN vm y ON y.conv = z.conv AND y.i = z.i + 1 LEFT JOIN c ON c.conv = z.conv AND c.i = z.i
    WHERE c.i IS NOT NULL OR x.b[z.s + 1] > 0)),
o AS (SELECT z.conv, audit, sha256(said) AS repaired_sha256 FROM z JOIN g ON g.conv = z.conv AND z.i = g.n + 1 AND z.s IN (0, 3))
SELECT u.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(vm.b[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) u LEFT JOIN g ON g.conv = coalesce(CAST(u.conv_id AS VARCHAR), ' ') LEFT JOIN vm ON vm.conv = g.conv AND vm.i = 1 LEFT JOIN o ON o.conv = g.conv"""
