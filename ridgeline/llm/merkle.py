"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions alone.

A paragraph is a line of the text, cut into leaves of a sentence or PIECE characters. A node's hash
is the MD5 of its children's hashes, whole all the way up. Sections are runs of paragraphs that end
where a paragraph's hash says so (one in eight), so an insertion moves no other boundary. A
fingerprint is a string in which only leaves are shortened, after they were hashed:

    root;section section ...;,paragraph.leaf.leaf,paragraph.leaf ...

with a blank at each section's end. Equal texts have equal fingerprints, and roots alone tell, as
surely as MD5 does. Branches that differ locate edits: see with_edit().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leaves: up to 48 characters without a sentence's end, and the end.
LEAF = r"[^.!?]{1,48}[.!?]*|[.!?]+"
#: Rows of one sorted run, and runs at most: ids are looked up in the bounds of runs.
RUN, RUNS = 512, 1 << 14


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column."""
    hashes = F.transform(F.split(F.col(text), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), F.md5))
    df = df.withColumn("_leaves", hashes)

    def paragraph(leaf: Column) -> Column:
        own = F.md5(F.array_join(leaf, ""))
        end = F.when(F.left(own, F.lit(1)).isin("0", "1"), " ").otherwise("")
        return F.concat(F.lit(","), own, F.array_join(F.transform(leaf, lambda x: F.concat(F.lit("."), F.left(x, F.lit(8)))), ""), end)

    df = df.withColumn("_tree", F.rtrim(F.array_join(F.transform("_leaves", paragraph), ""))).drop("_leaves")
    sections = F.transform(F.split(F.regexp_replace(F.col("_tree"), r"\.[0-9a-f]{8}", ""), " ", -1), F.md5)
    df = df.withColumn("_sections", F.array_join(sections, " "))
    return df.withColumn(name, F.concat(F.md5("_sections"), F.lit(";"), "_sections", F.lit(";"), "_tree")).drop("_tree", "_sections")


def leaves(fingerprint: Column) -> Column:
    """The leaves of a fingerprint, each as often as it stands there."""
    return F.regexp_extract_all(fingerprint, F.lit(r"\.([0-9a-f]{8})"), F.lit(1))


def root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, ";", 1)


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of the leaves of two fingerprints, repeats counted; 1 for equal roots, and below 1 for others.

    Texts of the same leaves in another order would reach 1: then one leaf more, of neither, is added
    to all. Leaves are sorted together, so the cost is that of sorting, however long a text is.
    """
    marked = F.array_sort(F.concat(F.transform(leaves(a), lambda x: F.concat(x, F.lit("a"))), F.transform(leaves(b), lambda x: F.concat(x, F.lit("b")))))
    start = F.struct(F.lit("").alias("leaf"), F.lit(0).alias("more"), F.lit(0).alias("apart"))

    def count(s: Column, x: Column) -> Column:
        leaf, one = F.left(x, F.lit(8)), F.when(x.endswith("a"), 1).otherwise(-1)
        same = s["leaf"] == leaf
        return F.struct(leaf.alias("leaf"), F.when(same, s["more"] + one).otherwise(one).alias("more"), F.when(same, s["apart"]).otherwise(s["apart"] + F.abs(s["more"])).alias("apart"))

    apart = F.aggregate(marked, start, count, lambda s: s["apart"] + F.abs(s["more"]))
    total = F.size(marked)
    return F.when(root(a) == root(b), 1.0).when(total == 0, 0.0).when(apart == 0, total / (total + 1.0)).otherwise((total - apart) / (total * F.lit(1.0)))


def _agreeing(a: Column, b: Column) -> Column:
    """Number of equal elements at the start of two arrays."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


EDIT = ("edit_section", "edit_paragraph", "edit_removed", "edit_added")


def with_edit(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with where the trees of the fingerprints a and b differ, null if equal: the numbers (from 0) of
    the first differing section and paragraph of a, and how many of its paragraphs are replaced by how
    many of b.

    The walk goes down only where hashes differ: sections that agree from the start and from the end
    are left, and within the others paragraphs that do. So the run is the shortest outside of which
    the texts agree, and a second copy of a paragraph counts by its place.
    """
    paragraphs = lambda trees: F.regexp_extract_all(F.array_join(trees, ""), F.lit(r",([0-9a-f]{32})"), F.lit(1))
    less = lambda x, n: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    for k, x in enumerate((a, b)):
        differ = root(F.col(a)) != root(F.col(b))
        part = lambda n, x=x, differ=differ: F.split(F.when(differ, F.split_part(F.col(x), F.lit(";"), F.lit(n))), " ", -1)
        df = df.withColumn(f"_s{k}", part(2)).withColumn(f"_t{k}", part(3))
    df = df.withColumn("_head", _agreeing(F.col("_s0"), F.col("_s1")))
    df = df.withColumn("_tail", _agreeing(F.reverse(less(F.col("_s0"), F.col("_head"))), F.reverse(less(F.col("_s1"), F.col("_head")))))
    for k in (0, 1):
        inner = F.slice(F.col(f"_t{k}"), F.col("_head") + 1, F.greatest(F.size(f"_t{k}") - F.col("_head") - F.col("_tail"), F.lit(0)))
        df = df.withColumn(f"_p{k}", paragraphs(inner))
    df = df.withColumn("_first", _agreeing(F.col("_p0"), F.col("_p1")))
    df = df.withColumn("_last", _agreeing(F.reverse(less(F.col("_p0"), F.col("_first"))), F.reverse(less(F.col("_p1"), F.col("_first")))))
    before = F.size(paragraphs(F.slice(F.col("_t0"), F.lit(1), F.col("_head"))))
    left = [F.size(f"_p{k}") - F.col("_first") - F.col("_last") for k in (0, 1)]
    found = [F.col("_head"), before + F.col("_first"), *left]
    df = df.withColumns({name: F.when(F.col("_head").isNotNull(), x).cast("int") for name, x in zip(EDIT, found, strict=True)})
    return df.drop("_s0", "_s1", "_t0", "_t1", "_head", "_tail", "_p0", "_p1", "_first", "_last")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with `_next`, the text of the next row by ascending id; after the last, the first.

    Ids are dealt to runs between quantiles, each run is sorted by itself, and the first row of a
    run is also sent to the run before. An id that many rows repeat, or null, is dealt to several
    runs by the hash that orders these rows. So no task sees much more than a run, and texts move once.
    """
    rows, known = docs.agg(F.count("*"), F.count(id_col)).first()
    n = 1
    while n < min(RUNS, known / RUN):
        n *= 2
    bounds = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 4 * n + 10_000)).first()[0] or [] if n > 1 else []
    spread = (F.xxhash64(text_col) / F.lit(2.0**64) + 0.5) * (1 - 1e-12)  # from 0 to less than 1, as the hash ascends
    empty = min(RUNS, -(-(rows - known) // RUN)) or 1
    if bounds:
        ids = sorted(set(bounds))
        copies = [bounds.count(i) for i in ids] if len(ids) < len(bounds) else [1] * len(ids)
        begins = [empty]  # the first run of what comes before the first bound, and of each bound's id
        for c in [1, *(c + 1 for c in copies)][: len(ids)]:
            begins.append(begins[-1] + c)
        array = lambda x, kind: F.from_json(F.lit(str(x)), f"array<{kind}>")  # noqa: E731  # a constant of the plan
        held = array(ids, docs.schema[id_col].dataType.simpleString())
        steps, s = [], 1
        while s <= len(ids):
            steps.insert(0, s)
            s *= 2
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda acc, s: acc + F.when(F.get(held, acc + s - 1) <= F.col(id_col), s).otherwise(0))
        docs = docs.withColumn("_at", at)
        parts = F.get(array(copies, "int"), F.col("_at") - 1)
        own = F.when(F.get(held, F.col("_at") - 1) == F.col(id_col), F.floor(spread * parts)).otherwise(parts).cast("int")
        run = F.get(array(begins, "int"), F.col("_at")) + F.coalesce(own, F.lit(0))
    else:
        run = F.lit(empty)
    docs = docs.withColumn("_run", F.when(F.col(id_col).isNull(), F.floor(spread * empty).cast("int")).otherwise(run)).drop("_at")
    docs = docs.withColumn("_order", F.struct(F.col(id_col), F.xxhash64(text_col)))
    firsts = docs.groupBy("_run").agg(F.min("_order").alias("_first"))
    by_run = Window.partitionBy(F.lit(0)).orderBy("_run")
    last = F.max("_run").over(Window.partitionBy(F.lit(0)))
    firsts = firsts.select(F.col("_run").alias("_of"), "_first", F.coalesce(F.lag("_run").over(by_run), last).alias("_to"), F.lag("_run").over(by_run).isNull().alias("_turn"))
    both = docs.join(F.broadcast(firsts), F.col("_run") == F.col("_of"))  # RUNS rows at most
    copy = F.struct(F.col("_to").alias("run"), F.col("_turn").alias("turn"), F.lit(True).alias("copy"))
    own = F.struct(F.col("_run").alias("run"), F.lit(False).alias("turn"), F.lit(False).alias("copy"))
    both = both.withColumn("_at", F.explode(F.when(F.col("_order").eqNullSafe(F.col("_first")), F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("_at.run").orderBy("_at.turn", "_order", "_at.copy")
    both = both.withColumn("_next", F.lead(text_col).over(order)).where("not _at.copy")
    return both.drop("_run", "_order", "_of", "_first", "_to", "_turn", "_at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row, and with_edit()'s columns.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or
    all, of the next row's text by ascending id; the last row's next is the first.

    A null text is empty; the fingerprint of an empty text is that of one empty paragraph. Rows
    that repeat an id follow each other by a hash of their text; those that repeat the text too stay in one run. A null id comes first. A row alone
    is its own next. An empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = with_next(rows, id_col, "_text").withColumn("n_chars", F.length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.left("_text", F.col("n_chars").cast("int") - half), F.left("_next", half)))
    rows = with_fingerprint(rows, "_text", "fingerprint").drop("_text")
    rows = with_fingerprint(rows, "_next", "_next_fingerprint").drop("_next")
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    rows = with_fingerprint(rows, "_edited", "edited_fingerprint").drop("_edited")
    own = F.col("fingerprint")
    rows = rows.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(own, F.col("edited_fingerprint")).alias("near_edited"), likeness(own, F.col("_next_fingerprint")).alias("near_next"))
    return with_edit(rows, "fingerprint", "edited_fingerprint")


def _tree_sql(text: str) -> str:
    return f"""rtrim(array_to_string(list_transform(list_transform(list_transform(string_split({text}, chr(10)),
        lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: md5(x))),
        lambda l: struct_pack(h := md5(coalesce(array_to_string(l, ''), '')), l := coalesce(array_to_string(list_transform(l, lambda x: '.' || left(x, 8)), ''), ''))),
        lambda p: ',' || p.h || p.l || CASE WHEN left(p.h, 1) IN ('0', '1') THEN ' ' ELSE '' END), ''), ' ')"""


def _print_sql(tree: str) -> str:
    sections = f"array_to_string(list_transform(string_split(regexp_replace({tree}, '\\.[0-9a-f]{{8}}', '', 'g'), ' '), lambda x: md5(x)), ' ')"
    return f"(md5({sections}) || ';' || {sections} || ';' || {tree})"


def _near_sql(a: str, b: str) -> str:
    of = lambda c: f"regexp_extract_all({c}, '\\.([0-9a-f]{{8}})', 1)"
    total = f"(len({of(a)}) + len({of(b)}))"
    apart = f"(SELECT coalesce(sum(abs(d)), 0) FROM (SELECT sum(s) AS d FROM (SELECT unnest({of(a)}) AS x, 1 AS s UNION ALL SELECT unnest({of(b)}), -1) GROUP BY x))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {total} = 0 THEN 0.0::DOUBLE WHEN {apart} = 0 THEN {total} / ({total} + 1.0::DOUBLE) ELSE ({total} - {apart}) / ({total} * 1.0::DOUBLE) END"


def _agreeing_sql(a: str, b: str) -> str:
    return f"coalesce(nullif(list_position(list_transform(list_zip({a}, {b}), lambda x: x[1] IS NOT DISTINCT FROM x[2]), false), 0) - 1, len({a}))"


def _paragraphs_sql(trees: str) -> str:
    return f"regexp_extract_all(coalesce(array_to_string({trees}, ''), ''), ',([0-9a-f]{{32}})', 1)"


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), (SELECT text FROM t ORDER BY doc_id LIMIT 1)) AS follow FROM t),
e AS (SELECT doc_id, text, follow, length(text) AS n_chars, left(text, length(text) - length(text) // 2) || left(follow, length(text) // 2) AS edited FROM n),
w AS (SELECT doc_id, n_chars, edited, {_tree_sql("text")} AS a, {_tree_sql("follow")} AS b, {_tree_sql("edited")} AS c FROM e),
f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_print_sql("a")} AS fingerprint, {_print_sql("b")} AS follow, {_print_sql("c")} AS edited_fingerprint, a, c FROM w),
g AS (SELECT *, string_split(split_part(fingerprint, ';', 2), ' ') AS s0, string_split(split_part(edited_fingerprint, ';', 2), ' ') AS s1, string_split(a, ' ') AS t0, string_split(c, ' ') AS t1 FROM f),
h AS (SELECT *, {_agreeing_sql("s0", "s1")} AS head FROM g),
i AS (SELECT *, {_agreeing_sql("list_reverse(s0[head + 1:])", "list_reverse(s1[head + 1:])")} AS tail FROM h),
j AS (SELECT *, {_paragraphs_sql("t0[head + 1:len(t0) - tail]")} AS p0, {_paragraphs_sql("t1[head + 1:len(t1) - tail]")} AS p1 FROM i),
k AS (SELECT *, {_agreeing_sql("p0", "p1")} AS first FROM j),
l AS (SELECT *, {_agreeing_sql("list_reverse(p0[first + 1:])", "list_reverse(p1[first + 1:])")} AS last, fingerprint <> edited_fingerprint AS differ FROM k)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_near_sql("fingerprint", "edited_fingerprint")} AS near_edited, {_near_sql("fingerprint", "follow")} AS near_next,
    CASE WHEN differ THEN head::INTEGER END AS edit_section, CASE WHEN differ THEN (len({_paragraphs_sql("t0[1:head]")}) + first)::INTEGER END AS edit_paragraph,
    CASE WHEN differ THEN (len(p0) - first - last)::INTEGER END AS edit_removed, CASE WHEN differ THEN (len(p1) - first - last)::INTEGER END AS edit_added
FROM l
"""
