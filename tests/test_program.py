"""Line programs against their meaning, on texts of our own."""

import pytest

from ridgeline.functions.regex import PatternError, translate
from ridgeline.plans.program import ProgramError, parse, run, validate


def rows(spark, program, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, raw string")
    return [tuple(r)[2:] for r in run(df, program, "raw", ["doc_id"], **options).orderBy("row_no").collect()]


TABLE = "note\nName  State Info\n--- --- ---\nge0  up  a b  c\n\nge1 down\nend of list\nge2 up x"


def test_table(spark):
    program = "# interfaces\nSKIP_UNTIL ^Name\nSKIP_LINES 1\nSKIP_BLANK\nSTOP_AT ^end\nSPLIT $name $state $info"
    assert rows(spark, program, TABLE) == [("ge0", "up", "a b c"), ("ge1", "down", "")]
    assert rows(spark, "SKIP_UNTIL ^Nothing\nSPLIT $a", TABLE) == []
    assert rows(spark, "SKIP_LINES 3\nFILTER ^ge\nREJECT down\nSPLIT $a $b", TABLE) == [("ge0", "up a b c"), ("ge2", "up x")]
    assert rows(spark, "SKIP_UNTIL ^Name\nSKIP_LINES 2\nSTOP_AT ^---\nSPLIT $a", TABLE) == []


def test_replace_and_set(spark):
    program = 'FILTER ^ge\nREPLACE "^ge(?P<n>\\d)" "port${n}"\nREPLACE " x$" ""\nSPLIT $p $s\nSET $both $p "/" $s\nSET $on ($s == "up" ? "yes" : "no")\nSET $first (REGEX_MATCH($p, "0$") ? "y" : $s)'
    assert rows(spark, program, TABLE)[1:] == [("port1", "down", "port1/down", "no", "down"), ("port2", "up", "port2/up", "yes", "up")]
    assert rows(spark, "FILTER ge2\nSPLIT $p $s\nSET $q $p", TABLE) == [("ge2", "up x", "ge2")]
    assert rows(spark, "FILTER ge2\nSPLIT $p $s\nSET $q $s", TABLE, compat=True) == [("ge2", "up", "up")]


def test_record(spark):
    text = "Router ID: 10.0.0.1\nArea : 7\nArea : 8"
    assert rows(spark, r"REGEX Router ID:\s+(?P<id>\S+)" + "\n" + r"REGEX Area : (?P<area>\d+)( x(?P<opt>y))?", text) == [("10.0.0.1", "7", "")]
    assert rows(spark, r"REGEX Nothing (?P<id>\S+)", text) == []
    assert rows(spark, 'REGEX Area : (?P<area>\\d+)\nSET $z "v"', text) == [("7", "v")]


def test_regex_table(spark):
    text = "a=1 b=2\na=3\nc=4\n"
    assert rows(spark, "FILTER =\nREGEX a=(?P<a>\\d)\nREGEX b=(?P<b>\\d)", text) == [("1", "2"), ("3", None)]


def test_sections(spark):
    program = "SECTION\nSKIP_UNTIL ^L\nSTOP_AT ^R\nSPLIT $l\nSECTION\nSKIP_UNTIL ^R\nSPLIT $r"
    assert rows(spark, program, "L\n1\n2\n3\nR\n4\n5") == [("1", "4"), ("2", "5"), ("3", None)]


def test_repeat(spark):
    text = "x\nGroup A id 1\nm1 up\nm2 down\nGroup B id 2\nm3 up"
    program = "REPEAT_FOR ^Group (?P<g>\\w) id (?P<i>\\d)\nSPLIT $m $s"
    assert rows(spark, program, text) == [("A", "1", "m1", "up"), ("A", "1", "m2", "down"), ("B", "2", "m3", "up")]
    assert rows(spark, "REPEAT_FOR ^None\nSPLIT $m", text) == []
    nested = "P a\n n 1\n  match x\n n 2\n  apply y\n  apply z\nP b\n n 1\n  match q"
    program = "REPEAT_FOR ^P (?P<p>\\w)\nREPEAT_FOR ^ n (?P<n>\\d)\nREGEX match (?P<match>\\w)\nREGEX apply (?P<apply>\\w)"
    assert rows(spark, program, nested) == [("a", "1", "x", None), ("a", "2", None, "y"), ("b", "1", "q", None)]


def test_unicode_blanks_and_carriage_returns(spark):
    assert rows(spark, "SKIP_BLANK\nSPLIT $a $b", "x\u00a0y\r\n\u2003\r\nz") == [("x", "y"), ("z", "")]
    assert rows(spark, "FILTER abc$\nSPLIT $a", "abc\r\nabc") == [("abc",)]
    assert rows(spark, "SPLIT $a", None) == []


def test_errors():
    for bad in ("", "# only\n", "JUMP x", "SPLIT", "SPLIT a", "REPLACE x", "FILTER (", "FILTER (?=x)", "SKIP_LINES x", "SET a b"):
        with pytest.raises(ProgramError):
            validate(bad)
    assert [x.verb for x in parse("split $a\n  # c\n\nEMIT")] == ["SPLIT", "EMIT"]
    assert translate(r"(?P<a_b>x)(y)(?P<c>[\s(])").groups == {"a_b": 1, "c": 3}
    with pytest.raises(PatternError):
        translate(r"(a)\1")
