"""Text cleaners against plain-Python definitions of the same semantics."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions import text as TX


def py_clean_text(s):
    spaced = "".join(" " if c in ",\\-" else c for c in s)
    return " ".join(spaced.split())


def py_clean_address(s):
    return " ".join(s.split())


def py_digits(s):
    return "".join(c for c in s if c.isdecimal())


def py_strip_title(s):
    return s.strip().title()


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", fn("v").alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


def test_fixture_cases(spark):
    assert run(spark, ["a,b\\c-d", None, "  x ,, y  "], TX.clean_text) == ["a b c d", None, "x y"]
    assert run(spark, ["12-B Main,\nSt", "\ta  b\r\n"], TX.clean_address) == ["12-B Main, St", "a b"]
    assert run(spark, ["+1-555x12", "abc", None, "٣4"], TX.digits_only) == ["155512", "", None, "٣4"]
    assert run(spark, ["non-vegetarian", "o'neil", "3rd", "\ta  ", "", None], TX.strip_title) == [
        "Non-Vegetarian", "O'Neil", "3Rd", "A", "", None]
    assert run(spark, ["straße", "ǆungla"], TX.strip_title) == ["Straße", "ǅungla"]


# Unicode whitespace, separators, punctuation, digits of other scripts and
# letters with simple one-to-one case mappings.
ALPHABET = (
    string.ascii_letters + string.digits + " ,-\\'.#_/\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    "        　​"
    "éÉàÀüÜñÑçÇøØåÅæÆœŒĳ٣۴०"
)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=30))
def test_differential(spark, values):
    assert run(spark, values, TX.clean_text) == [py_clean_text(v) for v in values]
    assert run(spark, values, TX.clean_address) == [py_clean_address(v) for v in values]
    assert run(spark, values, TX.digits_only) == [py_digits(v) for v in values]
    assert run(spark, values, TX.strip_title) == [py_strip_title(v) for v in values]
    assert run(spark, values, TX.strip_title_expr) == [py_strip_title(v) for v in values]


def test_idempotent(spark):
    vals = ["  a,,b--c\\d  ", "x\n\ny", "MiXeD-case words 3rd"]
    once = run(spark, vals, TX.clean_text)
    assert run(spark, once, TX.clean_text) == once
    t1 = run(spark, vals, TX.strip_title)
    assert run(spark, t1, TX.strip_title) == t1


def test_whitespace_classes_equal_python(spark):
    from pyspark.sql import functions as F

    # one row per BMP code point up to U+30FF (covers every whitespace char)
    rows = [(cp, chr(cp)) for cp in range(1, 0x3100) if not 0xD800 <= cp <= 0xDFFF]
    df = spark.createDataFrame(rows, "cp int, c string")
    java = {r.cp for r in df.where(F.regexp_replace("c", TX.JAVA_WS, "") == "").collect()}
    listed = {r.cp for r in df.where(F.regexp_replace("c", TX.WS, "") == "").collect()}
    py = {cp for cp, c in rows if c.isspace()}
    assert java == py == listed
