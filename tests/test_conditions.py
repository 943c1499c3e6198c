"""The condition language: its truth table over typed columns and over maps, and its grammar."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenry.model import field_value
from lumenry.plans import conditions as C

POINT = {"host": "web-7", "load": 0.75, "cores": 16, "up": True}
#: For each rule of the truth table: condition, values, outcome.
CASES = [
    # another type than the literal's is false for every operator, "!=" too
    ("{ cores = 16.0 }", POINT, False),
    ("{ cores != 'many' }", POINT, False),
    ("{ load >= 0 }", POINT, False),
    ("{ up = 'true' }", POINT, False),
    ("{ host > 5 }", POINT, False),
    # the same type
    ("{ cores = 16, cores >= 16, cores <= 16 }", POINT, True),
    ("{ cores > 15 and cores < 17 }", POINT, True),
    ("{ cores != 17 }", POINT, True),
    ("{ up = true }", POINT, True),
    ("{ up != false }", POINT, True),
    ("{ up >= true }", POINT, False),
    ("{ up < true }", POINT, False),
    # strings by bytes
    ("{ host > 'web-10' }", POINT, True),
    ("{ host < 'Web' }", POINT, False),
    ("{ host >= 'web-7', host <= 'web-7' }", POINT, True),
    # floats are equal within 1e-9, and unequal exactly
    ("{ load = 0.7500000001 }", POINT, True),
    ("{ load != 0.7500000001 }", POINT, True),
    ("{ load = 0.7501 }", POINT, False),
    # missing keys
    ("{ zone = nil }", POINT, True),
    ("{ zone != NULL }", POINT, False),
    ("{ zone != 'eu' }", POINT, True),
    ("{ zone = 'eu' }", POINT, False),
    ("{ zone < 3 }", POINT, False),
    ("{ zone >= 3 }", POINT, False),
    # keys that are there
    ("{ up = null }", POINT, False),
    ("{ load != nil }", POINT, True),
    # re(): unanchored, strings only; "!=" is always true for strings
    ("{ host = re('b-[0-9]') }", POINT, True),
    ("{ host = re(`^b`) }", POINT, False),
    ("{ cores = re('1') }", POINT, False),
    ("{ zone = re('.') }", POINT, False),
    ("{ host != re('web') }", POINT, True),
    # IN: typed; for a missing key the first item alone decides
    ("{ host in ['db-1', 'web-7'] }", POINT, True),
    ("{ cores in ['16', 16.0, 8] }", POINT, False),
    ("{ up in [2, true] }", POINT, True),
    ("{ zone in [nil, 'eu'] }", POINT, True),
    ("{ zone in ['eu', nil] }", POINT, False),
    ("{ zone in [] }", POINT, False),
    # NOTIN
    ("{ host notin ['db-1', 7] }", POINT, True),
    ("{ cores not_in [8, 16] }", POINT, False),
    ("{ zone notin ['eu', 'us'] }", POINT, True),
    ("{ zone notin ['eu', nil] }", POINT, False),
    ("{ zone notin [] }", POINT, True),
    # MATCH: any pattern
    ("{ host match ['^db', '7$'] }", POINT, True),
    ("{ host match ['^db'] }", POINT, False),
    ("{ host match [] }", POINT, False),
    ("{ cores match ['.'] }", POINT, False),
    ("{ zone match ['.*'] }", POINT, False),
    ("{ host match ['*bad('] }", POINT, False),
    # NOTMATCH: true if any pattern fails
    ("{ host notmatch ['^db', '7$'] }", POINT, True),
    ("{ host notmatch ['web', '7$'] }", POINT, False),
    ("{ host notmatch [] }", POINT, False),
    ("{ zone notmatch ['eu'] }", POINT, False),
    ("{ up notmatch ['x'] }", POINT, False),
    # literals and names on the other side
    ("{ 'x' = 'x' }", POINT, True),
    ("{ 2 = 2.0 }", POINT, False),
    ("{ nil = nil }", POINT, True),
    ("{ host = load }", POINT, False),
    ("{ re('web') = host }", POINT, False),
    # groups: the comma is AND; a semicolon starts the next; an empty one holds; a leading semicolon never does
    ("{ up = true, cores = 16 }", POINT, True),
    ("{ up = true, cores = 8 }", POINT, False),
    ("{ cores = 8 }; { load > 0.5 }", POINT, True),
    ("{ cores = 8 }; { load > 0.9 };", POINT, False),
    ("{}", POINT, True),
    ("; { up = true }", POINT, False),
    # precedence, parentheses, spellings
    ("{ cores = 8 and zone = 'eu' or up = true }", POINT, True),
    ("{ cores = 8 && (zone = 'eu' || up = true) }", POINT, False),
    ("{ UP = true OR host MATCH ['web'] }", POINT, True),
    ("{ (up = true) }", POINT, False),
    # arithmetic, functions and dotted names are read, and hold for nothing
    ("{ cores + 1 = 17 }", POINT, False),
    ("{ 2 * (3 - 1) ^ 2 = 8 }", POINT, False),
    ("{ cores % 5 = 1 }", POINT, False),
    ("{ size(host, unit='b').round([1, 2]) > 0 }", POINT, False),
    ("{ disk.free = 3 }", {"disk.free": 3}, False),
    ("{ `disk.free` = 3 }", {"disk.free": 3}, True),
    ("{ identifier('host') = 'web-7' }", POINT, True),
    # literals
    ("{ cores = 0x10, cores = 020, cores != -16 } # note", POINT, True),
    ("{ load < inf, load > -1.5e3 }", POINT, True),
    ("{ quote = 'it\\'s', quote = \"it's\" }", {"quote": "it's"}, True),
]
KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string"}


@pytest.mark.filterwarnings("ignore")
def test_truth_table_wide_and_mapped(spark):
    one = spark.range(1)
    flags = []
    for i, (text, values, _) in enumerate(CASES):
        typed = one.select(*(F.lit(v).cast(KINDS[type(v)]).alias(k) for k, v in values.items()))
        flags.append(typed.select(F.lit(i).alias("i"), F.lit("wide").alias("mode"), C.parse(text).matches(C.wide(typed.schema)).alias("ok")))
        entries = [x for k, v in values.items() for x in (F.lit(k), field_value(F.lit(v).cast(KINDS[type(v)]), KINDS[type(v)]))]
        mapped = one.select(F.create_map(*entries).alias("fields"), F.expr("cast(map() as map<string,string>)").alias("tags"))
        flags.append(mapped.select(F.lit(i).alias("i"), F.lit("map").alias("mode"), C.parse(text).matches(C.mapped()).alias("ok")))
    for at in range(0, len(flags), 24):
        union = flags[at]
        for f in flags[at + 1 : at + 24]:
            union = union.union(f)
        for row in union.collect():
            assert row.ok is CASES[row.i][2], (CASES[row.i], row.mode)


def test_groups_give_the_first_that_holds(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "a bigint")
    index = C.parse("{a > 8}; {a > 4};; {a = 100}").index(C.wide(df.schema))
    assert [r[0] for r in df.select(index).collect()] == [-1, 1, 0]


@pytest.mark.parametrize("text", ["{a = }", "{a / 0 > 1}", "{a > 1", "{a = re('(')}", "a > 1", "{a = 'x\\q'}"])
def test_bad_texts_are_rejected(text):
    with pytest.warns() if "re(" in text else _nothing():
        with pytest.raises(C.ConditionError):
            C.parse(text)


class _nothing:
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_precedence():
    assert C.parse("{a = 1 or b = 2 and c = 3}").groups[0][0].op == "or"


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id as a", "id * 2 as b").write.parquet(str(tmp_path / "t"))
    plan = C.where(spark.read.parquet(str(tmp_path / "t")), "{a > 3}")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,3)" in plan
