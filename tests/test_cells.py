import pytest
from pyspark.sql import functions as F

from glyphmill.functions import cells as c


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("cell,want", [
    (None, []), ("WT", []), ("  ", []), ("wt", []), ("p.V600E; V600E", ["V600E"]), ("R132H R132H", ["R132H"]),
    ("Q10fs|R100*,A1B", ["Q10FS", "R100*", "A1B"]), ("\tA1B\n", ["A1B"]),
])
def test_normalise_cell(spark, cell, want):
    assert one(spark, cell, c.normalise_cell) == want


def test_other_splitters(spark):
    assert one(spark, "A1B a1b A1B", c.split_whitespace) == ["A1B", "a1b", "A1B"]
    assert one(spark, "A1BC2D", c.split_grammar) == ["A1B", "C2D"]
    assert one(spark, "A1B / C2D ;A1B", c.split_grammar) == ["A1B", "C2D"]
    assert one(spark, "A1Bxx", c.split_grammar) == ["A1Bxx"]
    assert one(spark, "nan", c.single_event) is None
    assert one(spark, " v600e ", c.single_event) == "V600E"


@pytest.mark.parametrize("event,dialect,want", [
    ("A-12B", "standard7", "SPLICE"), ("*261*", "standard7", "NONSENSE"), ("*261*", "compact6", "other"),
    ("R100X", "standard7", "NONSENSE"), ("R100X", "standard7_strict_x", "NONSENSE"), ("AX", "standard7", "NONSENSE"),
    ("AX", "standard7_strict_x", "OTHER"), ("AX", "detail9", "NONSENSE"), ("Q10FS", "compact6", "missense"),
    ("Q10fs", "compact6", "frameshift"), ("A5A", "standard7", "SYNONYMOUS"), ("E5DELINSK", "detail9", "DELINS"),
    ("E5DELINSK", "standard7", "INFRAME_INDEL"), ("1_2AB>C", "compact6", "other"), ("1_2AB>C", "canonical14", "DELINS_COMPLEX"),
    ("START_LOST", "canonical14", "START_LOSS"), ("A5FSINS", "canonical14", "FRAMESHIFT_INS"), ("A5", "canonical14", "OTHER_VALID"),
    ("foo", "canonical14", "UNKNOWN"), ("A5B", "state3", "missense_like"), ("A5*", "state3", "truncating"), ("a5b", "eda7", "Missense_like"),
    ("A5*", "basic5", "nonsense"), ("V600E", "basic5", "missense"),
])
def test_dialects(spark, event, dialect, want):
    assert one(spark, event, c.DIALECTS[dialect]) == want


def test_positions(spark):
    assert one(spark, "A-12B", c.substitution_position) == -12
    assert one(spark, "12_13del", c.first_integer) == 12
    assert one(spark, "A12fs", c.leading_position) == 12
    assert one(spark, "12del", c.leading_position) is None
    row = spark.range(1).select(
        c.position_bin(F.lit(50), "zero").alias("z"), c.position_bin(F.lit(50), "one").alias("o"),
        c.position_bin(F.lit(-3), "label").alias("l"), c.position_range(F.lit(1001)).alias("r"), c.position_range(F.lit(0)).alias("n")).first()
    assert (row.z, row.o, row.l, row.r, row.n) == (1, 0, "1_50", 5, None)
