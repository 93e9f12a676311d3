"""The scalar rules on literals with known values."""

import pytest

from docstrata.functions import text as fn
from docstrata.plans.dialect import Spark


def value(spark, text, expression):
    d = Spark("")
    row = spark.createDataFrame([(text,)], "t string").selectExpr("t", f"{fn.dotted_number(d, 't')} AS num")
    row = row.selectExpr("*", f"{fn.hierarchical_level(d, 't')} AS hier")
    return row.selectExpr(f"{expression(d)} AS v").first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("6.3 Title", 2), ("10.0.0.1 gateway", None), ("1.2.3 版本说明", None), ("1.2 text。", None), ("100.1 x", None), ("1.2.3.4 Title", 4)],
)
def test_hierarchical_level(spark, text, want):
    assert value(spark, text, lambda d: "hier") == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("a) x", "letter"), ("1) x", "decimal"), ("• x", "bullet2"), ("—— x", "dash"), ("6.3 x", None), ("6. x", "decimal")],
)
def test_list_kind(spark, text, want):
    assert value(spark, text, lambda d: fn.list_kind(d, "t")) == want


def test_strip_list_marker_takes_every_marker_and_the_page_number(spark):
    assert value(spark, "a) 1) table 5", lambda d: fn.strip_list(d, "t")) == "table"


@pytest.mark.parametrize(("text", "want"), [("注1：x", "numbered_note"), ("备注：x", "note"), ("x", None)])
def test_note_role(spark, text, want):
    assert value(spark, text, lambda d: fn.note_role(d, "t")) == want
