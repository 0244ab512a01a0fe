"""House style against hand-made results."""

import pytest
from pyspark.sql import functions as F

from storyflow.operators import editing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given,want",
    [
        ("Officers attended and officers found a number of items .", "Police attended and Police found several items."),
        ("It has been confirmed that the the work commenced,then ended", "the work began, then ended"),
        ("SUBSEQUENTLY he left", "LATER he left"),
        ("She said “at this stage  we commenced” at this stage", "She said“at this stage we commenced”currently"),
        ("", ""),
        (None, ""),
    ],
)
def test_house_style(spark, given, want):
    assert one(spark, editing.house_style(F.lit(given).cast("string"))) == want


def test_repeats(spark):
    assert one(spark, editing.without_repeats(F.lit("A b. C d! a, b. E"))) == "A b. C d! E"
    assert one(spark, editing.without_repeats(F.lit("Only one"))) == "Only one"


def test_merging_is_pairwise(spark):
    ps = ["a" * 100, "b" * 100, "c" * 100, "“q”", "d", "e" * 181, "f"]
    got = one(spark, editing.merged(F.array(*map(F.lit, ps))))
    assert got == ["a" * 100 + " " + "b" * 100, "c" * 100, "“q”", "d", "e" * 181, "f"]
    assert one(spark, editing.merged(F.array().cast("array<string>"))) == []
