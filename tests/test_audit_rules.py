"""Audit rules put together, and the shapes of images as text and kind."""

import pytest
from pyspark.sql import functions as F

from replistat.operators.rollup import audit_passed, preflight_rules
from replistat.sources.files import shape_kind, shape_text


def test_fatal_rules_fail_an_audit_and_warnings_do_not(spark):
    def rule(n, sample):
        return spark.createDataFrame([(n, sample)], "n int, sample string")

    def verdict(*rules):
        rows = preflight_rules(rules)
        assert rows.columns == ["rule", "severity", "n", "sample"] and rows.count() == len(rules)
        return tuple(audit_passed(rows).first())

    assert verdict(("names", "fatal", rule(0, None)), ("pairs", "warning", rule(3, "a;b"))) == (0, 1, True)
    assert verdict(("names", "fatal", rule(2, "x")), ("scale", "fatal", rule(1, "y")), ("pairs", "warning", rule(0, None))) == (2, 0, False)
    assert verdict(("names", "fatal", rule(None, None))) == (0, 0, True)


@pytest.mark.parametrize("shape, text, kind", [
    ([512, 640], "512x640", "2D"), ([512, 640, 3], "512x640x3", "RGB"), ([512, 640, 4], "512x640x4", "RGB"),
    ([1, 512, 640], "1x512x640", "2D"), ([1, 1, 512, 640], "1x1x512x640", "2D"), ([30, 512, 640], "30x512x640", "3D"), ([2, 30, 512, 640], "2x30x512x640", "3D"),
])
def test_shapes(spark, shape, text, kind):
    df = spark.createDataFrame([(shape,)], "shape array<int>")
    assert tuple(df.select(shape_text("shape"), shape_kind(F.col("shape"))).first()) == (text, kind)
