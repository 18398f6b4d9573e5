"""Property tests: the Spark numerics equal exact JS semantics on random doubles."""

from decimal import ROUND_FLOOR, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from defectlens.functions import fixed2, js_round


def js_to_fixed2(x: float) -> float:
    """Number(x.toFixed(2)) from the spec: n with n/100 - x closest to zero,
    the larger n on a tie, computed on the exact binary value."""
    d = Decimal(x)
    sign = -1 if d < 0 else 1
    a = abs(d) * 100
    lo = a.to_integral_value(rounding=ROUND_FLOOR)
    n = lo + 1 if (a - lo) >= Decimal("0.5") else lo
    return float(sign * n / 100) if n != 0 else 0.0


def js_math_round(x: float) -> int:
    """Math.round: floor(x + 0.5) on the exact value, ties to +inf."""
    return int((Decimal(x) + Decimal("0.5")).to_integral_value(rounding=ROUND_FLOOR))


NUMS = st.one_of(
    st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False),
    st.integers(min_value=-100000, max_value=100000).map(lambda i: i / 1000),   # many decimal ties
    st.integers(min_value=-100000, max_value=100000).map(lambda i: i / 8),      # exact binary ties
)


@settings(max_examples=60, deadline=None)
@given(st.lists(NUMS, min_size=1, max_size=40))
def test_fixed2_and_round_match_js(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = df.select(fixed2("x").alias("f"), js_round("x").alias("r")).collect()
    for x, row in zip(xs, got):
        assert row.f == js_to_fixed2(float(x)), x
        assert row.r == js_math_round(float(x)), x
