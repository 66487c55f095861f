import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volpanel.functions import mathx, ssvi
from volpanel.functions.black import with_black_price
from volpanel.functions.student import student_t_two_sided
from volpanel.operators import surface

KEY = ("option_root", "quote_date")


def latent_frame(spark, rows):
    data = [(f"r{i}", "2020-01-02", *[float(v) for v in row]) for i, row in enumerate(rows)]
    schema = "option_root string, quote_date string, " + ", ".join(f"{c} double" for c in ssvi.LATENT_COLUMNS)
    return spark.createDataFrame(data, schema)


def latent(low, high, rho, eta, lam):
    return [*np.log(np.linspace(low, high, 11)), rho, eta, lam]


def test_normal_cdf_matches_erfc(spark):
    xs = [-40.0, -9.0, -7.2, -7.0, -3.3, -1.0, -1e-9, 0.0, 0.4, 2.5, 7.05, 7.1, 12.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", mathx.normal_cdf(F.col("x")).alias("p")).collect()
    for row in rows:
        assert row.p == pytest.approx(0.5 * math.erfc(-row.x / math.sqrt(2)), abs=5e-16, rel=1e-12)


def test_student_tail_known_values(spark):
    cases = [(-7.148256223078783, 7.0, 0.00018564281821276118), (0.0, 5.0, 1.0), (1.0, 1.0, 0.5)]
    rows = spark.createDataFrame(cases, "t double, df double, p double").withColumn("q", student_t_two_sided(F.col("t"), F.col("df")))
    for row in rows.collect():
        assert row.q == pytest.approx(row.p, rel=1e-10)


def test_parameter_maps_round_trip(spark):
    states = ssvi.with_constrained(latent_frame(spark, [latent(0.02, 0.04, -0.25, -0.9, 0.3)]))
    again = ssvi.with_constrained(ssvi.with_latent(states.select(*KEY, *ssvi.PARAMETER_COLUMNS)).select(*KEY, *ssvi.LATENT_COLUMNS))
    a, b = states.select(*ssvi.PARAMETER_COLUMNS).first(), again.select(*ssvi.PARAMETER_COLUMNS).first()
    assert np.allclose(a, b)


def test_extreme_latent_state_is_admissible(spark):
    raw = [5.0, -3.0, 2.0, -4.0, 1.0, 0.5, -1.5, -2.0, 0.1, 0.2, -0.7, 4.0, 5.0, -5.0]
    states = ssvi.with_constrained(latent_frame(spark, [raw]))
    assert states.select(ssvi.parameters_valid().alias("ok")).first().ok
    grid = surface.on_grid(states, [0.0, 0.1, -0.1], [30 / 365, 91 / 365, 1.0])
    assert ssvi.with_implied_vol(grid).where("NOT predicted_iv > 0").count() == 0


def test_theta_curve_is_linear_interpolation(spark):
    states = ssvi.with_constrained(latent_frame(spark, [latent(0.02, 0.05, -0.3, -1.0, 0.1)]))
    thetas = states.select(*ssvi.THETA_COLUMNS).first()
    taus = [0.001, 10 / 365, 0.05, 0.3, 1.0, 1.7, 2.0, 5.0]
    rows = states.select(F.explode(surface.literal_array(taus)).alias("tau"), *ssvi.THETA_COLUMNS)
    for row in rows.select("tau", ssvi.theta_curve("tau").alias("theta")).collect():
        assert row.theta == pytest.approx(np.interp(row.tau, ssvi.KNOT_TAUS, thetas), rel=1e-12)


def test_certificate_of_a_clean_surface(spark):
    states = ssvi.with_constrained(latent_frame(spark, [latent(0.02, 0.05, -0.35, -1.0, 0.1)]))
    row = surface.certify(states).first()
    assert row.passes_static_arb and row.calendar_violation_count == 0 and row.butterfly_violation_count == 0
    assert surface.require_certified(surface.certify(states)).count() == 1


def test_certificate_matches_dense_numpy_grid(spark):
    states = ssvi.with_constrained(latent_frame(spark, [latent(0.02, 0.05, -0.35, -1.0, 0.1)]))
    broken = states.withColumn("eta", F.lit(9.0)).withColumn("theta_d730", F.col("theta_d010"))
    params = broken.select(*ssvi.PARAMETER_COLUMNS).first()
    theta_knots, (rho, eta, lam) = np.array(params[:11]), params[11:]
    m = np.array(surface.certification_moneyness())[None, :]
    tau = np.array(surface.certification_taus())[:, None]
    theta = np.interp(tau, ssvi.KNOT_TAUS, theta_knots)
    phi = eta * theta**-lam
    root = np.sqrt((phi * m + rho) ** 2 + 1 - rho**2)
    w = 0.5 * theta * (1 + rho * phi * m + root)
    w1, w2 = 0.5 * theta * phi * (rho + (phi * m + rho) / root), 0.5 * theta * phi**2 * (1 - rho**2) / root**3
    g = (1 - m * w1 / (2 * w)) ** 2 - 0.25 * w1**2 * (1 / w + 0.25) + 0.5 * w2
    steps = np.diff(w, axis=0)
    row = surface.certify(broken).first()
    assert row.calendar_violation_count == int((steps < -1e-8).sum()) > 0
    assert row.butterfly_violation_count == int((g < -1e-8).sum()) > 0
    assert row.max_negative_calendar_residual == pytest.approx(steps.min(), rel=1e-9)
    assert row.max_negative_butterfly_residual == pytest.approx(g.min(), rel=1e-9)
    with pytest.raises(Exception, match="certification failed"):
        surface.require_certified(surface.certify(broken)).collect()


def test_black_price_put_call_parity(spark):
    rows = [(100.0, k, 0.5, 0.2, 0.99, side) for k in (80.0, 100.0, 130.0) for side in ("C", "P")]
    frame = spark.createDataFrame(rows, "forward_price double, strike double, tau double, iv double, discount_factor double, option_type string")
    prices = {(r.strike, r.option_type): r.price for r in with_black_price(frame, "iv", "price").collect()}
    for k in (80.0, 100.0, 130.0):
        assert prices[k, "C"] - prices[k, "P"] == pytest.approx(0.99 * (100.0 - k), abs=1e-10)
