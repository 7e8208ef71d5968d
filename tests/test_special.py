"""Distribution functions against published table values and identities."""

import math

import pytest

from cohortstats.functions import special as s


@pytest.mark.parametrize(("t", "df", "p"), [(1.0, 1, 0.25), (2.0, 2, 0.0917517095), (2.228138852, 10, 0.025), (1.959963985, 1e9, 0.025)])
def test_t_tail(t, df, p):
    assert s.t_sf(t, df) == pytest.approx(p, rel=1e-7)
    assert s.t_sf(-t, df) == pytest.approx(1 - p, rel=1e-7)
    assert s.t_ppf(1 - p, df) == pytest.approx(t, rel=1e-6)


def test_normal():
    assert s.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert s.norm_ppf(0.525) == pytest.approx(0.06270677794321385, abs=1e-12)
    assert s.norm_cdf(1.0) + s.norm_sf(1.0) == pytest.approx(1, abs=1e-15)
    assert s.norm_ppf(0) == -math.inf and math.isnan(s.norm_ppf(2))


def test_f():
    assert s.f_sf(4.102821, 2, 10) == pytest.approx(0.05, rel=1e-5)
    assert s.f_cdf(4.102821, 2, 10) == pytest.approx(0.95, rel=1e-5)
    # F with one degree is t squared
    assert s.f_sf(2.5**2, 1, 7) == pytest.approx(2 * s.t_sf(2.5, 7), rel=1e-10)


@pytest.mark.parametrize(("q", "k", "df"), [(3.151, 2, 10), (3.877, 3, 10), (3.578, 3, 20), (4.232, 5, 20), (3.314, 3, 1e6)])
def test_studentized_range_at_five_percent(q, k, df):
    assert s.studentized_range_sf(q, k, df) == pytest.approx(0.05, abs=2e-4)


def test_studentized_range_of_two_is_t():
    assert s.studentized_range_sf(math.sqrt(2) * 2.5, 2, 12) == pytest.approx(2 * s.t_sf(2.5, 12), abs=1e-6)


def test_beta_edges():
    assert s.betainc(2, 3, 0) == 0 and s.betainc(2, 3, 1) == 1
    assert s.betainc(2, 3, 0.3) + s.betainc(3, 2, 0.7) == pytest.approx(1, abs=1e-14)
