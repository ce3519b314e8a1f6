import math

import pytest

from cohortkit.functions.special import betainc, chi2_sf, f_sf, fisher_two_sided, gammaincc, t_two_sided


@pytest.mark.parametrize("t", [0.1, 1.0, 2.5, 10.0])
def test_t_closed_forms(t):
    assert t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
    assert t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)


@pytest.mark.parametrize("x", [0.01, 1.0, 3.0, 20.0, 80.0])
def test_chi2_dof2_closed_form(x):
    assert chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)


def test_chi2_dof1_is_normal_tail():
    for x in (0.5, 3.1172, 9.0):
        assert chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)


def test_chi2_dof0_is_one():
    assert chi2_sf(0.0, 0) == 1.0


def test_f_with_one_numerator_dof_equals_t_squared():
    for t, d in ((2.0, 10), (0.7, 3), (5.0, 100)):
        assert f_sf(t * t, 1, d) == pytest.approx(t_two_sided(t, d), rel=1e-10)


def test_fisher_known_tables():
    assert fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70, rel=1e-12)
    assert fisher_two_sided(1, 9, 11, 3) == pytest.approx(0.0027594561852200836, rel=1e-9)
    assert fisher_two_sided(5, 0, 0, 5) == pytest.approx(2 / 252, rel=1e-12)
    assert fisher_two_sided(2, 2, 2, 2) == 1.0


def test_welch_golden_from_fixtures():
    # lineitem sf0.01 l_quantity by status: t and dof measured in both engines
    assert t_two_sided(1.1067446198, 59995.7512252) == pytest.approx(0.2684087954, abs=1e-9)


def test_incomplete_functions_edges():
    assert betainc(2.0, 3.0, 0.0) == 0.0 and betainc(2.0, 3.0, 1.0) == 1.0
    assert gammaincc(3.0, 0.0) == 1.0
    assert math.isnan(t_two_sided(float("nan"), 3))
