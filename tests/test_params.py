"""Parameter sets: values given over defaults, and their domains."""

import pytest

from cohortsmith import constants as K
from cohortsmith.params import CohortParams, EvalParams, GuardrailParams, checked, merged


def test_given_values_replace_defaults_and_none_keeps_them():
    base = CohortParams(seed=7)
    got = merged(base, seed=None, batch_size=50)
    assert (got.seed, got.batch_size, got.max_age) == (7, 50, K.MAX_AGE)
    assert base.batch_size == 1000


def test_a_rate_table_is_merged_by_entry():
    one = next(iter(K.CONDITION_RATES))
    got = merged(CohortParams(), condition_rates={one: 0.5})
    assert got.condition_rates == {**K.CONDITION_RATES, one: 0.5}
    assert CohortParams().condition_rates == K.CONDITION_RATES


@pytest.mark.parametrize("params, given", [
    (CohortParams(), {"female_probability": 1.5}), (CohortParams(), {"batch_size": 0}),
    (CohortParams(), {"min_age": 90, "max_age": 20}), (CohortParams(), {"hash": "crc32"}),
    (CohortParams(), {"condition_rates": {"x": -0.1}}), (CohortParams(), {"colour": 1}),
    (GuardrailParams(), {"scope": "table"}), (GuardrailParams(), {"distribution_tolerance": -1.0}),
    (EvalParams(), {"rank_bucket_width": 0}),
])
def test_values_outside_their_domain(params, given):
    with pytest.raises(ValueError):
        merged(params, **given)


def test_defaults_are_in_their_domain():
    for params in (CohortParams(), GuardrailParams(), EvalParams()):
        assert checked(params) is params
