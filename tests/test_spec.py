import pytest

from ebbtide.plans import catalog
from ebbtide.plans.spec import Fn, Horizon, clamp_horizon, column_name, expand, feature_columns, horizons, line, unique


def n_columns(lines):
    return sum(len(l.lengths) * len([f for f in l.functions if f is not Fn.ISNULL]) for l in lines)


def test_expand_groups_by_length_and_mode():
    lines = [line("rn", Fn.SUM, [1, 2]), line("markup", Fn.AVG, [2]), line("markup", Fn.AVG, [2], "only")]
    grouped = expand(lines)
    assert list(grouped) == [(1, "agg"), (2, "agg"), (2, "only")]
    assert [item.metric for item in grouped[(2, "agg")]] == ["RN", "MARKUP"]


def test_generated_names():
    assert column_name("RN", Fn.SUM, 13, "agg") == "FF_RN_SUM_L13S"
    assert column_name("markup", Fn.AVG, 2, "only") == "FF_MARKUP_MEAN_L2SO"
    assert column_name("RN", Fn.SUM, 12, "agg", "M", "") == "RN_SUM_L12M"


def test_catalogue_sizes():
    assert n_columns(catalog.client_lines(extra=["brand_a", "brand_b"])) == 510
    assert n_columns(catalog.hotel_lines()) == 142
    assert n_columns(catalog.month_lines(extra=["brand_a", "brand_b"])) == 308
    for lines in (catalog.client_lines(), catalog.hotel_lines(), catalog.month_lines()):
        names = [
            column_name(l.metric, f, n, l.mode) for l in lines for n in l.lengths for f in l.functions if f is not Fn.ISNULL
        ]
        assert len(names) == len(set(names))


def test_model_features_come_from_the_client_catalogue():
    names = {
        column_name(l.metric, f, n, l.mode)
        for l in catalog.client_lines() for n in l.lengths for f in l.functions
    }
    assert set(catalog.CLIENT_MODEL_FEATURES) <= names


def test_horizon_grid():
    grid = horizons()
    assert len(grid) == 16 and grid[0] == Horizon(4, 4) and grid[-1] == Horizon(1, 1)
    assert (Horizon(1, 4).first_slot, Horizon(1, 4).last_slot) == (6, 3)
    assert (Horizon(4, 1).first_slot, Horizon(4, 1).last_slot) == (0, 0)


def test_parameters_out_of_range_fall_back_to_one():
    assert clamp_horizon(0, 5) == Horizon(1, 1)
    assert clamp_horizon(3, 4) == Horizon(3, 4)


def test_bad_mode_is_refused():
    with pytest.raises(ValueError):
        line("rn", Fn.SUM, [1], "some")


def test_name_helpers():
    assert feature_columns(["PK", "FF_A", "CHURN"]) == ["FF_A"]
    assert unique(["b", "a", "b"]) == ["b", "a"]
