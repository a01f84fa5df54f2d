"""Deprecated names."""

import pickle
import warnings

import pytest

import derivia as dv
from derivia.plans.deprecation import deprecated


@deprecated("0.2", "1.0", "new()")
def old(x):
    """Doubles."""
    return 2 * x


@deprecated("0.1", "0.9")
def older(x):
    return old(x)


def test_warns_at_the_callers_line_and_calls():
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert [older(x) for x in (3,)] == [6]
    assert [w.category for w in caught] == [dv.DeriviaDeprecationWarning] * 2
    assert {w.filename for w in caught} == {__file__}
    assert [(w.message.since, w.message.expected_removal) for w in caught] == [("0.1", "0.9"), ("0.2", "1.0")]
    assert str(caught[1].message).endswith("use new()") and "use" not in str(caught[0].message)


def test_names_and_pickles():
    assert old.__name__ == "old" and old.__doc__ == "Doubles."
    again = pickle.loads(pickle.dumps(dv.DeriviaDeprecationWarning("gone", "0.4", "1.0")))
    assert (str(again), again.since, again.expected_removal) == ("gone", "0.4", "1.0")
    with pytest.warns(DeprecationWarning):
        old(1)
