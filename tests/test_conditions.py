import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.functions.conditions import holds, minimize


@pytest.mark.parametrize(
    ("text", "short"),
    [
        ("(B > 1 && B > 2) || B <= 0", "B <= 0 || B > 2"),
        ("A == v || (A == v && B > 1)", "A == v"),
        ("P == true || P == false", "true"),
        ("(Q == a && X <= 5) || (Q == a && X > 5 && X <= 10)", "Q == a && X <= 10"),
        ("X > 3 && X <= 3", "false"),
        ("x < 5 || x >= 5", "true"),
        ("nonsense(", "nonsense("),
        ("x < 2.5", "x < 2.5"),
        ("", ""),
        ("false || A == v", "A == v"),
    ],
)
def test_short_forms(text, short):
    assert minimize(text) == short


LITERAL = st.one_of(
    st.builds("n {} {}".format, st.sampled_from(["<=", ">", "<", ">="]), st.integers(-1, 3)),
    st.builds("a {} {}".format, st.sampled_from(["==", "!="]), st.sampled_from("xyz")),
    st.builds("b {} {}".format, st.sampled_from(["==", "!="]), st.sampled_from(["true", "false"])),
)
TEXT = st.lists(st.lists(LITERAL, min_size=1, max_size=4).map(lambda c: f"({' && '.join(c)})"), min_size=1, max_size=5).map(" || ".join)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_same_meaning(text):
    short = minimize(text)
    assert minimize(short) == short
    for n, a, b in itertools.product(range(-3, 6), "xyzw", (True, False)):
        values = {"n": n, "a": a, "b": b}
        assert holds(text, values) == holds(short, values)


def test_a_missing_value_meets_nothing():
    assert not holds("a != x", {}) and holds("true", {})
