import pytest

from eventloom.functions.formula import FormulaError, calls, parse, result_type


@pytest.mark.parametrize(("text", "kind"), [("duration()", "time"), ('contains("a")', "percent"), ('count("a") + 1', "count"), ('duration() > 2', "percent"), ('time_between("a", "b") where contains("c")', "time")])
def test_types(text, kind):
    assert result_type(parse(text)) == kind


@pytest.mark.parametrize("text", ["", "1 +", '"a"', "1 = 2", "1 < 2 < 3", "foo()", "duration(1)", 'count("a', "1.2.3", "count(1)", "1 2", "(1"])
def test_errors(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_calls():
    assert calls(parse('attr("x") == "y" and count("a") > 0')) == {("attr", "x"), ("count", "a")}
