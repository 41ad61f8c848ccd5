import pytest

from tracemill.cli import Condition, Shell, with_arguments
from tracemill.plans.parser import QueryError
from tracemill.session import Session


def test_arguments():
    assert with_arguments("a $1 ${2:-x} $@", ["p"]) == "a p x p"
    with pytest.raises(QueryError, match="need it"):
        with_arguments("${1:?need it}", [])


def test_conditions():
    v = {"n": 5, "s": "ab", "e": ""}
    for text, want in (("n > 3 && s == 'ab'", True), ("!(n + 1 >= 7) || false", True), ("exists(q)", False), ("empty(e) && exists(e)", True), ("n * 2 == 10", True), ("s != 'ab'", False)):
        assert bool(Condition(text, v).value()) is want, text


def test_script(spark):
    s = Session(spark).add_events("x", spark.createDataFrame([(1,), (2,), (3,)], "v int"))
    out = Shell(s).script("set n = events/x | count()\nset name = hello\necho ${name} $1 ${n[0].count}\nif exists(n)\nshow events/x | sum(v)\nelse\necho no\nendif\nif name == 'bye'\necho bye\nelif name == 'hello'\necho hi\nendif\ntypes", ["arg"])
    assert out[0] == "hello arg 3" and "6.0" in out[1] and out[2:] == ["hi", "x"]
