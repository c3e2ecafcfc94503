import pytest
from graphloom.functions.predicates import And, Call, Equals, Field, Literal, Name, Not, NodeTarget, EdgeTarget, Options, Or, PredicateError, always, parse, to_column


@pytest.mark.parametrize(
    "text, body",
    [
        ("1 = 1", Equals(Literal(1), Literal(1))),
        ("not a = b", Not(Equals(Name("a"), Name("b")))),
        ("not a and b", And(Not(Name("a")), Name("b"))),
        ("a and b or c and d", Or(And(Name("a"), Name("b")), And(Name("c"), Name("d")))),
        ("a or b or c", Or(Or(Name("a"), Name("b")), Name("c"))),
        ("a != -3", Not(Equals(Name("a"), Literal(-3)))),
        ("a = b = c", Equals(Name("a"), Equals(Name("b"), Name("c")))),
        ("(a or b) and c", And(Or(Name("a"), Name("b")), Name("c"))),
        ("f(x, 'y').z = \"q\"", Equals(Field(Call(Name("f"), (Name("x"), Literal("y"))), "z"), Literal("q"))),
        ("order and notify or android", Or(And(Name("order"), Name("notify")), Name("android"))),
    ],
)
def test_parse(text, body):
    assert parse(text).body == body
    assert parse(str(parse(text))) == parse(text)


def test_options():
    assert parse("*|is('x')").options == Options(kleene=True)
    assert parse("[](?P<n>)|").options == Options(repeated=True, capture="n")
    assert always(parse("?|")) and always(parse("1 = 1")) and not always(parse("1 = 2"))
    for p in ("*[]?(?P<a>)|true", "[](?P<x>)|is('q') and not five = 5"):
        assert parse(str(parse(p))) == parse(p)


@pytest.mark.parametrize("text", ["", "a and", "(a", "a b", "''", "(?Q<x>)|a", "(?P<x>)", "a = ", "§"])
def test_errors(text):
    with pytest.raises(PredicateError):
        parse(text)


def holds(spark, text, edge=False):
    if edge:
        df = spark.sql("SELECT 'EXTRA' AS etype, 'Owes' AS eclass, 'next' AS label")
        return df.select(to_column(text, EdgeTarget())).first()[0]
    df = spark.sql("SELECT array('Invoke', 'calc.Add') AS types, 'A' AS method_class, 'f' AS method_name UNION ALL SELECT array('Add'), NULL, NULL")
    return [r[0] for r in df.select(to_column(text, NodeTarget())).collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("is('Invoke')", [True, False]),
        ("is('calc.Add') or is('Add')", [True, True]),
        ("method().className = 'A' and method().name = 'f'", [True, False]),
        ("not method().className = 'A'", [False, True]),
        ("'foo bar' = 2", [False, False]),
        ("not 'foo bar' = 2", [False, False]),
        ("true or five = 'x'", [False, False]),
        ("five = 5 and not false", [True, True]),
        ("is(5)", [False, False]),
        ("method().nothing = 'x'", [False, False]),
        ("method() = method()", [True, False]),
    ],
)
def test_nodes(spark, text, want):
    assert holds(spark, text) == want


def test_edges(spark):
    assert holds(spark, "is('Owes') and name() = 'next' and not is('DATA')", True)
    assert not holds(spark, "is('CONTROL')", True)


def test_meaningless():
    for text, target in (("five", NodeTarget()), ("unknown = 1", NodeTarget()), ("name() = 'x'", NodeTarget()), ("method().name = 'x'", EdgeTarget()), ("is(name())", EdgeTarget()), ("is('Nope')", NodeTarget(frozenset({"Add"})))):
        with pytest.raises(PredicateError):
            to_column(text, target)
