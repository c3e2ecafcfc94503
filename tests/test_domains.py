import pytest
from graphloom.operators import domains as D
from graphloom.operators.domains import Constraint, Linear, Octagon
from graphloom.operators.polyhedra import Polyhedron
from pyspark.sql import functions as F

INF = float("inf")


def value(spark, c):
    r = spark.range(1).select(c.alias("x")).first().x
    return (r.lo, r.hi) if hasattr(r, "lo") else r


def test_intervals(spark):
    i = D.interval
    assert value(spark, i(5.001, INF)) == value(spark, i(5.4, INF)) == (6, INF)
    assert value(spark, D.join(i(1, 3), i(7, 9))) == (1, 9)
    assert value(spark, D.join(i(3, 1), i(7, 9))) == (7, 9)
    assert value(spark, D.meet(i(1, 8), i(7, 9))) == (7, 8)
    assert value(spark, D.meet(i(1, 3), D.top())) == (1, 3)
    assert value(spark, D.widen(i(0, 3), i(0, 4))) == (0, INF)
    assert value(spark, D.scaled(i(1, 3), -2)) == (-6, -2)
    assert value(spark, D.scaled(D.top(), 0)) == (0, 0)
    assert [value(spark, D.constraint(r, 5.0)) for r in ("<", "<=", ">", ">=", "=")] == [(-INF, 4), (-INF, 5), (6, INF), (5, INF), (5, 5)]
    assert D.constraint("!=", 1) is None
    with pytest.raises(ValueError):
        D.constraint("~", 1)


def test_states(spark):
    s = F.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array(D.interval(0, 10), D.interval(1, 1)))
    get = lambda st, n="x": value(spark, D.bound_of(st, n))
    assert get(D.assume(s, "x", ">", 3)) == (4, 10) and get(D.assume(s, "x", "!=", 0)) == (1, 10)
    assert value(spark, D.assume(s, "x", ">", 10)) is None
    assert get(D.assign(s, "z", {"x": 2, "y": -1}, 5), "z") == (4, 24)
    assert get(D.forget(s, "x")) == (-INF, INF) and value(spark, D.declared(s, "y")) is True
    t = D.put(s, "x", D.interval(20, 30))
    assert get(D.join_states(s, t)) == (0, 30) and value(spark, D.meet_states(s, t)) is None
    assert get(D.widen_states(s, t)) == (0, INF) and get(D.substitute(s, "y", 1), "y") == (-INF, INF)
    assert value(spark, D.is_top(D.forget(s, "x", "y"))) is True
    df = spark.range(3).select(F.when(F.col("id") == 2, F.lit(None)).otherwise(D.put(s, "x", D.interval(F.col("id"), F.col("id") + 1))).alias("s"))
    r = df.agg(D.merge_states(F.col("s")).alias("m")).select(F.col("m")["x"].alias("x")).first().x
    assert (r.lo, r.hi) == (0, 2)


def test_linear():
    a, b = Linear.of(1, x=2, y=1), Linear.of(3, x=-2)
    assert a + b == Linear.of(4, y=1) and -(-a) == a and a * 2 == Linear.of(2, x=4, y=2)
    with pytest.raises(NotImplementedError):
        a * b
    c = Constraint.of(a, "<", b)
    assert c.form == a - b and c.negate().relation == ">=" and c.negate().negate() == c and Constraint.of(a, "==", b).negate().relation == "!="


def test_octagons():
    o = Octagon([]).assume(1, "x", 0, None, 10).assume(-1, "x", 0, None, 0).assume(1, "y", -1, "x", -2)
    assert o.bounds("x") == (0, 10) and o.bounds("y")[1] == 8
    assert o.assume(-1, "y", 0, None, -9).bottom and not o.bottom
    assert o.assign("x", "x", 3).bounds("x") == (3, 13) and o.assign("z", "x", 1).bounds("z") == (1, 11)
    p = Octagon([]).assign("x", None, 20)
    assert o.join(p).bounds("x") == (0, 20) and o.meet(p).bottom and o.forget("x").bounds("x") == (-INF, INF)
    assert Octagon([]).assume(-1, "f", 0, None, -5.001) == Octagon([]).assume(-1, "f", 0, None, -5.4)
    assert o.widen(o.join(p)).bounds("x") == (0, INF)
    assert o == o.closed() and o != p


def test_forms_over_tables(spark):
    n = lambda x: str(x)
    a, b = D.form({"x": 2, "y": -1}, 3), D.form({"y": 1, "z": 0.5}, -1)
    assert value(spark, D.form_text(D.form_plus(a, b))) == "2*x + 0.5*z + 2"
    assert value(spark, D.form_text(D.form_times(D.form({}, -2), a))) == "-4*x + 2*y + -6"
    c = D.constraint_of(a, F.lit("<="), b)
    assert value(spark, D.constraint_text(c)) == "2*x + -2*y + -0.5*z + 4 <= 0" and value(spark, D.constraint_text(D.constraint_negated(c))).endswith(" > 0")
    for bad in (D.form_times(a, b), D.constraint_of(a, F.lit("~"), b)):
        with pytest.raises(Exception, match="linear|relation"):
            value(spark, F.to_json(bad))
    rows = spark.range(3).select((F.col("id") % 2).alias("k"), D.form({"x": F.col("id"), "y": 1}, 1).alias("f"))
    got = {r.k: n(r.t) for r in D.sum_forms(rows, ["k"], "f").select("k", D.form_text(F.col("f")).alias("t")).collect()}
    assert got == {0: "2*x + 2*y + 2", 1: "1*x + 1*y + 1"}


def test_merge_by(spark):
    s = lambda **b: F.map_from_arrays(F.array(*map(F.lit, b)), F.array(*(D.interval(*x) for x in b.values())))
    k = F.col("id")
    rows = spark.range(6).select((k % 3).alias("g"), F.when(k == 0, s(x=(0, 1), y=(2, 2))).when(k == 3, s(x=(5, 7))).when(k == 1, s(x=(1, 1))).when(k.isin(2, 5), F.lit(None)).alias("s"))
    got = {r.g: r.s for r in D.merge_by(rows, ["g"], "s").collect()}
    pairs = lambda m: {v: (i.lo, i.hi) for v, i in m.items()}
    assert pairs(got[0]) == {"x": (0, 7), "y": (-INF, INF)} and pairs(got[1]) == {"x": (1, 1)} and got[2] is None


def test_substitute(spark):
    s = F.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array(D.interval(0, 10), D.interval(4, 9)))
    get = lambda st, n: value(spark, D.bound_of(st, n))
    before = D.substitute(s, "y", {"x": 2}, 1)
    assert get(before, "x") == (2, 4) and get(before, "y") == (-INF, INF)
    assert get(D.substitute(s, "x", {"x": 1}, 5), "x") == (-5, 5) and value(spark, D.substitute(s, "y", {"x": 1}, 100)) is None


def test_octagons_over_tables(spark):
    rows = [(1, 1, "x", 0, None, 5.0), (1, -1, "x", 0, None, 0.0), (1, 1, "y", -1, "x", 2.5), (2, 1, "x", 0, None, 1.0), (2, -1, "x", 0, None, -2.0)]
    df = spark.createDataFrame(rows, "g long, a int, x string, b int, y string, c double")
    assert sorted(map(tuple, D.octagon_bounds(df, ["g"]).collect())) == [(1, "x", 0.0, 5.0), (1, "y", -INF, 7.0)]


def test_polyhedra():
    """Against the points of a grid: what they satisfy, hulls that hold both, bounds, entailment, assignments both ways."""
    import itertools
    import random

    rnd, grid = random.Random(4), list(itertools.product(range(-4, 5), repeat=2))

    def random_one():
        p = Polyhedron().assume(Linear.of(x=1), "<=", 4).assume(Linear.of(x=1), ">=", -4).assume(Linear.of(y=1), "<=", 4).assume(Linear.of(y=1), ">=", -4)
        made = [(rnd.randint(-2, 2), rnd.randint(-2, 2), rnd.choice(["<=", "<", ">=", ">", "="] if rnd.random() < 0.2 else ["<=", ">="]), rnd.randint(-5, 5)) for _ in range(rnd.randrange(4))]
        for a, b, rel, c in made:
            p = p.assume(Linear.of(x=a, y=b), rel, c)
        holds = {"<=": lambda v, c: v <= c, "<": lambda v, c: v < c, ">=": lambda v, c: v >= c, ">": lambda v, c: v > c, "=": lambda v, c: v == c}
        return p, {(x, y) for x, y in grid if all(holds[rel](a * x + b * y, c) for a, b, rel, c in made)}

    has = lambda p, x, y: all(sum({"x": x, "y": y}[n] * k for n, k in t) <= b for t, b in p.rows)
    for _ in range(25):
        (p, points), (q, others) = random_one(), random_one()
        assert points == {g for g in grid if has(p, *g)} and not (points and p.bottom)
        hull = p.join(q)
        assert all(has(hull, *g) for g in points | others) and (p.bottom or hull.entails(hull.join(p)))
        assert {g for g in grid if has(p.meet(q), *g)} == points & others
        if points:
            low, high = p.bounds("x")
            assert low <= min(x for x, _ in points) and high >= max(x for x, _ in points)
            assert p.entails(p.widen(hull)) and hull.entails(p.widen(hull))
        after = p.assign("x", Linear.of(1, x=1, y=1))
        assert all(has(after, x + y + 1, y) for x, y in points)
        before = p.substitute("x", Linear.of(1, x=1, y=1))
        assert {g for g in grid if has(before, *g)} == {(x, y) for x, y in grid if has(p, x + y + 1, y)}
    one, two = (Polyhedron().assume(Linear.of(x=1), "=", k).assume(Linear.of(y=1), "=", 2 * k) for k in (0, 3))
    line = one.join(two)
    assert line.bounds("y") == (0, 6) and line.entails(Polyhedron().assume(Linear.of(y=1, x=-2), "=", 0)) and line.forget("x").names == {"y"}
    assert Polyhedron().assume(Linear.of(x=1), ">=", 5.001).same(Polyhedron().assume(Linear.of(x=1), ">=", 5.4)) and Polyhedron().top
    assert one.assume(Linear.of(x=1), "!=", 0).bottom and not line.assume(Linear.of(x=1), "!=", 0).bottom


def test_null_bounds_are_infinite(spark):
    rows = spark.sql("SELECT * FROM VALUES (1D, NULL), (NULL, 2D), (NULL, NULL) AS t(a, b)")
    got = rows.select(D.interval(F.col("a"), F.col("b")).alias("i"), D.is_top(F.create_map(F.lit("x"), D.interval(F.col("a"), F.col("b")))).alias("top")).collect()
    inf = float("inf")
    assert [(tuple(r.i), r.top) for r in got] == [((1, inf), False), ((-inf, 2), False), ((-inf, inf), True)]
