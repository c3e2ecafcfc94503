"""Numeric abstract domains over integers.

Intervals are struct<lo, hi> Columns with infinite bounds, states are map<variable, interval> Columns
(a variable without an entry is unbounded, a null state is bottom), so lattice operations run inside
Spark's expressions and merge by its aggregates. Octagons (bounds on +-x +-y) are closed matrices in
numpy, for grouped pandas functions (``octagon_bounds``). Linear forms are exact rationals on the driver
side, and struct<terms, constant> Columns with decimal coefficients over tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
INTERVAL = "struct<lo:double,hi:double>"
STATE = f"map<string,{INTERVAL}>"


# Intervals


def interval(lo: Column | float, hi: Column | float) -> Column:
    """Bounds tightened to integers; a null bound is none, so it is infinite."""
    lo, hi = (F.coalesce(x.cast("double"), F.lit(none)) if isinstance(x, Column) else F.lit(float(x)) for x, none in ((lo, -INF), (hi, INF)))
    tight = lambda c, f: F.when(F.abs(c) == INF, c).otherwise(f(c).cast("double"))
    return F.struct(tight(lo.cast("double"), F.ceil).alias("lo"), tight(hi.cast("double"), F.floor).alias("hi"))


def top() -> Column:
    return F.struct(F.lit(-INF).alias("lo"), F.lit(INF).alias("hi"))


def let(value: Column, use) -> Column:
    """use(value), where ``value`` is one expression, however often it is used."""
    return F.transform(F.array(value), use)[0]


def is_empty(a: Column) -> Column:
    return a["lo"] > a["hi"]


def join(a: Column, b: Column) -> Column:
    """Least interval with both; an empty one adds nothing."""
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi")))


def meet(a: Column, b: Column) -> Column:
    return F.struct(F.greatest(a["lo"], b["lo"]).alias("lo"), F.least(a["hi"], b["hi"]).alias("hi"))


def widen(old: Column, new: Column) -> Column:
    """Bounds of ``old`` that ``new`` leaves become infinite."""
    return F.struct(F.when(new["lo"] < old["lo"], F.lit(-INF)).otherwise(old["lo"]).alias("lo"), F.when(new["hi"] > old["hi"], F.lit(INF)).otherwise(old["hi"]).alias("hi"))


def join_all(a: Column) -> Column:
    """Aggregate: the join of a group's intervals."""
    return F.struct(F.min(a["lo"]).alias("lo"), F.max(a["hi"]).alias("hi"))


def plus(a: Column, b: Column) -> Column:
    return F.struct((a["lo"] + b["lo"]).alias("lo"), (a["hi"] + b["hi"]).alias("hi"))


def scaled(a: Column, k: float) -> Column:
    lo, hi = (a["lo"], a["hi"]) if k >= 0 else (a["hi"], a["lo"])
    part = lambda c: (c * F.lit(float(k))) if k else F.lit(0.0)
    return F.struct(part(lo).alias("lo"), part(hi).alias("hi"))


def constraint(relation: str, value: float) -> Column | None:
    """The interval of ``x relation value`` over integers; None for !=, which no interval is."""
    match relation:
        case "=" | "==":
            return interval(value, value)
        case "<=":
            return interval(-INF, value)
        case "<":
            return interval(-INF, math.ceil(value) - 1)
        case ">=":
            return interval(value, INF)
        case ">":
            return interval(math.floor(value) + 1, INF)
        case "!=":
            return None
    raise ValueError(f"{relation} is no relation")


# States


def bound_of(state: Column, name: str) -> Column:
    return F.coalesce(state[name], top())


def declared(state: Column, name: str) -> Column:
    return F.map_contains_key(state, name)


def put(state: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(state, lambda k, _: k != name), F.map_from_arrays(F.array(F.lit(name)), F.array(value)))


def assign(state: Column, name: str, terms: dict[str, float], constant: float = 0) -> Column:
    """name := constant + sum of factor * variable."""
    return put(state, name, value_of(state, terms, constant))


def value_of(state: Column, terms: dict[str, float], constant: float = 0) -> Column:
    """The interval of constant + sum of factor * variable."""
    value = interval(constant, constant)
    for v, k in terms.items():
        value = plus(value, scaled(bound_of(state, v), k))
    return value


def substitute(state: Column, name: str, value: float | dict[str, float], constant: float = 0) -> Column:
    """Backwards assignment of ``value``, a constant or the terms of a linear form with ``constant``: the states before
    it, null if none leads to ``state``. ``name`` was anything, unless it is in the form itself; every variable of
    the form is held to what makes the form fit the bounds of ``name`` after it."""
    if not isinstance(value, dict):
        value, constant = {}, value
    terms = {v: k for v, k in value.items() if k}
    after = bound_of(state, name)
    before = state if not terms else put(state, name, top()) if name in terms else state
    rest = lambda skip: value_of(before, {v: k for v, k in terms.items() if v != skip}, constant)
    out = put(state, name, top())
    fits = ~is_empty(meet(value_of(before, terms, constant), after))
    for v, k in terms.items():
        room = scaled(F.struct((after["lo"] - rest(v)["hi"]).alias("lo"), (after["hi"] - rest(v)["lo"]).alias("hi")), 1 / k)
        held = meet(bound_of(before, v), interval(room["lo"], room["hi"]))
        fits &= ~is_empty(held)
        out = put(out, v, held)
    return F.when(fits, out)


def assume(state: Column, name: str, relation: str, value: float) -> Column:
    """The state met with a constraint; null (bottom) if nothing is left."""
    c = constraint(relation, value)
    now = bound_of(state, name)
    if c is None:
        lo = F.when(now["lo"] == value, now["lo"] + 1).otherwise(now["lo"])
        hi = F.when(now["hi"] == value, now["hi"] - 1).otherwise(now["hi"])
        left = F.struct(lo.alias("lo"), hi.alias("hi"))
    else:
        left = meet(now, c)
    return F.when(~is_empty(left), put(state, name, left))


def forget(state: Column, *names: str) -> Column:
    return F.map_filter(state, lambda k, _: ~k.isin(*names))


def zip_states(a: Column, b: Column, how) -> Column:
    """Variable by variable; one that a side doesn't declare is unbounded there (both are conformed)."""
    sides = lambda x, y: F.struct(F.coalesce(x, top()).alias("x"), F.coalesce(y, top()).alias("y"))
    return F.map_zip_with(a, b, lambda _, x, y: let(sides(x, y), lambda s: how(s["x"], s["y"])))


def join_states(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(zip_states(a, b, join))


def meet_states(a: Column, b: Column) -> Column:
    out = zip_states(a, b, meet)
    return F.when(~F.exists(F.map_values(out), is_empty), out)


def widen_states(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(zip_states(old, new, widen))


def equal_states(a: Column, b: Column) -> Column:
    """Whether two states allow the same values, undeclared variables being unbounded; bottom equals bottom."""
    same = ~F.exists(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, top()) == F.coalesce(y, top()))), lambda e: ~e)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def merge_by(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """keys, ``state``: the join of each group's states; nulls (bottom) add nothing, a group of nulls only is null.

    Groups of any size: bounds are aggregated variable by variable, and what is gathered is one row a variable.
    """
    name, i, lo, hi, n, states, entries = (f"state {x}" for x in ("variable", "interval", "lo", "hi", "n", "states", "entries"))
    alive = df.groupBy(*keys).agg(F.count(state).alias(states))
    each = df.select(*keys, F.explode(state).alias(name, i)).groupBy(*keys, name).agg(F.min(F.col(i)["lo"]).alias(lo), F.max(F.col(i)["hi"]).alias(hi), F.count("*").alias(n))
    both = F.col(n) == F.col(states)
    value = F.struct(F.when(both, F.col(lo)).otherwise(-INF).alias("lo"), F.when(both, F.col(hi)).otherwise(INF).alias("hi"))
    entry = F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("key"), value.alias("value")))
    joined = alive.join(each, keys, "left").groupBy(*keys, states).agg(F.collect_list(entry).alias(entries))
    return joined.select(*keys, F.when(F.col(states) > 0, F.map_from_entries(entries)).cast(STATE).alias(state))


def merge_states(c: Column) -> Column:
    """Aggregate: the join of a group's states; nulls (bottom) add nothing. It gathers the states, so it is for groups as
    small as a node's predecessors; ``merge_by`` is for groups of any size."""
    states = F.collect_list(c)
    return F.when(F.size(states) > 0, F.aggregate(F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0))), states[0], lambda a, b: zip_states(a, b, join)))


def is_top(state: Column) -> Column:
    return state.isNotNull() & F.coalesce(~F.exists(F.map_values(state), lambda i: (F.coalesce(i["lo"], F.lit(-INF)) > -INF) | (F.coalesce(i["hi"], F.lit(INF)) < INF)), F.lit(False))


# Linear forms as Columns: struct<terms: map<variable, coefficient>, constant>, without terms of 0

NUMBER = "decimal(38,9)"
LINEAR = f"struct<terms:map<string,{NUMBER}>,constant:{NUMBER}>"


def number(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(NUMBER)


def form(terms: dict[str, Column | float], constant: Column | float = 0) -> Column:
    """constant + sum of coefficient * variable."""
    entries = F.map_from_arrays(F.array(*(F.lit(n) for n in terms)), F.array(*(number(k) for k in terms.values()))) if terms else F.create_map()
    return F.struct(F.map_filter(entries.cast(f"map<string,{NUMBER}>"), lambda _, k: k != 0).alias("terms"), number(constant).alias("constant"))


def form_plus(a: Column, b: Column) -> Column:
    terms = F.map_zip_with(a["terms"], b["terms"], lambda _, x, y: number(F.coalesce(x, number(0)) + F.coalesce(y, number(0))))
    return F.struct(F.map_filter(terms, lambda _, k: k != 0).alias("terms"), number(a["constant"] + b["constant"]).alias("constant"))


def form_scaled(a: Column, k: Column | float) -> Column:
    terms = F.transform_values(a["terms"], lambda _, x: number(x * number(k)))
    return F.struct(F.map_filter(terms, lambda _, x: x != 0).alias("terms"), number(a["constant"] * number(k)).alias("constant"))


def form_minus(a: Column, b: Column) -> Column:
    return form_plus(a, form_scaled(b, -1))


def form_times(a: Column, b: Column) -> Column:
    """A product of which one side is a constant; an error in rows where neither is."""
    none = F.raise_error(F.lit("a product of two variables isn't linear")).cast(LINEAR)
    return F.when(F.size(b["terms"]) == 0, form_scaled(a, b["constant"])).when(F.size(a["terms"]) == 0, form_scaled(b, a["constant"])).otherwise(none)


def form_text(a: Column) -> Column:
    """``2*x + -1*y + 3``, variables by name."""
    plain = lambda x: F.regexp_replace(x.cast("string"), r"\.?0+$", "")
    terms = F.transform(F.array_sort(F.map_entries(a["terms"])), lambda t: F.concat(plain(t["value"]), F.lit("*"), t["key"]))
    return F.array_join(F.array_append(terms, plain(a["constant"])), " + ")


def sum_forms(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, ``column``: the sum of each group's forms; coefficients are summed variable by variable."""
    v, k, c, entries = (f"form {x}" for x in ("variable", "coefficient", "constant", "entries"))
    each = df.select(*keys, F.explode(F.map_concat(F.col(column)["terms"], F.map_from_arrays(F.array(F.lit("")), F.array(F.col(column)["constant"])))).alias(v, k))
    total = each.groupBy(*keys, v).agg(number(F.sum(k)).alias(k))
    entry = F.when((F.col(v) != "") & (F.col(k) != 0), F.struct(F.col(v).alias("key"), F.col(k).alias("value")))
    parts = total.groupBy(*keys).agg(F.collect_list(entry).alias(entries), F.max(F.when(F.col(v) == "", F.col(k))).alias(c))
    return parts.select(*keys, F.struct(F.map_from_entries(entries).alias("terms"), F.col(c).alias("constant")).alias(column))


def constraint_of(left: Column, relation: Column, right: Column) -> Column:
    """struct<form, relation>: left - right relation 0; an unknown relation is an error."""
    known = F.when(relation == "==", "=").when(relation.isin(*NEGATED), relation).otherwise(F.raise_error(F.concat(relation, F.lit(" is no relation"))).cast("string"))
    return F.struct(form_minus(left, right).alias("form"), known.alias("relation"))


def constraint_negated(c: Column) -> Column:
    other = F.create_map(*[F.lit(x) for kv in NEGATED.items() for x in kv])[c["relation"]]
    return F.struct(c["form"].alias("form"), other.alias("relation"))


def constraint_text(c: Column) -> Column:
    return F.concat(form_text(c["form"]), F.lit(" "), c["relation"], F.lit(" 0"))


# Linear forms on the driver


@dataclass(frozen=True)
class Linear:
    """constant + sum of coefficient * variable, exact."""

    terms: tuple[tuple[str, Fraction], ...] = ()
    constant: Fraction = Fraction(0)

    @staticmethod
    def of(constant: float | int | Fraction = 0, **terms: float | int | Fraction) -> Linear:
        return Linear(tuple(sorted((n, Fraction(k)) for n, k in terms.items() if k)), Fraction(constant))

    def __add__(self, other: Linear) -> Linear:
        total = dict(self.terms)
        for n, k in other.terms:
            total[n] = total.get(n, Fraction(0)) + k
        return Linear.of(self.constant + other.constant, **total)

    def __neg__(self) -> Linear:
        return Linear.of(-self.constant, **{n: -k for n, k in self.terms})

    def __sub__(self, other: Linear) -> Linear:
        return self + -other

    def __mul__(self, other: Linear | int | Fraction) -> Linear:
        other = other if isinstance(other, Linear) else Linear.of(other)
        if self.terms and other.terms:
            raise NotImplementedError("a product of two variables isn't linear")
        form, k = (other, self.constant) if not self.terms else (self, other.constant)
        return Linear.of(form.constant * k, **{n: c * k for n, c in form.terms})

    def __str__(self) -> str:
        return " + ".join([*(f"{k}*{n}" for n, k in self.terms), str(self.constant)])


NEGATED = {"<": ">=", ">=": "<", ">": "<=", "<=": ">", "=": "!=", "==": "!=", "!=": "="}


@dataclass(frozen=True)
class Constraint:
    """form relation 0."""

    form: Linear
    relation: str

    @staticmethod
    def of(left: Linear, relation: str, right: Linear) -> Constraint:
        if relation not in NEGATED:
            raise ValueError(f"{relation} is no relation")
        return Constraint(left - right, "=" if relation == "==" else relation)

    def negate(self) -> Constraint:
        return Constraint(self.form, NEGATED[self.relation])

    def __str__(self) -> str:
        return f"{self.form} {self.relation} 0"


# Octagons


class Octagon:
    """Integer constraints +-x +-y <= c. m[2i, 2j] bounds x_j - x_i, where 2i is x_i and 2i + 1 is -x_i."""

    def __init__(self, names: list[str], m: np.ndarray | None = None):
        self.names = sorted(names)
        n = 2 * len(self.names)
        self.m = np.full((n, n), INF) if m is None else m.copy()
        np.fill_diagonal(self.m, np.minimum(self.m.diagonal(), 0))

    @property
    def bottom(self) -> bool:
        return bool((self.closed().m.diagonal() < 0).any())

    def conform(self, names: list[str]) -> Octagon:
        """The same constraints over more variables."""
        out = Octagon(sorted({*self.names, *names}))
        at = [2 * out.names.index(n) + s for n in self.names for s in (0, 1)]
        out.m[np.ix_(at, at)] = self.m
        return out

    def closed(self) -> Octagon:
        """Strong closure, tightened to integers."""
        out, n = Octagon(self.names, self.m), len(self.m)
        if not n:
            return out
        bar = np.arange(n) ^ 1
        for _ in range(2):
            for k in range(n):
                out.m = np.minimum(out.m, out.m[:, k, None] + out.m[None, k, :])
            own = out.m[np.arange(n), bar]
            out.m[np.arange(n), bar] = np.where(np.isinf(own), own, 2 * np.floor(own / 2))
            own = out.m[np.arange(n), bar]
            out.m = np.minimum(out.m, (own[:, None] + own[bar][None, :]) / 2)
        return out

    def assume(self, a: int, x: str, b: int, y: str | None, c: float) -> Octagon:
        """a*x + b*y <= c, with a and b 1 or -1; without y, a*x <= c."""
        out = self.conform([x] + ([y] if y else []))
        i = 2 * out.names.index(x)
        p = i if a > 0 else i + 1
        if y is None:
            out.m[p ^ 1, p] = min(out.m[p ^ 1, p], 2 * math.floor(c))
            return out
        j = 2 * out.names.index(y)
        q = j if b > 0 else j + 1
        out.m[q ^ 1, p] = min(out.m[q ^ 1, p], math.floor(c))
        out.m[p ^ 1, q] = min(out.m[p ^ 1, q], math.floor(c))
        return out

    def forget(self, *names: str) -> Octagon:
        out = self.closed()
        for name in names:
            if name in out.names:
                i = 2 * out.names.index(name)
                out.m[[i, i + 1], :], out.m[:, [i, i + 1]] = INF, INF
                out.m[i, i] = out.m[i + 1, i + 1] = 0
        return out

    def assign(self, x: str, y: str | None, c: float) -> Octagon:
        """x := y + c, or x := c."""
        if y == x:
            out = self.conform([x])
            i = 2 * out.names.index(x)
            for s, d in ((0, c), (1, -c)):
                out.m[:, i + s] += d
                out.m[i + s, :] -= d
            return out
        out = self.forget(x)
        if y is None:
            return out.assume(1, x, 0, None, c).assume(-1, x, 0, None, -c)
        return out.assume(1, x, -1, y, c).assume(-1, x, 1, y, -c)

    def join(self, other: Octagon) -> Octagon:
        if self.bottom or other.bottom:
            return other if self.bottom else self
        a, b = self.conform(other.names).closed(), other.conform(self.names).closed()
        return Octagon(a.names, np.maximum(a.m, b.m))

    def meet(self, other: Octagon) -> Octagon:
        a, b = self.conform(other.names), other.conform(self.names)
        return Octagon(a.names, np.minimum(a.m, b.m))

    def widen(self, new: Octagon) -> Octagon:
        a, b = self.conform(new.names), new.conform(self.names).closed()
        return Octagon(a.names, np.where(b.m > a.m, INF, a.m))

    def bounds(self, x: str) -> tuple[float, float]:
        """(least, greatest) value."""
        if x not in self.names:
            return -INF, INF
        i, m = 2 * self.names.index(x), self.closed().m
        return -m[i, i + 1] / 2, m[i + 1, i] / 2

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Octagon):
            return NotImplemented
        a, b = self.conform(other.names), other.conform(self.names)
        return a.bottom and b.bottom or not a.bottom and not b.bottom and bool((a.closed().m == b.closed().m).all())

    __hash__ = None


def octagon_bounds(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, lo, hi: the bounds of each variable in the octagon of each group's constraints, integers all.

    ``constraints`` has the keys and a, x, b, y, c: a*x + b*y <= c, or a*x <= c where y is null; a and b are 1 or -1.
    A group without a solution has no rows. A group is a matrix in one task, of the square of its variables.
    """
    import pandas as pd

    names = [*keys, "name", "lo", "hi"]

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        o = Octagon(sorted({*rows["x"], *rows["y"].dropna()}))
        for a, x, b, y, c in zip(rows["a"], rows["x"], rows["b"], rows["y"], rows["c"], strict=True):
            o = o.assume(int(a), x, int(b), y, float(c)) if isinstance(y, str) else o.assume(int(a), x, 0, None, float(c))
        closed = o.closed()
        found = [] if closed.bottom else [(*key, n, -closed.m[2 * i, 2 * i + 1] / 2, closed.m[2 * i + 1, 2 * i] / 2) for i, n in enumerate(closed.names)]
        return pd.DataFrame(found, columns=names)

    kinds = dict(constraints.dtypes)
    return constraints.select(*keys, "a", "x", "b", "y", "c").groupBy(*keys).applyInPandas(solve, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "name string, lo double, hi double"]))
