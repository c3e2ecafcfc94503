"""Convex polyhedra over integer variables, by exact elimination of variables.

A polyhedron is a set of constraints ``sum of coefficient * variable <= bound`` with coprime integers. Bounds are
tightened to integers constraint by constraint; beyond that, reasoning is over the rationals. Variables are
eliminated by pairing the constraints that bound them from above and below. That is for states of a few variables, as in the grouped function
``polyhedron_bounds``; ``domains.Octagon`` and intervals are for many.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame

from .domains import INF, NEGATED, Linear

Row = tuple[tuple[tuple[str, int], ...], int | Fraction]  # ((variable, coefficient), ...), bound


def tidy(terms: dict[str, Fraction | int], bound: Fraction | int, integers: bool = True) -> Row:
    """The constraint with coprime integers as coefficients; its bound rounded down if the variables are ``integers``."""
    terms = {n: Fraction(k) for n, k in terms.items() if k}
    down = math.floor if integers else Fraction
    if not terms:
        return (), down(bound)
    scale = math.lcm(*(k.denominator for k in terms.values()))
    scaled = {n: int(k * scale) for n, k in terms.items()}
    by = math.gcd(*scaled.values())
    return tuple(sorted((n, k // by) for n, k in scaled.items())), down(Fraction(bound) * scale / by)


def tightest(rows: list[Row]) -> frozenset[Row]:
    """One constraint for each left side; those that always hold go."""
    least: dict[tuple, int] = {}
    for terms, bound in rows:
        least[terms] = min(bound, least.get(terms, bound))
    return frozenset((t, b) for t, b in least.items() if t or b < 0)


def eliminate(rows: frozenset[Row], names: set[str]) -> frozenset[Row]:
    """What the constraints say about the other variables, over the rationals.

    A pair of more ancestors than variables were eliminated, and one more, follows from others. That rule only holds
    if nothing else is left out but what a constraint with the same left side, none of whose ancestors it lacks, implies.
    """
    left: list[tuple[dict, Fraction, frozenset]] = [(dict(t), Fraction(b), frozenset((k,))) for k, (t, b) in enumerate(sorted(rows))]
    names, done = set(names), 0
    while names:
        cost = lambda n: sum(t.get(n, 0) > 0 for t, _, _ in left) * sum(t.get(n, 0) < 0 for t, _, _ in left)
        name = min(sorted(names), key=cost)
        names.remove(name)
        done += 1
        over, under = [r for r in left if r[0].get(name, 0) > 0], [r for r in left if r[0].get(name, 0) < 0]
        kept: dict[tuple, list[tuple[Fraction, frozenset]]] = {}

        def add(terms: dict, bound: Fraction, of: frozenset) -> bool:
            key, bound = tidy(terms, bound, False)
            if not key:
                return bound < 0
            same = kept.setdefault(key, [])  # noqa: B023
            if not any(b <= bound and q <= of for b, q in same):
                same[:] = [(b, q) for b, q in same if not (bound <= b and of <= q)] + [(bound, of)]
            return False

        empty = [add(*r) for r in left if not r[0].get(name)]
        for t, b, p in over:
            for u, c, q in under:
                if len(p | q) <= done + 1:
                    x, y = -u[name], t[name]
                    empty.append(add({n: x * t.get(n, 0) + y * u.get(n, 0) for n in t.keys() | u.keys() if n != name}, x * b + y * c, p | q))
        if any(empty):
            return frozenset({((), -1)})
        left = [(dict(key), bound, of) for key, same in kept.items() for bound, of in same]
    return tightest([(tuple(sorted(t.items())), b) for t, b, _ in left])


def whole(rows: frozenset[Row]) -> frozenset[Row]:
    """The constraints with bounds tightened to integers."""
    return tightest([tidy(dict(t), b) for t, b in rows])


@dataclass(frozen=True)
class Polyhedron:
    """Values of integer variables; one that no constraint names is unbounded. An empty one is bottom."""

    rows: frozenset[Row] = frozenset()

    @property
    def names(self) -> set[str]:
        return {n for t, _ in self.rows for n, _ in t}

    @property
    def bottom(self) -> bool:
        return any(not t and b < 0 for t, b in eliminate(self.rows, self.names))

    @property
    def top(self) -> bool:
        return not self.rows

    def assume(self, left: Linear, relation: str, right: Linear | int = 0) -> Polyhedron:
        """Met with ``left relation right``; != only empties what allows nothing else."""
        if relation not in NEGATED:
            raise ValueError(f"{relation} is no relation")
        form = left - (right if isinstance(right, Linear) else Linear.of(right))
        terms, c = dict(form.terms), form.constant
        minus = {n: -k for n, k in terms.items()}
        if relation == "!=":
            equal = self.assume(form, "=")
            return Polyhedron(frozenset({((), -1)})) if self.entails(equal) else self
        rows = list(self.rows)
        if relation in ("<=", "<", "=", "=="):
            rows.append(strictly(terms, -c) if relation == "<" else tidy(terms, -c))
        if relation in (">=", ">", "=", "=="):
            rows.append(strictly(minus, c) if relation == ">" else tidy(minus, c))
        return Polyhedron(tightest(rows))

    def meet(self, other: Polyhedron) -> Polyhedron:
        return Polyhedron(tightest([*self.rows, *other.rows]))

    def forget(self, *names: str) -> Polyhedron:
        return Polyhedron(whole(eliminate(self.rows, set(names) & self.names)))

    def entails(self, other: Polyhedron) -> bool:
        """Whether all values of this one are the other's."""
        for terms, bound in other.rows:
            beyond = tidy({n: -k for n, k in terms}, -bound - 1)
            if not Polyhedron(tightest([*self.rows, beyond])).bottom:
                return False
        return True

    def assign(self, x: str, form: Linear) -> Polyhedron:
        """x := form."""
        old = f"{x} before"
        renamed = Polyhedron(frozenset((tuple(sorted((old if n == x else n, k) for n, k in t)), b) for t, b in self.rows))
        form = Linear.of(form.constant, **{old if n == x else n: k for n, k in form.terms})
        return renamed.assume(Linear.of(**{x: 1}), "=", form).forget(old)

    def substitute(self, x: str, form: Linear) -> Polyhedron:
        """The values before x := form that lead into this one."""
        rows = []
        for t, b in self.rows:
            terms = {n: Fraction(k) for n, k in t}
            by = terms.pop(x, Fraction(0))
            for n, k in form.terms:
                terms[n] = terms.get(n, Fraction(0)) + by * k
            rows.append(tidy(terms, b - by * form.constant))
        return Polyhedron(tightest(rows))

    def join(self, other: Polyhedron) -> Polyhedron:
        """The convex hull: points between one of each, eliminated down to the point itself."""
        if self.bottom or other.bottom:
            return other if self.bottom else self
        names = self.names & other.names
        a, b = self.forget(*(self.names - names)), other.forget(*(other.names - names))
        one, share = {n: f"{n} of one" for n in names}, "share"
        #: The share of one and its part of the point are no integers.
        rows = [tidy({share: 1}, 1, False), tidy({share: -1}, 0, False)]
        rows += [tidy({one[n]: k for n, k in t} | {share: -bound}, 0, False) for t, bound in a.rows]
        rows += [tidy(dict(t) | {one[n]: -k for n, k in t} | {share: bound}, bound, False) for t, bound in b.rows]
        return Polyhedron(whole(eliminate(tightest(rows), {*one.values(), share})))

    def widen(self, new: Polyhedron) -> Polyhedron:
        """The constraints of this one that ``new`` keeps."""
        if self.bottom:
            return new
        return Polyhedron(frozenset(r for r in self.rows if new.entails(Polyhedron(frozenset({r})))))

    def bounds(self, x: str) -> tuple[float, float]:
        """(least, greatest) value."""
        low, high = -INF, INF
        for t, b in eliminate(self.rows, self.names - {x}):
            if not t:
                return INF, -INF
            k = t[0][1]
            low, high = (low, min(high, math.floor(Fraction(b, k)))) if k > 0 else (max(low, math.ceil(Fraction(b, k))), high)
        return low, high

    def same(self, other: Polyhedron) -> bool:
        return self.entails(other) and other.entails(self)


def strictly(terms: dict[str, Fraction], bound: Fraction) -> Row:
    """sum < bound, over integers."""
    scale = math.lcm(*(k.denominator for k in terms.values())) if terms else 1
    return tidy(terms, Fraction(math.ceil(bound * scale) - 1, scale))


def polyhedron_bounds(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, lo, hi: the bounds of each variable in the polyhedron of each group's constraints.

    ``constraints`` has the keys, terms (map<string, double>) and c: sum of terms <= c. A group without a solution
    has no rows. A group is solved in one task.
    """
    import pandas as pd

    names = [*keys, "name", "lo", "hi"]

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = Polyhedron(tightest([tidy({n: Fraction(k) for n, k in dict(t).items()}, Fraction(c)) for t, c in zip(rows["terms"], rows["c"], strict=True)]))
        found = [] if p.bottom else [(*key, n, *p.bounds(n)) for n in sorted(p.names)]
        return pd.DataFrame(found, columns=names)

    kinds = dict(constraints.dtypes)
    return constraints.select(*keys, "terms", "c").groupBy(*keys).applyInPandas(solve, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "name string, lo double, hi double"]))
