"""Exact medians and quantiles by narrowing brackets, in aggregates of bounded size.

An exact quantile aggregate keeps every distinct value. Here a sketch of the values
gives two of them close to the wanted rank, and one count tells exactly how many values
lie below, at and between the two. The part that holds the rank is the next bracket. A
sketch's rank error is bounded, so a round narrows the bracket by a factor of
thousands whatever the distribution, and both of its ends drop out of it for good.
A few values are left at the end, which are sorted. All columns share the rounds.
"""

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a bracket that one aggregate may hold and sort.
EXACT_VALUES = 20_000
#: The rank error of a sketch is one part in this.
ACCURACY = 10_000


@dataclass
class _Rank:
    """The ``rank``-th value (from 0) of those strictly between ``low`` and ``high``, of which there are ``inside``."""

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def bracket(self) -> tuple:
        return self.column, self.low, self.high

    def settle(self, low: float, high: float, counts: tuple[int, int, int, int]) -> None:
        """Move to the part that holds the rank; counts are below, at ``low``, between, at ``high``."""
        ends = [(self.low, low), low, (low, high), high, (high, self.high)]
        sizes = [*counts, self.inside - sum(counts)]
        for part, size in zip(ends, sizes):
            if self.rank < size:
                if isinstance(part, tuple):
                    self.low, self.high, self.inside = *part, size
                else:
                    self.value = part
                return
            self.rank -= size


def _between(value: Column, low: float | None, high: float | None) -> Column:
    found = value.isNotNull()
    if low is not None:
        found = found & (value > low)
    return found if high is None else found & (value < high)


def _one_row(rows: DataFrame, wanted: list[Column]) -> list:
    return list(rows.agg(*[c.alias(f"x{k}") for k, c in enumerate(wanted)]).first()) if wanted else []


def exact_medians(rows: DataFrame, columns: list[str], exact_values: int = EXACT_VALUES, accuracy: int = ACCURACY) -> dict[str, float | None]:
    """The exact median of each column, None where it has no value; null and NaN are none.

    Of an even number of values it is the mean of the two in the middle. ``rows`` should
    be a stored table, of which each round reads ``columns`` twice.
    """
    return {c: found and found[0] for c, found in exact_quantiles(rows, columns, [0.5], exact_values, accuracy).items()}


def exact_quantiles(rows: DataFrame, columns: list[str], shares: list[float], exact_values: int = EXACT_VALUES,
                    accuracy: int = ACCURACY) -> dict[str, list[float] | None]:
    """The exact quantiles of each column at ``shares``, as ``exact_medians`` finds the middle one.

    Between two values a quantile is interpolated in proportion, as numpy's is.
    """
    value = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns}
    totals = dict(zip(columns, _one_row(rows, [F.count(value[c]) for c in columns])))
    places = {c: [share * (n - 1) for share in shares] for c, n in totals.items() if n}
    ranks = {c: [(_Rank(c, floor(p), totals[c]), _Rank(c, ceil(p), totals[c])) for p in at] for c, at in places.items()}
    while open_ := [t for pairs in ranks.values() for pair in pairs for t in pair if t.value is None]:
        few = {t.bracket: t for t in open_ if t.inside <= exact_values}
        many = {t.bracket: t for t in open_ if t.inside > exact_values}
        lists = [F.sort_array(F.collect_list(F.when(_between(value[c], low, high), value[c]))) for c, low, high in few]
        at = {key: [t.rank for t in open_ if t.bracket == key] for key in few}
        picked = [F.array(*[F.get(kept, F.lit(r)) for r in at[key]]) for key, kept in zip(few, lists)]
        margin = 2 / accuracy
        cuts = []
        for (c, low, high), t in many.items():
            shares = [max(0.0, t.rank / t.inside - margin), min(1.0, t.rank / t.inside + margin)]
            cuts.append(F.percentile_approx(F.when(_between(value[c], low, high), value[c]), shares, accuracy))
        found = _one_row(rows, picked + cuts)
        for key, values in zip(few, found):
            for t, v in zip([t for t in open_ if t.bracket == key], values):
                t.value = v
        ends = dict(zip(many, found[len(few):]))
        counts = _one_row(rows, [F.count_if(condition) for (c, low, high), (a, b) in ends.items() for condition in (
            _between(value[c], low, a), value[c] == a, _between(value[c], a, b), (value[c] == b) & F.lit(a != b))])
        for k, (key, (a, b)) in enumerate(ends.items()):
            for t in [t for t in open_ if t.bracket == key]:
                t.settle(a, b, tuple(counts[4 * k:4 * k + 4]))

    def between(p: float, low: _Rank, high: _Rank) -> float:
        return low.value if low.value == high.value else low.value * (1 - p % 1) + high.value * (p % 1)

    return {c: [between(p, *pair) for p, pair in zip(places[c], ranks[c])] if c in ranks else None for c in columns}
