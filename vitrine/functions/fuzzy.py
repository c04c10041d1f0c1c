"""Fuzzy term matching helpers (X12), all as Column expressions.

Candidates come from deletion neighbourhoods: two strings within k edits
(insert, delete, substitute, transpose) share a string obtained by deleting
at most k characters from each, so an equi-join on those variants finds every
candidate pair without comparing all pairs. The exact distance is then checked
on candidate pairs only: the built-in ``levenshtein`` with a threshold decides
most, the rest go through a banded table that an ``aggregate`` fills row by row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.features import let

MAX_EDITS = 2
#: A table cell beyond the band, or a distance over MAX_EDITS.
_FAR = 9


def deletion_variants(term, max_deletes: int = MAX_EDITS) -> Column:
    """array<struct<v:string, d:int>>: the term with 0..max_deletes characters
    removed (d = number removed). Pure array expressions (JVM-side)."""
    t = F.col(term) if isinstance(term, str) else term
    n = F.length(t)
    zero = F.array(F.struct(t.alias("v"), F.lit(0).alias("d")))
    if max_deletes == 0:
        return zero

    def drop1(s: Column, i: Column) -> Column:
        return F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.lit(1 << 20)))

    one = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda i: F.struct(drop1(t, i).alias("v"), F.lit(1).alias("d")))
    one = F.when(n >= 1, one).otherwise(F.array().cast("array<struct<v:string,d:int>>"))
    if max_deletes == 1:
        return F.concat(zero, one)
    two = F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.transform(F.sequence(i + 1, F.greatest(n, i + 1)),
                              lambda j: F.struct(drop1(drop1(t, j), i).alias("v"), F.lit(2).alias("d")))))
    two = F.when(n >= 2, two).otherwise(F.array().cast("array<struct<v:string,d:int>>"))
    return F.concat(zero, one, two)


def _letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def _banded(a: Column, b: Column) -> Column:
    """Distance of two letter arrays by a table of which only the five cells
    around the diagonal are kept, and the three rows above."""
    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x == y, F.lit(False))

    def row(acc: Column, i: Column) -> Column:
        one, two, three = acc["one"], acc["two"], acc["three"]
        cell, cells = F.lit(_FAR), []
        for d in range(5):
            j = i + (d - 2)
            here, swap = same(F.get(a, i - 1), F.get(b, j - 1)), []
            ways = [one[d] + F.when(here, 0).otherwise(1), cell + 1]
            if d < 4:
                ways.append(one[d + 1] + 1)
            # letters a[i], b[j] change places with the letters before, or around one letter in between
            crossed = same(F.get(a, i - 2), F.get(b, j - 1)) & same(F.get(a, i - 1), F.get(b, j - 2))
            swap.append(F.when(crossed, two[d] + 1))
            if d < 4:
                swap.append(F.when(same(F.get(a, i - 3), F.get(b, j - 1)) & same(F.get(a, i - 1), F.get(b, j - 2)), three[d + 1] + 2))
            if d > 0:
                swap.append(F.when(same(F.get(a, i - 2), F.get(b, j - 1)) & same(F.get(a, i - 1), F.get(b, j - 3)), two[d - 1] + 2))
            cell = (F.when((j < 0) | (j > F.size(b)), _FAR).when(j == 0, i)
                    .otherwise(F.least(F.lit(_FAR), *ways, *swap)))
            cells.append(cell)
        return F.struct(F.array(*cells).alias("one"), one.alias("two"), two.alias("three"))

    far = F.array(*[F.lit(_FAR)] * 5)
    start = F.struct(F.array(*map(F.lit, (_FAR, _FAR, 0, 1, 2))).alias("one"), far.alias("two"), far.alias("three"))
    last = F.size(b) - F.size(a) + 2
    rows = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.aggregate(rows, start, row, lambda acc: F.get(acc["one"], last)), F.lit(_FAR))


def edit_distance(a: str, b: str) -> Column:
    """Unrestricted Damerau-Levenshtein distance of two columns if it is at most
    MAX_EDITS, else MAX_EDITS + 1. A swap costs one edit; other edits may lie
    between the swapped letters, which within two edits is one letter."""
    # each swap takes two plain edits at most, so a pair over four is over two here as well
    plain = F.levenshtein(a, b, 2 * MAX_EDITS)
    exact = let(F.struct(_letters(F.col(a)).alias("a"), _letters(F.col(b)).alias("b")), lambda s: _banded(s["a"], s["b"]))
    return (F.when(F.col(a) == F.col(b), 0).when(plain < 0, MAX_EDITS + 1).when(plain == 1, 1)
            .otherwise(F.least(exact, F.lit(MAX_EDITS + 1))))
