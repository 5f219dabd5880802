"""When two texts count as alike: the size of their shingles and the least Jaccard likeness."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``size`` words; linked from ``per_cent`` per cent of intersection / union."""

    size: int = 5
    per_cent: int = 80
    lower: bool = True

    @property
    def t(self) -> Fraction:
        return Fraction(self.per_cent, 100)

    def difference(self, n: int) -> int:
        """Most shingles by which a set of n and a larger linked one may differ."""
        return int(n * (1 - self.t) / self.t)

    def spare(self, n: int) -> int:
        """Parts beyond those that differences can take, more of them the fewer shingles a part holds: half the
        differences at 0.8, two ninths at 0.9."""
        return 2 + self.difference(2 * self.difference(n))

    def parts(self, n: int) -> int:
        return self.difference(n) + 1 + self.spare(n)

    def linked(self, n_a: int, n_b: int, both: int) -> bool:
        return 100 * both >= self.per_cent * (n_a + n_b - both)

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return 100 * F.least(a, b) >= self.per_cent * F.greatest(a, b)
