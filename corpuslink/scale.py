"""The two measuring scales. A report belongs to one scale, and a level of one is never laid on the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scale:
    """Everything in which the two scales differ, so that each measure is written once.

    ``rank_groups`` lists, strongest first, the ranks of each group; ``weak_from`` is the first rank called weak;
    ``grade_order`` lists the grades strongest first; ``levels`` names the groups."""

    key: str
    rank_groups: tuple[tuple[int, ...], ...]
    weak_from: int
    grade_order: tuple[int, ...]
    levels: tuple[str, ...]
    reference: str = "Trustworthy"

    @property
    def groups(self) -> int:
        return len(self.rank_groups)

    def group_of(self, rank: Column) -> Column:
        """The rank group (0 strongest) of a rank, null for a rank outside the scale."""
        out = F.lit(None).cast("int")
        for group, ranks in reversed(list(enumerate(self.rank_groups))):
            out = F.when(rank.isin(list(ranks)), F.lit(group)).otherwise(out)
        return out

    def grade_index(self, grade: Column) -> Column:
        """The place of a grade in the order strongest first, null when the scale has no such grade."""
        out = F.lit(None).cast("int")
        for place, value in reversed(list(enumerate(self.grade_order))):
            out = F.when(grade == value, F.lit(place)).otherwise(out)
        return out

    def level(self, group: Column) -> Column:
        """The name of a rank group; "None ranked" for null."""
        out = F.lit("None ranked")
        for place, name in reversed(list(enumerate(self.levels))):
            out = F.when(group == place, F.lit(name)).otherwise(out)
        return out


# The two scales' rank groups, weak cuts and grade orders.
SCALE_A = Scale(
    "A", ((1,), (2, 3), (4, 5), (6,), (7, 8, 9), (10, 11, 12)), 7, (4, 3, 2, 1, 0),
    ("Companion only", "Trustworthy", "Truthful", "Acceptable", "Weak / unknown", "Rejected"))
SCALE_B = Scale("B", ((1,), (2,), (3,), (4,)), 4, (4, 3, 2, 1), ("Trustworthy", "Praised", "Muwaththaq", "Weak"))
SCALES = {"A": SCALE_A, "B": SCALE_B}


def scale_of(key: str | None) -> Scale:
    """The scale of a scope: ``B`` for the second, the first for anything else."""
    return SCALES.get(key or "A", SCALE_A)


def by_scale(scale: Column, of_a: Column, of_b: Column) -> Column:
    """One column for both scales: the first scale's expression unless the row is of the second."""
    return F.when(scale == "B", of_b).otherwise(of_a)
