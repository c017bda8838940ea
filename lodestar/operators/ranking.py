"""Scores of people for projects, and the best of each project."""

from __future__ import annotations

import bisect
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Functions travel by value, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Points of each part, and the steps by which a part is given in part.
POINTS = {"skill": 40, "experience": 15, "rate": 15, "location": 20, "remote": 10}
ROLE_POINTS, DISPATCH_POINTS, DISPATCH_CAP, CAP = 30, 5, 20, 100
#: Rows that are looked at together, and rows that wait before a task thins them out.
STRIDE, MOST_WAITING = 256, 100_000
UNKNOWN_EXPERIENCE = 8 / 15
BY_YEARS = [(10, 1.0), (7, 12 / 15), (5, 8 / 15), (3, 4 / 15), (1, 2 / 15)]
BY_SHORTFALL = [(0, 1.0), (1, 8 / 15), (2, 4 / 15)]
BY_EXCESS = [(1.0, 1.0), (1.1, 8 / 15), (1.2, 3 / 15)]


def steps(value: Column, bounds: list[tuple[float, float]], at_least: bool, otherwise: float = 0.0) -> Column:
    """The share of the first bound that value reaches (at_least) or stays within."""
    out = None
    for bound, share in bounds:
        holds = value >= bound if at_least else value <= bound
        out = F.when(holds, share) if out is None else out.when(holds, share)
    return out.otherwise(otherwise)


def skill_share(hit: Column, unverified: Column, total: Column, nice_hit: Column, nice: Column) -> Column:
    """Weights hit, unverified ones for half, over all; hits of n nice-to-have skills add a tenth at most."""
    main = F.when(F.coalesce(total, F.lit(0)) == 0, 0.5).when(F.coalesce(hit, F.lit(0)) == 0, 0.0).otherwise(F.least((hit - 0.5 * F.coalesce(unverified, F.lit(0))) / total, F.lit(1.0)))
    extra = F.when(nice > 0, F.least(F.coalesce(nice_hit, F.lit(0)) / nice, F.lit(1.0)) * 0.1).otherwise(0.0)
    return F.least(main + extra, F.lit(1.0))


def experience_share(years: Column, required: Column) -> Column:
    asked = steps(required - years, [(0, 1.0), *BY_SHORTFALL[1:]], at_least=False)
    return F.when(years.isNull(), UNKNOWN_EXPERIENCE).when(required > 0, asked).otherwise(steps(years, BY_YEARS, at_least=True))


def rate_share(rate: Column, budget: Column) -> Column:
    within = [(rate <= budget * bound, share) for bound, share in BY_EXCESS]
    out = F.when(budget.isNull(), 1.0).when(rate.isNull(), 0.0)
    for holds, share in within:
        out = out.when(holds, share)
    return out.otherwise(0.0)


def location_share(full_remote: Column, work: Column, home: Column, work_region: Column, home_region: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(full_remote, 1.0).when(blank(work) | blank(home), 0.25).when(home == work, 1.0).when(home_region == work_region, 0.5).otherwise(0.0)


def remote_share(wants_all: Column, can: Column, project_full: Column, project_some: Column) -> Column:
    return F.when(wants_all & ~project_some, -1.0).when(project_full, 0.0).when(can & project_some, 1.0).when(can.isNull(), 0.5).otherwise(0.0)


def role_points(affinity: Column) -> Column:
    return F.round((affinity - 0.5) * ROLE_POINTS)


def contract_points(contract_dispatch: Column, dispatch_ok: Column) -> tuple[Column, Column]:
    """What dispatch adds, and the most that a score may be."""
    return F.when(contract_dispatch & dispatch_ok, DISPATCH_POINTS).otherwise(0), F.when(contract_dispatch & ~dispatch_ok, DISPATCH_CAP).otherwise(CAP)


def score(parts: dict[str, Column], points: dict[str, int] = POINTS, contract_dispatch: Column | None = None, dispatch_ok: Column | None = None, affinity: Column | None = None) -> Column:
    """Each part is rounded by itself, their sum is at least 0; then come dispatch and role points, and the cap.

    A person who refuses dispatch gets DISPATCH_CAP at most in a dispatch project. Rounding is half away from zero.
    """
    total = F.greatest(F.lit(0), sum((F.round(share * points[name]) for name, share in parts.items()), F.lit(0)))
    if affinity is not None:
        total = total + role_points(affinity)
    if contract_dispatch is None:
        return F.least(total, F.lit(CAP))
    more, most = contract_points(contract_dispatch, dispatch_ok)
    return F.least(total + more, most)


def best(scored: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    """The n best rows of each `by`, with rank. The order must end with a unique key. Only narrow rows should come in here."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def _unbeaten(rows: pd.DataFrame, by: list[str], n: int) -> pd.DataFrame:
    """Rows (points, cost, id) that fewer than n others of their group beat: as many points or more, no higher cost, and more points or a smaller id.

    In the order of points and id, only rows before one can beat it, and of these the n lowest costs tell whether n do.
    """
    group = rows.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    order = np.lexsort((rows["id"].to_numpy(), -rows["points"].to_numpy(), group))
    group, cost = group[order], rows["cost"].to_numpy()[order]
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
    kept = []
    for start, end in itertools.pairwise(bounds):
        lowest: list[float] = []
        for at in range(start, end, STRIDE):
            part = cost[at : min(at + STRIDE, end)]
            for i in np.flatnonzero(part < lowest[-1]) if len(lowest) == n else range(len(part)):
                if len(lowest) < n or part[i] < lowest[-1]:
                    kept.append(at + i)
                    bisect.insort(lowest, part[i])
                    del lowest[n:]
    return rows.iloc[order[kept]]


def contenders(people: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, points, cost, id: of each group those who can be among the n best for anyone to whom more points and lower costs are never worse
    and ids break ties. cost may be infinite, but not null or NaN.

    A group's people are thinned out where they are first, batch by batch, so that those few who are left alone are shuffled.
    """

    def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, size, seen = [], 0, 0
        for batch in batches:
            left.append(batch)
            size += len(batch)
            if size >= max(MOST_WAITING, 2 * seen):
                left = [_unbeaten(pd.concat(left), by, n)]
                size = seen = len(left[0])
        if size:
            yield _unbeaten(pd.concat(left), by, n)

    rows = people.select(*by, "points", "cost", "id")
    return rows.mapInPandas(thinned, rows.schema).groupBy(*by).applyInPandas(lambda g: _unbeaten(g, by, n), rows.schema)


def weight_of(category_points: Column, asked_years: Column, position: Column, most: int = 6) -> Column:
    """A required skill's weight: its category's, 2 more with years, 1 more as the first, `most` at most."""
    return F.least(category_points + F.when(asked_years, 2).otherwise(0) + F.when(position == 0, 1).otherwise(0), F.lit(most))
