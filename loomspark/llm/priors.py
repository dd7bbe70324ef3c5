"""Empirical beta priors from counts by group: how far the rates of groups spread beyond what chance alone does."""

from __future__ import annotations

#: Bounds of a prior's weight, in rows.
PRIOR_WEIGHT = (2.0, 1000.0)


def prior_weight(groups: int, parents: int, n: float, bad: float, squares: float, parent_squares: float, sizes: float) -> float:
    """The weight of a beta prior for groups within parents, by the moments of a nested analysis of variance.

    ``squares`` is the sum of bad**2 / n over groups, ``parent_squares`` that over parents, and ``sizes`` the sum over
    parents of the sum of their groups' n**2 by their own n. The binomial variance within groups is taken off the variance
    between them. Where that leaves nothing, or groups of one row each tell nothing, the prior has its greatest weight.
    """
    low, high = PRIOR_WEIGHT
    if groups <= parents or n <= groups:
        return high
    between = (squares - parent_squares) / (groups - parents)
    within = (bad - squares) / (n - groups)
    if between - within <= 1e-12:
        return high
    size = (n - sizes) / (groups - parents)
    return min(max(size * within / (between - within), low), high)
