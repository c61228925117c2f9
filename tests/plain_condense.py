"""The condensed tree of one table in plain loops over its points, to compare the distributed one with."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd

NOISE = -1
ROUNDING = 1e-12


@dataclass
class _Group:
    """A cluster of the condensed tree while it grows upwards."""

    members: list[tuple[int, float]]
    children: list[_Group]
    rows: float
    birth: float = 0.0


def plain_condense(tree: pd.DataFrame, core: np.ndarray, n: np.ndarray, min_cluster_size: int):
    """Labels and persistence from the condensed tree's most stable clusters.

    A copied point with enough rows is a group by itself, from its core level on.
    """
    level = lambda gap: 1.0 / gap if gap > 0 else math.inf
    owner = list(range(len(n)))
    # Small pieces carry their points; a piece that reaches the minimum size
    # becomes a group, and two groups that meet get a parent.
    groups: dict[int, _Group] = {}
    loose: dict[int, list[int]] = {}
    for i in range(len(n)):
        if n[i] >= min_cluster_size:
            groups[i] = _Group([(i, level(core[i]))], [], n[i])
        else:
            loose[i] = [i]

    def find(i):
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for gap, a, b in zip(tree["gap"].tolist(), tree["a"].tolist(), tree["b"].tolist()):
        a, b = find(a), find(b)
        at = level(gap)
        owner[b] = a
        one, two = groups.pop(a, None), groups.pop(b, None)
        if one and two:
            one.birth = two.birth = at
            groups[a] = _Group([], [one, two], one.rows + two.rows)
        elif one or two:
            group = one or two
            fallen = loose.pop(b if one else a)
            group.members += [(i, at) for i in fallen]
            group.rows += n[fallen].sum()
            groups[a] = group
        else:
            piece = loose.pop(a) + loose.pop(b)
            if n[piece].sum() >= min_cluster_size:
                groups[a] = _Group([(i, at) for i in piece], [], n[piece].sum())
            else:
                loose[a] = piece
    root = groups[find(0)]
    chosen = _most_stable(root, n)
    chosen.sort(key=lambda g: min(i for i, _ in _all_members(g)))
    labels = np.full(len(n), NOISE)
    levels = [lam for g in _walk(root) for _, lam in g.members]
    top = max(levels + [c.birth for g in _walk(root) for c in g.children])
    persistence = []
    for c, group in enumerate(chosen):
        members = [i for i, _ in _all_members(group)]
        labels[members] = c
        share = _stability(group, n, top) / (n[members].sum() * top) if 0 < top < math.inf else 1.0
        persistence.append(float(share))
    return labels, persistence


def _stability(group: _Group, n: np.ndarray, highest: float) -> float:
    """Excess of mass: levels each row stays in the group, summed over the rows."""
    own = sum((min(lam, highest) - group.birth) * n[i] for i, lam in group.members)
    return own + sum((c.birth - group.birth) * c.rows for c in group.children)


def _walk(root: _Group):
    stack = [root]
    while stack:
        group = stack.pop()
        yield group
        stack.extend(group.children)


def _all_members(group: _Group) -> list[tuple[int, float]]:
    return [m for g in _walk(group) for m in g.members]


def _most_stable(root: _Group, n: np.ndarray) -> list[_Group]:
    """Excess of mass: a group or its descendants, whichever is more stable.

    The root is never chosen.
    """
    finite = [lam for g in _walk(root) for _, lam in g.members if math.isfinite(lam)]
    highest = max(finite, default=1.0)
    picked: dict[int, tuple[float, list[_Group]]] = {}
    for group in reversed(list(_walk(root))):
        below = sum(picked[id(c)][0] for c in group.children)
        own = _stability(group, n, highest)
        if group is root or (group.children and own < below * (1 - ROUNDING)):
            picked[id(group)] = (below, [g for c in group.children for g in picked[id(c)][1]])
        else:
            picked[id(group)] = (own, [group])
    return picked[id(root)][1]
