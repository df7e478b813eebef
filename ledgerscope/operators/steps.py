"""What a run of mints and burns does to the supply it starts from, as a step function: helpers of the ledger's tasks.

A function is two lists: ``at``, ascending starts, and ``add``, what is added to a start from there up to the next one. It
holds from its first start up to a highest one, and is empty where it would have too many steps. Numbers are doubles or
decimals; decimals are added with 120 digits, as Python's own 28 would round amounts of 38.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence
from decimal import Context, localcontext
from itertools import pairwise

import numpy as np

EXACT = Context(prec=120)

Steps = tuple[list, list]


def replay(start, deltas: Iterable) -> list:
    """The supply after each move; a burn above the supply changes nothing."""
    out, supply = [], start
    with localcontext(EXACT):
        for delta in deltas:
            if delta >= 0 or -delta <= supply:
                supply += delta
            out.append(supply)
    return out


def net(start, deltas: Sequence):
    """What the moves add to a start."""
    with localcontext(EXACT):
        return replay(start, deltas)[-1] - start


def of_moves(deltas: Iterable, low, high, most: int) -> Steps:
    """The function of moves in their order for starts of ``low`` to ``high``."""
    kind = float if isinstance(low, float) else object
    none = low - low
    with localcontext(EXACT):
        at, add, minted = np.array([low], kind), np.array([none], kind), none
        for delta in deltas:
            if delta >= 0:
                minted += delta
                continue
            least = -delta - minted - add  # the least start, on each step, that the burn is granted
            granted = (at >= least).astype(bool)
            split = ~granted & (np.append(least[:-1] < at[1:], least[-1] <= high)).astype(bool)
            if split.any():
                where = np.flatnonzero(split)
                at, add, granted = np.insert(at, where + 1, least[where]), np.insert(add, where + 1, add[where]), np.insert(granted, where + 1, True)
            add = np.where(granted, add + delta, add)
            if len(at) > most:
                at, add = (np.array(x, kind) for x in _joined(at.tolist(), add.tolist()))
                if len(at) > most:
                    return [], []
        return _joined(at.tolist(), (add + minted).tolist())


def _joined(at: list, add: list) -> Steps:
    """The same function without steps that add what the one before adds."""
    kept = [0, *(k for k, (a, b) in enumerate(pairwise(add), 1) if a != b)]
    return [at[k] for k in kept], [add[k] for k in kept]


def _then(first: Steps, high, second: Steps) -> Steps:
    """One function after another, for starts up to ``high``."""
    at, add = [], []
    for k, (begin, plus) in enumerate(zip(*first, strict=True)):
        j = max(bisect_right(second[0], begin + plus) - 1, 0)
        at.append(begin)
        add.append(plus + second[1][j])
        for step, more in zip(second[0][j + 1 :], second[1][j + 1 :], strict=True):
            inside = step - plus
            if inside > high or (k + 1 < len(first[0]) and inside >= first[0][k + 1]):
                break
            at.append(inside)
            add.append(plus + more)
    return _joined(at, add)


def chain(functions: Iterable[tuple], most: int) -> Steps:
    """Functions, each with its highest start, put together in their order; empty if one is or the whole has over ``most`` steps."""
    whole, high = None, None
    with localcontext(EXACT):
        for highest, at, add in functions:
            if len(at) == 0:
                return [], []
            if whole is None:
                whole, high = (list(at), list(add)), highest
            else:
                whole = _then(whole, high, (list(at), list(add)))
            if len(whole[0]) > most:
                return [], []
    return whole


def starts(start, functions: Iterable[tuple]) -> list:
    """The start of each function of a chain."""
    out = []
    with localcontext(EXACT):
        for at, add in functions:
            out.append(start)
            start += add[max(bisect_right(at, start) - 1, 0)]
    return out
