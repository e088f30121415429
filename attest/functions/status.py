"""Four-valued statuses. Each fold has its own order of precedence; none is Kleene logic.

A status column is one of supported, refuted, unknown, conflicting. Null counts as unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUPPORTED, REFUTED, UNKNOWN, CONFLICTING = "supported", "refuted", "unknown", "conflicting"
STATUSES = (SUPPORTED, REFUTED, UNKNOWN, CONFLICTING)

#: The first status present wins.
ALL = (REFUTED, CONFLICTING, UNKNOWN, SUPPORTED)
ANY = (SUPPORTED, CONFLICTING, UNKNOWN, REFUTED)
GRASP = (CONFLICTING, REFUTED, UNKNOWN, SUPPORTED)
LAYER = (CONFLICTING, REFUTED, UNKNOWN, SUPPORTED)
COMPLETENESS = ("invalid", "incomplete", "complete")


def rank(status: Column, order: tuple[str, ...]) -> Column:
    """0 for the strongest; a null status ranks as unknown (last, where the order has no unknown)."""
    out = F.when(status == order[0], 0)
    for i, s in enumerate(order[1:], 1):
        out = out.when(status == s, i)
    return out.otherwise(order.index(UNKNOWN) if UNKNOWN in order else len(order) - 1)


def unrank(n: Column, order: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in order]), (n + 1).cast("int"))


def fold(statuses: list[Column], order: tuple[str, ...]) -> Column:
    """Of several columns of a row; no columns fold to unknown."""
    if not statuses:
        return F.lit(UNKNOWN)
    ranks = [rank(s, order) for s in statuses]
    return unrank(F.least(*ranks) if len(ranks) > 1 else ranks[0], order)


def fold_rows(status: Column, order: tuple[str, ...]) -> Column:
    """Of the rows of a group."""
    return unrank(F.min(rank(status, order)), order)


def negate(status: Column) -> Column:
    return F.when(status == SUPPORTED, REFUTED).when(status == REFUTED, SUPPORTED).otherwise(F.coalesce(status, F.lit(UNKNOWN)))


def release(inside: Column, contact: Column, gripper: Column | None = None) -> Column:
    """Released in a region: inside, and not in contact, and (if referenced) the gripper is open."""
    parts = [inside, contact] + ([gripper] if gripper is not None else [])
    conflict = refuted = unknown = F.lit(False)
    for p in parts:
        conflict = conflict | (p == CONFLICTING)
        unknown = unknown | F.coalesce(p == UNKNOWN, F.lit(True))
    refuted = (inside == REFUTED) | (contact == SUPPORTED)
    if gripper is not None:
        refuted = refuted | (gripper == REFUTED)
    return F.when(conflict, CONFLICTING).when(refuted, REFUTED).when(unknown, UNKNOWN).otherwise(SUPPORTED)


def verdict(goal: Column, failure: Column | None) -> Column:
    """A supported failure refutes the goal; any other failure status is ignored."""
    return goal if failure is None else F.when(failure == SUPPORTED, REFUTED).otherwise(goal)


def expression(tree: dict, statuses: dict[str, Column]) -> Column:
    """A goal tree of all / any / not / predicate as one column over the named statuses. A predicate without a status is unknown."""
    (kind, body), *more = tree.items()
    if more:
        raise ValueError("an expression has exactly one operator")
    if kind == "predicate":
        return F.coalesce(statuses.get(body, F.lit(UNKNOWN)), F.lit(UNKNOWN))
    if kind == "not":
        return negate(expression(body, statuses))
    if kind in ("all", "any"):
        if not body:
            raise ValueError("an expression must not be empty")
        return fold([expression(x, statuses) for x in body], ALL if kind == "all" else ANY)
    raise ValueError(f"unknown operator {kind}")
