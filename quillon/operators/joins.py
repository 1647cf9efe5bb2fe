"""Inner joins of any number of tables on any of the six comparisons, with a selectable physical strategy.

Tables are joined in the order of least estimated intermediate rows. Catalyst chooses the algorithm unless a
strategy is asked for; a strategy is a hint and never changes the result. Broadcasts and nested loops are asked for
only when the estimated size of the table is within HINTED_BYTES, nested loops also only when the pairs of rows
that they compare are within LOOPED_PAIRS; beyond that the choice is Catalyst's.

A join that is estimated to make FAN_OUT rows or more of each row of either side has few keys, so a shuffle by them
would give a few tasks all the rows. Where the following table is within SPREAD_BYTES, it is broadcast and what is joined
before is dealt out evenly. Beyond DEALT_BYTES that would take several times the tables' size of disk, so there an
earlier join by KEYS_A_TASK keys or more for each task shuffles its rows into as many tasks instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame

from quillon.operators.relational import column, predicate
from quillon.plans.estimates import Estimate, estimated_bytes, joined_rows
from quillon.plans.spec import Attr, Cond, QueryError

HINTED_BYTES = 64 << 20
LOOPED_PAIRS = 1 << 28
FAN_OUT, SPREAD_BYTES = 4, 4 << 20
#: Tasks that get so many keys each differ by about a tenth of their rows.
KEYS_A_TASK, DEALT_BYTES = 128, 32 << 20
#: Strategies whose work is the product of both tables' rows.
LOOPS = ("nested", "block")
#: Strategy to hint; nested loops have one implementation in Spark, an index join is an ordinary join on the sorted copy.
HINTS = {"auto": None, "nested": "shuffle_replicate_nl", "block": "shuffle_replicate_nl", "merge": "merge", "hash": "shuffle_hash", "broadcast": "broadcast", "index": None}


def hinted(df: DataFrame, strategy: str, pairs: float = 0.0) -> DataFrame:
    """pairs: of rows, at most, that a nested loop with this table compares."""
    if strategy not in HINTS:
        raise QueryError(f"no join strategy {strategy}; there are {', '.join(HINTS)}")
    hint = HINTS[strategy]
    if hint is None or hint in ("broadcast", "shuffle_replicate_nl") and estimated_bytes(df) > HINTED_BYTES:
        return df
    if strategy in LOOPS and pairs > LOOPED_PAIRS:
        return df
    return df.hint(hint)


def tasks_of_shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt_evenly(df: DataFrame) -> DataFrame:
    """The rows in as many tasks as a shuffle has, whatever their keys."""
    return df.repartition(tasks_of_shuffles(df))


def dealt_by_keys(df: DataFrame, table: str, on: Sequence[Cond]) -> DataFrame:
    """The rows of a table by what it is joined on, in as many tasks as a shuffle has: adaptive execution merges those of other shuffles."""
    keys = [column(a) for c in on if c.op == "=" for a in (c.left, c.right) if a.table == table]
    return df.repartition(tasks_of_shuffles(df), *keys)


def fanning_out(frames: Mapping[str, DataFrame], order: Sequence[str], conditions: Sequence[Cond], estimates: Mapping[str, Estimate]) -> list[str]:
    """The tables whose join has few keys, and that may be broadcast."""
    rows, found = estimates[order[0]].rows, []
    for k, t in enumerate(order[1:], 1):
        before, rows = rows, joined_rows(rows, order[:k], t, conditions, estimates)
        if rows >= FAN_OUT * max(before, estimates[t].rows) and estimated_bytes(frames[t]) <= SPREAD_BYTES:
            found.append(t)
    return found


def broadcast_side(joined: DataFrame, following: DataFrame) -> DataFrame | None:
    """The one that Catalyst broadcasts when it plans an inner join of them by an equality; None: it shuffles both."""
    most = joined.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    least = min(joined, following, key=estimated_bytes)
    return least if estimated_bytes(least) <= most else None


def joined_keys(on: Sequence[Cond], estimates: Mapping[str, Estimate]) -> float:
    """Values by which a shuffled join deals out the rows of both sides."""
    values = 1.0
    for c in on:
        if c.op == "=":
            values *= min(estimates[a.table].distinct_of(a.column) for a in (c.left, c.right))
    return values


def join_order(tables: Sequence[str], conditions: Sequence[Cond], estimates: Mapping[str, Estimate] | None = None) -> list[list[str]]:
    """The tables by connected component, each in the order in which they are joined.

    Of the tables connected to those before, first those with an equality, of these the one whose join is estimated to
    have the fewest rows, then the first listed. A component begins with the pair of the fewest rows. Without estimates
    the order of the list decides.
    """
    components = _in_listed_order(tables, conditions)
    return components if estimates is None else [_by_estimates(c, conditions, estimates) for c in components]


def _by_estimates(component: list[str], conditions: Sequence[Cond], estimates: Mapping[str, Estimate]) -> list[str]:
    """Greedy from every first table; the order whose intermediate results have the fewest rows altogether."""
    best, least = component, float("inf")
    for first in component:
        order, rows, total = [first], estimates[first].rows, 0.0
        while len(order) < len(component):
            linked = [c for c in conditions if len(c.tables & set(order)) == 1]
            connected = [t for t in component if t not in order and any(t in c.tables for c in linked)]
            by_equality = [t for t in connected if any(t in c.tables and c.op == "=" for c in linked)]
            size = {t: joined_rows(rows, order, t, conditions, estimates) for t in by_equality or connected}
            following = min(size, key=size.get)
            rows = size[following]
            total += rows
            order.append(following)
        # the first join reads both its tables anyway: prefer to begin with the smaller one
        total += estimates[first].rows
        if total < least:
            best, least = order, total
    return best


def _in_listed_order(tables: Sequence[str], conditions: Sequence[Cond]) -> list[list[str]]:
    waiting, components = list(tables), []
    while waiting:
        joined = [waiting.pop(0)]
        while True:
            linked = [c for c in conditions if len(c.tables) == 2 and len(c.tables & set(joined)) == 1]
            by_equality = {t for c in linked if c.op == "=" for t in c.tables}
            connected = {t for c in linked for t in c.tables}
            following = [t for t in waiting if t in by_equality] or [t for t in waiting if t in connected]
            if not following:
                break
            waiting.remove(following[0])
            joined.append(following[0])
        components.append(joined)
    return components


def join_tables(frames: Mapping[str, DataFrame], tables: Sequence[str], conditions: Sequence[Cond], strategy: str = "auto", estimates: Mapping[str, Estimate] | None = None, most: Mapping[str, Estimate] | None = None) -> DataFrame:
    """All frames joined on all conditions between two tables; components without a common condition are crossed.

    most: estimates on the high side, which nested loops are bounded by; without them they aren't.
    """
    parts = []
    for component in join_order(tables, conditions, estimates):
        joined, within, rows = frames[component[0]], {component[0]}, most[component[0]].rows if most else 0.0
        fanning = fanning_out(frames, component, conditions, estimates) if estimates and strategy == "auto" else []
        dealt = False
        for t in component[1:]:
            on = [c for c in conditions if isinstance(c.right, Attr) and t in c.tables and len(c.tables) == 2 and c.tables <= within | {t}]
            following = frames[t]
            if t in fanning:
                joined, following, dealt = joined if dealt else dealt_evenly(joined), following.hint("broadcast"), True
            elif fanning and (side := broadcast_side(joined, following)) is None:
                stored = sum(estimated_bytes(frames[x]) for x in {*within, t})
                dealt = stored > DEALT_BYTES and joined_keys(on, estimates) >= KEYS_A_TASK * tasks_of_shuffles(joined)
                if dealt and fanning[-1] in component[component.index(t) :]:
                    following = dealt_by_keys(following, t, on)
            elif fanning and side is joined:
                dealt = False
            joined = joined.join(hinted(following, strategy, rows * most[t].rows if most else 0.0), reduce(and_, (predicate(joined, c) for c in on)), "inner")
            rows = joined_rows(rows, within, t, conditions, most) if most else 0.0
            within.add(t)
        parts.append(joined)
    return reduce(lambda a, b: a.crossJoin(b), parts)
