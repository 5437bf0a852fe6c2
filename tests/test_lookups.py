"""Trees of lookups at any depth against a plain walk."""

import random

from helpers import by, frame
from runledger.operators import lookups

ROWS = "lookup_id bigint, parent_lookup_id bigint"


def closure(spark, parents):
    made = frame(spark, ROWS, *({"lookup_id": number, "parent_lookup_id": up} for number, up in parents.items()))
    return by(lookups.lookup_closure(made), "lookup_id")


def walked(parents, number):
    """(root, depth, path, in_cycle) step by step."""
    path, seen = [number], {number}
    while parents[path[0]] in parents:
        up = parents[path[0]]
        if up in seen:
            return None, None, None, True
        seen.add(up)
        path.insert(0, up)
    return path[0], len(path) - 1, "/".join(map(str, path)), False


def compare(spark, parents):
    found = closure(spark, parents)
    assert found.keys() == parents.keys()
    for number, row in found.items():
        assert (row["root_id"], row["depth"], row["path"], row["in_cycle"]) == walked(parents, number)


def test_random_trees_with_cycles_and_missing_parents(spark):
    draw = random.Random(7)
    parents = {number: draw.choice([None, draw.randrange(1, 45), draw.randrange(1, 45)]) for number in range(1, 41)}
    parents |= {100: 101, 101: 102, 102: 100, 103: 101, 104: 104}
    compare(spark, parents)


def test_a_chain_and_a_parent_of_many(spark):
    parents = {1: None} | {number: number - 1 for number in range(2, 38)} | {number: 30 for number in range(100, 160)}
    compare(spark, parents)


def test_no_lookups(spark):
    assert closure(spark, {}) == {}
