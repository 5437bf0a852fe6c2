"""Where each lookup stands in the tree of lookups, at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runledger.functions.joins import spread_join
from runledger.session import work_path


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder, so that no round is computed again."""
    path = work_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def lookup_closure(lookups: DataFrame) -> DataFrame:
    """lookup_id, root_id, depth (0 for a root), path (ids from the root down, joined by ``/``) and in_cycle.

    Each row points at an ancestor, at first its parent; in a round it takes over what that
    ancestor points at, so the distance doubles and a tree of depth d takes log2(d) rounds. Rows
    whose parent does not exist are roots. Rows of a cycle, and those below one, still point at
    something when the distance is above the number of rows: they have ``in_cycle`` and no root,
    depth or path. An ancestor that many rows point at is joined in pieces. Ids are unique.
    """
    rows = lookups.select("lookup_id", "parent_lookup_id")
    known = rows.select(F.col("lookup_id").alias("parent_lookup_id"), F.lit(True).alias("known"))
    start = spread_join(rows, known, "parent_lookup_id", "lookup_id", how="left").select(
        "lookup_id", F.when(F.col("known"), F.col("parent_lookup_id")).alias("up")
    )
    start = _written(start, "lookup-parents")
    total = start.count()

    # Roots and depths first: paths of rows in a cycle would grow with the distance.
    at = start.select("lookup_id", "up", F.col("up").isNotNull().cast("long").alias("depth"), F.coalesce("up", "lookup_id").alias("root_id"))
    reach = 1
    while reach <= total and not at.where("up is not null").isEmpty():
        above = at.select(F.col("lookup_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root_id").alias("top"))
        open_rows = at.where("up is not null")
        moved = spread_join(open_rows, above, "up", "lookup_id").select("lookup_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("root_id"))
        at = _written(at.where("up is null").unionByName(moved), "lookup-roots")
        reach *= 2
    cyclic = F.col("up").isNotNull()
    placed = at.select(
        "lookup_id", F.when(~cyclic, F.col("root_id")).alias("root_id"), F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("in_cycle")
    )

    sound = at.where("up is null").select("lookup_id")
    named = start.join(sound, "lookup_id").select("lookup_id", "up", F.col("lookup_id").cast("string").alias("path"))
    while not named.where("up is not null").isEmpty():
        above = named.select(F.col("lookup_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("upper"))
        moved = spread_join(named.where("up is not null"), above, "up", "lookup_id").select(
            "lookup_id", F.col("next").alias("up"), F.concat_ws("/", "upper", "path").alias("path")
        )
        named = _written(named.where("up is null").unionByName(moved), "lookup-paths")
    return placed.join(named.select("lookup_id", "path"), "lookup_id", "left").select("lookup_id", "root_id", "depth", "path", "in_cycle")
