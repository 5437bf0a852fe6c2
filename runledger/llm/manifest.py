"""Merkle manifest of a data set, its levels built by lag and lead windows.

Every row is a leaf. Per partition of the data set the leaves ascend by id, and every ``ARITY``
consecutive nodes become one until one is left, the partition's subroot; the subroots become
the root in the same way. A level is a window over blocks of consecutive leaves: lag and lead by
fixed offsets, masked by a node's slot among its siblings and by the run's length, give its
siblings, and the row of the first child hashes the parent. Blocks hold ``ARITY ** LEVELS``
leaves, so a few rounds of blocks make a tree of any size, and no window sees more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runledger.llm.common import sent_if_small, stored
from runledger.llm.ranks import numbered

ARITY = 2
LEVELS = 10
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 of the values, each as its UTF-8 byte count, a colon and itself; null is a hyphen."""

    def piece(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(piece, columns)), 256)


def climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The nodes with ``block``, ``steps`` (per level the siblings before and after as hex text) and ``top``.

    Nodes have group, place (from 0 in the group), size (nodes of the group) and digest. ``top``
    is the digest that their block of ``arity ** levels`` nodes comes to; where a whole group
    fits into a block, levels above the group's only node are null in ``steps``.
    """
    row = Window.partitionBy("group", "block").orderBy("place")
    known = nodes.withColumn("block", F.expr(f"place div {arity**levels}")).withColumn("node", F.col("digest"))
    names = []
    for level in range(levels):
        width = arity**level
        # A node stands in the row of its first leaf; the others of its run stand at fixed offsets.
        first, slot = F.col("place") % width == 0, F.expr(f"place div {width} % {arity}")
        near = {o: (F.lag if o < 0 else F.lead)("node", abs(o) * width).over(row) for o in range(1 - arity, arity) if o}
        known = known.withColumns({f"near{o}": near[o] for o in near})
        left = F.concat_ws("", *[F.when(slot >= -o, F.col(f"near{o}")) for o in sorted(near) if o < 0])
        right = F.concat_ws("", *[F.when(slot + o < arity, F.col(f"near{o}")) for o in sorted(near) if o > 0])
        above = F.expr(f"size > {width}")  # else this level has one node, and the tree ends here
        step = F.when(first & above, F.struct(left.alias("left"), right.alias("right")))
        parent = F.when(~above, F.col("node")).when((F.col("place") % (width * arity) == 0), F.sha2(F.concat(F.col("node"), right), 256))
        known = known.withColumns({f"step{level}": step, "node": parent}).drop(*[f"near{o}" for o in near])
        names.append(f"step{level}")
    # Rows that are no node of a level take the step of their node, whose row is the last one before them.
    so_far = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = F.array(*[F.last(name, ignorenulls=True).over(so_far) for name in names])
    top = F.first("node").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return known.select(*nodes.columns, "block", steps.alias("steps"), top.alias("top"))


def hashed_up(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS, name: str = "manifest") -> DataFrame:
    """The nodes with ``path`` (all their steps up to the group's top) and ``top``; ``nodes`` is a stored table.

    Each round turns blocks into the nodes of the next one. The number of rounds follows the
    largest group: one for up to ``arity ** levels`` nodes, two for the square of that. On the
    way down a node takes the path of its block's node; the window has dealt it by that key already.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels = next(k for k in range(1, levels + 1) if k == levels or arity**k >= largest)
    width, rounds, now = arity**levels, [climbed(nodes, arity, levels)], nodes
    while largest > width:
        largest = -(-largest // width)
        tops, size = rounds[-1].where(f"place % {width} = 0"), F.expr(f"(size + {width - 1}) div {width}")
        now = stored(tops.select("group", F.col("block").alias("place"), size.alias("size"), F.col("top").alias("digest")), f"{name}-level")
        rounds.append(climbed(now, arity, levels))
    paths = rounds[-1].withColumn("path", F.col("steps"))
    for lower in reversed(rounds[:-1]):
        upper = paths.select(F.col("group").alias("of"), F.col("place").alias("at"), F.col("path").alias("rest"), F.col("top").alias("end"))
        both = lower.join(upper, (F.col("group") == F.col("of")) & (F.col("block") == F.col("at")))
        paths = both.withColumns({"path": F.concat("steps", "rest"), "top": F.col("end")}).drop("of", "at", "rest", "end")
    return paths.withColumn("path", F.filter("path", lambda step: step.isNotNull())).drop("block", "steps", "size")


def folded(leaf: Column, path: Column) -> Column:
    """The digest that a leaf and the siblings on its path come to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(rows: DataFrame, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = LEAF_COLUMNS, tampered: Column | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Per row: key, group, leaf, subroot, root, path (siblings by level up to the root) and folded_root.

    ``tampered`` says how the leaf reads at an audit; it is folded over the original siblings, and
    a root that differs shows the damage. Groups ascend as UTF-8 bytes and leaves by key, null
    first in both; rows of one key go by their digest, so repeated rows are leaves of their own in
    a settled order. Nulls are hyphens and differ from empty text. Long texts are hashed in their
    task, only digests travel; other columns of the rows are not read. An empty table gives no rows.
    """
    read = leaf_digest([F.col(c) for c in columns])
    leaves = rows.select(F.col(key).alias("key"), F.col(group).alias("name"), read.alias("digest"), (read if tampered is None else tampered).alias("audited"))
    ordered = numbered(stored(leaves, "manifest-leaves"), ["name", "key", "digest", "audited"], "manifest-order")
    sizes = ordered.groupBy("name").agg(F.min("place").alias("begin"), F.count("*").alias("size"))
    groups = numbered(sizes, ["name"], "manifest-groups").select(F.col("name").alias("of"), "begin", "size", F.col("place").alias("group"))
    joined = ordered.join(sent_if_small(groups), F.col("name").eqNullSafe(F.col("of")))
    nodes = stored(joined.select("group", (F.col("place") - F.col("begin")).alias("place"), "size", "name", "key", "digest", "audited"), "manifest-nodes")
    lower = hashed_up(nodes, arity, levels).withColumnRenamed("top", "subroot")
    subroots = lower.where("place = 0").select(F.lit(0).alias("group"), F.col("group").alias("place"), F.col("subroot").alias("digest"))
    subroots = stored(subroots, "manifest-subroots")
    upper = hashed_up(stored(subroots.withColumn("size", F.lit(subroots.count())), "manifest-tops"), arity, levels, "manifest-root")
    upper = stored(upper.select(F.col("place").alias("group"), F.col("path").alias("rest"), F.col("top").alias("root")), "manifest-upper")
    found = lower.join(sent_if_small(upper), "group").withColumn("path", F.concat("path", "rest"))
    return found.select(
        F.col("key").alias(key), F.col("name").alias(group), F.col("digest").alias("leaf"), "subroot", "root",
        "path", folded(F.col("audited"), F.col("path")).alias("folded_root"),
    )


def audited_documents(docs: DataFrame, every: int = 7) -> DataFrame:
    """The manifest of documents, audited after a change of n_chars where ``every`` divides the crc32 of the id."""
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % every == 0
    changed = [F.col(c) + F.lit(1) if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]
    tampered = F.when(hit, leaf_digest(changed)).otherwise(leaf_digest([F.col(c) for c in LEAF_COLUMNS]))
    return manifest(docs, tampered=tampered)


# The same tree, folded level by level with recursive queries; crc32 by its table of 256 values.
ORACLE_SQL = """
WITH RECURSIVE bits(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) AS r(b)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
marked AS (
  SELECT doc_id, lang, source, n_chars, text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) % 7 = 0 AS hit
  FROM documents, crc
),
pieces AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS b,
    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS changed,
    coalesce(strlen(text) || ':' || text, '-') AS c, hit
  FROM marked
),
leaves AS (
  SELECT doc_id, lang, sha256(a || b || c) AS leaf, sha256(a || CASE WHEN hit THEN changed ELSE b END || c) AS audited FROM pieces
),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
),
nodes(grp, lvl, place, n, digest) AS (
  SELECT grp, 0, place, n, leaf FROM placed
  UNION ALL
  SELECT grp, lvl + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY grp, lvl, place // 2
),
subroots AS (SELECT grp, digest AS subroot, lvl AS depth FROM nodes WHERE n = 1),
tops(lvl, place, n, digest) AS (
  SELECT 0, grp - 1, count(*) OVER (), subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY lvl, place // 2
),
steps AS (
  SELECT p.grp, p.place, n.lvl, n.place < (p.place >> n.lvl) AS before, n.digest
  FROM placed p JOIN nodes n ON n.grp = p.grp AND n.place = xor(p.place >> n.lvl, 1) AND n.n > 1
  UNION ALL
  SELECT p.grp, p.place, s.depth + t.lvl, t.place < ((p.grp - 1) >> t.lvl), t.digest
  FROM placed p JOIN subroots s ON s.grp = p.grp JOIN tops t ON t.place = xor((p.grp - 1) >> t.lvl, 1) AND t.n > 1
),
alone AS (
  SELECT p.grp, p.place, n.lvl, CAST(NULL AS BOOLEAN) AS before, '' AS digest
  FROM placed p JOIN nodes n ON n.grp = p.grp AND n.place = p.place >> n.lvl AND n.n > 1 AND n.n = n.place + 1 AND n.place % 2 = 0
  UNION ALL
  SELECT p.grp, p.place, s.depth + t.lvl, NULL, ''
  FROM placed p JOIN subroots s ON s.grp = p.grp JOIN tops t ON t.place = (p.grp - 1) >> t.lvl AND t.n > 1 AND t.n = t.place + 1 AND t.place % 2 = 0
),
paths AS (
  SELECT grp, place, list({'before': before, 'digest': digest} ORDER BY lvl) AS path, string_agg(digest, '' ORDER BY lvl) AS proof
  FROM (SELECT * FROM steps UNION ALL SELECT * FROM alone) GROUP BY grp, place
),
folds(grp, place, k, digest) AS (
  SELECT grp, place, 0, audited FROM placed
  UNION ALL
  SELECT f.grp, f.place, k + 1, sha256(CASE WHEN path[k + 1].before THEN path[k + 1].digest || f.digest ELSE f.digest || path[k + 1].digest END)
  FROM folds f JOIN paths p ON p.grp = f.grp AND p.place = f.place WHERE k < len(path)
)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(coalesce(w.proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM placed p JOIN subroots s ON s.grp = p.grp LEFT JOIN paths w ON w.grp = p.grp AND w.place = p.place
JOIN folds f ON f.grp = p.grp AND f.place = p.place AND f.k = coalesce(len(w.path), 0)
CROSS JOIN (SELECT digest FROM tops WHERE n = 1) r
"""
