"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, with cycles reported.

A deterministic hash chooses one node in `SPLITTER_RATE` as a splitter. Every node walks up to its next splitter or
root, in rounds that double the way walked; a node at which a walk without a splitter ends is made one too, so long
chains and cycles without splitters join the reduced graph. The splitters' pointers, a graph smaller by that rate, are
solved by pointer doubling, and each node's answer is its walk joined with its splitter's. Paths are not carried through
the doubling: the splitters above each splitter are listed once at the end as rows, and the walks between them put
together. All state is in tables; nothing is collected, and the number of rounds grows with the logarithm of the
longest chain, whatever the cycles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.util import materialise

SPLITTER_RATE = 4
WALK_ROUNDS = 4  # a walk ends after 2 ** WALK_ROUNDS links


def clean_key(col: Column | str) -> Column:
    """A link without the blanks around it; null where nothing is left."""
    trimmed = F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    return F.when(trimmed != "", trimmed)


def resolve_hierarchy(links: DataFrame, *, paths: bool = False) -> DataFrame:
    """For `links` (tab, scope, node_id, parent_id): one row per node with `root_id`, `depth` and, with `paths`,
    `path` (the node, then its ancestors up to the root).

    A parent is looked up within the node's (tab, scope). `root_id` is the last existing node on the way up and
    `depth` the number of links to it: 0 without a parent or with one that does not exist. If the way up never ends,
    `root_id` is '-', `depth` -1 and `path` null. `parent_id` comes out as the node's parent (null: none). Rows
    repeated for one node count once, the smallest non-null parent winning; null node ids are left out, a null tab
    or scope is a scope of its own. Columns besides the four are ignored. An empty table gives an empty result.
    """
    nodes = links.where(F.col("node_id").isNotNull()).groupBy("tab", "scope", "node_id").agg(F.min("parent_id").alias("parent_id"))
    known = _as_right(nodes.select("tab", "scope", "node_id"))
    up = F.col("_node_id")
    splitter = F.pmod(F.xxhash64("tab", "scope", up), F.lit(SPLITTER_RATE)) == 0
    trail = [F.when(up.isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("node_id")).alias("trail")] if paths else []

    # Walks: `cur` is the node reached, `dist` the links to it, `trail` the nodes before it, `stop` whether it is a
    # splitter or a root. A root has walked to itself.
    walks = materialise(nodes.join(known, _same("parent_id"), "left").select(
        "tab", "scope", "node_id", "parent_id", F.coalesce(up, F.col("node_id")).alias("cur"), F.when(up.isNull(), 0).otherwise(1).alias("dist"),
        *trail, (up.isNull() | splitter).alias("stop"), up.isNull().alias("root"),
    ))
    roots = walks.where("root").select("tab", "scope", "node_id", F.col("node_id").alias("cur"), F.lit(0).alias("dist"))
    stopped, going, over = [walks.where("stop")], walks.where("not stop"), False
    for _ in range(WALK_ROUNDS):
        if over := going.isEmpty():
            break
        on = _as_right(_union([*stopped, going]).drop("parent_id", "root"))
        moved = materialise(going.join(on, _same("cur")).select(
            "tab", "scope", "node_id", "parent_id", F.col("_cur").alias("cur"), (F.col("dist") + F.col("_dist")).alias("dist"),
            *([F.concat("trail", "_trail").alias("trail")] if paths else []), F.col("_stop").alias("stop"), F.col("root"),
        ))
        stopped, going = [*stopped, moved.where("stop")], moved.where("not stop")
    walks = _union([*stopped, going])

    # The reduced graph: splitters, and nodes at which a walk ended without one.
    own = F.pmod(F.xxhash64("tab", "scope", "node_id"), F.lit(SPLITTER_RATE)) == 0
    inner = walks.where(~F.col("root"))
    reduced = inner.where(own)
    if not over:
        made = _as_right(going.select("tab", "scope", F.col("cur").alias("node_id")).distinct())
        reduced = reduced.unionByName(inner.where(~own).join(made, _same("node_id"), "left_semi"))
    reduced = materialise(reduced.drop("parent_id", "stop", "root"))
    slim = ["tab", "scope", "node_id", "cur", "dist"]
    rounds, ended, open_ = [], [], reduced.select(*slim)
    while not open_.isEmpty():
        rounds.append(open_)
        by = _union([x.select(*slim, F.lit(True).alias("end")) for x in (roots, *ended)] + [open_.select(*slim, F.lit(False).alias("end"))])
        moved = materialise(open_.join(_as_right(by), _same("cur")).select("tab", "scope", "node_id", F.col("_cur").alias("cur"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_end").alias("end")))
        ended.append(moved.where("end").select(*slim))
        open_ = moved.where("not end").select(*slim)
        # Above an open node that does end stands one that ends in the next round: if none did, only cycles are left.
        if ended[-1].isEmpty():
            break
    tops = _union([x.select(*slim) for x in (roots, *ended)])
    if paths:
        tops = _with_paths(tops, reduced, rounds)
    tail = ["_tail"] if paths else []
    answers = walks.join(_as_right(tops), _same("cur"), "left").select("tab", "scope", "node_id", "parent_id", "dist", *(["trail"] if paths else []), "_cur", "_dist", *tail)
    return answers.select(
        "tab", "scope", "node_id", "parent_id", F.coalesce("_cur", F.lit("-")).alias("root_id"),
        F.coalesce(F.col("dist") + F.col("_dist"), F.lit(-1)).cast("int").alias("depth"), *([F.concat("trail", "_tail").alias("path")] if paths else []),
    )


def _with_paths(tops: DataFrame, reduced: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """`tops` with `tail`, the nodes from a splitter or root up to its root.

    Round k of the doubling left each splitter with the splitter 2 ** k above it; joined with the splitters above that
    one, these rows list all splitters above each, once.
    """
    ends = _as_right(tops.select("tab", "scope", "node_id"))
    above: list[DataFrame] = []
    for k, jumps in enumerate(rounds):
        jumps = jumps.join(ends, _same("node_id"), "left_semi")
        if k == 0:
            above.append(materialise(jumps))
        far = jumps.join(_as_right(_union(above)), _same("cur")).select("tab", "scope", "node_id", F.col("_cur").alias("cur"), (F.col("dist") + F.col("_dist")).alias("dist"))
        above.append(materialise(far))
    walks = reduced.select("tab", "scope", "node_id", "trail")
    if not above:
        return tops.withColumn("tail", F.array("cur"))
    parts = _union(above).join(_as_right(walks), _same("cur")).groupBy("tab", "scope", "node_id").agg(F.array_sort(F.collect_list(F.struct("dist", F.col("_trail").alias("trail")))).alias("parts"))
    # A splitter's own walk comes first; a root has none, and a splitter right below its root no parts.
    first = tops.join(_as_right(walks), _same("node_id"), "left").select("tab", "scope", "node_id", "cur", "dist", F.coalesce("_trail", F.expr("cast(array() as array<string>)")).alias("walk"))
    out = first.join(_as_right(parts), _same("node_id"), "left")
    rest = F.coalesce(F.flatten(F.transform("_parts", lambda x: x["trail"])), F.expr("cast(array() as array<string>)"))
    return out.select("tab", "scope", "node_id", "cur", "dist", F.concat("walk", rest, F.array("cur")).alias("tail"))


def _as_right(frame: DataFrame) -> DataFrame:
    """`frame` as the right side of a join, with its columns' names marked."""
    return frame.select(*[F.col(c).alias(f"_{c}") for c in frame.columns])


def _same(col: str) -> Column:
    """The join of `col` on the right side's node, within one scope."""
    return F.col("tab").eqNullSafe(F.col("_tab")) & F.col("scope").eqNullSafe(F.col("_scope")) & (F.col(col) == F.col("_node_id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def descendants(resolved: DataFrame) -> DataFrame:
    """(tab, scope, ancestor_id, node_id, distance) for every node and each node above it, from a result with paths."""
    up = resolved.where(F.size("path") > 1).select("tab", "scope", "node_id", F.posexplode("path").alias("distance", "ancestor_id"))
    return up.where("distance > 0").select("tab", "scope", "ancestor_id", "node_id", "distance")
