"""The process forest: nodes, ancestry, roots, subtrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.scalars import basename, present
from emberwatch.model import PROCESS_TTL_S, epoch_us, severity_rank
from emberwatch.session import checkpointed


def process_nodes(events: DataFrame) -> DataFrame:
    """One node per (host, guid) from every event that names a process.

    Attributes are the first non-empty ones in arrival order; `first_seen` is the
    time of the first arrival, `last_seen` the latest time.
    """
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c) != "", F.col("seq")))
    return (
        events.filter(F.col("process_guid") != "")
        .groupBy("host", F.col("process_guid").alias("guid"))
        .agg(
            first("parent_process_guid").alias("parent_guid"), first("image").alias("image"),
            first("command_line").alias("command_line"), F.min_by("timestamp", "seq").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
        .withColumn("name", basename(F.col("image"), "unknown"))
    )


def parent_child_join(nodes: DataFrame) -> DataFrame:
    """(host, parent, child) links whose parent was observed."""
    parents = nodes.select("host", F.col("guid").alias("parent_guid"), F.col("name").alias("parent_name"))
    return nodes.select("host", "parent_guid", F.col("guid").alias("child_guid"), F.col("name").alias("child_name")).join(
        parents, ["host", "parent_guid"]
    )


def _guids(path: Column) -> Column:
    return F.transform(path, lambda s: s["guid"])


def _cut(path: Column) -> Column:
    """The part of a path before its first repeated node."""
    ids = _guids(path)
    repeats = F.filter(
        F.transform(ids, lambda g, i: F.when(F.array_position(ids, g) <= i, i)), lambda i: i.isNotNull()
    )
    return F.slice(path, F.lit(1), F.coalesce(F.array_min(repeats).cast("int"), F.size(path)))


def ancestry(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(host, guid, path, images, seen): the observed ancestors of each node, root first; all, or the nearest `max_depth`.

    Upward paths double in length each round: a path is extended by the path of
    its last node. Only unfinished paths are joined and written again, so the shallow
    trees endpoints produce finish in two or three rounds. Each step carries its image
    and first sighting, so chains and display rows need no further join.
    """
    limited = lambda path: path if max_depth is None else F.slice(path, 1, max_depth)
    step = F.struct("guid", "image", epoch_us(F.col("first_seen")).alias("us"))
    links = nodes.select("host", "guid", "parent_guid", step.alias("_self"))
    known = nodes.select("host", F.col("guid").alias("parent_guid"), step.alias("_parent"))
    paths = links.join(known, ["host", "parent_guid"], "left").select(
        "host", "guid",
        F.when(F.col("_parent").isNotNull(), F.array("_self", "_parent")).otherwise(F.array("_self")).alias("up"),
        F.col("_parent").isNotNull().alias("open"),
    )
    done, current, reach = [], checkpointed(paths), 1
    while True:
        open_paths = current.filter("open")
        if (max_depth is not None and reach >= max_depth) or open_paths.isEmpty():
            done.append(current)
            break
        done.append(current.filter("NOT open"))
        onward = reduce(DataFrame.unionByName, [*done, open_paths]).select(
            "host", F.col("guid").alias("_tail"), F.col("up").alias("_more"), F.col("open").alias("_on"))
        more = F.slice("_more", F.lit(2), F.greatest(F.size("_more") - 1, F.lit(0)))
        grown = open_paths.withColumn("_tail", F.element_at("up", -1)["guid"]).join(onward, ["host", "_tail"]).select(
            "host", "guid", limited(F.concat("up", more)).alias("up"), F.col("_on").alias("open"))
        if max_depth is not None:
            grown = grown.withColumn("open", F.col("open") & (F.size("up") < max_depth))
        # A path that ran into a cycle is final: its repeats are cut below.
        current = checkpointed(grown.withColumn(
            "open", F.col("open") & (F.size(F.array_distinct(_guids(F.col("up")))) == F.size("up"))))
        reach *= 2
    up = limited(F.col("up"))
    down = reduce(DataFrame.unionByName, done).select("host", "guid", F.reverse(_cut(up)).alias("_d"))
    return down.select(
        "host", "guid", _guids(F.col("_d")).alias("path"), F.transform("_d", lambda s: s["image"]).alias("images"),
        F.transform("_d", lambda s: s["us"]).alias("seen"),
    )


def tree_root(nodes: DataFrame) -> DataFrame:
    """(host, guid, root_guid, depth): the topmost observed ancestor, without any path.

    Pointers double: each node points ahead, and each round it points where its pointer points. Only nodes that have not
    reached a root are written again, as (host, guid, pointer, steps), so the rounds grow with the logarithm of the depth.
    Nodes at all smaller depths lie before a deep one; once a round ends no node's way, what is left goes round in a cycle
    or leads into one, and there the root is the last node before the first repeated one, as on a path.
    """
    known = nodes.select("host", F.col("guid").alias("parent_guid"), F.lit(True).alias("_known"))
    links = nodes.select("host", "guid", "parent_guid").join(known, ["host", "parent_guid"], "left")
    ahead = checkpointed(links.select(
        "host", "guid", F.when(F.col("_known"), F.col("parent_guid")).otherwise(F.col("guid")).alias("root_guid"),
        F.when(F.col("_known"), 1).otherwise(0).alias("depth"), F.col("_known").isNull().alias("_there")))
    done, left, before = [ahead.filter("_there")], ahead.filter("NOT _there"), None
    while (now := left.count()) and now != before:
        onward = reduce(DataFrame.unionByName, [*done, left]).select(
            "host", F.col("guid").alias("root_guid"), F.col("root_guid").alias("_to"), F.col("depth").alias("_more"), "_there")
        moved = checkpointed(left.drop("_there").join(onward, ["host", "root_guid"]).select(
            "host", "guid", F.col("_to").alias("root_guid"), (F.col("depth") + F.col("_more")).alias("depth"), "_there"))
        done.append(moved.filter("_there"))
        left, before = moved.filter("NOT _there"), now
    roots = reduce(DataFrame.unionByName, done).drop("_there")
    if now:
        looped = nodes.join(left.select("host", "guid"), ["host", "guid"], "left_semi")
        roots = roots.unionByName(path_roots(ancestry(looped)))
    return roots


def path_roots(paths: DataFrame) -> DataFrame:
    return paths.select("host", "guid", F.element_at("path", 1).alias("root_guid"), (F.size("path") - 1).alias("depth"))


def trees_with(nodes: DataFrame, roots: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the trees in which a process of `rows` (host, process_guid) stands."""
    wanted = rows.filter("process_guid <> ''").select("host", F.col("process_guid").alias("guid")).distinct()
    trees = roots.join(wanted, ["host", "guid"], "left_semi").select("host", "root_guid").distinct()
    members = roots.join(trees, ["host", "root_guid"], "left_semi").select("host", "guid")
    return nodes.join(members, ["host", "guid"], "left_semi")


def incident_process_tree(incidents: DataFrame, members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per incident and process of its tree: what the process is, how deep it stands, and its detections there.

    An incident's root is the top of a tree, so its processes are found by equality on the root, without a walk. An incident
    of a process that was never observed has no rows.
    """
    placed = nodes.join(roots, ["host", "guid"]).select(
        "host", "root_guid", "guid", "parent_guid", "depth", "name", "image", "command_line", "first_seen", "last_seen")
    counts = members.groupBy("incident_id", F.col("process_guid").alias("guid")).agg(
        F.count("*").alias("detections"), F.max(F.coalesce(severity_rank(F.col("severity")), F.lit(2))).alias("_rank"))
    rows = incidents.select(F.col("id").alias("incident_id"), "host", "root_guid").join(placed, ["host", "root_guid"])
    return rows.join(counts, ["incident_id", "guid"], "left").select(
        "incident_id", "guid", "parent_guid", "depth", "name", "image", "command_line", "first_seen", "last_seen",
        F.coalesce("detections", F.lit(0)).alias("detections"),
        F.get(F.lit(["info", "low", "medium", "high", "critical"]), F.col("_rank")).alias("worst_severity"))


def process_chain(paths: DataFrame) -> DataFrame:
    """(host, guid, root_guid, root_image, chain): image names along each path, root first."""
    return paths.select(
        "host", "guid", F.element_at("path", 1).alias("root_guid"), F.element_at("images", 1).alias("root_image"),
        F.transform("images", lambda i: basename(i, "unknown")).alias("chain"),
    )


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every observed descendant of each root (host, root_guid), the root included when observed.

    Walks down level by level without a depth limit; a node reached twice is kept once.
    """
    links = nodes.select("host", F.col("parent_guid").alias("_at"), "guid")
    level = checkpointed(roots.select("host", "root_guid", F.col("root_guid").alias("guid")).distinct())
    reached = level
    while True:
        below = level.select("host", "root_guid", F.col("guid").alias("_at")).join(links, ["host", "_at"])
        level = checkpointed(
            below.select("host", "root_guid", "guid").distinct().join(reached, ["host", "root_guid", "guid"], "left_anti")
        )
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached.join(
        nodes.select("host", "guid", "parent_guid", "image", "name", "command_line", "first_seen", "last_seen"),
        ["host", "guid"],
    )


def tree_rows(paths: DataFrame) -> DataFrame:
    """Display rows with depth; sorting by `sort_key` gives depth-first order, siblings by first sighting."""
    steps = F.transform(
        F.arrays_zip("seen", "path"),
        lambda s: F.concat(F.lpad(s["seen"].cast("string"), 17, "0"), F.lit("|"), s["path"]),
    )
    return paths.select(
        "host", "guid", F.element_at("path", 1).alias("root_guid"), (F.size("path") - 1).alias("depth"),
        F.array_join(steps, "/").alias("sort_key"),
    )


def tree_prune(nodes: DataFrame, as_of: Column, ttl_s: int = PROCESS_TTL_S) -> DataFrame:
    return nodes.filter(epoch_us(F.col("last_seen")) >= epoch_us(as_of) - ttl_s * 1_000_000)


def node_detection_join(nodes: DataFrame, detections: DataFrame) -> DataFrame:
    """Nodes with their detection count and worst severity.

    Matched by process; detections without one flag nodes of the same image name.
    """
    ranked = detections.select(
        "host", "process_guid", F.lower(F.coalesce(basename(F.col("image")), F.lit(""))).alias("_name"),
        F.coalesce(severity_rank(F.col("severity")), F.lit(2)).alias("_rank"),
    )
    has_guid = F.coalesce(F.col("process_guid") != "", F.lit(False))
    by_guid = ranked.filter(has_guid).groupBy("host", F.col("process_guid").alias("guid")).agg(
        F.count("*").alias("_n"), F.max("_rank").alias("_g"))
    by_name = ranked.filter(~has_guid).groupBy("host", "_name").agg(F.max("_rank").alias("_f"))
    levels = F.lit(["info", "low", "medium", "high", "critical"])
    return (
        nodes.withColumn("_name", F.lower("name")).join(by_guid, ["host", "guid"], "left").join(by_name, ["host", "_name"], "left")
        .select(*nodes.columns, F.coalesce("_n", F.lit(0)).alias("detections"),
                F.get(levels, F.coalesce("_g", "_f")).alias("worst_severity"))
    )
