"""Parent-child links of unknown depth: circles, heavy paths, depths, paths and descendant intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans import skew
from pagewright.plans.lineage import materialize, materialize_counted, release
from pagewright.plans.skew import skew_join

#: Ways in which the children of one parent are numbered side by side: so many, or one for so many nodes.
SIBLING_BUCKETS, BUCKET_NODES = 64, 500_000
_MAX_ROUNDS = 64


def _no_hot(rows: int) -> list[int] | None:
    """Hot keys of a side with so many rows: surely none, or to be looked for."""
    return [] if rows < skew.LEAST_ROWS else None


def clean_links(links: DataFrame) -> DataFrame:
    """Links (id, parent) as one row per id: rows with a NULL id are left out, of several parents the smallest counts,
    a parent that is no id counts as none. Other columns are left out."""
    nodes = links.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return skew_join(nodes, known, ["parent"], "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def separate_circles(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut every circle at its smallest id.

    Returns the links without circles, id and parent (the smallest id of a circle has no parent any more), and the ids
    at which a circle was cut. Pointer doubling: after k rounds each open node knows the ancestor 2^k steps up and the
    smallest id among those steps; the smallest id of a circle is the only one there that finds itself. Nodes that
    reach a root or a cut leave the rounds, so these are as many as the logarithm of the longest way.
    """
    links = materialize(clean_links(links))
    cut: DataFrame | None = None
    # nodes whose way up isn't known to end yet
    counted = {"rows": F.count(F.lit(1)), "closed": F.count_if(F.col("id") == F.col("least"))}
    state, seen = materialize_counted(links.where("parent is not null").select("id", F.col("parent").alias("jump"), F.col("parent").alias("least")), **counted)
    for _ in range(_MAX_ROUNDS):
        rows, closed = seen["rows"], seen["closed"]
        if rows == 0:
            break
        written = state
        if closed:
            new = materialize(state.where("id = least").select("id"))
            cut = new if cut is None else materialize(cut.union(new))
            # all on the circle have gone round by now and met its smallest id
            state = state.join(new.withColumnRenamed("id", "least"), "least", "left_anti").select("id", "jump", "least")
        up = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("least").alias("least2"))
        # the inner join drops nodes whose ancestor isn't open: their way ends
        following = skew_join(state, up, ["jump"], hot=_no_hot(rows)).select("id", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least"))
        following, seen = materialize_counted(following, **counted)
        release(written)
        state = following
    else:
        raise RuntimeError("the rounds of pointer doubling didn't end")
    release(state)
    if cut is None:
        return links, links.select("id").limit(0)
    acyclic = links.join(cut.withColumn("cut_", F.lit(True)), "id", "left").select("id", F.when(F.col("cut_").isNull(), F.col("parent")).alias("parent"))
    return materialize(acyclic), cut


def double(state: DataFrame, combine: dict[str, Column]) -> DataFrame:
    """Pointer doubling to the end: rows (id, up, values...), `up` NULL at the top. Each round a row takes over its
    ancestor's `up`; `combine` makes the new values from own ones and those of the ancestor, named `<value>_up`."""
    values = [c for c in state.columns if c not in ("id", "up")]
    counted = {"rows": F.count("up")}
    state, seen = materialize_counted(state, **counted)
    for _ in range(_MAX_ROUNDS):
        rows = seen["rows"]
        if rows == 0:
            return state
        going = state.where("up is not null")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up_up"), *[F.col(v).alias(f"{v}_up") for v in values])
        going = skew_join(going, above, ["up"], hot=_no_hot(rows))
        going = going.select("id", F.col("up_up").alias("up"), *[combine[v].alias(v) if v in combine else F.col(v) for v in values])
        following, seen = materialize_counted(going.unionByName(state.where("up is null")), **counted)
        release(state)
        state = following
    raise RuntimeError("the rounds of pointer doubling didn't end")


def resolve(links: DataFrame) -> DataFrame:
    """The topmost ancestor of each node of links (id, parent) that are known to have no circle: id, root."""
    state = links.groupBy("id").agg(F.min("parent").alias("up")).withColumn("root", F.coalesce("up", "id"))
    return double(state, {"root": F.col("root_up")}).select("id", "root")


def subtree_sizes(links: DataFrame) -> DataFrame:
    """Number of nodes in each node's subtree, itself included, of links without circles: id, parent, size.

    Doubling downwards: after k rounds a node counts its descendants less than 2^k steps below; it then takes the counts
    of the nodes exactly 2^k steps below, summed per ancestor before they are shuffled.
    """
    counted = {"rows": F.count("up")}
    state, seen = materialize_counted(links.select("id", "parent", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")), **counted)
    for _ in range(_MAX_ROUNDS):
        rows = seen["rows"]
        if rows == 0:
            return state.drop("up")
        more = state.where("up is not null").groupBy("up").agg(F.sum("size").alias("more")).withColumnRenamed("up", "id")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up_up"))
        following = skew_join(state, above, ["up"], "left", hot=_no_hot(rows)).join(more, "id", "left")
        following, seen = materialize_counted(following.select("id", "parent", F.col("up_up").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), **counted)
        release(state)
        state = following
    raise RuntimeError("the rounds of pointer doubling didn't end")


def heavy_paths(links: DataFrame) -> DataFrame:
    """Heavy-path decomposition of a forest given as links (id, parent), any orderable type.

    Every id gives one row: id, parent, root, depth (steps to the root), size (nodes of its subtree), chain (topmost id of
    its heavy path), pos (steps below it), lo and hi: within one root the descendants of a node, itself included,
    are the nodes with lo <= their lo < hi. on_circle is true for nodes on a circle or leading into one: their root is
    the smallest id of the circle, and their other numbers are those of the tree that is left when the circle is cut
    there. Ids with several parents take the smallest, parents that are no ids count as none, rows with a NULL id are
    left out, an empty input gives no rows.

    A chain goes on to the child with the largest subtree (then the smallest id). So a way up crosses at most log2(n)
    chains: labels along chains and along the tree of chains come from pointer doubling, never from a level at a time.
    """
    acyclic, cut = separate_circles(links)
    sized = subtree_sizes(acyclic)
    heavy = sized.where("parent is not null").groupBy("parent").agg(F.min_by("id", F.struct(-F.col("size"), F.col("id"))).alias("heavy"), F.max("size").alias("heavy_size"))

    # position along chains
    linked = skew_join(sized, heavy, ["parent"], "left")
    linked, seen = materialize_counted(linked.withColumn("is_heavy", F.coalesce(F.col("heavy") == F.col("id"), F.lit(False))), rows=F.count(F.lit(1)))
    buckets = max(SIBLING_BUCKETS, seen["rows"] // BUCKET_NODES)
    chains = double(
        linked.select("id", F.when(F.col("is_heavy"), F.col("parent")).alias("up"), F.when(F.col("is_heavy"), F.col("parent")).otherwise(F.col("id")).alias("chain"), F.when(F.col("is_heavy"), 1).otherwise(0).cast("bigint").alias("pos")),
        {"chain": F.col("chain_up"), "pos": F.col("pos") + F.col("pos_up")},
    ).select("id", "chain", "pos")

    # light children come after the heavy one; their order is that of buckets, then ids, and needs no full sibling list
    light = linked.where("parent is not null and not is_heavy").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    in_bucket = Window.partitionBy("parent", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("ahead", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    totals = light.groupBy("parent", "bucket").agg(F.sum("size").alias("bucket_size"))
    of_parent = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("bucket_ahead", F.coalesce(F.sum("bucket_size").over(of_parent), F.lit(0))).drop("bucket_size")
    light = light.join(totals, ["parent", "bucket"])
    attach = light.select("id", "parent", (1 + F.col("heavy_size") + F.col("bucket_ahead") + F.col("ahead")).alias("step"))

    # the tree of chains: each chain hangs on the node above its top
    above = chains.select(F.col("id").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("above_pos"))
    heads = linked.where("not is_heavy").select("id")
    hung = skew_join(attach, above, ["parent"]).select("id", "up", (F.col("above_pos") + 1).alias("base"), (F.col("above_pos") + F.col("step")).alias("start"))
    tops = heads.join(hung, "id", "left").select("id", "up", F.coalesce("up", "id").alias("root"), F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("start", F.lit(0)).alias("start"))
    tops = double(tops, {"root": F.col("root_up"), "base": F.col("base") + F.col("base_up"), "start": F.col("start") + F.col("start_up")})

    rows = chains.join(linked.select("id", "parent", "size"), "id")
    rows = skew_join(rows, tops.select(F.col("id").alias("chain"), "root", "base", "start"), ["chain"])
    marked = cut.select(F.col("id").alias("root"), F.lit(True).alias("on_circle"))
    rows = skew_join(rows, marked, ["root"], "left")
    lo = F.col("start") + F.col("pos")
    return rows.select("id", "parent", "root", (F.col("base") + F.col("pos")).alias("depth"), "size", "chain", "pos", lo.alias("lo"), (lo + F.col("size")).alias("hi"), F.coalesce("on_circle", F.lit(False)).alias("on_circle"))


def chain_paths(forest: DataFrame) -> DataFrame:
    """Full paths from heavy_paths(): id, path (ids from the root down to the node), NULL for nodes at circles.

    Each chain's members are listed once (never longer than the longest path given out), the prefixes of chains are
    concatenated by doubling along the tree of chains, and a node's path is its chain's prefix and a slice of the list.
    """
    tree = forest.where("not on_circle")
    members = tree.groupBy("chain").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda m: m["id"]).alias("members"))
    tops = tree.where("pos = 0").select("id", "parent")
    hooks = tree.select(F.col("id").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("at"))
    hooked = skew_join(tops.where("parent is not null"), hooks, ["parent"])
    hooked = skew_join(hooked, members.withColumnRenamed("chain", "up"), ["up"]).select("id", "up", F.slice("members", F.lit(1), (F.col("at") + 1).cast("int")).alias("prefix"))
    empty = F.slice(F.array("id"), 1, 0)
    state = tops.where("parent is null").select("id", F.lit(None).cast(tree.schema["id"].dataType).alias("up"), empty.alias("prefix")).unionByName(hooked)
    prefixes = double(state, {"prefix": F.concat("prefix_up", "prefix")}).select(F.col("id").alias("chain"), "prefix")
    whole = prefixes.join(members, "chain")
    rows = skew_join(tree.select("id", "chain", "pos"), whole, ["chain"])
    paths = rows.select("id", F.concat("prefix", F.slice("members", F.lit(1), (F.col("pos") + 1).cast("int"))).alias("path"))
    return paths.unionByName(forest.where("on_circle").select("id", F.lit(None).cast(paths.schema["path"].dataType).alias("path")))


def descendants(forest: DataFrame, asked: DataFrame) -> DataFrame:
    """All proper descendants of the nodes in `asked` (column id), from the intervals of heavy_paths(): id, descendant.

    Places in a tree are dense, so an interval is written out as its places, one for each descendant, and each place
    belongs to one node: an equi join on (root, place) whose work is that of its result. `forest` must hold whole trees.
    """
    wanted = asked.select("id").distinct().join(forest.select("id", "root", "lo", "hi"), "id").where("hi > lo + 1")
    blocks = wanted.select("id", "root", "hi", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1, F.lit(4096).cast("bigint"))).alias("from_"))
    places = blocks.select("id", "root", F.explode(F.sequence("from_", F.least(F.col("from_") + 4095, F.col("hi") - 1))).alias("lo"))
    return places.join(forest.select("root", "lo", F.col("id").alias("descendant")), ["root", "lo"]).select("id", "descendant")
