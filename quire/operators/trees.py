"""Trees and graphs as edge tables.

Loops double their reach, or run one join per step of a walk, and cut their lineage
in the shared checkpoint folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage, discard


def reachable(
    seeds: DataFrame, edges: DataFrame, keys: list[str], most: int | None = None, both_ways: bool = False
) -> DataFrame:
    """Nodes reachable from seeds: ``keys, node``; ``edges``: keys, source, target.

    Each round joins only the nodes found in the round before, so an edge is
    followed once; ``most`` bounds the rounds.  Edges are worked out once and each round
    writes only what it found.  Where every edge goes ``both_ways``, a node next to one
    round's is in that round, the one before or the one after, so a round looks no
    further back.
    """
    spark = seeds.sparkSession
    frontier = cut_lineage(seeds.select(*keys, "node").distinct())
    edges = cut_lineage(edges.select(*keys, F.col("source").alias("node"), "target"))
    rounds = [frontier.step_path]
    written = lambda paths: spark.read.schema(frontier.schema).parquet(*paths)
    while not frontier.isEmpty() and (most is None or len(rounds) <= most):
        step = (
            frontier.join(edges, [*keys, "node"])
            .select(*keys, F.col("target").alias("node"))
            .distinct()
            .join(written(rounds[-2:] if both_ways else rounds), [*keys, "node"], "left_anti")
        )
        frontier = cut_lineage(step)
        rounds.append(frontier.step_path)
    return written(rounds)


def unreachable(nodes: DataFrame, seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes no root leads to."""
    return nodes.join(reachable(seeds, edges, keys), [*keys, "node"], "left_anti")


def chained(links: DataFrame, keys: list[str]) -> DataFrame:
    """Place in a linked list: ``keys, node, head, place``; ``links``: keys, node, next.

    Nodes of a closed loop have neither head nor place; the rest is as in ``ranked``.
    """
    back = links.where("next is not null").select(*keys, F.col("next").alias("node"), F.col("node").alias("before"))
    return ranked(links.select(*keys, "node").join(back, [*keys, "node"], "left"), keys)


def ranked(nodes: DataFrame, keys: list[str], told: tuple[str, ...] = (), own: tuple[str, ...] = ()) -> DataFrame:
    """Place in a linked list: ``keys, node, head, place``, what the head has ``told`` and the node's ``own`` columns.

    ``nodes``: keys, node, before (null at the head of a list) and those columns.
    Every node jumps twice as far back in each round, so a list of a million entries takes
    twenty joins, not a million.  A node that has met its head is written once and jumps no
    more; it stays for others to land on only while one does.  So a round reads and writes
    the longer lists alone, and short lists cost what they would without long ones beside
    them.  The rounds end when no node is left, or a list of all nodes would be through;
    nodes of a closed loop have neither head nor place.
    """
    spark = nodes.sparkSession
    place = F.col("before").isNotNull().cast("bigint")
    state = cut_lineage(nodes.select(
        *keys, "node", F.coalesce("before", "node").alias("head"), place.alias("place"), (place == 0).alias("done"), (place == 0).alias("fresh"),
        *[F.when(place == 0, F.col(c)).alias(c) for c in told], *own,
    ))
    columns = state.columns
    most = state.count().bit_length() + 1
    steps = [state]
    for _ in range(most):
        if state.where("not done").isEmpty():
            break
        there = state.select(*keys, F.col("node").alias("head"), F.struct(*[c for c in columns if c not in keys]).alias("there"))
        met = F.col("there.done")
        lands = F.struct(
            F.col("node"), F.col("there.head").alias("head"), (F.col("place") + F.col("there.place")).alias("place"), met.alias("done"), met.alias("fresh"),
            *[F.col(f"there.{c}").alias(c) for c in told], *own,
        )
        stays = F.struct(*[(F.lit(False) if c == "fresh" else F.col(f"there.{c}")).alias(c) for c in columns if c not in keys])
        jumps = state.where("not done").select(*keys, "node", "head", "place", *own).join(there, [*keys, "head"])
        state = cut_lineage(jumps.select(*keys, F.explode(F.when(met, F.array(lands, stays)).otherwise(F.array(lands))).alias("row")).select(*keys, "row.*").select(*columns))
        steps.append(state)
    settled = spark.read.schema(state.schema).parquet(*[step.step_path for step in steps]).where("fresh")
    circling = state.where("not done").select(
        *keys, "node", *[F.lit(None).cast(kind).alias(c) for c, kind in state.dtypes if c in ("head", "place", *told)], *own
    )
    return settled.select(*keys, "node", "head", "place", *told, *own).unionByName(circling)


def outline_rows(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a tree held as first-child / next-sibling links.

    ``nodes``: keys, node, first, next (nullable), is_root (the first top entry).
    Result: keys, node, parent, level, path (``0.2.1``) and the path as numbers, ``order``.
    Siblings are ranked by pointer jumping, and so are the paths put together.  An entry two links lead to keeps the first link met
    (a first-child link, else the lowest node), so a damaged tree stays a tree.  Nodes are read once: each says what it
    leads to, and what is said of an entry is gathered in one grouping.
    """
    kind = dict(nodes.dtypes)["node"]

    def said(node, own=False, top=None, leads=None, parent=None, before=None):
        flags = [F.lit(own).alias("own"), F.lit(top).cast("boolean").alias("top"), F.lit(leads).cast("boolean").alias("leads")]
        return F.struct(F.col(node).cast(kind).alias("node"), *flags, F.lit(parent).cast(kind).alias("parent"), F.lit(before).cast(kind).alias("before"))

    node = F.col("node")
    three = F.array(said("node", True, F.col("is_root"), F.col("first").isNotNull()), said("first", parent=node), said("next", before=node))
    met = (
        nodes.select(*keys, F.explode(three).alias("said")).where("said.node is not null").select(*keys, "said.*")
        .groupBy(*keys, "node")
        .agg(*[F.max(c).alias(c) for c in ("own", "top", "leads")], F.min("parent").alias("parent"), F.min("before").alias("before"))
        .where("own")
    )
    heads = F.col("parent").isNotNull() | F.coalesce("top", F.lit(False))
    linked = met.select(
        *keys, "node", F.when(~heads, F.col("before")).alias("before"), F.coalesce("top", F.lit(False)).alias("top"), "parent", "leads"
    )
    start = ranked(linked, keys, ("top", "parent"), ("leads",)).where("top or parent is not null").select(
        *keys, "node", F.when(~F.col("top"), F.col("parent")).alias("parent"), F.array("place").alias("order"), F.col("top").alias("done"), "leads"
    )
    return climbed(start, keys).select(
        *keys, "node", "parent", F.size("order").alias("level"),
        F.array_join(F.transform("order", lambda n: n.cast("string")), ".").alias("path"), "order",
    )


def climbed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every entry's whole ``order``, from pieces and parent links, by pointer doubling.

    ``rows``, which are read several times: keys, node, parent, order (the piece of the
    entry itself), done (it is a top entry) and leads (others may be under it).  In each
    round an entry takes over what the entry it points at has gathered, and points where
    that points: depth 100 takes seven rounds.  An entry that has arrived is written once.
    Entries are met with those alone that one may still point at: at first those that lead
    to others, then those that these pointed at.  Entries of a depth between two powers of
    two arrive in one round, so a round without arrivals is the last; what has not arrived
    then hangs on no top entry and is left out.
    """
    columns = [*keys, "node", "parent", "above", "order", "done", "leads"]
    state = rows.withColumn("above", F.when(~F.col("done"), F.col("parent"))).select(*columns)
    found, targets = [state.where("done")], state.where("leads")
    while not state.where("not done").isEmpty():
        there = targets.select(
            *keys, F.col("node").alias("above"), F.col("above").alias("further"), F.col("order").alias("gathered"), F.col("done").alias("arrives")
        )
        state = cut_lineage(state.where("not done").join(there, [*keys, "above"]).select(
            *keys, "node", "parent", F.col("further").alias("above"), F.concat("gathered", "order").alias("order"), F.col("arrives").alias("done"), "leads"
        ))
        arrived = state.where("done")
        if arrived.isEmpty():
            break
        found.append(arrived)
        if state.where("not done").isEmpty():
            break
        pointed = targets.where("not done").select(*keys, F.col("above").alias("node")).distinct()
        targets = cut_lineage(targets.where("done").unionByName(state.where("leads")).join(pointed, [*keys, "node"], "left_semi").select(*columns))
    whole = found[0]
    for arrived in found[1:]:
        whole = whole.unionByName(arrived)
    return whole.select(*keys, "node", "parent", "order")


def ancestors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every (entry, ancestor) pair from dotted paths: ``keys, path, ancestor, gap``.

    A path names its ancestors, so no walk is needed: one row per level.
    """
    steps = F.split("path", r"\.")
    return rows.select(*keys, "path", steps.alias("steps")).select(
        *keys, "path", F.size("steps").alias("depth"),
        F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("level"), "steps",
    ).where(F.col("level") < F.col("depth")).select(
        *keys, "path", F.array_join(F.slice("steps", 1, F.col("level")), ".").alias("ancestor"),
        (F.col("depth") - F.col("level")).alias("gap"),
    )


def visible_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Visible descendants of each entry: positive when open, negative when closed, null for a leaf.

    ``rows``: keys, path, open.  A descendant shows when every entry strictly
    between it and the ancestor is open.
    """
    pairs = ancestors(rows, keys)
    state = rows.select(*keys, F.col("path").alias("ancestor"), F.col("open"))
    known = pairs.join(state, [*keys, "ancestor"])
    # Walking up from a descendant: how near is its nearest closed ancestor?
    nearest = known.groupBy(*keys, "path").agg(F.min(F.when(~F.col("open"), F.col("gap"))).alias("closed_at"))
    shown = known.join(nearest, [*keys, "path"]).where(
        F.col("closed_at").isNull() | (F.col("gap") <= F.col("closed_at"))
    )
    counts = shown.groupBy(*keys, F.col("ancestor").alias("path")).agg(F.count("*").alias("n"))
    return rows.join(counts, [*keys, "path"], "left").select(
        *keys, "path", F.when(F.col("open"), F.col("n")).otherwise(-F.col("n")).alias("count")
    )


def promoted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Entries kept after pruning, each under its nearest kept ancestor.

    ``rows``: keys, path, keep -> keys, path, parent_path (null at the top).
    """
    kept = rows.where("keep").select(*keys, "path")
    above = ancestors(kept, keys).join(kept.withColumnRenamed("path", "ancestor"), [*keys, "ancestor"])
    nearest = above.groupBy(*keys, "path").agg(F.min_by("ancestor", "gap").alias("parent_path"))
    return kept.join(nearest, [*keys, "path"], "left")


def inside_subtree(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit(".")))


def subtree_pages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pages touched by each entry, its descendants included: ``keys, path, page``."""
    own = rows.where("page is not null").select(*keys, "path", "page")
    up = ancestors(own.select(*keys, "path").distinct(), keys).join(own, [*keys, "path"]).select(
        *keys, F.col("ancestor").alias("path"), "page"
    )
    return own.unionByName(up).distinct()


def inherited(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` of each entry, or else of the nearest entry above that has one.

    ``rows``: keys, node, parent, and the value.  An entry without a value points at its
    parent, and each round makes pointers twice as long, until they reach a value or the
    top; entries of a closed loop without a value, or under a missing parent, have none.
    """
    state = cut_lineage(
        rows.select(*keys, "node", F.col(value).alias("value"), F.when(F.col(value).isNull(), F.col("parent")).alias("above"))
    )
    for _ in range(state.count().bit_length() + 1):
        if state.where("above is not null").isEmpty():
            break
        target = state.select(*keys, F.col("node").alias("above"), F.col("above").alias("further"), F.col("value").alias("found"))
        moved = state.where("above is not null").drop("value").join(target, [*keys, "above"], "left").select(
            *keys, "node", F.col("found").alias("value"), F.col("further").alias("above")
        )
        before, state = state, cut_lineage(state.where("above is null").unionByName(moved))
        discard(before)
    return state.select(*keys, "node", "value")


def inherited_pages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the page of the nearest entry above that names one: ``keys, node, path, page, order, depth``.

    ``rows``: keys, node, parent, path, page.
    """
    found = inherited(rows, keys, "page").withColumnRenamed("value", "inherited")
    order = F.transform(F.split("path", r"\."), lambda n: n.cast("bigint"))
    return rows.join(found, [*keys, "node"]).select(
        *keys, "node", "path", F.col("inherited").alias("page"), order.alias("order"), F.size(F.split("path", r"\.")).alias("depth")
    )


def resolved_roles(types: DataFrame, roles: DataFrame, keys: list[str], hops: int | None = None) -> DataFrame:
    """Custom types followed through the role map to its end (or ``hops`` times); loops stop.

    ``types``: keys, type; ``roles``: keys, type, role -> keys, type, resolved.
    """
    known = roles.select(*keys, F.col("type").alias("resolved"), "role")
    current = types.select(*keys, "type").distinct().withColumn("resolved", F.col("type")).withColumn("seen", F.array("type"))
    hop, moves = 0, True
    while moves and (hop != hops):
        goes_on = F.col("role").isNotNull() & ~F.array_contains("seen", F.col("role"))
        current = cut_lineage(
            current.join(known, [*keys, "resolved"], "left").select(
                *keys, "type", F.when(goes_on, F.col("role")).otherwise(F.col("resolved")).alias("resolved"),
                F.when(goes_on, F.array_append("seen", F.col("role"))).otherwise(F.col("seen")).alias("seen"),
                F.coalesce(goes_on, F.lit(False)).alias("moved"),
            )
        )
        hop, moves = hop + 1, not current.where("moved").isEmpty()
        current = current.drop("moved")
    return current.select(*keys, "type", "resolved")


def planned_moves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Where each outline entry goes when moved: up, down, in or out.

    ``rows``: keys, path -> keys, path, move, parent, index, result (null when
    the move is impossible).  Sibling numbers are already in the path.
    """
    steps = F.split("path", r"\.")
    parent = F.array_join(F.slice(steps, 1, F.size(steps) - 1), ".")
    place = F.element_at(steps, -1).cast("int")
    shaped = rows.select(*keys, "path", parent.alias("parent"), place.alias("place"))
    siblings = shaped.groupBy(*keys, "parent").agg(F.count("*").alias("siblings"))
    kids = siblings.select(*keys, F.col("parent").alias("into"), F.col("siblings").alias("kids"))
    under = F.when(F.col("parent") == "", F.lit("")).otherwise(F.concat(F.col("parent"), F.lit(".")))
    known = (
        shaped.join(siblings, [*keys, "parent"])
        .withColumn("into", F.when(F.col("place") > 0, F.concat(under, (F.col("place") - 1).cast("string"))))
        .join(kids, [*keys, "into"], "left")
    )
    outer = F.split("parent", r"\.")
    outer_parent = F.array_join(F.slice(outer, 1, F.size(outer) - 1), ".")
    outer_place = F.element_at(outer, -1).cast("int")
    outer_under = F.when(outer_parent == "", F.lit("")).otherwise(F.concat(outer_parent, F.lit(".")))

    def move(name, possible, to_parent, index, result):
        return F.struct(
            F.lit(name).alias("move"), F.when(possible, to_parent).alias("parent"),
            F.when(possible, index).cast("bigint").alias("index"), F.when(possible, result).alias("result"),
        )

    p = F.col("place")
    kids_count = F.coalesce("kids", F.lit(0))
    moves = F.array(
        move("up", p > 0, F.col("parent"), p - 1, F.concat(under, (p - 1).cast("string"))),
        move("down", p < F.col("siblings") - 1, F.col("parent"), p + 2, F.concat(under, (p + 1).cast("string"))),
        move("indent", p > 0, F.col("into"), kids_count, F.concat(F.col("into"), F.lit("."), kids_count.cast("string"))),
        move("outdent", F.col("parent") != "", outer_parent, outer_place + 1, F.concat(outer_under, (outer_place + 1).cast("string"))),
    )
    return known.select(*keys, F.col("path"), F.inline(moves))


def first_per(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """First occurrence wins: the row with the lowest ``by`` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("row")).select(*keys, "row.*")


def names_found(nodes: DataFrame, entries: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Values of wanted names in name trees: ``keys, name, value, steps``.

    ``nodes``: keys, node, parent (null at the root), low and high (the least and the
    greatest name below; null where a node does not say); ``entries``: keys, node, name,
    value; ``wanted``: keys, name.  The descent opens only kids whose limits hold a wanted
    name.  A name visits a node once, so a tree that leads back into itself ends too;
    where a name is found twice the entry nearest the root counts, then the lowest node.
    """
    at = cut_lineage(
        wanted.select(*keys, "name").distinct().join(nodes.where("parent is null").select(*keys, "node"), keys).withColumn("steps", F.lit(0))
    )
    seen, step = at, 0
    kids = nodes.where("parent is not null").select(*keys, F.col("parent").alias("node"), F.col("node").alias("kid"), "low", "high")
    holds = (F.col("low").isNull() | (F.col("low") <= F.col("name"))) & (F.col("high").isNull() | (F.col("name") <= F.col("high")))
    while not at.isEmpty():
        step += 1
        below = at.join(kids, [*keys, "node"]).where(holds).select(*keys, "name", F.col("kid").alias("node")).distinct()
        at = cut_lineage(below.join(seen, [*keys, "name", "node"], "left_anti").withColumn("steps", F.lit(step)))
        seen = cut_lineage(seen.unionByName(at))
    met = seen.join(entries.select(*keys, "node", "name", "value"), [*keys, "node", "name"])
    return met.groupBy(*keys, "name").agg(F.min_by(F.struct("value", "steps"), F.struct("steps", "node")).alias("found")).select(*keys, "name", "found.*")


def names_of(nodes: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """All entries that the roots of name trees lead to: ``keys, name, value``; loops end."""
    edges = nodes.where("parent is not null").select(*keys, F.col("parent").alias("source"), F.col("node").alias("target"))
    there = reachable(nodes.where("parent is null").select(*keys, "node"), edges, keys)
    return entries.join(there, [*keys, "node"]).select(*keys, "name", "value")
