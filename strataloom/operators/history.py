"""How the ancestors of commits differ, by a cover of the commit graph with chains instead of its closure.

``placed`` deals commits to chains of a child and one of its parents, so a commit's ancestors on a chain are all up to
some place of it.  ``steps`` keeps, for the parents on other chains, from which place on a chain how much of the
other one is reached.  ``reached`` follows steps from the asked commits alone: a row for each asked commit and
chain below it, where a closure has one for each ancestor.  A history in one line has one chain and no steps.

``relation`` needs no such rows.  Each commit's highest parent makes a tree, whose heavy paths are its chains (``laid``), so
a way to the root changes chains log2 of the commits at most.  What a merge adds to its tree parent's ancestors is
found by a walk from its other parents that stops at the tree's way to the root (``walked``), and a pair is a merge of its two
commits.  Sums of these along chains count the ancestors of every commit, and the rest is arithmetic.

Rounds: log2 of the longest chain or way to the root, and for walks as many as a path beside the tree changes chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.sources.scratch import settled, staged

#: Places of a chain that one running sum takes.
BLOCK = 4096


def edges(commits: DataFrame) -> DataFrame:
    """Distinct commit_id, parent_id; a commit without a parent has a row with none."""
    return commits.select("commit_id", "parent_id").filter("commit_id is not null").distinct()


def placed(commits: DataFrame) -> DataFrame:
    """commit_id, chain, place of every commit that is named: a chain has its lowest commit's id, and place 0 is that commit's.

    A commit follows the least of its parents, if it is the least of the commits that chose this one.  A cycle is an error.
    """
    own = edges(commits).filter("parent_id is not null")
    names = edges(commits).select("commit_id").union(own.select("parent_id")).distinct()
    link = own.groupBy("commit_id").agg(F.min("parent_id").alias("low")).groupBy("low").agg(F.min("commit_id").alias("commit_id"))
    first = names.join(link, "commit_id", "left").select("commit_id", F.coalesce("low", "commit_id").alias("low"), F.col("low").isNotNull().cast("long").alias("place"))
    line, known, far = staged(first, "line"), None, 1
    n, total = line.agg(F.count("*"), F.coalesce(F.sum("place"), F.lit(0))).first()
    while total != known:
        if far > 2 * max(n, 1):
            raise ValueError("the commits have a cycle")
        below = line.select(F.col("commit_id").alias("low"), F.col("low").alias("lower"), F.col("place").alias("more"))
        line, far = staged(line.join(below, "low").select("commit_id", F.col("lower").alias("low"), (F.col("place") + F.col("more")).alias("place")), "line"), far * 2
        known, total = total, line.agg(F.coalesce(F.sum("place"), F.lit(0))).first()[0]
    return line.select("commit_id", F.col("low").alias("chain"), "place")


def steps(commits: DataFrame, places: DataFrame) -> DataFrame:
    """chain, since, until, other, place: commits of ``chain`` from place ``since`` on, and before ``until``, reach ``other`` up to ``place`` by one parent on it."""
    child = places.select("commit_id", "chain", F.col("place").alias("since"))
    parent = places.select(F.col("commit_id").alias("parent_id"), F.col("chain").alias("other"), "place")
    across = edges(commits).join(child, "commit_id").join(parent, "parent_id").filter(F.col("chain") != F.col("other"))
    best = across.groupBy("chain", "other", "since").agg(F.max("place").alias("place"))
    up = Window.partitionBy("chain", "other").orderBy("since")
    before = F.max("place").over(up.rowsBetween(Window.unboundedPreceding, -1))
    higher = best.withColumn("before", before).filter("before is null or place > before")
    return higher.select("chain", "since", F.coalesce(F.lead("since").over(up), F.lit((1 << 63) - 1)).alias("until"), "other", "place")


def reached(asked: DataFrame, commits: DataFrame) -> DataFrame:
    """asked, chain, count: how many of each chain's commits, from its lowest one, are an asked commit (commit_id) or its ancestors."""
    places = staged(placed(commits), "places")
    across = staged(steps(commits, places), "steps")
    start = asked.select("commit_id").distinct().join(places, "commit_id")
    known = staged(start.select(F.col("commit_id").alias("asked"), "chain", "place", F.lit(-1).cast("long").alias("old")), "reached")
    while not (new := known.filter("place > old")).isEmpty():
        on = (F.col("n.chain") == F.col("s.chain")) & (F.col("s.since") <= F.col("n.place")) & (F.col("n.place") < F.col("s.until")) & (F.col("s.since") > F.col("n.old"))
        further = new.alias("n").join(across.alias("s"), on).select("n.asked", F.col("s.other").alias("chain"), "s.place", F.lit(-1).cast("long").alias("old"))
        both = known.withColumn("old", F.col("place")).unionByName(further)
        known = staged(both.groupBy("asked", "chain").agg(F.max("place").alias("place"), F.max("old").alias("old")), "reached")
    return known.select("asked", "chain", (F.col("place") + 1).alias("count"))


def doubled(line: DataFrame, size: bool = False) -> DataFrame:
    """The end of each row's way and its length, by jumps of twice the length each round: (commit_id, low, place), place 0 for ends, which are their own ``low``.

    With ``size`` also how many commits have their way through a row, itself included.  A cycle is an error.
    """
    more = ["size"] if size else []
    line, known, far = staged(line.withColumn("size", F.lit(1).cast("long")) if size else line, "line"), None, 1
    n, total = line.agg(F.count("*"), F.coalesce(F.sum("place"), F.lit(0))).first()
    while total != known:
        if far > 2 * max(n, 1):
            raise ValueError("the commits have a cycle")
        below = line.select(F.col("commit_id").alias("low"), F.col("low").alias("lower"), F.col("place").alias("more"))
        new = line.join(below, "low").select("commit_id", F.col("lower").alias("low"), (F.col("place") + F.col("more")).alias("place"), *more)
        if size:  # those at a distance of exactly ``far`` bring all they have within it
            brought = line.filter(F.col("place") == far).groupBy(F.col("low").alias("commit_id")).agg(F.sum("size").alias("brought"))
            new = new.join(brought, "commit_id", "left").select("commit_id", "low", "place", (F.col("size") + F.coalesce("brought", F.lit(0))).alias("size"))
        line, far = staged(new, "line"), far * 2
        known, total = total, line.agg(F.coalesce(F.sum("place"), F.lit(0))).first()[0]
    return line


def laid(commits: DataFrame) -> DataFrame:
    """commit_id, parent_id (the highest, or none), chain, place, depth: the heavy paths of the tree of highest parents.

    A chain goes on with the child that most commits descend from; it has its lowest commit's id.
    """
    own = edges(commits).filter("parent_id is not null")
    names = edges(commits).select("commit_id").union(own.select("parent_id")).distinct()
    parents = staged(names.join(own.groupBy("commit_id").agg(F.max("parent_id").alias("parent_id")), "commit_id", "left"), "parents")
    first = parents.select("commit_id", F.coalesce("parent_id", "commit_id").alias("low"), F.col("parent_id").isNotNull().cast("long").alias("place"))
    tree = parents.join(doubled(first, size=True).select("commit_id", F.col("place").alias("depth"), "size"), "commit_id")
    heavy = tree.filter("parent_id is not null").groupBy("parent_id").agg(F.max_by("commit_id", F.struct("size", "commit_id")).alias("commit_id"))
    tree = staged(tree.join(heavy.select("commit_id", F.lit(1).cast("long").alias("on")), "commit_id", "left"), "tree")
    line = tree.select("commit_id", F.when(F.col("on").isNotNull(), F.col("parent_id")).otherwise(F.col("commit_id")).alias("low"), F.coalesce("on", F.lit(0).cast("long")).alias("place"))
    ends = doubled(line).select("commit_id", F.col("low").alias("chain"), "place")
    return staged(tree.select("commit_id", "parent_id", "depth").join(ends, "commit_id"), "laid")


def ways(tree: DataFrame) -> DataFrame:
    """chain, other, until: the chains that a chain's way to the root takes and up to which place, its own without end."""
    up = tree.select(F.col("commit_id").alias("parent_id"), F.col("chain").alias("over"), F.col("place").alias("until"))
    bases = staged(tree.filter("place = 0 and parent_id is not null").select("chain", "parent_id").join(up, "parent_id").select("chain", "over", "until"), "bases")
    found = new = bases.withColumnRenamed("over", "other")
    above = bases.select(F.col("chain").alias("other"), "over", F.col("until").alias("upto"))
    while not (new := staged(new.join(above, "other").select("chain", F.col("over").alias("other"), F.col("upto").alias("until")), "ways")).isEmpty():
        found = found.unionByName(new)
    own = tree.filter("place = 0").select("chain", F.col("chain").alias("other"), F.lit((1 << 63) - 1).alias("until"))
    return staged(found.unionByName(own), "ways")


def on_way(tree: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows with (chain, at), once for each chain of the way to the root: with ``other`` and ``until``, the last place on it."""
    return commits.join(tree, "chain").withColumn("until", F.least("until", F.when(F.col("other") == F.col("chain"), F.col("at")).otherwise(F.col("until"))))


def walked(tasks: DataFrame, starts: DataFrame, way: DataFrame, across: DataFrame) -> DataFrame:
    """task, chain, place, floor: what the starts (task, chain, place) reach beside the way to the root from the task's commit (task, root, at).

    On each chain all after ``floor``, the way's own last place (-1 for none), up to ``place``; some of it may descend from the way by its merges.
    """
    def cut(rows: DataFrame) -> DataFrame:
        of = rows.join(tasks, "task").join(way.select(F.col("chain").alias("root"), F.col("other").alias("chain"), "until"), ["root", "chain"], "left")
        floor = F.when(F.col("root") == F.col("chain"), F.col("at")).otherwise(F.coalesce("until", F.lit(-1).cast("long")))
        return of.withColumn("floor", floor).filter("place > floor").select("task", "chain", "place", "floor", F.lit(-1).cast("long").alias("old"))

    known = staged(cut(starts.groupBy("task", "chain").agg(F.max("place").alias("place"))), "walk")
    while not (new := known.filter("place > old")).isEmpty():
        on = (F.col("n.chain") == F.col("s.chain")) & (F.col("s.since") <= F.col("n.place")) & (F.col("n.place") < F.col("s.until")) & (F.col("s.since") > F.greatest("n.old", "n.floor"))
        further = new.alias("n").join(across.alias("s"), on).groupBy("n.task", F.col("s.other").alias("chain")).agg(F.max("s.place").alias("place"))
        both = known.withColumn("old", F.col("place")).unionByName(cut(further))
        known = staged(both.groupBy("task", "chain", "floor").agg(F.max("place").alias("place"), F.max("old").alias("old")), "walk")
    return known.select("task", "chain", "place", "floor")


def added(walks: DataFrame, tasks: DataFrame, merges: DataFrame, way: DataFrame) -> DataFrame:
    """task, more: how many commits of its walk are no ancestors of the task's commit, by the walks of the merges (task, on, since) on its way to the root."""
    rows = walks.join(tasks, "task").select("task", F.col("chain").alias("walk"), "place", "floor", F.col("root").alias("chain"), "at")
    asked = on_way(way, rows).select("walk", F.col("other").alias("on"), F.col("until").alias("since"), "task", "place", "floor")
    told = walks.join(merges, "task").select(F.col("chain").alias("walk"), "on", "since", F.lit(None).cast("string").alias("task"), "place", F.lit(None).cast("long").alias("floor"))
    up = Window.partitionBy("walk", "on").orderBy("since").rangeBetween(Window.unboundedPreceding, 0)
    before = F.max(F.when(F.col("task").isNull(), F.col("place"))).over(up)
    best = told.unionByName(asked).withColumn("before", before).filter("task is not null").groupBy("task", "walk").agg(F.max("place").alias("place"), F.greatest(F.max("floor"), F.max("before")).alias("before"))
    return best.groupBy("task").agg(F.sum(F.greatest(F.col("place") - F.col("before"), F.lit(0))).alias("more"))


def counted(tree: DataFrame, way: DataFrame, more: DataFrame) -> DataFrame:
    """commit_id, count of its ancestors and itself, from what each merge (commit_id, more) adds: running sums along chains, block by block, and those of the chains below."""
    rows = tree.join(more, "commit_id", "left").select("commit_id", "chain", "place", (F.coalesce("more", F.lit(0)) + 1).alias("more")).withColumn("block", F.expr(f"place div {BLOCK}"))
    blocks = rows.groupBy("chain", "block").agg(F.sum("more").alias("sum"))
    line = Window.partitionBy("chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("chain", "block", F.coalesce(F.sum("sum").over(line), F.lit(0)).alias("before"))
    own = F.col("before") + F.sum("more").over(Window.partitionBy("chain", "block").orderBy("place"))
    sums = staged(rows.join(blocks, ["chain", "block"]).select("commit_id", "chain", "place", own.alias("sum")), "sums")
    below = way.filter("other != chain").join(sums.select(F.col("chain").alias("other"), F.col("place").alias("until"), "sum"), ["other", "until"]).groupBy("chain").agg(F.sum("sum").alias("below"))
    return sums.join(below, "chain", "left").select("commit_id", (F.col("sum") + F.coalesce("below", F.lit(0))).alias("count"))


def relation(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """stored, current, relation, ahead, behind for distinct pairs of commits: same, ancestor (stored is the current one's), descendant, diverged or unknown.

    ``ahead`` counts what the current one descends from and the stored one does not, itself included; ``behind`` the
    reverse.  A commit that the graph does not name descends from nothing; a pair with a null is unknown, 0 and 0.
    """
    return settled(pairs.sparkSession, "relation", lambda: _relation(pairs, commits))


def _relation(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    distinct = staged(pairs.select("stored", "current").distinct(), "pairs")
    tree = laid(commits)
    way, across = ways(tree), staged(steps(commits, tree), "steps")
    # tasks of pairs walk from the commit that is less deep and stop at the other one's way to the root
    side = lambda name: tree.select(F.col("commit_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("chain", "place", "depth")))
    both = distinct.filter("stored != current").join(side("stored"), "stored").join(side("current"), "current")
    turned = F.col("depth_current") > F.col("depth_stored")
    pick = lambda a, b, name: F.when(turned, F.col(a)).otherwise(F.col(b)).alias(name)
    asked = both.select(F.struct(F.lit(False).alias("merge"), "stored", "current").alias("task"), turned.alias("turned"), pick("chain_current", "chain_stored", "root"), pick("place_current", "place_stored", "at"), pick("chain_stored", "chain_current", "chain"), pick("place_stored", "place_current", "place"))
    # those of merges from the other parents, and stop at the tree parent's
    place = tree.select(F.col("commit_id").alias("parent_id"), F.col("chain").alias("chain"), "place")
    child = tree.filter("parent_id is not null").select("commit_id", F.col("parent_id").alias("first"), F.col("chain").alias("on"), F.col("place").alias("since"))
    merges = edges(commits).join(child, "commit_id").filter("parent_id != first").join(place, "parent_id")
    merges = merges.join(place.select(F.col("parent_id").alias("first"), F.col("chain").alias("root"), F.col("place").alias("at")), "first")
    merges = merges.select(F.struct(F.lit(True).alias("merge"), F.col("commit_id").alias("stored"), F.lit(None).cast(distinct.schema["current"].dataType).alias("current")).alias("task"), "commit_id", "on", "since", "root", "at", "chain", "place")
    asked, merges = (staged(df.withColumn("task", F.to_json("task")), "tasks") for df in (asked, merges))
    tasks = asked.select("task", "root", "at").union(merges.select("task", "root", "at").distinct())
    starts = asked.select("task", "chain", "place").union(merges.select("task", "chain", "place"))
    walks = walked(tasks, starts, way, across)
    more = staged(added(walks, tasks, merges.select("task", "on", "since").distinct(), way), "more")
    counts = staged(counted(tree, way, merges.select("task", "commit_id").distinct().join(more, "task").select("commit_id", "more")), "counts")
    out = distinct
    for name in ("stored", "current"):
        out = out.join(counts.select(F.col("commit_id").alias(name), F.col("count").alias(f"of_{name}")), name, "left")
    own = both.select("stored", "current", turned.alias("turned"), F.to_json(F.struct(F.lit(False).alias("merge"), "stored", "current")).alias("task"))
    own = own.join(more, "task", "left").select("stored", "current", "turned", F.coalesce("more", F.lit(0)).alias("more"))
    out = out.join(own, ["stored", "current"], "left")
    # of the walked side ``more`` are no ancestors of the other one
    s, c = F.coalesce("of_stored", F.lit(0)), F.coalesce("of_current", F.lit(0))
    common = F.when(F.col("stored") == F.col("current"), s).when(F.col("turned"), s - F.col("more")).otherwise(c - F.col("more"))
    out = out.withColumn("common", F.coalesce(common, F.lit(0)))
    named = F.col("stored").isNotNull() & F.col("current").isNotNull()
    behind, ahead = F.when(named, s - F.col("common")).otherwise(0), F.when(named, c - F.col("common")).otherwise(0)
    kind = (
        F.when(F.col("stored") == F.col("current"), "same")
        .when(F.col("common") == 0, "unknown")
        .when(behind == 0, "ancestor")
        .when(ahead == 0, "descendant")
        .otherwise("diverged")
    )
    return out.select("stored", "current", kind.alias("relation"), ahead.cast("long").alias("ahead"), behind.cast("long").alias("behind"))
