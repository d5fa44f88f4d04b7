"""A Merkle tree over the ordered rows of a table, and what sets two tables apart by it.

Rows are range-sorted by their key and numbered.  A leaf ends after a row whose digest says so, about each 256th, or at 4,096
rows; a node of the next level after one node in 16, or at 256.  So borders depend on the rows beside them alone:
a row that is put in changes its leaf and the path above it.  A node's digest is that of its children's in their order, so
order counts, and any partitioning gives the same tree.

``differing`` walks two trees from their roots and opens only nodes that the other one does not have behind the same
neighbour; ``changes`` compares the rows of the leaves that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.sources.scratch import staged

#: Of so many digests one ends a node (a power of two, at most 4,096), and a node's most children: for leaves, and above.
LEAF, ABOVE = (256, 4096), (16, 256)
#: Rows that one task numbers or scans for borders.
SLAB = 1 << 17


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, key, row, digest, before: rows as JSON, numbered from 0 by ``keys`` and then by themselves; ``before`` is the digest of the row before.

    The order of equal rows does not show in them.  Columns other than the keys may have any names that JSON can tell apart.
    """
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    rows = df.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), text.alias("row"))
    order = [*(f"_key{i}" for i in range(len(keys))), "row", "_at"]
    rows = staged(rows.withColumn("_at", F.monotonically_increasing_id()), "rows")  # deals equal rows, however many, between tasks
    lines = numbered(rows, order).select("n", "key", "row", F.sha2("row", 256).alias("digest"))
    return staged(preceded(lines, F.col("n")), "ordered")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with n from 0 in an order: a range sort, and the sizes of its parts summed, which is a row a task."""
    lines = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("line", F.monotonically_increasing_id()), "lines")
    part, own = F.shiftright("line", 33), F.col("line").bitwiseAND(F.lit((1 << 33) - 1))  # the two halves of a line's number
    sizes = lines.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    base = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("base"))
    return lines.withColumn("part", part).join(F.broadcast(base), "part").withColumn("n", F.col("base") + own).drop("line", "part", "base")


def given(rows: DataFrame) -> DataFrame:
    """n, key, row, digest, before of (n, row), which have their numbers already; the key is null."""
    lines = rows.select("n", F.lit(None).cast("string").alias("key"), "row", F.sha2("row", 256).alias("digest"))
    return staged(preceded(lines, F.col("n")), "ordered")


def preceded(rows: DataFrame, place: Column) -> DataFrame:
    """``rows`` with ``before``, the digest of the row before by place; slabs of places are looked through apart, and each slab's last digest goes to the next."""
    slab = F.floor(place / SLAB)
    own = rows.withColumn("_slab", slab).withColumn("_at", place)
    last = own.groupBy("_slab").agg(F.max_by("digest", "_at").alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(Window.orderBy("_slab"))).drop("_last")  # a row a slab
    inside = F.lag("digest").over(Window.partitionBy("_slab").orderBy("_at"))
    return own.withColumn("before", inside).join(last, "_slab").withColumn("before", F.coalesce("before", "_carry")).drop("_slab", "_at", "_carry")


def parents(nodes: DataFrame, every: int, most: int) -> DataFrame:
    """``nodes`` (n, digest, ...), numbered from 0, with the number ``up`` of the first one that has the same parent."""
    ends = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int") % every == 0
    rows = nodes.withColumn("_slab", F.floor(F.col("n") / SLAB)).withColumn("_end", F.when(ends, F.col("n")))
    carry = rows.groupBy("_slab").agg(F.max("_end").alias("_last"))
    before = Window.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select("_slab", F.max("_last").over(before).alias("_carry"))  # a row a slab
    inside = F.max("_end").over(Window.partitionBy("_slab").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce("_inside", "_carry", F.lit(-1)) + 1
    rows = rows.withColumn("_inside", inside).join(carry, "_slab")
    return rows.withColumn("up", F.col("n") - (F.col("n") - start) % most).drop("_slab", "_end", "_inside", "_carry")


def tree(rows: DataFrame) -> list[DataFrame]:
    """The levels of the tree over ``ordered`` rows, from the rows to the root: each has n, digest, before and ``up``, its parent's ``start``.

    ``start`` is a node's first child's number.  The root's level has one node; an empty table's has none.
    """
    levels = [staged(parents(rows, *LEAF), "level")]
    while True:
        groups = levels[-1].groupBy(F.col("up").alias("start")).agg(F.array_sort(F.collect_list(F.struct("n", "digest"))).alias("_own"))  # of ``most`` at most
        nodes = groups.select("start", F.sha2(F.array_join(F.transform("_own", lambda x: x["digest"]), ""), 256).alias("digest"))
        above = staged(parents(preceded(numbered(nodes, ["start"]), F.col("n")), *ABOVE), "level")
        levels.append(above)
        if above.limit(2).count() < 2:
            return levels


def root(levels: list[DataFrame]) -> str | None:
    """The digest of a whole table in its order; none for an empty one."""
    found = levels[-1].select("digest").first()
    return found and found[0]


def differing(mine: list[DataFrame], theirs: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows of either side in leaves that the other has not, or not behind the same leaf.

    Trees may differ in height: the higher one's upper levels are opened whole.
    """
    sides = [list(mine), list(theirs)]
    least = min(len(mine), len(theirs))
    open_ = [side[least - 1] for side in sides]
    for level in range(least - 1, -1, -1):
        if level == 0:
            return open_[0], open_[1]
        # a node is matched with one node of the other side alone, so of many equal ones the surplus is opened
        twins = [df.withColumn("twin", F.row_number().over(Window.partitionBy("digest", "before").orderBy("n"))) for df in open_]
        same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.before").eqNullSafe(F.col("b.before")) & (F.col("a.twin") == F.col("b.twin"))
        left = [twins[k].alias("a").join(twins[1 - k].select("digest", "before", "twin").alias("b"), same, "left_anti") for k in (0, 1)]
        left = [staged(df.select(F.col("start").alias("up")), "opened") for df in left]
        open_ = [staged(sides[k][level - 1].join(left[k], "up", "left_semi"), "opened") for k in (0, 1)]
    return open_[0], open_[1]


def changes(mine: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """key, change, mine, theirs (row numbers) of rows that set two tables apart: removed, added, changed (one key, another row), or moved (one row, but behind another one).

    Rows of one key are told apart by their content and by how many equal ones are before them.
    """
    from_, to = differing(mine, theirs)
    twin = F.row_number().over(Window.partitionBy("digest").orderBy("n"))
    a, b = (df.select("n", "key", "digest", "before").withColumn("twin", twin) for df in (from_, to))
    both = a.select(F.col("n").alias("mine"), "key", "digest", "twin", F.col("before").alias("was")).join(b.select(F.col("n").alias("theirs"), "key", "digest", "twin", F.col("before").alias("is")), ["key", "digest", "twin"], "full")
    both = staged(both, "rows")
    moved = both.filter(F.col("mine").isNotNull() & F.col("theirs").isNotNull() & ~F.col("was").eqNullSafe(F.col("is"))).select("key", F.lit("moved").alias("change"), "mine", "theirs")
    turn = F.row_number().over(Window.partitionBy("key").orderBy("place"))
    gone = both.filter("theirs is null").select("key", "mine", F.col("mine").alias("place")).withColumn("turn", turn).drop("place")
    new = both.filter("mine is null").select("key", "theirs", F.col("theirs").alias("place")).withColumn("turn", turn).drop("place")
    rest = gone.join(new, ["key", "turn"], "full")
    change = F.when(F.col("theirs").isNull(), "removed").when(F.col("mine").isNull(), "added").otherwise("changed")
    return moved.unionByName(rest.select("key", change.alias("change"), "mine", "theirs"))
