"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meldwork.llm.common import written

#: A key with more than this share of a table's rows, and more rows than a task takes easily, is a hub; so there are at most 1 / SHARE hubs, which fit a broadcast.
SHARE, LEAST = 1e-4, 100_000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows left joined with table, one row a key there, without a task that gets all rows of a hub.

    Both are read several times, so they should be written tables. Rows with a null key keep nulls.
    """
    count, extra = rows.count(), [c for c in table.columns if c not in keys]
    if count <= LEAST:  # no key can have more
        return rows.join(table, keys, "left").select(*rows.columns, *extra)
    bound = max(LEAST, int(count * SHARE))
    hubs = table.join(rows.groupBy(*keys).count().filter(F.col("count") > bound).drop("count"), keys, "left_semi")
    marked = rows.join(F.broadcast(hubs.withColumnsRenamed({c: f"_hub_{c}" for c in extra}).withColumn("_hub", F.lit(True))), keys, "left")
    of_hubs = marked.filter("_hub").select(*rows.columns, *[F.col(f"_hub_{c}").alias(c) for c in extra])
    others = marked.filter("_hub IS NULL").select(*rows.columns)
    return of_hubs.unionByName(others.join(table, keys, "left").select(*rows.columns, *extra))


#: Bits of a bitmap that marked() sends to the tasks: a key's share, and at most in all (half a million rows of two numbers).
BITS, MOST_BITS = 32, 1 << 25


def marked(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a column _may: false where the table surely lacks the row's key. No row is moved for it.

    What is sent to the tasks is a bitmap of the keys' hashes of bounded size, not the keys, so a few rows (most, for tables far beyond
    MOST_BITS keys) have _may without a key there, and a join must decide among them. table should be written: it is read twice.
    """
    bits = min(1 << max(6, (BITS * table.count() - 1).bit_length()), MOST_BITS)
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = table.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_bits"))
    found = rows.withColumn("_bit", bit).join(F.broadcast(words), F.expr("_bit div 64 = _word"), "left")
    return found.select(*rows.columns, F.expr("coalesce(shiftright(_bits, cast(_bit % 64 as int)) & 1, 0) = 1").alias("_may"))


def among(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the written table has; others are left where they are, so that a few wide rows are found among many without moving all."""
    return marked(rows, table, keys).filter("_may").drop("_may").join(table.select(*keys), keys, "left_semi").select(*rows.columns)


def without(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the written table lacks; only those are moved that may have to go."""
    told = marked(rows, table, keys)
    return told.filter("NOT _may").drop("_may").unionByName(told.filter("_may").drop("_may").join(table.select(*keys), keys, "left_anti").select(*rows.columns))


def _relabelled(pairs: DataFrame, table: DataFrame, old: str, new: str) -> DataFrame:
    """The distinct pairs (x, y), written, with both ends looked up in table (old, new), without those whose ends are one then.

    An end that the table lacks stays. Pairs of few rows go through both joins in one job.
    """
    few = pairs.count() <= LEAST
    for end in ("x", "y"):
        own = table.select(F.col(old).alias(end), F.col(new).alias("_new"))
        found = pairs.join(own, end, "left") if few else looked_up(pairs, own, [end])
        pairs = found.withColumn(end, F.coalesce("_new", end)).select("x", "y")
        pairs = pairs if few or end == "y" else written(pairs, "links")
    return written(pairs.filter("x <> y").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node reachable. links should be a written table.

    Every node takes the smallest of itself and its neighbours as its label. Then each round lets labels move:
    a label goes to its own label, or to the smallest label that a link leads to from it. What moves is a table of labels,
    not of nodes, and chains shorten by powers of two. Links within one label are dropped from the next
    round, and every round is written, which cuts the lineage.
    """
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    pairs = _relabelled(links.select(F.col("a").alias("x"), F.col("b").alias("y")), labels, "node", "label")
    while True:
        own = labels.select(F.col("label").alias("old")).distinct()
        up = own.join(labels.select(F.col("node").alias("old"), F.col("label").alias("new")), "old").filter("new < old")
        met = pairs.select(F.greatest("x", "y").alias("old"), F.least("x", "y").alias("new"))
        moves = written(up.unionByName(met).groupBy("old").agg(F.min("new").alias("new")), "moves")
        if moves.isEmpty():
            return labels
        moved = looked_up(labels, moves.select(F.col("old").alias("label"), "new"), ["label"])
        labels = written(moved.select("node", F.coalesce("new", "label").alias("label")), "labels")
        if not pairs.isEmpty():
            pairs = _relabelled(pairs, moves, "old", "new")


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of components(), for the links that gave labels and these further ones together.

    Only labels that a further link joins move, so the work grows with those links, not with all.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    alone = nodes.join(labels.select("node"), "node", "left_anti").withColumn("label", F.col("node"))
    met = _relabelled(links.select(F.col("a").alias("x"), F.col("b").alias("y")), labels, "node", "label")
    if met.isEmpty():
        return labels.unionByName(alone)
    top = components(met.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("top"))
    every = written(labels.unionByName(alone), "labels")
    return looked_up(every, top, ["label"]).select("node", F.coalesce("top", "label").alias("label"))
