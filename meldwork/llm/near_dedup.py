"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification, components.

Two permutations make all signature coordinates: the first (a 64-bit bijection) scatters a shingle
over a ring of 2**ring_bits places, the second orders the places, and coordinate k reads it shifted
by k. A shingle's coordinates are therefore one contiguous run of the second permutation. Sets that are
large against that ring use one of 2**64 places, whose second permutation is computed, not read; sets just below the
bound have both signatures, so that every two sets that may be linked share one.

Rows with equal shingle sets form a class; only its smallest id goes on. Bands of the signature make
buckets. First each member's full set is compared with that of the smallest of its bucket, which costs as much as there
are members; a group of copies of one text is done with that. Where a bucket then still holds sets that no confirmed
links join, what hangs together by such buckets is a family: no other link leads out of it. A family's full sets are compared in blocks of bounded size, pair of blocks
by pair of blocks, as products of incidence matrices, and a task returns only a spanning forest of the
links that it confirmed, so pairs never become rows and no group is held whole. A full set is the set of its shingles'
64-bit hashes; two shingles of a pair of sets agree by chance once in 2**64 / (size * size).

Banding finds a pair at the threshold t with probability 1 - (1 - t**r)**b; with r=6, b=32 and
t=0.85 it misses 3 in 10 million such pairs, and fewer of closer ones.

Defined cases: null text or one without words has an empty set and is linked with nothing; a text
with fewer words than a shingle has all of them as its one shingle; with equal ids each row
keeps its own set, and links of any of them count for the id; a null id is its own component (null); columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import map_rows, mix, shingles, words, written
from meldwork.llm.components import among, components, joined_by, looked_up, marked


def _ring(bits: int, k: int) -> np.ndarray:
    """The second permutation over the ring, repeated at its end so that k places can be read from any start."""
    order = np.argsort(mix(np.arange(1 << bits, dtype=np.uint64) + np.uint64(1 << 40)), kind="stable").astype(np.uint32)
    return np.concatenate((order, order[:k]))


def signature(hashes: np.ndarray, ring: np.ndarray, bits: int, k: int) -> np.ndarray:
    """k MinHash coordinates of one set."""
    view = np.lib.stride_tricks.sliding_window_view(ring, k)
    places = (mix(hashes ^ np.uint64(0x5EED)) >> np.uint64(64 - bits)).astype(np.int64)
    best = np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 2048):
        np.minimum(best, view[places[i : i + 2048]].min(axis=0), out=best)
    return best


def wide_signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """k MinHash coordinates of one set over the ring of all 64-bit numbers."""
    places, shifts = mix(hashes ^ np.uint64(0x5EED)), np.arange(k, dtype=np.uint64)
    best = np.full(k, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(places), 1024):
        np.minimum(best, mix(places[i : i + 1024, None] + shifts).min(axis=0), out=best)
    return best


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, percent: int, ring_bits: int = 18) -> DataFrame:
    """(id, n, k1, k2, bands): set size, a 128-bit key of the set, band hashes (twice as many near the bound of large sets)."""
    k, large = bands * rows, 1 << ring_bits - 4
    made: dict[str, np.ndarray] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "ring" not in made:
            made["ring"] = _ring(ring_bits, k)
        h, r, _, _ = words(batch.column(1))
        n = batch.num_rows
        r, h = shingles(h, r, width, n)
        at = np.searchsorted(r, np.arange(n + 1))
        size = np.diff(at)
        keys = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt))))) for salt in (1, 2)]
        keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in keys]
        small, big = (size > 0) & (size < large), size * 100 >= large * percent
        owner = np.concatenate((np.flatnonzero(small), np.flatnonzero(big)))
        out = np.zeros((len(owner), k), np.uint64)
        for j, i in enumerate(owner):
            out[j] = signature(h[at[i] : at[i + 1]], made["ring"], ring_bits, k) if j < small.sum() else wide_signature(h[at[i] : at[i + 1]], k)
        band = np.zeros((len(owner), bands), np.uint64)
        band[small.sum() :] = 1
        for j in range(rows):
            band = mix(band + out[:, j::rows] + np.uint64(j + 1))
        band = band[np.argsort(owner, kind="stable")]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((small.astype(int) + big) * bands))), pa.int32()), pa.array(band.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists], names=["id", "n", "k1", "k2", "bands"])

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), run, "id long, n long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, set): sorted 64-bit shingle hashes, as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, r, _, _ = words(batch.column(1))
        r, h = shingles(h, r, width, batch.num_rows)
        at = np.searchsorted(r, np.arange(batch.num_rows + 1))
        sets = [h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), run, "id long, set binary")


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the shingles that occur twice."""
    sizes, other_sizes = [len(x) for x in sets], [len(x) for x in others]
    flat = np.concatenate([*sets, *others])
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    row = np.concatenate((np.repeat(np.arange(len(sets)), sizes), np.repeat(np.arange(len(others)), other_sizes)))
    mine = np.arange(len(flat)) < sum(sizes)
    total = np.zeros((len(sets), len(others)), np.float32)
    order = np.argsort(number, kind="stable")
    number, row, mine = number[order], row[order], mine[order]
    top = int(number[-1]) + 1 if len(number) else 0
    for low in range(0, top, step):
        i, j = np.searchsorted(number, (low, low + step))
        column, own = number[i:j] - low, mine[i:j]
        left, right = np.zeros((len(sets), step), np.float32), np.zeros((len(others), step), np.float32)
        left[row[i:j][own], column[own]] = 1
        right[row[i:j][~own], column[~own]] = 1
        total += left @ right.T
    return total


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b), numbers of nodes, join two parts that the links before them don't."""
    up = np.arange(int(max(a.max(), b.max())) + 1 if len(a) else 0).tolist()
    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[y] = x
            keep[k] = True
    return keep


def _compare(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links that span the confirmed ones of each family of a group: between its two sides, or within one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        family, ids, n = (table[c].to_numpy() for c in ("family", "id", "n"))
        side = table["own"].to_numpy() > table["other"].to_numpy()
        twin = table["own"].to_numpy() != table["other"].to_numpy()
        sets = table["set"].chunk(0) if table.num_rows else []
        order = np.argsort(family, kind="stable")
        out = [[], []]
        for g in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            left, right = (g[~side[g]], g[side[g]]) if twin[g[0]] else (g, g)
            if not len(left) or not len(right):
                continue
            have = {k: np.frombuffer(sets[int(k)].as_buffer(), np.uint64) for k in g}
            same = _overlaps([have[k] for k in left], [have[k] for k in right])
            # Whole numbers below 2**24, so exact: 100 * same >= percent * (sizes - same).
            linked = (100 + percent) * same >= percent * (n[left][:, None] + n[right][None]).astype(np.float32) if (n[left].max() + n[right].max()) * 200 < 1 << 24 else (100 + percent) * same.astype(float) >= percent * (n[left][:, None] + n[right][None])
            i, j = np.nonzero(linked)
            x, y = left[i], right[j]
            ok = ids[x] < ids[y] if not twin[g[0]] else np.ones(len(x), bool)
            x, y = x[ok], y[ok]
            if len(x):
                keep = forest(x, y)
                out[0].append(ids[x[keep]])
                out[1].append(ids[y[keep]])
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in zip("ab", out, strict=True)})

    return run


def _links(families: DataFrame, percent: int, block: int, most: int = 1024) -> DataFrame:
    """(a, b): links that span the confirmed ones of every family; families is (family, id, n, set).

    Families of at most `block` shingles and `most` members are dealt to bins of about that size. A
    larger one is cut into blocks by a hash of the id, and every pair of blocks is a group of its own.
    """
    spark = families.sparkSession
    sizes = written(families.groupBy("family").agg(F.sum("n").alias("weight"), F.count("*").alias("m")), "near-sizes")
    whole = (F.col("weight") <= block) & (F.col("m") <= most)
    small = sizes.filter(whole).agg(F.sum("weight")).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-small // block))
    parts = F.when(whole, 1).otherwise(F.ceil(F.greatest(F.col("weight") * 2 / block, F.col("m") / most))).cast("int")
    rows = families.join(sizes.select("family", parts.alias("parts")), "family")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.withColumn("group", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.xxhash64("family", low, high)))

    return rows.select("group", "family", "id", "n", "own", "other", "set").groupBy("group").applyInArrow(_compare(percent), "a long, b long")


def _to_first(ties: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): the ties that are links. Members of one first are dealt to groups of about `block` shingles, each with the first's set."""
    weights = written(looked_up(ties, sets.select(F.col("id").alias("a"), F.col("n").alias("first_n")), ["a"]).join(sets.select(F.col("id").alias("b"), "n"), "b"), "near-weights")
    chunks = weights.groupBy("a").agg(F.ceil(F.sum("n") / block + F.count("*") / 256).cast("int").alias("chunks"))
    dealt = written(looked_up(weights.select("a", "b"), written(chunks, "near-chunks"), ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk")), "near-dealt")
    firsts = dealt.select("a", "chunk").distinct().select("a", "chunk", F.col("a").alias("id"), F.lit(1).alias("own"), F.lit(0).alias("other"))
    rows = dealt.select("a", "chunk", F.col("b").alias("id"), F.lit(0).alias("own"), F.lit(1).alias("other")).unionByName(firsts)
    rows = rows.join(sets, "id").select(F.xxhash64("a", "chunk").alias("group"), F.col("a").alias("family"), "id", "n", "own", "other", "set")
    return rows.groupBy("group").applyInArrow(_compare(percent), "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 32, rows: int = 6, block: int = 1 << 19) -> DataFrame:
    """(id, n, class, component) of every row: set size, smallest id with the same set, smallest id reachable by links."""
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    id_col, text_col = "_id", "_text"
    signs = written(signatures(docs, id_col, text_col, width, bands, rows, percent), "near-signatures")
    classes = written(signs.filter("n > 0 AND id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("id").alias("class")), "near-sets-of-rows")
    heads = signs.join(classes.select(F.col("class").alias("id"), "k1", "k2"), ["id", "k1", "k2"], "left_semi")
    slots = heads.select("id", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64(F.col("band") % bands, "hash").alias("bucket"), "id")
    slots = written(slots, "near-slots")
    first = slots.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last").drop("last")
    first = written(first, "near-firsts")
    # Most buckets have one member, and their slots need not be moved again.
    maybe = written(marked(slots, first, ["bucket"]).filter("_may").drop("_may"), "near-slots")
    shared = written(looked_up(maybe, first, ["bucket"]).filter("a IS NOT NULL"), "near-buckets")
    ties = written(shared.filter("a < id").select("a", F.col("id").alias("b")).distinct(), "near-ties")
    members = among(docs, written(shared.select(F.col("id").alias(id_col)).distinct(), "near-members"), [id_col])
    sets = written(_sets(members, id_col, text_col, width).withColumn("n", (F.octet_length("set") / 8).cast("long")), "near-family-sets")
    sure = written(_to_first(ties, sets, percent, block), "near-links")
    joined = components(sure)
    # Buckets that confirmed links don't join: their members, tied to the first, are compared pair by pair.
    labelled = shared.join(joined.withColumnRenamed("node", "id"), "id", "left").select("bucket", "a", "id", F.coalesce("label", "id").alias("label"))
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    of_open = looked_up(shared, written(open_.withColumn("open", F.lit(True)), "near-open"), ["bucket"]).filter("open")
    left = written(of_open.filter("a < id").select("a", F.col("id").alias("b")).distinct(), "near-ties")
    families = components(left).select(F.col("node").alias("id"), F.col("label").alias("family"))
    rest = sets.join(families, "id").select("family", "id", "n", "set")
    further = written(_links(written(rest, "near-family-sets"), percent, block), "near-links")
    labels = written(joined_by(joined, further).select(F.col("node").alias("class"), F.col("label").alias("component")), "labels")
    own = signs.filter("n > 0").select("id", "k1", "k2", "n")
    named = looked_up(written(own, "near-rows"), classes, ["k1", "k2", "n"]).select("id", "n", F.coalesce("class", "id").alias("class"))
    out = looked_up(written(named, "near-rows"), labels, ["class"]).select("id", "n", "class", F.coalesce("component", "class").alias("component"))
    return out.unionByName(signs.filter("n = 0").select("id", "n", F.col("id").alias("class"), F.col("id").alias("component")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document: 3-word shingles, 85 percent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_classes(docs, width=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
