"""Document fingerprints from closed syncmers, in DataFrame functions only.

The text is a string of words. A k-mer is k words in a row, its inner substrings are the s-mers; a
k-mer is an anchor (a closed syncmer) if its smallest s-mer, by hash, is its first or its last. That
depends on the k-mer alone, so an anchor survives any edit outside it. The fingerprint is all
anchor hashes in the order of the text, so texts with the same anchors in another order differ; the likeness of two is the Jaccard similarity of the whole sets. placed() gives
the anchors with their word positions, to find passages that two texts share.

The next document's text comes by a window over ranges of the id, cut at quantiles; the first row of
each range is added to the range before it, so every row meets its successor with one shuffle of the
texts and their anchors.

The k-mer's length sets the size: two of k - s + 1 k-mers are anchors. The query takes k = 22 and s = 2, about one anchor in eleven words, a
fingerprint of under a third of the text; a passage that two texts share must have 22 words to give one.

Defined cases: null text is empty; a text with at least one word but no syncmer (always with fewer than k
words, by chance with k or k + 1) has one anchor, all its words; without words the fingerprint is empty, and two empty ones have likeness 1; equal ids
follow each other by text, a null id comes last; a table of one row is followed by itself; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column, k: int = 5, s: int = 2) -> Column:
    """Hashes of the closed syncmers of a text's words; nulls stand where a k-mer is none."""
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    word_hashes = F.transform(found, lambda x: F.xxhash64(x))

    def smers(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, s))))

    def syncmers(w: Column, m: Column) -> Column:
        inner = k - s  # the last s-mer's place in a k-mer
        def anchor(x: Column, i: Column) -> Column:
            edge = F.least(x, F.get(m, i + inner))
            middle = F.least(*(F.get(m, i + j) for j in range(1, inner))) if inner > 2 else F.get(m, i + 1)
            return F.when(edge <= middle, F.xxhash64(x, *(F.get(m, i + j) for j in range(s, inner, s)), F.get(m, i + inner)))
        return F.transform(F.slice(m, 1, F.size(w) - (k - 1)), anchor)

    def of(w: Column) -> Column:
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        found = let(let(smers(w), lambda m: syncmers(w, m)), lambda x: F.when(F.exists(x, F.isnotnull), x).otherwise(few))
        return F.when(F.size(w) < k, few).otherwise(found)

    return let(word_hashes, of)


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two whole anchor sets; 1 of two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, anchor): every anchor of every row with the number of its first word, from 0, for positional matching."""
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.posexplode(anchors(F.coalesce(text_col, F.lit("")))).alias("position", "anchor"))
    return found.filter("anchor IS NOT NULL")


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _ranges(ids: DataFrame, id_col: str, parts: int) -> tuple[Column, int]:
    """The number of the id's range, ranges in descending order of ids, nulls in the last one."""
    step = max(2, int(parts**0.5))
    cuts = sorted(set(ids.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], parts * 20)).first()[0] or []), reverse=True)
    fine, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[step - 1 :: step]))
    whole = F.size(F.filter(coarse, lambda t: t > F.col(id_col))) * step
    number = whole + F.size(F.filter(F.slice(fine, whole + 1, step), lambda t: t > F.col(id_col)))
    return (F.when(F.col(id_col).isNull(), len(cuts)).otherwise(number) if cuts else F.lit(0)), len(cuts) + 1


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, s: int = 2) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    number, _ = _ranges(rows, "id", 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("range", number)
    tops = rows.groupBy("range").agg(F.max("id").alias("top"))  # one row a range
    first = rows.join(F.broadcast(tops.withColumnRenamed("range", "_r")), (F.col("range") == F.col("_r")) & F.col("id").eqNullSafe(F.col("top")))
    first = first.groupBy("range").agg(F.max(F.struct("id", "text")).alias("first"))
    order = sorted(r[0] for r in tops.select("range").collect())
    before = spark.createDataFrame(list(zip(order, [order[-1], *order[:-1]], strict=True)) if order else [], "range int, before int")
    follow = first.join(F.broadcast(before), "range").select("first.id", "first.text", F.col("before").alias("range"), F.lit(1).alias("extra"))
    # A range's extra row closes it, also where its id is above theirs: after the last comes the first.
    both = rows.withColumn("extra", F.lit(0)).unionByName(follow)
    # A text's anchors are taken once, before the exchange, and go to its predecessor with it: a fraction of the text's size.
    both = both.withColumn("anchors", F.array_compact(anchors(F.col("text"), k, s)))
    ahead = Window.partitionBy("range").orderBy("extra", F.desc_nulls_last("id"), F.desc("text"))
    both = both.withColumn("next", F.lead(F.struct("text", "anchors")).over(ahead)).filter("extra = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = both.select("id", n.cast("long").alias("n_chars"), F.col("anchors").alias("own_anchors"), F.col("next.anchors").alias("next_anchors"), edited.alias("edited"))
    out = out.withColumns({"edited_anchors": F.array_compact(anchors(F.col("edited"), k, s)), "edited_sha256": F.sha2("edited", 256), "own_set": F.array_distinct("own_anchors"), "next_set": F.array_distinct("next_anchors")})
    out = out.withColumn("edited_set", F.array_distinct("edited_anchors"))
    return out.select(
        "id", "n_chars", "edited_sha256", printed(F.col("own_anchors")).alias("fingerprint"), printed(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=22).withColumnRenamed("id", "doc_id")
