"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

A document's evidence is the sum of logistic heads (one a label: low quality, toxic) over hashed
words and word beginnings that pass a screening test and some style measures. The heads are fitted on a bounded sample of
labelled rows: the `sample` rows with the smallest hash of their id, at most `most` words a head. All labels are then
grouped by site: a host's rate of bad documents is shrunk toward the global rate and a path's toward its host's, each by the
weight that the method of moments finds in the spread between groups, so sparse sites stay near their
prior. Documents are dealt to FOLDS folds by their id, and a fold's rates come from the labels of the others, so no
label speaks for its own document. The document's log-odds move by the path's log-odds against the global ones. A document is
rejected where any head's probability of being bad reaches the threshold. Each text is scored once.

Defined cases: null text is empty: no words, style of nothing; rows without a host or path fall to the
group of nulls; labels for unknown documents, and null labels, are ignored, several labels of one
document count as the worst; without labels of both kinds a head says 0 and rejects nothing; equal ids
are scored row by row; every column of the documents is kept, whatever its name; columns named _p_low, _p_toxic or
_keep are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import aside, map_rows, mix, restored, text_bytes, words, written

BITS = 20
_MASK = (1 << BITS) - 1
#: Bytes of a word's beginning, which stands for its inflected forms.
HEAD = 5
HEADS = ("low", "toxic")
FOLDS = 5
STYLE = 8
#: Groups that a broadcast may hold; with more, posteriors are joined by shuffle.
MAX_BROADCAST_GROUPS = 100_000


def features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, hashed features, style): each row's distinct words and word beginnings, hashed, and STYLE measures a row.

    wanted says which of the hashed features the caller needs; None is all.
    """
    h, r, _, _ = words(column)
    n = len(column)
    begin = mix(words(column, head=HEAD)[0] ^ np.uint64(HEAD))
    word, begin = ((x >> np.uint64(64 - BITS)).astype(np.int64) for x in (h, begin))
    here = r.astype(np.int64) << BITS
    distinct_words = np.unique(here | word)
    some = (slice(None), slice(None)) if wanted is None else (wanted[distinct_words & _MASK], wanted[begin])
    pair = np.unique(np.concatenate((distinct_words[some[0]], (here | begin)[some[1]])))
    body, at = text_bytes(column)
    count, distinct = np.bincount(r, minlength=n), np.bincount(distinct_words >> BITS, minlength=n)
    length = np.diff(at)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(length, 1)

    mark = np.zeros(256, bool)
    mark[[ord(c) for c in "!#$%&*|<>{}=~^@\\/_+"]] = True
    style = np.stack((
        share((body >= 65) & (body <= 90)), share(mark[body]), share((body >= 48) & (body <= 57)), share(body == 10),
        np.log1p(count) / 10, distinct / np.maximum(count, 1), length / np.maximum(count, 1) / 20, np.sqrt(share(mark[body])),
    ), axis=1)
    return pair >> BITS, pair & _MASK, style


def _marks(labels: DataFrame) -> DataFrame:
    """(_label_id, low, toxic): the worst labels of every document."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_label_id"))
    return good.agg((1 - F.min("quality")).alias("low"), F.max("toxic").alias("toxic"))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Style rows, word lists and labels of the sampled labelled documents; at most `sample` of them reach the driver."""
    chosen = _marks(labels).orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample)
    joined = docs.select(F.col(f"`{id_col}`").alias("_label_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), "_label_id").select("_text", "low", "toxic")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found, style = features(batch.column(0))
        at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * STYLE, pa.int32()), pa.array(style.ravel())),
            batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.int32())], names=["words", "style", *HEADS])

    got = map_rows(joined, run, "words array<int>, style array<double>, low int, toxic int").toArrow()
    if not got.num_rows:
        return np.zeros((0, STYLE)), [], np.zeros((0, 2))
    style = np.array(got["style"].to_pylist())
    return style, [np.asarray(x.values) for x in got["words"]], np.stack([got[h].to_numpy() for h in HEADS], axis=1).astype(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 8000, most: int = 600) -> list[dict]:
    """One head a label: {'words': hashed words, 'weights', 'style', 'bias'}; at most `most` words a head."""
    style, found, y = _sample(docs, labels, id_col, text_col, sample)
    return [_head(style, found, y[:, k], most) for k in range(len(HEADS))] if len(y) else []


def _head(style: np.ndarray, found: list[np.ndarray], y: np.ndarray, most: int) -> dict:
    n, bad = len(y), y.sum()
    if not 0 < bad < n:
        return {"words": np.zeros(0, np.int64), "weights": np.zeros(0), "style": np.zeros(STYLE), "bias": -20.0}
    rows, flat = np.repeat(np.arange(n), [len(x) for x in found]), np.concatenate(found)
    total = np.bincount(flat, minlength=1 << BITS)
    hits = np.bincount(flat, weights=y[rows], minlength=1 << BITS)
    # Screening: how far a word's count among the bad is from what its total count leads to expect.
    expected = total * bad / n
    z = np.where(total >= 3, (hits - expected) / np.sqrt(expected * (1 - bad / n) + 0.5), 0)
    chosen = np.argsort(-np.abs(z))[:most]
    chosen = np.sort(chosen[np.abs(z[chosen]) > 4])
    x = np.zeros((n, len(chosen) + STYLE + 1))
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    hit = place[flat] >= 0
    x[rows[hit], place[flat[hit]]] = 1
    x[:, len(chosen) : -1], x[:, -1] = style * 4, 1
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    ridge[-1] = 1e-6
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return {"words": chosen, "weights": w[: len(chosen)], "style": w[len(chosen) : -1] * 4, "bias": float(w[-1])}


def scored(docs: DataFrame, heads: list[dict], text_col: str = "text") -> DataFrame:
    """docs with _low and _toxic: each head's log-odds of being bad."""
    tables: list[np.ndarray] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(text_col)
        out = np.full((batch.num_rows, len(HEADS)), -20.0)
        if heads:
            if not tables:
                for head in heads:
                    tables.append(np.zeros(1 << BITS))
                    tables[-1][head["words"]] = head["weights"]
                tables.append(np.any(tables, axis=0))
            rows, found, style = features(column, tables[-1])
            for k, head in enumerate(heads):
                out[:, k] = np.bincount(rows, weights=tables[k][found], minlength=batch.num_rows) + style @ head["style"] + head["bias"]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, k]) for k in range(len(HEADS)))], names=[*batch.schema.names, "_low", "_toxic"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_rows(docs, run, f"{fields}, _low double, _toxic double")


def _moments(rates: DataFrame, parent: Column) -> float:
    """The prior's weight in rows: from the spread of the groups' rates around their parents'."""
    n, p = F.col("n"), F.col("s") / F.col("n")
    got = rates.agg(F.sum(n * (p - parent) ** 2).alias("between"), F.sum(parent * (1 - parent)).alias("within"), F.sum(n).alias("n"), F.count("*").alias("g"), F.avg(parent * (1 - parent)).alias("v")).first()
    if not got["g"] or not got["n"]:
        return 1e6
    spread = max(1e-9, (got["between"] - got["within"]) / got["n"])
    return float(min(1e6, max(1.0, (got["v"] or 0) / spread - 1)))


def posteriors(labelled: DataFrame, head: str) -> DataFrame:
    """(_host, _path, _fold, shift): log-odds that each path adds to its documents of the fold; labelled is (_host, _path, _fold, head).

    A document's own label must not speak for it, so a fold's counts are those of the other folds.
    """
    counts = labelled.groupBy("_host", "_path", "_fold").agg(F.count("*").alias("n"), F.sum(head).cast("double").alias("s"))
    every = counts.groupBy("_host", "_path").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.collect_list(F.struct("_fold", "n", "s")).alias("own"))

    def of_others(c: str, fold: Column) -> Column:
        own = F.filter("own", lambda o: o["_fold"] == fold)
        return (F.col(c) - F.aggregate(own, F.lit(0.0), lambda total, o: total + o[c])).alias(c)

    folds = F.transform(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: F.struct(f.alias("_fold"), of_others("n", f), of_others("s", f)))
    paths = every.select("_host", "_path", F.explode(folds).alias("f")).select("_host", "_path", "f.*")
    hosts = paths.groupBy("_host", "_fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    base = min(0.999, max(0.001, (total["s"] or 0) / max(1, total["n"] or 0)))
    k = _moments(hosts.filter("n > 0"), F.lit(base))
    hosts = hosts.select(F.col("_host").alias("_h"), F.col("_fold").alias("_f"), ((F.col("s") + k * base) / (F.col("n") + k)).alias("prior"))
    known = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_h"]) & (paths["_fold"] == hosts["_f"])).drop("_h", "_f")
    k = _moments(known.filter("n > 0"), F.col("prior"))
    post = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), (F.col("s") + k * F.col("prior")) / (F.col("n") + k)))
    return known.select("_host", "_path", "_fold", (F.log(post / (1 - post)) - float(np.log(base / (1 - base)))).alias(f"_{head}_shift"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, sample: int = 8000, threshold: float = 0.5) -> DataFrame:
    """docs with _p_low, _p_toxic (after the sites' posteriors) and _keep. By default the host is the source, and a path is source and language."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", host, F.col("lang")) if path is None else path
    heads = fit(docs, labels, id_col, text_col, sample)
    fold = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(5)), F.lit(FOLDS)).cast("int")
    rows, inner = aside(docs, host.alias("_host"), path.alias("_path"), fold.alias("_fold"))
    marks = _marks(labels)
    sites = written(rows.select(F.col(inner[id_col]).alias("_label_id"), "_host", "_path", "_fold").join(marks, "_label_id").select("_host", "_path", "_fold", *HEADS), "quality-labels")
    keys = ["_host", "_path", "_fold"]
    shifts, other = (posteriors(sites, h).withColumnsRenamed({c: f"{c}{i}" for c in keys}) for i, h in enumerate(HEADS))
    shifts = written(shifts.join(other, [F.col(f"{c}0").eqNullSafe(F.col(f"{c}1")) for c in keys]), "quality-shifts")
    if shifts.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS:
        shifts = F.broadcast(shifts)
    out = scored(rows, heads, inner[text_col])
    out = out.join(shifts, [F.col(c).eqNullSafe(F.col(f"{c}0")) for c in keys], "left")
    p = {f"_p_{h}": 1 / (1 + F.exp(-(F.col(f"_{h}") + F.coalesce(f"_{h}_shift", F.lit(0.0))))) for h in HEADS}
    out = out.withColumns(p).withColumn("_keep", (F.col("_p_low") < threshold) & (F.col("_p_toxic") < threshold))
    return restored(out, inner, "_p_low", "_p_toxic", "_keep")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low, p_toxic of the documents that the classifier keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("_keep").select("doc_id", F.col("_p_low").alias("p_low"), F.col("_p_toxic").alias("p_toxic"))
