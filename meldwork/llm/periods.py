"""Periodic runs of words: aligned blocks found again in the document, then extended word by word.

A run is a stretch of consecutive words with smallest period q that is at least 4 q and 6 words long and that
no neighbour extends. Words become numbers. For every power of two b the document is cut into aligned blocks of b
words; an Aho-Corasick automaton over the blocks' number sequences finds where they stand again. An occurrence at
a distance d with 2 b - 1 <= 3 d < 4 b - 1 is a seed: words d apart are compared in both directions from it
until they differ. The distances of all scales together are all whole numbers, and in a run of period d the 3 d words
or more that are repeated d later hold a whole aligned block of that scale, so no run is missed.

What can't be a seed is left out first: a block with a word that isn't repeated within the scale's
distances, and a block deep inside a run of a shorter period, which is found again only at multiples of that period.
A stretch is extended once a distance, and shorter periods are tested by the prime factors of the distance, which are
enough as a stretch of four periods has only divisors of its period as shorter ones.

Each document is searched whole, in one task, in time near n log n and memory in proportion to its
words; rows never meet, so there is no shuffle and no hot key.

Defined cases: null and empty texts have no words and no runs; words are what stands between the white space
U+0020 and U+0009 to U+000D; equal texts have equal results; a null id is a row like others; columns other than the id and
the text are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import map_rows
from meldwork.llm.fingerprints import let

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Numbers in a key of the automaton at most.
MOST_KEY = 32
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ahead(w: np.ndarray) -> np.ndarray:
    """How far on each word is repeated; the number of words if it isn't."""
    order = np.argsort(w, kind="stable")
    out = np.full(len(w), len(w), np.int64)
    again = w[order[1:]] == w[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def _forward(w: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on, i < j."""
    most, done, step = len(w) - j, 0, 16
    while done < most:
        k = min(step, most - done)
        differ = w[i + done : i + done + k] != w[j + done : j + done + k]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + k, step * 2
    return done


def _backward(w: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j, i < j."""
    done, step = 0, 16
    while done < i:
        k = min(step, i - done)
        differ = w[i - done - k : i - done] != w[j - done - k : j - done]
        at = int(differ[::-1].argmax())
        if differ[k - 1 - at]:
            return done + at
        done, step = done + k, step * 2
    return done


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _smallest(w: np.ndarray, i: int, j: int, d: int) -> bool:
    """Whether w[i:j], which has period d, has no shorter one."""
    return not any(np.array_equal(w[i : j - d // p], w[i + d // p : j]) for p in _primes(d))


class _Names:
    """For a length c, a power of two, a number for the c words from each place on: equal numbers, equal words."""

    def __init__(self, w: np.ndarray) -> None:
        self.names, self.length = w, 1

    def of(self, c: int) -> np.ndarray:
        """The numbers for c, which never falls from call to call."""
        while self.length < c:
            pairs = self.names[: -self.length] * (int(self.names.max()) + 1) + self.names[self.length :]
            self.names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            self.length *= 2
        return self.names


class _Scale:
    """The aligned blocks of one length and the seeds that they give."""

    def __init__(self, w: np.ndarray, b: int, names: _Names) -> None:
        self.w, self.b, self.names = w, b, names
        self.low, self.high = (2 * b + 1) // 3, min((4 * b + 1) // 3 - 1, len(w) // LEAST_PERIODS)

    def blocks(self, ahead: np.ndarray, known: list[tuple[int, int, int]]) -> np.ndarray:
        """Numbers of the blocks that may be found again at one of the scale's distances, outside what the known runs explain."""
        b, n = self.b, len(self.w) // self.b
        keep = ahead[: n * b].reshape(n, b).max(axis=1) <= self.high
        for i, length, _ in known:
            last = (i + length - self.high - b) // b
            if last >= 0:
                keep[-(-i // b) : last + 1] = False
        return np.flatnonzero(keep)

    def seeds(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """(start of a block, distance at which it stands again), in order.

        A long block is a key of MOST_KEY numbers, each the name of a piece, looked for along every offset of a piece: the
        search walks back through a key's length at every step in texts that overlap themselves.
        """
        b, content, key_of, c = self.b, {}, {}, max(1, self.b // MOST_KEY)
        names = self.names.of(c)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k in numbers.tolist():
            key = tuple(names[k * b : k * b + b : c].tolist())
            if key not in content:
                content[key] = len(content)
                automaton.add_word(key, content[key])
            key_of[k] = content[key]
        automaton.make_automaton()
        out = []
        for begin, end in self._windows(numbers):
            for r in range(begin, min(begin + c, end - b + 1)):
                for at, key in automaton.iter(tuple(names[r : end - c + 1 : c].tolist())):
                    y = r + (at + 1) * c - b
                    k = (y - self.low) // b
                    if k * b >= y - self.high and key_of.get(k) == key:
                        out.append((k * b, y - k * b))
        return sorted(out)

    def _windows(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Where the blocks may stand again, stretches that touch put together."""
        begin = numbers * self.b + self.low
        end = np.minimum(numbers * self.b + self.high + self.b, len(self.w))
        first = np.ones(len(begin), bool)
        first[1:] = begin[1:] > end[:-1]
        at = np.flatnonzero(first)
        return list(zip(begin[at].tolist(), end[np.append(at[1:], len(end)) - 1].tolist(), strict=True))


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers, by start and period."""
    n, found, known, b, names = len(w), [], [], 2, _Names(w)
    ahead = _ahead(w) if n >= LEAST_WORDS else w
    while n >= LEAST_WORDS and (scale := _Scale(w, b, names)).low * LEAST_PERIODS <= n:
        known = [r for r in known if r[1] >= scale.low]
        numbers = scale.blocks(ahead, known)
        if len(numbers):
            shorter: dict[int, list[tuple[int, int]]] = {}
            listed = numbers.tolist()
            for i, length, q in known:
                for k in range(bisect_left(listed, -(-i // b)), len(listed)):
                    if listed[k] * b + scale.low > i + length:
                        break
                    shorter.setdefault(listed[k] * b, []).append((i + length, q))
            passed: dict[int, int] = {}
            for x, d in scale.seeds(numbers):
                if x < passed.get(d, 0) or any(x + d <= end and d % q == 0 for end, q in shorter.get(x, ())):
                    continue
                i, j = x - _backward(w, x, x + d), x + _forward(w, x, x + d)
                passed[d] = j
                length = j + d - i
                if length >= max(LEAST_WORDS, LEAST_PERIODS * d) and _smallest(w, i, j + d, d):
                    found.append((i, length, d))
                    known.append((i, length, d))
        b *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal words the same one."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for i, length, q in runs:
        keep[i + q : i + length] = False
    return b" ".join(words[k] for k in np.flatnonzero(keep).tolist())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): every row's runs in order, and its words without the repeats, joined by spaces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).cast(pa.large_binary()).to_pylist():
            words = (text or b"").split()
            runs = find_runs(numbered(words))
            rows.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed(words, runs)))
        n, runs, kept = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    only = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(only, run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, the first of equal ones; null without runs."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def with_repeats(text: Column, key: Column) -> Column:
    """The text, in a tenth of the keys with its end replaced by copies of the words from a chosen one on; a null key changes nothing."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(w: Column) -> Column:
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        of = let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda s: F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, s["a"] + (i - s["a"]) % s["p"]))))
        return F.when(F.size(w) > 0, F.array_join(of, " ")).otherwise(text)

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.when(h % 10 == 0, let(words, changed)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", with_repeats(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text")))
    printed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(printed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
