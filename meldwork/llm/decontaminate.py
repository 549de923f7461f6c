"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are lower-cased and every run of characters other than letters and digits becomes one
space. An item of m characters has an error budget of e = floor(max_error * m) edits and is split into
e + 1 pieces; a passage within e edits of the item holds at least one piece unchanged, as an edit touches one piece only.
That holds for any e + 1 pieces of an item that don't overlap, so what many items share, such as a prompt's
opening, is left out of the pieces where the rest has room for them; of many items that share a piece, 3-gram counts
leave those that may be at its hit. Exact piece
hits (one Aho-Corasick automaton over all pieces) give the places to look at, and Myers' bit-parallel
edit distance decides there.

The benchmark is the stated query set: it goes to the tasks in blocks of at most `block_chars`
characters, each block one pass over the documents, so what a task holds is bounded.

Defined cases: null or empty texts match nothing; an item without a letter or digit is ignored; an
item so short that its budget is 0 (12 characters at most) must occur unchanged between spaces; repeated
items are reported under each id; repeated rows of a document are each searched; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import map_rows, mix

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return f" {_OTHER.sub(' ', text.lower()).strip()} " if text else "  "


#: The shortest piece that is chosen around shared parts, and the items that may share one.
LEAST, MANY = 8, 16


def pieces(item: str, max_error: float, shared: np.ndarray | None = None) -> tuple[int, list[tuple[int, str]]]:
    """The error budget and its budget-plus-one pieces, each with its place in the item.

    `shared` says of each place whether the LEAST characters from there on stand in many items. If the stretches
    without them have room for all pieces, they are cut from these.
    """
    m = len(item)
    budget = int(max_error * m)
    free = [(0, m)]
    if shared is not None and shared.any():
        own = np.flatnonzero(~shared[: m - LEAST + 1])
        cut = np.flatnonzero(np.diff(own) > 1) + 1
        free = [(int(x[0]), int(x[-1]) + LEAST) for x in np.split(own, cut) if len(x)]
        free = [(max(i, free[k - 1][1]) if k else i, j) for k, (i, j) in enumerate(free)]
        if sum(max(0, j - i) // LEAST for i, j in free) <= budget:
            free = [(0, m)]
    # Pieces go one by one to the stretch whose pieces are then the longest.
    count = [0] * len(free)
    heap = [(-(j - i), k) for k, (i, j) in enumerate(free)]
    heapify(heap)
    for _ in range(budget + 1):
        _, k = heappop(heap)
        count[k] += 1
        heappush(heap, (-(free[k][1] - free[k][0]) / (count[k] + 1), k))
    out = []
    for (i, j), n in zip(free, count, strict=True):
        ends = [i + (j - i) * x // n for x in range(n + 1)] if n else []
        out += [(a, item[a:b]) for a, b in pairwise(ends)]
    return budget, out


def shared_places(texts: list[str]) -> list[np.ndarray]:
    """For every text and place, whether the LEAST characters from there on stand in more than MANY of the texts."""
    size = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(points) - LEAST + 1), np.uint64)
    for j in range(LEAST):
        h = mix(h + points[j : len(h) + j])
    owner = np.repeat(np.arange(len(texts)), size)[: len(h)]
    order = np.lexsort((owner, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    own = new.copy()
    own[1:] |= owner[order][1:] != owner[order][:-1]
    group = np.cumsum(new) - 1
    many = np.bincount(group, weights=own)[group] > MANY if len(h) else np.zeros(0, bool)
    out = np.zeros(len(points), bool)
    out[order] = many
    return np.split(out, np.cumsum(size)[:-1])


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of pattern to a substring of text, and where that substring ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best, where = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(zero | plus) & full
        down = zero & plus
        score += ((up & top) != 0) - ((down & top) != 0)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(zero | up) & full, zero & up
        if score < best:
            best, where = score, j + 1
    return best, where


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; one block at a time is on the driver."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        text = normal(row[1]).strip()
        if text and row[0] is not None:
            block.append((row[0], text))
            size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _grams(text: str) -> np.ndarray:
    """16-bit hashes of the text's 3-grams."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return (mix(x[:-2] + (x[1:-1] << np.uint64(21)) + (x[2:] << np.uint64(42))) >> np.uint64(48)).astype(np.uint16) if len(x) > 2 else np.zeros(0, np.uint16)


class _Sharers:
    """The items that share a piece. Which of them may be at a hit is asked of all at once, by the q-gram lemma.

    A passage within e edits of an item of m characters has at least m - 2 - 3e of the item's 3-grams.
    """

    def __init__(self, block: list[tuple[int, str]], budgets: list[int], uses: list[tuple[int, int]]) -> None:
        grams = [_grams(block[i][1]) for i, _ in uses]
        self.uses, self.grams = uses, np.concatenate([*grams, np.zeros(1, np.uint16)])
        self.at = np.cumsum([0, *map(len, grams[:-1])])
        self.least = np.array([len(g) - 3 * budgets[i] for g, (i, _) in zip(grams, uses, strict=True)])
        self.before = max(p + budgets[i] for i, p in uses)
        self.behind = max(len(block[i][1]) - p + 3 * budgets[i] for i, p in uses)

    def near(self, grams: np.ndarray, begin: int) -> list[tuple[int, int]]:
        """The uses whose items may be found around the piece that begins at `begin` in the text of these 3-grams."""
        there = np.zeros(1 << 16, bool)
        there[grams[max(0, begin - self.before) : begin + self.behind]] = True
        found = np.add.reduceat(there[self.grams].astype(np.int32), self.at)
        found[-1] -= there[0]  # the one behind the last item's
        return [self.uses[k] for k in np.flatnonzero(found >= self.least)]


def _automaton(block: list[tuple[int, str]], max_error: float) -> tuple[ahocorasick.Automaton, list[int]]:
    found = ahocorasick.Automaton()
    budgets, at = [], {}
    for i, ((_, text), shared) in enumerate(zip(block, shared_places([t for _, t in block]), strict=True)):
        budget, parts = pieces(text, max_error, shared) if int(max_error * len(text)) else (0, [(-1, f" {text} ")])
        budgets.append(budget)
        for place, part in parts:
            at.setdefault(part, []).append((i, place))
    for part, uses in at.items():
        found.add_word(part, (len(part), uses, _Sharers(block, budgets, uses) if len(uses) > MANY else None))
    if at:
        found.make_automaton()
    return found, budgets


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_error: float = 0.08, block_chars: int = 1 << 22) -> DataFrame:
    """(doc_id, item_id, distance, budget, end): the best passage of every document for every item it is within budget of."""
    schema = "doc_id long, item_id long, distance int, budget int, end long"
    out = None
    for block in _blocks(items, item_id, item_text, block_chars):
        part = map_rows(docs.select(F.col(id_col).cast("long"), text_col), _search(block, max_error), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _search(block: list[tuple[int, str]], max_error: float) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    made: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.extend(_automaton(block, max_error))
        automaton, budgets = made
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = normal(text)
            looked: dict[int, list[int]] = {}
            grams = None
            for end, (length, uses, sharers) in automaton.iter(text):
                if sharers is not None:
                    grams = _grams(text) if grams is None else grams
                    uses = sharers.near(grams, end + 1 - length)
                for i, place in uses:
                    looked.setdefault(i, []).append(end + 1 - length - place)
            for i, begins in looked.items():
                item, budget = block[i][1], budgets[i]
                if budget == 0:
                    rows.append((doc, block[i][0], 0, 0, begins[0] + len(item)))
                    continue
                best, done = (budget + 1, 0), -1
                for begin in sorted(set(begins)):
                    if begin <= done:  # inside the window looked at before
                        continue
                    low, done = max(0, begin - budget), begin + budget
                    distance, where = myers(item, text[low : begin + len(item) + 2 * budget + budget])
                    if distance < best[0]:
                        best = (distance, low + where)
                if best[0] <= budget:
                    rows.append((doc, block[i][0], best[0], budget, best[1]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "budget", "end"])

    return run


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, budget, end: a row for every benchmark item found in a document."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
