"""Packing: vector bin packing with the dot-product heuristic.

Examples are placed under simultaneous limits on tokens, segments and loss-bearing tokens. Rows of
(tokens, segments, loss) are dealt to groups of about `group_rows` by a hash, so the work is spread
and no group grows with the corpus; a group is packed bin by bin: of the examples that still fit, the
one with the largest dot product of its demand and the bin's free room (both as fractions of the
limits) goes in next, until none fits.

A document is read as an instruction example: the first `prompt` of its ids, a quarter, is its prompt and bears no
loss. A sequence holds at most 7/8 of its length in loss-bearing ids and at most 12 segments; short documents couldn't
fill it so, and a group's limit on segments is doubled until its sequences number at most a twentieth more than their
ids and loss need, or no more than without the limit. A document longer than
a sequence is cut: its prompt into quarters of a sequence, the rest into three quarters, which must share theirs with prompts.

Defined cases: null text is empty: the closing id alone; equal ids are separate documents; an empty table gives
no rows; an example beyond a limit on its own is an error in pack(), as no bin can hold it.
"""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import map_rows, written


def fill_bins(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every example and its place in the bin; demand is one row of limited amounts an example."""
    share = demand / limits
    if (share > 1).any():
        raise ValueError("an example exceeds a limit on its own")
    order = np.lexsort((np.arange(len(share)), -share.sum(axis=1)))
    left, bins, places = np.ascontiguousarray(share[order].T), np.zeros(len(share), np.int64), np.zeros(len(share), np.int64)
    where, number = order, 0  # left: amounts by rows of what is still to place, where: its place in demand

    def add(at: int, place: int) -> None:
        bins[where[at]], places[where[at]] = number, place

    while len(where):
        used, place = np.zeros(len(where), bool), 0
        free = np.ones(len(left))
        fits, own, pick = np.arange(len(where)), left, 0  # an empty bin takes the largest, which is the first
        while len(fits):
            at = fits[pick]
            used[at] = True
            add(at, place)
            free = free - left[:, at]
            place += 1
            ok = np.logical_and.reduce(own <= free[:, None] + 1e-9)
            ok[pick] = False
            fits, own = fits[ok], own[:, ok]
            pick = int(np.argmax(free @ own)) if len(fits) else 0
        left, where, number = left[:, ~used], where[~used], number + 1
    return bins, places


def fill_elastic(demand: np.ndarray, limits: np.ndarray, elastic: int, slack: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """fill_bins with the smallest of the limit in place `elastic`, its double, its fourfold, ... that costs little.

    Little is at most `slack` more bins than the other amounts need, or than the same heuristic fills without that limit.
    """
    firm = np.arange(len(limits)) != elastic
    enough = (1 + slack) * np.ceil((demand[:, firm].sum(axis=0) / limits[firm]).max(initial=1) - 1e-9)
    found = fill_bins(demand, limits)
    if len(demand) and found[0].max() + 1 > enough:
        enough = max(enough, fill_bins(demand[:, firm], limits[firm])[0].max() + 1)
    while len(demand) and found[0].max() + 1 > enough and limits[elastic] < demand[:, elastic].sum():
        limits = np.where(firm, limits, limits * 2)
        found = fill_bins(demand, limits)
    return found


def pack(examples: DataFrame, amounts: dict[str, int], key: list[str], group_rows: int = 1000, elastic: str | None = None) -> DataFrame:
    """examples with _bin, and _ahead, how much of the first amount stands before it in the bin.

    amounts maps each limited column to its limit; the limit of the column `elastic` may grow, see fill_elastic().
    """
    rows = examples.count()
    groups = max(1, -(-rows // group_rows))
    dealt = examples.withColumn("_group", F.pmod(F.xxhash64(*key), F.lit(groups)))
    limits = np.array(list(amounts.values()), float)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, kind="stable").reset_index(drop=True)
        demand = frame[list(amounts)].to_numpy(float)
        bins, places = fill_elastic(demand, limits, list(amounts).index(elastic)) if elastic else fill_bins(demand, limits)
        order = np.lexsort((places, bins))
        total = np.cumsum(demand[order, 0]) - demand[order, 0]
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        ahead = np.empty(len(frame), np.int64)
        ahead[order] = total - np.repeat(total[first], np.diff(np.append(first, len(frame))))
        return frame.assign(_bin=bins * groups + frame["_group"], _ahead=ahead)  # no two groups share a number

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.groupBy("_group").applyInPandas(run, f"{fields}, _bin long, _ahead long").drop("_group")


#: Characters for which lower-casing, NFC and white space are the same in Python and in the tokenizer.
PLAIN = r"[^\x20-\x7E\n\r\tÀ-ÿ]"
#: A word of its own for the tokenizer that no plain text can hold.
MARK = "¤"


#: Signs that the tokenizer cuts off a word of letters as one piece. The apostrophe isn't one.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Numbers(dict):
    """Words to numbers. An unknown word gets the next one and is noted as new; letters with signs behind them as a pair."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[tuple[int, str]] = []
        self.pairs: list[tuple[int, int, int]] = []

    def __missing__(self, word: str) -> int:
        core = word.rstrip(SIGNS)
        if len(core) < len(word) and core.isalpha():
            pair = self[core], self[word[len(core) :]]
            number = self[word] = len(self)
            self.pairs.append((number, *pair))
        else:
            number = self[word] = len(self)
            self.new.append((number, word))
        return number


class WordTokenizer:
    """ids of texts by a tokenizer file that never joins characters across white space.

    Plain texts go word by word: words seen before are looked up, new ones are encoded together.
    The tokenizer ends every piece of a word with an id whose string ends in </w>, so a word of
    letters is one such piece; these go to a copy of the tokenizer that cuts at white space alone,
    which is faster. Any other word gets a mark behind it. A text that holds one of the tokenizer's special
    strings, which it may find inside a word, is encoded whole.
    """

    def __init__(self, path: str, most: int = 700_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.quick = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.quick.normalizer = None
        self.quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ending = np.zeros(1 + max(self.model.get_vocab().values()), bool)
        self.ending[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.mark = self._encode(MARK)
        special = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.most, self.odd, self.special = most, re.compile(PLAIN).search, re.compile("|".join(special), re.I).search
        self._forget()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.size, self.begin = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Append the ids of the new words."""
        new, pairs = self.numbers.new, np.array(self.numbers.pairs, np.int64).reshape(-1, 3)
        grown = np.zeros(len(self.numbers), np.int64)
        self.size, self.begin = (np.concatenate((x, grown[len(x) :])) for x in (self.size, self.begin))
        parts, end = [self.flat], len(self.flat)

        def put(numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
            nonlocal end
            self.size[numbers], self.begin[numbers] = sizes, end + np.cumsum(sizes) - sizes
            parts.append(ids)
            end += len(ids)

        letters = [(i, w) for i, w in new if w.isalpha()]
        if letters:
            ids = np.array(self.quick.encode_batch_fast([" ".join([w for _, w in letters])], add_special_tokens=False)[0].ids, np.uint32)
            put(np.array([i for i, _ in letters]), np.diff(np.flatnonzero(self.ending[ids]) + 1, prepend=0), ids)
        other = [(i, w) for i, w in new if not w.isalpha()]
        if other:
            ids = self._encode(" ".join([f"{w} {MARK}" for _, w in other]))
            ends = np.flatnonzero(ids == self.mark[-1]) + 1
            part = np.ones(len(ids), bool)
            for k in range(len(self.mark)):
                part[ends - 1 - k] = False
            put(np.array([i for i, _ in other]), np.diff(ends - len(self.mark) * np.arange(1, len(ends) + 1), prepend=0), ids[part])
        self.flat = np.concatenate(parts)
        if len(pairs):
            parts = [self.flat]
            both = pairs[:, 1:].ravel()
            put(pairs[:, 0], self.size[both].reshape(-1, 2).sum(axis=1), self._laid(both))
            self.flat = np.concatenate(parts)
        new.clear()
        self.numbers.pairs.clear()

    def _laid(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the words, end to end."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[numbers] - ends + size, size)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > self.most:
            self._forget()
        plain = [not (self.odd(t) or "<" in t and self.special(t)) for t in texts]
        number, find = [], self.numbers.__getitem__
        for t, p in zip(texts, plain, strict=True):
            words = t.lower().split() if p else []
            number.append(np.fromiter(map(find, words), np.int64, len(words)))
        if self.numbers.new or self.numbers.pairs:
            self._learn()
        return [self._laid(n) if p else self._encode(t) for t, p, n in zip(texts, plain, number, strict=True)]


def cuts(n: int, length: int, prompt: float) -> list[int]:
    """Where a document of n ids is cut, its ends included."""
    if n <= length:
        return [0, n]
    behind, step = int(n * prompt), max(1, int(length * prompt))
    return [*range(0, behind, step), *range(behind, n, length - step), n]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, prompt: float = 0.25, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole documents of at most `length` ids, and the cut ones."""
    made: list[WordTokenizer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(WordTokenizer(tokenizer))
        rows = []
        for doc, ids in zip(batch.column(0).to_pylist(), made[0].ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            rows += [(doc, i, j - i, zlib.crc32(ids[i:j].tobytes()), len(ids)) for i, j in pairwise(cuts(len(ids), length, prompt))]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", 1 << 20)


def loss_bearing(prompt: float) -> Column:
    """The ids of a piece that stand behind its document's prompt."""
    begin = F.greatest(F.col("start"), F.floor(F.col("doc_tokens") * prompt))
    return F.greatest(F.lit(0), F.col("start") + F.col("length") - begin).cast("long")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, segments: int = 12, loss: float = 0.875, prompt: float = 0.25, group_rows: int = 1000) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens."""
    cut = written(pieces(docs, tokenizer, length=length, prompt=prompt).withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    amounts = {"length": length, "_segments": segments, "loss_tokens": int(length * loss)}
    packed = pack(cut.withColumns({"_segments": F.lit(1), "loss_tokens": loss_bearing(prompt)}), amounts, ["doc_id", "start", "_row"], group_rows, "_segments")
    packed = packed.withColumnsRenamed({"_ahead": "offset", "_bin": "sequence_id"})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every piece of every document in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
