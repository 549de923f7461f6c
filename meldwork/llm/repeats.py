"""Repeated passages: every byte covered by a long string that also starts in an earlier document.

The corpus is cut into slices of some megabytes. Each string of `length` bytes belongs to the smallest
k-gram hash in it (its minimizer), so equal strings meet wherever they stand; neighbouring strings with
one minimizer form a fragment. Three exchanges, all of blobs from slice to bucket or back:

1. For each fragment of a slice, its minimizer, hashes of its bytes and of what stands on either side of the minimizer
   (128 bits together), and the slice's first document go
   to the minimizer's bucket. The bucket tells the slice which fragments an earlier document holds whole
   (their bytes go), and which first holders may share a string with another fragment: those that agree with one
   on half a string's rest to the left or to the right of the minimizer.
2. The bytes of those few go to the bucket, which builds a run-length index of them in the order of documents: the
   Burrows-Wheeler transform over contexts of `length - 1` symbols, ties in text order, kept as runs of equal symbols, with a
   sample, the document, at the first end of each run of a context. Then every fragment is streamed through it from its last
   symbol to its first: each backward step narrows the interval of the context that matches, up to its
   full length; from there on the step's symbol and the interval's context are a string of `length` bytes, and the first run of that symbol
   in the interval has the smallest document with that string as its sample. Where that is an earlier document, the match is long and the
   bytes go. Symbols decide, not hashes.
3. The spans to remove come back to the slices.

Equal fragments count once in a slice. The fragments at the edges of a passage that many documents share
differ in every one of them, though their minimizer is the same; where a minimizer has more than HOT
different fragments, their windows of `length` bytes go out under a 128-bit hash of the whole string
instead, and the smallest document of each hash is a grouped minimum, so no group holds them all. Only passages
that may repeat are indexed, once for each slice of the corpus that holds them first.

Defined cases: null text is empty; a text shorter than `length` loses nothing; equal ids don't take
from each other; a null id neither loses nor takes anything; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import _BACK, _STEP, _powers, mix, scratch, small_batches, text_bytes, written

SLICE = 1 << 21
GRAM = 16
#: Bytes kept of a minimizer and of a fragment's hash, and of the hashes of its sides; a fragment is known by all.
KEY_BYTES = 5
#: Different fragments of one minimizer above which they are compared window by window instead of in one bucket.
HOT = 1 << 14
#: The bucket number that marks rows of such windows, and windows in a row.
_WINDOWS, _WINDOW_ROWS = -1, 1 << 16
SIDE_BYTES = 3
#: A side that is too short to decide, and sides of a fragment that holds its minimizer more than once.
_SHORT, _WILD = 0, (1 << 8 * SIDE_BYTES) - 1
#: Symbols of a piece that is streamed; longer fragments are cut into pieces that overlap by a string.
PIECE = 256


def _slices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(slice, ids, sizes, data): documents laid end to end, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE // max(SLICE, batch.nbytes))
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                body, at = text_bytes(part.column(1))
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                packed = zstandard.ZstdCompressor(level=3).compress(body.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), np.diff(at).tobytes(), packed)), pa.array([len(body)], pa.int64())], names=["slice", "ids", "sizes", "data", "n_bytes"])
                number += 1

    return docs.select(F.col(id_col).cast("long"), text_col).filter(F.col(id_col).isNotNull()).mapInArrow(run, "slice long, ids binary, sizes binary, data binary, n_bytes long")


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice's bytes, document ids and offsets."""
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["n_bytes"])), np.uint8)
    return body, np.frombuffer(row["ids"], np.int64), np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], np.int64))))


#: The first powers of _STEP and its inverse, which every slice needs.
_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """The first n powers of base."""
    if n > 2 * SLICE:  # one long document
        return _powers(base, n)
    if len(_TABLES.get(base, ())) < n:
        _TABLES[base] = _powers(base, n)
    return _TABLES[base][:n]


#: Strings whose minimizers are found at once; their arrays stay in a core's cache.
_BLOCK = 1 << 14


def _narrowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    span, n = 1, len(x) - width + 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def _minimizers(sums: np.ndarray, back: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the n strings: the smallest k-gram hash with its place modulo a power of two in the lowest bits, whether it stands there once, and how many bits those are."""
    bits = max(1, (width - 1).bit_length())
    low, once, ring = np.empty(n, np.uint64), np.empty(n, bool), np.uint64((1 << bits) - 1)
    for x in range(0, n, _BLOCK):
        y = min(n, x + _BLOCK) + width - 1
        grams = mix((sums[x + GRAM : y + GRAM] - sums[x:y]) * back[x:y]) & ~ring
        place = np.arange(x, y, dtype=np.uint64) & ring
        least = _narrowest(grams | place, width)
        low[x : y - width + 1] = least
        once[x : y - width + 1] = (least ^ _narrowest(grams | place ^ ring, width)) & ring == ring
    return low, once, bits


def _fragments(body: np.ndarray, ids: np.ndarray, at: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """start, stop (in the slice), doc, gram (minimizer), mark (hash of the bytes), left and right (hashes of the sides) of every fragment."""
    n = len(body) - length + 1
    if n <= 0:
        return {k: np.zeros(0, np.uint64 if k in ("gram", "mark", "left", "right") else np.int64) for k in ("start", "stop", "doc", "gram", "mark", "left", "right")}
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(value[body] * _table(_STEP, len(body)), out=sums[1:])
    back = _table(_BACK, len(body) + 1)
    low, once, bits = _minimizers(sums, back, n, length - GRAM + 1)
    # A fragment ends where the minimizer's hash changes and where a document has no further string.
    head, end = at[:-1], at[1:] - length + 1
    cuts = np.unique(np.concatenate((np.flatnonzero((low[1:] ^ low[:-1]) >> np.uint64(bits)) + 1, head[end > head], end[end > head])))
    row = np.searchsorted(at, cuts[:-1], "right") - 1
    valid = cuts[:-1] + length <= at[row + 1]
    start, stop = cuts[:-1][valid], cuts[1:][valid] - 1 + length
    mark = mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))
    left, right = _sides(start, stop, low, once, bits, sums, back, length)
    return {"start": start, "stop": stop, "doc": ids[row[valid]], "gram": low[start] >> np.uint64(bits), "mark": mark, "left": left, "right": right}


def _sides(start: np.ndarray, stop: np.ndarray, low: np.ndarray, once: np.ndarray, bits: int, sums: np.ndarray, back: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bytes to the left and right of each fragment's minimizer, half of what a string holds beside it.

    A string of two fragments with one minimizer has at least that half on one side, so they agree on a side.
    """
    half, ring = (length - GRAM + 1) // 2, (1 << bits) - 1
    first, last = (s + ((low[s] & np.uint64(ring)).astype(np.int64) - s & ring) for s in (start, stop - length))
    p = np.where(once[start] & once[stop - length] & (first == last), first, -1)
    out = []
    for begin in (p - half, p + GRAM):
        whole = (begin >= start) & (begin + half <= stop)
        b = np.where(whole, begin, 0)
        h = mix((sums[b + half] - sums[b]) * back[b]) % np.uint64(_WILD - 1) + np.uint64(1)
        out.append(np.where(p < 0, np.uint64(_WILD), np.where(whole, h, np.uint64(_SHORT))))
    return out[0], out[1]


def _ordered(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The order by `first` and then by `more`, the most significant one first, of which only rows with equal firsts are sorted."""
    order = np.argsort(first)
    same = first[order[1:]] == first[order[:-1]]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    rows = np.sort(order[tied])
    order[tied] = rows[np.lexsort([k[rows] for k in (*more[::-1], first)])]
    return order


def _known(f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fragments of a slice: for each the place of one with the first document; each fragment's number among them and first document."""
    order = _ordered(f["mark"], f["gram"], f["doc"])
    head = np.ones(len(order), bool)
    head[1:] = (f["gram"][order][1:] != f["gram"][order][:-1]) | (f["mark"][order][1:] != f["mark"][order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(head) - 1
    place = order[head]
    return place, number, f["doc"][place][number] if len(place) else f["doc"]


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


#: Bytes of a fragment's key in a message: minimizer, hash, left, right.
_WIDTHS = (KEY_BYTES, KEY_BYTES, SIDE_BYTES, SIDE_BYTES)
_FIELDS = ("gram", "mark", "left", "right")


def _keys(f: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The keys of the fragments at `at`, one column of bytes a field behind the other."""
    return np.concatenate([f[k][at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].ravel() for k, w in zip(_FIELDS, _WIDTHS, strict=True)])


def _read_keys(raw: np.ndarray, n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The keys of n fragments, and what stands behind them."""
    out, at = {}, 0
    for k, w in zip(_FIELDS, _WIDTHS, strict=True):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = raw[at : at + w * n].reshape(n, w)
        out[k], at = wide.view("<u8").ravel(), at + w * n
    return out, raw[at:]


def _again(key: np.ndarray) -> np.ndarray:
    """Which rows of the key occur more than once."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _spread(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    few = len(bucket) and 0 <= bucket.min() and bucket.max() < 1 << 16  # sorted by radix
    order = np.argsort(bucket.astype(np.uint16) if few else bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def _announce(slices: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, slice, n, blob): grams, marks and first documents of each slice's fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                f = _fragments(*_open(row), length)
                place, _, _ = _known(f)
                out: list[tuple] = []
                for b, part in _spread(f["gram"][place] % np.uint64(buckets)):
                    p = place[part]
                    docs, which = np.unique(f["doc"][p], return_inverse=True)
                    kind = np.uint16 if len(docs) < 65536 else np.uint32
                    out.append((b, row["slice"], len(p), len(docs), _packed(_keys(f, p), which.astype(kind), docs)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "slice", "n", "docs", "blob"])

    return slices.mapInArrow(run, "bucket long, slice long, n long, docs long, blob binary")


def _answer(told: DataFrame, hot: int) -> DataFrame:
    """(slice, n, blob): for each fragment of the slice's message to bucket n, in its order, 0, 1 (all held earlier), 2 (bytes wanted) or 3 (windows wanted)."""

    def run(table: pa.Table) -> pa.Table:
        keys, docs, ends = [], [], np.cumsum(table["n"].to_numpy())
        for n, k, blob in zip(table["n"].to_pylist(), table["docs"].to_pylist(), table["blob"], strict=True):
            key, rest = _read_keys(np.frombuffer(blob.as_buffer(), np.uint8), n)
            rest, wide = rest.tobytes(), 2 if k < 65536 else 4
            which = np.frombuffer(rest[: wide * n], np.uint16 if wide == 2 else np.uint32)
            keys.append(key)
            docs.append(np.frombuffer(rest[wide * n :], np.int64)[which])
        key = {k: np.concatenate([x[k] for x in keys]) for k in _FIELDS}
        doc, spare = np.concatenate(docs), np.uint64(64 - 8 * KEY_BYTES)  # bits of a number beside a minimizer
        order = _ordered(key["gram"] << spare | key["mark"] & np.uint64((1 << int(spare)) - 1), key["mark"], key["left"], key["right"], doc)
        key, doc = {k: v[order] for k, v in key.items()}, doc[order]
        gram = key["gram"]
        new_gram = np.ones(len(gram), bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new_mark = new_gram.copy()
        for k in ("mark", "left", "right"):
            new_mark[1:] |= key[k][1:] != key[k][:-1]
        at_mark = np.flatnonzero(new_mark)
        sizes = np.diff(np.append(at_mark, len(doc)))
        first = np.repeat(doc[at_mark], sizes)
        # Of the different fragments of a minimizer, those that agree with another one on a side; with all, where one holds it twice.
        g, left, right = (key[k][at_mark] for k in ("gram", "left", "right"))
        agree = _again(g << spare | left) & (left != _SHORT) | _again(g << spare | right) & (right != _SHORT)
        begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
        members = np.diff(np.append(begin, len(g)))
        if len(g):
            wild = np.repeat(np.logical_or.reduceat(left == _WILD, begin), members)
            agree = agree | wild & (np.repeat(members, members) > 1)
            asked = np.repeat(np.add.reduceat(agree.astype(np.int64), begin), members)
            agree, asked = np.repeat(agree, sizes), np.repeat(asked, sizes)
        else:
            asked = agree
        reply = np.empty(len(order), np.uint8)
        reply[order] = np.where(doc > first, 1, np.where(agree, np.where(asked > hot, 3, 2), 0))
        out = pa.table({"slice": table["slice"], "n": table["bucket"], "blob": pa.array([x.tobytes() for x in np.split(reply, ends[:-1])], pa.binary())})
        return out.filter(np.logical_or.reduceat(reply > 0, ends - table["n"].to_numpy()))

    return told.groupBy("bucket").applyInArrow(run, "slice long, n long, blob binary")


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > stop[:-1]
    return start[head], stop[np.append(np.flatnonzero(head)[1:] - 1, len(stop) - 1)] if len(stop) else stop


_SPANS = "slice long, bucket long, n long, blob binary"


def _window_hashes(body: np.ndarray, at: np.ndarray, length: int, salt: int) -> np.ndarray:
    value = mix(np.arange(salt, salt + 256, dtype=np.uint64) * np.uint64(_STEP))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(value[body] * _powers(_STEP, len(body)), out=sums[1:])
    return mix((sums[at + length] - sums[at]) * _powers(_BACK, len(body))[at])


def _resolve(slices: DataFrame, announced: int, buckets: int, length: int) -> DataFrame:
    """_SPANS rows: with bucket null, spans of the slice to remove; else fragments whose bytes are wanted there. The answers are those of `announced` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                body, ids, at = _open(row)
                f = _fragments(body, ids, at, length)
                place, number, first = _known(f)
                reply = np.zeros(len(place), np.uint8)
                said = {x["n"]: x["blob"] for x in row["answers"] or []}
                for b, part in _spread(f["gram"][place] % np.uint64(announced)):  # as they were announced
                    if b in said:
                        reply[part] = np.frombuffer(said[b], np.uint8)
                gone = (f["doc"] > first) | (reply[number] == 1)
                start, stop = _merged(f["start"][gone], f["stop"][gone])
                out = [(row["slice"], None, len(start), _packed(start.astype(np.int64), stop.astype(np.int64)))] if len(start) else []
                wanted = np.flatnonzero((reply[number] == 2) & (f["doc"] == first))  # each place where that document has it
                for b, part in _spread(f["gram"][wanted] % np.uint64(buckets)):
                    w = wanted[part]
                    text = b"".join(body[x:y].tobytes() for x, y in zip(f["start"][w], f["stop"][w], strict=True))
                    out.append((row["slice"], b, len(w), _packed(f["doc"][w], f["start"][w].astype(np.int64), (f["stop"] - f["start"])[w].astype(np.int64)) + text))
                hot = np.flatnonzero((reply[number] == 3) & (f["doc"] == first))
                if len(hot):
                    count = (f["stop"] - f["start"])[hot] - length + 1
                    at_ = np.repeat(f["start"][hot] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    doc = np.repeat(f["doc"][hot], count)
                    a, b = (_window_hashes(body, at_, length, salt) for salt in (1, 1 << 32))
                    for j in range(0, len(at_), _WINDOW_ROWS):
                        part = slice(j, j + _WINDOW_ROWS)
                        out.append((row["slice"], _WINDOWS, len(at_[part]), _packed(a[part], b[part], doc[part], at_[part])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["slice", "bucket", "n", "blob"])

    return slices.mapInArrow(run, _SPANS)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the rows of two columns of small numbers, in their order."""
    a, b = columns
    return np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_inverse=True)[1].astype(np.int32)


def contexts(symbols: np.ndarray, length: int) -> np.ndarray:
    """For every place, the number of the `length` symbols from there on, in their order; behind the end stand zeros."""
    wide, n = min(7, length), len(symbols)
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(length, np.uint64)))
    words = np.zeros(n, np.uint64)
    for j in range(wide):
        words = words << np.uint64(9) | padded[j : n + j]
    number = np.unique(words, return_inverse=True)[1].astype(np.int32) + 1
    while wide < length:
        step = min(wide, length - wide)
        number = _numbered(number, np.concatenate((number[step:], np.zeros(step, np.int32)))) + 1
        wide += step
    return number


class RunIndex:
    """A run-compressed Burrows-Wheeler transform over contexts of `length - 1` symbols, ties in text order.

    `symbols` are bytes plus one, with a zero behind every piece; `docs` is the document of every place, in rising order.
    Kept are runs of equal symbols with their counts, the starts of the contexts and of those one symbol shorter, and
    for each run of one symbol in one context the document at its first end. The order of places is not kept.
    """

    def __init__(self, symbols: np.ndarray, docs: np.ndarray, length: int) -> None:
        n = self.n = len(symbols)
        shorter = contexts(symbols, length - 2)
        number = _numbered(shorter, np.concatenate((symbols[length - 2 :], np.zeros(min(n, length - 2), symbols.dtype)))[:n])
        order = np.sort(number.astype(np.int64) << 32 | np.arange(n)) & 0xFFFFFFFF  # ties in text order
        before = np.where(order > 0, symbols[order - 1], 0).astype(np.int64)
        edge = np.ones(n, bool)
        edge[1:] = before[1:] != before[:-1]
        ends = edge.copy()
        ends[1:] |= number[order][1:] != number[order][:-1]
        new = np.ones(n, bool)
        new[1:] = shorter[order][1:] != shorter[order][:-1]
        self.shorter = np.flatnonzero(new)
        start = np.flatnonzero(edge)
        symbol, size = before[start], np.diff(np.append(start, n))
        by = np.argsort(symbol.astype(np.uint16), kind="stable")  # the starts rise
        self.key, self.start, self.size = symbol[by] * (n + 1) + start[by], start[by], size[by]
        total = np.cumsum(size[by]) - size[by]
        count = np.bincount(symbol, weights=size, minlength=258).astype(np.int64)
        self.less = np.cumsum(count) - count  # places whose symbol is smaller
        self.ahead = total - self.less[symbol[by]]
        self.symbol = symbol[by]
        head = np.flatnonzero(ends)
        by = np.argsort(before[head].astype(np.uint16), kind="stable")
        self.ends, self.sample = before[head][by] * (n + 1) + head[by], docs[order[head]][by]

    def step(self, symbol: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where the interval of symbol + P begins, if that of P begins at low."""
        j = np.searchsorted(self.key, symbol * (self.n + 1) + low, "right") - 1
        known = (j >= 0) & (self.symbol[j] == symbol)
        return self.less[symbol] + np.where(known, self.ahead[j] + np.minimum(low - self.start[j], self.size[j]), 0)

    def first(self, symbol: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The smallest document with symbol + P, where P is a whole context whose interval begins at low."""
        return self.sample[np.searchsorted(self.ends, symbol * (self.n + 1) + low)]

    def cut(self, low: np.ndarray) -> np.ndarray:
        """Where the interval of P without its last symbol begins, for a whole context P."""
        return self.shorter[np.searchsorted(self.shorter, low, "right") - 1]


def repeated(body: np.ndarray, doc: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """The places in body of all strings that a smaller document holds too; pieces lie end to end, in rising order of doc.

    Every piece is streamed through the index backwards, all pieces in step.
    """
    begin = np.cumsum(size) - size
    at = np.arange(len(body)) + np.repeat(np.arange(len(size)), size)
    symbols = np.zeros(len(body) + len(size), np.int32)
    symbols[at] = body.astype(np.int32) + 1
    index = RunIndex(symbols, np.repeat(doc, size + 1), length)
    longest = np.argsort(-size, kind="stable")
    last, own, left = (begin + size)[longest], doc[longest], size[longest]
    low, out = np.zeros(len(size), np.int64), [np.zeros(0, np.int64)]
    for t in range(1, int(left.max(initial=0)) + 1):
        active = int(np.searchsorted(-left, -t, "right"))
        place = last[:active] - t
        symbol, low = body[place].astype(np.int64) + 1, low[:active]
        if t >= length:  # the context is whole
            earlier = index.first(symbol, low) < own[:active]
            out.append(place[earlier])
            low = index.cut(low)
        low = index.step(symbol, low)
    return np.concatenate(out)


def _index(asked: DataFrame, length: int) -> DataFrame:
    """_SPANS rows: what the wanted fragments share with others of earlier documents."""

    def run(table: pa.Table) -> pa.Table:
        docs, starts, sizes, froms, texts = [], [], [], [], []
        for slice_, n, blob in zip(table["slice"].to_pylist(), table["n"].to_pylist(), table["blob"], strict=True):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            head = np.frombuffer(raw[: 24 * n].tobytes(), np.int64).reshape(3, n)
            docs.append(head[0])
            starts.append(head[1])
            sizes.append(head[2])
            froms.append(np.full(n, slice_))
            texts.append(raw[24 * n :])
        doc, start, size, source = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, starts, sizes, froms))
        body = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        begin = np.cumsum(size) - size
        # Pieces of bounded size that overlap by all but one byte of a string, in the order of their documents.
        step = max(1, PIECE - length + 1)
        n = np.maximum(1, -(-(size - length + 1) // step))
        piece = np.repeat(np.arange(len(size)), n)
        ahead = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
        order = np.argsort(doc[piece], kind="stable")
        piece, ahead = piece[order], ahead[order]
        long = np.minimum(size[piece] - ahead, step + length - 1)
        origin = begin[piece] + ahead
        place = np.repeat(origin - np.cumsum(long) + long, long) + np.arange(long.sum())
        found = repeated(body[place], doc[piece], long, length)
        own = np.repeat(piece, long)[found]
        left, piece = start[own] + place[found] - begin[own], own
        out = []
        for s, part in _spread(source[piece]):
            a, b = _merged(left[part], left[part] + length)
            out.append((s, None, len(a), _packed(a, b)))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("slice", "bucket", "n", "blob"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    return asked.groupBy("bucket").applyInArrow(run, _SPANS)


def _hot(asked: DataFrame, length: int) -> DataFrame:
    """_SPANS rows: windows of hot minimizers that an earlier document holds, by a grouped minimum over the hash of the whole string."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                columns = np.frombuffer(blob.as_buffer(), np.int64).reshape(4, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, slice_)), *map(pa.array, columns)], names=["slice", "a", "b", "doc", "start"])

    def run(table: pa.Table) -> pa.Table:
        start = table["start"].to_numpy()
        a, b = _merged(start, start + length)
        return pa.table({"slice": table["slice"].slice(0, 1), "bucket": pa.array([None], pa.int64()), "n": pa.array([len(a)], pa.int64()), "blob": pa.array([_packed(a, b)], pa.binary())})

    windows = asked.select("slice", "n", "blob").mapInArrow(opened, "slice long, a long, b long, doc long, start long")
    first = windows.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    return windows.join(first, ["a", "b"]).filter("doc > first").select("slice", "start").groupBy("slice").applyInArrow(run, _SPANS)


def _removed(slices: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every document without its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                body, ids, at = _open(row)
                spans = [np.frombuffer(x["blob"], np.int64).reshape(2, -1) for x in row["answers"] or []]
                gone = np.zeros(len(body) + 1, np.int32)
                for start, stop in spans:
                    np.add.at(gone, start, 1)
                    np.add.at(gone, stop, -1)
                gone = np.cumsum(gone[:-1]) > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                heads = at[:-1][at[:-1] < len(body)]
                edge[heads] = gone[heads]
                count, spans_ = (np.concatenate(([0], np.cumsum(x))) for x in (gone, edge))
                kept = [body[x:y][~gone[x:y]].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array(np.diff(at)), pa.array((count[at[1:]] - count[at[:-1]]).astype(np.int64)), pa.array((spans_[at[1:]] - spans_[at[:-1]]).astype(np.int64)),
                    pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return slices.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _with_answers(slices: DataFrame, answers: DataFrame) -> DataFrame:
    told = answers.groupBy(F.col("slice").alias("_s")).agg(F.collect_list(F.struct("n", "blob")).alias("answers"))
    return slices.join(told, F.col("slice") == F.col("_s"), "left").drop("_s")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept is the remaining bytes."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bucketed by slice, so that the two joins that bring answers to the slices don't shuffle the texts again.
    name = f"repeat_slices_{uuid.uuid4().hex}"
    _slices(docs, id_col, text_col).repartition(parts, "slice").write.bucketBy(parts, "slice").sortBy("slice").option("path", scratch(spark, name, name)).saveAsTable(name)
    slices = spark.table(name)
    total = slices.agg(F.sum("n_bytes")).first()[0] or 0
    announced = max(parts, total >> 24)
    answers = _answer(_announce(slices, announced, length), HOT)
    found = written(_resolve(_with_answers(slices, answers), announced, max(parts, total >> 21), length), "repeat-fragments")
    spans = found.filter("bucket IS NULL").unionByName(_index(found.filter(f"bucket <> {_WINDOWS}"), length))
    spans = spans.unionByName(_hot(found.filter(f"bucket = {_WINDOWS}"), length))
    out = _removed(_with_answers(slices, spans))
    odd = docs.filter(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("kept"))
    odd = odd.select("doc_id", F.octet_length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept")
    return out.unionByName(odd)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, for strings of 50 bytes."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
