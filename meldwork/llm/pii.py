"""Personal data: exact patterns, and terms that reveal a protected entity by information content.

Four kinds of entity are found by pattern; a fifth, the secret, is a long value of letters and digits that a label is
set to (`token = "..."`). Every term within `WINDOW` words of an entity e is judged by
what it tells about e: its pointwise mutual information, PMI(t, e) = log2(p(e | t) / p(e)), against the
entity's information content IC(e) = -log2 p(e), both from document counts over the whole corpus, where p(e | t)
counts the documents in which t stands that near to e. The same
is asked for e's class (mail domain, number prefix, label of a secret) and its kind, whose counts are those of all entities in
them, so a term can give away what a rare entity is. A term that gives away at least `disclosure` of the
content of one of the three is sanitised wherever it stands near that one, if chance doesn't explain it: its
different texts save `texts * PMI` bits, which must exceed by -log2(`chance`) the log2 of the terms that could have
stood there by chance: all different terms of the corpus, as a term of one text stands near something by necessity. So
in a corpus of usual vocabulary an entity and a term must meet in two different texts or more; a value of one text is given away
through its class and kind only. Texts that differ little are different texts here. A secret gives itself away: it is sanitised where it is rare, that is where its own
content, by different texts, is at least half of what a value of one text has.

Defined cases: null text is empty; equal texts count as one text for the evidence; a long text is
searched whole and in linear time; a term inside an entity's span is no term; equal ids are separate
documents and a null id is a document like others; columns other than the id and the text pass through
sanitise() and are ignored by find().
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import SPACES, map_rows, mix, words, written
from meldwork.llm.components import looked_up

#: The kinds, in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans.
NAMES = (*KINDS, "secret", "term")
SECRET, TERM = 4, 5
#: What the low bits of a group's number say beside the five kinds of exact values: a class, a kind.
_CLASS, _KIND = 5, 6
#: Words on each side of an entity that count as near it.
WINDOW = 64
#: Numbers that no term has: how many documents hold a group, and of how many terms its evidence is the best.
_HOLDERS, _CANDIDATES = 0, 1
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't begin inside a run of digits that a search has passed, so both may ask for its beginning.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]{1,63})[\"']? ?[=:] ?[\"']?([A-Za-z0-9][A-Za-z0-9_+/=~-]{15,})")
#: Characters at which terms end.
BREAKS = SPACES + ".,;:!?()[]{}<>\"'|/\\*#$%&=~`^"
#: Flagged pairs of term and entity that a task holds (eight bytes each); more are brought to the rows by a join.
MAX_PAIRS = 1 << 21


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every entity, in order."""
    out = [(i, 0, j) for i, j in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def secret_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, label) of every value that is set behind a label and holds letters and digits, outside the base spans."""
    if "=" not in text and ":" not in text:
        return []
    found = [(m.start(2), SECRET, m.end(2), m[1].lower()) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[2]) and any(c.isalpha() for c in m[2])]
    covered = _Cover([(i, j) for i, _, j in base])
    return [s for s in found if not covered.touches(s[0], s[2])]


class _Cover:
    """Spans, merged, to ask whether they touch another."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [], []
        for i, j in sorted(spans):
            if self.ends and i <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], j)
            else:
                self.starts.append(i)
                self.ends.append(j)

    def touches(self, i: int, j: int) -> bool:
        k = bisect_right(self.starts, j - 1) - 1
        return k >= 0 and self.ends[k] > i


def _number(name: str, mark: int) -> int:
    return xxhash.xxh64_intdigest(name) >> 4 << 3 | mark


def _byte_places(text: str) -> np.ndarray | None:
    """The byte at which each code point begins, and the text's end; None where that is the code point's own number."""
    if text.isascii():
        return None
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))


class _Text:
    """A text's entities and terms: what it holds, and which terms stand near which group."""

    def __init__(self, text: str) -> None:
        self.base = base_spans(text)
        self.secrets = secret_spans(text, self.base)
        self.text = text

    def read(self) -> None:
        h, _, start, end = words(pa.array([self.text]), BREAKS)
        places = _byte_places(self.text)
        spans = [(i, k, j, "") for i, k, j in self.base] + self.secrets
        at = np.array([(i, j) for i, _, j, _ in spans], np.int64).reshape(-1, 2)
        if places is not None:
            at = places[at]
        inside = np.zeros(int(max(end.max(initial=0), at.max(initial=0))) + 2, np.int64)
        np.add.at(inside, at[:, 0], 1)
        np.add.at(inside, at[:, 1], -1)
        held = np.concatenate(([0], np.cumsum(np.cumsum(inside) > 0)))
        keep = np.flatnonzero((end - start >= 3) & (held[end] == held[start]))
        self.terms, self.start, self.end, self.order = h[keep], start[keep], end[keep], keep
        if places is not None:
            self.start, self.end = np.searchsorted(places, self.start), np.searchsorted(places, self.end)
        word = np.searchsorted(start, at[:, 0], "right") - 1
        self.near: dict[int, list[int]] = {}
        for (i, k, j, label), w in zip(spans, word.tolist(), strict=True):
            for group in _groups(self.text[i:j].lower(), k, label):
                self.near.setdefault(group, []).append(w)

    def groups(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each group and the places of the terms near it."""
        for group, at in self.near.items():
            w = np.unique(np.array(at, np.int64))
            low, high = np.searchsorted(self.order, w - WINDOW), np.searchsorted(self.order, w + WINDOW, "right")
            low[1:] = np.maximum(low[1:], high[:-1])  # stretches that overlap count once
            n = np.maximum(high - low, 0)
            yield group, np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each group and the different terms near it."""
        for group, at in self.groups():
            yield group, np.unique(self.terms[at]).view(np.int64)


def _groups(value: str, kind: int, label: str) -> tuple[int, int, int]:
    """Numbers of an entity's exact value, its class and its kind.

    The class is a mail's domain, an address's first two numbers, a card's first six, a phone's first four digits, a secret's label.
    """
    digits = re.sub(r"[^0-9]", "", value)
    part = (value[value.rfind("@") :], ".".join(x.lstrip("0") or "0" for x in value.split(".")[:2]), digits[:6], digits[:4], label)[kind]
    exact = digits if kind in (2, 3) else value
    return _number(f"{NAMES[kind]}:{exact}", kind), _number(f"{NAMES[kind]}/{part}", _CLASS), _number(NAMES[kind], _KIND)


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct rows of the key columns, and the sums of the value columns over each."""
    if not len(keys[0]):
        return [*keys, *values]
    order = np.lexsort(keys[::-1])
    head = np.ones(len(order), bool)
    head[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.flatnonzero(head)
    return [*(k[order][at] for k in keys), *(np.add.reduceat(v[order], at) for v in values)]


def _holding(docs: DataFrame, text_col: str) -> DataFrame:
    """(text, copies): the different texts that hold an entity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [t for t in batch.column(0).to_pylist() if t and (x := _Text(t)) and (x.base or x.secrets)]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["text"])

    return map_rows(docs.select(text_col), run, "text string").groupBy("text").agg(F.count("*").alias("copies"))


def _pairs(texts: DataFrame) -> DataFrame:
    """(entity, term, together, texts): in how many documents and different texts both are; with the term _HOLDERS those that hold the entity, with _CANDIDATES the terms near it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        for text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = _Text(text)
            own.read()
            for group, terms in own.pairs():
                parts[0].append(np.full(len(terms) + 2, group))
                parts[1].append(np.append(terms, (_HOLDERS, _CANDIDATES)))
                parts[2].append(np.append(np.full(len(terms) + 1, copies), len(terms)))
        entity, term, copies = map(np.concatenate, parts)
        out = _summed([entity, term], [copies, np.ones(len(copies), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["entity", "term", "together", "texts"])

    out = map_rows(texts, run, "entity long, term long, together long, texts long")
    # By the term alone, so that the join with the terms' counts needs no second exchange. The two numbers that no term has are spread by entity.
    spread = F.when(F.col("term").isin(_HOLDERS, _CANDIDATES), F.col("entity")).otherwise(F.col("term"))
    return out.groupBy("entity", "term", spread.alias("_at")).agg(F.sum("together").alias("together"), F.sum("texts").alias("texts")).drop("_at")


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n): how many documents hold each term."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, r, start, end = words(batch.column(0), BREAKS)
        long = end - start >= 3
        h, r = h[long], r[long]
        order = np.argsort(h, kind="stable")  # rows stay in order within a term
        h, r = h[order], r[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        term, n = np.unique(h[once], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    return map_rows(docs.select(text_col), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def revealing(docs: DataFrame, text_col: str = "text", disclosure: float = 0.9, chance: float = 0.05) -> DataFrame:
    """(entity, term): the pairs whose term gives the entity, its class or its kind away; with the term _HOLDERS, the secrets that are rare."""
    pairs = written(_pairs(written(_holding(docs, text_col), "pii-texts")), "pii-pairs")
    total = docs.count()
    holders = pairs.filter(F.col("term") == _HOLDERS).select("entity", F.col("together").alias("holders"), F.col("texts").alias("held"))
    candidates = pairs.filter(F.col("term") == _CANDIDATES).select("entity", F.col("together").alias("candidates"))
    counted = written(_counted(docs, text_col), "pii-terms")
    vocabulary = max(1, counted.count())
    share = F.col("together") / F.col("n")
    # No entity has less than one holder, so a term below this share gives away too little of any, and one in fewer texts is too little evidence.
    known = pairs.filter(~F.col("term").isin(_HOLDERS, _CANDIDATES)).filter(F.col("texts") * math.log2(max(total, 2)) * 1.001 >= math.log2(vocabulary / chance))
    known = written(known.join(counted, "term").filter(share >= max(total, 1) ** (disclosure - 1) * 0.999), "pii-known")
    # A kind's rows are a large part of all, so the hubs are looked up.
    known = looked_up(known, written(holders.join(candidates, "entity"), "pii-holders"), ["entity"])
    content = -F.log2(F.col("holders") / total)
    information = F.log2(F.least(F.lit(1.0), share)) + content
    evidence = F.col("texts") * information - F.log2(F.greatest(F.col("candidates"), F.lit(vocabulary)))
    found = known.filter((content > 0) & (information >= disclosure * content) & (evidence >= -math.log2(chance))).select("entity", "term")
    rare = holders.filter((F.col("entity").bitwiseAND(7) == SECRET) & (F.col("held") * F.col("held") <= total))
    return found.unionByName(rare.select("entity", F.lit(_HOLDERS).cast("long").alias("term")))


def _spans_of(text: str, flagged: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those of rare secrets and of terms near an entity with which their pair is flagged."""
    own = _Text(text)
    if not (own.base or own.secrets) or not len(flagged):
        return own.base, []
    own.read()
    hit, mixed = np.zeros(len(own.terms), bool), mix(own.terms)

    def known(pair: np.ndarray) -> np.ndarray:
        return flagged[np.minimum(np.searchsorted(flagged, pair), len(flagged) - 1)] == pair

    for group, at in own.groups():
        hit[at] |= known(mix(mixed[at] ^ np.uint64(group)))
    more = [(i, TERM, j) for i, j in zip(own.start[hit].tolist(), own.end[hit].tolist(), strict=True)]
    numbers = np.array([_groups(text[i:j].lower(), k, label)[0] for i, k, j, label in own.secrets], np.uint64)
    rare = known(mix(mix(np.full(len(numbers), _HOLDERS, np.uint64)) ^ numbers)) if len(numbers) else []
    return own.base, more + [(i, k, j) for (i, k, j, _), r in zip(own.secrets, rare, strict=True) if r]


def _pair_hash(entity: np.ndarray, term: np.ndarray) -> np.ndarray:
    return np.sort(mix(mix(term.view(np.uint64)) ^ entity.view(np.uint64)))


def _with_flags(docs: DataFrame, text_col: str, options: dict) -> tuple[DataFrame, np.ndarray | None]:
    """The documents and the flagged pairs: one array for all up to MAX_PAIRS, else a column _terms by join on a key of the text.

    What is flagged in a row depends on its text alone, so equal texts share a key of 128 bits and the id plays no part.
    """
    pairs = written(revealing(docs, text_col, **options), "pii-revealing")
    if pairs.limit(MAX_PAIRS + 1).count() <= MAX_PAIRS:
        got = pairs.toArrow()
        return docs, _pair_hash(got["entity"].to_numpy(), got["term"].to_numpy())
    text = F.col(f"`{text_col}`")
    docs = docs.withColumns({"_k1": F.xxhash64(F.lit(1), text), "_k2": F.xxhash64(F.lit(2), text)})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [[np.zeros(0, np.int64)] for _ in range(4)]
        for t, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = _Text(t or "")
            if own.base or own.secrets:
                own.read()
                for group, terms in own.pairs():
                    n = len(terms) + 1
                    for part, x in zip(parts, (np.full(n, key[0]), np.full(n, key[1]), np.full(n, group), np.append(terms, _HOLDERS)), strict=True):
                        part.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in parts], names=["_t1", "_t2", "entity", "term"])

    holds = map_rows(docs.select(text_col, "_k1", "_k2"), run, "_t1 long, _t2 long, entity long, term long")
    terms = holds.join(pairs, ["entity", "term"], "left_semi").groupBy("_t1", "_t2").agg(F.collect_set(F.struct("entity", "term")).alias("_terms"))
    return docs.join(terms, (F.col("_k1") == F.col("_t1")) & (F.col("_k2") == F.col("_t2")), "left").drop("_k1", "_k2", "_t1", "_t2"), None


def _row_flags(batch: pa.RecordBatch, flagged: np.ndarray | None) -> Iterator[np.ndarray]:
    if flagged is not None:
        yield from (flagged for _ in range(batch.num_rows))
        return
    for pairs in batch.column("_terms").to_pylist():
        yield _pair_hash(*(np.array([x[c] for x in pairs or []], np.int64) for c in ("entity", "term")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    docs, flagged = _with_flags(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), "_text", options)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, flags in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _row_flags(batch, flagged), strict=True):
            base, terms = _spans_of(text or "", flags)
            count = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
            printed = ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in base)
            every = sorted([*base, *terms])
            rows.append((doc, *count, hashlib.sha256(printed.encode()).hexdigest(), ",".join(f"{NAMES[k]}:{i}:{j}" for i, k, j in every)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return map_rows(docs, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """docs with every entity generalised to its kind in brackets, every rare secret to [secret] and every revealing term to [term]."""
    columns, fields = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    docs, flagged = _with_flags(docs, text_col, options)

    def clean(text: str | None, flags: np.ndarray) -> str | None:
        base, terms = _spans_of(text or "", flags)
        out, done = [], 0
        for i, k, j in sorted([*base, *terms]):
            if i >= done:
                out += [text[done:i], f"[{NAMES[k]}]"]
            done = max(done, j)
        return "".join(out) + text[done:] if out else text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([clean(t, f) for t, f in zip(batch.column(text_col).to_pylist(), _row_flags(batch, flagged), strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([texts if c == text_col else batch.column(c) for c in columns], names=columns)

    return map_rows(docs, run, fields)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
