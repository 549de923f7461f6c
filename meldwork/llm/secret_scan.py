"""Secrets: three patterns, and encoded material that is reported only where its inner structure holds.

Three kinds come from patterns: a value behind a label (`assign`), an access key's id (`access`) and a run of
hexadecimal digits (`hex`). Three more are confirmed by structure: base64 and hexadecimal candidates are decoded and
reported as

- `key` if the bytes are a private key: DER of an RSA, DSA or elliptic key, wrapped or encrypted or not, in which all nested
  lengths fit to the byte, or the binary form that starts with "openssh-key-v1", whose lengths must do so too; as a
  block between BEGIN and END lines, as one run of base64 or as one of hexadecimal digits;
- `jwt` if it is a signed token: the header is a JSON object with a text for `alg`, the payload decodes, and the signature has
  the length that the algorithm gives; or an encrypted one of five parts with `enc` in the header;
- `fernet` if version, block count and signature of such a token fit.

A candidate may hold another one, as base64 of a key's text does; it is followed `DEPTH` times. What a `assign` or
`hex` span holds is judged too, and told in `form`. A candidate is a whole run of the alphabet, from its first character on.

Each text is scanned whole, in time linear in its length, in the task that reads it: no shuffle, no key, no broadcast.

Defined cases: null text is empty; a match that fails its condition goes and is not tried again from a later start; spans of
different kinds may overlap; positions are code points; equal and null ids are rows of their own; columns other than the id and the text are
ignored by find() and pass through redact().
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import map_rows

#: The kinds found by pattern, in the order in which spans with one start are listed, and those found by structure after them.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "jwt", "fernet")
#: How often a candidate inside a candidate is followed.
DEPTH = 3

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_LABELS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
# Runs of base64 or hexadecimal digits whose first bytes may begin a key, a block of text around one, a token, or either in base64 again.
_BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNz|LS0tLS|TFMwdExT|T[UV]|e[wy]|ZX[dl]|gAAAA|Z0FBQ)[A-Za-z0-9+/_-]{20,}={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70|2[Dd]2[Dd]|4[Dd]|65|80)[0-9A-Fa-f]{44,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[wy][A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}(?![A-Za-z0-9_.-])")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40})PRIVATE KEY-----")
_MAGIC = b"openssh-key-v1\0"
#: Bytes of a signature by algorithm; a pair is the least and the greatest.
SIGNATURES = {
    "none": (0, 0), "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114),
    "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024), "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024),
}


def decoded(run: str) -> bytes | None:
    """Base64 of either alphabet, with or without its padding."""
    bare = run.rstrip("=")
    if len(bare) % 4 == 1 or (len(run) > len(bare) and len(run) % 4):
        return None
    try:
        return base64.b64decode(bare.translate(str.maketrans("-_", "+/")) + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the DER element at a place; None if its length isn't in the shortest form or goes beyond the end."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if size < 0x80 or size >> 8 * (k - 1) == 0:
            return None
    return (tag, at, at + size) if at + size <= end and tag & 0x1F != 0x1F else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """The elements that fill a stretch to its end; none if they don't."""
    out = []
    while at < end:
        e = _element(data, at, end)
        if e is None:
            return []
        out.append(e)
        at = e[2]
    return out


def _algorithm(data: bytes, e: tuple[int, int, int]) -> bool:
    inner = _elements(data, e[1], e[2])
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]


def _filled(data: bytes, e: tuple[int, int, int]) -> bool:
    inner = _element(data, e[1], e[2])
    return inner is not None and inner[2] == e[2]


def der_form(data: bytes) -> str | None:
    """Which private key the bytes are, as DER."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return None
    parts = _elements(data, top[1], top[2])
    tags = [t for t, _, _ in parts]
    first = data[parts[0][1] : parts[0][2]] if parts else b""
    if tags == [0x02] * 9 and first == b"\0" and parts[1][2] - parts[1][1] >= 32:
        return "rsa"
    if tags == [0x02] * 6 and first == b"\0" and parts[1][2] - parts[1][1] >= 32:
        return "dsa"
    if tags[:3] == [0x02, 0x30, 0x04] and first in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0x81} and _algorithm(data, parts[1]) and _filled(data, parts[2]):
        return "pkcs8"
    if tags[:2] == [0x02, 0x04] and first == b"\1" and parts[1][2] - parts[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1} and all(_filled(data, p) for p in parts[2:]):
        return "ec"
    if tags == [0x30, 0x04] and _algorithm(data, parts[0]) and parts[1][2] - parts[1][1] >= 16:
        return "encrypted"
    return None


def openssh_form(data: bytes) -> str | None:
    """A key in the binary form of strings that tell their own lengths."""
    if not data.startswith(_MAGIC):
        return None
    at, fields = len(_MAGIC), []
    while at < len(data):
        if len(fields) == 3:  # the number of keys, of which each has a public string
            count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            fields.append(count)
            continue
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if at > len(data) or at < 4:
            return None
        fields.append(size)
    return "openssh" if len(fields) > 4 and fields[3] >= 1 and len(fields) == 5 + fields[3] and fields[-1] >= 16 else None


def fernet_form(data: bytes) -> str | None:
    """Version, time, vector, whole blocks and a signature."""
    blocks = len(data) - 1 - 8 - 16 - 32
    return "fernet" if blocks >= 16 and blocks % 16 == 0 and data[0] == 0x80 and data[1:4] == b"\0\0\0" else None


def token_form(run: str) -> str | None:
    """The algorithm of a signed or encrypted token, if all of it fits."""
    parts = run.split(".")
    if len(parts) not in (3, 5):
        return None
    bytes_of = [decoded(p) for p in parts]
    if any(b is None for b in bytes_of):
        return None
    try:
        header = json.loads(bytes_of[0])
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
        return None
    if len(parts) == 5:
        return f"{header['alg']}/{header['enc']}" if isinstance(header.get("enc"), str) and parts[2] and parts[3] and parts[4] else None
    low, high = SIGNATURES.get(header["alg"], (1, 1 << 16))
    return header["alg"] if parts[1] and low <= len(bytes_of[2]) <= high else None


def pem_form(body: str) -> str | None:
    """The key between a BEGIN and an END line: what its base64 holds, or that it is encrypted under a header that says so."""
    plain = body.replace("\\r", "\n").replace("\\n", "\n")
    lines = [x for x in (y.strip() for y in plain.split("\n")) if x]
    headers = [x for x in lines if ":" in x]
    data = decoded("".join(x for x in lines if ":" not in x).replace(" ", "").replace("\t", ""))
    if not data:
        return None
    if any(h.startswith("DEK-Info:") for h in headers):
        return "encrypted" if len(data) % 8 == 0 else None
    return der_form(data) or openssh_form(data)


def pem_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, form) of every BEGIN line with its END line and a key between them."""
    marks = list(_MARK.finditer(text))
    for m, n in zip(marks, marks[1:], strict=False):
        if (m[1], n[1]) == ("BEGIN", "END") and m[2] == n[2]:
            form = pem_form(text[m.end() : n.start()])
            if form:
                yield m.start(), n.end(), form


def inside(data: bytes, depth: int = DEPTH) -> tuple[str, str] | None:
    """(kind, form) of what decoded bytes are, or hold as text that is encoded again."""
    form = der_form(data) or openssh_form(data)
    if form:
        return "key", form
    form = fernet_form(data)
    if form:
        return "fernet", form
    if depth and data.isascii():
        text = data.decode().strip()
        for _, _, form in pem_spans(text):
            return "key", form
        return whole(text, depth - 1)
    return None


def whole(run: str, depth: int = DEPTH) -> tuple[str, str] | None:
    """(kind, form) of a run of base64 or hexadecimal digits, or of a token."""
    form = token_form(run) if run.startswith(("ew", "ey")) else None
    if form:
        return "jwt", form
    for data in (bytes.fromhex(run) if len(run) % 2 == 0 and _HEX_RUN.fullmatch(run) else None, decoded(run) if _BASE64_RUN.fullmatch(run) else None):
        found = inside(data, depth) if data else None
        if found:
            return found
    return None


def spans(text: str) -> list[tuple[int, int, int, str | None]]:
    """(start, number of the kind, end, form) of everything found, in order."""
    out: list[tuple[int, int, int, str | None]] = []
    low = text.lower()
    if any(x in low for x in _LABELS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                out.append((m.start(), 0, m.end(), "/".join(whole(m[2]) or ()) or None))
    out += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), "/".join(whole(m[0]) or ()) or None) for m in _HEX.finditer(text)]
    confirmed = {(i, j): ("key", form) for i, j, form in pem_spans(text)}
    ends = sorted(confirmed)
    for pattern in (_TOKEN, _BASE64_RUN, _HEX_RUN):
        block = 0
        for m in pattern.finditer(text):
            while block < len(ends) and ends[block][1] <= m.start():
                block += 1
            if block < len(ends) and ends[block][0] <= m.start():
                continue
            found = whole(m[0])
            if found:
                confirmed[m.span()] = found
    out += [(i, KINDS.index(kind), j, form) for (i, j), (kind, form) in confirmed.items()]
    return sorted(out, key=lambda s: s[:3])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("form", pa.string())])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every row's spans by start, then kind, each with its kind, place and, where structure was read, its form."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": KINDS[k], "start": i, "end": j, "form": form} for i, k, j, form in spans(t or "")] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], names=["id", "spans"])

    only = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(only, run, "id long, spans array<struct<kind:string,start:long,end:long,form:string>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; of spans that overlap, the first is named."""

    def clean(text: str | None) -> str | None:
        out, done = [], 0
        for i, k, j, _ in spans(text or ""):
            if i >= done:
                out += [text[done:i], f"[{KINDS[k]}]"]
            done = max(done, j)
        return "".join(out) + text[done:] if out else text

    at, columns = docs.columns.index(text_col), docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=columns)

    return map_rows(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def printed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed of every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    confirmed = F.size(F.filter("spans", lambda s: s["form"].isNotNull())).cast("long")
    return found.select(F.col("id").alias("doc_id"), *map(counted, BASE), F.sha2(printed(base), 256).alias("base_sha256"), printed(F.col("spans")).alias("spans"), confirmed.alias("n_confirmed"))
