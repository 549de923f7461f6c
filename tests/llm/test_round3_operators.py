"""Periodic runs, whitening and secret scans against brute force, and on awkward rows."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from meldwork.llm import common, fingerprints, html_main, near_dedup, packing, periods, repeats, secret_scan, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                part = w[i : j + q]
                if not any(all(a == b for a, b in zip(part, part[p:], strict=False)) for p in range(1, q)):
                    out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("key", [1, 2, 32])
def test_runs_equal_brute_force(key, monkeypatch):
    monkeypatch.setattr(periods, "MOST_KEY", key)
    rnd = random.Random(key)
    for _ in range(700):
        n, v = rnd.randint(0, 150), rnd.choice([1, 2, 2, 3, 6])
        w = [rnd.randrange(v) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            if n > 10:
                p, a = rnd.randint(1, max(1, n // 4)), rnd.randrange(n)
                for i in range(a, rnd.randint(a, n)):
                    w[i] = w[a + (i - a) % p]
        assert periods.find_runs(np.array(w, np.int64)) == slow_runs(w), w


def test_repetitive_texts_take_near_linear_time():
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    began = time.perf_counter()
    assert periods.find_runs(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    assert not periods.find_runs(np.array(b))
    assert time.perf_counter() - began < 20


def slow_op11(doc, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = slow_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11(spark, tmp_path):
    rnd = random.Random(3)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "\x85a b a b a b a b", "a\tb\x0ba\x0cb\ra b  a b c", "é ü " * 9, "x " * 90 + "y " * 40]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts + [" ".join(rnd.choice("ab c d".split()) for _ in range(rnd.randint(0, 120))) for _ in range(300)])]
    rows += [rows[5], (-4, "q r " * 30, 1, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, runs int, id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = periods.op11_periodic_runs(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want = [slow_op11(i, t) for i, t, _, _ in rows]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 10
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_op11_edges(spark):
    frame = spark.createDataFrame([(None, "a " * 8, 1)], "`d.id` long, `t.x` string, id int")
    (row,) = periods.periodic_runs(frame, "d.id", "t.x").collect()
    assert (row["id"], row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (None, 8, [(0, 8, 1)], "a")
    assert periods.periodic_runs(frame.limit(0), "d.id", "t.x").collect() == []


def test_jacobi():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        m = rng.normal(size=(n, n))
        a = m @ np.diag(10.0 ** -rng.uniform(0, 6, n)) @ m.T
        values, vectors = whitening.jacobi(a)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-13 * abs(a).max() * n)
        assert (np.diff(values) <= 0).all()
    # graded: the small eigenvalue of a scaled matrix keeps its digits
    d = np.diag([1.0, 1e-8])
    values, _ = whitening.jacobi(d @ np.array([[2.0, 1.0], [1.0, 2.0]]) @ d)
    assert abs(values[1] - 1.5e-16) < 1e-22


def vectors(n=300, d=6):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=d) * [3, 2, 1, 1, 0.5, 0.1]], 0) for i in range(n)]
    rows += [(900 + i, rows[7][1], 1) for i in range(200)]
    return [*rows, (None, rows[3][1], 2), (5, rows[5][1], 3), (950, None, 0), (951, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (952, [float("nan")] * d, 0), (953, [float("inf")] * d, 0), (954, [1.0], 0), (955, [], 0), (956, [1e300] * d, 0)]


def check(rows, got, most=16):
    kept = [(i, v) for i, v, _ in rows if v and len(v) == 6 and all(x is not None and np.isfinite(x) and abs(x) < 1e200 for x in v)]
    x = {tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for _, v in kept}
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    r = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in sorted(x)])
    values, basis = np.linalg.eigh(r.T @ r / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(most, len(values))
    assert len(got) == len(kept) * k
    for i, v in kept:
        ints = [int(np.floor(64 * c)) + 1_000_000 for c in v]
        mine = [g for g in got if g["vec_id"] == i and g["deviation"] == sum((n * c - s) ** 2 for c, s in zip(ints, sums, strict=True))]
        by = {}
        for g in mine:
            by.setdefault(g["component"], []).append(g)
        assert sorted(by) == list(range(1, k + 1))
        y = np.array([float(Fraction(n * c - s, n)) for c, s in zip(ints, sums, strict=True)]) @ basis / np.sqrt(values)
        for c, rows_of in by.items():
            assert abs(abs(rows_of[0]["whitened"]) - abs(y[c - 1])) < 1e-8
            assert abs(rows_of[0]["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9
    assert {g["n"] for g in got} == {n}
    assert max(g["identity_error"] for g in got) < 1e-9


def test_op12(spark, tmp_path):
    rows = vectors()
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op12_embedding_whitening(spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(rows, got.collect())


def test_op12_edges(spark):
    def run(rows, kind="vec_id long, embedding array<float>", **more):
        return whitening.whiten(spark.createDataFrame(rows, kind), **more).collect()

    assert run([]) == []
    assert run([(1, None), (2, [])]) == []
    (one,) = run([(1, [2.0])])
    assert (one["n"], one["deviation"], one["whitened"], one["explained"], one["identity_error"]) == (1, 0, None, None, 0.0)
    flat = run([(i, [float(i), 5.0]) for i in range(10)])
    assert {r["whitened"] is None for r in flat if r["component"] == 2} == {True}
    assert max(r["identity_error"] for r in flat) < 1e-12
    far = run([(i, [1e10 * i]) for i in range(3)])
    assert [r["deviation"] for r in far] == [None, 0, None]
    odd = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], "`v.id` long, `e.b` array<double>, x int")
    assert len(whitening.whiten(odd, "v.id", "e.b").collect()) == 2


# -- secrets ---------------------------------------------------------------------------------------------------------------


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")
    return bytes([tag]) + size + body


def whole_number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def rsa(bits=1024, seed=1):
    rnd = random.Random(seed)
    half = bits // 2
    return tlv(0x30, b"".join(map(whole_number, (0, rnd.getrandbits(bits) | 1 << bits - 1, 65537, rnd.getrandbits(bits), *(rnd.getrandbits(half) | 1 << half - 1 for _ in range(5))))))


OID = tlv(6, bytes.fromhex("2a864886f70d010101"))
PKCS8 = tlv(0x30, whole_number(0) + tlv(0x30, OID + tlv(5, b"")) + tlv(4, rsa()))
ED25519 = tlv(0x30, whole_number(0) + tlv(0x30, tlv(6, bytes.fromhex("2b6570"))) + tlv(4, tlv(4, bytes(range(32)))))
EC = tlv(0x30, whole_number(1) + tlv(4, bytes(range(32))) + tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))) + tlv(0xA1, tlv(3, b"\0\4" + bytes(64))))
LOCKED = tlv(0x30, tlv(0x30, OID + tlv(0x30, b"")) + tlv(4, bytes(range(64))))
PUBLIC = tlv(0x30, tlv(0x30, OID + tlv(5, b"")) + tlv(3, b"\0" + rsa()))


def openssh():
    s = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(b"ssh-ed25519" * 3) + s(bytes(160))


def b64(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode()


def jwt(alg="HS256", size=32, header=None):
    part = lambda x: b64(x, True).rstrip("=")
    return ".".join((part(json.dumps(header or {"alg": alg, "typ": "JWT"}).encode()), part(b'{"sub":"1"}'), part(bytes(range(size)))))


def pem(data, label="RSA ", gap="\n"):
    body = b64(data)
    return f"-----BEGIN {label}PRIVATE KEY-----{gap}" + gap.join(body[i : i + 64] for i in range(0, len(body), 64)) + f"{gap}-----END {label}PRIVATE KEY-----"


FERNET = b64(b"\x80\0\0\0\0" + bytes(range(4)) + bytes(16) + bytes(32) + bytes(32), True)


@pytest.mark.parametrize(
    ("text", "kind", "form"),
    [
        (b64(rsa()), "key", "rsa"), (b64(PKCS8), "key", "pkcs8"), (b64(ED25519), "key", "pkcs8"), (b64(EC), "key", "ec"), (b64(LOCKED), "key", "encrypted"), (b64(openssh()), "key", "openssh"), (rsa().hex(), "key", "rsa"), (EC.hex().upper(), "key", "ec"),
        (pem(rsa()), "key", "rsa"), (pem(PKCS8, ""), "key", "pkcs8"), (pem(openssh(), "OPENSSH "), "key", "openssh"), (pem(EC, "EC ", "\\n"), "key", "ec"), (b64(pem(rsa()).encode()), "key", "rsa"), (b64(b64(pem(EC, "EC ").encode()).encode()), "key", "ec"),
        (jwt(), "jwt", "HS256"), (jwt("RS256", 256), "jwt", "RS256"), (jwt("none", 0), "jwt", "none"), (b64(jwt().encode()), "jwt", "HS256"), (FERNET, "fernet", "fernet"),
    ],
)
def test_structures_are_confirmed(text, kind, form):
    for before, after in (("", ""), ("some é words ", " and more"), ("key: '", "'")):
        found = [s for s in secret_scan.spans(before + text + after) if s[1] >= 3]
        assert found == [(len(before), secret_scan.KINDS.index(kind), len(before) + len(text), form)]


@pytest.mark.parametrize("text", [b64(PUBLIC), b64(rsa()[:-1]), b64(rsa() + b"\0"), b64(bytes(range(90))), b64(openssh()[:-3]), jwt("HS256", 31), jwt(header={"typ": "JWT"}), "eyJhbGciOiJIUzI1NiJ9.!.x", pem(b"nothing"), "-----BEGIN PRIVATE KEY-----\nabc", FERNET[:-8], "MIIE" + "A" * 200, "30" * 40, "M" * 500])
def test_what_only_looks_like_one_is_not(text):
    assert [s for s in secret_scan.spans(f"x {text} y") if s[1] >= 3] == []


def slow_op13(doc, text):
    text, out = text or "", []
    for k, pattern in enumerate((r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?a:[A-Za-z0-9+/_.=-]+))""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[2] if k == 0 else m[0]) >= (12, 18, 16)[k]:
                out.append((m.start(), k, m.end()))
    out.sort()
    printed = ",".join(f"{secret_scan.BASE[k]}:{i}:{j}" for i, k, j in out)
    return (doc, *(sum(s[1] == k for s in out) for k in range(3)), hashlib.sha256(printed.encode()).hexdigest()), printed


def test_op13(spark, tmp_path):
    rnd = random.Random(8)
    bits = ["password", "PassWd", "ſecret", "secret", "toKen", "Token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "é", "\n", "deadBEEFdeadbeef0", "abcdefghijkl", "/+_.-", "zz", jwt(), b64(EC)]
    texts = [None, "", "token = \"" + "a1" * 20 + "\"", "secret:password=abcdefghijkl", "x" * 300_000 + " password: " + "y" * 12] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)] + [(3, texts[3], 1, "s"), (None, texts[2], 1, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, spans int, id string").write.parquet(f"{tmp_path}/documents.parquet")
    got = secret_scan.op13_secret_scan(spark, str(tmp_path))
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]
    want = [slow_op13(i, t) for i, t, _, _ in rows]
    found = got.collect()
    assert sorted(str(tuple(r)[:5]) for r in found) == sorted(str(w[0]) for w in want)
    for r in found:
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in secret_scan.BASE)
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
    assert sum(r["n_confirmed"] for r in found) > 20


def test_scans_take_linear_time():
    began = time.perf_counter()
    for text in ("-----BEGIN PRIVATE KEY-----" * 20_000, "eyJ." * 200_000, "token" * 100_000, "token " + " " * 400_000, "MII" * 200_000, "30" * 300_000, "ey" * 300_000 + ".a.b", "password=" * 60_000):
        secret_scan.spans(text)
    assert time.perf_counter() - began < 30


def test_redact(spark):
    frame = spark.createDataFrame([(1, f"a {jwt()} b token=abcdefghijkl c", "k"), (2, None, "k"), (3, "plain", "k")], "id long, `a.text` string, text string")
    assert [(r["id"], r["a.text"], r["text"]) for r in secret_scan.redact(frame, "a.text").orderBy("id").collect()] == [(1, "a [jwt] b [assign] c", "k"), (2, None, "k"), (3, "plain", "k")]
    assert secret_scan.redact(frame.limit(0), "a.text").collect() == []


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("run", [periods.op11_periodic_runs, secret_scan.op13_secret_scan])
def test_whole_table(spark, run):
    assert run(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_whole_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = whitening.op12_embedding_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows)
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_op10_fingerprints_are_smaller_than_their_texts(spark):
    got = fingerprints.op10_fingerprints(spark, SF).collect()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(text)
    long = [r for r in got if len(text[r["doc_id"]].split()) > 200]
    assert sum(len(r["fingerprint"]) for r in long) < sum(len(text[r["doc_id"]]) for r in long) / 3
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)


# Texts that html pages, packing and hashes of words must keep apart

PROSE = "Real text, which is long, has commas, and says something of note here."


@pytest.mark.parametrize(("part", "want"), [
    ('<p>The <span class="social">social</span> contract is a text of note.</p>', ["The social contract is a text of note."]),
    ("<p>Press <button>Go</button> or <label>this mark</label> to go on with it, please.</p>", ["Press or this mark to go on with it, please."]),
    (f"<p>{PROSE} <script>x()</script>More.</p>", [f"{PROSE} More."]),
    (f'<section class="share-price"><p>{PROSE}</p></section>', [PROSE]),
    (f'<div class="cookie-recipe"><h2>Dough</h2><p>{PROSE}</p>x</div>', ["Dough", PROSE, "x"]),
    (f'<div id="tags-explained"><p>{PROSE}</p></div>', [PROSE]),
    ('<div class="share-tools"><p><a href=1>Tell all of your friends about it</a></p></div>', []),
    (f'<div class="articleComments"><p>{PROSE}</p></div>', []),
    (f'<div class="comment-list"><p>{PROSE}</p></div>', []),
    (f'<div class="siteCookieBanner"><p>{PROSE}</p></div>', []),
    (f"<p>{PROSE} <a class=share href=1>Share</a></p>", [PROSE]),
    (f"<p>{PROSE} <span class=share><b>Tell</b> <a href=1>all</a></span> More.</p>", [f"{PROSE} More."]),
    ("<ul><li><a href=1>Linked item</a></li><li>Plain item</li></ul>", ["Linked item", "Plain item"]),
    ("<ul><li><a href=1>Home</a></li><li><a href=2>Products</a></li></ul>", []),
])
def test_prose_stays_whatever_its_class(part, want):
    page = f"<body><article><h1>Title</h1><p>{PROSE} 1</p>{part}<p>{PROSE} 2</p></article></body>"
    assert html_main.main_text(page).split("\n") == ["Title", f"{PROSE} 1", *want, f"{PROSE} 2"]


def test_blocks_of_labelled_pages():
    """Precision and recall of blocks over pages made of parts whose label is known."""
    rnd = random.Random(4)
    kept = ["<p>{}</p>", "<div class=share-price><p>{}</p></div>", '<p class="lead">{}</p>', "<blockquote><p>{}</p></blockquote>", "<section id=community-garden><p>{}</p></section>", "<ul><li>{}</li></ul>"]
    gone = ["<div class=ad>{}</div>", "<aside><p>{}</p></aside>", '<div class="reader-comments"><p>{}</p></div>', "<form><p>{}</p></form>", "<div class=cookieNotice><p>{}</p></div>", '<ul class="nav-list"><li><a href=1>{}</a></li></ul>']
    hits = found = wanted = 0
    for i in range(200):
        parts = [(f"Block {i} {j}, {' '.join(rnd.choice(['which', 'says,', 'a', 'word']) for _ in range(rnd.randint(8, 40)))}.", rnd.random() < 0.7) for j in range(rnd.randint(3, 12))]
        parts[0] = (parts[0][0], True)
        body = "".join(rnd.choice(kept if good else gone).format(text) for text, good in parts)
        got, want = set(html_main.main_text(f"<body><nav><a href=1>Home</a></nav><main><article>{body}</article></main></body>").split("\n")), {t for t, good in parts if good}
        hits, found, wanted = hits + len(got & want), found + len(got), wanted + len(want)
    assert hits == found == wanted


def test_words_of_equal_polynomials_have_different_hashes(spark):
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    for n in (1, 7, 8, 9, 16, 63, 64, 65, 2048):
        h, r, _, _ = common.words(pa.array([f"{thue[:n]} {other[:n]}", f"x {thue[:n].upper()}y {thue[:n].upper()}"]))
        assert h[0] != h[1] and h[0] == h[4] and len(set(h.tolist())) == 4 and r.tolist() == [0, 0, 1, 1, 1]
    frame = spark.createDataFrame([(1, f"{thue} q r"), (2, f"{other} q r"), (3, f"{thue.upper()}\tq r")], "doc_id long, text string")
    assert sorted((r["id"], r["component"]) for r in near_dedup.near_classes(frame, width=3, percent=85).collect()) == [(1, 1), (2, 2), (3, 1)]


def plain_fill(demand, limits):
    """The heuristic as it is defined, by loops."""
    share = [[d / m for d, m in zip(row, limits, strict=True)] for row in demand]
    left, bins, places, number = sorted(range(len(share)), key=lambda i: (-sum(share[i]), i)), {}, {}, 0
    while left:
        free, place = [1.0] * len(limits), 0
        while fits := [i for i in left if all(s <= f + 1e-9 for s, f in zip(share[i], free, strict=True))]:
            best = max(fits, key=lambda i: (sum(s * f for s, f in zip(share[i], free, strict=True)), -left.index(i))) if place else fits[0]
            left.remove(best)
            bins[best], places[best] = number, place
            free, place = [f - s for s, f in zip(share[best], free, strict=True)], place + 1
        number += 1
    return [bins[i] for i in range(len(share))], [places[i] for i in range(len(share))]


@pytest.mark.parametrize("seed", range(5))
def test_bins_equal_the_plain_heuristic(seed):
    demand = np.random.default_rng(seed).integers(1, 64, (120, 3)).astype(float)
    limits = np.array([128.0, 64.0, 256.0])  # powers of two, so that both sums are exact
    assert tuple(x.tolist() for x in packing.fill_bins(demand, limits)) == plain_fill(demand.tolist(), limits.tolist())


@pytest.mark.parametrize("size", [1, 5, 20, 60, 120, 700, 1100])
def test_short_documents_fill_their_sequences(size):
    demand = np.array([[size, 1, size - size // 4]] * 1000, float)
    limits = np.array([2048.0, 12, 1792])
    bins, places = packing.fill_elastic(demand, limits, 1)
    each = int(min(2048 // size, 1792 // (size - size // 4)))
    assert bins.max() + 1 <= max(1.05 * np.ceil(1000 * size / 2048), -(-1000 // each))
    assert all((demand[bins == b].sum(axis=0) <= limits)[[0, 2]].all() for b in np.unique(bins))
    if size >= 700:  # where the limit costs nothing it stands
        assert places.max() < 12
    assert packing.fill_elastic(demand[:0], limits, 1)[0].size == 0


def test_minimizers_equal_brute_force():
    """Blocks, windows of every width, and hashes that stand twice in a string."""
    rnd = np.random.default_rng(5)
    for n_bytes, letters, length in ((400, 2, 16), (900, 3, 17), (700, 1, 50), (3000, 2, 50), (40_000, 200, 50), (2000, 2, 130)):
        body = rnd.integers(97, 97 + letters, n_bytes).astype(np.uint8)
        value = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(common._STEP))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[body] * common._powers(common._STEP, n_bytes))))
        back = common._powers(common._BACK, n_bytes + 1)
        n, width = n_bytes - length + 1, length - repeats.GRAM + 1
        low, once, bits = repeats._minimizers(sums, back, n, width)
        grams = common.mix((sums[repeats.GRAM :] - sums[: -repeats.GRAM]) * back[: n_bytes - repeats.GRAM + 1]) >> np.uint64(bits)
        windows = np.lib.stride_tricks.sliding_window_view(grams, width)
        assert (low >> np.uint64(bits) == windows.min(axis=1)).all()
        hit = windows == windows.min(axis=1)[:, None]
        assert (once == (hit.sum(axis=1) == 1)).all()
        ring = (1 << bits) - 1
        assert (((low & np.uint64(ring)).astype(np.int64) == (np.arange(n) + hit.argmax(axis=1)) & ring)[once]).all()


def test_op3_answers_are_a_byte_a_fragment(spark):
    """A bucket answers by the order of the message, so the keys don't go back (17 bytes a fragment before)."""
    text = " ".join(f"{common.mix(np.arange(i, i + 1, dtype=np.uint64))[0]:x}" for i in range(3000))
    frame = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string").repartition(4, "doc_id")
    told = repeats._announce(repeats._slices(frame, "doc_id", "text"), 7, 50).cache()
    try:
        answers = repeats._answer(told, repeats.HOT).collect()
        by = {(r["bucket"], r["slice"]): r["n"] for r in told.collect()}
    finally:
        told.unpersist()
    assert answers and all(len(r["blob"]) == by[r["n"], r["slice"]] for r in answers)
    assert {x for r in answers for x in bytes(r["blob"])} == {1}
