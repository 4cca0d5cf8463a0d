"""Secret scan: base patterns, and candidates confirmed by decoding them and parsing their structure."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, texts_of

KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")  # every assign match has one of these
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# the body may hold hyphens, as the headers of old encryption do, but no five in a row: it ends before the next BEGIN or END
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([^-]*+(?:-(?!----)[^-]*+)*+)-----END \1-----")
LINE_END = re.compile(r"(?:\\+r)?\\+n|\r\n?")  # \r and \n as two characters each are line ends in JSON and env files
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
# base64 of DER starts with the byte 0x30 (M, then A to P), of OpenSSH's magic with b3BlbnNzaC1rZXktdjEA, of PEM with LS0tLS1CRUdJTi
B64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNzaC1r|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{30,}={0,2}")
HEXDER = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){30,}(?![0-9A-Fa-f])")


def der(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, bytes, int, int]] | None:
    """The DER elements that fill data[at:end] exactly, as (tag, content, start, end); None if they don't."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, n, body = data[at], data[at + 1], at + 2
        if tag & 0x1F == 0x1F or n == 0x80:
            return None
        if n > 0x80:
            k = n - 0x80
            if k > 4 or body + k > end or not data[body] or k == 1 and data[body] < 0x80:
                return None  # lengths have their shortest form in DER
            n, body = int.from_bytes(data[body : body + k], "big"), body + k
        if body + n > end:
            return None
        out.append((tag, data[body : body + n], at, body + n))
        at = body + n
    return out


def private_der(data: bytes) -> bool:
    """Is this one PKCS#8, PKCS#1, SEC1 or encrypted PKCS#8 private key, nested lengths and all?"""
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der(top[0][1])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags[:1] == [2] and len(parts) >= 3:
        if tags[1:3] == [0x30, 4] and parts[0][1] in (b"\0", b"\1"):  # PKCS#8: version, algorithm, key
            inner = der(parts[1][1])
            return bool(inner) and inner[0][0] == 6
        if tags == [2] * 9 and parts[0][1] == b"\0":  # PKCS#1: nine integers, the modulus longer than the primes
            return len(parts[1][1]) > max(len(parts[4][1]), len(parts[5][1])) >= 16
        if tags == [2] * 6 and parts[0][1] == b"\0":  # DSA
            return len(parts[1][1]) > len(parts[2][1]) >= 16
    if tags[:2] == [2, 4] and parts[0][1] == b"\1":  # SEC1
        return len(parts[1][1]) in (20, 24, 28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 4]:  # encrypted PKCS#8: the algorithm is one of PKCS#5 or PKCS#12 (1.2.840.113549.1.5 or .12)
        inner = der(parts[0][1])
        return bool(inner) and inner[0][0] == 6 and inner[0][1][:8] in (b"*\x86H\x86\xf7\r\1\5", b"*\x86H\x86\xf7\r\1\x0c")
    return False


def private_ssh(data: bytes) -> bool:
    """OpenSSH's container: magic; cipher, derivation and its options; a count of keys; that many public keys and one
    private part, all length-prefixed. They fill the data exactly."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at, fields, wanted = 15, [], 4
    while len(fields) < wanted:
        if len(fields) == 3 and wanted == 4:
            wanted = 4 + int.from_bytes(data[at : at + 4], "big")
            at += 4
            if wanted == 4:
                return False
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            return False
        fields.append(n)
    return at == len(data) and fields[0] > 0 and all(fields[3:])


def unbase64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None, depth: int = 0) -> str | None:
    if not data:
        return None
    if private_der(data):
        return "der_key"
    if private_ssh(data):
        return "ssh_key"
    if depth < 2 and data.startswith(b"-----BEGIN"):
        m = PEM.search(data.decode("latin-1"))
        if m and pem_body(m[2], depth + 1):
            return "pem_key"
    return None


def pem_body(body: str, depth: int = 0) -> bool:
    """Does a key, plain or encrypted, fill this PEM body, whose line ends may be escaped?"""
    body = LINE_END.sub("\n", body).replace("\\/", "/")
    return bool(key_kind(unbase64(body), depth)) or _legacy(body)


def _legacy(body: str) -> bool:
    """A PEM body with the headers of old encryption, and then whole cipher blocks."""
    head, _, rest = "\n".join(x.strip() for x in body.split("\n")).strip("\n").partition("\n\n")
    data = unbase64(rest)
    return "Proc-Type: 4,ENCRYPTED" in head and "DEK-Info:" in head and bool(data) and len(data) % 8 == 0


def signed_token(m: re.Match) -> bool:
    """A signed token: JSON objects as header and payload, and an algorithm in the header that fits the signature."""
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in (m[1], m[2]))
    except (ValueError, RecursionError):
        return False
    if not (isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)):
        return False
    alg = head["alg"]
    if alg.lower() == "none":
        return False  # whatever stands behind it signs nothing
    sizes = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
    sig = unbase64(m[3])
    return bool(sig) and (len(sig) in sizes[alg] if alg in sizes else len(sig) >= 64)


RUN = np.zeros(256, dtype=bool)
RUN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", dtype=np.uint8)] = True


def long_run(text: str, least: int = 24) -> bool:
    """Is there a run of at least `least` base64 characters? Hex runs and encoded keys are such runs."""
    breaks = np.flatnonzero(~RUN[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)])
    if not len(breaks):
        return len(text) >= least
    return bool(breaks[0] >= least or len(text) and np.diff(breaks, append=len(text.encode("utf-8", "surrogatepass"))).max() > least)


def confirmed_spans(text: str, runs: bool = True) -> list[tuple[str, int, int]]:
    """Spans of keys and signed tokens whose decoded structure is whole. runs: long_run(text)."""
    out = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if pem_body(m[2]):
                out.append(("pem_key", m.start(), m.end()))
    inside = lambda a: any(s <= a < e for _, s, e in out)
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if signed_token(m)]
    for m in B64.finditer(text) if runs else ():
        if not inside(m.start()) and (kind := key_kind(unbase64(m[0]))):
            out.append((kind, m.start(), m.end()))
    for m in HEXDER.finditer(text) if runs else ():
        if not inside(m.start()) and private_der(bytes.fromhex(m[0])):
            out.append(("der_key", m.start(), m.end()))
    return out


def base_spans(text: str, runs: bool = True) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches a kind; matches that are too short go, and take their text with them."""
    out, low = [], text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if runs:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def joined(spans, order) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=order))


def by_start(span) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def find_secrets(docs: DataFrame) -> DataFrame:
    """Scans every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed, n_spans.

    Spans are kind:start:end in code points, the end exclusive. A null text counts as empty and gives no spans.
    Repeated rows give equal rows; null doc_ids are kept; other columns are ignored. No shuffle.
    """

    @lean
    def run(batches):
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                runs = long_run(text)
                base, more = base_spans(text, runs), confirmed_spans(text, runs)
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(joined(base, by_start).encode()).hexdigest(), joined(base + more, by_start), len(more), len(base) + len(more)))
            columns = [pa.array(v, k) for v, k in zip(zip(*rows), (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),) * 2)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed", "n_spans"])

    return documents(docs).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long, n_spans long"
    )
