"""Secret scans with structural confirmation.

Base findings are plain patterns. Beyond them, every run that could be base64 or hexadecimal is decoded and reported
only if its structure holds: a DER key whose nested lengths add up, an OpenSSH key whose length-prefixed fields add up,
or a signed token whose header and payload are JSON objects with an ``alg``. Random base64 or hex is not reported.

Spans are code points, end exclusive. Cases: a null or empty text has no findings; a null doc_id is kept; repeated
rows are scanned row by row; an empty table gives an empty result; other columns are ignored. No shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binaries, per_batch

KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "signed_token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A line break in a run, also indented or escaped (as in JSON).
BREAK = r"(?:[ \t]*\r?\n[ \t]*|(?:\\r)?\\n)"
#: What may be an encoded key, one alphabet at a time: wrapped base64 counts as one run.
ENCODED = tuple(re.compile(rf"[A-Za-z0-9{a}]{{40,}}(?:{BREAK}[A-Za-z0-9{a}]+)*={{0,2}}") for a in ("+/", "_-"))
#: The body of a PEM block may be short, and its lines too.
PEM = re.compile(rf"-----BEGIN [A-Z0-9 ]+-----{BREAK}([A-Za-z0-9+/]+(?:{BREAK}[A-Za-z0-9+/]+)*={{0,2}})")
HEXED = re.compile(r"(?:[0-9a-fA-F]{2}){32,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")


def b64(text: str) -> bytes | None:
    """A run in either base64 alphabet, wrapped or not, padded or not."""
    s = re.sub(rf"{BREAK}|=", "", text).translate({45: 43, 95: 47})
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the DER values that fill data[start:end] exactly; None if the lengths do not add up."""
    out = []
    while start < end:
        if start + 2 > end:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 128:
                return None
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def is_der_key(data: bytes | None) -> bool:
    """A PKCS#1, PKCS#8, SEC 1 or subject-public-key structure: one sequence, its fields of the right tags and lengths."""
    if not data or len(data) < 30 or data[0] != 0x30 or not (top := der_items(data, 0, len(data))) or len(top) != 1:
        return False
    items = der_items(data, top[0][1], top[0][2])
    if not items:
        return False
    tags = [t for t, _, _ in items]
    if tags[0] == 0x02 and items[0][2] - items[0][1] == 1 and data[items[0][1]] <= 1:
        if len(items) >= 9 and set(tags[:9]) == {0x02}:  # RSA: version and eight integers
            return True
        if tags[1:3] == [0x30, 0x04]:  # PKCS#8: algorithm with an object identifier, then the key
            return _algorithm(data, items[1])
        return tags[1] == 0x04 and items[1][2] - items[1][1] in (28, 32, 48, 66)  # an elliptic-curve key
    return tags == [0x30, 0x03] and _algorithm(data, items[0])


def _algorithm(data: bytes, item: tuple[int, int, int]) -> bool:
    inner = der_items(data, item[1], item[2])
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]


def is_ssh_key(data: bytes | None) -> bool:
    """``openssh-key-v1`` with its length-prefixed fields, or a public key whose fields fill it exactly."""
    if not data:
        return False
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at = len(magic)
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data) or (at := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
                return False
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16
    n = int.from_bytes(data[:4], "big")
    if not 7 <= n <= 64 or not re.match(rb"(ssh|ecdsa|sk)-[\w@.-]+$", data[4 : 4 + n]):
        return False
    at, fields = 0, 0
    while at < len(data):
        if at + 4 > len(data) or (at := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
            return False
        fields += 1
    return fields >= 2


def _declared(data: bytes) -> int | None:
    """How long the DER value at the start says it is, with its header."""
    if len(data) < 2 or data[0] != 0x30:
        return None
    n, k = data[1], data[1] & 0x7F
    if not n & 0x80:
        return 2 + n
    return 2 + k + int.from_bytes(data[2 : 2 + k], "big") if 1 <= k <= 4 else None


def _key_kind(data: bytes | None) -> int | None:
    return 3 if is_der_key(data) else 4 if is_ssh_key(data) else None


def key_in(run: str) -> tuple[int, int] | None:
    """(kind, length) of the key that a run of base64 starts with: the whole run, else as much of it as the DER's own
    length takes, else as many whole lines as make a key (the most first)."""
    if kind := _key_kind(b64(run)):
        return kind, len(run)
    letters = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_-]+", re.sub(r"\\r(?=\\n)|\\n", lambda m: " " * len(m[0]), run))]
    bare = "".join(run[a:b] for a, b in letters)
    if n := _declared(b64(bare[:8]) or b""):
        size = -(-n * 4 // 3)
        if size <= len(bare) and is_der_key(b64(bare[:size])):
            for a, b in letters:
                if size <= b - a:
                    end = a + size
                    # the padding belongs to the key where it stands
                    return 3, end + len(re.match("={0,2}", run[end:])[0])
                size -= b - a
    elif bare.startswith(("AAAA", "b3Bl")):
        for _, b in reversed(letters[:-1]):
            if is_ssh_key(b64(run[:b])):
                return 4, b
    return None


def encoded_keys(text: str) -> list[tuple[int, int, int]]:
    """Keys in base64: of each run, from its start and from the start of each of its lines."""
    out: dict[tuple[int, int], int] = {}
    for pattern in (*ENCODED, PEM):
        for m in pattern.finditer(text):
            at, end = m.span(1) if pattern is PEM else m.span()
            starts = [at, *(at + x.end() for x in re.finditer(BREAK, text[at:end]))]
            done = at
            for a in starts:
                # base64 of 0x30 0x00-0xFF, of a length below 2**24 (public keys), or of the magic
                if a >= done and text.startswith(("M", "AAAA", "b3Bl"), a) and (got := key_in(text[a:end])):
                    done = a + got[1]
                    out[a, got[0]] = max(done, out.get((a, got[0]), 0))
    return [(a, k, b) for (a, k), b in out.items()]


def is_signed_token(header: str, payload: str) -> bool:
    try:
        h, p = (json.loads(b64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(p, dict)


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all findings, sorted; kind indexes KINDS."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += encoded_keys(text)
    for m in HEXED.finditer(text):
        if is_der_key(bytes.fromhex(m[0])):
            out.append((m.start(), 3, m.end()))
        elif is_ssh_key(bytes.fromhex(m[0])):
            out.append((m.start(), 4, m.end()))
    if "eyJ" in text:
        out += [(m.start(), 5, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    return sorted(set(out))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batch: pa.RecordBatch) -> dict:
    found = [scan(t if t is None else t.decode()) for t in binaries(batch.column("text"))]
    out = {"doc_id": batch.column("doc_id"), "spans": [_listed(x) for x in found]}
    for k, name in enumerate(KINDS):
        out[f"n_{name}"] = [sum(s[1] == k for s in x) for x in found]
    out["base_sha256"] = [hashlib.sha256(_listed([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found]
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the number of findings of each kind, all spans, and the digest of the base spans."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return per_batch(docs.select("doc_id", "text"), _scan, f"doc_id long, {counts}, base_sha256 string, spans string")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
