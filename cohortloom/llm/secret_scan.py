"""Secret scans with structural confirmation.

Three base patterns report credentials by their looks. Beyond them, candidates
in base64 or hexadecimal are decoded, and reported only if what they hold
parses as a key or a signed token from end to end:

* ``jwt``: a header that is a JSON object with an ``alg``, and a JSON object as payload;
* ``key``: DER whose nested lengths add up exactly and whose outline is that of
  a PKCS#1, PKCS#8, encrypted PKCS#8, SEC1 or DSA private key, in a base64 run,
  a hexadecimal run or a PEM block;
* ``ssh``: the OpenSSH private key container with all its nested lengths.

Defined results: a null text counts as empty; an empty text has no spans;
repeated rows get equal results; every candidate is decoded whole, so the work
is linear in the text but for the sort of its spans.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "jwt", "key", "ssh")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ with 16 or more
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
# Possessive, so that no run is tried in more than one way.
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:(?:[0-9A-F]{2}){20,}+|(?:[0-9a-f]{2}){20,}+)(?![0-9A-Za-z])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.[A-Za-z0-9_-]*+")
_FENCE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
# Lines of a run, broken by line ends or by their escapes, and what quotes or comments put before a line.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{40,}+(?:\r?+\n|(?:\\r)?+\\n)[\x20\t>#*|]*+)++[A-Za-z0-9+/]*+={0,2}")
_BREAK = re.compile(r"\\r|\\n|[\s>#*|\"',\\]")
#: The least bytes of a modulus or prime.
_LARGE = 32
Span = tuple[int, int, int]  # start, place in KINDS, end


def decoded(run: str) -> bytes | None:
    """Base64, plain or for URLs, with or without padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def items(data: bytes) -> list[tuple[int, bytes]] | None:
    """DER items (tag, content) that fill ``data`` exactly, else None."""
    out, at, n = [], 0, len(data)
    while at < n:
        if at + 2 > n:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > n:
                return None
            size = int.from_bytes(data[at : at + wide], "big")
            if size < 0x80:  # DER takes the short form there
                return None
            at += wide
        if at + size > n:
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_key(data: bytes) -> bool:
    """The outline of a private key in DER."""
    top = items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = items(top[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if all(t == 0x02 for t in tags):  # RSA: version and eight numbers; DSA: version and five
        return parts[0][1] in (b"\0", b"\1") and len(tags) in (6, 9) and len(parts[1][1]) >= _LARGE and all(x for _, x in parts)
    if tags[:3] == [0x02, 0x30, 0x04] and parts[0][1] in (b"\0", b"\1"):  # PKCS#8
        return _algorithm(parts[1][1]) and _inner_key(parts[2][1])
    if tags == [0x30, 0x04]:  # PKCS#8, encrypted
        return _algorithm(parts[0][1]) and len(parts[1][1]) >= 16
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\1":  # SEC1
        return len(parts[1][1]) >= 16 and all(t in (0xA0, 0xA1) and items(x) for t, x in parts[2:])
    return False


def _inner_key(data: bytes) -> bool:
    """What PKCS#8 wraps: a key of its own, or one string or number of a key's size."""
    inner = items(data)
    if not inner or len(inner) != 1:
        return False
    tag, body = inner[0]
    return is_private_key(data) if tag == 0x30 else tag in (0x02, 0x04) and len(body) >= 16


def _algorithm(data: bytes) -> bool:
    inner = items(data)
    return bool(inner) and inner[0][0] == 0x06 and 3 <= len(inner[0][1]) <= 32


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's container: names, options, public keys and the private part, each with its length."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, n = len(magic), len(data)

    def text() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > n or at + 4 + size > n:
            return None
        at += 4 + size
        return data[at - size : at]

    if not text() or not text() or text() is None or at + 4 > n:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= n // 4 and all(text() for _ in range(keys)) and bool(text()) and at == n


def _object(part: str) -> dict | None:
    try:
        found = json.loads(decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _kind(data: bytes | None) -> int | None:
    if data and data[0] == 0x30 and is_private_key(data):
        return 4
    return 5 if data and is_ssh_key(data) else None


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[Span]:
    """What decodes and parses."""
    out: set[Span] = set()
    if "ey" in text:
        out |= {(m.start(), 3, m.end()) for m in _JWT.finditer(text) if "alg" in (_object(m[1]) or ()) and _object(m[2]) is not None}
    inside = []
    if "-----BEGIN " in text:
        begun = None
        for m in _FENCE.finditer(text):
            if m[1] == "END" and begun is not None and begun[2] == m[2]:
                kind = _kind(decoded(_BREAK.sub("", text[begun.end() : m.start()])))
                if kind is not None:
                    out.add((begun.start(), kind, m.end()))
                    inside.append((begun.start(), m.end()))
            begun = m if m[1] == "BEGIN" else None
    for m in _LINES.finditer(text):
        kind = _kind(decoded(_BREAK.sub("", m[0])))
        block = bisect_right(inside, (m.start(), len(text))) - 1
        if kind is not None and not (block >= 0 and m.end() <= inside[block][1]):
            out.add((m.start(), kind, m.end()))
            inside.append((m.start(), m.end()))
            inside.sort()
    for pattern, decode in ((_RUN, decoded), (_ANY_HEX, bytes.fromhex)):
        for m in pattern.finditer(text):
            kind = _kind(decode(m[0]))
            block = bisect_right(inside, (m.start(), len(text))) - 1
            if kind is not None and not (block >= 0 and m.end() <= inside[block][1]):
                out.add((m.start(), kind, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """For each row the number of spans of each base kind, their digest, and all spans in code points, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: tuple[list[int], ...] = ([], [], [], [])
            digest, every = [], []
            for x in b.column(1):
                text = x.as_py() or ""
                base, more = base_spans(text), confirmed_spans(text)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                counts[3].append(len(more))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(sorted({*base, *more})))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=pa.int64()) for c in counts[:3]), pa.array(digest, type=pa.string()), pa.array(every, type=pa.string()), pa.array(counts[3], type=pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``secrets`` replaced in the text."""
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for a, _, b in sorted({*base_spans(text), *confirmed_spans(text)}):
            if b > end:
                if a >= end:
                    out += [text[end:a], mark]
                end = b
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([clean(x.as_py()) for x in b.column(at)], type=b.column(at).type))

    return docs.mapInArrow(run, docs.schema)
