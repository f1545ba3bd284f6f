"""Secret scan with structural confirmation.

Patterns find the base spans (assignments, access key ids, long hex runs). Beyond these, a
candidate is reported only if its structure proves it: base64 or hex is decoded and must be

* ``token``: a signed token, whose first two parts are JSON objects, the first naming an algorithm;
* ``key``: a private key, in PEM armour or bare. The DER inside must be a SEQUENCE whose nested
  lengths add up exactly and that starts like PKCS#1, PKCS#8 or SEC 1; or the OpenSSH container,
  whose length-prefixed fields must add up.

Defined cases: a null or empty text has no span; ties cannot occur within a kind; a repeated row
is scanned again and gives a repeated result; an empty table gives an empty result; other columns
are not looked at. Time is linear in the length of a text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ._common import per_row, table

KINDS = ("assign", "access", "hex", "token", "key")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: An assignment holds one of these in lower case; plain search for them is far faster than the pattern.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]*+)\.(eyJ[A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]*+)")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]*+)-----END \1PRIVATE KEY-----")
#: DER starts with the byte 0x30: "M" in base64, "30" in hex.
BARE_64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/_-]{60,}+={0,2}")
BARE_HEX = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){40,}+")
OPENSSH = b"openssh-key-v1\0"


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(number of the kind, start, end) of what the patterns alone find."""
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 8:
                yield 0, m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield 1, m.start(), m.end()
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end()


def confirmed_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(number of the kind, start, end) of what decoding confirms."""
    if "eyJ" in text:
        for m in SIGNED.finditer(text):
            if is_signed_token(m[1], m[2]):
                yield 3, m.start(), m.end()
    armoured = []
    if "PRIVATE KEY-----" in text:
        for m in ARMOUR.finditer(text):
            if (data := decode64("".join(m[2].split()))) is not None and (is_private_der(data) or is_openssh(data) or m[1] == "ENCRYPTED " and der_value(data, 0) == len(data)):
                armoured.append(m.span())
                yield 4, *m.span()
    for m in BARE_64.finditer(text):
        if not any(a <= m.start() < b for a, b in armoured) and (data := decode64(m[0])) is not None and is_private_der(data):
            yield 4, *m.span()
    if "30" in text:
        for m in BARE_HEX.finditer(text):
            if is_private_der(bytes.fromhex(m[0])):
                yield 4, *m.span()


def decode64(text: str) -> bytes | None:
    """Base64 in either alphabet, padded or not; None if it isn't."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    parts = []
    for part in (header, payload):
        try:
            parts.append(json.loads(decode64(part) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in parts) and isinstance(parts[0].get("alg"), str)


def der_header(data: bytes, at: int) -> tuple[int, int] | None:
    """Start and end of the content of the DER value at ``at``, if that lies within the data."""
    if at + 2 > len(data):
        return None
    size, begin = data[at + 1], at + 2
    if size == 0x80 or size > 0x84:
        return None
    if size > 0x80:
        n = size - 0x80
        size, begin = int.from_bytes(data[begin : begin + n], "big"), begin + n
        if size < 0x80:
            return None
    return (begin, begin + size) if begin + size <= len(data) else None


def der_value(data: bytes, at: int, depth: int = 0) -> int | None:
    """End of the DER value at ``at`` if all nested lengths add up, else None."""
    if (content := der_header(data, at)) is None:
        return None
    begin, end = content
    if data[at] & 0x20:  # a constructed value holds values up to its end exactly
        if depth > 16:
            return None
        while begin < end:
            if (begin := der_value(data[:end], begin, depth + 1)) is None:
                return None
    return end


def is_private_der(data: bytes) -> bool:
    """PKCS#1 or PKCS#8 (version, then a number or an algorithm) or SEC 1 (version 1, then octets)."""
    if data[:1] != b"\x30" or der_value(data, 0) != len(data) or (outer := der_header(data, 0)) is None:
        return False
    at, tags = outer[0], []
    while at < outer[1] and len(tags) < 10:
        content = der_header(data, at)
        tags.append((data[at], data[content[0] : content[1]]))
        at = content[1]
    if len(tags) < 2 or tags[0][0] != 0x02 or len(tags[0][1]) != 1:
        return False
    version, second = tags[0][1][0], tags[1][0]
    return (
        second == 0x02 and version <= 1 and len(tags) >= 6 and all(tag == 0x02 for tag, _ in tags[:6])  # RSA, DSA
        or second == 0x30 and version <= 1 and len(tags) >= 3 and tags[2][0] == 0x04  # PKCS#8
        or second == 0x04 and version == 1 and len(tags[1][1]) >= 16  # SEC 1
    )


def is_openssh(data: bytes) -> bool:
    """Cipher, key derivation, its options, number of keys, public keys, private part: lengths add up."""
    if not data.startswith(OPENSSH):
        return False
    at, keys = len(OPENSSH), 1
    for i in range(100):
        if i == 3:
            keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if i == 4 + keys:
            return at == len(data)
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
    return False


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base and confirmed spans by start, then kind."""
    by = lambda x: (x[1], x[0], x[2])
    return sorted(base_spans(text or ""), key=by), sorted(confirmed_spans(text or ""), key=by)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's spans: doc_id and an array of (kind, start, end, base or not, the text found)."""

    def row(number: int, body: str | None) -> list:
        base, more = scan_text(body)
        spans = [(KINDS[k], a, b, base_one, body[a:b]) for found, base_one in ((base, True), (more, False)) for k, a, b in found]
        return [number, [dict(zip(("kind", "start", "end", "base", "secret"), x, strict=True)) for x in spans]]

    return per_row(docs.select(doc_id, text), f"{doc_id} {dict(docs.dtypes)[doc_id]}, spans array<struct<kind:string,start:long,end:long,base:boolean,secret:string>>", [doc_id, "spans"], row)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def row(number: int, body: str | None) -> list:
        base, more = scan_text(body)
        counts = [sum(k == kind for k, _, _ in base) for kind in range(3)]
        spans = joined(sorted(base + more, key=lambda x: (x[1], x[0], x[2])))
        return [number, *counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), spans]

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"
    return per_row(table(spark, sf_dir, "documents").select("doc_id", "text"), schema, names, row)
