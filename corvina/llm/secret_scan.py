"""Secret scans with structural confirmation.

Base patterns find assignments of credentials, access key ids and long hexadecimal strings. The method adds what its
structure proves: long base64 or hexadecimal runs are decoded and parsed. A private key is a DER SEQUENCE whose nested
lengths add up exactly and whose members are those of PKCS#1, PKCS#8 or SEC 1, or an OpenSSH container whose length-
prefixed strings add up; a signed token is three base64url parts whose header and claims are JSON objects and whose
header names an algorithm. A run that only looks random is not reported.

Spans are kind:start:end in code points, end exclusive, by start, then kind in the order of KINDS, then end: so spans that
start together have a fixed order. Null texts count as empty; empty texts have no spans. Rows are scanned each for itself,
repeated rows and rows that share a doc_id too. A carried column that has the name of an added one comes as
``<name>_given``. All patterns run in linear time, whatever a text's length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: The kinds in their order, base kinds first.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "key")
ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64,}|[0-9A-F]{64,})(?![0-9A-Za-z])")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
#: Line ends may be escaped, and slashes too, as in JSON.
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----((?:[A-Za-z0-9+/=\s]|\\+[nr/])++)-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
ESCAPES = re.compile(r"\\+[nr]|\\+(?=/)|\s+")
JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]+")

#: The fewest characters that BASE64 and ANY_HEX, and that JWT, can match: a text without a run of so many holds none.
SHORTEST_KEY, SHORTEST_TOKEN = 32, 13

SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if long_run(text, 32):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def long_run(text: str, n: int) -> bool:
    """Whether some run without blanks has n characters; only such texts can hold what the longer patterns need."""
    return len(text) >= n and max(map(len, text.split()), default=0) >= n


def der_nodes(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill ``data`` exactly; None if their lengths don't add up."""
    at, out = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 128:
            size = n - 128
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + n > len(data):
            return None
        content = data[at : at + n]
        if tag == SEQUENCE and depth < 8 and der_nodes(content, depth + 1) is None:
            return None
        out.append((tag, content))
        at += n
    return out


def is_private_key(data: bytes) -> bool:
    """DER of PKCS#1, PKCS#8 or SEC 1, or an OpenSSH private key."""
    if data[:15] == b"openssh-key-v1\0":
        at, strings = 15, 0
        while at + 4 <= len(data) and strings < 3:  # cipher, key derivation, its options
            at, strings = at + 4 + int.from_bytes(data[at : at + 4], "big"), strings + 1
        return strings == 3 and at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16
    if len(data) < 32 or data[0] != SEQUENCE:
        return False
    top = der_nodes(data)
    if not top or len(top) != 1:
        return False
    parts = der_nodes(top[0][1]) or []
    tags = [t for t, _ in parts]
    if tags[:1] != [INTEGER] or len(parts[0][1]) != 1:
        return False
    if len(tags) >= 9 and set(tags[:9]) == {INTEGER}:
        return True
    if tags[1:3] == [SEQUENCE, OCTETS]:
        return [t for t, _ in der_nodes(parts[1][1]) or []][:1] == [OID]
    return tags[1:2] == [OCTETS] and parts[0][1] == b"\x01" and 16 <= len(parts[1][1]) <= 72


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_starts(run: str) -> list[int]:
    """Where in a base64 run a key may start: at its start, and after a slash (of a path) if its first bytes say so."""
    out, n, at = [0], len(run.rstrip("=")), run.find("/")
    while at >= 0:
        at += 1
        if run.startswith("b3BlbnNzaC1rZXktdjEA", at):
            out.append(at)
        elif run.startswith("M", at) and (head := unbase64(run[at : at + 8])) and len(head) == 6 and head[0] == SEQUENCE:
            size = max(head[1] - 128, 0)
            if size <= 4 and (int.from_bytes(head[2 : 2 + size], "big") if size else head[1]) + 2 + size == (n - at) * 3 // 4:
                out.append(at)
        at = run.find("/", at)
    return out


def is_signed_token(text: str) -> bool:
    parts = text.split(".")
    try:
        header, claims = (json.loads((unbase64(p) or b"").decode("utf-8")) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(claims, dict) and isinstance(header.get("alg"), str) and unbase64(parts[2]) is not None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """What decoding and parsing prove."""
    out = []
    if "PRIVATE KEY-----" in text:
        for m in ARMOUR.finditer(text):
            data = unbase64(ESCAPES.sub("", m[1]))
            if data and is_private_key(data):
                out.append(("key", *m.span()))
    if "." in text and long_run(text, SHORTEST_TOKEN):
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    if not long_run(text, SHORTEST_KEY):
        return out
    within = [(s, e) for k, s, e in out if k == "key"]
    for m in BASE64.finditer(text):
        if not any(s <= m.start() < e for s, e in within):
            for at in key_starts(m[0]):
                data = unbase64(m[0][at:])
                if data and is_private_key(data):
                    out.append(("key", m.start() + at, m.end()))
                    break
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
            out.append(("key", *m.span()))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda x: (x[1], ORDER[x[0]], x[2]))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for _, s, e in in_order(spans):
        if s >= at:
            out += [text[at:s], mark]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id) with n_assign, n_access, n_hex, base_sha256, spans and redacted (the text without them)."""

    def make():
        def work(texts: list[str]) -> dict:
            out: dict[str, list] = {x: [] for x in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")}
            for t in texts:
                base = in_order(base_spans(t))
                spans = in_order(base + confirmed_spans(t))
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(sha256(shown(base).encode()).hexdigest())
                out["spans"].append(shown(spans))
                out["redacted"].append(redacted(t, spans) if spans else None)
            return out

        return work

    ddl = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
    return map_texts(docs, make, ddl, keep=["doc_id"] if keep is None else keep)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in text replaced; n_chars, where there is one, follows the new text."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text"))
    found = scan(held, keep=list(names.values()))
    text = F.coalesce("redacted", F.col(names["text"]))
    out = []
    for c, n in names.items():
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("redacted").isNull(), F.col(n)).otherwise(F.length("redacted").cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(n).alias(c))
    return found.select(*out)
