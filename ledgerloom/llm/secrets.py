"""Secret scans: three base patterns, and spans that decode to a real key, token or credential.

Spans are (kind, start, end) in code points, end exclusive. The method's kinds are reported only once their structure holds:
  jwt      three base64url parts, a JSON header with `alg` and a JSON payload
  der      base64 (also in PEM lines) or hex whose nested DER lengths all agree and whose fields are those of a private key
  openssh  base64 of an openssh-key-v1 container whose length-prefixed fields all fit
  encoded  base64 or hex of UTF-8 text, of one line or many, that itself holds a base secret or any of the kinds above, at any depth

Base64 and hex are read in whole runs, and in lines of 60 or more characters, as encoders wrap them, also as one block. A run that is nothing as a whole may be glued to other text: it is read again behind each of its
`/`, `-` and `_`, where what comes first could begin a key or a text; a header of a token may stand behind these, too. Text may hold
tabs and line ends, but no other control characters.

Edge cases: a null or empty text has no spans; a candidate that fails to decode or parse is skipped; overlapping spans of different
kinds are all reported; work is linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # greedy runs are whole, so the length test can sit in the pattern
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "encoded")

JWT_START, JWT_PART = re.compile(r"(?<![A-Za-z0-9])eyJ"), re.compile(r"[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,24}PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]{16,}?)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")  # the shortest base secret has 14 bytes, which are 19 characters and padding
HEX_ANY = re.compile(r"(?:[0-9a-f]{2}){12,}|(?:[0-9A-F]{2}){12,}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{60,}+\r?\n[ \t]*+)+[A-Za-z0-9+/_-]*={0,2}")
SEPARATOR = re.compile(r"[/_-]")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def der_fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of each value between the offsets, or None if the lengths don't fill them exactly."""
    out = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size = data[start], data[start + 1]
        start += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size = int.from_bytes(data[start : start + n], "big")
            start += n
        if start + size > end:
            return None
        out.append((tag, start, start + size))
        start += size
    return out


def is_private_der(data: bytes) -> bool:
    """PKCS#1, SEC1 or PKCS#8: the outer sequence fills the data and the fields have the types and nested lengths of a key."""
    outer = der_fields(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    inner = der_fields(data, *outer[0][1:])
    if not inner or inner[0][0] != INTEGER or not 1 <= inner[0][2] - inner[0][1] <= 2:
        return False
    tags = [t for t, _, _ in inner]
    if len(tags) >= 9 and set(tags[:9]) == {INTEGER}:
        return True
    if len(tags) >= 2 and tags[1] == OCTETS and data[inner[0][1]] == 1:
        return inner[1][2] - inner[1][1] >= 16
    if len(tags) >= 3 and tags[1] == SEQUENCE and tags[2] == OCTETS:
        kind = der_fields(data, *inner[1][1:])
        return bool(kind) and kind[0][0] == OID and inner[2][2] - inner[2][1] >= 16
    return False


def is_openssh(data: bytes) -> bool:
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    at = 15
    for _ in range(3):  # cipher, key derivation, its options
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if size > 256 or at > len(data):
            return False
    keys = int.from_bytes(data[at : at + 4], "big")
    return 1 <= keys <= 16


def unbase64(text: str) -> bytes | None:
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_jwt(head: str, body: str, signature: str) -> bool:
    parts = [unbase64(head), unbase64(body)]
    if None in parts or (signature and unbase64(signature) is None):
        return False
    try:
        header, claims = (json.loads(p) for p in parts)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def plain_text(data: bytes | None) -> str | None:
    """The text that decoded bytes hold, if they hold text."""
    try:
        text = data.decode() if data else None
    except UnicodeDecodeError:
        return None
    return None if text is None or CONTROL.search(text) else text


def confirmed(data: bytes | None, deep: bool = True) -> str | None:
    """The kind that decoded bytes prove to be, if any; `deep` looks for more than base secrets in decoded text."""
    if not data or len(data) < 12:
        return None
    if data[0] == SEQUENCE and is_private_der(data):
        return "der"
    if is_openssh(data):
        return "openssh"
    text = plain_text(data)
    return "encoded" if text and (base_spans(text) or deep and structured_spans(text)) else None


def begins_text(data: bytes) -> bool:
    """Whether bytes could be the beginning of a text; a character cut off at their end doesn't count against it."""
    try:
        return not CONTROL.search(data.decode())
    except UnicodeDecodeError as e:
        return e.start > 8 and e.start >= len(data) - 3 and e.reason == "unexpected end of data" and not CONTROL.search(data[: e.start].decode())


def _fits_der(head: bytes, size: int) -> bool:
    """Whether the outer length that the first bytes give is that of `size` bytes."""
    if len(head) < 6 or head[0] != SEQUENCE:
        return False
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    return n <= 4 and 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]) == size


def glued_value(run: str) -> tuple[int, str] | None:
    """(offset, kind) of a base64 value that ends a run of other characters.

    Only beginnings that could be one are decoded whole. Where such a value is found to be no text at some place, others of its alignment that begin before the place aren't either, so a run is decoded a few times at most.
    """
    bare, bad = run.rstrip("="), [-1] * 4
    for m in SEPARATOR.finditer(bare):
        p = m.end()
        if len(bare) - p < 19:
            return None
        head = unbase64(bare[p : p + 24])
        if head is None:
            continue
        texts = begins_text(head) and bad[p % 4] <= p
        if not texts and not _fits_der(head, (len(bare) - p) * 3 // 4) and not head.startswith(b"openssh-key-v1\0"):
            continue
        data = unbase64(run[p:])
        if data is None:
            continue
        if kind := confirmed(data):
            return p, kind
        if plain_text(data):
            return None  # a text without secrets holds none behind its other separators
        if texts:
            try:
                at = len(data[: CONTROL.search(data.decode()).start()])
            except UnicodeDecodeError as e:
                at = e.start
            bad[p % 4] = max(bad[p % 4], p + at * 4 // 3 - 8)
    return None


def jwt_spans(text: str) -> list[tuple[int, int, int]]:
    """Token headers may stand behind `_`, `-` or `/`. The parts of a run are found once, however many headers could begin in it."""
    out, run, done = [], (-1, -1, -1), -1
    for m in JWT_START.finditer(text):
        at = m.start()
        if at < done:
            continue
        if at >= run[0]:
            head = JWT_PART.match(text, at).end()
            body = JWT_PART.match(text, head + 1).end() if text.startswith(".", head) else -1
            run = head, body, JWT_PART.match(text, body + 1).end() if body >= 0 and text.startswith(".", body) else -1
        head, body, end = run
        if end < 0 or head - at < 9 or body - head < 3 or not begins_text(unbase64(text[at : min(head, at + 24)]) or b"\xff"):
            continue
        if is_jwt(text[at:head], text[head + 1 : body], text[body + 1 : end]):
            out.append((at, 3, end))
            done = end
    return out


def unhex(text: str) -> bytes | None:
    try:
        return bytes.fromhex(text)
    except ValueError:
        return None


def wrapped_value(m: re.Match[str]) -> tuple[int, str | None] | None:
    """(end, kind) of a block of lines that decode as one value, with the last line or, where that is other text, without it."""
    for end in (m.end(), m.start() + len(m[0][: m[0].rindex("\n")].rstrip("\r"))):
        block = re.sub(r"\s", "", m.string[m.start() : end])
        for data in (unhex(block), unbase64(block)):
            # what is text as a whole isn't tried in other ways, so that nested values cost no more than their length
            if (kind := confirmed(data)) or plain_text(data):
                return end, kind
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the base patterns."""
    out = []
    low = text.lower() if text.isascii() else text
    if not text.isascii() or any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def within(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether a position lies in one of some ordered spans that don't overlap."""
    i = bisect_right(spans, (at, sys.maxsize)) - 1
    return i >= 0 and at < spans[i][1]


def structured_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "eyJ" in text:
        out += jwt_spans(text)
    armored: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if kind := confirmed(unbase64(re.sub(r"\\n|\\r|\s", "", m[2])), deep=False):
                out.append((m.start(), KINDS.index(kind), m.end()))
                armored.append(m.span())
    blocks: list[tuple[int, int]] = []
    for m in WRAPPED.finditer(text):
        if not within(armored, m.start()) and (value := wrapped_value(m)):
            end, kind = value
            blocks.append((m.start(), end))
            if kind:
                out.append((m.start(), KINDS.index(kind), end))
    for pattern, decode in ((BASE64, unbase64), (HEX_ANY, bytes.fromhex)):
        for m in pattern.finditer(text):
            if within(blocks, m.start()):
                continue
            data = decode(m[0])
            if kind := confirmed(data):
                out.append((m.start(), KINDS.index(kind), m.end()))
            elif decode is unbase64 and not plain_text(data) and (found := glued_value(m[0])):
                out.append((m.start() + found[0], KINDS.index(found[1]), m.end()))
    return out


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each by start, then kind."""
    base = base_spans(text)
    return sorted(base), sorted({*base, *structured_spans(text)})


SPAN = "array<struct<kind: string, start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): the base spans and all confirmed spans of every document. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans = [], []
            for text in b.column(1).to_pylist():
                for into, found in zip((base, spans), find_spans(text), strict=True):
                    into.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _SPANS), pa.array(spans, _SPANS)], ["doc_id", "base", "spans"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, base {SPAN}, spans {SPAN}")


def joined_spans(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact_text(text: str) -> str:
    """Each span replaced by a mark of its kind; overlapping spans become one mark, of the first."""
    out, at = [], 0
    for start, kind, end in find_spans(text)[1]:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every confirmed secret in `text_col` replaced; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact_text, na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(text_col)))


def scan_digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, KINDS[:3]), digest, joined_spans(F.col("spans")).alias("spans"))
