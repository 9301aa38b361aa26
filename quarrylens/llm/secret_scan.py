"""Secret scans with structural confirmation.

Base rules find assigned credentials, access-key ids and long hex strings.  Beyond
them, base64 and hex candidates are decoded and reported only if their bytes parse as
a private key (nested DER lengths that fill each other exactly, or the length-prefixed
OpenSSH layout), or if a dotted token's header and claims are JSON objects whose
signature fits the algorithm that the header names.  A key may begin anywhere in a run of
its alphabet and end before its end; it may be wrapped, indented, quoted, and stand in
JSON with its line ends written out.

Scale: one pass over whole texts, no shuffle; memory is that of a batch of texts.  Of a
candidate only the heads of its items are decoded, so a text's time grows with its length.

Edge cases: null and empty texts have no spans; repeated rows are scanned one by one,
alike; a very long text comes alone in its batch; extra columns are ignored by ``scan`` and passed through by ``redact``; an empty
table gives an empty result; a null ``doc_id`` stays null.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import map_frames

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_key long, n_signed long, n_spans long"
)
MARK = "[REDACTED]"

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "key", "signed")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: How lines are wrapped: line ends of any kind, also written out as in JSON, with blanks
#: and marks of quotation around them.
WRAP = r"[\x20\t]*(?:\r|\n|\\r|\\n)(?:[\x20\t>\r\n]|\\r|\\n)*"
UNWRAP = re.compile(rf"{WRAP}|[\x20\t:]+")
#: Base64 in either alphabet and hex (with colons or without) that may be wrapped.
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{WRAP}[A-Za-z0-9+/_-]+)*")
ANY_HEX = re.compile(rf"[0-9A-Fa-f][0-9A-Fa-f:]{{31,}}(?:{WRAP}[0-9A-Fa-f][0-9A-Fa-f:]*)*")
#: A key between its marks, after header lines and an empty line if it has them.
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----[\x20\t]*((?:\r?\n[A-Za-z0-9-]+:[^\r\n]*(?:\r?\n[\x20\t]+[^\s][^\r\n]*)*)*)([^-]+)-----END \1-----")
CIPHER = re.compile(r"DEK-Info:\x20*([A-Za-z0-9-]+),([0-9A-Fa-f]+)\x20*\r?(?:\n|$)")
#: Runs in which dotted tokens stand, and how a JSON object may begin in base64.
DOTTED = re.compile(r"[A-Za-z0-9_-]{2,}(?:\.[A-Za-z0-9_-]*){2,}")
OBJECT_START = re.compile(rb"[\x20\t\r\n]*\{")

#: How a DER sequence of a key's size, or the OpenSSH magic word, begins: in base64 and hex.
MAGIC = b"openssh-key-v1\0"
STARTS_64 = re.compile("M[D-I]|" + base64.b64encode(MAGIC).decode())
STARTS_HEX = re.compile("(?i)30(?:8[1-4]|[3-7][0-9a-f])|" + MAGIC.hex())
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Bytes of a signature: (least, most).  Fixed values of the published token algorithms.
SIGNATURES = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64),
    "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114),
    "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024),
    "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024),
}


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not; None if it is none."""
    plain = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Encoded:
    """Bytes written from a place of a clean string on; only what is asked for is decoded."""

    def __init__(self, clean: str, at: int, hexadecimal: bool):
        self.clean, self.at, self.hexadecimal = clean, at, hexadecimal
        left = len(clean) - at
        self.size = left // 2 if hexadecimal else left * 3 // 4

    def chars(self, size: int) -> int:
        """Characters that so many bytes take, without padding."""
        return 2 * size if self.hexadecimal else -(-size * 4 // 3)

    def read(self, begin: int, size: int) -> bytes:
        end = min(begin + size, self.size)
        if begin >= end:
            return b""
        if self.hexadecimal:
            return bytes.fromhex(self.clean[self.at + 2 * begin : self.at + 2 * end])
        group = begin // 3
        text = self.clean[self.at + 4 * group : self.at + 4 * -(-end // 3)]
        text = text[:-1] if len(text) % 4 == 1 else text
        return base64.b64decode(text + "=" * (-len(text) % 4))[begin - 3 * group : end - 3 * group]


Item = tuple[int, int, int]


def der_head(data: Encoded, at: int) -> Item | None:
    """(tag, begin, end) of the DER item at a place."""
    head = data.read(at, 6)
    if len(head) < 2:
        return None
    tag, length, begin = head[0], head[1], at + 2
    if length & 0x80:
        width = length & 0x7F
        if not 1 <= width <= 4 or len(head) < 2 + width:
            return None
        length, begin = int.from_bytes(head[2 : 2 + width], "big"), begin + width
    return (tag, begin, begin + length) if begin + length <= data.size else None


def der_items(data: Encoded, begin: int, end: int, most: int = 12) -> list[Item] | None:
    """The items that fill a stretch exactly, of which a key has ``most`` at most."""
    items: list[Item] = []
    while begin < end and len(items) < most:
        item = der_head(data, begin)
        if item is None or item[2] > end:
            return None
        items.append(item)
        begin = item[2]
    return items if begin == end else None


def der_key(data: Encoded) -> int | None:
    """The size of a private key at the start: PKCS#1, PKCS#8 (plain or encrypted), SEC1
    or DSA layout.  Only heads of items are decoded, so its cost doesn't grow with sizes."""
    outer = der_head(data, 0)
    if outer is None or outer[0] != SEQUENCE or not 24 <= outer[2]:
        return None
    inner = der_items(data, outer[1], outer[2])
    if not inner or len(inner) < 2:
        return None
    tags = [tag for tag, _, _ in inner]
    sizes = [end - begin for _, begin, end in inner]
    value = lambda k: data.read(inner[k][1], min(sizes[k], 4))
    named = lambda k: der_items(data, *inner[k][1:])
    holds = False
    if all(tag == INTEGER for tag in tags):  # RSA has version, n, e, d, p, q and three more; DSA version, p, q, g, y, x
        holds = len(tags) in (6, 9) and value(0) in (b"\0", b"\1") and sizes[1] >= 64
    elif tags[0] == INTEGER and sizes[0] == 1:
        if tags[1] == OCTETS:  # an elliptic-curve key
            holds = value(0) == b"\1" and 16 <= sizes[1] <= 72
        elif tags[1] == SEQUENCE and len(tags) >= 3 and tags[2] == OCTETS and sizes[2] >= 16:
            names = named(1)
            holds = bool(names) and names[0][0] == OBJECT
    elif tags == [SEQUENCE, OCTETS]:
        names = named(0)
        holds = bool(names) and len(names) == 2 and names[0][0] == OBJECT and names[1][0] == SEQUENCE and sizes[1] >= 32
    return outer[2] if holds else None


def openssh_key(data: Encoded) -> int | None:
    """The size of a key in the OpenSSH layout at the start: a magic word, then
    length-prefixed strings."""
    at = len(MAGIC)
    if data.read(0, at) != MAGIC:
        return None

    def number() -> int | None:
        nonlocal at
        four = data.read(at, 4)
        at += 4
        return int.from_bytes(four, "big") if len(four) == 4 else None

    def string() -> int | None:
        nonlocal at
        size = number()
        at += size or 0
        return size if size is not None and at <= data.size else None

    if not string() or not string() or string() is None:
        return None
    keys = number()
    if keys is None or not 1 <= keys <= 16 or any(string() is None for _ in range(keys)) or string() is None:
        return None
    return at


def key_size(data: Encoded) -> int | None:
    return openssh_key(data) or der_key(data)


def whole_key(body: str) -> bool:
    """Whether a text between marks is a key and nothing else."""
    clean = UNWRAP.sub("", "".join(body.split(" "))).rstrip("=").translate(ONE_ALPHABET)
    if not clean or not re.fullmatch("[A-Za-z0-9+/]+", clean):
        return False
    data = Encoded(clean, 0, False)
    return key_size(data) == data.size


#: The second alphabet of base64 in terms of the first.
ONE_ALPHABET = str.maketrans("-_", "+/")


def keys_in(text: str, start: int, end: int, hexadecimal: bool) -> Iterator[tuple[int, int]]:
    """The places of keys that begin anywhere in a stretch of wrapped base64 or hex."""
    pieces, places, at = [], [], start
    for gap in [*UNWRAP.finditer(text, start, end), None]:
        to = gap.start() if gap else end
        pieces.append(text[at:to])
        places.append(at)
        at = gap.end() if gap else end
    clean = "".join(pieces).translate(ONE_ALPHABET)
    begins = [0, *itertools.accumulate(map(len, pieces))]

    def place(k: int) -> int:
        piece = bisect.bisect_right(begins, k) - 1
        return places[piece] + k - begins[piece]

    at, starts = 0, STARTS_HEX if hexadecimal else STARTS_64
    while found := starts.search(clean, at):
        at = found.start() + 1
        data = Encoded(clean, found.start(), hexadecimal)
        size = key_size(data)
        # zeros behind it are the rest of a larger structure
        if size is None or (rest := data.read(size, 3)) and not any(rest):
            continue
        at = found.start() + data.chars(size)
        stop = place(at - 1) + 1
        if not hexadecimal:
            stop += len(re.compile("={0,2}").match(text, stop)[0])
        yield place(found.start()), stop


def is_locked(headers: str, body: bytes | None) -> bool:
    """The body of an encrypted PEM key: whole cipher blocks under a named cipher, whose
    initial vector fits a block."""
    cipher = CIPHER.search(headers)
    if not cipher or not body or "ENCRYPTED" not in headers:
        return False
    block = 16 if cipher[1].upper().startswith(("AES-", "CAMELLIA-", "ARIA-", "SEED-", "SM4-")) else 8
    return len(cipher[2]) == 2 * block and len(body) >= 48 and len(body) % block == 0


def json_object(part: str) -> dict | None:
    """The JSON object that a part of a token holds; read on only while it parses."""
    if not OBJECT_START.match(unbase64(part[:16]) or b""):
        return None
    size = 256
    while True:
        data = unbase64(part if size >= len(part) else part[: size // 4 * 4])
        try:
            text = (data or b"").decode("utf-8")
        except UnicodeDecodeError as error:
            if size >= len(part) or error.start < len(data) - 3:
                return None
            text = data[: error.start].decode("utf-8")
        try:
            found = json.loads(text)
            return found if size >= len(part) and isinstance(found, dict) else None
        except RecursionError:
            return None
        except ValueError as error:
            # an error before the end is no matter of what is still to come
            near = isinstance(error, json.JSONDecodeError) and (error.pos >= len(text) - 8 or "Unterminated" in error.msg)
            if size >= len(part) or not near:
                return None
        size *= 4


def signature_end(signature: str, algorithm: str) -> int | None:
    """How much of a part is the signature: all of it, or up to a sign of the alphabet that
    only divides it from what follows, where it has a usual size then."""
    least, most = SIGNATURES.get(algorithm, (1, 0))
    size = len(unbase64(signature) or b"")
    usual = {least} if least == most else {x for x in (64, 114, 128, 256, 384, 512, 1024) if least <= x <= most}
    if size in usual:
        return len(signature)
    divided = (n for n in sorted((-(-x * 4 // 3) for x in usual), reverse=True) if n < len(signature) and signature[n] in "_-")
    return next(divided, len(signature) if least <= size <= most else None)


def tokens_in(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The places of signed tokens in a run of dotted parts; a header may begin after a
    dash or underscore that divides it from what stands before."""
    parts, at = [], start
    for part in text[start:end].split("."):
        parts.append((at, part))
        at += len(part) + 1
    free = start
    for k in range(len(parts) - 2):
        (begin, head), (_, claims), (last, signature) = parts[k : k + 3]
        if begin < free or not OBJECT_START.match(unbase64(claims[:16]) or b""):
            continue
        for own in [0, *(m.end() for m in re.finditer("[-_]", head))]:
            header = json_object(head[own:])
            if header is None:
                continue
            algorithm = header.get("alg")
            size = (None if signature else 0) if algorithm == "none" else signature_end(signature, algorithm) if isinstance(algorithm, str) else None
            if size is not None and json_object(claims) is not None:
                free = last + size
                yield begin + own, free
                break


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, by start and then kind; code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of decoded candidates whose structure holds."""
    found: list[tuple[int, int, int]] = []
    if "-----BEGIN " in text:
        found += [(m.start(), 3, m.end()) for m in ARMOUR.finditer(text) if whole_key(m[3]) or is_locked(m[2], unbase64(m[3]))]
    if "." in text:
        found += [(a, 4, b) for m in DOTTED.finditer(text) for a, b in tokens_in(text, *m.span())]
    found.sort()
    starts, ends = [a for a, _, _ in found], [b for _, _, b in found]

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    for pattern, hexadecimal in ((BASE64, False), (ANY_HEX, True)):
        for m in pattern.finditer(text):
            found += [(a, 3, b) for a, b in keys_in(text, *m.span(), hexadecimal) if free(a, b)]
    return sorted(set(found))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_text(text: str | None) -> tuple:
    base = base_spans(text) if text else []
    more = confirmed_spans(text) if text else []
    n = [sum(kind == k for _, kind, _ in base + more) for k in range(len(KINDS))]
    spans = sorted(base + more)
    return n[0], n[1], n[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), n[3], n[4], len(spans)


def redacted(text: str | None) -> str | None:
    """The text with a mark in place of each run of overlapping spans."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for start, _, end in sorted(base_spans(text) + confirmed_spans(text)):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], MARK]
        at = end
    return "".join([*out, text[at:]]) if merged else text


def scan(documents: DataFrame) -> DataFrame:
    """One row of counts and spans for each document."""
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pd.DataFrame(list(map(scan_text, pdf["text"])), columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return map_frames(documents.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def redact(documents: DataFrame) -> DataFrame:
    """The documents with secrets replaced in ``text``; ``n_chars`` follows if present."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(redacted)

    out = documents.withColumn("text", cleaned("text"))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*documents.columns)
