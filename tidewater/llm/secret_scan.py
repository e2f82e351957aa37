"""Secrets in texts and in what is encoded inside them.

A worklist holds layers, the text itself first. Each is scanned and decoded in every way that applies: URL and Unicode escapes over
the whole layer, base64 runs (single lines, and blocks wrapped over several), and compressed data in these or behind %XX and \\xXX.
Every layer can tell which part of the original a part of it stands for: escapes and base64 character by character, compressed data as
a whole. A layer that stands for the same part with the same text as an earlier one is not taken up again, so data that decode to
themselves end. Escapes nested beyond ``LEVELS`` are decoded to the end in one pass with a stack, so each text costs time in proportion.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in their order, their patterns and the least lengths of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\x[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|apos|lt|gt|equals|colon);")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64 and nothing else follow the first, which may stand behind other text.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++(?=={0,2}[\"',;)\]}]*[ \t]*(?:\r?\n|\Z)))+={0,2}")
MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00")
# The first bytes of compressed data as written with %XX or \\xXX, where bytes that are printable may stand for themselves; what may follow.
PERCENT_MAGIC = re.compile(r"%1[fF]%8[bB]|(?:x|%78)(?:%01|\^|%5[eE]|%9[cC]|%[dD][aA])|(?:B|%42)(?:Z|%5[aA])(?:h|%68)(?:[1-9]|%3[1-9])|%[fF][dD](?:7|%37)(?:z|%7[aA])(?:X|%58)(?:Z|%5[aA])%00")
SLASH_MAGIC = re.compile(r"\\x1[fF]\\x8[bB]|(?:x|\\x78)(?:\\x01|\^|\\x5[eE]|\\x9[cC]|\\x[dD][aA])|(?:B|\\x42)(?:Z|\\x5[aA])(?:h|\\x68)(?:[1-9]|\\x3[1-9])|\\x[fF][dD](?:7|\\x37)(?:z|\\x7[aA])(?:X|\\x58)(?:Z|\\x5[aA])\\x00")
PERCENT_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|[!-$&-~]")
SLASH_BYTE = re.compile(r"\\x[0-9A-Fa-f]{2}|\\[abtnvfr0'\"\\]|[\x20-\x5b\x5d-\x7e]")
SLASHED = dict(zip("abtnvfr0'\"\\", b"\a\b\t\n\v\f\r\0'\"\\"))

#: Bytes that one compressed run may unfold to; beyond, the run counts as no text (a guard against bombs, and the bound on memory).
MOST_UNFOLDED = 64 << 20


#: Levels of escapes inside escapes that are layers of their own; what is nested deeper is one last layer.
LEVELS = 8

Place = Callable[[int, int], tuple[int, int]]


@dataclass
class Layer:
    """A text, the part of the original that each of its parts stands for (None: the text is the original), and its level of escapes."""

    text: str
    place: Place | None = None
    level: int = 0

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return self.place(a, b) if self.place else (a, b)

    def inside(self, text: str, place: Place, level: int = 0) -> Layer:
        """A layer whose parts stand for parts of this one."""
        outer = self.place
        return Layer(text, place if outer is None else lambda a, b: outer(*place(a, b)), level)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the findings in a text; kinds are positions in KINDS."""
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if any(word in low for word in WORDS) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _unescaped(run: str) -> str:
    if run[0] == "&":
        return html.unescape(run)
    if run[0] == "%":
        return binascii.unhexlify(run.replace("%", "")).decode("utf-8", "replace")
    if run[1] == "x":
        return binascii.unhexlify(run.replace("\\x", "")).decode("utf-8", "replace")
    if run[1] == "U" or run.startswith("\\u{"):
        code = int(run.strip("\\uU{}"), 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    return binascii.unhexlify(run.replace("\\u", "")).decode("utf-16-be", "replace")


def unescape(layer: Layer) -> Layer | None:
    """The layer with its escapes decoded, a run at a time; each decoded character stands for its whole run."""
    pieces, starts, ends, at = [], [], [], 0
    for m in ESCAPE.finditer(layer.text):
        plain = _unescaped(m[0])
        pieces += [layer.text[at : m.start()], plain]
        step = len(m[0]) // len(plain) if plain and len(m[0]) % len(plain) == 0 else 0
        inner = m.start() + step * np.arange(len(plain))
        starts += [np.arange(at, m.start()), inner if step else np.full(len(plain), m.start())]
        ends += [np.arange(at, m.start()) + 1, inner + step if step else np.full(len(plain), m.end())]
        at = m.end()
    if not pieces:
        return None
    rest = np.arange(at, len(layer.text))
    start, end = np.concatenate([*starts, rest]).astype(np.int64), np.concatenate([*ends, rest + 1]).astype(np.int64)
    return layer.inside("".join([*pieces, layer.text[at:]]), _by_arrays(start, end), layer.level + 1)


def _by_arrays(start: np.ndarray, end: np.ndarray) -> Place:
    return lambda a, b: (int(start[a:b].min()), int(end[a:b].max())) if a < b else (0, 0)


#: An escape that ends where the text does, for the stack.
LAST_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|apos|lt|gt|equals|colon);)\Z")
LONGEST_ESCAPE = 10
_CLOSING = frozenset("0123456789abcdefABCDEF};")


def unescape_wholly(layer: Layer) -> Layer | None:
    """The layer with its escapes decoded until none is left: what a decoded character completes is decoded in turn.

    One pass: each character is put on a stack once, and an escape takes at least three off for the one it puts on. Bytes beyond
    ASCII are taken one by one, which no pattern minds.
    """
    chars, starts, ends = [], [], []
    marks = []  # where on the stack an escape may begin
    for at, char in enumerate(layer.text):
        chars.append(char), starts.append(at), ends.append(at + 1)
        if char in "%\\&":
            marks.append(len(chars) - 1)
        while marks and len(chars) - marks[-1] <= LONGEST_ESCAPE and chars[-1] in _CLOSING and (m := LAST_ESCAPE.search("".join(chars[-LONGEST_ESCAPE:]))):
            size = m.end() - m.start()
            plain = _unescaped(m[0])[:1]
            begin, end = starts[-size], ends[-1]
            del chars[-size:], starts[-size:], ends[-size:]
            while marks and marks[-1] >= len(chars):
                marks.pop()
            chars.append(plain or "\ufffd"), starts.append(begin), ends.append(end)
            if plain in ("%", "\\", "&"):
                marks.append(len(chars) - 1)
    if len(chars) == len(layer.text):
        return None
    return layer.inside("".join(chars), _by_arrays(np.array(starts, np.int64), np.array(ends, np.int64)), layer.level + 1)


def _decompressor(first: bytes):
    makers = {b"\x1f": lambda: zlib.decompressobj(31), b"\x78": zlib.decompressobj, b"B": bz2.BZ2Decompressor, b"\xfd": lzma.LZMADecompressor}
    return makers[first]()


BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError)


def _unfolded(data: bytes) -> bytes | None:
    """Decompressed data, all members one after the other, or None if they are no compressed data or unfold beyond the bound."""
    out, size = [], 0
    while data.startswith(MAGIC):
        unit = _decompressor(data[:1])
        try:
            out.append(unit.decompress(data, MOST_UNFOLDED + 1 - size))
        except BROKEN:
            break  # whole members before it count
        size += len(out[-1])
        if size > MOST_UNFOLDED:
            return None
        data = unit.unused_data if unit.eof else b""
    return b"".join(out) if out else None


def _readable(data: bytes) -> tuple[str, Callable[[str], int]]:
    """Any data as text (what is sought is ASCII, so bytes of no encoding do no harm beside it), and the bytes that a beginning of it takes."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16", "replace"), lambda head: 2 + len(head.encode("utf-16-le", "surrogatepass"))
    return data.decode("utf-8", "surrogateescape"), lambda head: len(head) if head.isascii() else len(head.encode("utf-8", "surrogateescape"))


def _payload(data: bytes) -> tuple[str, Callable[[str], int] | None]:
    """The text in decoded data, decompressed as long as they are compressed, and its :func:`_readable` measure if they are not."""
    seen, plain = set(), True
    while data.startswith(MAGIC) and (key := hashlib.sha256(data).digest()) not in seen:
        seen.add(key)
        if not (inner := _unfolded(data)):
            break
        data, plain = inner, False
    text, measure = _readable(data)
    return text, measure if plain else None


def _byte(shown: str) -> int:
    if len(shown) == 1:
        return ord(shown)
    return SLASHED[shown[1]] if shown[0] == "\\" and len(shown) == 2 else int(shown[-2:], 16)


def _escaped_payload(text: str, at: int, byte: re.Pattern) -> tuple[int, str] | None:
    """(end, inner text) of the compressed data whose escaped bytes begin at ``at``; they end where their stream does."""
    shown, ends, out, size, unit = bytearray(), [], [], 0, None
    while unit is None or not unit.eof:
        shown.clear(), ends.clear()
        while len(shown) < 4096 and (m := byte.match(text, at)):
            # a plus sign is itself where it is escaped, and else a space
            shown.append(32 if byte is PERCENT_BYTE and m[0] == "+" else _byte(m[0]))
            ends.append(at := m.end())
        if not shown:
            break
        unit = unit or _decompressor(bytes(shown[:1]))
        try:
            out.append(unit.decompress(bytes(shown), MOST_UNFOLDED + 1 - size))
        except BROKEN:
            return None
        size += len(out[-1])
        if size > MOST_UNFOLDED:
            return None
    if not size:
        return None
    end = ends[len(ends) - len(unit.unused_data) - 1] if unit.eof else at
    return end, _payload(b"".join(out))[0]


def _in_base64(m: re.Match, inner: str, measure: Callable[[str], int]) -> Place:
    """The characters of a base64 run that hold the bytes of a part of its text; white space between lines counts along."""
    held = [n for n, c in enumerate(m[0]) if not c.isspace()] if m.re is WRAPPED else range(len(m[0]))

    def place(a: int, b: int) -> tuple[int, int]:
        first, last = measure(inner[:a]) * 4 // 3, -(-measure(inner[:b]) * 4 // 3)
        last = min(max(last, first + 1), len(held))
        return m.start() + held[min(first, last - 1)], m.start() + held[last - 1] + 1

    return place


def unwrap(layer: Layer) -> Iterator[Layer]:
    """A layer for each base64 run, block of base64 lines and escaped run of compressed data.

    Data are decompressed (repeatedly) if they are compressed; their text stands for the whole run. A line of a block is a run too, for
    it may stand on its own.
    """
    text = layer.text
    runs = list(BASE64.finditer(text))
    if "\n" in text:
        runs += WRAPPED.finditer(text)
    for m in runs:
        body = "".join(m[0].split()).rstrip("=")
        if len(body) % 4 == 1:
            body = body[:-1]  # the last character has too few bits for a byte
        inner, measure = _payload(base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4)))
        if inner:
            yield layer.inside(inner, _in_base64(m, inner, measure)) if measure else _whole(layer, m.start(), m.end(), inner)
    for mark, magic, byte in (("%", PERCENT_MAGIC, PERCENT_BYTE), ("\\x", SLASH_MAGIC, SLASH_BYTE)):
        if mark not in text:
            continue
        for m in magic.finditer(text):
            if found := _escaped_payload(text, m.start(), byte):
                yield _whole(layer, m.start(), *found)


def _whole(layer: Layer, a: int, b: int, inner: str) -> Layer:
    part = layer.origin(a, b)
    return Layer(inner, lambda *_: part)


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base findings, all findings) as sorted (start, kind, end) in code points of ``text``."""
    base = sorted(scan(text))
    found, seen, work = set(base), set(), [Layer(text)]
    while work:
        layer = work.pop()
        if layer.place:
            found.update((start, kind, end) for a, kind, b in scan(layer.text) for start, end in [layer.origin(a, b)])
        plain = (unescape if layer.level < LEVELS else unescape_wholly)(layer) if ESCAPE.search(layer.text) else None
        for inner in [*([plain] if plain and plain.text else []), *unwrap(layer)]:
            key = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), inner.origin(0, len(inner.text)))
            if key not in seen:
                seen.add(key)
                work.append(inner)
    return base, sorted(found)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added) for each row of ``docs`` (doc_id, text; others are left out).

    Counts and digest are of the findings in the text as it stands; ``spans`` has those in decoded layers too, each at the part of the
    text it was decoded from, as kind:start:end by start, kind and end. A missing text is empty; an empty one has no findings.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                base, found = find_secrets(text)
                kinds = [sum(k == n for _, k, _ in base) for n in range(3)]
                out.append((doc_id, *kinds, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), len(found) - len(base)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
