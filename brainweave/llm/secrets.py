"""Operator 9, secret scans: a decoding worklist over every whole text, rescanning each layer.

The raw text is scanned first (the base spans). Then a worklist unwraps, wherever they stand and inside one another, URL
escapes, Unicode escapes (of the whole layer at once, and of each run without white space alone), base64 runs, and zlib, gzip
and raw deflate streams. Each decoded piece is a new layer that is scanned and
searched for further pieces, until nothing new appears. A layer with a content and a place in the raw text that have been
seen together is not entered again, so cycles end, and a piece that stands at several places is found at each. A secret found in a layer is mapped back to the span, in code points of the raw text,
of the encoded piece's characters that it came from: exactly for URL and Unicode escapes, and to the whole encoded run
for base64 and compressed pieces (of a run over several lines, to the whole lines). Base64 may begin at any character of
a run of 12 characters or more, so what is glued to a path or a word is found, and other bytes than
text hide nothing but themselves; text in UTF-16 among the bytes is read, too. Runs go on over line breaks, indented or not, and over
blanks between pieces of one length, of 12 characters or more. A shorter run can hold a secret only compressed, and is taken for a raw deflate stream
if it is a whole one. A raw deflate stream has no mark of its own: it is looked for where a piece begins, and must be whole.
Spans are reported once each; base spans are never removed.

A decompressed piece may have any size: it is read in windows of ``window`` bytes, each a layer that begins with the last
``overlap`` bytes of the one before, so memory is bounded; only a secret longer than the overlap can be reported in part there.

Null and empty texts have no spans. Repeated rows are reported alike. Extra columns are not read.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brainweave.llm import common

#: The base patterns. A match of fewer characters than stated is dropped after matching.
ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
KEYWORDS = ("passw", "secret", "token", "api")

URL_CODE = r"%(?:u[0-9A-Fa-f]{4}|[0-9A-Fa-f]{2})"
UNICODE_CODE = r"\\(?:u\{[0-9A-Fa-f]{1,6}\}|U[0-9A-Fa-f]{8}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})"
URL_RUN = re.compile(rf"(?<![^\s%])[^\s%]*(?:{URL_CODE}[^\s%]*)+")
URL_UNIT = re.compile(rf"(?:{URL_CODE})+")
UNICODE_RUN = re.compile(rf"(?<![^\s\\])[^\s\\]*(?:{UNICODE_CODE}[^\s\\]*)+")
UNICODE_UNIT = re.compile(rf"(?:{UNICODE_CODE})+")
URL_PART = re.compile(r"%u([0-9A-Fa-f]{4})|((?:%[0-9A-Fa-f]{2})+)")
UNICODE_PART = re.compile(r"[uUx]\{?([0-9A-Fa-f]+)")
#: Base64 over one or more lines, indented or not, and in pieces of 12 characters or more between blanks (the last may be shorter).
_B64, _BREAK = "[A-Za-z0-9+/_-]", r"[ \t]*+\r?\n[ \t]*+"
BASE64_RUN = re.compile(
    rf"(?<!{_B64})(?:{_B64}{{12,}}+(?:{_BREAK}{_B64}++|[ \t]++{_B64}{{12,}}+(?:[ \t]++{_B64}{{1,11}}+(?!{_B64}))?+)*+"
    rf"|{_B64}{{1,11}}+(?:{_BREAK}{_B64}++)++)={{0,2}}"
)
BASE64_LINE = re.compile(rf"{_B64}+={{0,2}}")
#: Shorter runs hold only what is compressed: a raw deflate stream of one fixed block. The three bits of its header leave 32 first characters
#: and 16 second ones, so few words of a text are tried.
SHORT_RUN = re.compile(rf"(?<!{_B64})[ACEGIKMOQSUWYacegikmoqsuwy02468+-][w-z0-9+/_-]{_B64}{{2,9}}+={{0,2}}(?!{_B64})")
URL_ALPHABET = str.maketrans("-_", "+/")
#: Nothing shorter holds a secret (14 characters at least) or a further piece (12).
STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{12}")
STRETCHES = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
PRINTABLE = np.isin(np.arange(256), [9, 10, 13, *range(32, 127)])
#: The same in UTF-16, of either byte order.
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12}|(?:\0[\t\n\r\x20-\x7e]){12}")
#: The first two bytes of gzip and zlib streams (RFC 1952; 1950: a multiple of 31, without a dictionary).
STREAM = re.compile(
    b"\x1f\x8b|"
    + b"|".join(
        re.escape(bytes([c])) + b"[" + b"".join(re.escape(bytes([f])) for f in range(256) if not (c * 256 + f) % 31 and not f & 32) + b"]"
        for c in range(0x08, 0x80, 0x10)
    )
)
WINDOW, OVERLAP = 1 << 24, 1 << 16
Inflate = tuple[int, int]
"""Most bytes of a layer, and how many of them the next one repeats."""



def scan(text: str) -> list[tuple[str, int, int]]:
    """Base spans of a text: (kind, start, end), leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


Layer = tuple[str, np.ndarray, np.ndarray]
"""A decoded text and, per character, start and end of what it came from."""


def unwrapped(text: str, unit: re.Pattern, run: re.Pattern, decode) -> Iterator[Layer]:
    """The text with all its escapes decoded, so that what stands around them stays in context; then each run alone."""
    out, parts, at = [], [], 0
    for m in unit.finditer(text):
        out += [text[at : m.start()], decode(m[0])]
        parts += [(len(out[-2]), at, at, 1), (len(out[-1]), *m.span(), 0)]
        at = m.end()
    if not parts:
        return
    out.append(text[at:])
    parts.append((len(out[-1]), at, at, 1))
    n, start, end, copied = np.array(parts).T
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(start, n) + inner * np.repeat(copied, n)
    ends = np.where(np.repeat(copied, n), starts + 1, np.repeat(end, n))
    decoded = "".join(out)
    yield decoded, starts, ends
    for m in run.finditer(text):
        i, j = np.searchsorted(starts, m.span())
        yield decoded[i:j], starts[i:j], ends[i:j]


def url_units(s: str) -> str:
    out = []
    for m in URL_PART.finditer(s):
        if m[1]:
            out.append(chr(int(m[1], 16)))
            continue
        raw = bytes.fromhex(m[2].replace("%", ""))
        try:
            out.append(raw.decode("utf-8"))
        except UnicodeDecodeError:
            out.append(raw.decode("latin-1"))
    return paired("".join(out))


def paired(s: str) -> str:
    """s with surrogate pairs joined; what is no character is replaced."""
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def unicode_units(s: str) -> str:
    return paired("".join(chr(min(int(x, 16), 0x10FFFF)) for x in UNICODE_PART.findall(s)))


def url_bytes(s: str) -> bytes:
    """The bytes of a URL-escaped run; characters beyond Latin-1 are question marks."""
    got = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), s)
    return got.encode("latin-1", "replace")


def inflated(raw: bytes, at: int, bits: int, block: int = 1 << 14) -> Iterator[tuple[bytes, int, bool]]:
    """What the stream at a byte decompresses to, bit by bit, as far as it is whole; where each bit ends, and whether the stream does.

    Further members of a gzip stream belong to it (RFC 1952, 2.2). No bit is longer than 1 MiB.
    """
    d = zlib.decompressobj(bits)
    gzip = bits > 0 and raw.startswith(b"\x1f\x8b", at)
    feed = b""
    while at < len(raw) or feed:
        if d.eof:
            if not (gzip and raw.startswith(b"\x1f\x8b\x08", at)):
                return
            d = zlib.decompressobj(31)
        before = d.copy()
        feed = feed or raw[at : at + block]
        try:
            got = d.decompress(feed, 1 << 20)
        except zlib.error:
            if block == 1:
                return
            d, block, feed = before, 1, b""
            continue
        at += len(feed) - len(d.unused_data) - len(d.unconsumed_tail)
        feed = d.unconsumed_tail
        if got or d.eof:
            yield got, at, d.eof


def may_inflate(raw: bytes) -> bool:
    """Whether bytes may begin with a raw deflate stream, by its first block's header (RFC 1951, 3.2.3 and 3.2.4)."""
    kind = raw[0] >> 1 & 3 if raw else 3
    return kind in (1, 2) or kind == 0 and len(raw) > 4 and raw[1] ^ raw[3] == raw[2] ^ raw[4] == 255


def streams(raw: bytes, limit: Inflate) -> Iterator[tuple[bytes, int, int]]:
    """The windows of every compressed stream in raw, with the stream's first byte and its end."""
    done = 0
    starts = [(m.start(), 47) for m in STREAM.finditer(raw)]
    if len(raw) > 8 and (not starts or starts[0][0]) and may_inflate(raw):
        starts.insert(0, (0, -15))  # raw deflate: only from the beginning, and only if whole
    for at, bits in starts:
        if at < done:
            continue
        end, ended, some = at, False, 0
        for got, end, ended in inflated(raw, at, bits):  # noqa: B007
            some += len(got)
        if not some or (bits < 0 and not ended):
            continue
        if ended and bits > 0:
            done = end
        held = b""
        for got, _, _ in inflated(raw, at, bits):
            held += got
            if len(held) >= limit[0]:
                yield held, at, end
                held = held[-limit[1] :]
        if held:
            yield held, at, end


def narrow(raw: bytes) -> tuple[bytes, np.ndarray] | None:
    """raw without its zero bytes, and where the others stood, if it holds text in UTF-16."""
    if b"\0" not in raw or not WIDE.search(raw):
        return None
    at = np.flatnonzero(np.frombuffer(raw, np.uint8))
    return raw.replace(b"\0", b""), at


def compressed_layers(raw: bytes, limit: Inflate) -> Iterator[Layer]:
    """The layers of the streams in raw, placed at all of their bytes; those that can hold nothing are left out."""
    for inner, at, end in streams(raw, limit):
        found = [inner] if STRETCH.search(inner) or STREAM.match(inner) else []
        if (wide := narrow(inner)) is not None:
            found.append(wide[0])
        for text in found:
            yield text.decode("latin-1"), *(np.broadcast_to(x, len(text)) for x in (at, end))


def base64_bytes(chars: str) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """The bytes in base64 characters (either alphabet) that may begin at any of them;

    with, per byte, the first and last character it came from."""
    for skip in range(min(4, len(chars) - 1)):
        body = chars[skip:].translate(URL_ALPHABET)
        body = body[: len(body) - (len(body) % 4 == 1)]
        raw = binascii.a2b_base64(body + "=" * (-len(body) % 4))
        if STRETCH.search(raw) or STREAM.search(raw) or may_inflate(raw) and next(inflated(raw, 0, -15), None):
            n = np.arange(len(raw))
            yield raw, skip + n * 4 // 3, skip + (n * 8 + 7) // 6
        if (wide := narrow(raw)) is not None:
            yield wide[0], skip + wide[1] * 4 // 3, skip + (wide[1] * 8 + 7) // 6


def pieces_of(text: str, run: re.Match) -> list[list[tuple[int, int]]]:
    """The spans of a run's pieces that belong together: lines always, pieces between blanks if all but the last are of one length.

    A last piece of fewer than 12 characters belongs to two others at least: else it is the next word of a text.
    """
    lines = [m.span() for m in BASE64_LINE.finditer(text, *run.span())]
    blank = [i for i in range(1, len(lines)) if "\n" not in text[lines[i - 1][1] : lines[i][0]]]
    sizes = [b - a for a, b in lines]
    if not blank or len(set(sizes[:-1])) == 1 and sizes[-1] <= sizes[0] and (sizes[-1] >= 12 or len(sizes) > 2):
        return [lines]
    return [lines[i:j] for i, j in zip([0, *blank], [*blank, len(lines)])]


def within(raw: bytes, limit: Inflate) -> Iterator[Layer]:
    """Layers of bytes: all of them if most are text; of others what is compressed, and the stretches of text, which no pattern goes beyond."""
    if len(raw) < 4096 or PRINTABLE[np.frombuffer(raw, np.uint8)].mean() > 0.75:
        n = np.arange(len(raw))
        yield raw.decode("latin-1"), n, n + 1
        return
    yield from compressed_layers(raw, limit)
    for m in STRETCHES.finditer(raw):
        n = np.arange(*m.span())
        yield m[0].decode("latin-1"), n, n + 1


def base64_layers(text: str, limit: Inflate) -> Iterator[Layer]:
    """The layers of base64 runs, joined over line breaks and line by line, each byte placed at its whole lines.

    Bytes stand as Latin-1 characters: the patterns are ASCII, and no other byte hides what stands around it."""
    for run in SHORT_RUN.finditer(text):
        body = run[0].rstrip("=").translate(URL_ALPHABET)
        raw = binascii.a2b_base64(body[: len(body) - (len(body) % 4 == 1)] + "==")
        inner = b"".join(x for x, _, _ in inflated(raw, 0, -15))
        if STRETCH.search(inner) and any(ended for _, _, ended in inflated(raw, 0, -15)):
            yield inner.decode("latin-1"), *(np.broadcast_to(x, len(inner)) for x in run.span())
    for lines in (own for run in BASE64_RUN.finditer(text) for own in pieces_of(text, run)):
        for part in [lines, *([x] for x in lines if len(lines) > 1 and x[1] - x[0] >= 12)]:
            chars = "".join(text[a:b].rstrip("=") for a, b in part)
            if len(chars) < 12:
                continue
            first, last = np.array(part).T
            till = np.cumsum(last - first)
            for raw, a, b in base64_bytes(chars):
                for inner, i, j in within(raw, limit):
                    if len(part) == 1:
                        yield inner, *(np.broadcast_to(x, len(inner)) for x in part[0])
                    else:
                        starts = mapped(first, till.searchsorted(mapped(a, i), "right"))
                        yield inner, starts, mapped(last, till.searchsorted(mapped(b, j - 1), "right"))


def layers(text: str, limit: Inflate) -> Iterator[Layer]:
    """What can be unwrapped from a text in one step."""
    if "%" in text:
        yield from unwrapped(text, URL_UNIT, URL_RUN, url_units)
        for run in URL_RUN.finditer(text):
            for inner, starts, _ in compressed_layers(url_bytes(run[0]), limit):
                yield inner, *(np.broadcast_to(x, len(starts)) for x in run.span())
    if "\\" in text:
        yield from unwrapped(text, UNICODE_UNIT, UNICODE_RUN, unicode_units)
    yield from compressed_layers(text.encode("latin-1", "replace"), limit)
    yield from base64_layers(text, limit)


def mapped(spans: np.ndarray, at: np.ndarray) -> np.ndarray:
    """spans[at]; spans that are all the same take no room."""
    return spans[at] if spans.strides[0] else np.broadcast_to(spans[0], len(at))


def key_of(layer: Layer) -> bytes:
    """Content and place of a layer, in short."""
    key = hashlib.blake2b(layer[0].encode("utf-8", "surrogatepass"))
    for x in layer[1:]:
        key.update(b"|%d|" % len(x) + (x.tobytes() if x.strides[0] else b"%d" % x[0]))
    return key.digest()


def find_secrets(text: str | None, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[list, list]:
    """(base spans, all spans), each sorted by start, then kind."""
    text = text or ""
    base = scan(text)
    found, seen = set(base), set()
    work: list[tuple[str, np.ndarray | None, np.ndarray | None]] = [(text, None, None)]
    while work:
        layer, first, last = work.pop()
        for decoded, starts, ends in layers(layer, (window, overlap)):
            if first is not None:
                starts, ends = mapped(first, starts), mapped(last, ends - 1)
            key = key_of((decoded, starts, ends))
            if key in seen:
                continue
            seen.add(key)
            for kind, a, b in scan(decoded):
                found.add((kind, int(starts[a]), int(ends[b - 1])))
            work.append((decoded, starts, ends))
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=key), sorted(found, key=key)


def scan_secrets(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, base_spans and spans, both array<struct<kind, start, end>> in code points."""
    common.small_batches(df.sparkSession)
    one = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base_spans {one}, spans {one}")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [find_secrets(t, window, overlap) for t in texts]
            yield pd.DataFrame(
                {
                    c: [[{"kind": k, "start": a, "end": b} for k, a, b in g[i]] for g in got]
                    for i, c in enumerate(("base_spans", "spans"))
                }
            )

    return df.select(F.col(doc_id).alias("doc_id"), find(F.col(text)).alias("_s")).select(
        "doc_id", "_s.base_spans", "_s.spans"
    )


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def digest_spans(scanned: DataFrame) -> DataFrame:
    """The contract's columns from what scan_secrets returns."""
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(
        "doc_id", *map(n, KINDS), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
