"""Secret scans with a recursive decoding worklist.

Every text is scanned for three kinds of secret.  Then a worklist unwraps what is
encoded in it: URL escapes, Unicode escapes, base64 and zlib/gzip layers, nested
in any order, until nothing new decodes.  Each layer is scanned again; a match is
mapped back to the span of the original text it came from (exactly, character by
character, through URL and Unicode escapes; to the whole encoded run through
base64 and compression).  A layer that was seen before with the same origin is
not taken up again, so cycles end.

Bytes that do not decode (a bad URL escape, binary data around a text) are passed
over, the rest is scanned.  Base64 is tried from the start of a run and behind every
separator in it that could also be one of its digits, and across wrapped lines.

Defined cases: a null text counts as empty and has no spans.  Repeated rows are
kept, and an empty table gives an empty result.  Columns other than doc_id and text
are not looked at, whatever their names.  Whole texts are scanned.  A layer may inflate to any size, from all of its
zlib or gzip members: beyond `PIECE` bytes it is inflated and scanned in pieces,
cut behind a character that no pattern has in it, so that no match is cut.  Only a
run without such a character is held whole.  Spans are in code points, end
exclusive.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: bytes of a decoded layer that are held at a time
PIECE = 1 << 22
KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three kinds, leftmost and not overlapping
    within a kind; matches that are too short are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    # a run that is too short has no longer one inside, so the length can stand in the pattern
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: lines of base64, as mail wraps them
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{40,}\r?\n)+[A-Za-z0-9+/]+={0,2}")
#: what decoded bytes must hold to hold a match: the shortest has 12 characters of ASCII,
#: so that its base64 has the 16 digits that a run must have
_PLAIN = re.compile(rb"[\x20-\x7E]{12}")
#: a character that stands in no match of any pattern here
_BREAK = re.compile(r"""[^A-Za-z0-9+/_.=:"'\x20%\\{}&#;-]""")


class Layer:
    """A decoded text and, for each of its characters, the span of the original."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range) -> None:
        self.text, self.starts, self.ends = text, starts, ends


def _substituted(layer: Layer, edits: list[tuple[int, int, str]]) -> Layer:
    """The layer with (start, end, new) put in, spans kept."""
    parts, starts, ends, at = [], [], [], 0
    for a, b, new in edits:
        parts += [layer.text[at:a], new]
        starts += [*layer.starts[at:a], *[layer.starts[a]] * len(new)]
        ends += [*layer.ends[at:a], *[layer.ends[b - 1]] * len(new)]
        at = b
    parts.append(layer.text[at:])
    starts += layer.starts[at:]
    ends += layer.ends[at:]
    return Layer("".join(parts), starts, ends)


def _url(layer: Layer) -> Layer | None:
    edits = []
    for m in _URL.finditer(layer.text):
        # each escape on its own where its byte is ASCII, else as many as make a character;
        # bytes that make none stay as they are written
        data, k = bytes.fromhex(m[0].replace("%", "")), 0
        while k < len(data):
            n = 1 if data[k] < 0x80 else 2 if data[k] < 0xE0 else 3 if data[k] < 0xF0 else 4
            try:
                edits.append((m.start() + 3 * k, m.start() + 3 * (k + n), data[k : k + n].decode()))
                k += n
            except UnicodeDecodeError:
                k += 1
    return _substituted(layer, edits) if edits else None


def _unicode(layer: Layer) -> Layer | None:
    edits = []
    for m in _UNICODE.finditer(layer.text):
        hexa = m[1] or m[2] or m[3] or m[4]
        code = int(hexa, 16) if hexa else int(m[5])
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            edits.append((m.start(), m.end(), chr(code)))
    return _substituted(layer, edits) if edits else None


def _wrap(data: bytes) -> int | None:
    """zlib's window bits for the gzip or zlib member that data begins with."""
    if data[:2] == b"\x1f\x8b":
        return 31
    return 15 if len(data) > 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0 else None


def _members(chunks: Iterator[bytes]) -> Iterator[bytes | None]:
    """What the zlib or gzip members in chunks inflate to, and None at the end of
    each; ends at the first that is broken, cut short or no member."""
    rest, first = b"", True
    while True:
        while len(rest) < 3 and (more := next(chunks, None)) is not None:
            rest = (rest + more) if first else (rest + more).lstrip(b"\0")  # members may be padded
        wrap = _wrap(rest)
        if wrap is None:
            return
        d, full = zlib.decompressobj(wrap), False
        while not d.eof:
            if not rest and not full and not (rest := next(chunks, b"")):
                return
            try:
                out = d.decompress(rest, PIECE)
            except zlib.error:
                return
            rest, full = d.unused_data if d.eof else d.unconsumed_tail, len(out) == PIECE
            if out:
                yield out
        yield None
        rest, first = rest.lstrip(b"\0"), False


#: gives the bytes of a layer, as often as it is called
Source = Callable[[], Iterator[bytes]]


def _whole_members(source: Source, most: int) -> Iterator[bytes]:
    for out in _members(source()):
        if out is not None:
            yield out
        elif (most := most - 1) == 0:
            return


def _inflated(source: Source) -> tuple[Source, bytes] | None:
    """The source without one zlib or gzip layer, as far as its members are whole, and a digest."""
    whole, n, held, new = 0, 0, [], []
    digest, done = hashlib.blake2b(digest_size=16), b""
    for out in _members(source()):
        if out is None:
            whole, done = whole + 1, digest.digest()
            if n <= PIECE:
                held, new = held + new, []
        else:
            digest.update(out)
            n += len(out)
            if n <= PIECE:
                new.append(out)
    if not whole:
        return None
    if n <= PIECE:
        data = b"".join(held)
        return (lambda: iter((data,))), done
    return (lambda: _whole_members(source, whole)), done


def _texts(source: Source) -> Iterator[str]:
    """The source as text, in chunks; bytes that are none are replaced."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in source():
        yield decoder.decode(chunk)
    yield decoder.decode(b"", True)


def _pieces(source: Source) -> Iterator[str]:
    """The text of the source, cut where no match can stand."""
    parts: list[str] = []
    size = 0
    for text in _texts(source):
        parts.append(text)
        size += len(text)
        if size >= PIECE and (m := _BREAK.search(text[::-1])):
            cut = len(text) - m.start()
            parts[-1] = text[:cut]
            yield "".join(parts)
            parts, size = [text[cut:]], len(text) - cut
    if last := "".join(parts):
        yield last


def _layers_of(data: bytes) -> Iterator[Source]:
    """What is in decoded bytes: compressed layers, one in the other, or the bytes themselves."""
    source: Source = lambda: iter((data,))
    known = {hashlib.blake2b(data, digest_size=16).digest()}
    while (more := _inflated(source)) is not None and more[1] not in known:
        source = more[0]
        known.add(more[1])
    if len(known) > 1 or _PLAIN.search(data):
        yield source


def _decoded_runs(layer: Layer) -> Iterator[Layer]:
    found = [(m.start(), m.end(), m[0]) for m in _BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        found += [(m.start(), m.end(), "".join(m[0].split())) for m in _WRAPPED.finditer(layer.text)]
    for start, end, run in found:
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        # what is encoded may begin behind a separator that could be one of its digits;
        # where it begins matters by fours only, as another start gives the same bytes later
        begins = [0, *(k + 1 for k, c in enumerate(run) if c in "+/")]
        for offset in sorted({k % 4 for k in begins}):
            digits = run[offset:]
            digits = digits[: len(digits) - (len(digits) % 4 == 1)]
            data = base64.b64decode(digits + "=" * (-len(digits) % 4))
            at = [(k - offset) * 3 // 4 for k in begins if k % 4 == offset and k >= offset]
            sources = [s for k in at if k == 0 or _wrap(data[k : k + 3]) for s in _layers_of(data[k:])]
            if at[0] > 0 and _PLAIN.search(data):
                sources.append(lambda data=data: iter((data,)))
            for source in sources:
                a, b = layer.starts[start], layer.ends[end - 1]
                for text in _pieces(source):
                    yield Layer(text, [a] * len(text), [b] * len(text))


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    """What one step of decoding makes of the layer, one after the other."""
    yield from _decoded_runs(layer)
    if ("\\" in layer.text or "&#" in layer.text) and (got := _unicode(layer)):
        yield got
    if "%" in layer.text and (got := _url(layer)):
        yield got


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and these with the spans of every decoded layer."""
    base = base_spans(text)
    found = set(base)
    n = len(text)
    # the layers being unwrapped, each with what is still to come of it
    whole = Layer(text, range(n), range(1, n + 1))
    work = [(whole, _unwrapped(whole))]
    seen: set[tuple[bytes, int, int]] = set()
    while work:
        layer, nxt = work[-1]
        new = next(nxt, None)
        if new is None:
            work.pop()
            continue
        key = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), new.starts[0] if new.text else 0, new.ends[-1] if new.text else 0)
        if key in seen or new.text == layer.text:
            continue
        seen.add(key)
        found.update((new.starts[a], kind, new.ends[b - 1]) for a, kind, b in base_spans(new.text))
        work.append((new, _unwrapped(new)))
    return base, sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


FIELDS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(frames, 512):
            out = {c: [] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                base, every = all_spans(text or "")
                counts = [sum(1 for s in base if s[1] == k) for k in range(3)]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                for c, v in zip(out, (doc_id, *counts, digest, written(every)), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in list(out)[:4]), *(pa.array(out[c], pa.string()) for c in list(out)[4:])], names=list(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FIELDS)
