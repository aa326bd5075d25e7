"""Secret scans with a recursive decoding worklist.

A text is scanned as it is; then its encoded parts are unwrapped, layer after layer, and each layer is
scanned again until nothing new appears: percent-encoding and Unicode escapes are decoded in the place
where they stand (so a secret may reach across decoded and plain parts), runs of base64, joined over line
breaks, become layers of their own at each alignment, with undecodable bytes replaced and, where there are
zero bytes, without these (UTF-16), and gzip or zlib data anywhere in one, or bare deflate data that are one, are inflated. Layers seen before in the text are not
visited again. Each character of a layer knows the range of the original text that it comes from, so
every find is a span of the original: exactly its characters under percent and Unicode decoding, the
whole encoded line or lines that hold it under base64, and under compression all from the beginning of
the compressed data to the end of the run.

Base finds, those of the text as it is, always stay. Defined results: null text is the empty text,
which has no finds; spans are code points, end exclusive, ordered by start, kind, end; equal spans count
once in `spans`; repeated rows get equal results; an empty table gives no rows; other columns take no
part. Inflated data are read to their end, member after member, in chunks of `most_inflated` bytes, so
archive bombs cost time but not memory.
"""

from __future__ import annotations

import base64
import codecs
import copy
import hashlib
import itertools
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import documents

# Fixed patterns of the three kinds, in the order of the result.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_GAP, _CLASS = r"[ \t]*(?:\r\n?|\n|\\r\\n|\\n)[ \t]*", "[A-Za-z0-9+/_-]"
GAP = re.compile(_GAP)
# A run with the lines that it may go on in, of any width; escaped line breaks, as in JSON, count too.
BASE64 = re.compile(rf"(?<!{_CLASS})(?:{_CLASS}{{16,}}+|{_CLASS}++(?={_GAP}{_CLASS}))(?:{_GAP}{_CLASS}++)*+")
_INDENT = re.compile(rf"{_CLASS}[ \t]*[\r\n]+[ \t]+{_CLASS}|{_CLASS}[ \t]+[\r\n]")
GZIP = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
ZLIB = re.compile(b"|".join(re.escape(bytes([a])) + b"[" + b"".join(re.escape(bytes([b])) for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32) + b"]" for a in range(8, 128, 16)))
_HEX_MAP = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_BASE64_MAP = bytes(49 if chr(b).isalnum() and b < 128 or chr(b) in "+/_-" else 48 for b in range(256))
HEX_RUN, BASE64_RUN = b"1" * 24, b"1" * 16
MOST_INFLATED = 1 << 20
MOST_TWINS = 64  # streams in one another that begin alike, all of them different; what is further in is not read
# Of texts in parts: blanks that are shortened, ends that wait for the next part, the rest of an open run, runs.
BLANKS = re.compile(r"[ \t]{17,}")
HELD = re.compile(r"(?:[ \t]*(?:\r\n?|\n|\\r\\n|\\n|\\r\\?|\\)?[ \t]*|%[0-9A-Fa-f]?|\\(?:u\{?[0-9A-Fa-f]{0,7}|U[0-9A-Fa-f]{0,7}|x[0-9A-Fa-f]?))\Z")
MORE = re.compile(rf"{_CLASS}*+(?:{_GAP}{_CLASS}++)*+")
PART = re.compile(rf"(?<!{_CLASS})(?:{_CLASS}{{16,}}+|{_CLASS}++(?={_GAP}{_CLASS}|\Z))(?:{_GAP}{_CLASS}++)*+")


def find(text: str, data: bytes | None = None) -> list[tuple[int, int, int]]:
    """Start, kind, end of each match that is long enough; quick tests first tell texts without any."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if HEX_RUN in (text.encode("utf-8", "surrogatepass") if data is None else data).translate(_HEX_MAP):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


class Layer:
    """A text and, for each of its characters, where its source begins and ends; without them it is the text itself."""

    def __init__(self, text: str, begin: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.begin, self.end = text, begin, end

    def source(self, i: int, j: int) -> tuple[int, int]:
        return (i, j) if self.begin is None else (int(self.begin[i]), int(self.end[j - 1]))

    def replaced(self, parts: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
        """This layer with ranges replaced by decoded characters; each comes with its range here."""
        texts, begins, ends, done = [], [], [], 0
        n = len(self.text)
        begin = np.arange(n) if self.begin is None else self.begin
        end = np.arange(1, n + 1) if self.end is None else self.end
        for i, j, decoded, places in parts:
            texts += [self.text[done:i], decoded]
            begins += [begin[done:i], np.array([begin[a] for a, _ in places], np.int64)]
            ends += [end[done:i], np.array([end[b - 1] for _, b in places], np.int64)]
            done = j
        return Layer("".join([*texts, self.text[done:]]), np.concatenate([*begins, begin[done:]]), np.concatenate([*ends, end[done:]]))


def _percent(layer: Layer) -> Layer | None:
    parts = []
    for m in PERCENT.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        decoded, places, k = [], [], 0
        while k < len(data):  # character by character, so that bytes that aren't UTF-8 spoil only themselves
            for width in (1, 2, 3, 4):
                try:
                    char = data[k : k + width].decode()
                except UnicodeDecodeError:
                    continue
                break
            else:
                width, char = 1, "\ufffd"
            decoded.append(char)
            places.append((m.start() + 3 * k, m.start() + 3 * min(k + width, len(data))))
            k += width
        parts.append((m.start(), m.end(), "".join(decoded), places))
    return layer.replaced(parts) if parts else None


def _unicode(layer: Layer) -> Layer | None:
    parts = []
    for m in UNICODE.finditer(layer.text):
        decoded, places, high = [], [], None
        for e in ESCAPE.finditer(m[0]):
            code, place = int(next(filter(None, e.groups())), 16), (m.start() + e.start(), m.start() + e.end())
            if high is not None and 0xDC00 <= code < 0xE000:
                code, place = 0x10000 + ((high - 0xD800) << 10) + code - 0xDC00, (places[-1][0], place[1])
                decoded.pop()
                places.pop()
            high = code if 0xD800 <= code < 0xDC00 else None
            decoded.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")
            places.append(place)
        parts.append((m.start(), m.end(), "".join(decoded), places))
    return layer.replaced(parts) if parts else None


def _streams(data: bytes) -> Iterator[tuple[int, int]]:
    """Where gzip or zlib data may begin, and how sure that is: 2 a long header, 1 a short one at the start, 0 perhaps an accident."""
    yield from ((m.start(), 2) for m in GZIP.finditer(data))
    yield from ((m.start(), int(m.start() == 0)) for m in ZLIB.finditer(data))


class _Pass:
    """One reading of compressed data: the streams that were held back in it, and those that this time are read."""

    def __init__(self, cleared: frozenset[tuple[int, ...]]):
        self.cleared, self.held, self.count = cleared, [], 0

    def __deepcopy__(self, memo: dict) -> "_Pass":
        return self


class _Origin:
    """A stream's place among the streams that it is in, and a running digest of its compressed bytes."""

    def __init__(self, first: bytes, path: tuple[int, ...]):
        self.first, self.path, self.count, self.size, self.sha = first, path, 0, 0, hashlib.sha256()

    def took(self, data: bytes | memoryview) -> None:
        self.sha.update(data)
        self.size += len(data)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Origin) and (self.size, self.sha.digest()) == (other.size, other.sha.digest())

    __hash__ = None

    def __deepcopy__(self, memo: dict) -> "_Origin":
        twin = _Origin(self.first, self.path)
        twin.count, twin.size, twin.sha = self.count, self.size, self.sha.copy()
        return twin


class _Void:
    """Takes data and looks at none."""

    def feed(self, data: bytes) -> None:
        pass

    close = staticmethod(lambda: None)


class _Inflating:
    """Compressed data that come in parts; what they inflate to is read in chunks, and the kinds found go to `kinds`.

    Where the header is short, finds count if nothing is wrong up to the end of the input, or, within other data, if
    the checksum at the end of the stream is right. A stream that begins like one that it is in may be the same one,
    which would inflate to itself without end: it is held back, that is, inflated but not read, and compared as a whole, by length and
    digest, when both have ended. If they differ, all is read once more, and that stream with it.
    """

    def __init__(self, kinds: set[int], sure: int, chunk: int, around: tuple[_Origin, ...], now: _Pass, raw: bool = False):
        self.kinds, self.sure, self.chunk, self.around, self.now, self.raw = kinds, sure, chunk, around, now, raw
        self.own: set[int] = set()
        self.first, self.inside, self.done = b"", None, False

    def feed(self, data: bytes | memoryview) -> None:
        if self.inside is None and not self.done:
            rest = 4096 - len(self.first)
            self.first += bytes(data[:rest])
            data = data[rest:]
            if len(self.first) == 4096:
                self._start()
        for i in range(0, len(data), 1 << 16):
            if not self.done:
                self._inflate(data[i : i + (1 << 16)])

    def _start(self) -> None:
        parent = self.around[-1] if self.around else self.now
        self.origin = _Origin(self.first, (*(self.around[-1].path if self.around else ()), parent.count))
        parent.count += 1
        self.stream = zlib.decompressobj(-15 if self.raw else 47)
        twins = [x for x in self.around if x.first == self.first]
        if twins and (len(twins) > MOST_TWINS or self.origin.path not in self.now.cleared):
            if len(twins) <= MOST_TWINS:
                self.now.held.append((self.origin, twins))
            self.inside = _Void()
        else:
            self.inside = _Bytes(self.own, self.chunk, (*self.around, self.origin), self.now)
        self._inflate(self.first)

    def _inflate(self, data: bytes | memoryview) -> None:
        while True:
            try:
                out = self.stream.decompress(data, self.chunk)
            except zlib.error:
                self.origin.took(data)
                self._end(self.sure == 2)
                return
            rest = self.stream.unused_data if self.stream.eof else self.stream.unconsumed_tail
            self.origin.took(data[: len(data) - len(rest)])
            self.inside.feed(out)
            data = self.stream.unconsumed_tail
            if self.stream.eof:
                self._end(True)
                return
            if not data and len(out) < self.chunk:
                return

    def _end(self, counts: bool) -> None:
        self.done = True
        if counts:
            self.inside.close()
            self.kinds |= self.own
        self.inside = None

    def close(self) -> None:
        if self.inside is None and not self.done:
            self._start()
        if not self.done:
            self._end(self.sure > 0)


class _Bytes:
    """Data that come in parts: their text, and compressed data anywhere in them, one member after another."""

    def __init__(self, kinds: set[int], chunk: int, around: tuple[_Origin, ...], now: _Pass, bare: bool = False):
        self.kinds, self.chunk, self.around, self.now, self.bare = kinds, chunk, around, now, bare
        self.decoder, self.text = codecs.getincrementaldecoder("utf-8")("replace"), _Text(kinds, chunk, around, now)
        self.wide: _Text | None = None  # without zero bytes, which stand between the characters of UTF-16 and UTF-32
        self.tail, self.open, self.begun = b"", [], False

    def feed(self, data: bytes) -> None:
        if not data:
            return
        if self.bare:  # they may be bare deflate data as a whole
            self.open.append(_Inflating(self.kinds, 0, self.chunk, self.around, self.now, True))
            self.bare = False
        for x in self.open:
            x.feed(data)
        both = self.tail + data
        for k, sure in _streams(both):
            if k + (4 if sure == 2 else 2) > len(self.tail):
                self.open.append(_Inflating(self.kinds, 0 if sure == 1 and self.begun else sure, self.chunk, self.around, self.now))
                self.open[-1].feed(memoryview(both)[k:])
                if self.open[-1].done:
                    self.open.pop()
        self.open = [x for x in self.open if not x.done]
        self.tail, self.begun = both[-3:], True
        self.text.feed(self.decoder.decode(data))
        if self.wide is None and b"\0" in data:
            self.wide = _Text(self.kinds, self.chunk, self.around, self.now)
        if self.wide is not None:
            self.wide.feed(data.replace(b"\0", b"").decode("latin-1"))

    def close(self) -> None:
        for x in self.open:
            x.close()
        if self.wide is not None:
            self.wide.close()
        self.text.feed(self.decoder.decode(b"", True))
        self.text.close()


class _Run:
    """A base64 run that comes in parts, at each alignment."""

    def __init__(self, kinds: set[int], chunk: int, around: tuple[_Origin, ...], now: _Pass):
        self.ways = [[skip, "", _Bytes(kinds, chunk, around, now, True)] for skip in range(4)]

    def feed(self, run: str) -> None:
        for way in self.ways:
            body = way[1] + run[way[0] :]
            way[0] = max(0, way[0] - len(run))
            whole = len(body) // 4 * 4
            way[1] = body[whole:]
            way[2].feed(base64.b64decode(body[:whole]))

    def close(self) -> None:
        for _, rest, inside in self.ways:
            if len(rest) > 1:
                inside.feed(base64.b64decode(rest + "=" * (4 - len(rest))))
            inside.close()


class _Text:
    """Text that comes in parts. Of finds only their kinds count, so the last characters are all that has to be carried."""

    def __init__(self, kinds: set[int], chunk: int, around: tuple[_Origin, ...], now: _Pass):
        self.kinds, self.chunk, self.around, self.now = kinds, chunk, around, now
        self.tail = self.held = ""
        self.run: _Run | None = None
        self.children: list[_Text | None] = [None, None]

    def feed(self, text: str, last: bool = False) -> None:
        # Long blanks count as shorter ones; what may be half an escape or line break waits for the rest.
        text = BLANKS.sub(lambda m: ("\t" if "\t" in m[0] else " ") * 16, self.held + text)
        at = len(text) if last else max(0, len(text) - 80) + HELD.search(text[-80:]).start()
        text, self.held = text[:at], text[at:]
        if not text:
            return
        both = self.tail + text
        self.kinds.update(kind for _, kind, _ in find(both))
        for k, (sign, pattern, decoded) in enumerate((("%", PERCENT, _percent_decoded), ("\\", ESCAPE, _unicode_decoded))):
            if self.children[k] is None and sign in text and pattern.search(text):
                child = self.children[k] = _Text(self.kinds, self.chunk, self.around, self.now)
                child.tail, child.run = self.tail, copy.deepcopy(self.run, {id(x): x for x in (self.kinds, *self.around)})
            if self.children[k] is not None:
                self.children[k].feed(pattern.sub(decoded, text))
        self._runs(text)
        self.tail = both[-96:]

    def _runs(self, text: str) -> None:
        at = 0
        if self.run is not None:
            at = MORE.match(text).end()
            self.run.feed(_bare(text[:at]))
            if at == len(text):
                return
            self.run.close()
            self.run = None
        for m in PART.finditer(text, at):
            run = _bare(m[0])
            if m.end() == len(text) or len(run) >= 16:
                self.run = _Run(self.kinds, self.chunk, self.around, self.now)
                self.run.feed(run)
                if m.end() < len(text):
                    self.run.close()
                    self.run = None

    def close(self) -> None:
        self.feed("", True)
        if self.run is not None:
            self.run.close()
        for child in self.children:
            if child is not None:
                child.close()


def _bare(run: str) -> str:
    return GAP.sub("", run).replace("-", "+").replace("_", "/")


def _percent_decoded(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _unicode_decoded(m: re.Match) -> str:
    code = int(next(filter(None, m.groups())), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _kinds_inflated(data: memoryview, sure: int, chunk: int, raw: bool = False) -> set[int]:
    """The kinds found in what data inflate to, at any depth, with some chunks in memory at once."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1_000_000))  # layers in layers; only Python frames, which are not on the C stack
    cleared: frozenset[tuple[int, ...]] = frozenset()
    try:
        while True:
            kinds: set[int] = set()
            now = _Pass(cleared)
            stream = _Inflating(kinds, sure, chunk, (), now, raw)
            stream.feed(data)
            stream.close()
            differ = frozenset(held.path for held, twins in now.held if held not in twins)
            if differ <= cleared:
                return kinds
            cleared |= differ
    finally:
        sys.setrecursionlimit(limit)


def _characters(data: bytes) -> tuple[str, np.ndarray]:
    """Text of data, with a replacement for each byte that isn't UTF-8, and the byte at which each character begins."""
    text = data.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    lost = (codes >= 0xDC80) & (codes < 0xDD00)
    widths = np.where(lost, 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
    codes[lost] = 0xFFFD
    return codes.tobytes().decode("utf-32-le") if lost.any() else text, np.cumsum(widths) - widths


def _base64(layer: Layer, chunk: int, known: dict[bytes, set[int]]) -> Iterator[Layer | tuple[int, int, set[int]]]:
    """Each alignment of a run, wherever in it the encoded part begins: what stands before or after spoils only itself.

    Compressed data in one give their range and the kinds found.
    """
    for m in BASE64.finditer(layer.text):
        gaps = [(m.start() + g.start(), m.start() + g.end()) for g in GAP.finditer(m[0])]
        lines = list(zip([m.start(), *(b for _, b in gaps)], [*(a for a, _ in gaps), m.end()], strict=True))
        run = "".join(layer.text[a:b] for a, b in lines).replace("-", "+").replace("_", "/")
        after = np.cumsum([b - a for a, b in lines])  # characters of the run up to the end of each line
        for skip in range(4):
            body = run[skip:]
            if len(body) < 16:
                break
            cut = len(body) - (len(body) % 4 == 1)
            data = base64.b64decode(body[:cut] + "=" * (-cut % 4))
            sources = [layer.source(a, b) for a, b in lines]
            if skip < lines[0][1] - lines[0][0]:
                sources[0] = layer.source(lines[0][0] + skip, lines[0][1])
            begins, ends = np.array(sources).T
            forms = [_characters(data)]
            if data.count(0) >= 6:  # the text without zero bytes, which is that of UTF-16 and UTF-32 where it is ASCII
                kept = np.flatnonzero(np.frombuffer(data, np.uint8))
                wide, places = _characters(data.replace(b"\0", b""))
                forms.append((wide, kept[places]))
            for text, at in forms:
                if len(lines) == 1:
                    yield Layer(text, np.full(len(text), begins[0]), np.full(len(text), ends[0]))
                else:  # from the beginning of the line of a character's first bits to the end of that of its last
                    last = np.append(at[1:], len(data)) - 1
                    first_line, last_line = (np.searchsorted(after, np.minimum(skip + k // 3 * 4 + k % 3 + more, len(run) - 1), "right") for k, more in ((at, 0), (last, 1)))
                    yield Layer(text, begins[first_line], ends[last_line])
            if kinds := _kinds_inflated(memoryview(data), 0, chunk, True):  # bare deflate has no header: it counts if it comes to its end
                yield int(begins[0]), int(ends[-1]), kinds
            for k, sure in _streams(data):
                at_line = int(np.searchsorted(after, place := skip + k // 3 * 4 + k % 3, "right"))
                start = lines[at_line][1] - int(after[at_line]) + place
                if sure:
                    if (key := data[k:]) not in known:
                        known[key] = _kinds_inflated(memoryview(key), sure, chunk)
                    kinds = known[key]
                else:
                    kinds = _kinds_inflated(memoryview(data)[k:], sure, chunk)
                if kinds:
                    yield layer.source(start, start + 1)[0], int(ends[-1]), kinds


def scan(text: str, most_inflated: int = MOST_INFLATED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base finds and all finds, as (start, kind, end) of the text."""
    data = text.encode("utf-8", "surrogatepass")
    base = find(text, data)
    if "%" not in text and "\\" not in text and BASE64_RUN not in data.translate(_BASE64_MAP, b"\r\n") and not _INDENT.search(text):
        return base, base
    found, seen, work = set(base), {(text, 0)}, [Layer(text)]
    known: dict[bytes, set[int]] = {}
    while work:
        layer = work.pop()
        children = [x for x in (_percent(layer) if "%" in layer.text else None, _unicode(layer) if "\\" in layer.text else None) if x is not None]
        for child in itertools.chain(children, _base64(layer, most_inflated, known)):
            if isinstance(child, tuple):
                found.update((child[0], kind, child[1]) for kind in child[2])
                continue
            key = (child.text, int(child.begin[0]) if len(child.text) else 0)
            if key in seen:
                continue
            seen.add(key)
            for i, kind, j in find(child.text):
                start, end = child.source(i, j)
                found.add((start, kind, end))
            work.append(child)
    return base, sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_inflated: int = MOST_INFLATED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = scan(text or "", most_inflated)
                kinds = [k for _, k, _ in base]
                counts.append([kinds.count(k) for k in range(3)])
                bases.append(joined(base))
                spans.append(joined(every))
            per = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(per[:, k]) for k in range(3)), pa.array(bases, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
