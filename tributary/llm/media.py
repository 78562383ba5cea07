"""Interleaved document sequences with media columns.

``parse`` turns HTML into an ordered array of structs, text runs and media
references mixed, each with its position; a figure's caption stays with its
references.  References name their payload by digest (``media:<sha256>``), so a
join on the digest resolves them; a digest that is used a million times is one
row of the resolved table, and positions and captions come back unchanged.

``encode``/``decode`` store any byte payload losslessly as 8-bit samples of a
greyscale image (binary PGM, 24 samples a line): payloads are padded with bytes
255 to whole tiles of 24 x 24 samples.  ``store`` writes the images of a payload
column, each digest once a task, and features are computed from what is read
back from there.

Defined results: null or empty html gives an empty sequence; a null payload
counts as empty (one tile of 255); texts and payloads of any length are treated
whole; repeated rows give the same row each, and one stored payload serves them;
references that tie in position do not occur, as positions count a page's items;
an unresolved reference keeps its position and caption with null media columns;
an empty table gives no rows; other columns, of whatever name, are ignored.
Malformed html is parsed as far as it goes: a caption outside a figure is text;
one that is not closed ends with its figure, or where that is not closed either,
at the next block; titles, scripts and styles are no text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, tidy

LINE, TILE = 24, 576
SCHEME = "media:"
#: Digests that a task remembers having stored; bytes of stored payloads that it holds.
_SEEN, _HELD = 200_000, 4 << 20
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


class _Sequence(HTMLParser):
    """Collects text runs and media references in document order.

    ``short`` says that captions end at the next block.
    """

    HIDDEN = {"script", "style", "template", "noscript", "title"}
    MEDIA = {"img", "video", "audio", "source", "embed"}
    BLOCK = {"p", "br", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "tr", "figure", "nav", "footer", "header", "main", "ul", "ol", "table"}

    def __init__(self, short: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.short = short
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []  # index of the first item of each open figure
        self.named: set[int] = set()  # items that have their figure's caption
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = "".join(self.run).strip()
        self.run = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption = "".join(self.caption).strip(), None
        for k in range(self.figures[-1], len(self.items)):
            if self.items[k]["kind"] == "media" and k not in self.named:
                self.items[k]["caption"] = text
                self.named.add(k)

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
            return
        if tag in self.BLOCK and (self.short or tag == "figure"):
            self.end_caption()
        if tag == "figure":
            self.flush()
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            if self.figures and self.caption is None:
                self.flush()
                self.caption = []
        elif tag in self.MEDIA:
            found = dict(attrs)
            src = found.get("src") or ""
            if src:
                self.flush()
                digest = src[len(SCHEME) :] if src.startswith(SCHEME) else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": digest, "caption": found.get("alt")})
        elif tag in self.BLOCK:
            (self.run if self.caption is None else self.caption).append("\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_caption()
            self.flush()
            self.figures.pop()
        elif tag in ("p", "div", "article", "section") and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if self.hidden:
            return
        (self.run if self.caption is None else self.caption).append(data)


def sequence(page: str | None) -> list[dict]:
    """Ordered items of one page."""
    for short in (False, True):
        p = _Sequence(short)
        p.feed(page or "")
        p.close()
        if p.caption is None or short:  # else a caption would take all that follows
            break
    p.end_caption()
    p.flush()
    return p.items


def parse(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, html) -> id, items; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(x.as_py()) for x in b.column(1)], kind)], ["id", "items"])

    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, items {ITEM}")


def references(sequences: DataFrame) -> DataFrame:
    """id, position, digest and caption of every media reference."""
    return sequences.select("id", F.explode("items").alias("item")).where("item.kind = 'media'").select("id", "item.position", "item.digest", "item.caption")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """Join references with the media table (one row per ``digest``); unresolved ones stay."""
    return refs.join(media, "digest", "left")


def pad(data: bytes) -> bytes:
    """Append bytes 255 up to a positive multiple of the tile."""
    return data + b"\xff" * (-len(data) % TILE if data else TILE)


def encode(payload: bytes) -> bytes:
    """A padded payload as a binary greyscale image."""
    return b"P5\n%d %d\n255\n" % (LINE, len(payload) // LINE) + payload


_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def decode(stored: bytes) -> np.ndarray:
    """The samples of a stored image, line by line."""
    m = _HEADER.match(stored)
    if not m:
        raise ValueError("not a binary greyscale image of 8 bits")
    wide, high = int(m[1]), int(m[2])
    return np.frombuffer(stored, np.uint8, wide * high, m.end()).reshape(high, wide)


def features(samples: np.ndarray) -> str:
    """Size, mean and spread of the samples and the mean of each quarter of the value range."""
    share = np.bincount(samples.ravel() >> 6, minlength=4) / samples.size
    return f"{samples.shape[1]}x{samples.shape[0]};mean={samples.mean():.4f};std={samples.std():.4f};" + ",".join(f"{x:.4f}" for x in share)


def media_table(docs: DataFrame, payload_col: str) -> DataFrame:
    """(payload) -> digest (of the payload), n_bytes, media (stored form): each digest at least once, and once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            d, k, m = zip(*rows, strict=True)
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(k, pa.int64()), pa.array(m, pa.binary())], ["digest", "n_bytes", "media"])

        for b in batches:
            for payload in b.column(0):
                data = payload.as_py() or b""
                digest = hashlib.sha256(data)
                if digest.digest() in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(digest.digest())
                rows.append((digest.hexdigest(), len(data), encode(pad(data))))
                held += len(rows[-1][2])
                if held > _HELD:
                    yield flush()
        if rows:
            yield flush()

    return docs.select(F.col(payload_col).cast("binary").alias("payload")).mapInArrow(tidy(run), "digest string, n_bytes long, media binary")


def store(docs: DataFrame, payload_col: str) -> DataFrame:
    """The media table of a payload column, written to storage and read from there."""
    return saved(media_table(docs, payload_col), "media-store", codec="zstd")


def payload_digest(payload: Column) -> Column:
    """What a reference to a payload says; null counts as empty."""
    return F.sha2(F.coalesce(payload.cast("binary"), F.lit(b"")), 256)


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes (digest, n_bytes, media) say when they are read back; one row per row of ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stored in b.column(2):
                stored = stored.as_py()
                samples = decode(stored)
                read = samples.tobytes()
                out.append((len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["digest", "n_bytes", *names])

    return media.mapInArrow(tidy(run), "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolved_payloads(media: DataFrame) -> DataFrame:
    """One row per digest: the features of a stored payload, written before references join them."""
    return saved(media_features(media).dropDuplicates(["digest"]), "media-payloads", True)


def page(digest: str, caption: Column) -> Column:
    """A page whose only figure refers to the payload of a digest column."""
    text = F.replace(F.replace(caption, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<article><p>"), text, F.lit(f'</p><figure><img src="{SCHEME}'), F.col(digest), F.lit('"><figcaption>'), text, F.lit("</figcaption></figure></article>"))
