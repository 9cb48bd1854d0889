"""Interleaved document sequences: ordered text and media references from HTML, payloads by digest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, spread_join

#: A payload is cut into tiles of 24 x 24 samples of 8 bits.
SIDE = 24
TILE = SIDE * SIDE
PNG = b"\x89PNG\r\n\x1a\n"
#: Digests that a task remembers.
SEEN = 1_000_000
ITEM = "struct<position:int,kind:string,text:string,media:string,caption:string>"
_BREAKS = {"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "article", "section", "ul", "ol", "table", "blockquote", "pre", "title"}
_SILENT = {"script", "style", "noscript", "template"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class _Sequence(HTMLParser):
    """Collects text runs and media references in document order; a figure's caption goes to its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.silent = 0
        self.figure: int | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "media": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        if tag == "figcaption":
            self.flush()
            self.caption = []
        if tag in _MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self.flush()
                self.items.append({"kind": "media", "text": None, "media": given["src"], "caption": given.get("alt") or given.get("title")})

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            own = [x for x in self.items[self.figure or 0 :] if x["kind"] == "media"] if self.figure is not None else []
            for x in own:
                x["caption"] = words
            if words and not own:  # a caption before its media, or without any, stays in the sequence
                self.items.append({"kind": "text", "text": words, "media": None, "caption": None})
            self.caption = None
        if tag in _BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": i, **x} for i, x in enumerate(p.items)]


def interleaved(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, items: every page as the ordered array of its text runs and media references.

    Null, empty or broken HTML gives what items it has, at least none; repeated rows are kept. A page
    is parsed where it is read."""
    kind = pages.select(key).schema[0].dataType
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence(x.as_py()) for x in batch.column(1)], pa.list_(item))], names=[key, "items"])

    return pages.select(key, F.col(html).cast("string").alias("html")).mapInArrow(run, f"`{key}` {kind.simpleString()}, items array<{ITEM}>")


def resolved(sequences: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """key, position, digest, caption and the payload's columns for each media reference: an equi-join by
    digest of references (sha256:...) with payloads (digest, ...; one row a digest). References without
    a payload keep their place with null columns. References to a payload that many documents share stay
    in their tasks."""
    refs = sequences.select(key, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    refs = checkpoint(refs.select(key, "item.position", F.regexp_replace("item.media", "^sha256:", "").alias("digest"), "item.caption"))
    shared = checkpoint(refs.groupBy("digest").agg(F.count("*").alias("n_refs")).join(payloads, "digest", "left"))
    return spread_join(refs, shared, ["digest"], "n_refs").drop("n_refs")


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def store(payload: bytes) -> bytes:
    """The payload as a grey PNG image, SIDE samples wide, 8 bits a sample, rows without filters."""
    rows = np.zeros((len(payload) // SIDE, SIDE + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    head = SIDE.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return PNG + png_chunk(b"IHDR", head) + png_chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + png_chunk(b"IEND", b"")


def load(media: bytes) -> bytes:
    """The samples of a stored image; checks every chunk's checksum."""
    if media[:8] != PNG:
        raise ValueError("not a PNG image")
    parts, at = {}, 8
    while at < len(media):
        size = int.from_bytes(media[at : at + 4], "big")
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != int.from_bytes(media[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("damaged image")
        parts[kind] = parts.get(kind, b"") + data
        at += 12 + size
    head = parts[b"IHDR"]
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if head[8:] != bytes([8, 0, 0, 0, 0]) or rows[:, 0].any():
        raise ValueError("not an image of this kind")
    return rows[:, 1:].tobytes()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // TILE)) * TILE - len(raw))


def feature(samples: bytes) -> str:
    """Difference hash of the mean tile on a grid of 8 x 9 cells, then mean and deviation of all samples."""
    x = np.frombuffer(samples, np.uint8)
    mean = x.reshape(-1, SIDE, SIDE).mean(axis=0)
    cells = np.add.reduceat(mean.reshape(8, 3, SIDE).sum(axis=1), [0, 3, 6, 9, 12, 14, 16, 18, 21], axis=1) / np.array([3, 3, 3, 3, 2, 2, 2, 3, 3])
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel())
    return f"{bits.tobytes().hex()}:{x.mean():.4f}:{x.std():.4f}"


def stored_media(docs: DataFrame) -> DataFrame:
    """digest, media: the stored image of every text of docs (doc_id, text), written to reliable storage and
    read back. Images stay in their tasks: one that a task has written lately is not written again, but
    equal texts of different tasks have a row each, with equal bytes."""
    return images_of(documents_with_images(docs))


def images_of(sequences: DataFrame) -> DataFrame:
    return sequences.where(F.col("k.media").isNotNull()).select("k.digest", "k.media")


def documents_with_images(docs: DataFrame) -> DataFrame:
    """k (doc_id, n_bytes, digest, media), items of docs (doc_id, text), in reliable storage: every text's
    image is made once, and its sequence is parsed in the same pass. Of items only what joins and counts need
    is kept, without texts. media is null where the task has written the same image lately."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_bytes", "digest", "media"]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            sizes, digests, media, html = [], [], [], []
            for t in batch.column("text"):
                n, payload = padded(t.as_py())
                m = store(payload)
                digest = hashlib.sha256(m).hexdigest()
                sizes.append(n)
                digests.append(digest)
                media.append(None if digest in seen else m)
                html.append(page(t.as_py() or "", n, digest))
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(digest)
            k = pa.StructArray.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays([k, pa.array(html, pa.string())], names=["k", "html"])

    sequences = interleaved(texts.mapInArrow(pages, "k struct<doc_id:bigint,n_bytes:bigint,digest:string,media:binary>, html string"), "k", "html")
    return checkpoint(sequences.select("k", F.transform("items", lambda x: x.dropFields("text")).alias("items")))


def described(stored: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored
    (digest, media): one row a digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column("media"):
                raw = m.as_py()
                samples = load(raw)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["digest", *names])

    return checkpoint(stored.mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").distinct())


def page(text: str, n: int, digest: str) -> str:
    """A document as HTML: the first half of its lines as a paragraph, its image with a caption, the rest."""
    lines = text.split("\n")
    half = (len(lines) + 1) // 2
    before, after = (escape("\n".join(x), quote=False) for x in (lines[:half], lines[half:]))
    return f'<article><p>{before}</p><figure><img src="sha256:{digest}"><figcaption>{n} bytes of text</figcaption></figure><p>{after}</p></article>'


def document_media(docs: DataFrame) -> DataFrame:
    """Each text of docs (doc_id, text) as an interleaved document with its stored image: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; position and caption of
    the image's reference and n_items of the sequence follow.

    A document's HTML holds its text and, in between, refers to its stored image by digest. The sequence of
    text runs and references is parsed from that HTML, and each reference meets what was read back from the
    image's stored bytes (stored_media) in a join by digest. Only digests and features are shuffled, never
    payloads. A text without words gives no text items. Null texts are empty (one tile of padding); null or
    repeated ids and repeated rows are kept; an empty table gives an empty result."""
    sequences = documents_with_images(docs)
    sized = sequences.select(F.struct("k.doc_id", "k.n_bytes", F.size("items").alias("n_items")).alias("k"), "items")
    return resolved(sized, described(images_of(sequences)), "k").select("k.doc_id", "k.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "k.n_items")
