"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: How byte-level vocabularies cut a text into pieces (fixed value, public).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000
#: Tokens after which a task hands on what it has.
PART = 1_000_000
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library.

    A merge's id is its rank, as in all files whose ids follow the merges; __init__ checks that."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.parts = [(i, i) for i in range(len(self.tokens))]  # what a token was merged from
        self.merged = {}  # (left, right) -> token
        last = -1
        for m in model["model"]["merges"]:
            a, b = (vocab[bytes(letters[c] for c in x)] for x in (m if isinstance(m, list) else m.split(" ")))
            t = vocab[self.tokens[a] + self.tokens[b]]
            if t <= last:
                raise ValueError("ids don't follow the merges")
            last = t
            self.parts[t], self.merged[a, b] = (a, b), t
        self.bytes_ = [vocab[bytes([b])] for b in range(256)]
        self.shorter = [-1] * len(self.tokens)  # the longest token that is a proper prefix
        for t, i in vocab.items():
            self.shorter[i] = next((vocab[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in vocab), -1)
        self.find = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.find.add_word(t.decode("latin-1"), (len(t), i))
        self.find.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.cut = regex.compile(PIECES)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' joined bytes gives just these two tokens. Undo the later of the
        two outermost merges again and again: the pair fails as soon as the tokens that meet at the border
        would have merged before the merge that was undone."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 4 * CACHE:
                self.fits.clear()
            known, before, x, y = True, len(self.tokens), a, b
            while True:
                made = self.merged.get((x, y))
                if made is not None and made < before:
                    known = False
                    break
                left, right = self.parts[x], self.parts[y]
                whole_left, whole_right = left[0] == x, right[0] == y
                if whole_left and whole_right:
                    break
                if whole_right or (not whole_left and x > y):
                    before, x = x, left[1]
                else:
                    before, y = y + 1, right[0]  # on a tie in time the left one merges first
            self.fits[a, b] = known
        return known

    def piece(self, piece: bytes) -> list[int]:
        """Tokens of a piece: take the longest match, or a shorter one, or step back, until each token
        is compatible with the one before; a place that was left for good is never tried again."""
        n, tokens = len(piece), self.tokens
        longest = [0] * n
        best = [0] * n
        for end, (size, t) in self.find.iter(piece.decode("latin-1")):
            at = end - size + 1
            if size > best[at]:
                best[at], longest[at] = size, t
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        at, t = 0, longest[0]
        while at < n:
            end = at + len(tokens[t])
            if open_[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                at = end
                if at < n:
                    t = longest[at]
            elif self.shorter[t] >= 0:
                t = self.shorter[t]
            else:
                open_[at] = 0
                t = out.pop()
                at -= len(tokens[t])
                # the token that led here goes on with its next shorter prefix, as its end is closed now
        return out

    def word(self, word: str) -> tuple[int, ...]:
        ids: list[int] = []
        for p in self.cut.findall(word):
            made = self.pieces.get(p)
            if made is None:
                made = self.piece(p.encode())
                if len(p) <= 64:
                    if len(self.pieces) >= CACHE:
                        self.pieces.clear()
                    self.pieces[p] = made
            ids += made
        return tuple(ids)

    def plain(self, text: str) -> list[int]:
        """Tokens of a text without special tokens. Pieces never cross a space that a non-space follows,
        so the text is cut there and frequent words are encoded once."""
        out: list[int] = []
        known, held = self.known, ""
        for i, part in enumerate(text.split(" ")):
            word = held + " " + part if i else part
            if not part or part[0].isspace():  # this space belongs to a longer run of white space
                held = word
                continue
            if held:
                out += self.word(held)
                word, held = " " + part, ""
            ids = known.get(word)
            if ids is None:
                ids = self.word(word)
                if len(word) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = ids
            out += ids
        return out + list(self.word(held)) if held else out

    def encode(self, text: str) -> np.ndarray:
        if self.cut_special is None or not any(s in text for s in self.special):
            return np.array(self.plain(text), np.uint32)
        out: list[int] = []
        for part in self.cut_special.split(text):
            out += [self.special[part]] if part in self.special else self.plain(part)
        return np.array(out, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """Bytes are gathered from the table of all tokens by offset and length."""
        size = self.length[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.offset[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.table[at].tobytes().decode("utf-8", "replace")


_MADE: dict[str, BytePairs] = {}


def pairs_of(spec: str) -> BytePairs:
    """The encoder of a file, made once in each Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _MADE:
        _MADE[key] = BytePairs(spec)
    return _MADE[key]


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every text of docs (doc_id, text): doc_id, ids (its tokens), decoded (the text that
    these tokens stand for).

    tokenizer: path of the vocabulary file on the driver; its content (about 1.5 MB) is broadcast. Each
    row stays in its task: no shuffle, and memory as one Arrow batch and PART tokens. Null texts are empty
    and have no tokens; null or repeated ids and repeated rows are kept; an empty table gives an empty
    result."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pairs_of(spec.value)
        for batch in batches:
            first, ids, texts = 0, [], []

            def out(end: int) -> pa.RecordBatch:
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                tokens = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
                return pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens)), pa.array(texts, pa.string())], schema=ENCODED)  # noqa: B023

            held = 0
            for at, text in enumerate(batch.column("text")):
                ids.append(bpe.encode(text.as_py() or ""))
                texts.append(bpe.decode(ids[-1]))
                held += len(ids[-1])
                if held > PART:
                    yield out(at + 1)
                    first, ids, texts, held = at + 1, [], [], 0
            yield out(batch.num_rows)

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encoded makes of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, text in zip(batch.column("ids"), batch.column("decoded"), strict=True):
                ids = ids.values.to_numpy(zero_copy_only=False)
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.as_py().encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(OUT)[1:], strict=True))], schema=OUT)

    return encoded(docs, tokenizer).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
