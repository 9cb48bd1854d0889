"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary of the sentencepiece library.

A state tells, for each suffix of what was read that a longer piece could begin with, which token came
before the suffix and how many tokens there were. The next character leads to one next state and changes
the number of tokens by a known amount, so every transition carries a number and the sum over a text is
its token count. States are compiled when they are first met and kept."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, spread_join, text_of

#: What stands for a space in pieces (fixed value, public).
MARK = "▁"
#: Characters of a part of a long text, and parts whose maps one task composes.
PART = 1 << 16
PARTS = 64
#: Characters before a part from which its likely entry states are guessed.
BEFORE = 64
#: Characters after which runs from several entry states are compared.
STRIDE = 256
#: Words and transitions that a worker keeps; beyond that it starts anew.
KEPT = 1_000_000

State = tuple[tuple[str, str, int], ...]
#: Nothing read, or nothing that could matter: (suffix, token before it, tokens there less tokens now).
START: State = (("", "", 0),)


class Counts(dict):
    """Token counts of words, made when they are asked for."""

    def __init__(self, made: Transducer):
        super().__init__()
        self.made = made

    def __missing__(self, word: str) -> int:
        n = self.made.run(START, MARK + word)[1]
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n


class Transducer:
    """The transducer of a .model file's bytes: byte-pair pieces with byte fallback, texts as they are but
    for marks in place of spaces and one before the text. Another kind of model raises ValueError."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as spec

        parsed = spec.ModelProto.FromString(model)
        how = parsed.normalizer_spec
        if parsed.trainer_spec.model_type != spec.TrainerSpec.BPE or not parsed.trainer_spec.byte_fallback or parsed.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a byte-pair model with byte fallback")
        if how.precompiled_charsmap or not how.add_dummy_prefix or how.remove_extra_whitespaces or not how.escape_whitespaces:
            raise ValueError("the model changes texts before it cuts them")
        if any(p.type in (spec.ModelProto.SentencePiece.USER_DEFINED, spec.ModelProto.SentencePiece.UNUSED) for p in parsed.pieces):
            raise ValueError("the model has pieces with rules of their own")
        library = SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        self.pieces = {library.id_to_piece(i): library.get_score(i) for i in plain}
        self.longer = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(c not in self.pieces for p in self.pieces for c in p) or any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a character has no piece, or a mark is inside of one")
        self.fit: dict[tuple[str, str], bool] = {}
        self.words = Counts(self)
        self.forget()

    def forget(self) -> None:
        self.number: dict[State, int] = {}
        self.states: list[State] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.size = 0

    def numbered(self, state: State) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return at

    def fits(self, a: str, b: str) -> bool:
        """Whether byte-pair merging of a + b ends in just a and b. Merges on one side of the border come in
        the same order whatever lies farther off, so tokens that fit in pairs fit as a whole."""
        if a[-1] + b[0] not in self.pairs:
            return True
        known = self.fit.get((a, b))
        if known is None:
            if len(self.fit) >= KEPT:
                self.fit.clear()
            known = self.fit[a, b] = self.merged(a, b)
        return known

    def merged(self, a: str, b: str) -> bool:
        symbols, border, scores = [*a, *b], len(a), self.pieces
        while len(symbols) > 1:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                break
            if where + 1 == border:
                return False
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
            if where < border:
                border -= 1
        return symbols == [a, b]

    def compiled(self, at: int, char: str) -> tuple[int, int]:
        """The transition of a state for a character: next state, change of the number of tokens."""
        ends, open_ = [], []
        for suffix, before, n in self.states[at]:
            longer = suffix + char
            if longer in self.pieces:
                ends.append((longer, before, n))
            if longer in self.longer:
                open_.append((longer, before if before and before[-1] + longer[0] in self.pairs else "", n))
        # just one of the pieces that end here fits what is before it, so the last one needs no test
        token, added = "", len(char.encode())
        for i, (piece, before, n) in enumerate(ends):
            if i + 1 == len(ends) or not before or self.fits(before, piece):
                token, added = piece, n + 1
                break
        after = tuple((s, before, n - added) for s, before, n in open_) + (("", token, 0),) if token else START
        step = self.steps[at][char] = (self.numbered(after), added)
        self.size += 1
        return step

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after text and the tokens added, from a state on."""
        if self.size > KEPT:
            self.forget()
        at, n, steps = self.numbered(state), 0, self.steps
        for char in text:
            step = steps[at].get(char) or self.compiled(at, char)
            at = step[0]
            n += step[1]
        return self.states[at], n

    def count(self, text: str) -> int:
        """Tokens of a whole text. No piece holds a mark after another character, so each word is counted by
        itself, and frequent ones once."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return sum(map(self.words.__getitem__, words))
        total, marks = 0, ""
        for word in words[:-1]:
            if word:
                total += self.run(START, marks + MARK + word)[1] if marks else self.words[word]
                marks = ""
            else:
                marks += MARK
        last = words[-1]
        return total + (self.run(START, marks + MARK + last)[1] if marks else self.words[last])


@dataclass
class StateMap:
    """What a stretch of text does to any entry state: head is read first; known has some entry states' state
    and tokens after it. If settled, what follows the head doesn't depend on the entry: it ends in end, with
    n more tokens."""

    head: str
    known: dict[State, tuple[State, int]]
    settled: bool = False
    end: State = START
    n: int = 0

    def after_head(self, made: Transducer, state: State) -> tuple[State, int]:
        return self.known.get(state) or made.run(state, self.head)

    def __call__(self, made: Transducer, state: State) -> tuple[State, int]:
        after, n = self.after_head(made, state)
        return (self.end, n + self.n) if self.settled else (after, n)


def state_map(made: Transducer, before: str, part: str) -> StateMap:
    """The map of a part. Where two neighbouring characters are together in no piece, the state is the same
    whatever came before; so the head ends there. A part without such a place keeps its whole text, with the
    results for the states that its left context can lead to."""
    ends = next((i for i in range(1, len(part)) if part[i - 1 : i + 1] not in made.pairs), None)
    if ends is not None:
        end, n = made.run(START, part[ends:])
        return StateMap(part[:ends], {}, True, end, n)
    runs = {state: (state, 0) for state in {made.run(START, before[i:])[0] for i in range(len(before) + 1)}}
    for i in range(0, len(part), STRIDE):
        stride = part[i : i + STRIDE]
        moved = {state: made.run(state, stride) for state in {s for s, _ in runs.values()}}
        runs = {entry: (moved[s][0], n + moved[s][1]) for entry, (s, n) in runs.items()}
    return StateMap(part, runs)


def compose(made: Transducer, a: StateMap, b: StateMap) -> StateMap:
    """The map of a's text with b's behind it; the operation is associative."""
    if a.settled:
        end, n = b(made, a.end)
        return StateMap(a.head, a.known, True, end, a.n + n)
    known = {}
    for entry, (state, n) in a.known.items():
        after, more = b.after_head(made, state)
        known[entry] = (after, n + more)
    return StateMap(a.head + b.head, known, b.settled, b.end, b.n)


def composed(made: Transducer, maps: Iterable[StateMap]) -> StateMap:
    whole = None
    for m in maps:
        whole = m if whole is None else compose(made, whole, m)
    return whole


_MADE: dict[str, Transducer] = {}


def transducer_of(model: bytes) -> Transducer:
    """The transducer of a model, compiled once in each Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _MADE:
        _MADE[key] = Transducer(model)
    return _MADE[key]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text of docs (doc_id, text), as the library counts without
    special tokens.

    model: path of the vocabulary file on the driver; its content (0.5 MB) is broadcast. Texts of up to part
    characters are counted where they lie. Longer ones are cut into parts that many tasks work on: each part
    becomes a state map, and maps compose in order, first in blocks of PARTS, then the blocks of a text. Equal
    long texts (by SHA-256 and length) are worked on once. Null texts are empty and have no tokens; null or
    repeated ids and repeated rows are kept; an empty table gives an empty result."""
    with open(model, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    is_long = F.length("text") > part

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = transducer_of(spec.value)
        for batch in batches:
            n = [made.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                whole = marked(value.as_py())
                for i, at in enumerate(range(0, len(whole), part)):
                    yield pa.RecordBatch.from_pydict({"key": [key], "no": pa.array([i], pa.int64()), "before": [whole[max(0, at - BEFORE) : at]], "part": [whole[at : at + part]]})

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = transducer_of(spec.value)
        for batch in batches:
            maps = [pickle.dumps(state_map(made, b.as_py(), p.as_py())) for b, p in zip(batch.column("before"), batch.column("part"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array(maps, pa.binary())], ["key", "no", "map"])

    def of_block(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
        whole = composed(transducer_of(spec.value), map(pickle.loads, maps.sort_values("no")["map"]))
        return pd.DataFrame({"key": [key[0]], "no": [key[1]], "map": [pickle.dumps(whole)]})

    def of_text(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
        made = transducer_of(spec.value)
        whole = composed(made, map(pickle.loads, maps.sort_values("no")["map"]))
        return pd.DataFrame({"key": [key[0]], "n_tokens": [whole(made, START)[1]]})

    short = rows.where(~is_long).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    keyed = rows.where(is_long).withColumn("key", F.concat(F.sha2("text", 256), F.lit(":"), F.col("n_bytes").cast("string")))
    owners = checkpoint(keyed.select("doc_id", "n_bytes", "key"))
    made = short
    if not owners.isEmpty():
        parts = keyed.select("key", "text").mapInArrow(cut, "key string, no long, before string, part string")
        once = parts.groupBy("key", "no").agg(F.first(F.struct("before", "part")).alias("p")).select("key", "no", "p.before", "p.part")
        maps = once.mapInArrow(mapped, "key string, no long, map binary")
        blocks = maps.groupBy("key", F.floor(F.col("no") / PARTS).alias("block")).applyInPandas(of_block, "key string, no long, map binary")
        totals = blocks.groupBy("key").applyInPandas(of_text, "key string, n_tokens long")
        per_key = checkpoint(totals.join(owners.groupBy("key").agg(F.count("*").alias("n")), "key"))
        made = short.unionByName(spread_join(owners, per_key, ["key"]).select("doc_id", "n_bytes", "n_tokens"))
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
