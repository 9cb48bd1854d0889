"""How filters of documents interact: what each of them removes, in every order, by source.

A document's failures are a mask of five bits. Four of them its text tells; the fifth says that a smaller
doc_id has the same text, found by routing texts by their fingerprint. All counts of all orders follow from
how many documents of a source have each mask."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import text_of

FILTERS = "ABCDE"
SHORT, REPEATS, CAPITALS, SYMBOLS, COPY = (1 << i for i in range(len(FILTERS)))
MASKS = 1 << len(FILTERS)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
_LATER_BYTES = bytes(range(0x80, 0xC0))  # of a UTF-8 character
#: Bytes of texts that a task holds while it looks for copies among its own rows.
HELD = 64 << 20
#: Bytes of texts for each partition that texts are routed to, where that makes more than the session's number.
ROUTED_BYTES = 256 << 20
ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes) -> int:
    """The mask of what a text (UTF-8) fails by itself; bytes.split cuts at the contract's white space."""
    words = text.split()
    mask = SHORT * (len(words) < 200) + REPEATS * (100 * len(set(words)) < 50 * len(words))
    capitals, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _LATER_BYTES))
    return mask + CAPITALS * (100 * capitals > 2 * points) + SYMBOLS * (len(text.translate(None, _SYMBOLS)) < len(text))


def fingerprint(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


#: fingerprint, (text or None where the mask is final, doc_id, mask, documents by part)
Routed = tuple[int, tuple[bytes | None, int | None, int, dict[str, int]]]


def merged(into: dict, counts: dict) -> dict:
    for k, n in counts.items():
        into[k] = into.get(k, 0) + n
    return into


class Chains:
    """Texts that share a fingerprint, told apart by their whole text; of each the smallest id's documents are held."""

    def __init__(self):
        self.chains: dict[int, dict[bytes, list]] = {}
        self.bytes = 0

    def add(self, print_: int, text: bytes, doc_id: int, mask: int | None, parts: dict[str, int]) -> tuple[int, int, dict[str, int]] | None:
        """Puts documents of one id in; returns those that are now known not to have the smallest id of
        their text: doc_id, mask, documents by part."""
        chain = self.chains.setdefault(print_, {})
        held = chain.get(text)
        if held is None:
            chain[text] = [doc_id, failures(text) if mask is None else mask, parts]
            self.bytes += len(text)
            return None
        least, mask, of_least = held
        if doc_id == least:
            merged(of_least, parts)
            return None
        if doc_id > least:
            return doc_id, mask | COPY, parts
        held[0], held[2] = doc_id, parts
        return least, mask | COPY, of_least

    def drained(self) -> Iterator[tuple[int, bytes, int, int, dict[str, int]]]:
        for print_, chain in self.chains.items():
            for text, held in chain.items():
                yield print_, text, *held
        self.chains, self.bytes = {}, 0


def routed(rows: Iterable[Row]) -> Iterator[Routed]:
    """What a task sends on: of each text among its rows only the smallest id with the text, to where the
    fingerprint leads, and all other documents without text, spread by their id. So a text of a third of all rows
    is sent once a task."""
    found = Chains()

    def final(doc_id: int | None, mask: int, parts: dict[str, int]) -> Routed:
        return fingerprint(str(doc_id).encode()), (None, doc_id, mask, parts)

    for doc_id, part, text in rows:
        text = bytes(text)
        if doc_id is None:
            yield final(None, failures(text), {part: 1})
            continue
        settled = found.add(fingerprint(text), text, doc_id, None, {part: 1})
        if settled:
            yield final(*settled)
        if found.bytes > HELD:
            yield from ((p, (t, *rest)) for p, t, *rest in found.drained())
    yield from ((p, (t, *rest)) for p, t, *rest in found.drained())


def copies(rows: Iterable[Routed]) -> Iterator[tuple[int | None, int, dict[str, int]]]:
    """doc_id, mask, documents by part, of rows in the order of their fingerprints; only the chains of one
    fingerprint are held."""
    found, last = Chains(), None
    for print_, (text, doc_id, mask, parts) in rows:
        if print_ != last:
            yield from (tuple(rest) for _, _, *rest in found.drained())
            last = print_
        if text is None:
            yield doc_id, mask, parts
        else:
            settled = found.add(print_, text, doc_id, mask, parts)
            if settled:
                yield settled
    yield from (tuple(rest) for _, _, *rest in found.drained())


def orders() -> list[tuple[str, int, int, np.ndarray]]:
    """filter_order, step, filter's place, and which masks count as kept, removed, redundant and failing only this
    filter: 600 rows, fixed by the five filters."""
    masks, out = np.arange(MASKS), []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            fails, gone = masks & (1 << f) > 0, masks & before > 0
            out.append(("".join(FILTERS[i] for i in order), step + 1, f, np.stack([~fails & ~gone, fails & ~gone, fails & gone, masks == 1 << f]).astype(np.int64)))
            before |= 1 << f
    return out


def expanded(rows: Iterable[tuple[str, np.ndarray]]) -> Iterator[tuple]:
    """All orders' rows of a part, from its counts: masks in columns; all, good and toxic documents in rows."""
    made = orders()
    for part, counts in rows:
        n = [(kind @ counts.T) for *_, kind in made]
        total = np.zeros(len(FILTERS), np.int64)
        for (_, _, f, _), at in zip(made, n, strict=True):
            total[f] += at[1, 0]
        for (order, step, f, _), at in zip(made, n, strict=True):
            yield part, order, step, *map(int, at[:, 0]), int(at[1, 1]), int(at[1, 2]), int(total[f])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters, and step, as in ROWS, of docs (doc_id, text, source) and
    labels (doc_id, quality, toxic).

    Texts are routed by xxHash64, whole, with only one row for each text and task; in a partition the rows come in
    the order of their fingerprints, sorted outside of memory where needed, so that one fingerprint's chain is
    held at a time. Labels meet by doc_id, counts by part, both combined in the tasks before they are sent:
    neither a hot source nor a repeated id is one task's work.

    Null texts are empty; a null source is the part '', like an empty one. A null doc_id is no copy, makes none,
    and has no label. Rows with the same id and text are no copies of each other, each counts. An id that is
    labelled more than once is good (toxic) if any of its rows says so. Sources without documents, so empty
    tables, give no rows."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // ROUTED_BYTES)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")), text_of().cast("binary"))
    found = texts.rdd.mapPartitions(routed).repartitionAndSortWithinPartitions(n, partitionFunc=lambda print_: print_).mapPartitions(copies)

    # by id: [is good, is toxic, documents by (part, mask)]
    told = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False)))
    facts = found.map(lambda r: (r[0], [False, False, {(part, r[1]): n for part, n in r[2].items()}])).union(told.rdd.map(lambda r: (r[0], [r[1], r[2], {}])))

    def both(a: list, b: list) -> list:
        return [a[0] or b[0], a[1] or b[1], merged(a[2], b[2])]

    by_id = facts.combineByKey(lambda a: a, both, both, numPartitions=n)

    def vectors(rows: Iterable[tuple[int, list]]) -> Iterator[tuple[str, tuple[int, int, int, int]]]:
        for _, (good, toxic, documents) in rows:
            for (part, mask), count in documents.items():
                yield part, (mask, count, count * good, count * toxic)

    def put(counts: np.ndarray, fact: tuple[int, int, int, int]) -> np.ndarray:
        counts[:, fact[0]] += fact[1:]
        return counts

    by_part = by_id.mapPartitions(vectors).combineByKey(lambda fact: put(np.zeros((3, MASKS), np.int64), fact), put, lambda a, b: a + b, numPartitions=n, partitionFunc=lambda part: fingerprint(part.encode()))
    return spark.createDataFrame(by_part.mapPartitions(expanded), ROWS)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (
  SELECT part,
         CAST(len(ws) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER)
         + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INTEGER)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS mask,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM w),
v AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(l, b)),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS f, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(step)),
c AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (mask & (f | before) = 0) AS kept, sum(n) FILTER (mask & f > 0 AND mask & before = 0) AS removed,
         sum(n) FILTER (mask & f > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = f) AS unique_fails,
         sum(g) FILTER (mask & f > 0 AND mask & before = 0) AS good_lost, sum(x) FILTER (mask & f > 0 AND mask & before = 0) AS toxic_lost
  FROM v, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM c
"""
