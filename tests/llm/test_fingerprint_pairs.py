"""Near copies of whole texts that meet by their SimHash fingerprints alone."""

import random

from pyspark.sql import functions as F

from relog.llm import nearcopies, simhash


def test_near_copies_meet_by_fingerprints_and_are_verified(spark):
    rng = random.Random(3)
    texts = [""]
    for _ in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(800)]
        texts += [" ".join(words), " ".join(words), *[" ".join([*words[: 799 - n], f"x{n}", *words[800 - n :]]) for n in range(3)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.unhex(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text"))))
    prints = nearcopies.signatures(docs, 5, simhash.fingerprint).withColumn("bands", F.array().cast("array<long>"))  # no min-hashes
    key = {r["doc_id"]: bytes(r["key"]) for r in prints.collect()}
    fp = [simhash.fingerprint(t.encode().split(), 5) for t in texts]
    root = {k: k for k in key.values()}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(1, len(texts)):
        for j in range(1, i):
            a, b = set(nearcopies.shingle_set(texts[i]).tolist()), set(nearcopies.shingle_set(texts[j]).tolist())
            if (fp[i] ^ fp[j]).bit_count() <= simhash.RADIUS and len(a & b) >= 0.8 * len(a | b):
                x, y = find(key[i]), find(key[j])
                root[max(x, y)] = min(x, y)
    want = {k: find(k) for k in root}
    assert len(set(want.values())) < len(want)
    found = {bytes(r["key"]): bytes(r["component"]) for r in nearcopies.classes(docs, prints, pairs=simhash.met_by_fingerprint(prints)).collect()}
    assert {k: found.get(k, k) for k in want} == want
