"""The whole pipeline over an awkward and an empty table: decisions of all stages show in the tokens."""

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from relog.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, bucket string"


def rows():
    prose = " ".join(f"stone{i} river{i * 7 % 101} and town{i * 13 % 97}" for i in range(90))
    other = "\n\n".join(f"line{i}\twith {i * 3} things" for i in range(120))
    texts = [prose, prose, prose + " end", other, None, "", " \n", "write to anna@x.org " + prose[::-1], "short text"]
    out = [(i, t, "en", None if i == 3 else "s", None, 1, "x", "y") for i, t in enumerate(texts)]
    return [*out, out[3], (None, "text without id", "en", "s", 3, 1, "x", "y"), (None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize("given", [rows(), []], ids=["awkward", "empty"])
def test_pipeline(spark, tmp_path, given):
    spark.createDataFrame(given, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokenizer_path())
    assert bool(got) == bool(given)
    for r in got:
        assert library.decode(r["ids"], skip_special_tokens=False) == r["decoded"]
    ids = {r["doc_id"] for r in got}
    assert not ids & {1, 2, 4, 5, 6}  # near and exact copies and empty texts are gone
    if given:
        assert {0, 3, 7} & ids and not any("anna@x.org" in r["decoded"] for r in got)
        assert all("\t" in r["decoded"] for r in got if r["doc_id"] == 3)


def test_stages_decide(spark, tmp_path):
    """Of good documents, their near copies and labelled junk, exactly one good document of each group comes
    out whole (one source: the mix takes every block), with its personal data generalised."""
    good = {i: " ".join(f"stone{i} river{(i + 3) * j % 101} over town{(i + 7) * j % 97}, the road went on." for j in range(1, 40)) for i in range(90)}
    good[5] += " Write to anna@x.org today."
    junk = {200 + i: " ".join(f"%#{(i + 5) * j % 89} $$ x{j % 3} x{j % 3} ||" for j in range(1, 60)) for i in range(90)}
    copies = {400 + i: f"{good[i]} The end." for i in range(0, 90, 9)} | {500 + i: good[i] for i in range(0, 90, 10)}
    texts = good | junk | copies
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d not in junk), 0) for d in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {d: t.replace("anna@x.org", "[EMAIL]") for d, t in good.items()}
    assert {r["doc_id"] for r in got} == set(good)
    assert {(d, t) for d, t in whole.items()} <= {(r["doc_id"], r["decoded"]) for r in got}
    assert all(r["decoded"] in whole[r["doc_id"]] or len(r["decoded"]) < len(whole[r["doc_id"]]) for r in got)
