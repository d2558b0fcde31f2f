import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from ledgerloom.llm import bpe


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(12)
    words = {x: [f"{x}{''.join(rng.choice(s) for _ in range(5))}" for _ in range(400)] for x, s in (("e", "abcde"), ("g", "öxyzu"))}
    texts = [(i, " ".join(rng.choice(words["eg"[i % 2]]) for _ in range(80)), ["en", "de"][i % 2]) for i in range(40)]
    item = " ".join(rng.choice(words["e"]) for _ in range(25))
    near = texts[3][1].split()
    texts += [(100, texts[0][1], "en"), (101, texts[5][1], None), (102, None, "en"), (103, "1234 -- 99", "en")]
    texts += [(104, texts[2][1] + " " + " ".join(item.split()[4:16]), "en"), (105, "x " + " ".join(near), "de")]
    rows = [(d, t, lang, "src", len(t or "")) for d, t, lang in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict((d, t) for d, t, _ in texts)


def test_stages(spark, folder):
    sf, texts = folder
    assert [n for n, _ in p.STAGES] == ["language_id", "simhash", "decontaminate", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spoken = p.languages(spark, docs, sf)
    assert spoken.columns == docs.columns
    assert {r.doc_id for r in spoken.collect()} == set(texts) - {102, 103}
    out = p.run(spark, sf).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {100, 101, 102, 103, 104}  # exact copies, no language, a benchmark passage
    assert set(range(40)) <= ids
    ranks = bpe.load_ranks(public_tokenizers.path(p.TOKENIZER))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        assert r.decoded_text == r.text == texts[r.doc_id]
        assert r.token_ids == " ".join(map(str, library.encode_ordinary(r.text))) and r.lang in ("en", "de")


def test_one_evaluation_of_the_language_model(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for step in (p.languages, p.encoded):
        plan = step(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_clashing_columns_and_empty_tables(spark, folder):
    sf, texts = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 6")
    names = ["row", "found", "code", "n_tokens", "token_ids", "decoded_text", "fp", "content", "nth", "_digest2", "root"]
    clash = docs.select("*", *[F.lit("clash").alias(n) for n in names])
    for name, step in p.STAGES:
        out = step(spark, clash, sf)
        kept = {r.doc_id for r in out.collect()}
        assert kept == set(range(6)), name
        if name != "bpe":
            assert out.columns == clash.columns
        else:
            assert sorted(out.columns) == sorted(clash.columns)
            assert {r.decoded_text for r in out.collect()} == {texts[d] for d in range(6)}
        assert step(spark, clash.limit(0), sf).count() == 0
