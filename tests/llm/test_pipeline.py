"""The pipeline against plain loops over the same documents."""

import os
import subprocess
import sys
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from lodestone.llm import language_id
from tests.llm import test_decontamination, test_line_dedup, test_near_copies, test_packing
from tests.llm.cases import awkward


def _brute(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit_language_model(table)
    docs = {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}
    for i, text in list(docs.items()):
        (marginals,), (words,) = model.label([text or ""])
        lang, _, margin = model.document(marginals, words)
        if lang == "und" or (len(words) >= P.LEAST_WORDS and margin < P.LEAST_MARGIN):
            del docs[i]
    kept = test_line_dedup._brute(list(docs.items()), 10, True)
    docs = {i: t for i, t in kept.items() if t or t == docs[i]}
    left = test_near_copies._brute(sorted(docs.items()))
    docs = {i: t for i, t in docs.items() if i in left}
    items = [(r["item_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i, _ in test_decontamination._brute(list(docs.items()), items):
        docs.pop(i, None)
    return docs


def test_run_against_brute_force(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in _brute(spark, sf_dir).items()}
    test_packing._check(P.run(spark, sf_dir).collect(), ids)


def test_stages_keep_columns_and_survive_awkward_documents(spark, sf_dir):
    docs = awkward(spark)
    for _, stage in P.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            found = stage(spark, frame, sf_dir)
            assert found.columns == docs.columns and found.count() <= frame.count()
    assert P.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_line_stage_corrects_the_length(spark, sf_dir):
    rows = [(i, f"same line\nown line {i}", "en", "s", 99) for i in range(12)] + [(50, "same line", "en", "s", 9), (51, "", "en", "s", 0)]
    found = P.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf_dir)
    assert {(r["doc_id"], r["n_chars"]) for r in found.collect()} == {(0, len("same line\nown line 0"))} | {(i, len(f"own line {i}")) for i in range(1, 12)} | {(51, 0)}


def test_line_stage_leaves_the_first_copy_and_the_first_passage(spark):
    rows = [(i, "whole\ncopy", "en", "s", 10) for i in range(20)] + [(30 + i, f"passage\nown {i}", "en", "s", 99) for i in range(12)]
    found = P.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {0: "whole\ncopy", 30: "passage\nown 0"} | {30 + i: f"own {i}" for i in range(1, 12)}


def test_language_stage_rejects_mixed_texts_and_keeps_clean_ones(spark):
    english = "the house of the old man was near the river and they went there with the children in the morning"
    german = "das haus des alten mannes war nahe am fluss und sie gingen dort mit den kindern am morgen hin"
    rows = [(i, text, lang) for i in range(60) for lang, text in (("en", f"{english} {i}"), ("de", f"{german} {i}"))]
    rows = [(k, text, lang, "s", len(text)) for k, (_, text, lang) in enumerate(rows)]
    rows += [(1000, f"{english}\n{german}", None, "s", 1), (1001, "12 34 !!", None, "s", 1), (1002, "the old house", None, "s", 1), (1003, f"{english}\ndas haus", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"] for r in P.language_stage(spark, docs, "").collect()}
    assert {r[0] for r in rows} - found == {1000, 1001}


def test_language_stage_keeps_columns_that_are_named_like_predictions(spark):
    docs = awkward(spark)
    found = {(r["doc_id"], r["score"], r["label"]) for r in P.language_stage(spark, docs, "").collect()}
    assert found and found <= {(r["doc_id"], 0.5, "x") for r in docs.collect()}


_SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.adaptive.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
item = " ".join(f"word{i}" for i in range(20))
spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(sys.argv[1] + "/benchmark.parquet")
docs = spark.createDataFrame([(1, " ".join([item] * 600)), (2, "a clean text of a few words")], "doc_id long, text string")
print("LEFT", [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, sys.argv[1]).collect()])
"""


def test_decontamination_of_a_long_document_of_passages_fits_a_small_heap(tmp_path):
    root = Path(__file__).resolve().parents[2]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 700m pyspark-shell", "PYTHONPATH": str(root)}
    ran = subprocess.run([sys.executable, "-c", _SMALL_HEAP, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "LEFT [2]" in ran.stdout, ran.stderr[-1500:]
