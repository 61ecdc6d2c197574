"""Nulls, long texts, repeated rows, ties and clashing columns, by operator."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vframe.llm import ann, chat, embdedup, langid, mixing, neardup, packing, pii, secret_scan, token_store
from vframe.llm.common import Scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LONG = "the cat and the dog of the house " * 40_000


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of more than a megabyte with a find at its end, one unbroken word, and extra columns with the operators' names."""
    rows = [(1, LONG + "password=abc123xyz and 743-555-3824."), (2, "x" * 500_000), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    return df.select("*", *(F.lit("own").alias(c) for c in ("secrets", "score", "lang_pred", "taken", "shards", "_key", "n_phone", "start", "rep", "within", "size")))


def test_long_texts(spark, long_docs):
    model = langid.fit(["the cat and the dog", "le chat et le chien de la maison"] * 5, ["en", "fr"] * 5)
    found = {r["doc_id"]: r for r in langid.identify(long_docs, model).collect()}
    assert found[1]["lang_pred"] == "en" and found[3]["lang_pred"] == "und" and found[1]["taken"] == "own"
    secrets = {r["doc_id"]: r for r in secret_scan.find_secrets(long_docs, None).collect()}
    start = len(LONG)
    assert [tuple(s) for s in secrets[1]["secrets"]] == [(start, start + len("password=abc123xyz"), "assign")] and secrets[2]["secrets"] == secrets[3]["secrets"] == []
    private = {r["doc_id"]: r for r in pii.pseudonymise(long_docs, "k").collect()}
    assert private[1]["n_phone"] == 1 and private[1]["text"].startswith(LONG) and "555-3824" not in private[1]["text"] and len(private[1]["text"]) == len(LONG) + 36
    assert private[2]["text"] == "x" * 500_000 and private[3]["text"] is None
    plain = Tokenizer.from_file(WORD_BPE)
    want = {i: zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in long_docs.select("doc_id", "text").collect() if i != 1}
    path = Scratch(spark).path("t")
    token_store.write_tokens(long_docs, path, WORD_BPE, 2, shards=2)
    stored = {r["doc_id"]: r for r in token_store.digest(token_store.read_tokens(spark, path)).collect()}
    assert all(stored[i]["ids_crc32"] == c for i, c in want.items()) and stored[1]["n_tokens"] > 8 * 40_000
    pieces = packing.pack(long_docs, WORD_BPE, 2)
    assert {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: r["n_tokens"] for i, r in stored.items()}
    groups = {r["doc_id"]: r for r in neardup.find_duplicates(long_docs.unionByName(long_docs.filter("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 10))).collect()}
    assert groups[11]["component_id"] == 1 and groups[12]["component_id"] == 2 and groups[3]["kept"]
    mixed = {r["doc_id"]: r for r in mixing.mix(long_docs).collect()}
    assert mixed[1]["size"] == 8 * 40_000 + 3 and mixed[1]["taken"] in (mixed[1]["size"], 2 * mixed[1]["size"]) and mixed[3]["taken"] == 0


def test_chat_of_a_long_turn(spark):
    turns = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", "</turn> ### \\ " * 50_000), (2, None, None, None), (2, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    turns = turns.withColumn("formatted", F.lit("own")).withColumn("loss", F.lit("own"))
    got = {r["conv_id"]: r for r in chat.digest(chat.read_chat(chat.format_chat(turns))).collect()}
    loss = "</turn> ### \\ " * 50_000
    assert got[1]["loss_chars"] == len(loss) and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[2]["n_turns"] == 2


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "one two three"), (None, None), (4, "one two three"), (4, "one two three")], "doc_id bigint, text string").withColumn("source", F.lit(None).cast("string"))
    pieces = packing.pack(df, WORD_BPE, 2).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces) and sum(r["length"] for r in pieces) == 3 * 4 + 1
    found = neardup.find_duplicates(df).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, True), (0, 0, True), (4, 4, True), (4, 4, True)]
    assert mixing.mix(df).count() == 4 and pii.pseudonymise(df, "k").count() == 4


def test_repeated_vectors(spark):
    x = np.random.default_rng(4).normal(size=(6, 8)).astype(np.float32)
    rows = [(1, x[0]), (1, x[1]), (2, x[0]), (3, x[2]), (3, x[2]), (4, x[3] * 0), (5, x[2])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<float>")
    df = df.select("*", *(F.lit("own").alias(c) for c in ("h1", "h2", "rep", "copies", "width", "cell")))
    got = {(r["vec_id"], r["component_id"]) for r in embdedup.find_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 3)} and embdedup.find_duplicates(df).count() == 7
    near = ann.search(df, F.col("vec_id") == 2, k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in near][0] == 1 and len(near) == 3 and len({r["vec_id"] for r in near}) == 3


def test_ties_of_languages():
    model = langid.fit(["aa bb", "aa bb"] * 4, ["zz", "yy"] * 4)
    assert langid.predict(model, ["aa bb", "", "12"])[0] == ["yy", "und", "und"]
