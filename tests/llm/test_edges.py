"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing columns: every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import chat, decontaminate, licenses, lm_scoring, neardup, packing, pii, quality, token_counts, urlfilter
from weftline.llm.shared import picked

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "label fp n_shingles list h n_tokens group_id digest shard u d s c0 c1 __row n node a v code op turns out conflict url blocked item_id words squeezed t __text_hash doc TEXT Doc_Id H Turn Role `odd a.b".split()
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions near old stone bridges at dawn".split()
LONG = " ".join(f"{WORDS[i % 20]}{i % 9973 if i % 3 else ''}" for i in range(200_000))


def rows():
    return [
        (1, "the plain text of a document about rivers and hills", "en", "s", 51),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (None, "the text of a row without an id, long enough to have a handful of words", None, "s", None),
        (None, None, None, None, None),
        (4, LONG, "en", "hot", len(LONG)),
        (5, "same words here as there are in the other one, quite the same words", "en", "hot", 67),
        (6, "same words here as there are in the other one, quite the same words", "en", "hot", 67),
        (7, "repeated row with mail jo.doe@mail.example.com in it", "en", "hot", 53),
        (7, "repeated row with mail jo.doe@mail.example.com in it", "en", "hot", 53),
        (8, " \n\t ", "en", "s", 4),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(rows(), SCHEMA)
    return d.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASH)]).withColumn("TEXT2", F.lit(None).cast("string")).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the plain text of a document about rivers and hills"), (2, None), (3, ""), (None, "unrelated item words that occur in no document at all"), (1, "the plain text of a document about rivers and hills")], "item_id bigint, text string")


def test_stages_keep_columns(spark, docs, empty, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (docs, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, str(tmp_path))
            assert out.columns == d.columns, name
            assert out.count() <= d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() >= d.count()


def test_quality(docs, empty):
    r = {(x["doc_id"], x["n_words"]): x["kept"] for x in quality.report(docs).collect()}
    assert r[(2, 0)] is False and r[(3, 0)] is False and r[(8, 0)] is False and r[(1, 10)] is True and r[(4, 200_000)] is True
    assert quality.report(docs).count() == docs.count() and quality.report(empty).count() == 0
    assert {x["doc_id"] for x in quality.keep(docs).collect()} == {1, None, 4, 5, 6, 7}


def test_neardup(docs, empty):
    g = sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in neardup.groups(docs).collect())
    assert g == [(5, 5, 2), (6, 5, 2), (7, 7, 2), (7, 7, 2)]
    assert neardup.groups(empty).count() == 0
    kept = [r["doc_id"] for r in neardup.deduplicated(docs).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 2, 3, 4, 5, 7, 8] and kept.count(None) == 2


def test_decontaminate(docs, empty, bench):
    r = decontaminate.leaks(docs, bench).collect()
    assert [(x["doc_id"], x["item_id"], x["score"]) for x in r] == [(1, 1, 1.0)]
    assert (r[0]["start_char"], r[0]["end_char"]) == (0, 51)
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count() - 1


def test_pii(docs, empty):
    out = pii.replaced(docs, b"k")
    assert out.dtypes == docs.dtypes
    out = picked(out, "doc_id", "text", "n_chars")
    a = out.where("doc_id = 7").collect()
    assert a[0] == a[1] and "jo.doe" not in a[0]["text"] and a[0]["n_chars"] == len(a[0]["text"])
    assert out.where("doc_id = 2").first()["text"] is None and out.where("doc_id = 3").first()["text"] == ""
    assert out.where("doc_id = 4").first()["text"] == LONG
    assert pii.replaced(empty, b"k").count() == 0


def test_packing(docs, empty):
    p = packing.pack(docs).collect()
    pieces = [r for r in p if r["doc_id"] == 4]
    assert sum(r["n_tokens"] for r in pieces) > 200_000 and max(r["n_tokens"] for r in pieces) <= packing.CAPACITY
    assert sorted(r["piece"] for r in pieces) == list(range(len(pieces)))
    assert [(r["bin_id"], r["n_tokens"]) for r in p if r["doc_id"] in (2, 3)] == [(None, 0)] * 2
    assert len([r for r in p if r["doc_id"] == 7]) == 2 and len([r for r in p if r["doc_id"] is None]) == 2
    assert packing.pack(empty).count() == 0


def test_token_counts(docs, empty):
    t = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in token_counts.rollup(docs).collect()}
    assert t[(None, None)] == (2, 0) and t[("hot", "en")][0] == 5 and sum(n for n, _ in t.values()) == docs.count()
    assert token_counts.rollup(empty).count() == 0


def test_lm(docs, empty):
    s = lm_scoring.score(docs, order=3).collect()
    assert len(s) == docs.count()
    for r in s:
        assert (r["n_bytes"] == 0) == (r["bits_per_byte"] is None) and (r["n_bytes"] == 0) == (r["log_prob"] == 0)
    same = [r["log_prob"] for r in s if r["doc_id"] in (5, 6)]
    assert same[0] == same[1]
    assert lm_scoring.score(empty, order=3).count() == 0


def test_licenses(spark, docs, empty):
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0
    line = "Released under the MIT License."
    d = spark.createDataFrame([(1, f"{line} some words {line}"), (1, f"{line} some words {line}"), (None, line), (2, LONG + " " + line)], "doc_id bigint, text string")
    r = licenses.scan(d).collect()
    assert [x["doc_id"] for x in r].count(1) == 4 and [x["doc_id"] for x in r].count(None) == 1 and [x["start_char"] for x in r if x["doc_id"] == 2] == [len(LONG) + 1]


def test_chat(spark):
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "user", ""), (2, 1, "system", LONG)], "conv_id bigint, turn bigint, role string, text string")
    t = t.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    r = {x["conv_id"]: x for x in chat.formatted(t).collect()}
    assert r[1]["n_turns"] == 3 and r[None]["n_turns"] == 1 and all(x["identical"] for x in r.values())
    assert r[1]["rendered"].startswith("<|im_start|>\n<|im_end|>\n<|im_start|>user\na")
    assert chat.formatted(t.limit(0)).count() == 0


def test_urls(spark):
    p = spark.createDataFrame([(1, "http://a/"), (1, "http://a/"), (2, None), (3, ""), (None, "http://b/" + "x" * 100_000)], "page_id bigint, url string")
    p = p.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH) if c.lower() != "url"], F.lit("x").alias("URL"))
    index = urlfilter.Index(p.where("page_id is null or page_id = 2 or page_id = 3"))
    out = urlfilter.filtered(p, index)
    assert out.columns == p.columns and sorted(r["page_id"] for r in out.collect()) == [1, 1, 2, 3]
    assert urlfilter.filtered(p, urlfilter.Index(p.limit(0))).count() == 5
    assert urlfilter.filtered(p.limit(0), index).count() == 0
