"""Operators and the pipeline on rows with nulls, repeats, empty and long texts, clashing columns, and on empty tables."""

import zlib
from collections import Counter

import pytest
import public_tokenizers as P
from pyspark.sql import functions as F
from tests.llm import plain

import corpus_pipeline
from lodestrata.llm import decontaminate, langid, pii, toxicity


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def bare_rows(tricky):
    """The same rows without the clashing columns, in one partition."""
    return tricky.select("doc_id", "text", "lang").coalesce(1)


@pytest.fixture
def marks(spark, tricky_rows):
    ids = sorted({i for i, _, _ in tricky_rows if i is not None})
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in ids if i % 2] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def test_leaks_on_tricky_rows(spark, tricky, tricky_rows, bare_rows, empty):
    """Clashing columns, nulls and repeats change nothing; a document holds every window of its own text, a repeated one in each row."""
    items = [(k, t) for k, (_, t, _) in enumerate(tricky_rows) if t is None or 100 < len(t) < 1500][:12] + [(90, ""), (91, None)]
    bench = spark.createDataFrame([(*r, "s") for r in items], "item_id long, text string, w string")
    found = decontaminate.find_leaks(tricky, bench)
    windows = ["doc_id", "item_id", "window_start", "window_length"]
    assert rows_of(found.select(*windows)) == rows_of(decontaminate.find_leaks(bare_rows, bench.drop("w")).select(*windows))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    for i, t, _ in tricky_rows:
        for k, item in items:
            if item and t == item and decontaminate.normalised(item.encode()):
                assert (i, k) in got
    clean = decontaminate.keep_clean(tricky, bench)
    assert clean.columns == tricky.columns and rows_of(clean.select("doc_id", "text")) == Counter((i, t) for i, t, _ in tricky_rows if i not in {d for d, _ in got})
    assert decontaminate.find_leaks(empty, bench).collect() == [] == decontaminate.keep_clean(empty, bench).collect()
    none = bench.limit(0)
    assert decontaminate.find_leaks(tricky, none).collect() == [] and decontaminate.keep_clean(tricky, none).count() == len(tricky_rows)


def test_toxicity_on_tricky_rows(tricky, tricky_rows, bare_rows, marks, empty):
    key = lambda df: Counter((r.doc_id, round(r.p_low_quality, 6), round(r.p_toxic, 6)) for r in df.collect())
    got = key(toxicity.flagged(tricky, marks))
    assert got == key(toxicity.flagged(bare_rows, marks)) and sum(got.values()) == len(tricky_rows)
    assert toxicity.flagged(empty, marks).collect() == [] == toxicity.keep_clean(empty, marks).collect()
    kept = toxicity.keep_clean(tricky, marks)
    assert kept.columns == tricky.columns and rows_of(kept) - rows_of(tricky) == Counter()
    assert toxicity.keep_clean(tricky, marks.limit(0)).count() == len(tricky_rows)


def test_languages_of_tricky_rows(tricky, tricky_rows, bare_rows, empty):
    key = lambda df: Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in df.select("doc_id", "held_out", "lang_pred", "score").collect())
    out = langid.language_id(tricky, P.path("piece_bpe_32k.model"))
    got = key(out)
    assert got == key(langid.language_id(bare_rows, P.path("piece_bpe_32k.model"))) and sum(got.values()) == len(tricky_rows)
    for (i, held, lang, score), _ in got.items():
        assert lang in ("en", "de", "und") and 0 <= score <= 1
        assert i is None or held == (zlib.crc32(str(i).encode()) % 3 == 1)
    unread = Counter(i for i, t, _ in tricky_rows if t is None or not any(c.isalpha() for c in t))
    assert Counter({i: n for (i, _, lang, _), n in got.items() if lang == "und"}) >= unread - Counter([3, 3, None])
    assert langid.language_id(empty, P.path("piece_bpe_32k.model")).collect() == []


# The pipeline


def folder(spark, path, docs, marks, items):
    docs.withColumn("n_chars", F.when(F.col("doc_id") % 5 != 0, F.length("text")).cast("long")).write.parquet(str(path / "documents.parquet"))
    marks.write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_masking_keeps_what_is_unknown(spark, tricky, tricky_rows, tmp_path):
    docs = tricky.withColumn("n_chars", F.when(F.col("doc_id") % 5 != 0, F.length("text")).cast("long"))
    out = corpus_pipeline.mask_pii(spark, docs, "").collect()
    assert len(out) == len(tricky_rows)
    for r in out:
        assert r.n_chars is None or r.n_chars == len(r.text)
    unknown = lambda rows: sum(r.n_chars is None for r in rows)
    assert unknown(out) == unknown(docs.collect())
    again = spark.createDataFrame([(r.doc_id, r.text) for r in out], "doc_id long, text string")
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in pii.find_pii(again).collect())


def test_pipeline_on_tricky_rows(spark, tricky, tricky_rows, marks, tmp_path):
    """Every stage on what its predecessor kept: whole rows, no repeats of near copies, no leaks, and all tokens of the rest."""
    items = [(1, tricky_rows[-9][1]), (2, None), (3, "")]
    sf_dir = folder(spark, tmp_path, tricky, marks, items)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.count() <= before.count()
        if name == "ngram_jaccard":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            groups = plain.groups(rows)
            want = {(r[0], r[1]) for r, g in zip(rows, groups, strict=True) if not plain.shingles(r[1]) or r[0] == g}
            assert {(r.doc_id, r.text) for r in docs.collect()} == want
        if name == "decontamination":
            assert decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    left = {r.doc_id for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == left and sum(r.length for r in pieces) == sum({(r.doc_id, r.doc_tokens, r.start): r.length for r in pieces}.values())


def test_pipeline_on_an_empty_table(spark, empty, marks, tmp_path):
    sf_dir = folder(spark, tmp_path, empty, marks, [(1, "some benchmark item that nothing holds")])
    assert corpus_pipeline.run(spark, sf_dir).collect() == []
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect() == []
