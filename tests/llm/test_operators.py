"""Each operator against a plain version, on rows with nulls, empties, repeats and clashing columns, and on an empty table."""

import math
import random
import re
import threading
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, decontaminate, jaccard, langid, licenses, packing, pii, quality, queries, shards, tokencount, toxicity
from tests.llm import plain


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


# 1


def test_license_scan(tricky, tricky_rows, empty):
    got = Counter(tuple(r)[:6] for r in licenses.license_scan(tricky).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert got == Counter((i, *plain.license_row(t, licenses.PHRASES)) for i, t, _ in tricky_rows)
    assert licenses.license_scan(empty).collect() == []


def test_license_templates():
    scan = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    label = lambda text: scan(text.encode())[5]
    assert label("x Licensed under the Apache License, Version 2.0 y") == "apache,apache-2.0"
    assert label("Licensed under the Apache License, Version 3.0") == "apache"
    assert label("Distributed under the terms of the MIT license!") == "mit,mit" or label("Distributed under the terms of the MIT license!") == "mit"
    assert label("licensed under a Creative Commons Attribution 4.0 licence") == "cc-by-4.0"
    a = licenses.compiled('one <<beginOptional>>two <<beginOptional>>three <<endOptional>><<endOptional>><<var;original="x";match=".+">> four')
    accepts = lambda text: a.accepted(licenses.words_of(text.encode()), 0) == len(text.split())
    assert all(map(accepts, ["one two x four", "one two three y z four", "one q four"])) and not accepts("one four") and not accepts("two x four")
    for bad in ("<<endOptional>>", "<<beginOptional>>x", '<<var;original="x";match="[a-z]+">>', "<<alt;x>>"):
        with pytest.raises(ValueError):
            licenses.compiled(bad)


def original(template):
    return re.sub(r'<<var;original="([^"]*)".*?>>|<<[a-zA-Z]+>>', lambda m: m[1] or "", template)


def test_published_wordings_and_long_replacements():
    scan = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    labels = lambda text: scan(text.encode())[5].split(",")
    for label, template in licenses.TEMPLATES.items():
        text = original(template)
        assert label in labels(f"before {text} after")
        less = text.rsplit(None, 1)[0] if label in ("isc", "mit-text", "bsd") else text.split(None, 1)[1]
        assert label == "mit" or label not in labels(less)
    mit = original(licenses.TEMPLATES["mit-text"])
    for n in (1, 41, 500):
        assert "mit-text" in labels(mit.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "someone " * n))
    assert "mit-text" not in labels(mit.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "")) and "mit-text" not in labels(mit.replace("MERCHANTABILITY", "quality"))
    assert "bsd" not in labels(original(licenses.TEMPLATES["bsd"]).replace("DATA, OR PROFITS", "DATA"))
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"
    assert labels(gpl) == ["gpl", "gpl-2.0"]
    spans = scan(f"{mit} between {mit}".encode())[8].split(",")
    n = len(licenses.words_of(mit.encode()))
    assert spans == [f"0:{n}", f"{n + 1}:{2 * n + 1}"]


def test_automaton_against_regular_expressions():
    """Random texts over a small alphabet: what a template accepts at a place is what the same pattern matches there."""
    rng = random.Random(12)
    for template, pattern in [
        ('a <<var;original="x";match=".+">> b<<beginOptional>> c<<endOptional>>', "a (?:[abcd] )+?b (?:c )?"),
        ('<<beginOptional>>a <<endOptional>>b <<var;original="d";match="d|c d">> a', "(?:a )?b (?:d |c d )a "),
        ('a <<var;original="x";match=".+">> b <<var;original="x";match=".+">> c d', "a (?:[abcd] )+?b (?:[abcd] )+?c d "),
    ]:
        a = licenses.compiled(template)
        for _ in range(400):
            words = rng.choices("abcd", k=rng.randint(0, 14))
            text = "".join(w + " " for w in words)
            for i in range(len(words) + 1):
                m = re.compile(pattern).match(text, 2 * i)
                assert a.accepted([w.encode() for w in words], i) == (m.end() // 2 if m else -1)


def test_templates_that_begin_with_free_wording():
    scan = lambda template, text: licenses.Scanner({}, {"x": template})(text.encode())[5:9:3]
    assert scan('<<var;original="a";match=".+">> granted under foo', "hello granted under foo") == ("x", "0:4")
    assert scan('<<var;original="a";match=".+">> granted under foo', "granted under foo") == ("", "")
    assert scan('<<beginOptional>>p q f m <<endOptional>>q <<var;original="a";match=".+">> m', "p q f m q w w w") == ("x", "1:4")
    text = "w " * 200_000
    started = time.monotonic()
    assert scan('<<var;original="a";match=".+">> m', text) == ("", "") and time.monotonic() - started < 30


def test_scanner_against_runs_from_every_word():
    """Random templates with optional wording, choices and loops in any place: what the scanner leaves out never matters."""
    rng = random.Random(21)
    pieces = ["a", "b", "a b", "c", '<<var;original="x";match=".+">>', '<<var;original="a";match="a|b c">>', "<<beginOptional>>a b<<endOptional>>", "<<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>>", '<<beginOptional>>a <<var;original="x";match=".+">> b<<endOptional>>']
    found = 0
    for _ in range(400):
        template = " ".join(rng.choices(pieces, k=rng.randint(1, 5)))
        a = licenses.compiled(template)
        if a.final in a.closed({0}):
            continue  # it accepts no words at all
        scan = licenses.Scanner({}, {"x": template})
        for _ in range(12):
            words = rng.choices("abcd", k=rng.randint(0, 16))
            want, i = [], 0
            while i < len(words):
                end = a.accepted([w.encode() for w in words], i)
                want += [f"{i}:{end}"] if end >= 0 else []
                i = end if end > i else i + 1
            found += len(want)
            assert scan(" ".join(words).encode())[8] == ",".join(sorted(want, key=lambda x: tuple(map(int, x.split(":"))))), (template, words)
    assert found > 1000


def test_license_scan_of_a_long_text():
    """Start words all over a long text: places are right, and finding them takes linear time."""
    text = b"licensed released " * 300_000 + b"under the MIT License. " + b"permission " * 300_000
    started = time.monotonic()
    n_words, n_base, first, last, base, labels, score, n_templates, spans = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)(text)
    assert (n_words, n_base, first, last, base, labels, score, n_templates) == (900_004, 1, 600_002, 600_002, "mit", "mit", 1.0, 1)
    assert spans == "599999:600004" and time.monotonic() - started < 60


# 2


def test_compaction(spark, tricky, tmp_path):
    store = shards.ShardStore(spark, (tmp_path / "s").as_uri(), target_bytes=200_000, smallest=1000, fan_in=3)
    parts = [tricky.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(7)) == k) for k in range(7)]
    for p in parts:
        store.append(p)
    before = store.manifest()
    store.compact()
    after = store.manifest()
    assert len(after.shards) < len(before.shards) and after.version > before.version == 7
    key = lambda df: Counter(map(tuple, df.collect()))
    assert key(store.read()) == key(tricky) == key(store.read(7))
    assert store.vacuum() > 0 and key(store.read()) == key(tricky)
    assert not store.plan(after)


def test_commits_conflict(spark, empty, tmp_path):
    store = shards.ShardStore(spark, (tmp_path / "s").as_uri())
    base = store.manifest()
    assert store.append(empty).version == 1 and store.read().collect() == []
    with pytest.raises(shards.Conflict):
        store._commit(base, "", ())
    with pytest.raises(ValueError):
        store.append(empty.drop("lang"))


def test_two_writers(spark, tmp_path):
    """Writers that commit at once: every append is in the table, each version once."""
    path = (tmp_path / "s").as_uri()
    frames = [spark.createDataFrame([(10 * w + k,) for k in range(3)], "x long") for w in range(4)]
    failed = []

    def write(df):
        try:
            store = shards.ShardStore(spark, path)
            for _ in range(4):
                store.append(df)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(df,)) for df in frames]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = shards.ShardStore(spark, path)
    assert not failed and store.versions() == list(range(1, 17))
    assert Counter(r.x for r in store.read().collect()) == Counter({10 * w + k: 4 for w in range(4) for k in range(3)})


def test_compaction_query(spark, tricky, empty, tmp_path):
    """The registered query's rows from any table, also with its own column names, and from an empty one."""
    for name, df in (("full", tricky), ("none", empty)):
        df.withColumn("n_chars", F.length("text")).write.parquet(str(tmp_path / name / "documents.parquet"))
    key = lambda df: Counter(map(tuple, df.collect()))
    want = tricky.select("doc_id", "lang", "source", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("h"))
    assert key(queries.op2_compaction(spark, str(tmp_path / "full"))) == key(want)
    assert queries.op2_compaction(spark, str(tmp_path / "none")).collect() == []
    store = shards.ShardStore(spark, (tmp_path / "c").as_uri())
    store.append(tricky)
    assert key(store.read()) == key(tricky)


# 3


def test_index_of_a_large_block_is_small():
    """About 16 bytes for each byte of text; what is sent is the text."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(20_000)]
    items = [(i, " ".join(rng.choices(words, k=150)).encode()) for i in range(900)]
    size = sum(len(t) for _, t in items)
    x = decontaminate.index_of(sent := decontaminate.packed(items))
    held = sum(v.nbytes for v in vars(x).values() if isinstance(v, np.ndarray))
    assert len(sent) < size and held < 17 * size and decontaminate.index_of(sent) is x
    text = decontaminate.normalised(b"before " + items[77][1][:400] + b" after")
    assert {int(x.items[w]) for _, w, *_ in decontaminate.leaks([text], x)} == {77}


def test_short_items(spark):
    """Items without a gram are found as whole words, and only so."""
    docs = [(1, "We say: Abc, DE there"), (2, "xabc de"), (3, "abc de"), (4, "abc  dez zz"), (5, None), (6, "nothing")]
    items = [(1, "abc de"), (2, "zz"), (3, "!!"), (4, "abc de!"), (5, ""), (6, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits, r.doc_end) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(1, 1, 0, 13), (1, 4, 0, 13), (3, 1, 0, 6), (3, 4, 0, 6), (4, 2, 0, 10)}
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {2, 5, 6}


def test_leaks(spark):
    rng = random.Random(3)
    letters = "abcdefgh  "
    items = [(k, "".join(rng.choices(letters, k=n))) for k, n in enumerate((70, 90, 150, 260, 5, 0))] + [(7, None)]
    docs = [(0, None, "z"), (1, "", "z"), (2, "".join(rng.choices(letters, k=4000)), "z")]
    for k, text in items[:4]:
        for edits in (0, 2, 5, 20):
            x = list(text)
            for _ in range(edits):
                x[rng.randrange(len(x))] = rng.choice(letters)
            docs.append((len(docs), "".join(rng.choices(letters, k=50)) + "".join(x).upper() + "".join(rng.choices(letters, k=50)), "z"))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t, _ in docs:
        for k, text in items:
            for start, w in decontaminate.windows_of(decontaminate.normalised((text or "").encode())):
                most = int(decontaminate.ERROR * len(w))
                if len(w) < decontaminate.Q:
                    hit = w and b" " + w + b" " in b" " + decontaminate.normalised((t or "").encode()) + b" "
                    want |= {(d, k, start)} if hit else set()
                elif len(w) - decontaminate.Q + 1 - most * decontaminate.Q >= 1 and t and plain.best_edits(w, decontaminate.normalised(t.encode())) <= most:
                    want.add((d, k, start))
    got = {(r.doc_id, r.item_id, r.window_start) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == want and want
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {d for d, *_ in docs} - {d for d, *_ in want}
    assert decontaminate.find_leaks(df, bench.limit(0)).collect() == [] == decontaminate.find_leaks(df.limit(0), bench).collect()


def test_leaks_of_passages(spark):
    """Passages that straddle the covering windows, and windows too short for their share of edits."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=6)) for _ in range(n // 7 + 1))[:n].replace(" ", "x", 1)
    items = [(0, words(384)), (1, words(990)), (2, words(150)), (3, "abcdefghi klmnopqr")]
    parts = [(0, 40, 340), (1, 201, 590), (1, 433, 557), (2, 13, 140), (3, 0, 18)]
    docs = [(i, f"{words(300)} {items[k][1][a:b]} {words(300)}") for i, (k, a, b) in enumerate(parts)]
    docs += [(10, f"{words(300)} {items[0][1][60:115]} {words(300)}"), (11, words(900)), (12, f"{words(90)} {items[1][1][300:360]}Q{items[1][1][361:440]} {words(90)}")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {*((i, k) for i, (k, *_) in enumerate(parts)), (12, 1)}
    assert len(rows) == len({(r.doc_id, r.item_id, r.window_start, r.window_length) for r in rows})
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {10, 11}


# 4


@pytest.mark.parametrize("boundary", [None, 0, 32])
def test_jaccard_groups(tricky, tricky_rows, boundary):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(tricky, boundary).collect())
    ids = plain.groups([(i, t) for i, t, _ in tricky_rows])
    assert got == Counter((i, len(plain.shingles(t)), g) for (i, t, _), g in zip(tricky_rows, ids, strict=True))


def test_jaccard_groups_through_two_levels(tricky, tricky_rows):
    """More ranges than a run is divided into at once."""
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(tricky, fan=4, range_size=200).collect())
    ids = plain.groups([(i, t) for i, t, _ in tricky_rows])
    assert got == Counter((i, len(plain.shingles(t)), g) for (i, t, _), g in zip(tricky_rows, ids, strict=True))


def test_one_of_each(tricky, tricky_rows, empty):
    ids = plain.groups([(i, t) for i, t, _ in tricky_rows])
    want = {i for (i, t, _), g in zip(tricky_rows, ids, strict=True) if not plain.shingles(t) or i == g}
    kept = jaccard.one_of_each(tricky)
    rows = kept.collect()
    assert {r.doc_id for r in rows} == want and kept.columns == tricky.columns
    assert len([r for r in rows if r.text and r.text.strip()]) == len({g for (_, t, _), g in zip(tricky_rows, ids, strict=True) if plain.shingles(t)})
    assert jaccard.one_of_each(empty).collect() == [] == jaccard.near_copies(empty).collect()


def test_packed_runs():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**64 - 1, 500, dtype=np.uint64))
    a, b = rng.integers(0, 60000, 500).astype(np.uint16), rng.integers(0, 200, 500).astype(np.uint8)
    for x, y in zip((h, a, b), jaccard.unpacked(jaccard.packed(h, a, b), np.uint16, np.uint8), strict=True):
        assert (x == y).all()


# 5


def test_token_counts(spark, tricky, tricky_rows, empty, tmp_path):
    cache = tokencount.TokenCache(spark, (tmp_path / "cache").as_uri())
    path, t = P.path("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in tricky_rows)
    for _ in range(2):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.token_counts(tricky, path, cache).collect())
        assert got == want
    stored = cache.read()
    assert stored.count() == stored.select("digest").distinct().count()
    assert tokencount.token_counts(empty, path, cache).collect() == []


def test_second_call_encodes_nothing(spark, tricky, long, tmp_path, monkeypatch):
    """The cache's place comes from the session; with it warm no text is encoded, and only new texts are appended."""
    (tmp_path / "sf").mkdir()
    tricky.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    place = (tmp_path / "cache").as_uri()
    spark.conf.set(queries.TOKEN_CACHE, place)
    try:
        first = Counter(map(tuple, queries.op5_token_counts(spark, str(tmp_path / "sf")).collect()))
        cache = tokencount.TokenCache(spark, place)
        n = cache.read().count()
        assert Counter(map(tuple, queries.op5_token_counts(spark, str(tmp_path / "sf")).collect())) == first and cache.read().count() == n
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)
    for most in (tokencount.BROADCAST, 0):
        monkeypatch.setattr(tokencount, "BROADCAST", most)
        both = tricky.select("doc_id", "text").union(spark.createDataFrame([(70 + k, f"new text {most}") for k in range(5)], "doc_id long, text string"))
        got = tokencount.token_counts(both, P.path("word_bpe_49k.json"), cache)
        assert got.count() == both.count() and got.where("n_tokens = 0 AND n_bytes > 9").count() == 0
        n += 1
        assert cache.read().count() == n


def test_word_counter_forgets():
    t = tokenizer("word_bpe_49k.json")
    texts = ["It's <|startoftext|>x 12,5% Ünï İ", "don't we'll I'D " * 50, "ΑΣ 日本", "a" * 5000]
    assert tokencount.WordCounter(P.path("word_bpe_49k.json"), memo=3)([x.encode() for x in texts]) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


# 6 and 8


def test_pii(tricky, tricky_rows, empty):
    got = Counter(tuple(r) for r in pii.find_pii(tricky).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect())
    assert got == Counter((i, *plain.pii_row(t)) for i, t, _ in tricky_rows)
    assert pii.find_pii(empty).collect() == []


def test_pii_adds_spans_and_masks(spark):
    df = spark.createDataFrame([("iban GB82 WEST 1234 5698 7654 32, bad GB83 WEST 1234 5698 7654 32", 1), ("ssn 123-45-6789 and 123-45-6789", 2), ("a@b.com x 4111111111111111", 3), (None, 4)], "text string, doc_id long")
    spans = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert spans[1].startswith("iban:5:32") and spans[1].count("iban") == 1 and spans[2] == "ssn:4:15"
    out = {r.doc_id: r.m for r in df.select("doc_id", pii.masked(F.col("text")).alias("m")).collect()}
    assert out[3] == "<EMAIL> x <CARD>" and out[4] is None and out[1].startswith("iban <IBAN>, bad GB83")


def test_ibans_before_and_after_other_words(spark):
    """Numbers and capitals around an IBAN don't hide it; the code of an invoice before it neither, nor a second one after it."""
    a, b, c = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    unknown = next(f"ZZ{k:02} 1234 5678 9012 345" for k in range(2, 99) if int(f"123456789012345{3535}{k:02}") % 97 == 1)
    texts = [f"IBAN {a} BIC COBADEFFXXX", f"{b} BIC COBADEFFXXX", f"pay {a} 5 times", f"{a} {c} {b} END", f"RE12 {a} x", f"ZZ12 3456 {a} EUR 100", f"to {unknown} AND MORE", f"{a}7", f"{b}x and {a}1 {c[:-1]}3", f"日本 {c}\n{a}.", f"({a})"]
    spans = [[a], [b], [a], [a, c, b], [a], [a], [unknown], [], [], [c, a], [a]]
    rows = [(i, t) for i, t in enumerate([*texts, f"{b} AB1 " * 3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("iban")] for r in pii.find_pii(df).collect()}
    out = {r.doc_id: r.m for r in df.select("doc_id", pii.masked(F.col("text")).alias("m")).collect()}
    for i, (text, want) in enumerate(zip(texts, spans, strict=True)):
        assert [text[x:y] for x, y in got[i]] == want
        masked = text
        for x, y in reversed(got[i]):
            masked = masked[:x] + "<IBAN>" + masked[y:]
        assert out[i] == masked
    assert len(got[len(texts)]) == 3000 and out[len(texts)] == "<IBAN> AB1 " * 3000


def test_overlapping_ibans_are_masked_as_one(spark):
    from itertools import product

    check = lambda v: int("".join(str(int(x, 36)) for x in v[4:] + v[:4])) % 97 == 1
    a = "DE89 3704 0044 0532 0130 00"
    first = next(x for x in (f"AT{i}{j} {''.join(k)} {a[:9]}" for i, j, k in product("123", "0123456789", product("0123456789", repeat=8))) if check(x.replace(" ", "")))
    df = spark.createDataFrame([(1, f"x {first}{a[9:]} y AB12 3456 7890 1234 z")], "doc_id long, text string")
    spans = pii.find_pii(df).first().spans
    assert f"iban:2:{2 + len(first)}" in spans and f"iban:{2 + len(first) - 9}:{2 + len(first) - 9 + len(a)}" in spans
    assert df.select(pii.masked(F.col("text"))).first()[0] == "x <IBAN> y AB12 3456 7890 1234 z"


def test_pii_is_linear(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" * 100_000, "a@b" + ".c" * 100_000, "+1" * 100_000, "x.y@z.w " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.n_email for r in pii.find_pii(df).orderBy("doc_id").collect()] == [plain.pii_row(t)[0] if i not in (0, 1) else 0 for i, t in enumerate(texts)]


def test_native_plans(tricky):
    for df in (pii.find_pii(tricky), quality.features(quality.text_rows(tricky), {"en": ["the"]}), tricky.select(pii.masked(F.col("text")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_quality(tricky, tricky_rows, empty):
    rows = quality.quality_rules(tricky).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((i, *plain.quality_row(t)) for i, t, _ in tricky_rows)
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.quality_rules(empty).collect() == []


def test_quality_verdict(spark, tricky, tricky_rows):
    """The plain version's verdicts, over a real table and over the tricky rows."""
    settings = {k: getattr(quality, k) for k in ("MOST_SHARE", "LEAST_SHARE", "CHANCE", "MIN_CHARS", "MAX_CLASS_DISTANCE", "MIN_WORDS")}
    table = common.table(spark, "/root/testdata/sf0.001", "documents")
    other = table.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, "rare").otherwise(F.col("lang")))
    for df in (table, other, tricky):
        rows = [tuple(r) for r in df.select("doc_id", "text", "lang").collect()]
        assert quality.common_words(quality.text_rows(df)) == plain.common_words(rows, quality.N_COMMON, quality.MIN_REFERENCE)
        want = plain.kept(rows, quality.N_COMMON, quality.MIN_REFERENCE, settings)
        assert Counter((r.doc_id, r.kept) for r in quality.quality_rules(df).collect()) == Counter((i, k) for (i, *_), k in zip(rows, want, strict=True))


def test_quality_rejects_texts_without_their_languages_common_words(spark):
    rng = random.Random(6)
    often = {k: [f"{k}{c}" for c in "abcdefghijkl"] for k in ("de", "en", "es", "fi")}
    rare = {k: ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(3, 9))) for _ in range(600)] for k in often}
    text = lambda k, n, share=0.17: " ".join(rng.choice(often[k]) if rng.random() < share else rng.choice(rare[k]) for _ in range(n))
    rows = [(len(often) * i + j, text(k, rng.choice([100, 150, 400, 1500])), k) for i in range(60) for j, k in enumerate(sorted(often))]
    good = {i for i, *_ in rows} | {1000, 1001, 1002}
    rows += [(1000, text("en", 300).title(), "en"), (1001, text("de", 300), None), (1002, text("de", 120), "xx")]
    rows += [(2000 + i, text(k, n, 0), k) for i, (k, n) in enumerate((k, n) for k in often for n in (110, 300, 2000))]
    rows += [(3000, text("en", 300), "de"), (3001, text("de", 300), "fi"), (3002, text("fi", 3000), "es"), (3003, text("de", 400, 0), None), (3004, text("en", 400, 1), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {k: sorted(v) for k, v in quality.common_words(quality.text_rows(df)).items()} == often
    kept = {r.doc_id for r in quality.quality_rules(df).collect() if r.kept}
    assert kept == good
    assert abs(quality.farthest([10, 7, 83]) - spark.range(1).select(quality.js_distance(F.array(*map(F.lit, [10, 7, 83])), F.array(*map(F.lit, [0, 0, 5])))).first()[0]) < 1e-12
    assert quality.farthest([0, 5]) == 0 and 0.99 < quality.farthest([5, 0]) <= 1


def test_quality_of_a_script_without_blanks(spark):
    """A language whose words are whole sentences has no common words, but its classes are a reference."""
    rng = random.Random(11)
    letters = [chr(0x4E00 + k) for k in range(800)]
    text = lambda: "。 ".join("".join(rng.choices(letters, k=rng.randint(6, 14))) for _ in range(60))
    rows = [(i, text(), "zh") for i in range(30)] + [(100, " ".join("".join(rng.choices("0123456789+=<>^~", k=9)) for _ in range(60)), "zh")]
    rows += [(200 + i, " ".join(rng.choices(["the", "of", "and", *[f"word{k}" for k in range(50)]], k=400)), "en") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common_words = quality.common_words(quality.text_rows(df))
    assert common_words["zh"] == [] and len(common_words["en"]) == quality.N_COMMON
    out = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert not out[100].kept and out[100].class_distance > quality.MAX_CLASS_DISTANCE and out[100].word_distance == 0
    assert all(r.kept for i, r in out.items() if i != 100)
    assert quality.quality_rules(df.withColumn("lang", F.lit(None).cast("string"))).where("class_distance IS NOT NULL").count() == 0


def test_js_distance(spark):
    df = spark.sql("SELECT array(1L, 1L) AS a, array(2L, 2L) AS b, array(0L, 5L) AS c, array(7L, 0L) AS d, array(0L, 0L) AS z")
    d = lambda x, y: quality.js_distance(F.col(x), F.col(y))
    got = df.select(d("a", "b"), d("c", "d"), d("a", "c"), d("z", "a")).first()
    assert got[0] == 0 and abs(got[1] - 1) < 1e-9 and 0.5 < got[2] < 0.6 and got[3] is not None


# 7


def test_toxicity(spark, empty):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    docs, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=30)
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(30)] = rng.choice(["scumbag", "scumlord", "idiot"])
        docs.append((i, " ".join(text), "s"))
        if i % 2 == 0:
            labels.append((i, int(i % 3 > 0), int(bad)))
    docs += [(None, None, "s"), (9999, "", "s"), (0, docs[0][1], "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels + [(5000, 1, 1), (None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.flagged(df, marks).collect()
    assert len(rows) == len(docs)
    held = [(r.toxic, r.doc_id % 5 == 0) for r in rows if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in rows)
    kept = toxicity.keep_clean(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(not r.toxic for r in rows)
    assert toxicity.keep_clean(df, marks.limit(0)).count() == len(docs) and not any(r.toxic for r in toxicity.flagged(df, marks.limit(0)).collect())
    assert toxicity.flagged(empty.select("doc_id", "text"), marks).collect() == []


def test_toxicity_scores_against_a_plain_chain(spark):
    """Features, chi-square choice, folds and chain by other means, on a real table's labelled documents."""
    d = "/root/testdata/sf0.001"
    docs, labels = common.table(spark, d, "documents"), toxicity.label_categories(common.table(spark, d, "labels"))
    asked = [(r.doc_id, r.low_quality, r.toxic) for r in labels.join(docs, "doc_id", "left_semi").orderBy("doc_id").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: p for (i, _), p in zip(rows, plain.toxicity_scores(rows, asked, max_features=40), strict=True)}
    got = toxicity.score(docs, toxicity.fit(docs, labels, toxicity.CATEGORIES, max_features=40)).collect()
    assert len(got) == len(rows) and all(abs(r.p_low_quality - want[r.doc_id][0]) < 1e-3 and abs(r.p_toxic - want[r.doc_id][1]) < 1e-3 for r in got)


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    first = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    ys = np.column_stack([first, ((first > 0) ^ (rng.random(300) < 0.1)).astype(float)])
    weights, shares = toxicity.fit_chain(x, ys, np.arange(300) % 5)
    assert len(weights[0]) == 4 and len(weights[1]) == 5 and abs(shares[0] - first.mean()) < 1e-9
    assert abs(weights[1][3]) > 0.1


# 9


def test_pack(tricky, tricky_rows, empty):
    t = tokenizer("byte_bpe_50k.json")
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = packing.pack(tricky, *args, group_docs=16).collect()
    want = Counter()
    for i, text, _ in tricky_rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            want[i, at, len(ids[at : at + 1024]), zlib.crc32(np.array(ids[at : at + 1024], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(empty, *args).collect() == []


def test_first_fit_decreasing():
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    sequence, offset = packing.first_fit_decreasing(np.array(lengths), 100)
    room, want = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        want[i] = (k, 100 - room[k])
        room[k] -= lengths[i]
    assert all((sequence[i], offset[i]) == want[i] for i in range(300))


# 10


def test_language_id(spark, tricky, tricky_rows, empty):
    rng = random.Random(1)
    syllables = {"en": ["the", "ing", "and", "tion"], "de": ["der", "ung", "sch", "ein"], "fr": ["eau", "que", "les", "oir"]}
    rows = [(i, " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(20)), lang) for i, (lang, s) in enumerate(list(syllables.items()) * 60)]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "en"), (1002, "the", None), (None, "ing and the", "en"), (1003, "Q" * 5000, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    got = {r.doc_id: r for r in langid.language_id(df, P.path("piece_bpe_32k.model")).collect()}
    held = [i for i, _, _ in rows[:180] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i, _, _ in rows[:180])
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0 and got[1002].lang_pred == "en"
    assert len(langid.language_id(tricky, P.path("piece_bpe_32k.model")).collect()) == len(tricky_rows)
    assert langid.language_id(empty, P.path("piece_bpe_32k.model")).collect() == []


def test_forward_sums_all_segmentations():
    pieces = ["", "▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    s = langid.Segmenter(pieces, ["x", "y"], np.arange(16, dtype=float).reshape(8, 2))

    def total(word, k):
        if not word:
            return 1.0
        out = sum(s.prob[i, k] * total(word[len(p) :], k) for i, p in enumerate(pieces) if p and word.startswith(p))
        return out + (langid.FLOOR * total(word[1:], k) if word[0] not in pieces else 0.0)

    words = ["abab", "ba", "aqb", "b"]
    got = s.log_probs(words)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [np.log(total("▁" + w, k)) for k in (0, 1)])


def forward(s, word, k, pieces):
    """Log of the sum over all segmentations, in exact fractions."""
    prob = [Fraction(float(p)) for p in s.prob[:, k]]
    sums = [Fraction(1)]
    for j in range(1, len(word) + 1):
        x = sum((sums[j - len(p)] * prob[i] for i, p in enumerate(pieces) if p and j >= len(p) and word[j - len(p) : j] == p), Fraction(0))
        sums.append(x + (sums[j - 1] * Fraction(langid.FLOOR) if word[j - 1] not in pieces else 0))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_long_words_are_summed_whole():
    """Words of any length, with pieces far less likely than doubles could hold as a product."""
    pieces = ["", "▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    rng = random.Random(3)
    for counts in (np.arange(16, dtype=float).reshape(8, 2), np.array([[0.0, 0.0]] * 7 + [[1e14, 1e15]])):
        s = langid.Segmenter(pieces, ["x", "y"], counts)
        for n in (30, 31, 32, 33, 60, 200):
            w = "".join(rng.choices("abq", weights=[6, 6, 1], k=n))
            assert np.allclose(s.log_probs([w])[0], [forward(s, "▁" + w, k, pieces) for k in (0, 1)])
            assert np.allclose(s._alone("▁" + w), s._together(["▁" + w], n + 1)[0])
    assert np.isfinite(s.of_texts(["ab " * 10, "", "q" * 5000, "a"])).all() and np.allclose(s.of_texts(["ab ba"]), s.of_texts(["ab"]) + s.of_texts(["ba"]))


def test_letters_and_normal_forms(spark):
    """Numerals and marks alone are no letters; full-width and composed forms are one for learning and scoring."""
    none = ["½ ² ①", "Ⅷ", "٣", "\u0301", "_1", "!?", "", None]
    some = ["ª", "ʰ", "中", "ไ", "ß", "\u01c5"]
    rows = [(3 * i, t, "en") for i, t in enumerate(none + some)]
    rows += [(1000 + i, "the thing and that", "en") for i in range(40)] + [(2000 + i, "der schein und einung", "de") for i in range(40)]
    rows += [(5000, "ＴＨＥ ｔｈｉｎｇ ＡＮＤ ｔｈａｔ", None), (5001, "DER SCHEIN UND EINUNG", None)]
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), P.path("piece_bpe_32k.model")).collect()}
    assert [got[3 * i].lang_pred == "und" for i in range(len(none + some))] == [True] * len(none) + [False] * len(some)
    assert all(got[3 * i].score == 0 for i in range(len(none))) and got[5000].lang_pred == "en" and got[5001].lang_pred == "de"
    assert langid.word_list("Hé\u0301lo ＷＩＤＥ x²y हिन्दी") == ["hé\u0301lo", "wide", "x", "y", "हिन्दी"]


# Very long texts


def test_long_texts(spark, long, long_rows):
    """Every operator on texts of a megabyte, against plain versions where these are quick enough."""
    licence = {r.doc_id: r for r in licenses.license_scan(long).collect()}
    assert all(licence[i].n_words == len(re.findall("[a-z0-9]+", t)) for i, t, _ in long_rows)
    item = long_rows[0][1][600_000:600_300]
    bench = spark.createDataFrame([(1, item), (2, "same line"), (3, "nowhere " * 30)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(long, bench).collect()} == {(1, 1), (5, 1), (6, 1), (4, 2)}
    assert {r.doc_id for r in decontaminate.keep_clean(long, bench).collect()} == {2, 3}
    copies = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_copies(long).collect()}
    assert copies == {i: (len(plain.shingles(t)), {5: 1, 6: 1}.get(i, i)) for i, t, _ in long_rows}
    assert {r.doc_id for r in jaccard.one_of_each(long).collect()} == {1, 2, 3, 4}
    counts = {r.doc_id: r.n_tokens for r in tokencount.token_counts(long, P.path("word_bpe_49k.json"), tokencount.TokenCache(spark, common.shared_dir(spark, "t"))).collect()}
    t = tokenizer("word_bpe_49k.json")
    assert counts == {i: sum(len(t.encode(w, add_special_tokens=False).ids) for w in x.split()) for i, x, _ in long_rows if i != 1 and i < 5} | {i: sum(n * len(t.encode(w, add_special_tokens=False).ids) for w, n in Counter(x.split()).items()) for i, x, _ in long_rows if i in (1, 5, 6)}
    assert {r.doc_id: r.n_card for r in pii.find_pii(long).collect()} == {i: t.count("4111") for i, t, _ in long_rows}
    assert all(not (m := r.m) or "4111" not in m for r in long.select(pii.masked(F.col("text")).alias("m")).collect())
    scored = toxicity.flagged(long, spark.createDataFrame([(1, 1, 0), (4, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(scored) == len(long_rows)
    rows = {r.doc_id: (r.n_words, r.n_repeat_words, r.n_dup_lines) for r in quality.quality_rules(long).collect()}
    assert rows == {i: (q[0], q[4], q[3]) for i, t, _ in long_rows for q in [plain.quality_row(t)]}
    packed = packing.pack(long, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sizes = {r.doc_id: (r.n, r.m) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()}
    assert all(a == b for a, b in sizes.values()) and len(sizes) == len(long_rows)
    assert len(langid.language_id(long, P.path("piece_bpe_32k.model")).collect()) == len(long_rows)


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    first = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in c.STAGES[:-1]:
        new = common.written(stage(spark, docs, d), f"test-{name}")
        assert new.schema.simpleString() == docs.schema.simpleString()
        docs = new
    rows = docs.collect()
    assert {r.doc_id for r in rows} <= first and len(rows) > 0.5 * len(first)
    assert plain.groups([(r.doc_id, r.text) for r in rows]) == [r.doc_id for r in rows]
    assert not any(sum(plain.pii_row(r.text)[:4]) for r in rows)
    items = [r.text for r in common.table(spark, d, "benchmark").collect()]
    assert not any(x in r.text for r in rows for x in items)
    packed = c.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
