"""Quality rules by distribution divergence, in DataFrame functions only.

Each document has two histograms: character classes (small letters, capitals, digits,
white space, punctuation, symbols, other) and the most common words of its language
plus a rest. They are compared with its language's reference, the sum over all
documents of that language, by Jensen-Shannon distance (square root of the divergence
in bits, 0 to 1). A language has a class reference where its documents hold ``MIN_REFERENCE`` code points
or more, whatever its script. Its common words are the ``N_COMMON`` words that stand in
most of its documents and in a share of ``LEAST_DOCUMENTS`` at least (ties go by the
word), learned from all of them; a language that doesn't put blanks between words
has none, and is held by its classes alone. A distance counts only for
texts of a minimum length, as short texts stray by chance. Words are compared in small
letters and without punctuation around them; their limit is a share of the distance
that a text without any of the common words has from that reference, so it can be
reached, and falls with the text's length, as chance moves the distance by about
1 / sqrt(words). A document whose language is null is held against every reference and
the nearest, by the sum of its distances, decides; one whose language is too rare for a reference isn't rejected for
its distances, and without any reference no document is.

Words are counted for each language with a partial aggregation before the shuffle; the
features are computed once, inside each row, and written to the shared folder; only
``N_COMMON`` words and a row of sums for each language reach the driver. Null texts have no
words, so they fail the base rule; very long texts are read whole; repeated rows count
as often as they stand; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import narrowed, written
from lodestrata.llm.native import let, total

#: Common words of a language, and the code points that its documents must hold for a reference.
N_COMMON, MIN_REFERENCE = 12, 5_000
#: Share of a language's documents that a common word stands in, and the number of documents, at least.
LEAST_DOCUMENTS, LEAST_COUNT = 0.2, 3
CLASSES = 7
WHITE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Distances above these reject, for texts of at least so many code points or words.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.30, 400
MIN_WORDS = 100
#: Limit of the word distance as a share of the distance of a text without common words: LEAST_SHARE + CHANCE / sqrt(words), MOST_SHARE at most.
MOST_SHARE, LEAST_SHARE, CHANCE = 0.90, 0.40, 5.0
AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Between two words without the punctuation around them.
GAP = r"[\p{Punct}]*+[\x20\x09-\x0D][\p{Punct}\x20\x09-\x0D]*+"


def words(text: Column) -> Column:
    """Words between the six ASCII white-space characters."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN, -1)))


def repeated_window_words(w: Column, size: int = 3) -> Column:
    """How many words stand in a window of ``size`` words that the text has twice or more."""
    keys = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        same = lambda s, j, x: F.coalesce(F.get(s, j)["t"] == x["t"], F.lit(False))
        at = let(placed, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, j - 1, x) | same(s, j + 1, x)), lambda x: x["i"])))
        gained = let(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))).cast("long")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(total(gained))

    return F.when(F.size(w) <= size, F.lit(0).cast("long")).otherwise(let(keys, covered))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def class_histogram(text: Column) -> Column:
    """Counts of CLASSES classes of characters, by taking one class after another out of what is left."""
    out, left = [], text
    patterns = (r"[\p{Ll}\p{Lo}\p{Lm}]+", SPACE_RUN, r"[\p{Lu}\p{Lt}]+", r"[.,;:!?'\x22()\-]+", r"\p{Nd}+", r"[\p{S}\p{P}]+")

    def step(left: Column, rest: tuple, sizes: list[Column]) -> Column:
        if not rest:
            return F.array(*sizes, F.length(left).cast("long"))
        return let(F.regexp_replace(left, rest[0], ""), lambda y: step(y, rest[1:], [*sizes, (F.length(left) - F.length(y)).cast("long")]))

    return let(left, lambda t: step(t, patterns, out))


def bare_words(text: Column) -> Column:
    """The words in small letters, without punctuation around them; those of nothing else are left out."""
    return F.array_remove(F.split(F.lower(F.btrim(text, F.lit(WHITE + AROUND))), GAP, -1), "")


def word_histogram(bare: Column, n_words: Column, listed: Column) -> Column:
    """Counts of the listed words, and of all others."""
    found = F.transform(listed, lambda k: (F.size(bare) - F.size(F.array_remove(bare, k))).cast("long"))
    return let(found, lambda h: F.concat(h, F.array(n_words - total(h))))


def _shares(h: Column) -> Column:
    return let(total(h), lambda n: F.transform(h, lambda x: x / F.greatest(n, F.lit(1))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two histograms of counts."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(_shares(p), _shares(q), lambda a, b: let((a + b) / 2, lambda m: (part(a, m) + part(b, m)) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def text_rows(docs: DataFrame) -> DataFrame:
    rows = narrowed(docs, "doc_id", "text", "lang")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))


def common_words(rows: DataFrame) -> dict[str, list[str]]:
    """The common words of each language that has a reference; none for a language without any."""
    sizes = rows.where("lang IS NOT NULL").groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("n"), F.count(F.lit(1)).alias("docs")).where(F.col("n") >= MIN_REFERENCE).collect()
    out: dict[str, list[str]] = {r["lang"]: [] for r in sorted(sizes, key=lambda r: r["lang"])}
    if not out:
        return out
    least = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(LEAST_COUNT, LEAST_DOCUMENTS * r["docs"]))])
    found = rows.where(F.col("lang").isin(list(out))).select("lang", F.explode(F.array_distinct(bare_words(F.col("text")))).alias("word"))
    counts = found.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.element_at(least, F.col("lang")))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= N_COMMON)
    for r in ranked.orderBy("lang", "r").collect():
        out[r["lang"]].append(r["word"])
    return out


def _by_lang(values: dict[str, Column], kind: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]) if values else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))


def features(rows: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang, base counts and histograms of every row; word histograms for all references where the row's language is null."""
    langs = F.when(F.col("lang").isNull(), F.array(*map(F.lit, sorted(common))).cast("array<string>")).when(F.col("lang").isin(list(common)), F.array("lang")).otherwise(F.array().cast("array<string>"))
    lists = _by_lang({k: F.array(*map(F.lit, v)) for k, v in common.items()}, "array<string>")

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))

    wide = rows.select(
        "doc_id", "lang", "text", langs.alias("langs"), F.length("text").cast("long").alias("n_chars"),
        let(words(F.col("text")), counted).alias("w"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        class_histogram(F.col("text")).alias("classes"),
    )
    of = lambda bare: F.transform("langs", lambda k: let(F.element_at(lists, k), lambda listed: word_histogram(bare, F.col("w.n_words"), listed)))
    hists = let(bare_words(F.col("text")), of).alias("word_hists")
    inside = (F.col("n_chars") - F.get("classes", F.lit(1))).alias("word_chars")  # all but white space
    return wide.select("doc_id", "lang", "langs", "n_chars", "w.*", hists, inside, "n_symbols", "n_dup_lines", "classes")


def references(feats: DataFrame, common: dict[str, list[str]]) -> dict[str, tuple[list[int], list[int]]]:
    """Class and word counts over all documents of each language that has a reference; a row for each."""
    if not common:
        return {}
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(CLASSES)] + [F.sum(F.get(F.get("word_hists", F.lit(0)), F.lit(i))).alias(f"w{i}") for i in range(N_COMMON + 1)]
    rows = feats.where(F.col("lang").isin(list(common))).groupBy("lang").agg(*sums).collect()
    return {r["lang"]: ([r[f"c{i}"] for i in range(CLASSES)], [r[f"w{i}"] for i in range(len(common[r["lang"]]) + 1)]) for r in rows}


def farthest(counts: list[int]) -> float:
    """Distance of a text without any listed word from a reference's counts of the listed words and the rest."""
    listed, rest = sum(counts[:-1]), counts[-1]
    if not listed:
        return 0.0
    q = rest / (listed + rest)
    return math.sqrt((-math.log2((1 + q) / 2) + (q * math.log2(2 * q / (1 + q)) if q else 0.0) + 1 - q) / 2)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    base_failed: under 50 words, or more than half of the words in repeated windows.
    kept: not base_failed, and neither distance above its limit where its guard holds.
    """
    rows = text_rows(docs)
    common = common_words(rows)
    feats = written(features(rows, common), "quality")
    refs = references(feats, common)
    n, base = F.col("n_words"), (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    if refs:
        longs = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
        classes, listed = (F.create_map(*[x for k, v in refs.items() for x in (F.lit(k), longs(v[i]))]) for i in (0, 1))
        most = F.create_map(*[F.lit(x) for k, v in refs.items() for x in (k, farthest(v[1]))])
        both = F.transform("langs", lambda k, i: F.struct(js_distance(F.col("classes"), F.element_at(classes, k)).alias("c"), js_distance(F.get("word_hists", i), F.element_at(listed, k)).alias("d"), F.element_at(most, k).alias("f")))
        known = F.filter(both, lambda x: x["c"].isNotNull())
        near = F.get(F.array_sort(F.transform(known, lambda x: F.struct((x["c"] + x["d"]).alias("s"), x["c"].alias("c"), x["d"].alias("d"), x["f"].alias("f")))), F.lit(0))
    else:
        near = F.lit(None).cast("struct<s:double,c:double,d:double,f:double>")
    feats = feats.withColumn("near", near)
    limit = F.col("near.f") * F.least(F.lit(MOST_SHARE), LEAST_SHARE + CHANCE / F.sqrt(n))
    far = ((F.col("n_chars") >= MIN_CHARS) & (F.col("near.c") > MAX_CLASS_DISTANCE)) | ((n >= MIN_WORDS) & (F.col("near.d") > limit))
    return feats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~F.coalesce(far, F.lit(False))).alias("kept"), F.col("near.c").alias("class_distance"), F.col("near.d").alias("word_distance"),
    )
