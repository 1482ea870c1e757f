import random

import pytest

TRICKY = [
    None, "", "   \n\t ", "a", "one two three four", "ONE two\nthree FOUR", "x " * 3000, "word" * 4000,
    "Mail jo.doe@mail.example.com or x@y, call +1 (017) 555-7713. card 4111 1111 1111 1111, ip 10.0.0.255 and 10.0.0.256, 1.2.3.4.5.6.7.8",
    "a@b.com_c@d.org..e@f.g IBAN GB82 WEST 1234 5698 7654 32 token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff ssn 123-45-6789 12345678901234567890",
    "Released under the MIT License. Licensed under CC BY-NC 4.0. cc by cc by Apache license", "LICENSED under the apache license, version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "日本語 テキスト ünï ½ ② <|endoftext|> it's DON'T", "​ zero \x00 nul \x1f sep", "the and of to in " * 40, "\n".join(["same line of words here"] * 30),
]


@pytest.fixture(scope="session")
def tricky_rows():
    """Nulls, empty and long texts, repeats, ties, null and repeated ids, near copies."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=n)) for n in (8, 12, 20, 40, 60, 150) for _ in range(6)]
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(TRICKY + base)]
    for t in base:
        for _ in range(4):
            words = t.split()
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(words).upper() if rng.random() < 0.3 else " ".join(words), "en"))
    rows += [(3, "a", "en"), (3, "a", "en"), (None, base[0], "de"), (None, None, None)]
    return rows


#: Names that operators use for columns of their own.
CLASHING = "source n score digest norm bucket kind run local text_hash set_id data key grp part arrival kept_id kept_hash _kept_id _kept_hash _arrival held_out toxic langs classes w near item words known root".split()
SHAPE = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture
def tricky(spark, tricky_rows):
    """The rows with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, *["s"] * len(CLASHING)) for r in tricky_rows], SHAPE).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def long_rows():
    """Texts of a megabyte and more: ordinary words, one word, blanks, repeated lines; and copies of the first."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=200_000))
    return [(1, text, "en"), (2, "x" * 1_000_000, "en"), (3, " \n" * 500_000, "en"), (4, "the same line, 4111 1111 1111 1111\n" * 30_000, "en"), (5, text, "de"), (6, text[:-3000] + " other end", None)]


@pytest.fixture
def long(spark, long_rows):
    return spark.createDataFrame(long_rows, "doc_id long, text string, lang string").repartition(2)
