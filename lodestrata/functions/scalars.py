"""Scalar functions of the data path, as Columns where Spark has the parts; per-row Python only for recursive JSON and normal forms."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A token's longest length, and how many tokens of a query count.
TOKEN_CHARS, QUERY_TOKENS = 32, 16
#: A token, of which the first group keeps what counts.
TOKEN = rf"([\p{{L}}\p{{N}}]{{1,{TOKEN_CHARS}}})[\p{{L}}\p{{N}}]*"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC for corpora that aren't normalised yet; skip it where they are. Only texts with signs beyond ASCII, which alone can change, go to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, cut to TOKEN_CHARS; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def query_tokens(text: str) -> list[str]:
    """The same rule for a query on the driver, first QUERY_TOKENS tokens."""
    folded = unicodedata.normalize("NFKC", text).lower()
    return [t[:TOKEN_CHARS] for t in re.findall(r"[^\W_]+", folded)][:QUERY_TOKENS]


def slug(text: Column, size: int = 48) -> Column:
    """Lower-case letters and digits joined by single hyphens, none at the ends, then cut."""
    hyphened = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(hyphened, "^-+|-+$", ""), 1, size)


def sha256_base64(data: Column) -> Column:
    return F.base64(F.unhex(F.sha2(data.cast("binary"), 256)))


def value_key(value: Column) -> Column:
    """A canonical text of a value, for buckets; null has one too."""
    return F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})


def scope_key(table: str, arguments: Column) -> Column:
    """Table and key-sorted JSON of a string map; the table alone without arguments."""
    listed = F.map_from_entries(F.array_sort(F.map_entries(arguments)))
    return F.when(F.coalesce(F.size(arguments), F.lit(0)) == 0, F.lit(table)).otherwise(F.concat_ws("::", F.lit(table), F.to_json(listed)))


def identity_key(token_identifier: Column, subject: Column) -> Column:
    return F.coalesce(token_identifier, subject)


def lease_until(now_ms: Column, lease_ms: int = 30_000) -> Column:
    return now_ms + F.lit(lease_ms)


# Rich text trees: {"type", "content", "text"}

# Nodes that end a line.
BLOCKS = ("paragraph", "heading", "blockquote", "codeBlock", "listItem", "bulletList", "orderedList", "taskItem")


def plain_text(tree: object) -> str:
    """Text of a rich-text tree: blocks end lines, hard breaks are lines, no more than one empty line in a row."""
    out: list[str] = []

    def walk(node: object) -> None:
        if not isinstance(node, dict):
            return
        if node.get("type") == "hardBreak":
            out.append("\n")
        out.append(node.get("text") or "")
        for child in node.get("content") or ():
            walk(child)
        if node.get("type") in BLOCKS:
            out.append("\n")

    walk(tree)
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


@F.pandas_udf(StringType())
def prose_text(trees: pd.Series) -> pd.Series:
    """plain_text of JSON trees; null for null and for what isn't JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else plain_text(json.loads(x))
        except ValueError:
            return None

    return trees.map(one)


def prose_document(text: Column) -> Column:
    """A rich-text tree of a plain string: one paragraph, or an empty document for blank text; a tree stays as it is."""
    quoted = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    paragraph = F.concat(F.lit('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":'), quoted, F.lit("}]}]}"))
    return F.when(F.get_json_object(text, "$.type") == "doc", text).when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit('{"type":"doc","content":[]}')).otherwise(paragraph)


# Seeded randomness


def mulberry32(seed: int) -> Iterator[float]:
    """The public-domain 32-bit generator of that name: numbers from 0 to 1."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield (t ^ (t >> 14)) / 4294967296


def seeded_uuid(seed: int) -> str:
    numbers = mulberry32(seed)
    data = bytearray(int(next(numbers) * 256) for _ in range(16))
    data[6], data[8] = data[6] & 0x0F | 0x40, data[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(data)))


def _product32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, by halves, as whole products overflow a long."""
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (a.bitwiseAND(F.lit(0xFFFF)) * b + F.shiftleft(high, 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def uuid_of(seed: Column) -> Column:
    """seeded_uuid as a Column: its states are an arithmetic series, so each of the 16 numbers is worked out by itself. Null for null."""
    low = F.lit(0xFFFFFFFF)

    def first(s: Column) -> Column:
        return _product32(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1)))

    def second(t: Column) -> Column:
        mixed = _product32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))
        return t.bitwiseXOR((t + mixed).bitwiseAND(low))

    def two_digits(u: Column) -> Column:
        return F.lpad(F.hex(F.shiftrightunsigned(u.bitwiseXOR(F.shiftrightunsigned(u, 14)), 24)), 2, "0")

    start = seed.cast("long").bitwiseAND(low)
    states = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: (start + k * F.lit(0x6D2B79F5).cast("long")).bitwiseAND(low))
    digits = F.lower(F.array_join(F.transform(F.transform(F.transform(states, first), second), two_digits), ""))
    variant = F.translate(F.substring(digits, 17, 1), "0123456789abcdef", "89ab" * 4)
    parts = F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.concat(F.lit("4"), F.substring(digits, 14, 3)), F.concat(variant, F.substring(digits, 18, 3)), F.substring(digits, 21, 12)
    return F.when(seed.isNotNull(), F.concat_ws("-", *parts))
