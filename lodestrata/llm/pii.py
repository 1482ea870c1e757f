"""Personal data, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for card numbers,
mod 97 for IBANs, parts of IP addresses, digit counts), and words shortly before a
span raise its score; spans of the kinds the base doesn't know count from ``MIN_SCORE`` up.

The patterns are the base's, written with possessive repeats and a look at the
character before, which find the same leftmost spans in linear time and without deep
recursion. A span's place follows from the lengths of the pieces between matches.
An IBAN is proposed by its first four signs alone and ends where a group ends: after as
many signs as its country has, for unknown countries at the last place that passes
mod 97. So what follows it in capitals or digits doesn't matter, and proposals may
overlap; overlapping IBANs are reported each and masked as one.
Places are code points, the end is exclusive. Null texts are empty and have no spans.
Each row is handled where it lies; nothing is shuffled, doc_id may repeat or be null.
Very long texts are read whole, other columns are ignored by ``find_pii``, and an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import narrowed
from lodestrata.llm.native import Body, let, sums_before, total

MIN_SCORE = 0.5
#: Code points before a span in which context words count.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    must: str = ""  # a cheap test: no match without this substring
    head: int = 0  # only so many code points of the pattern's first group, the proposal, are taken out of the text


_LOCAL = "A-Za-z0-9._%+-"
BASE = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write|reach", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address", "."),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13,}+", 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile", "+"),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,31}[a-z]?))[A-Z]{2}[0-9]{2}", 0.7, "iban|account|bank", head=4),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security|tax"),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])", 0.3, "token|secret|key|password|passwd"),
)
#: Signs of an IBAN by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: An IBAN has at most 67 code points with its blanks, and starts at least 5 after another: so many before it may reach it.
REACH = 14


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: (v - F.when(v > 9, 9).otherwise(0)).cast("long")))
    return total(doubled) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 on division by 97."""
    turned = F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda v: (F.length(v) <= 3) & (F.substr(v, F.lit(1), F.lit(3)).cast("int") <= 255))
        return F.forall(F.split(x, r"\."), small)
    if kind == "card":
        return let(_digits(x), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def iban_length(proposal: Column) -> Column:
    """Code points of the longest IBAN at the start of a proposal that ends where one of its groups ends, 0 without any."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    want = F.try_element_at(lengths, F.left(proposal, F.lit(2)))

    def valid(p: Column) -> Column:
        return let(F.replace(p, F.lit(" "), F.lit("")), lambda v: F.when(F.length(v).between(15, 34) & (F.length(v) == F.coalesce(want, F.length(v))) & ~v.rlike("[^A-Z0-9]"), mod97(v)).otherwise(False))

    starts = lambda groups: F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.array_join(F.slice(groups, 1, k), " "))
    ibans = F.filter(let(F.split(proposal, " ", -1), starts), valid)
    return F.coalesce(F.array_max(F.transform(ibans, lambda p: F.length(p))), F.lit(0))


def confirmed(kind: Kind, x: Column) -> Column:
    """Code points of the span that a proposal holds from its start, 0 for none."""
    return iban_length(x) if kind.name == "iban" else F.when(_valid(kind.name, x), F.length(x)).otherwise(0)


def taken(kind: Kind, x: Column) -> Column:
    """Code points of a proposal that are missing between the pieces around it."""
    return F.lit(kind.head) if kind.head else F.length(x)


def proposals(text: Column, kind: Kind) -> tuple[Column, Column]:
    """The matches of a kind and the pieces around them."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if kind.head else 0))
    if kind.must:
        found = F.when(F.contains(text, F.lit(kind.must)), found).otherwise(none)
    return found, F.split(text, kind.pattern, -1)


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, end, kind, score) of a kind's confirmed spans."""
    shape = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"
    found, pieces = proposals(text, kind)

    def placed(matches: Column) -> Column:
        def build(gaps: Column) -> Column:
            def row(m: Column, i: Column, starts: Column) -> Column:
                near = F.lower(F.right(F.get(gaps, i), F.lit(CONTEXT)))
                score = F.lit(kind.score) + F.when(near.rlike(rf"(?:{kind.context})"), 0.3).otherwise(0.0)
                size = confirmed(kind, m)
                return let(size, lambda n: F.struct(F.get(starts, i).alias("start"), F.lit(rank).alias("rank"), (F.get(starts, i) + n).alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"), (n > 0).alias("ok")))

            steps = F.transform(matches, lambda m, i: (F.length(F.get(gaps, i)) + taken(kind, m)).cast("long"))
            before = let(sums_before(steps), lambda b: F.transform(b, lambda s, i: s + F.length(F.get(gaps, i))))
            rows = let(before, lambda starts: F.transform(matches, lambda m, i: row(m, i, starts)))
            kept = F.filter(rows, lambda r: r["ok"] & (r["score"] >= MIN_SCORE))
            return F.transform(kept, lambda r: F.struct(r["start"], r["rank"], r["end"], r["kind"], r["score"]))

        return F.when(F.size(matches) > 0, let(pieces, build)).otherwise(F.array().cast(shape))

    return let(found, placed).cast(shape)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score: a row per document."""
    rows = narrowed(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("doc_id", *[spans_of(F.col("text"), k, i).alias(f"s_{k.name}") for i, k in enumerate((*BASE, *ADDED))])
    base = F.concat(*[f"s_{k.name}" for k in BASE])
    every = F.concat(*[f"s_{k.name}" for k in (*BASE, *ADDED)])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(f"s_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.coalesce(F.array_max(F.transform(every, lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def masked_heads(text: Column, kind: Kind) -> Column:
    """The text with the spans of a kind that is proposed by its head; overlapping ones are masked as one."""
    found, pieces = proposals(text, kind)

    def mend(matches: Column) -> Column:
        def build(gaps: Column) -> Column:
            def cut(starts: Column, ends: Column) -> Column:
                # how far the spans before the i-th proposal reach
                reached = lambda i: F.coalesce(F.array_max(F.slice(ends, F.greatest(F.lit(1), i - REACH + 1), F.least(i, F.lit(REACH)))), F.lit(0).cast("long"))
                rest = lambda gap, at, reach: F.substr(gap, F.greatest(F.lit(1), reach - at + 1).cast("int"))

                def shown(m: Column, i: Column) -> Column:
                    head = lambda reach: F.when(reach > F.get(starts, i) + F.length(F.get(gaps, i)), "").when(F.get(ends, i) > 0, f"<{kind.name.upper()}>").otherwise(F.left(m, F.lit(kind.head)))
                    return let(reached(i), lambda reach: F.concat(rest(F.get(gaps, i), F.get(starts, i), reach), head(reach)))

                last = F.element_at(starts, -1) + F.length(F.element_at(gaps, -2)) + kind.head
                return F.concat(F.array_join(F.transform(matches, shown), ""), rest(F.element_at(gaps, -1), last, reached(F.size(matches))))

            steps = F.transform(matches, lambda m, i: (F.length(F.get(gaps, i)) + kind.head).cast("long"))
            end = lambda starts, m, i: let(confirmed(kind, m), lambda n: F.when(n > 0, F.get(starts, i) + F.length(F.get(gaps, i)) + n).otherwise(F.lit(0).cast("long")))
            # starts of the pieces, and ends of the confirmed spans
            return let(sums_before(steps), lambda starts: let(F.transform(matches, lambda m, i: end(starts, m, i)), lambda ends: cut(starts, ends)))

        return F.when(F.size(matches) > 0, let(pieces, build)).otherwise(text)

    return let(found, mend)


def masked(text: Column) -> Column:
    """The text with each confirmed span as its kind in angle brackets; kinds are masked one after another, null stays null."""

    def masker(kind: Kind) -> Body:
        if kind.head:
            return lambda text: masked_heads(text, kind)

        def replaced(text: Column) -> Column:
            found, pieces = proposals(text, kind)

            def mend(matches: Column) -> Column:
                def build(gaps: Column) -> Column:
                    def shown(m: Column, i: Column) -> Column:
                        near = F.lower(F.right(F.get(gaps, i), F.lit(CONTEXT)))
                        enough = F.lit(kind.score >= MIN_SCORE) | near.rlike(rf"(?:{kind.context})")
                        return F.concat(F.get(gaps, i), F.when(_valid(kind.name, m) & enough, F.lit(f"<{kind.name.upper()}>")).otherwise(m))

                    return F.concat(F.array_join(F.transform(matches, shown), ""), F.element_at(gaps, -1))

                return F.when(F.size(matches) > 0, let(pieces, build)).otherwise(text)

            return let(found, mend)

        return replaced

    out = text
    for kind in (BASE[0], ADDED[0], BASE[2], BASE[3], BASE[1], *ADDED[1:]):
        out = let(out, masker(kind))
    return F.when(text.isNotNull(), out)
