"""Keyset pages: a cursor holds the order key of a page's last row, so a page costs a bounded scan however far it is.

The keyset condition is written out (k1 >= c1 AND (k1 > c1 OR (k2 > c2 ...))), since a
comparison of structs pushes nothing to the scan.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.expr import path_column
from lodestrata.operators.windows import numbered_all
from lodestrata.plans.query import Query

# A cursor's prefix, and the cursor that ends the last page.
PREFIX, END = "ck1:", "_end_cursor"


def _plain(value: object) -> object:
    if isinstance(value, (datetime.datetime, datetime.date)):
        return {"$at": value.isoformat()}
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return {"$number": repr(value)}
    return value


def _typed(value: object) -> object:
    if isinstance(value, dict) and "$at" in value:
        return datetime.datetime.fromisoformat(value["$at"])
    if isinstance(value, dict) and "$number" in value:
        return float(value["$number"])
    return value


def encode_cursor(key: list[object]) -> str:
    return PREFIX + json.dumps([_plain(x) for x in key])


def decode_cursor(cursor: str | None, width: int) -> list[object] | None:
    """The order key, or None for anything else, which starts from the beginning."""
    if not cursor or not cursor.startswith(PREFIX):
        return None
    try:
        key = json.loads(cursor[len(PREFIX) :])
    except ValueError:
        return None
    return [_typed(x) for x in key] if isinstance(key, list) and len(key) == width else None


def _beyond(c: Column, value: object, descending: bool) -> Column:
    """c comes after value in the order; null is least."""
    if descending:
        return F.lit(False) if value is None else (c < F.lit(value)) | c.isNull()
    return c.isNotNull() if value is None else c > F.lit(value)


def after(fields: tuple[str, ...], key: list[object], descending: bool = False) -> Column:
    """Rows that come after the key; the first field's plain bound stands in front, for the scan."""
    condition = F.lit(False)
    for f, value in reversed(list(zip(fields, key, strict=True))):
        c = path_column(f)
        condition = _beyond(c, value, descending) | (c.eqNullSafe(F.lit(value)) & condition)
    c, value = path_column(fields[0]), key[0]
    if value is None:
        return condition
    return ((c <= F.lit(value)) | c.isNull() if descending else c >= F.lit(value)) & condition


def up_to(fields: tuple[str, ...], key: list[object], descending: bool = False) -> Column:
    return ~F.coalesce(after(fields, key, descending), F.lit(False))


def seek(df: DataFrame, field: str, value: object, inclusive: bool = True, descending: bool = False) -> DataFrame:
    """A scan that resumes at a value of one field."""
    c = path_column(field)
    bound = {(False, True): c >= F.lit(value), (False, False): c > F.lit(value), (True, True): c <= F.lit(value), (True, False): c < F.lit(value)}
    return df.where(bound[descending, inclusive])


@dataclass(frozen=True)
class Page:
    page: list[Row]
    is_done: bool
    continue_cursor: str
    split_cursor: str | None = None
    status: str | None = None


def page_plan(query: Query, cursor: str | None = None, end_cursor: str | None = None) -> DataFrame:
    """The rows after the cursor and, where the page's end is pinned, up to that end, in order."""
    rows, fields = query.matching(), query.order_key
    if key := decode_cursor(cursor, len(fields)):
        rows = rows.where(after(fields, key, query.descending))
    if key := decode_cursor(end_cursor, len(fields)):
        rows = rows.where(up_to(fields, key, query.descending))
    return rows.orderBy(*query.sort())


#: Rows that a pinned page may bring to the driver.
PINNED_ROWS = 16_384


def split_index(n: int) -> int:
    """The middle row of a page, which ends its first half."""
    return (n - 1) // 2


def split_status(n: int, size: int) -> str | None:
    """Pages of over four times the asked size must be split, over twice should be."""
    return "SplitRequired" if n > 4 * size else "SplitRecommended" if n > 2 * size else None


def byte_size(df: DataFrame) -> Column:
    """A row's size: UTF-8 bytes of its JSON."""
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))


def within_bytes(rows: list[tuple[Row, int]], most: int) -> list[Row]:
    """The longest start of a page within the budget, and the row that crosses it."""
    out, total = [], 0
    for row, n in rows:
        out.append(row)
        total += n
        if total >= most:
            break
    return out


def paginate(query: Query, size: int, cursor: str | None = None, end_cursor: str | None = None, max_rows: int | None = None, max_bytes: int | None = None) -> Page:
    """One page. A pinned page holds all rows up to its end; budgets, ``PINNED_ROWS`` where no other is given, cut it short and ask for a split."""
    fields = query.order_key
    rows = page_plan(query, cursor, end_cursor)
    key_of = lambda r: encode_cursor([_at(r, f) for f in fields])
    pinned = end_cursor is not None
    target = None if pinned else max(size, 0)
    most = min(x for x in (target, max_rows, PINNED_ROWS if pinned and max_rows is None else None) if x is not None)
    taken = rows.limit(most + 1)
    if max_bytes is None:
        got, sizes = taken.collect(), None
    else:
        both = taken.withColumn("_bytes", byte_size(taken)).collect()
        got, sizes = both, [r["_bytes"] for r in both]
    more, page = len(got) > most, got[:most]
    over = pinned and more
    if sizes is not None:
        kept = within_bytes(list(zip(page, sizes, strict=False)), max_bytes)
        over, more, page = over or len(kept) < len(page), more or len(kept) < len(page), kept
    over = over or (max_rows is not None and more and len(page) == max_rows and (target is None or max_rows < target))
    split = key_of(page[split_index(len(page))]) if len(page) > 1 else None
    if pinned and not more:
        return Page(page, end_cursor == END, end_cursor, split, split_status(len(page), size))
    if not more:
        return Page(page, True, END, split, split_status(len(page), size))
    last = key_of(page[-1]) if page else (cursor or "")
    return Page(page, False, last, split, "SplitRequired" if over else split_status(len(page), size))


def _at(row: Row, path: str) -> object:
    value: object = row
    for part in path.split("."):
        value = None if value is None else value[part]
    return value


def ranked_page(ranked: DataFrame, order: list[Column], id_column: str, size: int, cursor: object = None) -> DataFrame:
    """A page of ranked results after the row with id ``cursor``; an unknown cursor starts from the beginning.

    Ranks are numbered over the whole result, range by range.
    """
    numbered = numbered_all(ranked, [*order, F.col(id_column).asc()], "_rank")
    if cursor is not None:
        at = numbered.where(F.col(id_column) == F.lit(cursor)).agg(F.max("_rank")).first()[0]
        numbered = numbered if at is None else numbered.where(F.col("_rank") > at)
    return numbered.orderBy("_rank").limit(size).drop("_rank")


def key_page(df: DataFrame, key: str, after_key: object = None, size: int = 64) -> DataFrame:
    """A page of rows by one unique key; the size is held within 1 to 128. One row more tells that there is a next page."""
    size = min(max(size, 1), 128)
    rows = df if after_key is None else df.where(F.col(key) > F.lit(after_key))
    return rows.orderBy(key).limit(size + 1)


def offset_page(df: DataFrame, order: list[Column], offset: int, size: int = 32) -> DataFrame:
    """A page by place in a total order, for short lists; keyset pages are the way for long ones."""
    return df.orderBy(*order).offset(offset).limit(size)


class PagedWatch:
    """Pages that stay chained by cursors while rows change: each reload keeps the pages' ends, splits those that have grown too long, and re-reads only where the table's version moved."""

    def __init__(self, query_of, size: int, version_of):
        self.query_of, self.size, self.version_of = query_of, size, version_of
        self.ends: list[str] = []
        self._cache: dict[tuple, Page] = {}

    def _page(self, cursor: str | None, end: str | None) -> Page:
        key = (self.version_of(), cursor, end)
        if key not in self._cache:
            self._cache = {k: p for k, p in self._cache.items() if k[0] == key[0]}
            self._cache[key] = paginate(self.query_of(), self.size, cursor, end)
        return self._cache[key]

    def pages(self) -> list[Page]:
        for _ in range(8):
            out, cursor, ends, split = [], None, [], False
            for end in self.ends or [None]:
                p = self._page(cursor, end)
                if p.status == "SplitRequired" and p.split_cursor and end is not None:
                    ends += [p.split_cursor, end]
                    split = True
                else:
                    ends.append(p.continue_cursor)
                out.append(p)
                cursor = ends[-1]
            self.ends = ends
            if not split:
                return out
        return out

    def load_more(self) -> list[Page]:
        pages = self.pages()
        if not pages[-1].is_done:
            self.ends.append(self._page(self.ends[-1], None).continue_cursor)
        return self.pages()

    def status(self) -> str:
        return "LoadingFirstPage" if not self.ends else "Exhausted" if self.pages()[-1].is_done else "CanLoadMore"
