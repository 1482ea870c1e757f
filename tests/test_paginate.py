"""Pages: every row once, ties, pinned ends, budgets, cursors."""

import pytest

from lodestrata.functions import expr as E
from lodestrata.plans import paginate as P
from lodestrata.plans import query as Q
from lodestrata.plans.query import Bound, NotUnique, Query, check_range
from lodestrata.types import TableSpec

SPEC = TableSpec("items", {"by_status": ("status", "rank")}, creation="made", id="id")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, float(i // 3), "ab"[i % 2], None if i % 7 == 0 else i % 3) for i in range(60)]
    return Query(spark.createDataFrame(rows, "id long, made double, status string, rank int").cache(), SPEC)


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("size", [1, 7, 30, 100])
def test_pages_hold_each_row_once_in_order(items, direction, size):
    q = items.with_index("by_status", Q.eq("status", "a")).order(direction).filter(E.neq(E.field("id"), 8))
    want, got, cursor = [r.id for r in q.collect()], [], None
    while True:
        page = P.paginate(q, size, cursor)
        got += [r.id for r in page.page]
        if page.is_done:
            break
        cursor = page.continue_cursor
    assert got == want and page.continue_cursor == P.END


def test_pinned_page_grows(spark, items):
    q = items.with_index("by_status", Q.eq("status", "b"))
    first = P.paginate(q, 5)
    more = items.df.union(spark.createDataFrame([(100 + i, -1.0, "b", 0) for i in range(30)], items.df.schema))
    again = P.paginate(Query(more, SPEC).with_index("by_status", Q.eq("status", "b")), 5, None, first.continue_cursor)
    assert len(again.page) == 35 and again.status == "SplitRequired" and again.split_cursor and again.continue_cursor == first.continue_cursor


def test_budgets(items):
    rows = P.paginate(items, 50, max_rows=10)
    assert len(rows.page) == 10 and rows.status == "SplitRequired" and not rows.is_done
    few = P.paginate(items, 50, max_bytes=120)
    assert 1 <= len(few.page) < 10 and not few.is_done


def test_cursors():
    key = [None, 1.5, "x", float("inf"), 7]
    assert P.decode_cursor(P.encode_cursor(key), 5) == key
    for bad in (None, "", "zz", "ck1:{", "ck1:[1]", P.END):
        assert P.decode_cursor(bad, 5) is None


def test_empty_and_zero_pages(items):
    assert P.paginate(items, 0).page == [] and not P.paginate(items, 0).is_done
    none = P.paginate(items.filter(E.eq(E.field("id"), -1)), 5)
    assert none.page == [] and none.is_done


def test_take_first_unique(items):
    assert [r.id for r in items.take(2).take(50).filter(E.gt(E.field("id"), 10)).collect()] == [11, 12]
    assert items.with_index("by_id", Q.eq("id", 4)).unique().id == 4
    assert items.filter(E.eq(E.field("id"), -4)).first() is None
    with pytest.raises(NotUnique):
        items.unique()


@pytest.mark.parametrize(
    "bounds",
    [[Bound("eq", "rank", 1)], [Bound("gt", "status", 1), Bound("gt", "status", 2)], [Bound("gt", "status", 1), Bound("lt", "rank", 2)], [Bound("eq", "x", 1)], [Bound("gt", "status", 1), Bound("lt", "status", 2), Bound("lt", "status", 3)], [Bound("gt", "status", 1), Bound("eq", "status", 2)]],
)
def test_bad_ranges(bounds):
    with pytest.raises(ValueError):
        check_range(tuple(bounds), SPEC.index_fields("by_status"))


def test_order_key_drops_pinned_prefix(items):
    assert items.with_index("by_status", Q.eq("status", "a")).order_key == ("rank", "made", "id")
    assert items.with_index("by_id", Q.eq("id", 1)).order_key == ("id",)


def test_plans(items):
    plan = items.with_index("by_status", Q.eq("status", "a")).take(5).plan()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_watch(spark, items):
    rows = {"df": items.df, "v": 0}
    watch = P.PagedWatch(lambda: Query(rows["df"], SPEC), 10, lambda: rows["v"])
    assert watch.status() == "LoadingFirstPage"
    watch.pages()
    watch.load_more()
    assert sum(len(p.page) for p in watch.pages()) == 20 and watch.status() == "CanLoadMore"
    rows.update(df=items.df.union(spark.createDataFrame([(500 + i, 0.5, "a", 1) for i in range(60)], items.df.schema)), v=1)
    pages = watch.pages()
    assert len(pages) > 2 and sum(len(p.page) for p in pages) == 80


def test_pick_index():
    spec = TableSpec("t", {"a": ("x", "y"), "b": ("x", "z")})
    assert Q.pick_index(spec, {"x": 1, "z": 2}) == "b" and Q.pick_index(spec, {"q": 1}) is None
