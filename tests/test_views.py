import pytest

from tablemill.operators import views
from tablemill.specs import SortKey, ViewSpec


@pytest.fixture(scope="module")
def tables(spark):
    x = spark.createDataFrame([(k, str(k)) for k in range(4)], "col1 int, col2 string")
    return {"x": x, "x2": x}


V1 = ViewSpec("x", {"c1": "col1"}, "col2", 2)
V2 = ViewSpec(["x", "x2"], ["col1"], [SortKey("col2", descending=True), "col1"], 2)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_single(tables):
    assert rows(views.resolve(V1, tables)) == [(0,), (1,)]


def test_union_sorted(tables):
    assert rows(views.resolve(V2, tables)) == [(3,), (3,)]


def test_view_on_view_inherits(tables):
    df = views.resolve(ViewSpec(V1, ["c1"]), tables)
    assert df.columns == ["c1"] and rows(df) == [(0,), (1,)]


def test_view_on_union_takes_smaller_limit(tables):
    assert rows(views.resolve(ViewSpec(V2, None, SortKey("col1", True), 3), tables)) == [(3,), (3,)]


def test_fuse_and_nest_differ(tables):
    outer = ViewSpec(ViewSpec("x", None, "col1", 2), None, SortKey("col1", True), 1)
    assert rows(views.resolve(outer, tables)) == [(3, "3")]
    assert rows(views.nest(outer, tables)) == [(1, "1")]


def test_fuse_keeps_null_order():
    key = SortKey("a", True, nulls_first=True)
    assert ViewSpec(ViewSpec("t", {"b": "a"}), None, SortKey("b", True, True)).fuse().sort_keys() == [key]


def test_union_of_two(tables):
    assert views.resolve(ViewSpec(["x", "x2"]), tables).count() == 8


def test_limit_zero(tables):
    assert views.resolve(ViewSpec("x", limit=0), tables).count() == 0


def test_one_column_as_text(tables):
    assert views.resolve(ViewSpec("x", "col2"), tables).columns == ["col2"]


@pytest.mark.parametrize("src", [[], [V1, V1]])
def test_bad_sources(src):
    with pytest.raises(ValueError):
        ViewSpec(src)


def test_unknown_outer_column():
    with pytest.raises(ValueError):
        ViewSpec(V1, ["col1"]).fuse()


def test_union_needs_same_columns(spark, tables):
    with pytest.raises(ValueError):
        views.union_all([tables["x"], tables["x"].drop("col2")])


def test_topk_plan_has_no_full_sort(tables, capsys):
    views.top_k(tables["x"], [SortKey("col1")], 2).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
