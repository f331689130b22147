import math

import pytest

import quillframe as q
from quillframe import errors as E


@pytest.fixture
def fleet(spark):
    return q.frame_of(spark, {"depth": [1, 2, None, 4], "vessel": ["a", "b", "c", "d"], "moored": [True, None, False, True]})


def test_literals_and_schema(spark):
    f = q.frame_of(spark, {"port": ["Oran", "Bilbao"], "berths": [14, 6], "tide": [0.25, -1.5]})
    assert f.shape() == (2, 3)
    assert f.schema() == {"port": q.String, "berths": q.Int32, "tide": q.Float64}
    assert f.rows() == [("Oran", 14, 0.25), ("Bilbao", 6, -1.5)]
    typed = q.frame_of(spark, {"u": [1, 2]}, {"u": q.UInt32})
    assert typed.dtypes() == [q.UInt32]
    assert q.Frame.new_empty(spark).shape() == (0, 0)
    assert q.frame_of(spark, {"n": [None, None]}).dtypes() == [q.Null]


def test_construction_errors(spark):
    with pytest.raises(E.DuplicateColumnName):
        q.frame_of(spark, [("a", [1]), ("a", [2])])
    with pytest.raises(E.MismatchedLengths):
        q.frame_of(spark, {"a": [1, 2], "b": [1]})
    with pytest.raises(E.InvalidArgument):
        q.frame_of(spark, {"a": [300]}, {"a": q.UInt8})


def test_projection(fleet):
    assert fleet.select(["moored", "depth"]).columns_names() == ["moored", "depth"]
    assert fleet.drop("vessel").columns_names() == ["depth", "moored"]
    for bad in (lambda: fleet.select(["no"]), lambda: fleet.drop("no"), lambda: fleet.column("no"), lambda: fleet.column_at(9), lambda: fleet.rename_column("no", "x")):
        with pytest.raises(E.ColumnNotFound):
            bad()
    with pytest.raises(E.DuplicateColumnName):
        fleet.select(["depth", "depth"])
    with pytest.raises(E.TypeMismatch):
        fleet.downcast_column("depth", q.Int64)
    assert fleet.downcast_column("depth", q.Int32).name == "depth"


def test_columns_in_place(spark, fleet):
    gone = fleet.drop_column("vessel")
    assert gone.take_inner() == ["a", "b", "c", "d"] and fleet.columns_names() == ["depth", "moored"]
    fleet.add_column(q.Col.new(spark, "more", [9, 8, 7, 6]))
    assert [r[2] for r in fleet.rows()] == [9, 8, 7, 6]
    with pytest.raises(E.MismatchedLengths):
        fleet.add_column(q.Col.new(spark, "short", [1]))
    with pytest.raises(E.DuplicateColumnName):
        fleet.add_column(q.Col.new(spark, "more", [1, 2, 3, 4]))
    with pytest.raises(E.DuplicateColumnName):
        fleet.rename_column("more", "depth")
    assert fleet.rename_column("more", "less").columns_names() == ["depth", "moored", "less"]


def test_rows_by_position(fleet):
    assert [r[1] for r in fleet.head(2).rows()] == ["a", "b"]
    assert [r[1] for r in fleet.tail(3).rows()] == ["b", "c", "d"]
    assert [r[1] for r in fleet.tail(99).rows()] == ["a", "b", "c", "d"]
    assert [r[1] for r in fleet.slice(1, 2).rows()] == ["b", "c"]
    assert [r[1] for r in fleet.slice(3, 9).rows()] == ["d"]
    assert [r[1] for r in fleet.take([3, None, 0, 3]).rows()] == ["d", None, "a", "d"]
    with pytest.raises(E.IndexOutOfBounds):
        fleet.take([4])


def test_filter(spark, fleet):
    assert [r[1] for r in fleet.filter(fleet["moored"]).rows()] == ["a", "d"]
    foreign = q.Col.new(spark, "m", [False, True, None, True])
    assert [r[1] for r in fleet.filter(foreign).rows()] == ["b", "d"]
    with pytest.raises(E.MismatchedLengths):
        fleet.filter(q.Col.new(spark, "m", [True]))


def test_sort_nulls_and_nan(spark):
    f = q.frame_of(spark, {"v": [2.0, None, math.nan, 1.0], "k": [1, 2, 3, 4]})
    assert [r[1] for r in f.sort(["v"], [False]).rows()] == [4, 1, 3, 2]
    assert [r[1] for r in f.sort(["v"], [True]).rows()] == [2, 3, 1, 4]
    with pytest.raises(E.InvalidArgument):
        f.sort(["v"], [])
    two = q.frame_of(spark, {"a": ["x", "y", "x"], "b": [1, 2, 3]})
    assert two.sort(["a", "b"], [False, True]).rows() == [("x", 3), ("x", 1), ("y", 2)]
    assert two.sort([], []).rows() == two.rows()
    lists = q.frame_of(spark, {"l": [[1], [2]]})
    with pytest.raises(E.UnsupportedOperation):
        lists.sort(["l"], [False])


@pytest.fixture
def sides(spark):
    """Ships and visits: one ship without a visit, two visits of one ship, one visit of no ship; both sides have ``tons``."""
    ships = q.frame_of(spark, {"ship": ["Vela", "Orca", "Juno"], "tons": [700, 90, 310], "crew": [21, 4, 9]})
    visits = q.frame_of(spark, {"seen": ["Juno", "Vela", "Juno", "Argo"], "tons": [300, 650, 280, 55], "pilot": [False, True, True, False]})
    return ships, visits


def test_joins(sides):
    ships, visits = sides
    inner = ships.inner_join(visits, "ship", "seen")
    met = [("Juno", 310, 9, 280, True), ("Juno", 310, 9, 300, False), ("Vela", 700, 21, 650, True)]
    assert inner.schema() == {"ship": q.String, "tons": q.Int32, "crew": q.Int32, "tons_right": q.Int32, "pilot": q.Bool} and sorted(inner.rows()) == met
    alone = ("Orca", 90, 4, None, None)
    assert set(ships.left_join(visits, "ship", "seen").rows()) == {*met, alone}
    right = ships.right_join(visits, "ship", "seen")
    assert right.columns_names()[3:] == ["tons_left", "crew"]
    assert set(right.rows()) == {("Juno", 300, False, 310, 9), ("Juno", 280, True, 310, 9), ("Vela", 650, True, 700, 21), ("Argo", 55, False, None, None)}
    assert set(ships.outer_join(visits, "ship", "seen").rows()) == {*met, alone, (None, None, None, 55, False)}


def test_join_rules(spark, sides):
    ships, visits = sides
    with pytest.raises(E.JoinKeyTypeError):
        ships.inner_join(visits, "tons", "tons")
    assert ships.extended().inner_join(visits, "tons", "tons").rows() == []
    a = q.frame_of(spark, {"k": ["x", None, None], "v": [1, 2, 3]})
    b = q.frame_of(spark, {"k": [None, "y"], "w": [5, 6]})
    assert sorted(a.inner_join(b, "k", "k").rows(), key=str) == [(None, 2, 5), (None, 3, 5)]
    clash = q.frame_of(spark, {"k": ["x"], "w": [1], "w_right": [2]})
    with pytest.raises(E.DuplicateColumnName):
        clash.inner_join(b, "k", "k")


def test_group_rules(spark):
    f = q.frame_of(spark, {"k": ["p", "p", "q", None], "i": [2**31 - 1, 5, None, 1], "f": [math.nan, 1.0, None, 2.0], "s": ["b", "a", None, "c"]})
    g = f.groupby(["k"])
    assert sorted(g.count().rows()) == [("p", 2), ("q", 1)] and g.count().dtypes() == [q.String, q.UInt32]
    assert sorted(g.sum().rows()) == [("p", 2**31 - 1, 1.0), ("q", None, None)] and g.sum().dtypes() == [q.String, q.Int32, q.Float64]
    assert sorted(g.mean().rows()) == [("p", (2**31 + 4) / 2, 1.0), ("q", None, None)]
    assert sorted(g.min().rows()) == [("p", 5, 1.0, "a"), ("q", None, None, None)]
    assert sorted(g.max().rows()) == [("p", 2**31 - 1, 1.0, "b"), ("q", None, None, None)]
    low = q.frame_of(spark, {"k": ["a", "a"], "i": [-(2**31), -1]})
    assert low.groupby(["k"]).sum().rows() == [("a", -(2**31))]


def test_group_edges(spark):
    f = q.frame_of(spark, {"g": [1.5], "v": [2**40]})
    with pytest.raises(E.UnsupportedOperation):
        f.groupby(["g"])
    with pytest.raises(E.ColumnNotFound):
        f.groupby(["no"])
    k = q.frame_of(spark, {"k": ["a"], "big": [2**40], "count": [1]})
    assert k.groupby(["k"]).sum().columns_names() == ["k", "count"]  # Int64 is left out in strict mode
    assert k.extended().groupby(["k"]).sum().columns_names() == ["k", "big", "count"]
    with pytest.raises(E.DuplicateColumnName):
        k.groupby(["count"]).count()
    assert k.groupby([]).count().rows() == [(1,)]
    none = q.frame_of(spark, {"k": ["a"], "v": [1]}).filter(q.Col.new(spark, "m", [False]))
    assert none.groupby([]).count().rows() == [] and none.groupby(["k"]).sum().schema() == {"k": q.String, "v": q.Int32}


def test_show_and_equality(spark, fleet):
    text = str(fleet)
    assert "| null  |" in text and "Int32" in text
    assert str(q.Frame.new_empty(spark)) == "DataFrame (0x0)"
    assert "more rows" in str(q.frame_of(spark, {"a": list(range(12))}))
    same = q.frame_of(spark, {"v": [math.nan, 1.0]})
    assert same.equals(q.frame_of(spark, {"v": [1.0, math.nan]})) and not same.equals(q.frame_of(spark, {"v": [1.0, 2.0]}))


def test_copies_are_their_own(fleet):
    made = fleet.copy()
    made.drop_column("vessel")
    made.rename_column("depth", "draught")
    assert fleet.columns_names() == ["depth", "vessel", "moored"] and made.columns_names() == ["draught", "moored"]


def test_a_frame_of_columns(spark):
    f = q.Frame.new([q.Col.new(spark, "a", [1, 2]), q.Col.new(spark, "b", ["x", None])])
    assert f.rows() == [(1, "x"), (2, None)] and not f.is_empty() and f.head(0).is_empty()
    assert repr(f) == "Frame(columns=2, schema={a: Int32, b: String})"
    with pytest.raises(E.MismatchedLengths):
        q.Frame.new([q.Col.new(spark, "a", [1, 2]), q.Col.new(spark, "b", ["x"])])
