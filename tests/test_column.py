import math

import pytest

import quillframe as q
from quillframe import errors as E


@pytest.fixture
def make(spark):
    return lambda values, dtype=None, name="s": q.Col.new(spark, name, values, dtype)


def test_access(make):
    s = make([1.0, None, 3.5, 0.5])
    assert s.take_inner() == [1.0, None, 3.5, 0.5] and list(s.iter_valid()) == [1.0, 3.5, 0.5]
    assert (s.get(2), s.get(1), s.get(9), s.get_opt(1)) == (3.5, None, None, None)
    with pytest.raises(E.IndexOutOfBounds):
        s.get_opt(4)
    assert (s.get_str(0), s.get_str(1), s.get_as_f64(2), s.is_null_at(1), s.is_null_at(0)) == ("1", "null", 3.5, True, False)
    assert make(["x"]).get_as_f64(0) is None
    assert s.length() == 4 and not s.is_empty() and str(s) == "[1, null, 3.5, 0.5]"


def test_sort_push_clear(make):
    s = make([3, None, 1, 4, None, 1])
    up, down = s.sort(), s.sort(reverse=True)
    assert up.take_inner() == [None, None, 1, 1, 3, 4] and down.take_inner() == [4, 3, 1, 1, None, None]
    assert up.get_flags() == {"is_sorted_ascending": True, "is_sorted_descending": False}
    pushed = up.push(9)
    assert pushed.take_inner()[-1] == 9 and not pushed.is_sorted()
    assert make([]).push(5).dtype == q.Int32 and s.clear().dtype == q.Null
    with pytest.raises(E.UnsupportedOperation):
        make([1.0]).sort()


def test_gather_and_filter(make):
    s = make([10, None, 30, 40])
    assert s.filter(make([True, True, None, False])).take_inner() == [10, None]
    assert s.take_indices([3, 0, 0]).take_inner() == [40, 10, 10]
    assert s.take_indices_option([None, 2]).take_inner() == [None, 30]
    assert s.slice(2, 9).take_inner() == [30, 40] and s.head(1).take_inner() == [10] and s.tail(2).take_inner() == [30, 40]


def test_comparison(make):
    a, b = make([1, None, 3]), make([1, 2, 2], name="t")
    assert a.gt(1).take_inner() == [False, None, True] and a.gt(1).name == "s_gt_scalar"
    found = a.gte_series(b)
    assert found.take_inner() == [True, None, True] and found.name == "s_gte_series"
    assert make(["b", None]).lt("c").take_inner() == [True, None]
    v = make([math.nan, None, 1.0])
    assert v.eq(math.nan).take_inner() == [False, None, False] and v.neq(1.0).take_inner() == [True, None, False]
    with pytest.raises(E.MismatchedLengths):
        a.eq_series(make([1]))
    with pytest.raises(E.TypeMismatch):
        a.eq_series(make([1.0, 2.0, 3.0]))


def test_arithmetic(make):
    a, b = make([7, None, -7]), make([2, 2, 0], name="t")
    assert (a + b).take_inner() == [9, None, -7] and (a + b).name == "s"
    assert (a / 2).take_inner() == [3, None, -3] and (a / b).take_inner() == [3, None, None] and (a % 4).take_inner() == [3, None, -3]
    zero = a.div_scalar(0)
    assert zero.take_inner() == [None] * 3 and zero.name == "s_div_scalar_by_zero"
    assert a.add_scalar(1).name == "s_add_scalar" and a.mul_series(b).name == "s_mul_series_t"
    with pytest.raises(E.ComputeError):
        a.div_series(b).take_inner()
    x, y = make([1.0, -1.0, 0.0, None]), make([0.0, -0.0, 0.0, 1.0], name="y")
    found = x.div_series(y).take_inner()
    assert found[:2] == [math.inf, math.inf] and math.isnan(found[2]) and found[3] is None
    assert (x / 0.0).take_inner() == [None] * 4
    with pytest.raises(E.ComputeError):
        (make([2**31 - 1]) + 1).take_inner()


def test_nulls(make):
    v = make([1.0, None, math.nan, math.inf])
    assert v.is_null().take_inner() == [False, True, False, False] and v.is_null().name == "s_is_null"
    assert v.is_nan().take_inner() == [False, False, True, False] and v.is_not_nan().take_inner() == [True, True, False, True]
    assert v.is_infinite().take_inner() == [False, False, False, True] and v.fill_null(0.0).take_inner()[1] == 0.0
    with pytest.raises(E.TypeMismatch):
        make([1]).is_nan()


def test_reductions(make):
    assert (make([1, None, 3]).sum(), make([1, None, 3]).min(), make([1, None, 3]).max(), make([1, None, 3]).mean()) == (4, 1, 3, 2.0)
    assert math.isnan(make([1.0, math.nan]).sum()) and make([1.0, math.nan, 3.0]).max() == 3.0
    assert make([], q.Int32).sum() is None and make([None, None], q.Float64).mean() is None
    assert [make(v, q.Bool).all() for v in ([True, True], [True, None], [], [False])] == [True, False, True, False]
    assert [make(v, q.Bool).any() for v in ([False, True], [False, None], [])] == [True, False, False]


def test_equality(make):
    a = make([1.0, None, math.nan])
    assert not a.equals(make([1.0, None, math.nan])) and a.series_equal(make([1.0, None, math.nan], name="other"))
    assert make([1, None]).equals(make([1, None])) and not make([1]).equals(make([1], name="t")) and not make([1]).series_equal(make([1, 2]))


def test_strings(make):
    s = make(["  Hello ", None, "", "日本　", "abab"])
    assert s.str.contains("b").take_inner() == [False, None, False, False, True] and s.str.contains("b").name == "s_contains_b"
    assert s.str.startswith("ab").take_inner()[4] and s.str.endswith("ab").take_inner()[4]
    assert s.str.str_len().take_inner() == [8, None, 0, 9, 4] and s.str.str_len().dtype == q.UInt32
    assert s.str.replace("ab", "x").take_inner()[4] == "xx" and make(["ab"]).str.replace("", "$1").take_inner() == ["$1a$1b$1"]
    assert s.str.strip().take_inner() == ["Hello", None, "", "日本", "abab"]
    assert s.str.lstrip().take_inner()[0] == "Hello " and s.str.rstrip().take_inner()[0] == "  Hello"
    assert s.str.to_uppercase().take_inner()[0] == "  HELLO " and s.str.to_lowercase().name == "s_lower"
    with pytest.raises(E.TypeMismatch):
        _ = make([1]).str


def test_user_functions(make):
    s = make([1, None, 3])
    assert s.apply(lambda v: 0 if v is None else v * 2).take_inner() == [2, 0, 6]
    assert s.map(lambda v: f"<{v}>", q.String).take_inner() == ["<1>", "<None>", "<3>"]
    assert s.par_apply(lambda c: c * 2, native=True).take_inner() == [2, None, 6]
    assert make([], q.Int32).apply(lambda v: v).take_inner() == []


def test_cast_and_lists(spark, make):
    assert make([1.0]).cast(q.Float64).take_inner() == [1.0]
    with pytest.raises(E.CastError):
        make([1]).cast(q.Float64)
    assert make([None], q.Int32).cast(q.String).dtype == q.String
    assert make(["1", "x"]).cast(q.Int32, strict=False).take_inner() == [1, None]
    cells = q.Col.new_list(spark, "l", [make([1, 2]), None, make([], q.Int32)])
    assert cells.take_inner() == [[1, 2], None, []] and cells.dtype == q.list_of(q.Int32) and cells.get_str(1) is None
    assert cells.get_inner_series(0).take_inner() == [1, 2]
    with pytest.raises(E.OtherError):
        q.Col.new_list(spark, "l", [make([1]), make(["x"])])
    assert q.Col.new(spark, "l", [list(range(9))]).get_str(0) == "[0, 1, 2, 3, 4, ...]"


def test_dtypes():
    assert q.Int8.is_integer and q.Int128.is_integer and not q.Int128.is_numeric and q.Float32.is_float
    assert q.Null < q.Bool < q.Int8 < q.String < q.list_of(q.Bool) < q.list_of(q.String)


@pytest.mark.parametrize("kind", [q.UInt8, q.UInt16, q.UInt32, q.UInt64])
def test_unsigned_bounds(spark, kind):
    top = kind.bounds[1]
    c = q.Col.new(spark, "u", [top, 5, None], kind)
    assert c.take_inner() == [top, 5, None] and list(c) == [top, 5, None] and c.max() == top and c.dtype == kind
    assert (c - 5).take_inner() == [top - 5, 0, None] and (c / 2).take_inner() == [top // 2, 2, None] and (c % 2).take_inner() == [1, 1, None]
    assert c.gt(5).take_inner() == [True, False, None] and c.eq(top).take_inner() == [True, False, None]
    for wrong in (c + 1, c - 6, c * 2, c.add_scalar(top), c.sub_scalar(top)):
        with pytest.raises(E.ComputeError):
            wrong.take_inner()
        with pytest.raises(E.ComputeError):
            wrong.to_frame().rows()
    with pytest.raises(E.ComputeError):
        c.sum()
    assert q.Col.new(spark, "u", [top - 1, 1], kind).sum() == top
    f = q.frame_of(spark, {"k": ["a", "a"], "u": [top, top]}, {"u": kind}).extended()
    assert f.groupby(["k"]).sum().rows() == [("a", top)]
    with pytest.raises(E.InvalidArgument):
        q.Col.new(spark, "u", [top + 1], kind)
    assert q.Col.new(spark, "u", [top, 3], kind).sort().take_inner() == [3, top]
