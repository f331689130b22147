import io

import pytest

import quillframe as q
from quillframe import errors as E


@pytest.fixture
def read(spark, tmp_path):
    def run(text, **options):
        path = tmp_path / "t.csv"
        path.write_text(text, newline="")
        return q.read_csv(spark, str(path), q.ReadCsvOptions(**options))

    return run


def test_inference(read):
    f = read("id,value,is_active,name\n1,1.5,true,x\n2,,f,y\n,3,T,\n")
    assert f.schema() == {"id": q.Int64, "value": q.Float64, "is_active": q.Bool, "name": q.String}
    assert f.rows() == [(1, 1.5, True, "x"), (2, None, False, "y"), (None, 3.0, True, None)]
    assert read("a\n0\n1\n").dtypes() == [q.Int64]
    assert read("a,b\n1,x\n", infer_schema=False).dtypes() == [q.String, q.String]


def test_late_values_and_grammar(read):
    late = read("a\n" + "1\n" * 100 + "x\n")
    assert late.dtypes() == [q.Int64] and late.rows()[-1] == (None,)
    assert read("a\n" + "1\n" * 100 + "x\n", infer_schema_length=None).dtypes() == [q.String]
    assert read("a,b\n 1,1d\n2,2\n").dtypes() == [q.String, q.String]
    assert read("a\ninf\n1e5\n-.5\n").rows() == [(float("inf"),), (100000.0,), (-0.5,)]


def test_edges(spark, read):
    assert read("").shape() == (0, 0)
    empty = read("a,b\n")
    assert empty.dtypes() == [q.String, q.String] and empty.height() == 0
    for ragged in ("a,b\n1,2\n3\n", "a,b\n1,2\n3,4,5\n"):
        with pytest.raises(E.CsvError):
            read(ragged)
    with pytest.raises(E.DuplicateColumnName):
        read("a,a\n1,2\n")
    with pytest.raises(E.IoError):
        q.read_csv(spark, "/nowhere/at/all.csv")
    assert read('a,b\n1,"x\ny"\n').rows() == [(1, "x\ny")]


def test_options(read):
    f = read("1,x,true\n2,y,false\n", has_header=False)
    assert f.columns_names() == ["column_0", "column_1", "column_2"]
    f = read("junk\nmore\nberth;ship\n1;a\n# no\n2;b\n", skip_rows=2, comment_char="#", delimiter=";")
    assert f.rows() == [(1, "a"), (2, "b")]
    with pytest.raises(E.CsvError):
        read("one\n", skip_rows=5)
    f = read("id,name,value,active\n1,nm,2.5,true\n", use_columns=["active", "name"])
    assert f.rows() == [(True, "nm")]
    with pytest.raises(E.CsvError):
        read("a\n1\n", use_columns=["b"])
    assert read("a\n1\n", use_columns=[]).shape() == (0, 0)
    f = read("i,s\n1,n.k.\n??,x\n", na_values={"n.k.", "??"})
    assert f.rows() == [(1, None), (None, "x")]
    assert read("b\n10.5\n20.0\n", dtypes={"b": q.Int64}).rows() == [(None,), (None,)]
    with pytest.raises(E.UnsupportedOperation):
        read("b\n1\n", dtypes={"b": q.Int32})
    made = q.ReadCsvOptions.builder().delimiter(";").skip_rows(1).build()
    assert (made.delimiter, made.skip_rows, made.has_header) == (";", 1, True)


def written(frame, **options):
    out = io.StringIO()
    frame.to_csv_writer(out, q.WriteCsvOptions(**options))
    return out.getvalue()


def test_writer(spark):
    f = q.frame_of(spark, {"a": [1, 2], "b": ["x,y", None]})
    assert written(f) == 'a,b\n1,"x,y"\n2,\n'
    g = q.frame_of(spark, {"id": [1, 2], "v": [float("nan"), 1.0], "n": [None, "q"]})
    assert written(g, delimiter=";", na_rep="NULL") == "id;v;n\n1;NaN;NULL\n2;1;q\n"
    assert written(f, quote_style=q.QuoteStyle.ALWAYS, line_terminator="\r\n").startswith('"a","b"\r\n"1","x,y"\r\n')
    assert written(f, quote_style=q.QuoteStyle.NEVER, has_header=False) == "1,x,y\n2,\n"
    assert written(g, quote_style=q.QuoteStyle.NON_NUMERIC, na_rep="-").splitlines()[2] == '2,1,"q"'
    with pytest.raises(E.CsvError):
        written(f, line_terminator="ab")
    assert written(q.Frame.new_empty(spark)) == ""
    assert written(q.frame_of(spark, {"a": []}, {"a": q.Int64})) == "a\n"
    assert written(q.frame_of(spark, {"a": ["x", None]})) == 'a\nx\n""\n'
    assert written(q.frame_of(spark, {"f": [1e20, 1e-7]})) == "f\n100000000000000000000\n0.0000001\n"


def test_round_trip(spark, tmp_path):
    f = q.frame_of(spark, {"a": [1, 2], "b": ["x", 'say "hi"']}, {"a": q.Int64})
    path = str(tmp_path / "out.csv")
    f.to_csv(path)
    assert q.read_csv(spark, path).rows() == f.rows()
    with pytest.raises(E.IoError):
        f.to_csv(str(tmp_path / "no" / "such.csv"))


def test_quoted_line_breaks_after_skipped_lines(read):
    for end in ("\n", "\r\n"):
        text = end.join(['odd "', "", "a,b", '1,"x', 'y"', '2,"say ""hi"""', ""])
        f = read(text, skip_rows=2)
        assert f.rows() == [(1, f"x{end}y"), (2, 'say "hi"')] or (end == "\r\n" and f.rows() == [(1, "x\ny"), (2, 'say "hi"')])
    assert read("skip\n" * 30_000 + 'a\n"p\nq"\n', skip_rows=30_000).rows() == [("p\nq",)]


def test_types_of_columns_with_few_values(read):
    text = "a,b,c\n" + "1,,\n" * 300 + "x,2,\n"
    assert read(text).dtypes() == [q.Int64, q.Int64, q.String]
    assert read(text, infer_schema_length=None).dtypes() == [q.String, q.Int64, q.String]
    assert read("a\n", infer_schema_length=None).dtypes() == [q.String]


@pytest.mark.parametrize("style", list(q.QuoteStyle))
def test_parts_are_written_by_the_same_rules(spark, tmp_path, style):
    f = q.frame_of(spark, {"n": [1.0, 1e20, 1e-7, float("nan"), None], "s": ["x,y", "1_000", "", None, 'a"b'], "l": [[1, 2, 3, 4, 5, 6], [], None, [None], [7]], "b": [True, None, False, True, False]})
    options = q.WriteCsvOptions(quote_style=style, line_terminator="\r\n", na_rep="-", delimiter=";")
    path = tmp_path / "parts"
    q.write_parts(q.Frame(f._in_order().coalesce(1)), str(path), options)
    parts = [p.read_text(newline="") if hasattr(p, "read_text") else "" for p in sorted(path.glob("part-*"))]
    assert "".join(parts) == written(f, quote_style=style, line_terminator="\r\n", na_rep="-", delimiter=";")


def test_numbers_by_the_readers_grammar(spark):
    f = q.frame_of(spark, {"s": ["1_000", "1e5", "inf", "12a"]})
    assert written(f, quote_style=q.QuoteStyle.NON_NUMERIC).splitlines()[1:] == ['"1_000"', "1e5", "inf", '"12a"']
