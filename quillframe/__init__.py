"""A dataframe analytics engine whose every operation is a Spark plan."""

from quillframe.column import Col
from quillframe.dtypes import Bool, DType, Float32, Float64, Int8, Int16, Int32, Int64, Int128, Null, String, UInt8, UInt16, UInt32, UInt64, UInt128, list_of
from quillframe.frame import Frame
from quillframe.sources.csv_reader import ReadCsvOptions, read_csv
from quillframe.sources.csv_writer import QuoteStyle, WriteCsvOptions, write_parts
from quillframe.sources.literals import frame_of, read_parquet
from quillframe.sources.scratch import clean as clean_scratch

__all__ = ["Bool", "Col", "DType", "Float32", "Float64", "Frame", "Int128", "Int16", "Int32", "Int64", "Int8", "Null", "QuoteStyle", "ReadCsvOptions", "String", "UInt128", "UInt16", "UInt32", "UInt64", "UInt8", "WriteCsvOptions", "clean_scratch", "frame_of", "list_of", "read_csv", "read_parquet", "write_parts"]
