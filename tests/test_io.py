from pyspark.sql import functions as F

from churnspark.sources import io as IO


def test_delimiter_sniff_rules(spark):
    df = spark.createDataFrame([("a;b;c,d",), ("a|b|c",), ("abc",), ("a,b;c",), ("a\tb\tc\td;e",)], "line string")
    got = [r[0] for r in df.select(IO.delimiter_expr(F.col("line"))).collect()]
    assert got == [";", "|", ",", ",", "\t"]


def test_read_csv_bom_and_semicolon(spark):
    path = IO.new_output_path(spark, "t-csv")
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string").toDF(IO.BOM + " id ", "v") \
        .coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    df = IO.read_csv(spark, path)
    assert df.columns == ["id", "v"] and df.count() == 2


def test_encoding_fallback(spark):
    path = IO.new_output_path(spark, "t-latin")
    spark.createDataFrame([(1, "Zürich")], "id int, city string").coalesce(1).write \
        .option("header", True).option("encoding", "ISO-8859-1").csv(path)
    assert IO.read_csv(spark, path).first()["city"] == "Zürich"


def _file(spark, data: bytes) -> str:
    import os
    path = IO.new_output_path(spark, "t-raw").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/a.csv", "wb") as f:
        f.write(data)
    return path


def test_quoted_line_breaks_and_missing_words(spark):
    df = IO.read_csv(spark, _file(spark, b'id,text,num,flag\n1,"line one\nline ""two""",1.5,true\n2,b,NA,\n3,N/A,null,false\n'))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'line one\nline "two"', 1.5, True), (2, "b", None, None), (3, None, None, False)]


def test_valid_utf8_with_a_replacement_character_stays_utf8(spark):
    assert IO.read_csv(spark, _file(spark, "id,city\n1,Zürich \ufffd\n".encode())).first()["city"] == "Zürich \ufffd"
