"""CSV scans: cp949 with a Korean header, quoted comma and newline; round trip;
calendar spine of the source's 166 monthly chart dates."""

import os

from pyspark.sql import functions as F

from moodspark.sources import calendar as cal
from moodspark.sources import csv_io


def test_cp949_scan(spark, tmpdir_):
    path = os.path.join(tmpdir_, "utter.csv")
    with open(path, "wb") as f:
        f.write('발화문,상황\n"안녕, 반가워",happiness\n"줄\n바꿈",fear\n무섭다,neutral\n'.encode("cp949"))
    df = csv_io.read_csv(spark, path, "`발화문` string, `상황` string", encoding=csv_io.CP949)
    assert [tuple(r) for r in df.collect()] == [("안녕, 반가워", "happiness"), ("줄\n바꿈", "fear"),
                                               ("무섭다", "neutral")]


def test_csv_round_trip_keeps_text(spark, tmpdir_):
    rows = [(1, "쉼표, 있음"), (2, "줄\n바꿈"), (3, ' 앞뒤 공백 '), (4, ""), (5, None), (6, 'quote "q"')]
    df = spark.createDataFrame(rows, "id int, text string")
    out = os.path.join(tmpdir_, "rt")
    csv_io.write_csv(df, out)
    back = csv_io.read_csv(spark, out, "id int, text string")
    # like a pandas to_csv/read_csv pair, an empty string comes back as NULL
    expected = [(i, None if t == "" else t) for i, t in rows]
    assert sorted(((r[0], r[1]) for r in back.collect()), key=lambda r: r[0]) == expected
    out949 = os.path.join(tmpdir_, "rt949")
    csv_io.write_csv(df.where(F.col("id") != 6), out949, encoding=csv_io.CP949)
    back949 = csv_io.read_csv(spark, out949, "id int, text string", encoding=csv_io.CP949)
    assert sorted(((r[0], r[1]) for r in back949.collect()), key=lambda r: r[0]) == [e for e in expected if e[0] != 6]


def test_monthly_chart_calendar(spark):
    bounds = spark.range(1).select(F.lit("2010-01-01").alias("lo"), F.lit("2023-10-01").alias("hi"))
    dates = [r["chart_date"] for r in cal.calendar_spine(bounds, F.col("lo"), F.col("hi"), "1 month")
             .orderBy("seq").collect()]
    assert len(dates) == 166 and dates[0] == "20100101" and dates[-1] == "20231001"
    assert dates[155] == "20221201"  # the last date the source's every-12 snapshot saved


def test_appended_files_are_read(spark, tmpdir_):
    from moodspark.sources.tables import table
    path = os.path.join(tmpdir_, "labels.parquet")
    rows = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    rows.write.parquet(path)
    assert table(spark, tmpdir_, "labels").count() == 10
    rows.write.mode("append").parquet(path)
    assert table(spark, tmpdir_, "labels").count() == 20


def test_escaped_text_comes_back(spark):
    texts = ["가나 abc", "Étê ñ \\u00e9 \\\\ back", "한글\n줄 바꿈 中文", "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", csv_io.escape_unencodable(F.col("t")).alias("e"))
    rows = out.select("t", "e", csv_io.unescape(F.col("e")).alias("b")).collect()
    assert [r["b"] for r in rows] == texts
    for r in rows:
        r["e"].encode("cp949")


def test_tag_rows_keeps_every_row(spark):
    df = spark.createDataFrame([("src2",), ("src3",), (None,)], "source string")
    even = F.substring("source", 4, 10).cast("int") % 2 == 0
    got = [tuple(r) for r in csv_io.tag_rows(df, [("training", even)], "validation").collect()]
    assert got == [("src2", "training"), ("src3", "validation"), (None, "validation")]


def _csv_file(path, rows, header, encoding="utf-8", newline="\n"):
    import csv
    with open(path, "w", encoding=encoding, newline="") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(header)
        out.writerows(rows)


def _many_tasks(spark, path, schema, encoding="UTF-8", size="32k"):
    """Rows, and how many tasks read them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = csv_io.read_csv(spark, path, schema, encoding=encoding)
        tasks = len(df.select(F.spark_partition_id().alias("p")).distinct().collect())
        return [tuple(r) for r in df.collect()], tasks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_quoted_file_is_read_by_many_tasks(spark, tmpdir_):
    """Records with newlines, quotes, commas and CRs, some longer than a byte range; the same rows as one task reads."""
    import random
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        parts = [rng.choice(["a", "쉼표", ",", "\n", '"', "\r\n", " ", "x" * 40, '""\n"']) for _ in range(rng.randint(1, 12))]
        rows.append((i, "s" + "".join(parts), "t%d" % i))
    rows[3000] = (3000, "s" + "line of a long field\n" * 9000, "t3000")
    path = os.path.join(tmpdir_, "large.csv")
    _csv_file(path, rows, ["id", 'te"x\nt', "tag"])
    schema = "id int, text string, tag string"
    got, tasks = _many_tasks(spark, path, schema)
    assert sorted(got) == rows
    assert tasks > 10
    one = (spark.read.options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
           .schema(schema).csv(path))
    assert sorted(tuple(r) for r in one.collect()) == sorted(got)


def test_ranges_of_a_few_bytes(spark, tmpdir_):
    """Every cut is somewhere inside: headers, quotes and records over several ranges."""
    rows = [("1", 'a"b\n\n"c,\n'), ("2", "plain"), ("3", "\n" * 40), ("4", "한글\n줄"), ("5", '"'), ("6", "end")]
    path = os.path.join(tmpdir_, "small.csv")
    _csv_file(path, rows, ["i\nd", "long\nheader\nover lines"])
    for size in ("7b", "16b", "33b", "1k"):
        assert sorted(_many_tasks(spark, path, "id string, text string", size=size)[0]) == rows


def test_crlf_files_and_cp949_in_ranges(spark, tmpdir_):
    rows = [(str(i), "줄\n바꿈 %d" % i if i % 3 else "안녕, 반가워") for i in range(300)]
    dos, ko = os.path.join(tmpdir_, "dos.csv"), os.path.join(tmpdir_, "ko.csv")
    _csv_file(dos, rows, ["id", "text"], newline="\r\n")
    _csv_file(ko, rows, ["번호", "글"], encoding="cp949")
    assert sorted(_many_tasks(spark, dos, "id string, text string", size="512b")[0]) == sorted(rows)
    got, tasks = _many_tasks(spark, ko, "`번호` string, `글` string", csv_io.CP949, "512b")
    assert sorted(got) == sorted(rows) and tasks > 5
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_several_files_and_broken_records(spark, tmpdir_):
    import pytest
    for i in range(3):
        _csv_file(os.path.join(tmpdir_, f"f{i}.csv"), [(10 * i + j, f"x\n{j}") for j in range(4)], ["id", "text"])
    got, _ = _many_tasks(spark, tmpdir_, "id int, text string", size="20b")
    assert sorted(got) == [(10 * i + j, f"x\n{j}") for i in range(3) for j in range(4)]
    bad = os.path.join(tmpdir_, "bad.csv")
    _csv_file(bad, [("one", "not a number")], ["id", "text"])
    with pytest.raises(Exception):
        csv_io.read_csv(spark, bad, "id int, text string").collect()
