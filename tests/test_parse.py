import datetime
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from caselight.functions import ids, parse, text


@pytest.fixture(scope="module")
def read(spark):
    def run(*values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.asDict() for r in df.select("i", parse.parse_result(F.col("v")).alias("r")).select("i", "r.*").orderBy("i").collect()]

    return run


RESULTS = [
    # text, kind, exact, proxy, operator, lower, upper, category, unit
    ("0,75", "numeric_exact", 0.75, 0.75, "", None, None, "", ""),
    ("-4", "numeric_exact", -4.0, -4.0, "", None, None, "", ""),
    ("  88  ", "numeric_exact", 88.0, 88.0, "", None, None, "", ""),
    ("<= 0.5", "numeric_censored", None, 0.25, "<=", None, 0.5, "", ""),
    ("<-3", "numeric_censored", None, None, "<", None, -3.0, "", ""),
    (">=1,2", "numeric_censored", None, 1.2, ">=", 1.2, None, "", ""),
    ("10 to 30", "numeric_interval", None, 20.0, "", 10.0, 30.0, "", ""),
    ("1 đến 2", "numeric_interval", None, 1.5, "", 1.0, 2.0, "", ""),
    ("khoảng 9 g/L", "numeric_approx", 9.0, 9.0, "", None, None, "", "g/L"),
    ("≈ 4", "numeric_approx", 4.0, 4.0, "", None, None, "", ""),
    ("7 × 10^2", "numeric_with_unit", 700.0, 700.0, "", None, None, "", ""),
    ("1,5 x 10 -2 U", "numeric_with_unit", 0.015, 0.015, "", None, None, "", "U"),
    ("Nghi ngờ", "categorical", None, None, "", None, None, "indeterminate", ""),
    ("bất thường", "categorical", None, None, "", None, None, "abnormal", ""),
    ("chưa làm", "categorical", None, None, "", None, None, "not_performed", ""),
    ("++++", "semi_quantitative", None, None, "", None, None, "positive_plusplusplusplus", ""),
    ("vừa", "semi_quantitative", None, None, "", None, None, "vừa", ""),
    ("+++++", "free_text", None, None, "", None, None, "", ""),
    ("< six", "free_text", None, None, "", None, None, "", ""),
    ("1.2.3", "free_text", None, None, "", None, None, "", ""),
    ("not available", "missing", None, None, "", None, None, "", ""),
]


def test_results(read):
    for case, row in zip(RESULTS, read(*(c[0] for c in RESULTS)), strict=True):
        got = [row[n] for n in ("result_type", "result_numeric", "value_proxy", "result_operator", "result_lower_bound", "result_upper_bound", "result_category", "value_unit")]
        assert [round(x, 9) if isinstance(x, float) else x for x in got] == list(case[1:]), case
    levels = {"1+": 1.0, "4+": 4.0, "++": 2.0, "cao": 3.0, "trace": 1.0, "neg": None}
    assert {t: r["ordinal_level"] for t, r in zip(levels, read(*levels), strict=True)} == levels


def test_text(spark):
    df = spark.createDataFrame([("  Ｆull  width ", "12.0", "Straße_9"), ("NaN", "x.0", None)], "a string, b string, c string")
    row = df.select(text.clean(F.col("a"), compatibility=True).alias("a"), text.clean_key(F.col("b")).alias("b"), text.entity_key(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in row] == [("Full width", "12", "strasse 9"), ("", "x.0", "")]
    assert text.unique_headers(["a", None, "a", " a "]) == ["a", "unnamed_column_2", "a__2", "a__3"]
    joined = spark.range(1).select(text.join_unique(F.lit("A"), F.lit(""), F.lit("a"), F.lit("b")).alias("x")).first().x
    assert joined == "A; b"


def test_times(spark):
    at = datetime.datetime
    cases = {
        "199912312359": at(1999, 12, 31, 23, 59), "20240229": at(2024, 2, 29), "20230229": None, "20240229.0": at(2024, 2, 29), "202403310230": at(2024, 3, 31, 2, 30),
        "45000.5": at(2023, 3, 15, 12), "20000": at(1954, 10, 3), "60000": at(2064, 4, 8), "44561.999988": at(2021, 12, 31, 23, 59, 58, 963200), "2024-03-31T02:30:00": at(2024, 3, 31, 2, 30), "soon": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Asia/Tokyo", "Europe/Berlin"):  # the zone has no part in it, nor has its lost hour
            spark.conf.set("spark.sql.session.timeZone", name)
            got = {r.v: r.t for r in df.select("v", parse.parse_time(F.col("v")).alias("t")).collect()}
            assert got == cases, name
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_visit_dates(spark):
    at = datetime.datetime
    cases = {"2031-07-09 05:06:07.25": at(2031, 7, 9, 5, 6, 7, 250000), "2031-7-9 5:6:7": at(2031, 7, 9, 5, 6, 7), "2031-07-09": at(2031, 7, 9), " 9/7/2031  05:06:07 ": at(2031, 7, 9, 5, 6, 7), "09/07/2031 05:06": at(2031, 7, 9, 5, 6), "09/07/2031": at(2031, 7, 9)}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.t for r in df.select("v", parse.parse_date(F.col("v")).alias("t")).collect()} == cases
    for wrong in ("20310709", "2031/07/09", "31/02/2031", "", None, "null"):
        one = spark.createDataFrame([(wrong,)], "v string").select(parse.parse_date(F.col("v")).alias("t"))
        with pytest.raises(Exception, match="no known date"):
            one.collect()
        assert spark.createDataFrame([(wrong,)], "v string").select(parse.parse_date(F.col("v"), strict=False).alias("t")).first().t is None


def greedy_pieces(s, size):
    out, units = [""], 0
    for c in s:
        cost = len(c.encode("utf-16-le")) // 2
        if units + cost > size:
            out.append("")
            units = 0
        out[-1] += c
        units += cost
    return out


def test_split_text_by_units(spark):
    texts = ["", "abc", "abcdef", "😀" * 7, "a😀b😀c", "ab😀", "é" * 9, "😀a" * 5, "abcd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size in (2, 3, 4):
        got = {r.i: r.p for r in df.select("i", text.split_text(F.col("t"), size).alias("p")).collect()}
        assert got == {i: greedy_pieces(t, size) for i, t in enumerate(texts)}


def test_contexts_digests_and_json(spark):
    prompt = "rules\nBỆNH NHÂN A1\nold\nDATA\nBỆNH NHÂN B7 \n one \n two\nBỆNH NHÂN C12\nthree\nBỆNH NHÂN B7\nlast\n"
    row = spark.createDataFrame([(prompt, "none here")], "a string, b string").select(text.patient_blocks(F.col("a")).alias("a"), text.patient_blocks(F.col("b")).alias("b")).first()
    assert row.a == {"B7": "last", "C12": "three"} and row.b == {}
    v = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<double>").select(text.vector_sha256(F.col("v")).alias("h")).collect()
    assert [r.h for r in v] == [hashlib.sha256(struct.pack("<2f", 1.0, -2.5)).hexdigest(), None]
    df = spark.createDataFrame([(1, ("x", 2.0), [("q", 0.5)])], "b int, a struct<z:string,y:double>, c array<struct<k:string,d:double>>")
    kinds = {f.name: f.dataType for f in df.schema}
    assert df.select(text.canonical_json(kinds).alias("j")).first().j == '{"a":{"y":2.0,"z":"x"},"b":1,"c":[{"d":0.5,"k":"q"}]}'
    with pytest.raises(Exception, match="JSON can't hold"):
        spark.createDataFrame([(float("nan"),)], "x double").select(text.canonical_json({"x": kinds["a"]["y"].dataType}).alias("j")).collect()
    find = spark.createDataFrame([("Sô\u0301t cao", "so\u0302\u0301t"), ("abc", "b  C"), ("abc", "d")], "a string, b string")
    assert [r.m for r in find.select(text.matches_all(F.col("a"), F.col("b")).alias("m")).collect()] == [True, True, False]


def test_ids(spark):
    import json

    row = spark.range(1).select(ids.prefix_id("dx", F.lit('p"1'), F.lit("é")).alias("a"), ids.split_score(42, F.lit("x")).alias("s")).first()
    assert row.a == "dx_" + hashlib.sha256(json.dumps(['p"1', "é"], ensure_ascii=False).encode()).hexdigest()[:24]
    assert row.s == int(hashlib.sha256(b"42:x").hexdigest()[:12], 16) / 16**12
