from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corundum.functions import chemistry, text, values
from corundum.operators import heuristics
from corundum.schemas import DOMAINS, registry


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


def test_canonical_text_and_missing(spark):
    rows = [("10^-8 M s^-1", "10-8 M s-1"), ("μg mL^-1", "μg mL−1"), ("α-Fe2O3@CoNi", "Fe2O3@CoNi"), ("", "NOT_DETECTED"), (None, "NOT_DETECTED"), (" n/a ", "NOT_DETECTED"), ("not found", "NOT_DETECTED"), (" x ", "x")]
    got = spark.createDataFrame(rows, "x string, y string").select(values.value(F.col("x")), "y").collect()
    assert all(a == b for a, b in got)


def test_numeric_text(spark):
    rows = [("20-30", "20-30"), ("89.8 ± 7.9", "89.8"), ("~800", "800"), ("room temperature", "NOT_DETECTED"), ("13.5 × 10⁻⁸", "1.35e-07"), ("2 x 10^3", "2000"), ("about 5 +/- 1", "5"), ("a x 10^3", "a x 10^3")]
    got = spark.createDataFrame(rows, "x string, y string").select(values.numeric_text(F.col("x"), temperature=True), "y").collect()
    assert all(a == b for a, b in got), got


def test_whole_numbers_as_decimals(spark):
    rows = [("25", "25.0"), ("0025", "25.0"), ("+7", "7.0"), ("-7", "-7.0"), ("2.5", "2.5"), ("1e3", "1e3"), ("20-30", "20-30"), ("NOT_DETECTED", "NOT_DETECTED")]
    got = spark.createDataFrame(rows, "x string, y string").select(values.whole_as_decimal(F.col("x")), "y").collect()
    assert all(a == b for a, b in got), got


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e30, max_value=1e30), min_size=200, max_size=200))
def test_general_format(spark, xs):
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", values.general(F.col("x")).alias("g")).collect()
    # Ties at the twelfth digit are rounded up there and to the exact value here.
    assert all(g == f"{x:.12g}" or abs(float(g) - x) <= abs(x) * 1.01e-11 for x, g in got)


def test_pdf_identifiers(spark):
    for key, name, want in (("synergy", "paper.pdf", "paper.pdf"), ("benzimidazole", "paper.pdf", "paper"), ("nanozymes", "THNO.19257", "THNO.19257"), ("synergy", "11_fbioe-09-652362", "11_fbioe-09-652362.pdf"), ("nanozymes", "a/b/c.PDF", "c")):
        assert one(spark, name, lambda c, k=key: values.pdf_identifier(DOMAINS[k], c)) == want


def test_json_strings(spark):
    assert one(spark, '["a",null,1,true]', values.json_strings) == ["a", "", "1", "true"]
    assert one(spark, "5", values.json_strings) == ["5"]
    assert one(spark, "x y", values.json_strings) == ["x y"]
    assert one(spark, None, values.json_strings) == []


def test_confidence(spark):
    rows = [("0.9", 0.9), ("91", 0.91), ("high", 0.75), (None, 0.75), ("0", 0.01), ("1", 0.99)]
    got = spark.createDataFrame(rows, "x string, y double").select(values.confidence(F.col("x")), "y").collect()
    assert all(abs(a - b) < 1e-9 for a, b in got), got


def test_measured(spark):
    cases = {
        "MIC 4 µg/mL": (None, "4", "µg/mL"), "28": (None, "28", None), "<0,5 mM": ("<", "0.5", "mM"), "6a": None, "a12 nM": None, "12 things": None, "12 things, 3 ug mL-1": (None, "3", "µg mL−1"),
        "no number": None, "MIC50 was below 7": (None, "7", None), ">= 3.5": (">=", "3.5", None),
    }
    for cell, want in cases.items():
        got = one(spark, cell, chemistry.measured)
        assert (tuple(got) if got else None) == want, cell


def test_captions_and_headings(spark):
    got = one(spark, "x\nTable 1. MIC values", text.caption)
    assert tuple(got) == ("Table", "1", "MIC values")
    assert one(spark, "as in Table 1", text.caption) is None
    assert one(spark, "Results and so on\nmore", text.heading) == "Results and so on"
    assert one(spark, "2. Materials used", text.heading) == "2. Materials used"
    assert one(spark, "the results", text.heading) is None


def test_snippet(spark):
    assert one(spark, " a \n b ", lambda c: text.snippet(c, 5)) == "a b"
    assert one(spark, "abcd efgh", lambda c: text.snippet(c, 6)) == "abcd..."


def test_properties_carry_their_context(spark):
    got = one(spark, "We saw MIC = 4 ug/mL and IC50 of 12 nM; pMIC: 3.2 too", heuristics.properties)
    assert [r["value"] for r in got] == ["MIC = 4 ug/mL", "pMIC: 3.2", "IC50 of 12 nM"]
    assert [round(r["confidence"], 2) for r in got] == [0.78, 0.79, 0.8]
    assert all("We saw" in r["evidence"] for r in got)


def test_registry(spark):
    r = registry(spark)
    assert r.groupBy("domain").count().count() == 10
    assert r.where("is_numeric").count() == sum(len(d.numeric) for d in DOMAINS.values())
    assert [len(d.columns) for d in DOMAINS.values()] == [7, 7, 7, 4, 5, 20, 24, 21, 23, 29]
    assert DOMAINS["eyedrops"].columns == ("smiles", "name", "perm (cm/s)", "logP")
