from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.sources.files import codes_of_text


def values(df, column="v"):
    return [r[column] for r in df.collect()]


def test_age_group_edges(spark):
    ages = spark.createDataFrame([(a,) for a in [None, 0, 17, 18, 64, 65]], "a int")
    assert values(ages.select(S.age_group("a").alias("v"))) == ["ADULT", "CHILD", "CHILD", "ADULT", "ADULT", "SENIOR"]


def test_provider_by_place(spark):
    df = spark.createDataFrame([("11",), ("22",), ("23",), ("41",), ("99",), (None,)], "p string")
    assert values(df.select(S.provider_type_from_pos("p").alias("v"))) == [
        "PRIMARY_CARE", "HOSPITAL", "EMERGENCY", "URGENT_CARE", "SPECIALIST", "SPECIALIST"]


def test_masking(spark):
    cases = {
        "id 123-45-6789.": "id XXX-XX-XXXX.",
        "dob: 1/2/1990": "DOB: XX/XX/XXXX",
        "DOB12/31/2001 x": "DOB: XX/XX/XXXX x",
        "1234567890123456": "XXXX-XXXX-XXXX-XXXX",
        "12345678901234567": "12345678901234567",
        "1123-45-6789": "1123-45-6789",
        "é1234567890123456": "é1234567890123456",
        "123-45-6789 dob 1/2/1990 1234567890123456": "XXX-XX-XXXX DOB: XX/XX/XXXX XXXX-XXXX-XXXX-XXXX",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert values(df.select(S.mask_phi("t").alias("v"))) == list(cases.values())


def test_item_tags_skip_nulls(spark):
    df = spark.sql("SELECT array('A', null) d, array() p, cast(null AS string) t, '11' s, cast(null AS int) a")
    assert values(df.select(S.item_tags("d", F.col("p").cast("array<string>"), "t", "s", "a").alias("v"))) == [
        ["DIAG_A", "POS_11", "AGE_ADULT"]]


def test_payload_presence_decides(spark):
    rows = [
        (1, "old", '{"payer": "new"}'), (2, "old", '{"payer": null}'), (3, "old", "{broken"), (4, "old", None),
        (5, "old", '{"other": 1}'), (6, "old", "[1, 2]"),
    ]
    out = S.merge_payload(spark.createDataFrame(rows, "id int, payer string, claim_data string")).orderBy("id")
    assert values(out, "payer") == ["new", None, "old", "old", "old", "old"]
    assert "member_id" in out.columns


def test_split_charge_remainder(spark):
    df = spark.range(1, 4).select(S.split_charge(F.lit("100.00"), F.lit(3), F.col("id")).cast("string").alias("v"))
    assert values(df) == ["33.33", "33.33", "33.34"]


def test_primary_diagnosis(spark):
    entry = "struct<code:string,type:string,sequence:int,description:string,is_principal:boolean>"
    cases = [
        ([], None),
        ([("B", "I", None, "", False), ("C", "I", 2, "", False)], "C"),
        ([("B", "I", None, "", False)], "B"),
        ([("A", "I", 1, "", False), ("Z", "I", 5, "", True), ("Y", "I", 9, "", True)], "Z"),
        ([("A", "I", 1, "", None), ("B", "I", 1, "", None)], "A"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], f"d array<{entry}>")
    assert values(df.select(S.primary_diagnosis("d").alias("v"))) == [c[1] for c in cases]


def test_pointers_and_applied_filters(spark):
    df = spark.createDataFrame([("[2, 0, -1, 3]",), ("[]",), (None,), ("nonsense",)], "j string")
    assert values(df.select(S.applied_filters("j").alias("v"))) == [[2, 3], [], [], []]


def test_priority(spark):
    df = spark.createDataFrame([(8,), (7,), (5,), (4,)], "p int")
    assert values(df.select(S.priority_tier("p").alias("v"))) == ["high", "normal", "normal", "low"]


def test_code_list_forms(spark):
    df = spark.createDataFrame([("A1, B2,,C3",), ("A1\r\n\r\n B2 \nC3,x\n",), ("",)], "t string")
    assert values(df.select(codes_of_text("t").alias("v"))) == [["A1", "B2", "C3"], ["A1", "B2", "C3"], []]
