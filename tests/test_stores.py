"""Tables changed bucket by bucket, pages of stored blocks, and JSON lists read in ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F, types as T

from claimloom.sources import buckets, files, json_arrays, pages


def names(spark, path):
    rows = spark.read.parquet(path).select(F.col(buckets.BUCKET).alias("b"), F.input_file_name().alias("f")).distinct().collect()
    return {(r.b, r.f) for r in rows}


CLAIM = "claim_id string, processing_status string, processed_date timestamp, x int"


def test_only_buckets_of_changed_keys_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/claims"
    rows = spark.range(400).select(F.format_string("c%d", "id").alias("claim_id"), F.lit("PENDING").alias("processing_status"), F.lit(None).cast("timestamp").alias("processed_date"), F.col("id").cast("int").alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(None, "PENDING", None, 7)], CLAIM))
    buckets.write_buckets(rows, path, "claim_id", 16)
    before = names(spark, path)
    updates = spark.createDataFrame([("c3", "SENT", 1), ("c3", "RETRY", 2), ("c77", "SENT", 1), ("none", "SENT", 1)], "claim_id string, new_status string, update_no int")
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    touched = buckets.update_claims(spark, path, updates, as_of)
    after = names(spark, path)
    assert 1 <= len(touched) <= 3 and {x for x in before if x[0] not in touched} == {x for x in after if x[0] not in touched}
    assert not {x for x in before if x[0] in touched} & after
    got = {r.claim_id: (r.processing_status, r.processed_date is not None) for r in buckets.read_buckets(spark, path).collect()}
    assert len(got) == 401 and got["c3"] == ("RETRY", True) and got["c77"] == ("SENT", True) and "none" not in got
    assert sum(s == "PENDING" for s, _ in got.values()) == 399 and None in got
    again = names(spark, path)
    assert buckets.update_claims(spark, path, updates.limit(0), as_of) == [] and names(spark, path) == again


def test_upserts_make_new_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/queue"
    kind = "chunk_id int, error_message string, retry_count long, resolved boolean, created_date timestamp, last_retry_date timestamp"
    buckets.write_buckets(spark.createDataFrame([], kind), path, "chunk_id", 8)
    failures = spark.createDataFrame([(i % 5, f"E{i}", i) for i in range(12)], "chunk_id int, error_message string, event_id int").withColumn("failed_at", F.timestamp_seconds("event_id"))
    touched = buckets.upsert_retry(spark, path, failures)
    buckets.upsert_retry(spark, path, failures.filter("chunk_id = 1"))
    got = {r.chunk_id: (r.retry_count, r.error_message) for r in buckets.read_buckets(spark, path).collect()}
    assert got == {0: (3, "E10"), 1: (6, "E11"), 2: (2, "E7"), 3: (2, "E8"), 4: (2, "E9")} and touched


def test_a_late_page_reads_its_block_only(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    rows = spark.range(5_000).select(F.format_string("k%06d", F.col("id") * 7 % 5_000).alias("k"), F.col("id").alias("v"))
    pages.write_pages(rows, path, ["k"], 100)
    for limit, offset in ((10, 0), (30, 4_485), (250, 333), (10, 4_995), (5, 9_000), (0, 50)):
        got = [r.k for r in pages.read_page(spark, path, limit, offset).collect()]
        assert got == [f"k{i:06d}" for i in range(5_000)][offset : offset + limit]
    late = pages.read_page(spark, path, 30, 4_485)
    assert len(late.select(F.input_file_name().alias("f")).distinct().collect()) <= 2
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_block" in plan


def test_pages_of_many_blocks_lie_in_few_folders(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    spark.range(20_000).select(F.format_string("k%06d", F.col("id") * 7 % 20_000).alias("k")).write.parquet(f"file://{tmp_path}/rows")
    rows = spark.read.parquet(f"file://{tmp_path}/rows")
    pages.write_pages(rows, path, ["k"], 10)
    assert 200 <= len([f for f in (tmp_path / "pages").iterdir() if f.name.startswith("_block=")]) <= pages.FOLDERS
    for limit, offset in ((10, 0), (30, 14_485), (2_500, 333), (10, 19_995), (5, 29_000), (0, 50)):
        got = [r.k for r in pages.read_page(spark, path, limit, offset).collect()]
        assert got == [f"k{i:06d}" for i in range(20_000)][offset : offset + limit]
    assert len(pages.read_page(spark, path, 30, 14_485).select(F.input_file_name().alias("f")).distinct().collect()) <= 2


NASTY = ['plain', 'a "quoted" [x] {y}', 'back\\slash', 'ends with \\', '\\"', '\\\\"', '}],[{', 'é中\n\t', '', '"' * 7, '\\' * 9]


def listed(n, seed=1):
    rng = random.Random(seed)
    return [{"id": f"c{i}", "text": "".join(rng.choices(NASTY, k=rng.randint(0, 6))), "more": [{"x": rng.choice(NASTY)}, [1, [2, "]"]]], "n": i} for i in range(n)]


KIND = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_summaries_and_records_agree_whatever_the_ranges(indent, size):
    import numpy as np

    rows = listed(12 if size == 1 else 60)
    data = np.frombuffer((" \n" + json.dumps(rows, indent=indent, ensure_ascii=False) + "\n ").encode(), np.uint8)
    state, got = (False, False, 0), []
    for at in range(0, len(data), size):
        got += json_arrays.records(data[at:], min(size, len(data) - at), *state)
        after = json_arrays.summary(data[at : at + size])[2 * state[0] + state[1]]
        state = (after[0], after[1], state[2] + after[2])
    assert [json.loads(x) for x in got] == rows and state == (False, False, 0)


def test_one_file_in_many_ranges(spark, tmp_path):
    rows = listed(3_000)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(rows[:2_900], ensure_ascii=False))
    (tmp_path / "in" / "b.json").write_text(json.dumps(rows[2_900:], indent=1))
    (tmp_path / "in" / "c.json").write_text("[]")
    (tmp_path / "in" / "_SUCCESS").write_text("")
    for path in (str(tmp_path / "in"), f"file://{tmp_path}/in"):
        df = json_arrays.read_json_array(spark, path, KIND, 10_000)
        assert sorted((r.n, r.id, r.text) for r in df.collect()) == [(r["n"], r["id"], r["text"]) for r in rows]
    one = json_arrays.read_json_array(spark, str(tmp_path / "in" / "a.json"), KIND, 10_000)
    assert one.count() == 2_900 and one.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert json_arrays.read_json_array(spark, str(tmp_path / "in" / "c.json"), KIND).count() == 0


@pytest.mark.parametrize("text", ['{"claims": []}', '[1, 2]', '[{"a": 1}, "x"]', '[[{"a": 1}]]', '[{"a": 1}] x', '[{"a": 1}', 'x [{"a": 1}]'])
def test_other_content_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="Invalid JSON structure|ends inside"):
        json_arrays.read_json_array(spark, str(tmp_path / "x.json"), KIND, 4).collect()


def test_claims_without_an_id_are_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"claim_id": "a"}, {"patient_id": "b"}]')
    with pytest.raises(Exception, match="Invalid JSON structure"):
        files.read_claims_array(spark, str(tmp_path / "x.json")).collect()


def test_code_lists_report_other_failures_than_a_missing_file(spark, tmp_path):
    assert files.read_code_list(spark, f"file://{tmp_path}/none.csv", ["A"]).collect()[0].code == "A"
    with pytest.raises(Exception):
        files.read_code_list(spark, "nostore://none/x.csv")


def test_many_short_lists_take_few_tasks(spark, tmp_path):
    """Ranges are dealt out to tasks, however many files there are."""
    (tmp_path / "in").mkdir()
    for i in range(100):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps([{"a": i}, {"a": -i}]))
    df = json_arrays.read_json_array(spark, str(tmp_path / "in"), T.StructType([T.StructField("a", T.IntegerType())]), 8)
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(r.a for r in df.collect()) == sorted(x for i in range(100) for x in (i, -i))
