"""Tables that are stored by their keys are not moved again, and give what they gave."""

import re

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import assembly as A
from strandgraph.plans import record_queries as Q
from strandgraph.session import materialize_by


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)


def test_a_table_stored_by_keys_is_grouped_and_joined_in_place(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(i % 5, None if i % 7 == 0 else i % 3, i) for i in range(60)], "x long, b long, n long")
        stored = materialize_by(rows, {"a": F.col("x").cast("string"), "b": F.col("b")}, "rows")
        assert sorted(map(tuple, stored.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
        grouped = stored.groupBy("a", "b", "n").count()
        joined = grouped.join(stored.groupBy("a", "b").agg(F.max("n").alias("most")), ["a", "b"])
        assert not moves(joined) and joined.count() == sum(1 for i in range(60) if i % 7)
        assert materialize_by(rows.limit(0), {"a": F.col("x"), "b": F.col("b")}).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["conversation_build", "chat_messages", "triplet_source_stats"])
def test_order_lines_are_moved_to_their_study_once(spark, folder, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [k for k in moves(Q.QUERIES[name](spark, folder)) if k.startswith("subject_id")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) <= 3  # the images for the rows and for the retrieval, and the retrieved captions; not the lines


def test_images_of_placed_studies_are_those_of_any(spark):
    meta = [("1", "a", "d2"), ("1", "a", "d1"), ("1", "a", "d1-0"), ("1", "a", "d1"), ("2", "a", "d1"), (None, "b", "d1"), ("3", None, "d1"), ("4", "c", "d9")]
    meta = spark.createDataFrame(meta, "subject_id string, study_id string, dicom_id string")
    files = [("1", "a", "d1"), ("1", "a", "d1"), ("1", "a", "d1-0"), ("2", "a", "d1"), ("4", "c", "other"), (None, "b", "d1"), ("3", None, "d1")]
    files = spark.createDataFrame(files, "subject_id string, study_id string, dicom_id string").select(*A.STUDY, A.image_path("subject_id", "study_id", "dicom_id").alias("rel_path"))
    split = spark.createDataFrame([("1", "a", "d1", "val"), ("1", "a", "d1", "test"), ("2", "a", "d0", "val")], "subject_id string, study_id string, dicom_id string, split string")
    plain = sorted(map(tuple, A.study_images(meta, files.select("rel_path"), split).collect()))
    assert plain == [("1", "a", "d1", "p1/p1/sa/d1.jpg", "val"), ("2", "a", "d1", "p2/p2/sa/d1.jpg", "train")]
    found = A.study_images(meta, files, split, within=A.STUDY).select("subject_id", "study_id", "img_id", "rel_path", "split")
    assert sorted(map(tuple, found.collect())) == plain
