"""Texts go along once: inside their row, and not through Python where only marks come back."""

import pyarrow as pa

from rowloom.llm import paragraphs
from rowloom.llm.texts import WHO


def test_cut_out_takes_the_text_from_its_row():
    row = pa.array([{"doc_id": 1, "text": "one two three"}, {"doc_id": 2, "text": None}])
    given = {"row": row, "no_id": [False, False], "id": [1, 2], "digest": [5, 6], "parts": [[{"start": 0, "stop": 4}], None],
             "runs": [None, None], "kept_in": pa.array([[7], None], pa.list_(pa.int64()))}
    batch = pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, list) else v for v in given.values()], ["row", *WHO, "parts", "runs", "kept_in"])
    made = next(paragraphs._cut_out(iter([batch])))
    assert made.column("kept").to_pylist() == ["two three", None]
    assert made.column("n_removed").to_pylist() == [4, 0]


def test_known_counts_split_hot_keys_without_counting_again(spark, monkeypatch):
    from pyspark.sql import functions as F

    from rowloom.operators import joins

    monkeypatch.setattr(joins, "SMALL_LEFT", 10)
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.array(F.max("id")).alias("most")).where("key % 2 = 1")
    plain = type(left).groupBy

    def by_no_key(self, *keys):
        assert not keys, "counted again"
        return plain(self)

    monkeypatch.setattr(type(left), "groupBy", by_no_key)
    got = joins.lookup(left, right, ["key"], 1000, "inner", counted="n")
    monkeypatch.undo()
    want = left.join(right.drop("n"), "key")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
