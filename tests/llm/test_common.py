import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import common, simhash
from tessera.llm.common import numbered
from tests.llm.helpers import frame


def test_rows_are_told_apart_and_found_again(spark, tmp_path):
    frame(spark).repartition(5).write.parquet(f"{tmp_path}/d")
    files = spark.read.parquet(f"{tmp_path}/d")
    from_files = numbered(files.filter("rank >= 0").select("doc_id", "text"), "_row", "rows")
    made = numbered(files.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), "_row", "rows")  # each row twice: no places in files
    assert not hasattr(from_files, "_stored_at") and hasattr(made, "_stored_at")
    for df in (from_files, made):
        first = {(r["_row"]["file"], r["_row"]["place"]): (r["doc_id"], r["text"]) for r in df.collect()}
        assert len(first) == df.count()
        again = df.select("_row", "doc_id").filter("doc_id > 30").collect()  # other columns, other filters
        assert again and all(first[(r["_row"]["file"], r["_row"]["place"])][0] == r["doc_id"] for r in again)


def test_a_worker_keeps_one_model_until_it_reads_texts_of_near_dedup():
    common.held("a", list)
    kept = common.held("b", list)
    assert list(common._held) == ["b"] and common.held("b", dict) is kept
    row = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([b"a text"])], ["row", "id", "text"])
    assert [b.num_rows for b in simhash.read(iter([row]))] == [1]
    assert not common._held
