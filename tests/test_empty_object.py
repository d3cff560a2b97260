"""An empty text is an object like others."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import duck, same


def test_an_empty_text_is_read_from_the_store(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(5)
    odd = spark.createDataFrame([(-1, ""), (-2, ""), (-3, None), (-4, " ")], "doc_id long, text string")
    docs.unionByName(odd, allowMissingColumns=True).withColumn("source", F.coalesce("source", F.lit("s"))).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duck(data)
    db.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = entry.queries()["store_objects_read"](spark, str(tmp_path))
    same(found, db, entry.oracle_sql()["store_objects_read"])
    assert {r.text for r in found.collect()} >= {"", " "}
