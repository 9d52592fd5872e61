"""Every registered query on empty tables, and on tables with null, NaN, short and empty vectors, null and empty texts, and
repeated rows: each gives a result (rows or none), not an error."""

import pytest
from pyspark.sql import functions as F

from framelens.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for kind in ("empty", "odd"):
        d = str(tmp_path_factory.mktemp(kind))
        for name in TABLES:
            rows = spark.read.parquet(f"{SOURCE}/{name}.parquet")
            if kind == "empty":
                rows = rows.limit(0)
            elif name == "embeddings":
                v, own = F.col("embedding"), F.col("vec_id") % 50
                odd = F.when(own == 1, F.lit(None)).when(own == 2, F.transform(v, lambda x: F.lit(float("nan")).cast("float"))).when(own == 3, F.slice(v, 1, 3)).when(own == 4, F.slice(v, 1, 0))
                odd = odd.when(own == 5, F.transform(v, lambda x, i: F.when(i == 0, F.lit(None)).otherwise(x))).when(own == 6, F.transform(v, lambda x: F.lit(0.0).cast("float"))).otherwise(v)
                rows = rows.withColumn("embedding", odd).unionByName(rows.where("vec_id % 40 = 7"))
            elif name in ("documents", "benchmark", "conversations"):
                key = F.hash("text")
                rows = rows.withColumn("text", F.when(key % 7 == 0, F.lit(None)).when(key % 7 == 1, F.lit("")).when(key % 7 == 2, F.lit(" \n\t.")).otherwise(F.col("text")))
                rows = rows.unionByName(rows.limit(5))
            elif name == "pages":
                rows = rows.withColumns({c: F.when(F.col("page_id") % 7 == k, F.lit(None)).when(F.col("page_id") % 7 == k + 1, F.lit("")).otherwise(F.col(c)) for k, c in enumerate(("url", "html"))})
            rows.coalesce(1).write.parquet(f"{d}/{name}.parquet")
        made[kind] = d
    return made


@pytest.mark.parametrize("kind", ["empty", "odd"])
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_ends(spark, folders, name, kind):
    catalogue.QUERIES[name](spark, folders[kind]).collect()
