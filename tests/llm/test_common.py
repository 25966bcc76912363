from pyspark.sql import functions as F

from passagekit.llm.common import in_sample


def test_sample_cut_keeps_the_smallest_hashes(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    ids = ids.unionByName(ids)                            # repeated rows count once
    pick = lambda df: [r[0] for r in df.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()]
    cut = ids.where(in_sample(ids, "doc_id", 300))
    assert pick(cut) == pick(ids)
    assert 300 < cut.distinct().count() < 900
    assert ids.where(in_sample(ids, "doc_id", 20_000)).count() == ids.count()
    assert ids.limit(0).where(in_sample(ids.limit(0), "doc_id", 300)).count() == 0
