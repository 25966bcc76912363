"""Index build job: sections -> passage text -> unit vectors (+ shards).

Narrow all the way (encode is a per-batch Arrow UDF); the only exchange is
the optional repartition by shard for the partitioned write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import passage_text, section_headers
from ..operators import encode as enc
from ..operators import knn
from ..session import spread
from ..sources import writers


def section_vectors(sections: DataFrame, encoder, add_tags: bool = False,
                    add_first_sentence: bool = False) -> DataFrame:
    """``(id, embedding)`` for every section (prefix and optional decorations
    applied to the encoded text only)."""
    if add_tags and "headers" not in sections.columns:
        sections = sections.withColumn("headers", section_headers(F.col("text"), F.col("sec")))
    t = passage_text(add_tags=add_tags, add_first_sentence=add_first_sentence, prefix=encoder.passage_prefix)
    src = spread(sections.select("id", t.alias("_pt")))
    return enc.encode(src, encoder, "_pt", "embedding").select("id", "embedding")


def build_index(sections: DataFrame, encoder, path: str, shards: int | None = None,
                mode: str = "overwrite", **kw) -> DataFrame:
    """Write the vector table (partitioned by shard when ``shards`` is set)."""
    vecs = section_vectors(sections, encoder, **kw)
    if shards:
        vecs = knn.shard_vectors(vecs, shards)
    writers.write_vectors(vecs, path, mode=mode)
    return sections.sparkSession.read.parquet(path)
