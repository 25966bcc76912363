import numpy as np
from pyspark.sql import functions as F

from passagekit.operators import encode


def test_dense_equals_sparse_and_unit(spark):
    texts = ["Hello, world! Hello again.", "Ça va? Très bien, merci", "", "123 456 123", "!!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    enc = encode.HashingEncoder(32)
    dense = {r.id: np.array(r.embedding, dtype=np.float32) for r in encode.encode(df, enc).collect()}
    sparse = encode.encode_sparse(df, enc, "id").collect()
    rebuilt = {i: np.zeros(32, np.float32) for i in dense}
    for r in sparse:
        rebuilt[r.id][r.bucket] = r.weight
    for i in dense:
        assert np.array_equal(dense[i], rebuilt[i])
    assert abs(np.linalg.norm(dense[0]) - 1) < 1e-6
    assert not dense[2].any() and not dense[4].any()   # no tokens -> zero vector


def test_token_buckets_native(spark):
    import hashlib
    import regex
    df = spark.createDataFrame([("Grüße aus Köln, 2024!",)], "t string")
    got = df.select(encode.HashingEncoder(256).features(F.col("t"))).first()[0]
    toks = [t for t in regex.split(r"[^\p{L}\p{N}]+", "Grüße aus Köln, 2024!".lower()) if t]
    exp = [int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 256 for t in toks]
    assert got == exp


def test_callable_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    enc = encode.CallableEncoder(dim=2, fn=lambda texts: [[len(t), 1.0] for t in texts])
    out = {r.id: r.embedding for r in encode.encode(df, enc).collect()}
    assert np.allclose(out[1], np.array([2, 1]) / np.sqrt(5), atol=1e-6)


def test_model_is_loaded_once_per_worker_and_rows_keep_their_order(spark, tmp_path):
    log = str(tmp_path / "loads")

    def loader():
        import os
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return log

    def model(loaded, texts):
        import os
        with open(loaded, "a") as f:
            f.write(f"batch {os.getpid()} {len(texts)} {max(map(len, texts))}\n")
        return [[len(t) + 1.0, t.count("a") + 1.0] for t in texts]

    enc = encode.ModelEncoder("counted", 2, loader, model, batch_rows=50, batch_chars=2000, window_rows=150)
    n = 3000
    df = spark.range(n).repartition(12).select("id", F.expr("if(id % 17 = 0, null, repeat('ab', cast(id * 7 % 150 as int)))").alias("text"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        out = {r.id: np.array(r.embedding) for r in encode.encode(df, enc).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for i in range(n):
        k = 0 if i % 17 == 0 else i * 7 % 150
        want = np.array([2 * k + 1, k + 1])
        assert np.allclose(out[i], want / np.linalg.norm(want), atol=1e-6)
    lines = open(log).read().split("\n")[:-1]
    loads = [x for x in lines if not x.startswith("batch")]
    batches = [x.split()[1:] for x in lines if x.startswith("batch")]
    workers = {b[0] for b in batches}
    assert sorted(loads) == sorted(workers) and len(workers) <= 4 < 12
    assert all(int(rows) <= 50 and (int(rows) == 1 or int(rows) * int(longest) <= 2000) for _, rows, longest in batches)


def test_model_batches_cover_every_row_once():
    enc = encode.ModelEncoder("m", 1, len, len, batch_rows=4, batch_chars=100)
    rng = np.random.default_rng(1)
    lengths = np.r_[rng.integers(0, 60, 40), 500, 0]
    got = list(enc.model_batches(lengths))
    assert sorted(np.concatenate(got).tolist()) == list(range(42))
    assert all(len(b) == 1 or (len(b) <= 4 and len(b) * lengths[b].max() <= 100) for b in got)


def test_bag_model_equals_the_hashing_encoder(spark):
    from passagekit.operators.bag_model import bag_model
    df = spark.createDataFrame([(1, "Hello, world! hello"), (2, None), (3, "Ça va, 123 va?"), (4, "")], "id long, text string")
    a = {r.id: r.embedding for r in encode.encode(df, bag_model("m", 16)).collect()}
    b = {r.id: r.embedding for r in encode.encode(df.fillna(""), encode.HashingEncoder(16)).collect()}
    assert a == b
    assert bag_model("intfloat/e5-base-v2", 4).query_prefix == "query: "
