from passagekit.operators import choices

Q = [(0, "What?", "ctx", "a", "b", None, "d", "e", "C"), (1, "Why?", "", "1", "2", "3", "4", "5", "A")]
SCHEMA = ("prompt_id long, prompt string, context string, A string, B string, C string, D string, "
          "E string, answer string")


def test_pairs_plain(spark):
    df = choices.fill_options(spark.createDataFrame(Q, SCHEMA))
    p = {(r.prompt_id, r.choice): r for r in choices.mc_pairs(df).collect()}
    assert len(p) == 10
    assert p[(0, 2)].first == "[CLS] ctx"
    assert p[(0, 2)].second == " #### What? [SEP] None [SEP]"
    assert p[(0, 0)].label == 2 and p[(1, 4)].label == 0


def test_pairs_with_answers(spark):
    df = choices.fill_options(spark.createDataFrame(Q, SCHEMA))
    p = {(r.prompt_id, r.choice): r for r in choices.mc_pairs(df, with_answers=True).collect()}
    assert p[(0, 1)].first == "[CLS] a(o) None(o) d(o) e ### ctx"
    assert p[(0, 1)].second == " ### What? [SEP] b [SEP]"
    s1 = {(r.prompt_id, r.choice): r.first for r in choices.mc_pairs(df, True, shuffle_seed=3).collect()}
    s2 = {(r.prompt_id, r.choice): r.first for r in choices.mc_pairs(df, True, shuffle_seed=3).collect()}
    assert s1 == s2
    for key, first in s1.items():
        others = sorted(first[len("[CLS] "):first.index(" ### ")].split("(o) "))
        assert others == sorted(p[key].first[len("[CLS] "):p[key].first.index(" ### ")].split("(o) "))


def test_truncate(spark):
    pairs = spark.createDataFrame([(0, 0, "[CLS] one two three four five", " ### q [SEP] a [SEP]", 0)],
                                  "prompt_id long, choice int, first string, second string, label int")
    r = choices.truncate_pairs(pairs, 8).first()
    assert r.first == "[CLS] one" and not r.over_budget
    r = choices.truncate_pairs(pairs, 3).first()
    assert r.first == "" and r.over_budget


def test_shuffle_drop_union(spark):
    df = spark.createDataFrame(Q, SCHEMA)
    a = [(r.position, r.prompt_id) for r in choices.shuffle_rows(df, 1).collect()]
    b = [(r.position, r.prompt_id) for r in choices.shuffle_rows(df, 1).collect()]
    assert sorted(a) == sorted(b) and sorted(p for p, _ in a) == [0, 1]
    assert [r.prompt_id for r in choices.drop_rows(df, [0]).collect()] == [1]
    both = choices.union_train(df, df.drop("context"))
    assert sorted(r.row_id for r in both.collect()) == [0, 1, 2, 3]
    assert choices.drop_rows(both, [0], "row_id").count() == 3
    split = choices.prepare_split(df, df, [0], 1, n=2).collect()
    assert sorted(r.position for r in split) == [0, 1] and all(r.C is not None for r in split)


def _subwords():
    import public_tokenizers

    from passagekit.operators.tokens import RankTokenizer
    return RankTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def bpe(text, ranks, pattern):
    """Tokens by the definition: the pair with the lowest rank merges first."""
    import regex
    out = []
    for word in regex.findall(pattern, text):
        parts = [bytes([b]) for b in word.encode()]
        while True:
            pairs = [(ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not pairs or min(pairs)[0] == 1 << 30:
                break
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        out += parts
    return out


def test_truncate_with_a_subword_tokenizer(spark):
    import base64
    import random

    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh éß日\U0001f600\n.,1") for _ in range(rng.randint(0, 60)))
    rows = [(i, 0, "[CLS] " + word(), " ### " + word(), 0) for i in range(60)]
    rows += [(100, 0, None, "x", 0), (101, 0, "x", None, 0), (102, 0, "", "", 0)]
    df = spark.createDataFrame(rows, "prompt_id long, choice int, first string, second string, label int")
    got = {r.prompt_id: r for r in choices.truncate_pairs(df, 24, _subwords()).collect()}
    for i, _, first, second, _ in rows:
        n = len(bpe(second or "", ranks, public_tokenizers.PATTERN))
        tokens = bpe(first or "", ranks, public_tokenizers.PATTERN)
        fit = max(24 - n, 0)
        want = first if first is None or len(tokens) <= fit else b"".join(tokens[:fit]).decode("utf-8", "ignore")
        assert (got[i].first, got[i].second, got[i].over_budget) == (want, second, n > 24)


def test_token_lengths_with_a_subword_tokenizer(spark):
    texts = [("en", "one two three"), ("en", ""), ("de", "Straße"), ("de", None)]
    df = spark.createDataFrame(texts, "lang string, text string")
    tok = _subwords()
    got = {r.lang: r for r in choices.token_lengths(df, "lang", tokenizer=tok).collect()}
    en, de = tok.lengths(["one two three", ""]), tok.lengths(["Straße"])
    assert (got["en"].n, got["en"].min_tokens, got["en"].max_tokens, got["en"].avg_tokens) == (2, min(en), max(en), sum(en) / 2)
    assert (got["de"].n, got["de"].min_tokens, got["de"].max_tokens) == (2, de[0], de[0])


def test_shuffle_is_numbered_in_ranges_that_follow_the_rows(spark):
    df = spark.range(2000).withColumnRenamed("id", "prompt_id")
    many = choices.shuffle_rows(df, 3, rows_per_range=100)
    assert many.inputFiles() and len(many.inputFiles()) >= 20
    few = choices.shuffle_rows(df, 3)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    assert sorted(r.position for r in few.collect()) == list(range(2000))
