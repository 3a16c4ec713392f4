"""TF-IDF hand case and tokenisation rules."""
from tessera.operators import text as TT


def test_tfidf_hand_case(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, "red car red")], "id long, t string")
    m = TT.fit_tfidf(df, "id", "t", stop_words=[])
    got = {(r["id"], r["term"]): round(r["weight"], 6) for r in m.weights(df, "id").collect()}
    assert got[(1, "red")] == 0.449436 and got[(1, "apple")] == 0.631667
    assert got[(1, "red apple")] == 0.631667
    assert got[(2, "red")] == 0.570995
    for t in ("car", "red car", "car red"):
        assert got[(2, t)] == 0.473978


def test_tokens_accents_stopwords_bigrams(spark):
    df = spark.createDataFrame([(1, "The Café is a b Über-cool")], "id long, t string")
    toks = TT.tokenize(df, "t", "terms", TT.default_stop_words()).first()["terms"]
    assert toks == ["cafe", "uber", "cool", "cafe uber", "uber cool"]


def test_vocab_cap_and_ties(spark):
    df = spark.createDataFrame([(1, "zz yy xx"), (2, "zz yy")], "id long, t string")
    m = TT.fit_tfidf(df, "id", "t", max_features=2, stop_words=[])
    assert sorted(r["term"] for r in m.vocab.collect()) == ["yy", "zz"]


def test_accents_and_compatibility_forms_equal_nfkd(spark):
    """Every character by itself and between letters, and texts of many of them."""
    import random
    import sys
    import unicodedata

    from tessera.functions.text import strip_accents
    hangul = range(0xAC00, 0xD7A4)
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and c not in hangul
             and (c < 0x3000 or unicodedata.normalize("NFKD", chr(c)) != chr(c))]
    rnd = random.Random(2)
    texts = ["".join(chars[i:i + 40]) for i in range(0, len(chars), 40)]
    texts += ["".join(rnd.choice([rnd.choice(chars), "a", " ", "\n", "\u0301"]) for _ in range(60)) for _ in range(200)]
    texts += ["", "plain", "ﬁne Ｆｕｌｌ 𝐁𝐨𝐥𝐝 Ⅷ ½ … ① ㎏ e\u0301"]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", strip_accents("t").alias("s")).collect()
    wrong = [(texts[r["i"]], r["s"]) for r in got if r["s"] != plain(texts[r["i"]])]
    assert not wrong, wrong[:2]
    assert next(r["s"] for r in got if r["i"] == len(texts) - 1) == "fine Full Bold VIII 1⁄2 ... 1 kg e"


def test_accents_take_no_class_of_many_ranges_per_character(spark):
    """every text met a regular expression of hundreds of ranges; the results stay."""
    from tessera.functions import text as TX
    src = ["ﬁne Ａé½x", "plain ^&&[z]", "日本ﬁ é", "", "ﷺ", "가é", "𝐀𝟘 ǆ", None]
    col = TX.strip_accents("s")
    assert "RLIKE" not in str(col)
    got = [r[0] for r in spark.createDataFrame([(s,) for s in src], "s string").select(col).collect()]
    assert got == ["fine Ae1⁄2x", "plain ^&&[z]", "日本fi e", "", "صلى الله عليه وسلم", "가e", "A0 dz", None]


def test_term_stats_builds_no_struct_per_token(spark):
    from tessera.operators import text as TT
    df = spark.createDataFrame([("red red fox",), ("red hen",), (None,), ("",)], "t string")
    got = TT.term_stats(df, "t")
    assert "named_struct" not in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} == {("red", 3, 2), ("fox", 1, 1), ("hen", 1, 1), ("red red", 1, 1),
                                                 ("red fox", 1, 1), ("red hen", 1, 1)}
