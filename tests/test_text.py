from pyspark.sql import functions as F

from rankforge.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, " «Ёлка» – Тест\n\tX ", T.normalize_text) == '"елка" - тест x'
    assert one(spark, None, T.normalize_text) == ""


def test_legal_tokens(spark):
    sample = "ФИО адрес: согласно ст. 333.19 НК РФ и федеральный закон № 75-ФЗ"
    got = one(spark, sample, lambda t: T.lexical_tokens(t, T.LEGAL))
    assert {"нк", "рф", "ст_333.19"} <= set(got) and {"75_фз", "75фз"} & set(got)
    assert not {"фио", "адрес"} & set(got)


def test_min_len_keeps_codes_and_numbers(spark):
    assert one(spark, "ab рф 7 abc и", T.lexical_tokens) == ["рф", "7", "abc"]


def test_bigrams_break_at_structured_tokens(spark):
    got = one(spark, "alpha beta 12 gamma delta", lambda t: T.lexical_tokens(t, T.TokenRules(add_bigrams=True)))
    assert got == ["alpha", "beta", "12", "gamma", "delta", "alpha__beta", "gamma__delta"]


def test_lemma_column(spark):
    got = one(spark, "суды рф", lambda t: T.lexical_tokens(t, T.LEMMA, lemma=lambda x: F.regexp_replace(x, "ы$", "")))
    assert got == ["суд", "рф"]


def test_char_grams_of_short_and_long_words(spark):
    assert one(spark, "a", T.char_grams) == [" a "]
    assert one(spark, "abc", T.char_grams) == [" ab", "abc", "bc ", " abc", "abc ", " abc "]


def test_features(spark):
    row = spark.createDataFrame([("Суд РЕШИЛ по статья 15 и ст.10, 01.02.2020, 5 000 рублей",)], "t string").select(*T.document_features(F.col("t"))).first()
    assert (row.doc_kind, row.articles, row.date_count, row.has_reshil, row.has_ustanovil) == ("решение", "ст. 15 ст.10", 1, 1, 0)


def test_names():
    assert T.slug("BAAI/bge-M3 x") == "baai_bge_m3_x" and T.number_label(0.25) == "0p25"
