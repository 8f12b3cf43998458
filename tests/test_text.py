import re

import pytest
from pyspark.sql import functions as F

from postweave.functions import text as T


def values(spark, texts, expression):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


TEXTS = [
    "This is a test with a #camelCase #Mixed2dE #F1 and a @menti2on and @Other24 and "
    "a link https://www.example.org/fsfE?FSA^SDF?",
    "", "#", "#NaïveTag2d été", "httpfoo and http", "RTRT hi TR", "RT   RT\nline http x",
    "x² #m²q @ünal_1!", "a.b!  c?\n d", "tab\tand\x1cseparator http\x1cend",
]


def test_urls_match_python(spark):
    expected = [re.sub(r"http\S+", "http", t) for t in TEXTS]
    assert values(spark, TEXTS, T.collapse_urls(F.col("text"))) == expected


def test_hashtags_and_mentions_match_python(spark):
    tags = [", ".join(x.lower() for x in re.findall(r"#(\w+)", t)) for t in TEXTS]
    names = [", ".join(re.findall(r"@(\w+)", t)) for t in TEXTS]
    masked = [re.sub(r"@(\w+)", "@user", t) for t in TEXTS]
    assert values(spark, TEXTS, T.hashtags(F.col("text"))) == tags
    assert values(spark, TEXTS, T.mentions(F.col("text"))) == names
    assert values(spark, TEXTS, T.mask_mentions(F.col("text"))) == masked


def test_repost_prefix_and_charset_strip_differ(spark):
    texts = ["RT hello", "RTRT hi TR", "TRUE story RT", "rt no", " RT no"]
    assert values(spark, texts, T.strip_repost(F.col("text"))) == [
        "hello", "RTRT hi TR", "TRUE story RT", "rt no", " RT no"]
    clean = values(spark, texts, T.clean_post(F.col("text"))["text"])
    assert clean == [t.strip("RT").strip() for t in texts]


def test_clean_post_example(spark):
    columns = T.clean_post(F.col("text"))
    assert values(spark, TEXTS[:1], F.struct(columns["text"], columns["hashtags"], columns["mentions"]))[0] == (
        # The first T falls to the stripping of the letters R and T.
        "his is a test with a #camelCase #Mixed2dE #F1 and a @user and @user and a link http",
        "camelcase, mixed2de, f1", "menti2on, Other24")


@pytest.mark.parametrize("tag,words", [
    ("hashtagTest", "hashtag Test"), ("Mixed2dE", "Mixed 2 d E"), ("F1", "F 1"),
    ("ABC", "ABC"), ("", ""), ("été2012", "é t é 2012")])
def test_split_hashtag(spark, tag, words):
    assert values(spark, [tag], T.split_hashtag(F.col("text"))) == [words]


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    for column in (*T.clean_post(F.col("text")).values(), T.collapse_urls(F.col("text"))):
        assert df.select(column).first()[0] in (None, "")


def test_sentences_and_tokens(spark):
    assert values(spark, ["a.b!  c?\n d. "], T.sentences(F.col("text"))) == [["a.b!", "c?", "d."]]
    assert values(spark, ["Hi, #NaïveTag2d @me_1 !?"], T.tokens(F.col("text"))) == [
        ["Hi", ",", "#NaïveTag2d", "@me_1", "!", "?"]]


def tokens(spark, *lists):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, token array<string>")


def test_token_operators(spark):
    df = tokens(spark, ["#a", "b", "!", "@c", "#D", "?!"], [], None)
    t = F.col("token")
    rows = df.orderBy("i").select(
        T.token_positions(t, T.HASHTAG_TOKEN), T.token_positions(t, T.MENTION_TOKEN),
        T.token_positions(t, T.PUNCTUATION_TOKEN), T.replace_tokens(t, T.HASHTAG_TOKEN, "-"),
        T.hashtag_tokens(t)).collect()
    assert tuple(rows[0]) == ([0, 4], [3], [2], ["#a", "-", "-", "-", "#D", "-"], ["a", "d"])
    assert tuple(rows[1]) == ([], [], [], [], [])
    assert tuple(rows[2]) == (None,) * 5


def test_select_and_remove_by_index(spark):
    df = spark.createDataFrame(
        [(["a", "b", "a"], [2, 0, 2, 7, -1]), ([], [0]), (["x"], [])],
        "items array<string>, at array<int>")
    rows = df.select(T.select_by_index(F.col("items"), F.col("at")),
                     T.remove_by_index(F.col("items"), F.col("at"))).collect()
    assert [tuple(r) for r in rows] == [(["a", "a"], ["b"]), ([], []), ([], ["x"])]


def test_text_with_info_skips_null(spark):
    df = spark.createDataFrame([("t", 2012, None)], "text string, year int, tags string")
    out = df.select(T.text_with_info(F.col("text"), F.col("year"), F.col("tags"))).first()[0]
    assert out == "t <sep> 2012"
