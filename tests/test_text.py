"""Text functions, on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from convoscope.functions import text as T
from convoscope.functions.lexicon import Lexicon
from convoscope.functions.text import with_features
from convoscope.operators.markers import default_entries, with_entry_features
from helpers import messages


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, value):
        frame = spark.createDataFrame([(value,)], "text string")
        return frame.select(function(F.col("text"))).first()[0]

    return run


@pytest.mark.parametrize(
    "text, language",
    [
        ("سلام، چطوری؟", "fa"),
        ("Hello, how are you?", "en"),
        ("123456 !!!", "other"),
        ("", "unknown"),
        (" \t ", "unknown"),
        ("سلام hello دوست friend", "mixed"),
        ("سلام دوست عزیز من ok", "fa"),
        ("hello my dear friend سلا", "en"),
    ],
)
def test_detect_language(apply, text, language):
    assert apply(T.detect_language, text) == language


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Hello   World!   How ARE you?", "hello world! how are you?"),
        ("  soooo   loooong\n\n\tgone ", "soo loong gone"),
        ("a b c", "a b c"),
        ("   ", ""),
        ("سلام   می روم   به خانه ی  دوست", "سلام می‌روم به خانه‌ی دوست"),
        ("كتاب هاي علي", "کتاب‌های علی"),
        ("نمی دانم بزرگ ترین", "نمی‌دانم بزرگ‌ترین"),
        ("سلااااام", "سلاام"),
        ("۱۲ 123 !!!!", "۱۲ ۱۲۳ !!"),
    ],
)
def test_normalize(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "text string")
    assert T.with_language(frame).first()["normalized_text"] == expected


def test_mixed_text_keeps_its_case(spark):
    frame = spark.createDataFrame([("Salam سلام Dust دوست",)], "text string")
    row = T.with_language(frame).first()
    assert (row["language"], row["normalized_text"]) == ("mixed", "Salam سلام Dust دوست")


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("I'll go, OK_2!", ["i", "ll", "go", "ok_2"]),
        ("می‌روم", ["می", "روم"]),
        ("étude ½ 第3", ["étude", "½", "第3"]),
        ("éa", ["e", "a"]),
        (None, []),
    ],
)
def test_tokenize(apply, text, tokens):
    assert apply(T.tokenize, text) == tokens


@pytest.mark.parametrize(
    "text, expected",
    [
        ("what a day!!", {"exclamation_count": 2, "is_interrogative": 1, "is_question": 0}),
        ("چرا نیومدی", {"is_interrogative": 1, "is_question": 0}),
        ("coming?", {"is_question": 1, "is_interrogative": 1}),
        ("رفتی؟", {"is_question": 1}),
        ("nice！ day", {"exclamation_count": 1}),
        ("❤️ 👍🏽 😀", {"emoji_count": 3, "word_count": 0}),
        ("👨‍👩‍👧 🇫🇷", {"emoji_count": 5}),
        ("sooo goood ... !!!", {"elongation_count": 2}),
        ("see https://a.b/c and WWW.x.org t.me/joined", {"link_count": 3}),
        ("HTTPS://A.B only", {"link_count": 1}),
        ("I love my baby, sorry and thanks", {"affection_count": 2, "apology_count": 1, "gratitude_count": 1, "self_reference_count": 2}),
        ("we always never maybe", {"collective_reference_count": 1, "absolutist_count": 2, "hedge_count": 1}),
        ("عشقم ببخشید ممنونم من ما همیشه شاید", {"affection_count": 1, "apology_count": 1, "gratitude_count": 1, "self_reference_count": 1, "collective_reference_count": 1, "absolutist_count": 1, "hedge_count": 1}),
        ("love love love", {"affection_count": 3}),
        ("", {"word_count": 0, "char_count": 0}),
    ],
)
def test_markers(spark, text, expected):
    row = messages(spark, [("u1", 0, text)]).first()
    assert {name: row[name] for name in expected} == expected


@pytest.mark.parametrize(
    "text, cold, backchannel",
    [
        ("OK!", 1, 1),
        (" Ok. ", 1, 1),
        ("i see...", 0, 1),
        ("ok but what about tuesday", 0, 0),
        ("دقیقاً", 0, 1),
        ("باشه", 1, 1),
        ("o.k", 1, 1),
        ("thx", 1, 0),
        ("", 0, 0),
    ],
)
def test_whole_messages(spark, text, cold, backchannel):
    row = messages(spark, [("u1", 0, text)]).first()
    assert (row["is_cold_closure"], row["is_backchannel"]) == (cold, backchannel)


def test_stretching_is_read_from_raw_text(spark):
    row = messages(spark, [("u1", 0, "sooooo")], normalize=True).first()
    assert (row["normalized_text"], row["elongation_count"], row["char_count"]) == ("soo", 1, 3)


def test_own_lexicon(spark):
    rows = spark.createDataFrame([("affection", "Gezellig"), ("backchannel", "ja hoor")], "category string, token string")
    lexicon = Lexicon.from_dataframe(rows)
    frame = messages(spark, [("u1", 0, "heel gezellig love"), ("u2", 5, "Ja hoor!")]).drop("us")
    found = T.with_features(frame, lexicon).orderBy("msg_id").collect()
    assert found[0]["affection_count"] == 1
    assert found[1]["is_backchannel"] == 1
    assert found[1]["is_cold_closure"] == 0


def test_lexicon_must_be_complete():
    with pytest.raises(ValueError):
        Lexicon(token_markers={"affection": ("x",)})


def test_large_lists_equal_literal_ones(spark):
    said = ["Hey dear friend, sorry sorry!", "ok", "OK!!", "what now", "", "always and never us", "thank you my love", "می دونم باشه", None]
    df = messages(spark, [("u1", i, t) for i, t in enumerate(said)])
    small = with_features(df)
    extra = spark.createDataFrame([("affection", f"word{i}") for i in range(60_000)] + [("affection", "Hey"), ("other", "x"), ("apology", None)], "category string, token string")
    assert with_entry_features(df, default_entries(spark), most=3).orderBy("msg_id").collect() == small.orderBy("msg_id").collect()
    large = with_entry_features(df, default_entries(spark).unionByName(extra))
    assert large.dtypes == small.dtypes
    by = lambda rows: [{**r.asDict(), "affection_count": r["affection_count"] - ("Hey" in (r["text"] or "") and more)} for r in rows.orderBy("msg_id").collect()]
    more = 1
    found = by(large)
    more = 0
    assert found == by(small)
    # Categories that are not given keep their lists.
    alone = with_entry_features(df, extra.where("category = 'affection'"))
    assert [r["apology_count"] for r in alone.orderBy("msg_id").collect()] == [r["apology_count"] for r in small.orderBy("msg_id").collect()]
