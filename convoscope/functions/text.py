"""Per-message text functions (F1-F17), as column expressions.

A word is a run of letters, digits and underscores; combining marks and the
zero-width non-joiner end a word. Spaces include the Unicode ones.

Persian normalisation covers exactly these rules and claims no more: Arabic
letter forms become Persian ones, Latin and Arabic digits become Persian
digits, short-vowel marks are dropped, and a half-space joins the verb prefixes
``می``/``نمی`` and the suffixes ``ها``, ``های``, ``تر``, ``ترین``, and ``ی`` after
a final ``ه``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from convoscope.functions.lexicon import DEFAULT_LEXICON, Lexicon
from convoscope.schema import DERIVED_COLUMNS

# Patterns, code-point ranges and letter tables.
WORD_CHAR = r"[\p{L}\p{N}_]"
SPACE_CHAR = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
QUESTION_MARK = "[?؟]"
EXCLAMATION_MARK = "[!！]"
LINK = r"(?iu)https?://[^\s\x1c-\x1f\x85\p{Z}]+|www\.[^\s\x1c-\x1f\x85\p{Z}]+|t\.me/[^\s\x1c-\x1f\x85\p{Z}]+"
ELONGATION = r"([\p{L}\p{N}_])\1{2,}"
EMOJI = (
    r"[\x{1F300}-\x{1F3FA}\x{1F400}-\x{1FAFF}\x{1F000}-\x{1F0FF}"
    r"\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"
)
PERSIAN_SCRIPT = r"[\x{0600}-\x{06FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
LATIN_SCRIPT = "[a-zA-Z]"
SCRIPT_DOMINANCE = 2
ARABIC_FORMS = "يىكةۀ" + "0123456789" + "٠١٢٣٤٥٦٧٨٩"
PERSIAN_FORMS = "ییکهه" + "۰۱۲۳۴۵۶۷۸۹" + "۰۱۲۳۴۵۶۷۸۹"
SHORT_VOWELS = r"[\x{064B}-\x{0652}\x{0670}]"
HALF_SPACE = "‌"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE_CHAR}+|{SPACE_CHAR}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE_CHAR[1:]}")


def words_of(text: Column) -> Column:
    """The words of ``text`` in order, as they are written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD_CHAR}+)"), F.lit(1))


def tokenize(text: Column) -> Column:
    """the words of ``text`` in order, lowercased after they are cut."""
    return F.transform(words_of(text), F.lower)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("int")


def word_count(text: Column) -> Column:
    """F2. Needs no token array: word runs are counted in place."""
    return _count(text, f"{WORD_CHAR}+")


def char_count(text: Column) -> Column:
    """code points."""
    return F.length(F.coalesce(text, F.lit(""))).cast("int")


def is_question(raw: Column) -> Column:
    """F4."""
    return F.coalesce(raw, F.lit("")).rlike(QUESTION_MARK)


def exclamation_count(text: Column) -> Column:
    """F5."""
    return _count(text, EXCLAMATION_MARK)


def emoji_count(text: Column) -> Column:
    """one per emoji character; skin tones and variation selectors are not counted.

    Text of one byte per character holds none and is not searched.
    """
    return F.when(F.octet_length(text) > F.length(text), _count(text, EMOJI)).otherwise(0)


def link_count(raw: Column) -> Column:
    """F7. Every link holds a slash or ``www.``, which is cheap to look for first."""
    possible = F.contains(raw, F.lit("/")) | F.contains(F.lower(raw), F.lit("www."))
    return F.when(possible, _count(raw, LINK)).otherwise(0)


def elongation_count(raw: Column) -> Column:
    """F8: runs of three or more of one word character."""
    return _count(raw, ELONGATION)


def members(tokens: Column, words: tuple[str, ...]) -> Column:
    """How many of ``tokens`` are in ``words``, duplicates counted."""
    if not words:
        return F.lit(0)
    return F.size(F.filter(tokens, lambda token: token.isin(*words))).cast("int")


def whole_message_token(text: Column) -> Column:
    """the whole message as one comparable phrase, without punctuation or marks."""
    return F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), NOT_WORD_OR_SPACE, "")


def detect_language(text: Column) -> Column:
    """fa, en, mixed, other or unknown, by the script that dominates.

    Letters are only counted where both scripts occur.
    """
    persian, latin = _count(text, PERSIAN_SCRIPT), _count(text, LATIN_SCRIPT)
    has_persian, has_latin = text.rlike(PERSIAN_SCRIPT), text.rlike(LATIN_SCRIPT)
    return (
        F.when(is_blank(text), "unknown")
        .when(~has_persian, F.when(has_latin, "en").otherwise("other"))
        .when(~has_latin, "fa")
        .when(persian > latin * SCRIPT_DOMINANCE, "fa")
        .when(latin > persian * SCRIPT_DOMINANCE, "en")
        .otherwise("mixed")
    )


def clean(text: Column) -> Column:
    """one space between words, runs of three or more characters cut to two.

    Only spacing that has to change is matched; a single plain space is left alone.
    """
    collapsed = F.regexp_replace(
        F.coalesce(text, F.lit("")), f"{SPACE_CHAR}{{2,}}|[{SPACE_CHAR}&&[^ ]]", " "
    )
    return F.regexp_replace(F.trim(collapsed), r"(.)\1{2,}", "$1$1")


def normalize_persian(text: Column) -> Column:
    """the rules listed in the module docstring, then :func:`clean`."""
    letters = F.translate(F.regexp_replace(text, SHORT_VOWELS, ""), ARABIC_FORMS, PERSIAN_FORMS)
    spaced = clean(letters)
    prefixed = F.regexp_replace(spaced, r"(^| )(ن?می) (?=[\p{L}])", f"$1$2{HALF_SPACE}")
    suffixed = F.regexp_replace(
        prefixed, r"(?<=[\p{L}]) (های?|تر(?:ین)?)(?![\p{L}\p{N}_])", f"{HALF_SPACE}$1"
    )
    return F.regexp_replace(suffixed, r"(?<=[\p{L}]ه) ی(?![\p{L}\p{N}_])", f"{HALF_SPACE}ی")


def normalize(text: Column, language: Column) -> Column:
    """F16: the comparable form of ``text`` given the language it was detected as."""
    return (
        F.when(language == "unknown", "")
        .when(language.isin("fa", "mixed"), normalize_persian(text))
        .when(language == "en", clean(F.lower(text)))
        .otherwise(clean(text))
    )


def analysis_text() -> Column:
    """Q7: the normalised text, or the raw text where there is none."""
    return F.coalesce(
        F.when(F.col("normalized_text") != "", F.col("normalized_text")), F.col("text"), F.lit("")
    )


Normalizer = Callable[[Column, Column], Column]


def with_language(df: DataFrame, normalizer: Normalizer = normalize) -> DataFrame:
    """Add ``language`` and ``normalized_text``; ``normalizer`` is pluggable."""
    return df.withColumn("language", detect_language(F.col("text"))).withColumn(
        "normalized_text", normalizer(F.col("text"), F.col("language"))
    )


def with_features(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Add every derived per-message column; a pure projection without shuffle.

    Tokens are cut once and first narrowed to those in any marker list, so the
    per-category counts look at a handful of tokens rather than all of them.
    """
    markers = lexicon.token_markers
    listed = tuple(sorted({word for words in markers.values() for word in words}))
    # A phrase of n characters has at most n words, so longer messages match none.
    phrases = (*lexicon.low_investment, *lexicon.backchannel)
    longest = max((len(phrase) for phrase in phrases), default=0)
    text, raw = F.col("_text"), F.coalesce(F.col("text"), F.lit(""))
    staged = (
        df.drop(*DERIVED_COLUMNS)
        .withColumn("_text", analysis_text())
        .withColumn("_cut", words_of(text))
        .withColumn("_tokens", F.transform("_cut", F.lower))
        .withColumns(
            {
                "_hits": F.filter("_tokens", lambda token: token.isin(*listed)),
                "_words": F.size("_cut"),
                "_asks": F.exists("_tokens", lambda token: token.isin(*lexicon.question_words)),
                "_question": is_question(raw),
                "_whole": F.when(F.size("_cut") <= longest, whole_message_token(text)).otherwise(
                    F.lit(None)
                ),
            }
        )
    )
    hits, whole = F.col("_hits"), F.col("_whole")
    columns = {
        "word_count": F.col("_words"),
        "char_count": char_count(text),
        "is_question": F.col("_question").cast("int"),
        "is_cold_closure": F.coalesce(whole.isin(*lexicon.low_investment), F.lit(False)).cast("int"),
        "is_interrogative": (F.col("_question") | F.col("_asks")).cast("int"),
        "is_backchannel": F.coalesce(whole.isin(*lexicon.backchannel), F.lit(False)).cast("int"),
        "exclamation_count": exclamation_count(text),
        "emoji_count": emoji_count(text),
        "elongation_count": elongation_count(raw),
        "link_count": link_count(raw),
    }
    for name, words in markers.items():
        columns[f"{name}_count"] = members(hits, words)
    ordered = [columns[name].alias(name) for name in DERIVED_COLUMNS]
    return staged.select("*", *ordered).drop(
        "_text", "_cut", "_tokens", "_hits", "_words", "_asks", "_question", "_whole"
    )


def style_counts(tokens: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> dict[str, Column]:
    """Function-word counts per style category over one token array."""
    return {name: members(tokens, words) for name, words in lexicon.function_words.items()}
