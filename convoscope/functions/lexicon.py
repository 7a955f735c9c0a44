"""Word lists behind the marker counts, and the lexicon a caller may pass instead.

The lists are data: pass your own :class:`Lexicon` (or build one from a
DataFrame of ``category, token``) to count other words or other languages.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

# Word lists that decide what is counted, so results agree.

#: Whole-message acknowledgements that invest little.
LOW_INVESTMENT = (
    "k", "ok", "kk", "cool", "yeah", "yup", "lol", "nice",
    "fine", "sure", "alright", "nm", "idk", "thx", "ty", "np",
    "اوکی", "اوک", "باشه", "مرسی", "ممنون", "خب", "اره", "آره", "نه", "نوچ",
)

AFFECTION = (
    "love", "loved", "loves", "loving", "miss", "missed", "missing",
    "babe", "baby", "honey", "darling", "sweetheart", "sweetie", "dear",
    "hug", "hugs", "kiss", "kisses", "xoxo", "cutie", "beautiful",
    "عشق", "عشقم", "عزیزم", "عزیز", "جانم", "جونم", "نفسم", "زندگیم",
    "قربونت", "قربانت", "فدات", "فدایت", "دلم", "دلتنگ", "دوستت",
    "بوس", "بوسه", "ماچ", "بغل", "گلم", "خوشگلم", "جیگرم", "نازم",
)

APOLOGY = (
    "sorry", "apologize", "apologise", "apologies", "apology",
    "forgive", "regret", "fault",
    "ببخشید", "ببخش", "معذرت", "شرمنده", "عذر", "عذرخواهی",
    "متاسفم", "متأسفم",
)

GRATITUDE = (
    "thanks", "thank", "thx", "ty", "grateful", "gratitude",
    "appreciate", "appreciated", "appreciation",
    "مرسی", "ممنون", "ممنونم", "متشکرم", "تشکر", "سپاس", "سپاسگزارم",
)

SELF_REFERENCE = (
    "i", "me", "my", "mine", "myself", "im", "ive",
    "من", "منو", "منم", "خودم", "بهم", "برام", "واسم", "باهام", "ازم",
)

COLLECTIVE_REFERENCE = (
    "we", "us", "our", "ours", "ourselves", "weve",
    "ما", "مارو", "خودمون", "بهمون", "برامون", "واسمون", "باهامون",
    "ازمون", "باهم", "دوتامون",
)

ABSOLUTIST = (
    "absolutely", "all", "always", "complete", "completely", "constant",
    "constantly", "definitely", "entire", "entirely", "ever", "every",
    "everyone", "everything", "full", "must", "never", "nothing",
    "totally", "whole",
    "همیشه", "هیچوقت", "هرگز", "اصلا", "قطعا",
    "کاملا", "مطلقا", "تماما", "همه",
    "هیچی", "هیچ", "حتما", "باید", "دائما", "همیشگی",
)

HEDGE = (
    "maybe", "perhaps", "probably", "possibly", "guess", "might",
    "suppose", "kinda", "kind", "sorta", "sort", "somewhat",
    "apparently", "seemingly", "presumably", "arguably", "ish",
    "شاید", "احتمالا", "احتمال", "ظاهرا",
    "انگار", "انگاری", "نظرم", "فکر", "فک", "گمونم", "گمان",
    "تقریبا", "یجورایی", "نمیدونم",
)

#: Whole-message validations; entries may hold two words.
BACKCHANNEL = (
    "ok", "okay", "k", "kk", "yeah", "yep", "yup", "yes", "sure",
    "alright", "right", "true", "exactly", "aha", "ah", "ahh", "oh",
    "i see", "gotcha", "mhm", "hmm", "cool", "nice", "same",
    "اره", "آره", "اوکی", "اوک", "باشه", "درسته", "دقیقا",
    "حتما", "اهان", "آهان", "اها", "آها", "خب", "خوبه",
    "ایول", "موافقم", "همینطوره", "بله",
)

QUESTION_WORDS = (
    "what", "why", "how", "when", "where", "who", "whom", "whose",
    "which", "whats", "hows", "wheres",
    "چرا", "چطور", "چطوری", "چگونه", "کی", "کجا", "کجاست",
    "چیه", "چیست", "چی", "چه", "آیا", "ایا", "چند", "چقدر",
    "کدوم", "کدام", "مگه", "مگر", "هان",
)

PERSONAL_PRONOUNS = (
    "i", "me", "my", "mine", "myself", "im", "ive", "we", "us", "our",
    "ours", "you", "your", "yours", "he", "him", "his", "she", "her",
    "hers", "they", "them", "their", "theirs",
    "من", "منو", "منم", "ما", "مارو", "تو", "توئه", "شما", "او", "اون",
    "اونا", "آنها", "ایشون", "خودم", "خودت", "خودش", "خودمون",
)

IMPERSONAL_PRONOUNS = (
    "it", "its", "this", "that", "these", "those", "something",
    "anything", "everything", "nothing", "one", "some", "which",
    "این", "اون", "آن", "اینا", "اونا", "همین", "همون", "چیزی",
    "هیچی", "یچیزی",
)

ARTICLES = ("a", "an", "the", "یه", "یک")

PREPOSITIONS = (
    "in", "on", "at", "to", "for", "with", "from", "by", "about",
    "of", "into", "over", "under", "after", "before", "between",
    "در", "به", "از", "با", "برای", "تا", "روی", "زیر", "بین",
    "بعد", "قبل", "پیش", "سمت", "طرف", "واسه", "رو",
)

AUXILIARY_VERBS = (
    "am", "is", "are", "was", "were", "be", "been", "being", "do",
    "does", "did", "have", "has", "had", "will", "would", "can",
    "could", "should", "shall", "may", "might", "must",
    "هست", "هستم", "هستی", "هستیم", "بود", "بودم", "بودی", "باشه",
    "باشد", "شد", "شده", "میشه", "باید", "بشه", "داره",
    "دارم", "داری", "داشت", "کرد", "کنم", "کنی", "کنه",
)

ADVERBS = (
    "very", "really", "just", "so", "too", "also", "now", "then",
    "here", "there", "still", "already", "again", "always", "never",
    "خیلی", "واقعا", "فقط", "هم", "الان", "حالا", "بعدش",
    "اینجا", "اونجا", "هنوز", "دیگه", "باز", "همیشه", "هیچوقت", "کلا",
)

CONJUNCTIONS = (
    "and", "but", "or", "so", "because", "if", "when", "while",
    "although", "though", "than", "that", "as",
    "و", "ولی", "اما", "یا", "چون", "اگه", "اگر", "وقتی", "که",
    "پس", "هرچند", "بلکه", "تااینکه",
)

NEGATIONS = (
    "no", "not", "never", "none", "nobody", "nothing", "nowhere",
    "cant", "dont", "didnt", "wont", "isnt", "arent", "wasnt",
    "نه", "نیست", "نیستم", "نداره", "ندارم", "نکن", "نمیشه",
    "نمیدونم", "هیچ", "هیچی", "نخیر",
)

QUANTIFIERS = (
    "all", "some", "any", "many", "much", "more", "most", "few",
    "little", "lot", "lots", "every", "each", "both", "half",
    "همه", "بعضی", "خیلی", "چندتا", "چند", "کم", "زیاد", "بیشتر",
    "کمتر", "هرکدوم", "هردو", "نصف", "تعدادی",
)

#: Categories a token is counted under when it occurs anywhere in a message.
TOKEN_MARKERS: Mapping[str, tuple[str, ...]] = {
    "affection": AFFECTION,
    "apology": APOLOGY,
    "gratitude": GRATITUDE,
    "self_reference": SELF_REFERENCE,
    "collective_reference": COLLECTIVE_REFERENCE,
    "absolutist": ABSOLUTIST,
    "hedge": HEDGE,
}

#: Categories style matching compares.
FUNCTION_WORDS: Mapping[str, tuple[str, ...]] = {
    "personal_pronouns": PERSONAL_PRONOUNS,
    "impersonal_pronouns": IMPERSONAL_PRONOUNS,
    "articles": ARTICLES,
    "prepositions": PREPOSITIONS,
    "auxiliary_verbs": AUXILIARY_VERBS,
    "adverbs": ADVERBS,
    "conjunctions": CONJUNCTIONS,
    "negations": NEGATIONS,
    "quantifiers": QUANTIFIERS,
}

#: A lexicon travels inside the plan as literal sets, so its size is checked; larger ones
#: stay a table (``operators.markers``).
MAX_WORDS = 50_000


@dataclass(frozen=True)
class Lexicon:
    low_investment: tuple[str, ...] = LOW_INVESTMENT
    backchannel: tuple[str, ...] = BACKCHANNEL
    question_words: tuple[str, ...] = QUESTION_WORDS
    token_markers: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(TOKEN_MARKERS))
    function_words: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(FUNCTION_WORDS)
    )

    def __post_init__(self) -> None:
        size = len(self.low_investment) + len(self.backchannel) + len(self.question_words)
        for group in (self.token_markers, self.function_words):
            size += sum(len(words) for words in group.values())
        if size > MAX_WORDS:
            raise ValueError(f"a lexicon holds at most {MAX_WORDS} words, got {size}")
        missing = set(TOKEN_MARKERS) - set(self.token_markers)
        missing |= set(FUNCTION_WORDS) - set(self.function_words)
        if missing:
            raise ValueError(f"lexicon lacks categories: {sorted(missing)}")

    @classmethod
    def from_dataframe(cls, df: DataFrame) -> "Lexicon":
        """Build from rows of ``category, token``; absent categories keep the default.

        The row count is checked against :data:`MAX_WORDS` before anything is
        brought to the driver.
        """
        rows = df.select("category", F.lower("token").alias("token")).distinct()
        found = rows.limit(MAX_WORDS + 1).collect()
        if len(found) > MAX_WORDS:
            raise ValueError(f"a lexicon holds at most {MAX_WORDS} words")
        words: dict[str, list[str]] = {}
        for row in found:
            words.setdefault(row["category"], []).append(row["token"])

        def pick(name: str, default: tuple[str, ...]) -> tuple[str, ...]:
            return tuple(sorted(words[name])) if name in words else default

        return cls(
            low_investment=pick("low_investment", LOW_INVESTMENT),
            backchannel=pick("backchannel", BACKCHANNEL),
            question_words=pick("question_words", QUESTION_WORDS),
            token_markers={name: pick(name, words_) for name, words_ in TOKEN_MARKERS.items()},
            function_words={name: pick(name, words_) for name, words_ in FUNCTION_WORDS.items()},
        )


DEFAULT_LEXICON = Lexicon()
