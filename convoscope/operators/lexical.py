"""Vocabulary, moving-average diversity and style matching."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from convoscope.functions.lexicon import DEFAULT_LEXICON, Lexicon
from convoscope.functions.text import analysis_text, style_counts, tokenize, word_count, words_of
from convoscope.operators.arrange import Arranged, arrange, lookup, neighbours, running_sums
from convoscope.operators.timeline import BY_SENDER, with_bursts
from convoscope.params import DEFAULT, Params
from convoscope.session import ship_package

# Fixed value: keeps a category neither side used from dividing by zero.
STYLE_EPSILON = 0.0001


def _with_text(messages: DataFrame) -> DataFrame:
    return messages.withColumn("_text", analysis_text())


def _sender_tokens(messages: DataFrame) -> DataFrame:
    return _with_text(messages).select(*BY_SENDER, F.explode(tokenize(F.col("_text"))).alias("token"))


def token_counts(messages: DataFrame) -> DataFrame:
    """How often each sender used each word; counted map-side before the shuffle."""
    return _sender_tokens(messages).groupBy(*BY_SENDER, "token").agg(F.count("*").alias("uses"))


def vocabulary(messages: DataFrame) -> DataFrame:
    """L2: words, distinct words and their ratio, per chat and sender."""
    return (
        token_counts(messages)
        .groupBy(*BY_SENDER)
        .agg(F.sum("uses").alias("token_count"), F.count("*").alias("unique_count"))
        .withColumn("type_token_ratio", F.col("unique_count") / F.col("token_count"))
    )


def _words(messages: DataFrame) -> Column:
    """The stored word count where there is one, which spares a pass over the text."""
    if "word_count" in messages.columns:
        return F.col("word_count")
    return word_count(F.col("_text"))


def _offsets(messages: DataFrame, params: Params) -> Arranged:
    """Per message, the sender's word position its first word has (``_offset``, from 0).

    Works on narrow rows without the text, so only counts are put in order.
    """
    counted = _with_text(messages).withColumn("_words", _words(messages))
    narrow = [
        name
        for name in ("chat_id", "msg_id", "sender_id", "ts", "us", "slice")
        if name in messages.columns
    ]
    base = arrange(counted.select(*narrow, "_words"), params, ["_words"])
    placed = running_sums(base, {"_upto": "_words"}, "sender_id")
    return placed.having(placed.rows.withColumn("_offset", F.col("_upto") - F.col("_words")))


def token_stream(messages: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """L1: one row per word, with its position among the sender's words in the chat.

    Positions are the words of earlier messages plus the place in this one, so
    words are never numbered by a window of their own.
    """
    offsets = _offsets(messages, params).rows.select("chat_id", "msg_id", "_offset")
    texts = _with_text(messages).select("chat_id", "msg_id", "sender_id", "_text")
    exploded = texts.join(offsets, ["chat_id", "msg_id"]).select(
        "chat_id", "msg_id", "sender_id", "_offset", F.posexplode(tokenize(F.col("_text")))
    )
    return exploded.select(
        "chat_id",
        "msg_id",
        "sender_id",
        (F.col("_offset") + F.col("pos")).alias("position"),
        F.col("col").alias("token"),
    )


def _windows_per_word(messages: DataFrame, params: Params) -> DataFrame:
    """Every word with the number of windows it is the first of its kind in.

    With W = min(500, N) of the sender's N words, a word at position i whose previous
    use is at p comes first in ``min(i, N-W) - max(p+1, i-W+1, 0) + 1`` windows (none if
    negative). Only a use within the last W words matters, so positions are cut into
    buckets, each with the W-1 words before it, and a frequent word is spread over its
    buckets.
    """
    window = params.diversity_window
    size = max(params.tokens_per_bucket, window)
    base = _offsets(messages, params)
    # From the same shuffled rows as the offsets, so the words are counted once.
    totals = base.rows.groupBy(*BY_SENDER).agg(F.max("_upto").alias("_n"))
    places = lookup(
        base.rows.select("chat_id", "msg_id", "sender_id", "_offset"),
        totals,
        BY_SENDER,
        "msg_id",
        base.sliced,
        params,
        base.total,
    ).select("chat_id", "msg_id", "_offset", "_n")
    # Texts move once, on the unique message key, whatever the size of a chat.
    texts = _with_text(messages).select("chat_id", "msg_id", "sender_id", "_text")
    words = (
        texts.join(places, ["chat_id", "msg_id"])
        .select(*BY_SENDER, "_n", "_offset", F.posexplode(tokenize(F.col("_text"))))
        .select(
            *BY_SENDER, "_n", F.col("col").alias("token"), (F.col("_offset") + F.col("pos")).alias("i")
        )
    )
    own = F.expr(f"i div {size}")
    carried = F.col("i") % size > size - window
    buckets = F.when(carried, F.array(own, own + 1)).otherwise(F.array(own))
    spread = words.select("*", F.explode(buckets).alias("_bucket"))
    last_use = F.lag("i").over(
        Window.partitionBy(*BY_SENDER, "_bucket", "token").orderBy("i")
    )
    n, i = F.col("_n"), F.col("i")
    w = F.least(F.lit(window), n)
    first = F.greatest(F.coalesce(F.col("_p"), F.lit(-1)) + 1, i - w + 1, F.lit(0))
    windows = F.greatest(F.least(i, n - w) - first + 1, F.lit(0))
    return (
        spread.withColumn("_p", last_use)
        .filter(F.col("_bucket") == own)
        .select(*BY_SENDER, "token", "_n", windows.alias("_windows"))
    )


def _with_sender_total(base: Arranged) -> DataFrame:
    """Rows of ``_offsets`` with ``_n``, the words of their sender in the chat."""
    rows = base.rows.select("chat_id", "msg_id", "sender_id", "_words", "_offset", "_upto")
    if not base.sliced:
        # The rows of a sender are together already; nothing is read or moved again.
        return rows.withColumn("_n", F.max("_upto").over(Window.partitionBy(*BY_SENDER)))
    totals = base.rows.groupBy(*BY_SENDER).agg(F.max("_upto").alias("_n"))
    return lookup(rows, totals, BY_SENDER, "msg_id", True, base.params, base.total)


def _windows_of(size: int, window: int):
    """What a task makes of one bucket: its words, each with the windows it is first in."""

    def work(key, rows):
        lists = pc.split_pattern(rows.column("_text").combine_chunks().cast(pa.large_string()), " ")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        tokens = lists.flatten().dictionary_encode()
        code = tokens.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        i = np.arange(len(code)) + np.repeat(rows.column("_at").to_numpy() - (ends - lengths), lengths)
        order = np.lexsort((i, code))
        code, i = code[order], i[order]
        last = np.full(len(i), -1, dtype=np.int64)
        again = code[1:] == code[:-1]
        last[1:][again] = i[:-1][again]
        n = rows.column("_n")[0].as_py()
        w = min(window, n)
        first = np.maximum(np.maximum(last + 1, i - w + 1), 0)
        windows = np.maximum(np.minimum(i, n - w) - first + 1, 0)
        own = i // size == key[2].as_py()
        # At most a bucket's words times a window's, which a double holds exactly.
        total = np.bincount(code[own], weights=windows[own], minlength=len(tokens.dictionary)).astype(np.int64)
        found = np.flatnonzero(np.bincount(code[own], minlength=len(tokens.dictionary)))
        some = lambda value, kind: pa.array([value.as_py()] * len(found), kind)
        return pa.table(
            {
                "chat_id": some(key[0], rows.schema.field("chat_id").type),
                "sender_id": some(key[1], rows.schema.field("sender_id").type),
                "token": tokens.dictionary.take(pa.array(found)).cast(pa.string()),
                "_n": pa.array(np.full(len(found), n, dtype=np.int64)),
                "_windows": pa.array(total[found]),
            }
        )

    return work


def _windows_by_bucket(messages: DataFrame, params: Params) -> DataFrame:
    """Each bucket's different words with the number of windows they come first in.

    With W = min(500, N) of the sender's N words, a word at position i whose previous
    use is at p comes first in ``min(i, N-W) - max(p+1, i-W+1, 0) + 1`` windows (none if
    negative). Only a use within the last W words matters, so positions are cut into
    buckets, each with the W-1 words before it. A message goes to its buckets as text, a
    long one in the parts that they need, so no word is a row before it is counted and a
    task holds ``tokens_per_bucket`` words, whatever the size of a chat or a message.
    """
    window = params.diversity_window
    size = max(params.tokens_per_bucket, window)
    places = _with_sender_total(_offsets(messages, params)).where("_words > 0").select(
        "chat_id", "msg_id", "_offset", "_n"
    )
    # Texts move on the unique message key, then to their bucket.
    texts = _with_text(messages).select("chat_id", "msg_id", "sender_id", "_text")
    cut = (
        texts.join(places, ["chat_id", "msg_id"])
        .select(*BY_SENDER, "_n", "_offset", words_of(F.col("_text")).alias("_cut"))
        .withColumn("_end", F.col("_offset") + F.size("_cut"))
        .select("*", F.explode(F.expr(f"sequence(_offset div {size}, (_end + {window - 2}) div {size})")).alias("_bucket"))
        .withColumn("_at", F.greatest(F.col("_offset"), F.col("_bucket") * size - (window - 1)))
        .withColumn("_to", F.least(F.col("_end"), (F.col("_bucket") + 1) * size))
        .where("_to > _at")
    )
    part = F.slice("_cut", (F.col("_at") - F.col("_offset") + 1).cast("int"), (F.col("_to") - F.col("_at")).cast("int"))
    parts = cut.select(*BY_SENDER, "_bucket", "_n", "_at", F.lower(F.array_join(part, " ")).alias("_text"))
    ship_package(messages.sparkSession)
    kinds = {field.name: field.dataType.simpleString() for field in messages.schema}
    return parts.groupBy(*BY_SENDER, "_bucket").applyInArrow(
        _windows_of(size, window),
        f"chat_id {kinds['chat_id']}, sender_id {kinds['sender_id']}, token string, _n bigint, _windows bigint",
    )


def _diversity(window: int) -> Column:
    """Words that come first, summed over windows, by the words all windows hold."""
    n = F.col("token_count")
    w = F.least(F.lit(window), n)
    return F.col("distinct_in_windows") / ((n - w + 1) * w)


def lexical_diversity(messages: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """L3: mean share of distinct words over every window of min(500, N) words."""
    return (
        _windows_per_word(messages, params)
        .groupBy(*BY_SENDER)
        .agg(F.max("_n").alias("token_count"), F.sum("_windows").alias("distinct_in_windows"))
        .withColumn("lexical_diversity", _diversity(params.diversity_window))
    )


def word_profile(messages: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """L2 and L3 from one pass over the words, bucket by bucket in Arrow workers: counts,
    distinct words and diversity. ``lexical_diversity`` alone needs no Python."""
    per_word = (
        _windows_by_bucket(messages, params)
        .groupBy(*BY_SENDER, "token")
        .agg(F.max("_n").alias("_n"), F.sum("_windows").alias("_windows"))
    )
    return (
        per_word.groupBy(*BY_SENDER)
        .agg(
            F.max("_n").alias("token_count"),
            F.count("*").alias("unique_count"),
            F.sum("_windows").alias("distinct_in_windows"),
        )
        .withColumn("lexical_diversity", _diversity(params.diversity_window))
    )


def turn_tokens(
    messages: DataFrame, params: Params = DEFAULT, lexicon: Lexicon = DEFAULT_LEXICON
) -> Arranged:
    """L4: words and function words per turn; turns without a word are dropped.

    Counted per message before the shuffle, so texts stay where they are.
    """
    names = list(lexicon.function_words)
    counted = (
        _with_text(messages)
        .withColumn("_tokens", tokenize(F.col("_text")))
        .withColumn("tokens", F.size("_tokens"))
    )
    listed = tuple(sorted({word for words in lexicon.function_words.values() for word in words}))
    counted = counted.withColumn("_hits", F.filter("_tokens", lambda token: token.isin(*listed)))
    styles = style_counts(F.col("_hits"), lexicon)
    counted = counted.select(
        *[name for name in ("chat_id", "msg_id", "sender_id", "ts", "us", "slice") if name in counted.columns],
        "tokens",
        *[styles[name].alias(name) for name in names],
    )
    turns = with_bursts(counted, params, ["tokens", *names])
    bags = (
        # A turn has one sender; as a key it keeps the aggregation a hash one.
        turns.rows.groupBy("chat_id", "burst_no", "sender_id")
        .agg(
            F.sum("tokens").alias("tokens"),
            *[F.sum(name).alias(name) for name in names],
        )
        .filter("tokens > 0")
    )
    # Turn numbers are dense, so a plain division bounds the turns of a slice.
    return turns.having(
        bags.select(
            "*",
            F.col("burst_no").alias("us"),
            F.col("burst_no").alias("msg_id"),
            *(
                [F.expr(f"burst_no div {params.rows_per_slice}").alias("slice")]
                if turns.sliced
                else []
            ),
        )
    )


def style_pairs(
    messages: DataFrame, params: Params = DEFAULT, lexicon: Lexicon = DEFAULT_LEXICON
) -> DataFrame:
    """Adjacent turns by different senders with their match per category, 0 to 1."""
    names = list(lexicon.function_words)
    turns = turn_tokens(messages, params, lexicon)
    packed = turns.having(
        turns.rows.withColumn("_bag", F.struct("sender_id", "tokens", *names))
    )
    paired = neighbours(packed, {"_other": "_bag"}).rows.filter(
        F.col("_other").isNotNull() & (F.col("_other.sender_id") != F.col("sender_id"))
    )

    def match(name: str) -> Column:
        here = F.col(name) / F.col("tokens")
        there = F.col(f"_other.{name}") / F.col("_other.tokens")
        return F.lit(1.0) - F.abs(there - here) / (there + here + F.lit(STYLE_EPSILON))

    scored = paired.select("chat_id", "burst_no", *[match(name).alias(name) for name in names])
    mean = reduce(lambda a, b: a + b, [F.col(name) for name in names]) / F.lit(len(names))
    return scored.withColumn("score", mean)


def style_matching(
    messages: DataFrame, params: Params = DEFAULT, lexicon: Lexicon = DEFAULT_LEXICON
) -> DataFrame:
    """Mean match of a chat's turn pairs, overall and per category, in percent."""
    names = list(lexicon.function_words)
    return (
        style_pairs(messages, params, lexicon)
        .groupBy("chat_id")
        .agg(
            F.count("*").alias("turn_pairs"),
            (F.avg("score") * 100).alias("lsm_percent"),
            *[(F.avg(name) * 100).alias(name) for name in names],
        )
    )
