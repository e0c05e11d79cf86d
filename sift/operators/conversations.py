"""H1-H9: conversation operators over ``turns(conv_id, turn, role, text)``.

Scale rule: one conversation may hold a large share of all rows, so nothing
here sorts a whole conversation in one task.

* Neighbour and sliding-window look-ups (H1, H3, H4) are equi-joins on
  ``(conv_id, position + d)``, where a message's position is its rank in the
  conversation (see ``positions``): "next" is the next row, whatever the gaps
  between turn numbers.  Every key is unique, so no key is hot.
* Ranks go by the digits of the turn number (16 bits each): counts by digit are
  prefix-summed level by level, so that no window holds more than 65,536 groups
  whether turns are dense, sparse (timestamps) or both.
* "Last N" (H2) is ``row_number() <= N``, which Catalyst limits inside each
  partition before the shuffle (WindowGroupLimit).
* Running sums (H5) are two-level over positions: per-block totals, then a
  prefix over blocks, then a prefix inside each block.
* Per-conversation counts and word statistics are aggregates with map-side
  partial aggregation.

Defined order: messages of a conversation go by turn; equal turns by role and
text (rows equal in all of these are interchangeable), messages without a turn
come last, in the order of a hash of role and text.  Messages without a
conversation id belong to no conversation and are left out.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions.text import WS, py_strip, words

CONV, TURN = "conv_id", "turn"
PAGE = 100          # messages per rendered transcript page (H6)
BLOCK = 1 << 16     # messages per block for two-level running sums (H5)
DIGIT = 16          # bits of a digit of the rank's radix


def positions(turns: DataFrame, out: str = "_pos") -> DataFrame:
    """0-based place of each message in its conversation by the defined order."""
    return _rank_in_conv(turns, TURN, out, ("role", "text"))


def next_message(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, next_role, next_text)``: each message with the one after it, or nulls."""
    return _with_next(turns).drop("_pos")


def _with_next(turns: DataFrame) -> DataFrame:
    t = positions(turns.select(CONV, TURN, "role", "text"))
    nxt = t.select(CONV, (F.col("_pos") - 1).alias("_pos"), F.col("role").alias("next_role"), F.col("text").alias("next_text"))
    return t.join(nxt, [CONV, "_pos"], "left")


def render(role, text) -> Column:
    return F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))


def exchanges(turns: DataFrame) -> DataFrame:
    """H1: a user message and the assistant message right after it.

    ``(conv_id, q_turn, exchange_no, question, answer)``; ``exchange_no``
    counts exchanges from 0 in turn order (a running count of user→assistant
    pairs, computed with the same keyed join, not a per-conversation sort).
    """
    pairs = (_with_next(turns).filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
             .select(CONV, F.col(TURN).alias("q_turn"), F.col("text").alias("question"), F.col("next_text").alias("answer"), "_pos"))
    # exchange number = number of earlier pairs; pairs never overlap, so inside a
    # conversation it is the rank by the question's position
    return _rank_in_conv(pairs, "_pos", "exchange_no").drop("_pos")


def _rank_in_conv(df: DataFrame, order_col: str, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """0-based rank of ``order_col`` (an integral number or a timestamp) inside each conversation, by radix.

    The order key's upper three digits are prefix-summed over counts; only rows
    that share them (consecutive turns, at most 65,536 different ones) meet in a window.
    """
    key = F.col(order_col)
    if isinstance(df.schema[order_col].dataType, (T.TimestampType, T.TimestampNTZType)):
        key = F.unix_micros(key.cast("timestamp"))
    last = key.isNull()  # rows without a turn are spread by their content
    place = F.coalesce(key.cast("long"), F.xxhash64(*ties) if ties else F.lit(0).cast("long"))
    rows = df.withColumns({"_last": last, "_d1": F.shiftright(place, DIGIT)})
    keys = [CONV, "_last", "_d3", "_d2", "_d1"]
    counts = rows.groupBy(CONV, "_last", "_d1").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_d2": F.shiftright("_d1", DIGIT), "_d3": F.shiftright("_d1", 2 * DIGIT)})
    before = None
    for level in (5, 4, 3):  # rows of earlier groups within the group of the level above
        c = counts.groupBy(*keys[:level]).agg(F.sum("_n").alias("_n")) if level < 5 else counts
        up = keys[:1] if level == 3 else keys[:level - 1]
        w = Window.partitionBy(*up).orderBy(*([keys[1], keys[2]] if level == 3 else [keys[level - 1]])).rowsBetween(Window.unboundedPreceding, -1)
        c = c.select(*keys[:level], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_o{level}"))
        before = c if before is None else before.join(c, keys[:level])
    offset = before.select(CONV, "_last", "_d1", (F.col("_o5") + F.col("_o4") + F.col("_o3")).alias("_off"))
    w = Window.partitionBy(CONV, "_last", "_d1").orderBy(order_col, *([F.xxhash64(*ties)] if ties else []), *ties)
    inner = rows.withColumn("_in", F.row_number().over(w) - 1)
    return inner.join(offset, [CONV, "_last", "_d1"]).withColumn(out, (F.col("_off") + F.col("_in")).cast("long")).drop("_last", "_d1", "_in", "_off")


def tail_history(turns: DataFrame, n: int) -> DataFrame:
    """H2: the last ``n`` messages of each conversation."""
    tie = F.xxhash64("role", "text")
    w = Window.partitionBy(CONV).orderBy(F.col(TURN).desc_nulls_first(), tie.desc(), F.desc("role"), F.desc("text"))
    return turns.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _window_behind(df: DataFrame, key: str, n: int, payload: Column, out_prefix: str,
                   targets: DataFrame | None = None) -> DataFrame:
    """For each target row (default: every row), the rows with ``key`` in ``[key-n, key-1]`` of its conversation.

    Targets name the ``n`` places they look back at (keys only) and are joined
    on (conv_id, key) — unique keys, so no hot join key; every output group has
    at most ``n`` members.
    """
    src = df.select(CONV, F.col(key).alias("_src"), payload.alias("_pl"))
    back = F.explode(F.sequence(F.lit(1), F.lit(n)))
    fan = (df if targets is None else targets).select(CONV, key, back.alias("_d")).withColumn("_src", F.col(key) - F.col("_d"))
    g = fan.join(src, [CONV, "_src"], "left").groupBy(CONV, key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_pl").isNotNull(), F.struct("_src", "_pl")))).alias("_w"))
    return g.select(CONV, key,
                    F.size("_w").alias(f"{out_prefix}_size"),
                    F.array_join(F.transform("_w", lambda s: s["_pl"]), "\n").alias(f"{out_prefix}_text"))


def memory_window(ex: DataFrame, k: int) -> DataFrame:
    """H3: at each exchange, the previous ``k`` exchanges (what a k-window memory shows)."""
    payload = F.concat(F.lit("Human: "), F.col("question"), F.lit("\nAI: "), F.col("answer"))
    return _window_behind(ex, "exchange_no", k, payload, "memory")


def history_slice(turns: DataFrame, n: int) -> DataFrame:
    """H4: for each user message (a request), the ``n`` messages right before it."""
    t = positions(turns.select(CONV, TURN, "role", "text"))
    users = t.filter(F.col("role") == "user").select(CONV, "_pos", TURN)
    w = _window_behind(t, "_pos", n, render(F.col("role"), F.col("text")), "history", users)
    return w.join(users, [CONV, "_pos"]).select(CONV, TURN, "history_size", "history_text")


FIRST_SENTENCE_RE = r"(?s)^(.*?[.!?])(?:" + WS + r"|\z)"


def _first_sentence(text) -> Column:
    return F.regexp_extract(text, FIRST_SENTENCE_RE, 1)


def budget_memory(turns: DataFrame, budget: int = 1000, block: int = BLOCK) -> DataFrame:
    """H5: newest messages are kept while their cumulative token count stays within ``budget``.

    Tokens are whitespace words.  Returns per message ``position``, ``tokens``,
    ``newer_tokens`` (inclusive suffix sum) and ``kept``.  Suffix sums are two-level so a long
    conversation is never sorted in one task.
    """
    t = positions(turns).withColumn("tokens", F.greatest(F.size(words(F.col("text"))), F.lit(0)))  # null text: none
    t = t.withColumn("_blk", F.floor(F.col("_pos") / block))
    per_blk = t.groupBy(CONV, "_blk").agg(F.sum("tokens").alias("_bt"))
    after = Window.partitionBy(CONV).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_blk = per_blk.withColumn("_later", F.coalesce(F.sum("_bt").over(after), F.lit(0)))
    inside = Window.partitionBy(CONV, "_blk").orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_in", F.sum("tokens").over(inside))
    t = t.join(per_blk.select(CONV, "_blk", "_later"), [CONV, "_blk"])
    t = t.withColumn("newer_tokens", (F.col("_later") + F.col("_in")).cast("long"))
    return t.withColumn("kept", F.col("newer_tokens") <= budget).withColumnRenamed("_pos", "position").drop("_blk", "_in", "_later")


def memory_summary(budgeted: DataFrame) -> DataFrame:
    """H5 counts per conversation: kept messages / tokens and overflowed messages."""
    return budgeted.groupBy(CONV).agg(
        F.count_if("kept").alias("kept_messages"),
        F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("kept_tokens"),
        F.count_if(~F.col("kept")).alias("overflow_messages"))


def overflow_digest(budgeted: DataFrame, page: int = PAGE) -> DataFrame:
    """H5 overflow text: first sentence of each overflowed message, in turn order,
    one row per page of ``page`` messages (so no row grows with the conversation)."""
    over = budgeted.filter(~F.col("kept")).withColumn("page", F.floor(F.col("position") / page).cast("long"))
    g = over.groupBy(CONV, "page").agg(F.array_sort(F.collect_list(F.struct(
        F.col("position"), F.concat(F.col("role"), F.lit(": "), _first_sentence(F.col("text"))).alias("line"))))
        .alias("_l"))
    return g.select(CONV, "page", F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("summary"))


SENTENCE_RE = r"[^.!?]+[.!?]*"
UNIT = 100          # sentences that are ranked against each other at most


def ranked_digest(budgeted: DataFrame, keep: int = 3, rounds: int = 5, damping: float = 0.85, page: int = PAGE, unit: int = UNIT) -> DataFrame:
    """H5 overflow text by graph ranking: the ``keep`` best sentences of each page of overflowed messages, in their order.

    A page's sentences (in units of ``unit`` at most, so that no array grows with
    the session) are the nodes of a graph whose edges weigh the words two of
    them share, over the sum of their numbers of words.  Ranks come from
    ``rounds`` steps of ``1 - damping + damping * sum(rank * weight / weights)``
    and are compared at 1e-9; of equal ones the earlier sentence is better.
    """
    over = budgeted.filter(~F.col("kept")).withColumn("page", F.floor(F.col("position") / page).cast("long"))
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENTENCE_RE), F.lit(0))
    s = over.select(CONV, "page", "position", F.posexplode(parts).alias("_i", "_s")).withColumn("_s", py_strip("_s")).where(F.length("_s") > 0)
    nth = F.row_number().over(Window.partitionBy(CONV, "page").orderBy("position", "_i")) - 1
    s = s.withColumn("_n", nth).withColumn("unit", F.floor(F.col("_n") / unit).cast("long"))
    g = s.groupBy(CONV, "page", "unit").agg(F.array_sort(F.collect_list(F.struct("_n", "_s"))).alias("_l"))

    def let(value: Column, body) -> Column:  # bound once, however often the body names it
        return F.transform(F.array(value), body)[0]

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def weights(w: Column) -> Column:
        return F.transform(w, lambda a, i: F.transform(w, lambda b, j: F.when(i == j, F.lit(0.0)).otherwise(
            F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)).cast("double"))))

    def shares(m: Column) -> Column:
        return let(F.transform(m, total), lambda d: F.transform(m, lambda row: F.zip_with(row, d, lambda x, t: F.when(t > 0, x / t).otherwise(F.lit(0.0)))))

    def step(p: Column, r: Column) -> Column:
        return F.transform(p, lambda row: F.lit(1 - damping) + F.lit(damping) * total(F.zip_with(row, r, lambda x, y: x * y)))

    sets = F.transform("_l", lambda x: F.array_distinct(words(F.lower(x["_s"]))))
    rank = let(sets, lambda w: let(weights(w), lambda m: let(shares(m), lambda p: F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), F.transform(p, lambda _: F.lit(1.0)), lambda r, _: step(p, r)))))
    best = F.slice(F.array_sort(F.zip_with("_l", rank, lambda x, r: F.struct((-F.round(r, 9)).alias("r"), x["_n"].alias("n"), x["_s"].alias("s")))), 1, keep)
    lines = F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["n"], x["s"]))), lambda x: x["s"])
    return g.select(CONV, "page", "unit", F.array_join(lines, "\n").alias("summary"))


def transcript(turns: DataFrame, page: int = PAGE) -> DataFrame:
    """H6: role-tagged text in turn order, rendered in pages of ``page`` messages."""
    t = positions(turns.select(CONV, TURN, "role", "text")).withColumn("page", F.floor(F.col("_pos") / page).cast("long"))
    g = t.groupBy(CONV, "page").agg(F.array_sort(F.collect_list(
        F.struct(F.col("_pos"), render(F.col("role"), F.col("text")).alias("line")))).alias("_l"))
    return g.select(CONV, "page", F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("transcript"))


def session_insights(turns: DataFrame, terms: Sequence[str] = L.TOPIC_TERMS, top: int = 5,
                     keep: int = 3) -> DataFrame:
    """H7: exchanges (= messages // 2) and up to 3 topics per conversation.

    Topics: the 5 most frequent lower-cased whitespace words of the user's
    messages (ties: first occurrence), then those in ``terms`` or longer than
    4 characters, first 3.  Conversations without messages get 0 and no topics.
    """
    msgs = turns.filter(F.col("role").isin("user", "assistant"))
    n = msgs.groupBy(CONV).agg((F.count(F.lit(1)) / 2).cast("long").alias("total_exchanges"))
    u = msgs.filter(F.col("role") == "user").select(
        CONV, TURN, F.posexplode(words(F.lower(F.col("text")))).alias("pos", "word"))
    wc = u.groupBy(CONV, "word").agg(F.count(F.lit(1)).alias("cnt"),
                                     F.min(F.struct(F.col(TURN), F.col("pos"))).alias("first"))
    r = wc.withColumn("_r", F.row_number().over(
        Window.partitionBy(CONV).orderBy(F.col("cnt").desc(), F.col("first")))).filter(F.col("_r") <= top)
    r = r.filter(F.col("word").isin(*terms) | (F.length("word") > 4))
    r = r.withColumn("_r2", F.row_number().over(Window.partitionBy(CONV).orderBy("_r"))).filter(F.col("_r2") <= keep)
    topics = r.groupBy(CONV).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r2", "word"))), lambda s: s["word"]), ", ").alias("common_topics"))
    convs = turns.select(CONV).distinct()
    return (convs.join(n, CONV, "left").join(topics, CONV, "left")
                 .select(CONV, F.coalesce("total_exchanges", F.lit(0)).alias("total_exchanges"),
                         F.coalesce("common_topics", F.lit("")).alias("common_topics")))


def session_summary(insights: DataFrame) -> DataFrame:
    """H8: the end-of-session line for every conversation."""
    return insights.select(CONV, F.concat(
        F.lit("exchanges: "), F.col("total_exchanges").cast("string"),
        F.lit("; topics: "), F.when(F.col("common_topics") == "", F.lit("none")).otherwise(F.col("common_topics"))
    ).alias("summary"))


def global_topics(turns: DataFrame, k: int = 20) -> DataFrame:
    """H9: the ``k`` most frequent user words across all conversations (ties: word)."""
    u = turns.filter(F.col("role") == "user").select(F.explode(words(F.lower(F.col("text")))).alias("word"))
    return u.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "word").limit(k)
