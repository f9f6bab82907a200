"""Text -> fixed-length model-input arrays.

All array shaping is per row with built-in array functions (``slice``,
``concat``, ``array_repeat``), so it is narrow and needs no shuffle. The two
shuffles are the vocabulary build (token counts with map-side partial
aggregation) and the token -> id join, which is keyed by token; the re-collect
after that join groups at most ``max_len`` rows per sequence.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from moodspark import catalog as cat
from moodspark.functions import text as tx
from moodspark.operators.ordering import global_index

# Vocabulary ids 0..8 are reserved for the special tokens, in this order.
SPECIALS = [cat.LM_PAD, cat.UNK_TOKEN, cat.CLS, cat.SEP, cat.Q_TOKEN, cat.A_TOKEN,
            cat.EOS_TOKEN, cat.MASK_TOKEN, cat.SENT_TOKEN]
PAD_ID, UNK_ID = 0, 1
HOT_TOKENS = 1000


def special_id(token: str) -> int:
    return SPECIALS.index(token)


def tokens_long(df: DataFrame, key_cols: list[str], tokens: Column) -> DataFrame:
    """Q1: one row per token: (keys..., pos (1-based), token)."""
    return df.select(*key_cols, F.posexplode(tokens).alias("pos", "token")) \
        .select(*key_cols, (F.col("pos") + 1).cast("int").alias("pos"), "token")


def build_vocab(tokens: DataFrame, token_col: str = "token", min_count: int = 1) -> DataFrame:
    """Q2 vocab: specials first, then tokens by count desc, token asc.

    (token, token_id, n). Counting is a partial+final hash aggregate; ids are
    a distributed dense index (no single-partition window).
    """
    spark = tokens.sparkSession
    counts = (tokens.where(~F.col(token_col).isin(SPECIALS)).groupBy(F.col(token_col).alias("token"))
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))
    ranked = global_index(counts, [F.col("n").desc(), F.col("token")], "_r")
    words = ranked.select("token", (F.col("_r") + len(SPECIALS)).cast("int").alias("token_id"), "n")
    specials = spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, token_id int, n bigint")
    return specials.unionByName(words)


def encode_ids(tokens: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """Q2: token -> id, unknown -> ``UNK_ID``.

    Ids follow frequency, so the ``HOT_TOKENS`` smallest ids are the hot
    tokens: a table of that fixed size is broadcast and maps them where they
    are. Only the tail is shuffled to meet the rest of the vocabulary.
    """
    first_rest = len(SPECIALS) + HOT_TOKENS
    hot = F.broadcast(vocab.where(F.col("token_id") < first_rest).select(F.col("token").alias("_ht"), F.col("token_id").alias("_hid")))
    rest = vocab.where(F.col("token_id") >= first_rest).select(F.col("token").alias("_vt"), F.col("token_id").alias("_vid"))
    kept = list(tokens.columns)
    mapped = tokens.join(hot, F.col(token_col) == F.col("_ht"), "left").drop("_ht")
    front = mapped.where(F.col("_hid").isNotNull() | F.col(token_col).isNull())
    tail = mapped.where(F.col("_hid").isNull() & F.col(token_col).isNotNull()).join(rest, F.col(token_col) == F.col("_vt"), "left")
    return (front.select(*kept, F.coalesce("_hid", F.lit(UNK_ID)).cast("int").alias("token_id"))
            .unionAll(tail.select(*kept, F.coalesce("_vid", F.lit(UNK_ID)).cast("int").alias("token_id"))))


def ids_array(df: DataFrame, key_cols: list[str], token_arr: str, vocab: DataFrame, out_col: str = "ids",
              carry_cols: list[str] | None = None) -> DataFrame:
    """Map a per-row token array to an id array: explode -> join -> ordered re-collect.

    Returns (keys..., carry..., ids). ``carry_cols`` (small columns) ride
    through the aggregate instead of a join back to the input, and
    ``posexplode_outer`` keeps rows whose array is empty (ids = []).
    """
    carry = carry_cols or []
    exploded = df.select(*key_cols, *carry, F.posexplode_outer(F.col(token_arr)).alias("pos", "token"))
    encoded = encode_ids(exploded, vocab).withColumn(
        "token_id", F.when(F.col("token").isNotNull(), F.col("token_id")))
    return encoded.groupBy(*key_cols, *carry).agg(
        F.sort_array(F.collect_list(F.when(F.col("token_id").isNotNull(), F.struct("pos", "token_id"))))
        .alias("_s")).select(*key_cols, *carry, F.col("_s.token_id").alias(out_col))


def pad_to(arr: Column, length: int, pad: int) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(arr), F.lit(0))))


def encode_single(tokens: Column, max_len: int = 64) -> Column:
    """Q3 token part: keep the first ``max_len - 2`` tokens, wrap in CLS/SEP."""
    kept = F.slice(tokens, 1, max_len - 2)
    return F.concat(F.array(F.lit(cat.CLS)), kept, F.array(F.lit(cat.SEP)))


def leading_tokens(text: Column, n: int) -> Column:
    """The first ``n`` whitespace tokens without splitting the rest of the text.

    ``split`` with a limit leaves the remainder in the last piece; separators
    are whole whitespace runs, so only a leading empty piece can occur, and
    ``n + 2`` pieces always hold the first ``n`` real tokens.
    """
    pieces = F.split(text, tx.TOKEN_SPLIT_RE, n + 2)
    return F.slice(F.filter(pieces, lambda x: x != F.lit("")), 1, n)


def attention_mask(valid_length: Column, max_len: int) -> Column:
    """Q5: ``valid_length`` ones, then zeros, ``max_len`` long."""
    return F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: F.when(i <= valid_length, 1).otherwise(0))


def qa_tokens(q: Column, a: Column, label: Column | None = None) -> tuple[Column, Column]:
    """X1-X3 + Q1: question/answer token arrays of the LM template.

    Special tokens are kept as separate tokens; ``label`` (training form)
    is appended after ``<unused1>``, omitted in the inference form.
    """
    q_parts = [F.array(F.lit(cat.Q_TOKEN)), tx.whitespace_tokens(tx.punct_space(q)), F.array(F.lit(cat.SENT_TOKEN))]
    if label is not None:
        q_parts.append(F.array(label.cast("string")))
    a_parts = [F.array(F.lit(cat.A_TOKEN)), tx.whitespace_tokens(tx.punct_space(a)), F.array(F.lit(cat.EOS_TOKEN))]
    return F.concat(*q_parts), F.concat(*a_parts)


def qa_truncate(df: DataFrame, q_tok: str, a_tok: str, max_len: int = 60) -> DataFrame:
    """Q6: budget truncation of the source's dataset class.

    If the question alone reaches ``max_len`` it keeps its last
    ``max_len // 2`` tokens (losing ``<usr>``); the answer then keeps its
    first ``max_len - q_len`` tokens (possibly losing ``</s>``).
    """
    half = max_len // 2
    q_len0 = F.size(q_tok)
    q_cut = F.when(q_len0 >= max_len, F.slice(q_tok, F.greatest(q_len0 - half + 1, F.lit(1)), half)) \
        .otherwise(F.col(q_tok))
    out = df.withColumn("q_trunc", q_cut)
    out = out.withColumn("a_trunc", F.slice(a_tok, 1, F.lit(max_len) - F.size("q_trunc")))
    return out.withColumn("q_len", F.size("q_trunc")).withColumn("a_len", F.size("a_trunc"))


def qa_targets(df: DataFrame, ids_col: str, max_len: int = 60) -> DataFrame:
    """Q7/Q8: ``token_ids, mask, labels_ids, attention_mask`` from ``ids`` = ids(q ++ a).

    labels = mask_id x q_len ++ a[1:], padded; loss mask and attention mask
    = 1 on question and answer, 0 on padding.
    """
    ids = F.col(ids_col)
    mask_id = special_id(cat.MASK_TOKEN)
    labels = F.concat(F.array_repeat(F.lit(mask_id), F.col("q_len")),
                      F.slice(ids, F.col("q_len") + 2, F.greatest(F.col("a_len") - 1, F.lit(0))))
    ones = F.col("q_len") + F.col("a_len")
    used = F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.lit(max_len) - ones))
    return (df.withColumn("token_ids", pad_to(ids, max_len, PAD_ID))
            .withColumn("labels_ids", pad_to(labels, max_len, PAD_ID))
            .withColumn("mask", used).withColumn("attention_mask", used))


def masked_positions(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per position that counts: (keys, pos, token_id, label_id); padding never counts (quirk 12)."""
    cells = df.select(*key_cols, F.posexplode(F.arrays_zip("token_ids", "labels_ids", "mask")).alias("pos", "z"))
    return cells.where("z.mask = 1").select(*key_cols, "pos", F.col("z.token_ids").alias("token_id"), F.col("z.labels_ids").alias("label_id"))


def assign_batches(df: DataFrame, order_cols: list[str], batch_size: int) -> DataFrame:
    """Dense row index in order, then ``batch_id = idx // batch_size``."""
    idx = global_index(df, order_cols, "row_idx")
    return idx.withColumn("batch_id", F.floor(F.col("row_idx") / F.lit(batch_size)).cast("bigint"))


def collate(batched: DataFrame, fields: list[str], batch_col: str = "batch_id", order_col: str = "row_idx") -> DataFrame:
    """Q9: stack rows of a batch in order (a group holds at most one batch)."""
    return batched.groupBy(batch_col).agg(
        F.sort_array(F.collect_list(F.struct(order_col, *fields))).alias("rows"),
        F.count(F.lit(1)).alias("n_rows"))


def seeded_shuffle(df: DataFrame, key_col: str, seed: int) -> DataFrame:
    """T5: partitioning-independent shuffle order: sort by a keyed digest."""
    return df.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string"))))
