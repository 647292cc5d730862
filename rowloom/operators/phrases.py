"""Texts made of words from a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws
from rowloom.functions.values import LATIN_WORDS, phrase
from rowloom.operators.indexing import dense_index
from rowloom.operators.joins import fits_broadcast, lookup


def attach_phrases(df: DataFrame, row: str, words: DataFrame, draws: Draws, column: str, max_words: int = 4) -> DataFrame:
    """Phrases from a vocabulary too large to inline: word numbers are drawn and looked up by join.

    Uniform draws make the join even, whatever the frequency of a word in its source. A vocabulary that may be
    broadcast is looked up word by word beside the row, without a shuffle; a larger one meets the drawn numbers
    alone, and the phrases then meet their rows. Without any word the filler words make the text.
    """
    vocabulary = dense_index(words.select("word").distinct(), ["word"], derived=True)
    n = vocabulary.count
    if n == 0:
        return df.withColumn(column, phrase(draws, column, F.col(row), LATIN_WORDS, 3, 9))
    high = min(n, max_words + 1) - 1 if n > 1 else 1
    size = 1 + F.pmod(draws.at(column, F.col(row)).digits(25, 2), F.lit(high))

    def picked(key: str, slot: Column) -> Column:
        return draws.at(column, F.concat_ws("#", F.col(key).cast("string"), slot.cast("string"))).below(n)

    if fits_broadcast(vocabulary.df, n):
        out, places = df.drop(column), range(max(high, 1))
        out = out.select("*", *[F.when(size > slot, picked(row, F.lit(slot))).alias(f"_at{slot}") for slot in places])
        for slot in places:
            word = vocabulary.df.select(F.col(vocabulary.position).alias(f"_at{slot}"), F.col("word").alias(f"_word{slot}"))
            out = out.join(F.broadcast(word), f"_at{slot}", "left")
        phrases = F.concat_ws(" ", *[f"_word{slot}" for slot in places]).alias(column)
        return out.select(*[c for c in df.columns if c != column], phrases)
    slots = df.select(F.col(row).alias("_row"), F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))).alias("slot"))
    pick = picked("_row", F.col("slot"))
    drawn = slots.withColumn(vocabulary.position, pick)
    named = lookup(drawn, vocabulary.df, [vocabulary.position], right_rows=n, how="inner", even=True)
    phrases = named.groupBy("_row").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("slot", "word"))).getField("word"), " ").alias(column)
    )
    return df.drop(column).join(phrases, df[row] == phrases["_row"]).drop("_row")
