"""Join of texts by the similarity of their trigrams, without comparing all with all.

Two sets whose Jaccard similarity reaches the threshold differ in size by no more than that factor, and of their members in
any one order the first few of both meet: of a set of n, one more than may be missing. So with those trigrams first that
the fewest sets of the left side have, texts are dealt by the few rare ones at the front of their sets; pairs that meet
there are verified by their whole sets. Equal sets are one set until the end. Trigrams are made once, of the right side
only for texts that are not too long for any set of the left side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import may_have_few_trigrams, trigrams
from quillmark.session import cut, spread

#: Trigrams of all sets of the left side up to which they are sent to all executors, so that pairs are not dealt out.
SENT = 1 << 18


def _rows(rows: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """(id, set, grams) of the rows that have any trigrams, and no more than `most` of them: sorted, as one string."""
    own = spread(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), "id")
    # made once, after the rows are dealt: a filter would be tried before that, and what it asks for made again
    short = F.lit(True) if most is None else may_have_few_trigrams(F.col("text"), most)
    own = own.select("id", F.explode(F.when(short, F.array(trigrams(F.col("text"))))).alias("grams")).filter(F.size("grams").between(1, most or 2**31 - 1))
    own = own.select("id", F.array_join(F.array_sort("grams"), "\x00").alias("grams"))
    return own.select("id", F.unhex(F.md5("grams")).alias("set"), "grams")


def _sets(rows: DataFrame) -> DataFrame:
    """(set, grams, n) of each different set of trigrams, dealt by set over all cores."""
    own = spread(rows.groupBy("set").agg(F.first("grams").alias("grams")), "set").withColumn("grams", F.split("grams", "\x00"))
    return own.withColumn("n", F.size("grams"))


def _fronts(sets: DataFrame, known: DataFrame, threshold: float, s: str) -> DataFrame:
    """(gram, s, n_s, own_s, at_s): each set's rarest trigrams, of which similar sets must share one, with their places and all
    that are known (gram, count, number) in this order. The rarest are those that are not known: they meet nothing."""
    dealt = sets.select("set", "n", F.explode("grams").alias("gram")).join(known, "gram")
    own = dealt.groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("count", "number"))).alias("own"))
    own = own.select("set", "n", F.explode(F.array(F.col("own.number"))).alias("own"))
    more = (F.size("own") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    front = own.filter(more > 0).select("set", "n", "own", F.posexplode(F.slice("own", F.lit(1), more)).alias("place", "gram"))
    return front.select("gram", F.col("set").alias(s), F.col("n").alias(f"n_{s}"), F.col("own").alias(f"own_{s}"), (F.col("n") - F.size("own") + F.col("place") + 1).alias(f"at_{s}"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def similar(left: DataFrame, right: DataFrame, threshold: float, key: tuple[str, str] = ("left_id", "right_id"), text: tuple[str, str] = ("content", "content")) -> DataFrame:
    """All pairs of a row of left and one of right (key, text) whose trigrams' similarity is threshold or more: the two
    keys and similarity. Nulls and texts without trigrams are similar to nothing."""
    in_a = cut(_rows(left, key[0], text[0]))
    a = cut(_sets(in_a))
    least, most, total = a.agg(F.min("n"), F.max("n"), F.sum("n")).first()
    if least is None:
        return left.limit(0).select(F.col(key[0]).alias(key[0]), F.lit(None).cast(right.schema[key[1]].dataType).alias(key[1]), F.lit(None).cast("double").alias("similarity"))
    in_b = cut(_rows(right, key[1], text[1], math.floor(most / threshold + 1e-9)))  # longer and shorter ones meet none
    b = _sets(in_b).filter(F.col("n") >= least * threshold - 1e-9)
    sent = F.broadcast if total <= SENT else lambda df: df
    known = cut(a.select(F.explode("grams").alias("gram")).groupBy("gram").count().withColumn("number", F.monotonically_increasing_id()))
    met = _fronts(b, sent(known), threshold, "r").join(sent(_fronts(a, sent(known), threshold, "l")), "gram")
    # what is left behind the first place where they meet must do for the overlap that the threshold asks for
    enough = F.lit(threshold / (1 + threshold)) * (F.col("n_l") + F.col("n_r")) - 1e-9
    met = met.filter((F.col("n_l") >= F.col("n_r") * threshold - 1e-9) & (F.col("n_r") >= F.col("n_l") * threshold - 1e-9))
    met = met.filter(1 + F.least(F.col("n_l") - F.col("at_l"), F.col("n_r") - F.col("at_r")) >= enough)
    both = met.select("l", "r", "n_l", "n_r", "gram", F.explode(F.array(F.array_intersect("own_l", "own_r"))).alias("both"))
    first = both.filter(F.get("both", F.lit(0)) == F.col("gram"))  # the order of both sides: a pair counts where it meets first
    good = first.select("l", "r", (F.size("both") / (F.col("n_l") + F.col("n_r") - F.size("both"))).alias("similarity")).filter(F.col("similarity") >= threshold)
    rows = good.join(sent(in_a.select(F.col("id").alias(key[0]), F.col("set").alias("l"))), "l").join(in_b.select(F.col("id").alias(key[1]), F.col("set").alias("r")), "r")
    return rows.select(*key, "similarity")
