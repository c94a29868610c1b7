"""Which strings contain which: an equi-join on a gram of each, then the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.operators.storage import stash

#: Characters of a gram. Shorter strings are found by equal grams of their own length.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct substrings of ``n`` characters; the empty one for 0."""
    if not n:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.expr("cast(array() AS array<string>)"))


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """needle, hay: the pairs of the distinct strings of ``needles`` (needle) and ``hays`` (hay) of which the second contains the
    first. An empty needle is in every string, a null is in none and contains none.

    A needle meets only the hays that have the gram of its own that fewest of them have. Grams that no needle has are left
    out of the count of hays, so the shuffle is of the hays' grams at most."""
    ns = needles.filter("needle IS NOT NULL").select("needle").distinct()
    hs = hays.filter("hay IS NOT NULL").select("hay").distinct()
    short, long = ns.filter(F.length("needle") < GRAM), ns.filter(F.length("needle") >= GRAM)
    few = F.flatten(F.array(*[_grams(F.col("hay"), n) for n in range(GRAM)]))
    exact = hs.select("hay", F.explode(few).alias("needle")).join(short, "needle").select("needle", "hay")
    own = long.select("needle", F.explode(_grams(F.col("needle"), GRAM)).alias("gram"))
    theirs = hs.select("hay", F.explode(_grams(F.col("hay"), GRAM)).alias("gram"))
    counts = theirs.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r"))
    met = rarest.filter("r.n > 0").select("needle", F.col("r.gram").alias("gram")).join(theirs, "gram")
    return exact.unionByName(met.filter(F.contains("hay", "needle")).select("needle", "hay"))


def first_units(elements: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """key, unit_id: units of each key's elements, enough for its first ``limit``. ``elements`` (hay, unit_id) may have one hay
    in a third of its rows; no key needs more than the first ``limit`` units of a hay, which are picked before the shuffle."""
    first = elements.distinct().withColumn("_n", F.row_number().over(W.partitionBy("hay").orderBy("unit_id"))).filter(F.col("_n") <= limit)
    return first.join(pairs, "hay").select("key", "unit_id").distinct()


def named_units(units: DataFrame, hits: DataFrame, most_broadcast: int = 1 << 20) -> DataFrame:
    """The ``units`` (id) that ``hits`` (unit_id) name. Up to ``most_broadcast`` of them are broadcast, so that texts of all
    others end where they are read."""
    ids = stash(hits.select(F.col("unit_id").alias("id")).distinct())
    return units.join(F.broadcast(ids) if ids.count() <= most_broadcast else ids, "id", "left_semi")
