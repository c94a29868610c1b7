"""Sets of keys with a bounded size, gathered by Spark and broadcast as prefilters."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .words import Bits

#: Bits for each key, so that about one foreign key in BITS_A_KEY passes, and the most and least bits as powers of two.
#: A set has at most 2 ** 29 bits (64 MB in a task; the driver gets 2 ** 23 rows of 12 bytes): beyond 16 million keys more
#: foreign ones pass, which costs work but changes no result, as what passes is decided exactly afterwards.
BITS_A_KEY, LEAST_LOG2, MOST_LOG2 = 32, 16, 29


def size_for(n_keys: int) -> int:
    """The power of two of bits for so many keys."""
    return min(MOST_LOG2, max(LEAST_LOG2, (max(1, n_keys) * BITS_A_KEY - 1).bit_length()))


def gather_bits(keys: DataFrame, log2: int | None = None) -> Broadcast:
    """Broadcast Bits of the only column, a well-mixed long, of ``keys``; sized by their number unless ``log2`` is given."""
    name, keys = keys.columns[0], stash(keys)
    log2 = size_for(keys.count()) if log2 is None else log2
    at = F.col(name).bitwiseAND(F.lit((1 << log2) - 1))
    words = keys.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast({name} & 63 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = Bits(log2, found.column("word").to_numpy(), found.column("bits").to_numpy())
    return keys.sparkSession.sparkContext.broadcast(bits)
