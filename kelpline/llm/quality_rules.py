"""Quality rules: base limits on counts, then robust multivariate outliers by language and source. DataFrame functions
only."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, join_small, stash, table, text_of, words_of

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Printing characters of ASCII that are no letters or digits.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Code points of a short word, and words of a run whose distinct words are counted.
SHORT, RUN = 3, 50
#: The components of a row's vector: log of the mean word length; square roots of capitals and marks for each word, of the
#: share of words that repeat in a run, and of the share of short words. A square root gives counts a spread that doesn't
#: depend on their mean, and none of these is constant in prose.
VECTOR = ["v_word", "v_capital", "v_mark", "v_repeat", "v_short"]
#: A row's deviations are weighed as those of a mean of its words; more words than this count as the differences between
#: texts, which don't shrink with length.
FULL_WORDS = 3_000
#: Share of a group's rows whose covariance has the least determinant; concentration steps end when no log determinant
#: changes by more than STEADY. A warning tells of estimates that aren't steady after MOST_STEPS.
COVERED, STEADY, MOST_STEPS = 0.75, 0.01, 60
#: Rows that an estimate of the level above counts as in a group's: groups are shrunk to their language, these to all.
SHRINK_ROWS = 50
#: Rows of a file of vectors, and levels of a file of a step's estimates (FILES files at least), a row a level of about
#: LEVEL_BYTES.
ROWS_A_FILE, LEVELS_A_FILE, FILES, LEVEL_BYTES = 50_000, 10_000, 8, 400
#: What each variance has more than estimated, as a share: enough for a factor in directions without any spread.
RIDGE = 1e-9
#: Share of normal rows that a group's cut keeps: one clean document in a million goes.
KEPT_SHARE = 0.999999


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with q_words, q_chars, q_symbols, q_dup_lines, q_repeat, q_failed, the components VECTOR and their weight. A
    null or empty text has no words and fails; components of rows that fail may be null."""
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: F.ltrim(line, F.lit(SPACES)) != "")
    triple = F.transform(
        F.sequence(F.lit(0), F.col("q_words").cast("int") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    among = lambda chars: F.length("_other") - F.length(F.translate("_other", chars, ""))
    n_runs = F.floor(F.col("q_words") / RUN).cast("int")
    distinct = lambda i: F.size(F.array_distinct(F.slice("_words", i * RUN + 1, RUN)))
    counted = (
        docs.withColumn("_text", text_of())
        .withColumns({"_words": words_of(F.col("_text")), "_lines": lines})
        .withColumn("_bare", F.array_join("_words", ""))
        # Small letters and digits go in long runs; what is left is short in most texts, and counted character by character.
        .withColumn("_other", F.regexp_replace("_bare", "[a-z0-9]+", ""))
        .withColumns(
            {
                "q_words": F.size("_words").cast("long"),
                "q_chars": F.length("_bare").cast("long"),
                "q_symbols": among(SYMBOLS).cast("long"),
                "_capitals": among(CAPITALS),
                "_marks": among(MARKS),
                "_short": F.size(F.filter("_words", lambda w: F.length(w) <= SHORT)),
                "q_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            }
        )
        .withColumn("_triples", F.when(F.col("q_words") >= 3, triple))
        .withColumn("_runs", F.when(F.col("q_words") >= RUN, F.transform(F.sequence(F.lit(0), n_runs - 1), distinct)))
        .drop("_text", "_bare", "_other", "_words", "_lines")
    )
    placed = F.sort_array(F.transform("_triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_triples")) < F.size("_triples")
    same = lambda a, b: F.get("_placed", a)["h"] == F.get("_placed", b)["h"]
    again = F.filter("_placed", lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    words, chars = F.greatest("q_words", F.lit(1)), F.greatest("q_chars", F.lit(1))
    return (
        counted.withColumn("_placed", F.when(repeats, placed))
        .drop("_triples")
        .withColumn("q_repeat", F.when(F.col("_placed").isNotNull(), F.size(covered)).otherwise(0).cast("long"))
        .withColumns(
            {
                "q_failed": (F.col("q_words") < MIN_WORDS) | (100 * F.col("q_repeat") > 50 * F.col("q_words")),
                "v_word": F.log(chars / words),
                "v_capital": F.sqrt(F.col("_capitals") / words),
                "v_mark": F.sqrt(F.col("_marks") / words),
                "v_repeat": F.sqrt(1 - F.aggregate("_runs", F.lit(0), lambda a, n: a + n) / (F.size("_runs") * RUN)),
                "v_short": F.sqrt(F.col("_short") / words),
                "weight": words * FULL_WORDS / (words + FULL_WORDS),
            }
        )
        .drop("_placed", "_capitals", "_marks", "_short", "_runs")
    )


def _group() -> Column:
    return F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))


def _level(at: int) -> Column:
    """What a row of ``group`` is estimated with: 0 is all rows, 1 its language, 2 the group."""
    lang, source = (F.col("group")[name] if at >= least else F.lit("") for name, least in (("lang", 1), ("source", 2)))
    return F.struct(F.lit(at).alias("level"), lang.alias("lang"), source.alias("source"))


def _below_chi2(x: float, odd: int) -> float:
    """P(chi-square with an odd number of degrees of freedom <= x)."""
    total = term = 1.0
    for k in range(3, odd - 1, 2):
        term *= x / k
        total += term
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total


def chi2_quantile(share: float, p: int = len(VECTOR)) -> float:
    """The value that a chi-square variable with ``p`` (odd) degrees of freedom is below with probability ``share``."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _below_chi2(middle, p) < share else (low, middle)
    return low


#: Squared Mahalanobis distance beyond which a row goes, by the law of normal components rather than fitted to data.
TOO_FAR = chi2_quantile(KEPT_SHARE)


#: What half of the squared distances of normal rows are below.
MIDDLE = chi2_quantile(0.5)
PAIRS = [(a, b) for i, a in enumerate(VECTOR) for b in VECTOR[: i + 1]]


def _shrunk(raw: DataFrame, n_levels: int) -> DataFrame:
    """Level rows (at, n_rows, v) of a written table with the estimates v drawn to those of the level above, by rows."""
    # The level above is told from a row's own, not by constants: those would leave a join without a key.
    lang = F.when(F.col("at.level") == 2, F.col("at.lang")).otherwise(F.lit(""))
    own = raw.withColumn("parent", F.struct((F.col("at.level") - 1).alias("level"), lang.alias("lang"), F.lit("").alias("source")))
    part = F.col("n_rows") / (F.col("n_rows") + SHRINK_ROWS)
    drawn = F.zip_with("v", "up", lambda x, y: part * x + (1 - part) * y)
    levels = [raw.filter("at.level = 0")]
    for level in (1, 2):
        above = levels[-1].select(F.col("at").alias("parent"), F.col("v").alias("up"))
        met = join_small(own.filter(F.col("at.level") == level), above, "parent", LEVEL_BYTES * n_levels, ["at"], "inner")
        levels.append(met.select("at", "n_rows", drawn.alias("v")))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def _cholesky(c: Column) -> Column:
    """The lower triangle, row by row, of the factor of a covariance that is given in this way."""
    start = lambda row: _div(row * (row + 1), F.lit(2)).cast("int")

    def entry(l: Column, place: Column) -> Column:  # noqa: E741
        row, column = place["row"], place["column"]
        own, other = F.slice(l, start(row) + 1, column), F.slice(l, start(column) + 1, column)
        given = F.get(c, F.size(l))
        left = given - F.aggregate(F.zip_with(own, other, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        diagonal = F.sqrt(F.greatest(left + given * RIDGE, given * RIDGE) + 1e-15)
        return F.concat(l, F.array(F.when(row == column, diagonal).otherwise(left / F.get(l, start(column) + column))))

    places = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(j).alias("column")) for i in range(len(VECTOR)) for j in range(i + 1)])
    return F.aggregate(places, F.expr("cast(array() AS array<double>)"), entry)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _factored(moments: DataFrame) -> DataFrame:
    """Level rows with v, the means and the covariances' lower triangle: the means m, its Cholesky factor l, and log_det."""
    p = len(VECTOR)
    found = moments.select("at", "n_rows", F.slice("v", 1, p).alias("m"), _cholesky(F.slice("v", p + 1, len(PAIRS))).alias("l"))
    diagonal = F.filter("l", lambda x, i: F.exists(F.array(*[F.lit(k * (k + 3) // 2) for k in range(p)]), lambda k: k == i))
    return found.withColumn("log_det", 2 * F.aggregate(diagonal, F.lit(0.0), lambda a, x: a + F.log(x)))


def _distance() -> Column:
    """Weighted squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    of = lambda name, i: F.get(name, F.lit(i))
    for k, a in enumerate(VECTOR):
        row = k * (k + 1) // 2
        z.append(sum((-of("l", row + j) * z[j] for j in range(k)), F.col(a) - of("m", k)) / of("l", row + k))
    return F.col("weight") * sum((x * x for x in z), F.lit(0.0))


def _quantile(value: Column | str, share: float) -> Column:
    return F.percentile_approx(value, share, 10_000)


def fit(rows: DataFrame) -> DataFrame:
    """A row for each group (struct of lang and source, null as empty) of ``rows`` with the components VECTOR: means,
    Cholesky factor and scale of its estimate.

    Minimum covariance determinant with weights: from medians and median deviations, concentration steps take the share
    COVERED of rows nearest to the last estimate and estimate means and covariances again, until determinants are steady.
    Groups, languages and all rows are estimated side by side, and each step draws a group's estimate to its language's
    and that to all rows', so that a group of a few rows is judged by what is known of its kind. The scale lets half of
    a group's distances lie below the median of the chi-square law. Rows that fail the base rules teach nothing.

    Levels are summed up before they are shuffled; a step's estimates, a row a level, are written before they are used."""
    # Written before it is filtered: a filter would be pushed down and repeat the statistics in its condition.
    n_files = -(-rows.count() // ROWS_A_FILE)
    vectors = stash(rows.select(_group().alias("group"), "q_failed", "weight", *VECTOR).coalesce(max(1, n_files)))
    passing = vectors.filter("NOT q_failed").select(F.explode(F.array(*map(_level, range(3)))).alias("at"), "weight", *VECTOR)
    middle = stash(passing.groupBy("at").agg(F.count("*").alias("n_rows"), F.array(*[_quantile(c, 0.5) for c in VECTOR]).alias("m")))
    n_levels = middle.count()
    few = lambda levels: stash(levels.coalesce(max(FILES, n_levels // LEVELS_A_FILE)))
    near = lambda estimates: join_small(passing, estimates, "at", LEVEL_BYTES * n_levels, ["weight", *VECTOR], "inner")

    off = [_quantile(F.abs(F.col(c) - F.get("m", F.lit(i))) * F.sqrt("weight"), 0.5) for i, c in enumerate(VECTOR)]
    spread = near(middle.drop("n_rows")).groupBy("at").agg(F.array(*off).alias("d"))
    spreads = [(F.get("d", F.lit(VECTOR.index(a))) * 1.4826) ** 2 if a == b else F.lit(0.0) for a, b in PAIRS]
    first = few(middle.join(spread, "at").select("at", "n_rows", F.concat("m", F.array(*spreads)).alias("v")))
    estimate = few(_factored(_shrunk(first, n_levels)))
    for _ in range(MOST_STEPS):
        far = near(estimate).select("at", "n_rows", "weight", _distance().alias("distance"), *VECTOR)
        edge = far.groupBy("at").agg(_quantile("distance", COVERED).alias("edge"))
        inner = join_small(far, edge, "at", 60 * n_levels, ["weight", *VECTOR], "inner").filter("distance <= edge")
        sums = inner.groupBy("at").agg(
            F.first("n_rows").alias("n_rows"), F.count("*").alias("n"), F.sum("weight").alias("w"),
            F.array(*[F.sum(F.col("weight") * F.col(c)) / F.sum("weight") for c in VECTOR]).alias("m"),
            F.array(*[F.sum(F.col("weight") * F.col(a) * F.col(b)) for a, b in PAIRS]).alias("s"),
        )
        products = F.array(*[F.get("m", F.lit(VECTOR.index(a))) * F.get("m", F.lit(VECTOR.index(b))) for a, b in PAIRS])
        moments = sums.select("at", "n_rows", F.concat("m", F.zip_with("s", products, lambda s, mm: (s - F.col("w") * mm) / F.col("n"))).alias("v"))
        last, estimate = estimate, few(_factored(_shrunk(few(moments), n_levels)))
        moved = estimate.join(last.select("at", F.col("log_det").alias("last")), "at").agg(F.max(F.abs(F.col("log_det") - F.col("last"))).alias("by")).first()["by"]
        if moved is None or moved <= STEADY:
            break
    else:
        warnings.warn(f"estimates moved by {moved} in the last of {MOST_STEPS} steps", stacklevel=2)
    scale = few(near(estimate).groupBy("at").agg(F.first("n_rows").alias("n_rows"), F.array(_quantile(_distance(), 0.5) / MIDDLE).alias("v")))
    held = estimate.drop("n_rows", "log_det").join(_shrunk(scale, n_levels).select("at", F.get("v", F.lit(0)).alias("scale")), "at").filter("at.level = 2")
    return few(held.withColumn("group", F.struct("at.lang", "at.source")).drop("at"))


def judge(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with q_distance and q_kept: not failed, and within TOO_FAR of its group's estimate. Every passing row has
    a distance."""
    held = estimates.withColumnRenamed("group", "_group")
    judged = join_small(rows.withColumn("_group", _group()), held, "_group", LEVEL_BYTES * held.count(), ["weight", *VECTOR])
    judged = judged.withColumn("q_distance", _distance() / F.greatest("scale", F.lit(1e-12)))
    near = F.coalesce(F.col("q_distance") <= TOO_FAR, F.lit(False))
    # One condition on both sides of the join, so that no part of it is pushed below the statistics.
    against = F.greatest(F.col("q_failed").cast("int"), (~near).cast("int"))
    return judged.withColumn("q_kept", against == 0).drop("_group", "scale", "m", "l")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` (with text, lang, source), with its columns. A null text fails, a null lang or source is a
    name of its own, repeated rows are each judged, and no rows give none. Rows are written once with their statistics,
    and texts aren't shuffled: only the estimates come back to them."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source")
    rows = stash(statistics(own).drop("text"))
    return judge(rows, fit(rows)).filter("q_kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = stash(statistics(docs).drop("text"))
    return judge(rows, fit(rows)).select(
        "doc_id",
        F.col("q_words").alias("n_words"),
        F.col("q_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat").alias("n_repeat_words"),
        F.col("q_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
        "q_distance",
    )
