"""Mixing sources to target weights by hierarchical budgets over a domain, language and source tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_small, stash, table, text_of

#: The levels of the tree, root first.
LEVELS = ("domain", "lang", "source")
#: Stand-in for a null name of a level.
UNNAMED = "(none)"
#: Weights among siblings by level and name; a name that isn't here weighs 1.
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"web": 3.0, "books": 2.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {"src0": 2.0},
}
SEED = 17
MAX_EPOCHS = 2
#: Tokens to select, as a share of those that the corpus has once.
BUDGET_SHARE = 1.0
#: Hexadecimal digits of the seeded key that name a slice of a leaf: 4096 slices, of which one is ordered by row.
SLICE_DIGITS = 3


#: The domain of each source of the tables of documents; a source that isn't here is of the domain OTHER.
DOMAINS: dict[str, str] = {f"src{i}": "web" if i < 10 else "books" if i < 16 else "forums" for i in range(20)}
OTHER = "other"


def _leaf(domains: Mapping[str, str]) -> Column:
    lang, source = (F.coalesce(F.col(c), F.lit(UNNAMED)) for c in ("lang", "source"))
    listed = F.create_map(*[F.lit(x) for pair in domains.items() for x in pair]) if domains else F.expr("cast(map() AS map<string, string>)")
    return F.struct(F.coalesce(F.try_element_at(listed, source), F.lit(OTHER)).alias("domain"), lang.alias("lang"), source.alias("source"))


def _tokens() -> Column:
    return F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    found = F.lit(1.0)
    for name, weight in weights.get(level, {}).items():
        found = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(found)
    return found


def _poured(children: DataFrame, parent: list[str], level: str, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Split each parent's ``budget`` among its children (with ``cap``) by weight. What a child can't take goes to its
    siblings by weight: in order of cap / weight, children are full until the remaining budget for each weight is less
    than that, and all others get this same rate."""
    order = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = order.orderBy("ratio", level)
    lower, here_on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    rate = (F.col("budget") - F.coalesce(F.sum("cap").over(lower), F.lit(0))) / F.sum("weight").over(here_on)
    whole = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    full = F.col("cap") <= F.col("rate") * F.col("weight")
    return (
        children.withColumn("weight", _weight(level, weights))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("rate", rate)
        .withColumn("level_rate", F.max(F.when(~full, F.col("rate"))).over(whole))
        .withColumn("given", F.when(full, F.col("cap")).otherwise(F.floor(F.col("level_rate") * F.col("weight"))).cast("long"))
        .drop("weight", "ratio", "rate", "level_rate", "budget")
    )


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: Mapping[str, Mapping[str, float]] = WEIGHTS) -> DataFrame:
    """Token budgets of the leaves (domain, lang, source, tokens). A leaf can give its tokens ``max_epochs`` times. A
    shortage goes to siblings first, as a node never gets more than its leaves can give; only the rest of a whole node's
    shortage reaches that node's siblings. Budgets are floored to whole tokens."""
    node = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    budgets: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        children = node.groupBy(*path).agg(F.sum("cap").alias("cap"))
        if budgets is None:
            total = F.least(F.lit(budget).cast("long"), F.sum("cap").over(W.partitionBy(F.lit(0))))
            children = children.withColumn("budget", total)
        else:
            children = children.join(budgets, parent)
        budgets = _poured(children, parent, level, weights).select(*path, F.col("given").alias("budget"))
    return leaves.join(budgets, list(LEVELS))


def leaf_cuts(docs: DataFrame, budget_share: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]], seed: int, domains: Mapping[str, str] = DOMAINS) -> DataFrame:
    """A row a leaf: leaf, budget, full_epochs, cut_key (the first seeded key that the partial epoch leaves out)."""
    slim = stash(docs.select("doc_id", _leaf(domains).alias("leaf"), _tokens().alias("n_tokens")))
    leaves = slim.groupBy("leaf").agg(F.sum("n_tokens").alias("tokens")).select("leaf.*", "tokens")
    leaves = stash(leaves)
    tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    planned = leaf_budgets(leaves, int(tokens * budget_share), max_epochs, weights).select(
        F.struct(*LEVELS).alias("leaf"),
        "budget",
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("int").alias("full_epochs"),
        "tokens",
    )
    planned = stash(planned.withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens")))
    keyed = slim.join(planned.select("leaf", "full_epochs", "rest"), "leaf").withColumn("key", _key(seed, F.col("full_epochs")))
    keyed = keyed.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    lower = W.partitionBy("leaf").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = keyed.groupBy("leaf", "slice").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    # The slice in which the budget ends; a leaf whose budget ends between slices has its cut at the next slice.
    reached = slices.filter("before + n >= rest").groupBy("leaf").agg(F.min(F.struct("slice", "before")).alias("at"))
    reached = reached.select("leaf", "at.*")
    by_key = keyed.join(reached, ["leaf", "slice"]).groupBy("leaf", "key").agg(
        F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    earlier = W.partitionBy("leaf").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    by_key = by_key.withColumn("ahead", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    left_out = by_key.filter("ahead >= rest").groupBy("leaf").agg(F.min("key").alias("cut_key"))
    after = F.concat(F.col("slice"), F.lit("g"))  # above every key of its slice
    return (
        planned.select("leaf", "budget", "full_epochs")
        .join(reached.select("leaf", after.alias("slice_end")), "leaf", "left")
        .join(left_out, "leaf", "left")
        .select("leaf", "budget", "full_epochs", F.coalesce("cut_key", "slice_end", F.lit("")).alias("cut_key"))
    )


def mix(
    docs: DataFrame,
    budget_share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    weights: Mapping[str, Mapping[str, float]] = WEIGHTS,
    seed: int = SEED,
    domains: Mapping[str, str] = DOMAINS,
) -> DataFrame:
    """The columns of ``docs`` (with doc_id, text, lang, source) and mix_domain, mix_tokens, mix_epochs: how often each
    row is selected, 0 for rows that aren't. A column of ``docs`` with such a name is replaced.

    Tokens are words; the domain of a source is looked up in ``domains``. Each leaf gives whole epochs, then the prefix of
    one more epoch in the order of a seeded digest of the id, up to the document that reaches the leaf's budget. Rows with
    the same id are selected together; a null lang or source is a name of its own; a leaf without tokens isn't selected.
    No rows give no rows. Only digests of rows are shuffled: the cut of a leaf is a single key, so texts stay where they
    are read unless there are too many leaves to broadcast.
    """
    cuts = stash(leaf_cuts(docs.select("doc_id", "text", "lang", "source"), budget_share, max_epochs, weights, seed, domains))
    own = docs.select(F.struct(*docs.columns).alias("row"), _leaf(domains).alias("leaf"), _tokens().alias("mix_tokens"), "doc_id")
    joined = join_small(own, cuts, "leaf", 200 * cuts.count(), ["doc_id"], "inner")
    partial = (_key(seed, F.col("full_epochs")) < F.col("cut_key")).cast("int")
    ours = [F.col("leaf.domain").alias("mix_domain"), F.col("mix_tokens"), (F.col("full_epochs") + partial).alias("mix_epochs")]
    return joined.select(*[F.col(f"row.{c}") for c in docs.columns if c not in ("mix_domain", "mix_tokens", "mix_epochs")], *ours)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.filter("mix_epochs > 0").select(
        "doc_id",
        F.col("mix_domain").alias("domain"),
        "lang",
        "source",
        F.col("mix_tokens").alias("n_tokens"),
        F.explode(F.sequence(F.lit(0), F.col("mix_epochs") - 1)).alias("epoch"),
    )


def _sql_level(level: str, path: str, parent: str, parent_table: str | None) -> str:
    weight = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.get(level, {}).items())
    by = f"PARTITION BY {parent}" if parent else ""
    budget = f"JOIN {parent_table} USING ({parent})" if parent_table else "CROSS JOIN (SELECT least(floor(sum(tokens) * %s), sum(tokens) * %d)::BIGINT AS budget FROM leaves)" % (BUDGET_SHARE, MAX_EPOCHS)
    return f"""
{level}_c AS (
  SELECT {path}, cap, budget, CASE {level} {weight} ELSE 1::DOUBLE END AS w
  FROM (SELECT {path}, sum(tokens * {MAX_EPOCHS})::BIGINT AS cap FROM leaves GROUP BY {path}) {budget}
), {level}_r AS (
  SELECT *, (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM {level}_c
), {level}_b AS (
  SELECT {path}, CASE WHEN cap <= rate * w THEN cap
    ELSE floor(max(CASE WHEN NOT cap <= rate * w THEN rate END) OVER ({by}) * w)::BIGINT END AS budget FROM {level}_r
)"""


_domain_cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DOMAINS.items())
SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '{UNNAMED}') AS l, coalesce(source, '{UNNAMED}') AS s,
         CASE source {_domain_cases} ELSE '{OTHER}' END AS dom,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n
  FROM documents
), leaves AS (
  SELECT dom AS domain, l AS lang, s AS source, sum(n)::BIGINT AS tokens FROM d GROUP BY ALL
), {_sql_level("domain", "domain", "", None)}, {_sql_level("lang", "domain, lang", "domain", "domain_b")},
{_sql_level("source", "domain, lang, source", "domain, lang", "lang_b")}, plan AS (
  SELECT *, CASE WHEN tokens > 0 THEN floor(budget / tokens)::BIGINT ELSE 0 END AS full_n
  FROM leaves JOIN source_b USING (domain, lang, source)
), keyed AS (
  SELECT d.*, full_n, budget - full_n * tokens AS rest,
         md5(concat_ws(':', {SEED}, full_n, coalesce(doc_id::VARCHAR, 'null'))) AS k
  FROM d JOIN plan ON dom = plan.domain AND l = plan.lang AND s = plan.source
), run AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY dom, l, s ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS ahead
  FROM keyed
), e AS (
  SELECT *, full_n + CASE WHEN ahead < rest THEN 1 ELSE 0 END AS epochs FROM run
)
SELECT doc_id, dom AS domain, lang, source, n AS n_tokens, unnest(range(epochs))::INTEGER AS epoch FROM e WHERE epochs > 0
"""
