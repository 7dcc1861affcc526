"""Operator 4, mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

A token budget goes down a tree of domains, their languages and those's sources. At each node it is dealt to the children
by weight; a child that can't use its part (its texts, repeated at most max_epochs times, are too few) leaves the rest to
its siblings, and only what all of them can't use goes back to the ancestors, because a node's capacity is that of its
leaves. Each leaf then takes whole seeded epochs of its documents and a token-prefix of one more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import cut, meet

TOKEN = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a document's place in an epoch that name its slice of the leaf: 4096 slices share a hot leaf.
SLICE = 3


@dataclass(frozen=True)
class Mixture:
    """share: of all tokens, the budget. Children that have no weight here get `other`; every source weighs the same. What
    weighs 0 gets nothing, whatever others leave.
    """

    share: float = 0.6
    max_epochs: int = 2
    seed: int = 17
    domains: dict[str, int] = field(default_factory=lambda: {"web": 40, "books": 30, "code": 20, "reference": 10})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 60, "fr": 15, "de": 15, "es": 10})
    other: int = 5


def domain_of(source: Column) -> Column:
    """Our domains: sources are numbered, five to a domain; any other source is of domain 'other'."""
    n = F.regexp_extract(source, r"^src(\d{1,9})$", 1).try_cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, ("web", "books", "code", "reference"))), (n / 5).cast("int")), F.lit("other"))


def weight_of(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, w in weights.items():
        out = F.when(name == k, w).otherwise(out)
    return out.cast("double")


def dealt(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `given` to children with columns budget (the parent's), weight and capacity: exact water-filling.

    In order of capacity by weight, children are full as long as their part of what is left covers their capacity.
    """
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(0.0)), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = children.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(onward))
    # without any weight from here on, all are full of nothing
    full = F.when(F.col("weights") > 0, F.col("capacity") <= F.col("weight") * (F.col("budget") - F.col("used")) / F.col("weights")).otherwise(F.lit(True))
    out = out.withColumn("full", full)
    group = Window.partitionBy(*parent)
    out = out.withColumn("full_sum", F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0))).withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(group))
    part = F.floor(F.when(F.col("open_weight") > 0, F.col("weight") * (F.col("budget") - F.col("full_sum")) / F.col("open_weight")).otherwise(F.lit(0.0))).cast("long")
    return out.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("used", "weights", "full", "full_sum", "open_weight")


def leaf_plan(base: DataFrame, mixture: Mixture) -> DataFrame:
    """domain, lang, source, docs, available, given, whole (epochs), part (tokens of one more), for every leaf."""
    weighs = (weight_of(F.col("domain"), mixture.domains, mixture.other) > 0) & (weight_of(F.col("lang"), mixture.langs, mixture.other) > 0)
    leaves = base.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("docs")).withColumn("weighs", weighs)
    leaves = cut(leaves.withColumn("capacity", F.when(F.col("weighs"), F.col("available") * mixture.max_epochs).otherwise(F.lit(0).cast("long"))))
    total = leaves.agg(F.sum("available")).first()[0] or 0
    budget = int(total * mixture.share)
    top = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("root", F.lit(0)).withColumn("budget", F.lit(budget).cast("long")).withColumn("weight", weight_of(F.col("domain"), mixture.domains, mixture.other))
    top = dealt(top, ["root"], "domain").select("domain", F.col("given").alias("budget"))
    middle = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(top, "domain").withColumn("weight", weight_of(F.col("lang"), mixture.langs, mixture.other))
    middle = dealt(middle, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    plan = dealt(leaves.join(middle, ["domain", "lang"]).withColumn("weight", F.lit(1.0)), ["domain", "lang"], "source")
    whole = F.when(~F.col("weighs"), F.lit(0)).when(F.col("available") > 0, F.floor(F.col("given") / F.col("available"))).otherwise(F.lit(1)).cast("long")
    return plan.select("domain", "lang", "source", "docs", "available", "given", whole.alias("whole"), (F.col("given") - whole * F.col("available")).alias("part"))


def mix(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The chosen documents: doc_id, domain, lang, source, n_tokens, epochs (how often the mixture repeats the document).

    A token is a word between white space. Documents are taken whole: of the last, partial epoch those whose middle lies
    within the leaf's part, so a leaf misses its budget by half a document at most. Null or empty texts have no token and
    come with their leaf's whole epochs; null languages and sources are called 'unknown'; a null doc_id has a place of its
    own. Rows that repeat a doc_id are rows like others. An empty table gives none. Other columns are ignored.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("domain"), name("lang"), name("source"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("n_tokens"))
    base = cut(base)
    leaf = ["domain", "lang", "source"]
    planned = meet(base, cut(leaf_plan(base, mixture)), leaf, "docs", base.count())
    key = F.md5(F.concat_ws("|", F.lit(str(mixture.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    # a leaf's slices go to different tasks
    planned = planned.withColumn("key", key).withColumn("slice", F.substring("key", 1, SLICE)).repartition(*leaf, "slice")
    within = Window.partitionBy(*leaf, "slice").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = planned.withColumn("within", F.sum("n_tokens").over(within))
    slices = planned.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    earlier = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*leaf, "slice", F.coalesce(F.sum("slice_tokens").over(earlier), F.lit(0)).alias("earlier"))
    placed = running.join(slices, [*leaf, "slice"])
    chosen = F.when((F.col("part") > 0) & (2 * (F.col("earlier") + F.col("within")) - F.col("n_tokens") <= 2 * F.col("part")), 1).otherwise(0)
    return placed.select("doc_id", *leaf, "n_tokens", (F.col("whole") + chosen).cast("long").alias("epochs")).filter("epochs > 0")


def oracle(mixture: Mixture = Mixture()) -> str:
    """The same in DuckDB's SQL."""
    case = lambda c, w: f"CASE {c} {' '.join(f"WHEN '{k}' THEN {v}.0" for k, v in w.items())} ELSE {mixture.other}.0 END::DOUBLE"

    def deal(rows: str, parent: str, name: str) -> str:
        return f"""SELECT *, CASE WHEN is_full THEN capacity ELSE CAST(floor(weight * (budget - full_sum) / open_weight) AS BIGINT) END AS given FROM (
    SELECT *, coalesce(sum(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY {parent}), 0)::BIGINT AS full_sum, sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {parent}) AS open_weight FROM (
      SELECT *, capacity <= weight * (budget - used) / weights AS is_full FROM (
        SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
               sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
        FROM ({rows}))))"""

    return f"""
WITH base AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]{{1,9}}$') AND CAST(substr(source, 4) AS INTEGER) < 20 THEN ['web', 'books', 'code', 'reference'][CAST(substr(source, 4) AS INTEGER) // 5 + 1] ELSE 'other' END AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available, (sum(n_tokens) * {mixture.max_epochs})::BIGINT AS capacity FROM base GROUP BY ALL
), top AS (
  {deal(f"SELECT domain, sum(capacity)::BIGINT AS capacity, 0 AS root, (SELECT CAST(floor(sum(available) * {mixture.share}::DOUBLE) AS BIGINT) FROM leaves) AS budget, {case('domain', mixture.domains)} AS weight FROM leaves GROUP BY domain", "root", "domain")}
), middle AS (
  {deal(f"SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, any_value(t.given) AS budget, {case('l.lang', mixture.langs)} AS weight FROM leaves l JOIN top t USING (domain) GROUP BY l.domain, l.lang", "domain", "lang")}
), plan AS (
  {deal("SELECT l.domain, l.lang, l.source, l.available, l.capacity, m.given AS budget, 1.0::DOUBLE AS weight FROM leaves l JOIN middle m ON l.domain = m.domain AND l.lang = m.lang", "domain, lang", "source")}
), leaf AS (
  SELECT domain, lang, source, whole, given - whole * available AS part FROM (SELECT *, CASE WHEN available > 0 THEN given // available ELSE 1 END AS whole FROM plan)
), placed AS (
  SELECT b.*, whole, part, sum(n_tokens) OVER (PARTITION BY b.domain, b.lang, b.source ORDER BY md5('{mixture.seed}|' || whole || '|' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS running
  FROM base b JOIN leaf l ON b.domain = l.domain AND b.lang = l.lang AND b.source = l.source
)
SELECT * FROM (SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN part > 0 AND 2 * running - n_tokens <= 2 * part THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM placed) WHERE epochs > 0
"""
