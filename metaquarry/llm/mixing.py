"""Mixing sources to target weights: hierarchical budgets over a tree of domain, language and source.

A budget of tokens goes down the tree by the children's weights. What a child can't use (its documents' tokens, over
at most max_epochs epochs) goes to its siblings in proportion to their weights before anything goes back to its
parent, since a node asks for no more than all below it can give: at each node, shares are filled to one common level
per weight. All of it is integers, so the shares add up to the budget exactly.

A leaf then gives its documents in seeded epochs: each epoch orders them by md5(seed:epoch:doc_id), and the leaf takes
the shortest prefix of the epochs with at least its budget of tokens. Only the last epoch is cut, and where it is cut
shows from sums over 4096 parts of the order and the rows of one such part, so no task holds a leaf.

DataFrame operations only. Defined results: a null text has no tokens; a text without tokens is taken in no epoch; a
null domain, language or source is a group of its own, after the others; repeated rows are documents each by itself (equal doc_ids keep one
place in the order and are taken or left together); an empty table gives no rows; columns of the input keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.llm.common import looked_up, renamed, stored

SEED = 17
MAX_EPOCHS = 2
#: The budget: so many hundredths of all tokens.
PERCENT = 80
WORDS = r"[^\x20\x09-\x0D]+"
PART_DIGITS = 3  # of the order's hexadecimal digits: 4096 parts


def n_words(text: Column) -> Column:
    """Tokens as the budgets count them: words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children: parent columns, name, weight, cap, budget (the parent's). Adds `given`: what each child gets.

    In ascending order of cap / weight a child is full if a level of that height for all later ones is affordable."""
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight"))
    w = Window.partitionBy(*parent).orderBy(F.col("ratio").asc_nulls_last(), F.col(name).asc_nulls_last())
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    rows = (
        children.withColumn("ratio", ratio)
        .withColumn("w_all", F.sum("weight").over(whole))
        .withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("c_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("full", (F.col("weight") > 0) & (_wide(F.col("cap")) * (F.col("w_all") - F.col("w_before")) + _wide(F.col("c_before")) * F.col("weight") <= _wide(F.col("budget")) * F.col("weight")))
        .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
        .withColumn("b_open", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
        .withColumn("w_upto", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    level = lambda upto: F.expr(f"coalesce(cast((cast(b_open as decimal(38,0)) * {upto}) div nullif(w_open, 0) as bigint), 0)")
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level("w_upto") - level("(w_upto - weight)")))
    return rows.withColumn("given", given).select(*children.columns, "given")


def budgets(leaves: DataFrame, weights: dict[str, str], percent: int, max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds `budget`, the tokens that each leaf gives. weights has an SQL expression by level."""

    def level(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", F.expr(weights[keys[-1]]).cast("long"))

    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    top = level(leaves, ["domain"]).withColumn("one", F.lit(1))
    every = Window.partitionBy("one")  # one row for each domain
    asked = F.sum("tokens").over(every).cast("decimal(38,0)") * percent
    top = top.withColumn("asked", asked).withColumn("budget", F.least(F.expr("asked div 100"), F.sum("cap").over(every)))
    top = share_out(top, ["one"], "domain")
    given, keys = top.select("domain", F.col("given").alias("budget")), ["domain"]
    for name in ("lang", "source"):
        below = level(leaves, [*keys, name])
        below = looked_up(below, given, keys)
        keys = [*keys, name]
        given = share_out(below, keys[:-1], name).select(*keys, F.col("given").alias("budget"))
    return looked_up(leaves, given, keys).drop("cap")


def mix(docs: DataFrame, domain: Column, weights: dict[str, str], percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document and epoch taken: doc_id, domain, lang, source, n_tokens, epoch, and leaf_budget.

    weights: for each level (domain, lang, source) an SQL expression of integers over the columns down to it."""
    slim, _ = stored(
        docs.select(F.col("doc_id").cast("long"), domain.alias("domain"), F.col("lang"), F.col("source"), n_words(F.col("text").cast("string")).alias("n_tokens")).where("n_tokens > 0"), "sizes"
    )
    leaf = ["domain", "lang", "source"]
    plan = budgets(slim.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), weights, percent, max_epochs)
    plan = plan.withColumn("whole", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    plan, _ = stored(plan, "budgets")
    rows = looked_up(slim, plan.drop("tokens"), leaf)
    full = rows.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, cast(whole - 1 as int))")))
    last = rows.where("rest > 0").withColumn("epoch", F.col("whole").cast("int"))
    last = last.withColumn("key", order_key(seed, F.col("epoch"), F.col("doc_id"))).withColumn("part", F.col("key").substr(1, PART_DIGITS))
    parts = last.groupBy(*leaf, "part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = looked_up(last, parts, [*leaf, "part"])
    inside = own.where("before + n <= rest")  # all of such a part is taken
    edge = own.where("before < rest AND before + n > rest")
    w = Window.partitionBy(*leaf, "part").orderBy("key")
    edge = edge.withColumn("run", F.sum("n_tokens").over(w)).withColumn("run", F.col("run") - F.sum("n_tokens").over(Window.partitionBy(*leaf, "part", "key"))).where("before + run < rest")
    names = ["doc_id", *leaf, "n_tokens", "epoch", F.col("budget").alias("leaf_budget")]
    return full.select(*names).unionByName(inside.select(*names)).unionByName(edge.select(*names))


def oracle(domain_sql: str, weight_sql: dict[str, str], percent: int, max_epochs: int, seed: int) -> str:
    """The same rows in SQL."""

    def fill(name: str, keys: list[str], parent: str, budget: str) -> str:
        part = f"PARTITION BY {', '.join(keys[:-1])}" if keys[:-1] else ""
        join = f"JOIN {parent} b ON " + " AND ".join(f"n.{k} IS NOT DISTINCT FROM b.{k}" for k in keys[:-1]) if keys[:-1] else f"CROSS JOIN {parent} b"
        order = f"ORDER BY ratio ASC NULLS LAST, {keys[-1]} ASC NULLS LAST"
        return f"""
 {name}_n AS (SELECT {", ".join(keys)}, sum(cap) AS cap, CAST({weight_sql[keys[-1]]} AS BIGINT) AS weight FROM leaves GROUP BY {", ".join(keys)}),
 {name}_r AS (SELECT n.*, b.{budget} AS budget, CASE WHEN weight > 0 THEN CAST(n.cap AS DOUBLE) / weight END AS ratio FROM {name}_n n {join}),
 {name}_w AS (SELECT *, sum(weight) OVER ({part}) AS w_all,
   coalesce(sum(weight) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
   coalesce(sum(cap) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before FROM {name}_r),
 {name}_f AS (SELECT *, weight > 0 AND CAST(cap AS HUGEINT) * (w_all - w_before) + CAST(c_before AS HUGEINT) * weight <= CAST(budget AS HUGEINT) * weight AS is_full FROM {name}_w),
 {name}_o AS (SELECT *, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) AS w_open,
   budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS b_open,
   sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w_upto FROM {name}_f),
 {name} AS (SELECT {", ".join(keys)}, CASE WHEN is_full THEN cap ELSE least(cap, coalesce(CAST(b_open AS HUGEINT) * w_upto // nullif(w_open, 0), 0)
   - coalesce(CAST(b_open AS HUGEINT) * (w_upto - weight) // nullif(w_open, 0), 0)) END AS given FROM {name}_o)"""

    same = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in ("domain", "lang", "source"))
    return f"""
WITH sizes AS (SELECT * FROM (SELECT doc_id, {domain_sql} AS domain, lang, source,
   len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents) WHERE n_tokens > 0),
 leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {max_epochs} AS cap FROM sizes GROUP BY ALL),
 asked AS (SELECT least(CAST(sum(tokens) AS HUGEINT) * {percent} // 100, sum(cap)) AS given FROM leaves),
 {fill("top", ["domain"], "asked", "given")},
 {fill("mid", ["domain", "lang"], "top", "given")},
 {fill("low", ["domain", "lang", "source"], "mid", "given")},
 plan AS (SELECT l.*, given AS budget, given // tokens AS whole, given % tokens AS rest FROM leaves l JOIN low ON {same("l", "low")}),
 docs AS (SELECT s.*, p.budget, p.whole, p.rest FROM sizes s JOIN plan p ON {same("s", "p")}),
 cut AS (SELECT *, md5('{seed}:' || CAST(whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS k FROM docs WHERE rest > 0),
 run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
   - sum(n_tokens) OVER (PARTITION BY domain, lang, source, k) AS before FROM cut)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(budget AS BIGINT) AS leaf_budget FROM (
 SELECT doc_id, domain, lang, source, n_tokens, budget, unnest(range(CAST(whole AS BIGINT))) AS epoch FROM docs WHERE whole > 0
 UNION ALL SELECT doc_id, domain, lang, source, n_tokens, budget, whole FROM run WHERE before < rest)
"""


def kept(docs: DataFrame, domain: Column, weights: dict[str, str], **parameters) -> DataFrame:
    """The documents themselves, one row for each epoch that takes them, with the columns of docs alone."""
    taken = mix(docs, domain, weights, **parameters)
    key, times, row = (renamed(docs.columns, x) for x in ("taken_id_", "times_", "epoch_"))
    counts, _ = stored(taken.groupBy(F.col("doc_id").alias(key)).agg(F.countDistinct("epoch").cast("int").alias(times)), "taken")
    own = docs.join(counts, docs["doc_id"].cast("long").eqNullSafe(counts[key])).where(n_words(docs["text"].cast("string")) > 0)
    return own.withColumn(row, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs[c] for c in docs.columns])
