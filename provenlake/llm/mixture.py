"""Mixing sources to target weights by hierarchical budgeting.

Sources stand in a tree: domain, language, source. The token budget runs down the tree by weight. A
child can take no more than it holds times the most epochs allowed; what it can't take goes to its
siblings, by weight, and only what none of them can take goes to the level above. Each leaf then
takes whole epochs while they fit, and of the next epoch, in an order of its own drawn from the seed,
the longest prefix within what is left.

No task ever orders a whole leaf: an epoch's order is cut into ``BUCKETS`` slots of the order's hash,
tokens are summed per leaf and slot, and only the slot in which a leaf's prefix ends is ordered.

Defined results: null text has no tokens; null domain, language or source is a child of its own, named
``(none)``; a child without a named weight has the least named one above 0; an empty text costs nothing and is
taken with the prefix that reaches it; rows of one leaf with equal ids, or without an id and with equal texts,
share their place and are taken together or not at all; a weight of 0, or a budget of 0, gives no tokens; an empty table gives an empty result; further columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import durable, quoted, words

BUCKETS = 4096
#: Budgets are whole tokens; so much may be lost by rounding before they are cut.
NOISE = 1e-6
#: Up to so many leaves their rows are broadcast, and no text is shuffled. Beyond that, rows meet copies of their leaf's row, so that a leaf with very many rows is spread over tasks.
BROADCAST_LEAVES = 20_000
SALTS = 32
#: The production tree: which sources make up which domain, and the weights. Sources not named are in the last domain.
DOMAINS = {"crawl": ["src0"], "books": [f"src{i}" for i in range(1, 10)]}
OTHER_DOMAIN = "forums"
DOMAIN_WEIGHTS = {"crawl": 0.5, "books": 0.3, "forums": 0.2}
LANG_WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
LEAF = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    out = F.lit(OTHER_DOMAIN)
    for domain, members in DOMAINS.items():
        out = F.when(source.isin(members), domain).otherwise(out)
    return F.when(source.isNull(), "(none)").otherwise(out)


def _weight(of: Column, weights: dict[str, float] | None) -> Column:
    """The weight of a child; 1 for all if there are no weights. One not named has the least weight above 0 that is named."""
    if weights is None:
        return F.lit(1.0)
    out = F.lit(float(min((w for w in weights.values() if w > 0), default=1.0)))
    for name, w in weights.items():
        out = F.when(of == name, float(w)).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget``: what each child gets of its parent's ``given``.

    children: parent's columns, given, weight, capacity. A child is full if the budget reaches its
    ratio of capacity to weight while all with a higher ratio still take part; the rest is dealt by
    weight among those not full. With the children in the order of that ratio, running sums tell.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    df = children.withColumn("ratio", ratio)
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("ratio").asc_nulls_last(), "child")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As decimals, weights have exact running sums: what follows is the total less what came before.
    df = df.withColumn("exact", F.col("weight").cast("decimal(28,18)"))
    used, left = before("capacity"), (F.sum("exact").over(by) - before("exact")).cast("double")
    df = df.withColumn("full", F.coalesce(F.col("given") >= used + F.col("ratio") * left, F.lit(False)))
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    dealt = F.when(F.col("full"), F.col("capacity")).when(F.col("weight") > 0, F.greatest((F.col("given") - spent) * F.col("weight") / open_weight, F.lit(0.0))).otherwise(0.0)
    return df.withColumn("budget", F.least(dealt, F.col("capacity"))).drop("ratio", "full", "exact")


def leaf_budgets(leaves: DataFrame, budget: float, max_epochs: int, domain_weights=None, lang_weights=None, source_weights=None) -> DataFrame:
    """domain, lang, source, tokens, budget (whole tokens). leaves: domain, lang, source, tokens; budget: a share of all tokens."""
    ways = ((["domain"], domain_weights), (["domain", "lang"], lang_weights), (list(LEAF), source_weights))
    open_path = F.lit(True)
    for level, weights in ways:
        open_path = open_path & (_weight(F.col(level[-1]), weights) > 0)
    # A leaf below a weight of 0 can take nothing, so it is no room that its parents could be given tokens for.
    df = leaves.withColumn("capacity", F.when(open_path, F.col("tokens").cast("double") * max_epochs).otherwise(0.0))
    total = df.agg((F.sum("tokens") * F.lit(float(budget))).alias("given")).withColumn("root", F.lit(1))
    above, parent = total, ["root"]
    df = df.withColumn("root", F.lit(1))
    for level, weights in ways:
        name = level[-1]
        nodes = df.groupBy("root", *level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("child", F.col(name)).withColumn("weight", F.when(F.col("capacity") > 0, _weight(F.col(name), weights)).otherwise(0.0))
        dealt = share_out(nodes.join(above.select(*parent, "given"), parent), parent)
        above, parent = dealt.select("root", *level, F.col("budget").alias("given")), ["root", *level]
    return df.join(above, parent).select(*LEAF, "tokens", F.floor(F.col("given") + NOISE).cast("long").alias("budget"))


def mixed(docs: DataFrame, budget: float = 0.5, max_epochs: int = 3, seed: int = 42, domain: Column | None = None, domain_weights=None, lang_weights=None, source_weights=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """rec (a struct of the kept columns), domain, lang, source, n_tokens, copies (times the document is taken)."""
    keep = docs.columns if keep is None else keep
    named = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    domain = domain_of(quoted(source_col)) if domain is None else domain
    rows = docs.select(
        F.struct(*[quoted(c) for c in keep]).alias("rec"), F.coalesce(quoted(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64(quoted(text_col)).cast("string"))).alias("id"), named(domain).alias("domain"), named(quoted(lang_col)).alias("lang"),
        named(quoted(source_col)).alias("source"), F.size(words(quoted(text_col))).cast("long").alias("n_tokens"),
    )
    if set(keep) <= {id_col, lang_col, source_col}:
        rows = durable(rows)  # slim rows: texts are read once
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    leaves = durable(leaf_budgets(leaves, budget, max_epochs, domain_weights, lang_weights, source_weights))
    few = leaves.count() <= broadcast_leaves
    leaves = leaves.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))

    def placed(part: DataFrame, about: DataFrame) -> DataFrame:
        """Rows with what is known of their leaf, and their place in the epoch that is cut."""
        if few:
            met = part.join(F.broadcast(about), list(LEAF))  # at most BROADCAST_LEAVES rows, as counted
        else:
            salted = about.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = part.withColumn("salt", F.pmod(F.xxhash64("id", "n_tokens"), F.lit(SALTS)).cast("int")).join(salted, [*LEAF, "salt"])
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("id")))
        return met.withColumn("place", key).withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))

    sums = placed(rows.select("id", *LEAF, "n_tokens"), leaves.select(*LEAF, "epochs", "rest")).groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    crossed = sums.withColumn("upto", upto).where("upto > rest").groupBy(*LEAF).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before")), "bucket").alias("edge"))
    about = durable(leaves.join(crossed, list(LEAF), "left").select(*LEAF, "epochs", "rest", F.coalesce("edge.bucket", F.lit(BUCKETS)).alias("edge_bucket"), F.coalesce("edge.before", F.lit(0)).alias("before")))
    known = placed(rows, about)
    clear = known.where("bucket <> edge_bucket").withColumn("more", (F.col("bucket") < F.col("edge_bucket")).cast("int"))
    edge = known.where("bucket = edge_bucket")
    upto = F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("place"))
    edge = edge.withColumn("more", (F.col("before") + upto <= F.col("rest")).cast("int"))
    return clear.unionByName(edge).select("rec", *LEAF, "n_tokens", (F.col("epochs") + F.col("more")).alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, in their own columns; one that several epochs take stands there as often."""
    rows = mixed(docs, **options).where("copies > 0")
    rows = rows.withColumn("again", F.explode(F.expr("sequence(1, copies)")))
    return rows.select(*[F.col("rec").getField(c).alias(c) for c in docs.columns])


def _sql(budget: float, max_epochs: int, seed: int) -> str:
    """The production query in DuckDB.

    Here a parent's tokens rise like water in vessels: at level r a child holds min(capacity, r x weight), and the level
    is that at which all together hold what the parent was given.
    """

    def rise(name: str, above: str, parent: list[str], child: str, weight: str) -> str:
        by, mine = ", ".join(parent), ", ".join([*parent, child])
        return f"""
    {name}_n AS (SELECT {mine}, capacity, {weight} AS weight FROM (SELECT {mine}, sum(capacity)::DOUBLE AS capacity FROM cap GROUP BY {mine}) WHERE capacity > 0),
    {name}_r AS (SELECT {by}, 0.0::DOUBLE AS r FROM {name}_n UNION SELECT {by}, capacity / weight FROM {name}_n),
    {name}_h AS (SELECT {by}, r, sum(CASE WHEN capacity / weight <= r THEN capacity ELSE r * weight END) AS held, sum(CASE WHEN capacity / weight > r THEN weight ELSE 0 END) AS rising FROM {name}_r JOIN {name}_n USING ({by}) GROUP BY {by}, r),
    {name}_l AS (SELECT {by}, max(CASE WHEN rising > 0 THEN r + (given - held) / rising ELSE r END) AS level FROM {name}_h JOIN {above} USING ({by}) WHERE held <= given GROUP BY {by}),
    {name} AS (SELECT {mine}, CASE WHEN capacity / weight <= level THEN capacity ELSE level * weight END AS given FROM {name}_n JOIN {name}_l USING ({by})),"""

    case = lambda c, names: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + f" ELSE {min(names.values())} END::DOUBLE"
    domains = " ".join(f"WHEN source IN ({', '.join(repr(m) for m in ms)}) THEN '{d}'" for d, ms in DOMAINS.items())
    return f"""
    WITH docs AS (
        SELECT doc_id, CASE WHEN source IS NULL THEN '(none)' {domains} ELSE '{OTHER_DOMAIN}' END AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
    cap AS (SELECT 1 AS root, domain, lang, source, tokens * {max_epochs} AS capacity FROM leaves),
    top AS (SELECT 1 AS root, sum(tokens)::DOUBLE * {budget} AS given FROM leaves),
    {rise("d", "top", ["root"], "domain", case("domain", DOMAIN_WEIGHTS))}
    {rise("l", "d", ["root", "domain"], "lang", case("lang", LANG_WEIGHTS))}
    {rise("s", "l", ["root", "domain", "lang"], "source", "1.0::DOUBLE")}
    plan AS (SELECT domain, lang, source, tokens, floor(coalesce(given, 0) + {NOISE})::BIGINT AS budget, CASE WHEN tokens > 0 THEN floor(coalesce(given, 0) + {NOISE})::BIGINT // tokens ELSE 0 END AS epochs FROM leaves LEFT JOIN s USING (domain, lang, source)),
    runs AS (SELECT d.*, p.epochs, p.budget - p.epochs * p.tokens AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || p.epochs || ':' || doc_id)) AS upto FROM docs d JOIN plan p USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM runs"""


PRODUCTION = {"budget": 0.5, "max_epochs": 3, "seed": 42, "domain_weights": DOMAIN_WEIGHTS, "lang_weights": LANG_WEIGHTS}
ORACLE = _sql(0.5, 3, 42)
