"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are the sources of a language of a domain. The token budget goes down the tree: siblings
share their parent's budget by weight, none gets more than its subtree can give in MOST_EPOCHS
epochs, and what one cannot take goes to its siblings by their weights before anything goes back
to the parent's siblings. Each leaf takes whole epochs and then the documents of one more seeded
order until its budget is met.

No step holds the rows of a leaf together: its cut is found from sums of RANGES ranges of the
seeded order, the range with the cut is divided again until it has few rows, and only these are
ordered.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, table, text_column, unused, written

#: A word for the token counts here.
WORD = r"[^ \t\n\r\f\x0B]+"
#: Leaves up to which their table is broadcast.
BROADCAST_LEAVES = 50_000
#: Ranges (two hexadecimal digits of the place) that a range of a leaf is divided into, and rows
#: of a range up to which it is ordered.
RANGES = 256
RANGE_ROWS = 5_000
_DIGITS = 2
LEAF = ["mix_domain", "mix_lang", "mix_source"]


@dataclass(frozen=True)
class Mix:
    """Target weights (whole numbers; 1 where not given, 0 for none) and the budget: ``share`` of
    all tokens, as a fraction of whole numbers."""

    domains: Mapping[str, int] = field(default_factory=dict)
    languages: Mapping[str, int] = field(default_factory=dict)
    sources: Mapping[str, int] = field(default_factory=dict)
    share: tuple[int, int] = (1, 2)
    most_epochs: int = 2
    seed: int = 11


PRODUCTION = Mix(domains={"d0": 3}, languages={"en": 4, "de": 2, "fr": 2})


def domain_of(source: Column) -> Column:
    """The domain of a source: d and the last character of its name."""
    return F.concat(F.lit("d"), F.right(source, F.lit(1)))


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(F.col(name) == k, F.lit(int(v))).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """budget of each node (name, weight, most) of its parent's ``given``, whole tokens."""
    group = Window.partitionBy(*parents)
    before = group.orderBy(F.col("most").cast("double") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("most", F.when(F.col("weight") > 0, F.col("most")).otherwise(F.lit(0)).cast("long")).withColumn("weight", F.greatest("weight", F.lit(1).cast("long")))
    nodes = nodes.withColumn("_taken", F.coalesce(F.sum("most").over(before), F.lit(0)))
    nodes = nodes.withColumn("_open", F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    big = lambda c: f"cast({c} as decimal(20,0))"
    nodes = nodes.withColumn("_full", F.expr(f"{big('most')} * cast(_open as decimal(18,0)) <= {big('given - _taken')} * cast(weight as decimal(18,0))"))
    nodes = nodes.withColumn("_left", F.col("given") - F.sum(F.when(F.col("_full"), F.col("most")).otherwise(0)).over(group))
    nodes = nodes.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group))
    nodes = nodes.withColumn("budget", F.expr(f"case when _full then most else ({big('_left')} * cast(weight as decimal(18,0))) div _open end").cast("long"))
    return nodes.drop("_taken", "_open", "_full", "_left")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Adds budget, epochs (whole ones) and rest to leaves (LEAF columns, have: their tokens).

    What a source or language of weight 0 has counts in the budget's share of all tokens, but not
    in what the subtrees above it can give. Shares are rounded down, so the siblings of a parent
    leave less than a token each.
    """
    d, lang, source = LEAF
    can = (_weight(source, mix.sources) > 0) & (_weight(lang, mix.languages) > 0)
    leaves = leaves.withColumn("most", F.when(can, F.col("have") * mix.most_epochs).otherwise(F.lit(0)).cast("long"))
    domains = leaves.groupBy(d).agg(F.sum("most").alias("most"), F.sum("have").alias("_have")).withColumn("weight", _weight(d, mix.domains)).withColumn("_root", F.lit(0))
    domains = domains.withColumn("_all", F.sum("_have").over(Window.partitionBy("_root")))  # a row for each domain
    domains = domains.withColumn("given", F.expr(f"cast(_all as decimal(20,0)) * {mix.share[0]} div {mix.share[1]}").cast("long"))
    domains = _share(domains, ["_root"], d).select(d, F.col("budget").alias("given"))
    langs = leaves.groupBy(d, lang).agg(F.sum("most").alias("most")).withColumn("weight", _weight(lang, mix.languages)).join(domains, d)
    langs = _share(langs, [d], lang).select(d, lang, F.col("budget").alias("given"))
    leaves = leaves.withColumn("weight", _weight(source, mix.sources)).join(langs, [d, lang])
    leaves = _share(leaves, [d, lang], source)
    epochs = F.when(F.col("have") > 0, F.expr("budget div have")).otherwise(F.lit(0)).cast("int")
    return leaves.select(*LEAF, "have", "budget", epochs.alias("epochs")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have"))


def _order(mix: Mix, epochs: str = "epochs") -> Column:
    """A document's place in the seeded order of its leaf's last epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col(epochs).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _sized(leaves: DataFrame) -> DataFrame:
    """A written leaf table, marked for broadcast only if its counted rows are few."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def _leaf_columns(docs: DataFrame) -> DataFrame:
    source = F.coalesce(docs["source"].cast("string"), F.lit(""))
    return docs.withColumns({"mix_domain": domain_of(source), "mix_lang": F.coalesce(docs["lang"].cast("string"), F.lit("")), "mix_source": source})


def count_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, LEAF columns, mix_tokens): words of each whole text."""
    rows = docs.select("doc_id", "lang", "source", F.regexp_count(text_column(docs), F.lit(WORD)).cast("long").alias("mix_tokens"))
    return _leaf_columns(rows).select("doc_id", *LEAF, "mix_tokens")


def leaf_cuts(counted: DataFrame, mix: Mix) -> DataFrame:
    """Of each leaf budget, epochs, rest and cut: the last place of its seeded order whose
    documents are taken once more (null: none). ``counted`` is a written table."""
    leaves = written(leaf_budgets(counted.groupBy(*LEAF).agg(F.sum("mix_tokens").alias("have")), mix), "leaves")
    rows = counted.join(_sized(leaves), LEAF).where(F.col("rest") > 0).withColumn("_at", _order(mix))
    rows = rows.select(*LEAF, "_at", "rest", "mix_tokens")
    inside, digits, before = rows, 0, F.lit(0).cast("long")
    while digits < 32:
        digits += _DIGITS
        ranges = inside.groupBy(*LEAF, F.substring("_at", 1, digits).alias("_range")).agg(F.sum("mix_tokens").alias("_n"), F.count("*").alias("_rows"), F.first("rest").alias("_rest"), F.first(before).alias("_first"))
        upto = Window.partitionBy(*LEAF).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows of a leaf
        ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)) + F.col("_first")).where(F.col("_before") < F.col("_rest"))
        last = ranges.groupBy(*LEAF).agg(F.max(F.struct("_range", "_before", "_rows")).alias("_last")).select(*LEAF, "_last.*")
        last = written(last, "ranges")
        inside = rows.join(_sized(last), LEAF).where(F.col("_at").startswith(F.col("_range")))
        before = F.col("_before")
        if (last.agg(F.max("_rows")).first()[0] or 0) <= RANGE_ROWS:
            break
    upto = Window.partitionBy(*LEAF).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(*LEAF, "_at")
    inside = inside.withColumn("_cum", F.sum("mix_tokens").over(upto) - F.sum("mix_tokens").over(own) + F.col("_before"))
    cuts = inside.where(F.col("_cum") < F.col("rest")).groupBy(*LEAF).agg(F.max("_at").alias("cut"))
    return written(leaves.join(cuts, LEAF, "left"), "cuts")


def take(rows: DataFrame, cuts: DataFrame, mix: Mix) -> DataFrame:
    """Rows (LEAF columns and doc_id) that the mix takes, once for each epoch, with mix_epoch."""
    epochs, cut, copies = unused(rows, "mix_epochs", "mix_cut", "mix_copies")
    cuts = cuts.select(*LEAF, F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    joined = rows.join(_sized(cuts), LEAF)
    more = F.when(F.col(cut).isNotNull() & (_order(mix, epochs) <= F.col(cut)), 1).otherwise(0)
    joined = joined.withColumn(copies, F.col(epochs) + more).where(F.col(copies) > 0)
    return joined.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).select(*own_columns(rows), F.col("mix_epoch").cast("int").alias("mix_epoch"))


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The rows of docs that the mix takes, all their columns and mix_domain, mix_lang, mix_source
    and mix_epoch: a row for each epoch that takes it.

    A document is taken in the last, partial epoch if the documents before it in the seeded order
    do not meet the leaf's budget; rows of one doc_id are taken together. Null lang, source and
    text count as empty; a document without words is taken as its place in the order says. Leaves
    without tokens have no budget. An empty table gives no rows. Columns of docs of the new names
    are replaced.
    """
    new = (*LEAF, "mix_epoch")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    return take(_leaf_columns(docs), leaf_cuts(written(count_tokens(docs), "counted"), mix), mix)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = written(count_tokens(table(spark, sf_dir, "documents")), "counted")
    return take(counted, leaf_cuts(counted, PRODUCTION), PRODUCTION)


def _shared(nodes: str, parents: str, name: str) -> str:
    nodes = f"(SELECT * REPLACE (CASE WHEN weight > 0 THEN most ELSE 0 END AS most, greatest(weight, 1) AS weight) FROM {nodes})"
    return f"""(
  SELECT * EXCLUDE (_full, _taken, _open), CASE WHEN _full THEN most
    ELSE ((given - sum(CASE WHEN _full THEN most ELSE 0 END) OVER g) * weight // sum(CASE WHEN _full THEN 0 ELSE weight END) OVER g)::BIGINT END AS budget
  FROM (SELECT *, most * _open <= (given - _taken) * weight AS _full FROM (
    SELECT *, coalesce(sum(most) OVER b, 0) AS _taken, sum(weight) OVER g - coalesce(sum(weight) OVER b, 0) AS _open FROM {nodes}
    WINDOW g AS (PARTITION BY {parents}), b AS (PARTITION BY {parents} ORDER BY most::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
  WINDOW g AS (PARTITION BY {parents}))"""


def _oracle(mix: Mix = PRODUCTION) -> str:
    case = lambda c, m: "CASE " + c + "".join(f" WHEN '{k}' THEN {v}" for k, v in m.items()) + " ELSE 1 END" if m else "1"
    return rf"""
WITH counted AS (
  SELECT doc_id, 'd' || right(coalesce(source, ''), 1) AS mix_domain, coalesce(lang, '') AS mix_lang, coalesce(source, '') AS mix_source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS mix_tokens
  FROM documents
), leaves AS (SELECT mix_domain, mix_lang, mix_source, sum(mix_tokens) AS have,
  CASE WHEN {case('mix_source', mix.sources)} > 0 AND {case('mix_lang', mix.languages)} > 0 THEN sum(mix_tokens) * {mix.most_epochs} ELSE 0 END AS most, {case('mix_source', mix.sources)} AS weight FROM counted GROUP BY 1, 2, 3),
d0 AS (SELECT 0 AS root, mix_domain, sum(most) AS most, {case('mix_domain', mix.domains)} AS weight, (SELECT sum(have) FROM leaves) * {mix.share[0]} // {mix.share[1]} AS given FROM leaves GROUP BY mix_domain),
d1 AS (SELECT mix_domain, budget AS given FROM {_shared('d0', 'root', 'mix_domain')}),
l0 AS (SELECT mix_domain, mix_lang, sum(most) AS most, {case('mix_lang', mix.languages)} AS weight, any_value(given) AS given FROM leaves JOIN d1 USING (mix_domain) GROUP BY mix_domain, mix_lang),
l1 AS (SELECT mix_domain, mix_lang, budget AS given FROM {_shared('l0', 'mix_domain', 'mix_lang')}),
s0 AS (SELECT * FROM leaves JOIN l1 USING (mix_domain, mix_lang)),
s1 AS (SELECT mix_domain, mix_lang, mix_source, budget, CASE WHEN have > 0 THEN budget // have ELSE 0 END AS epochs, have FROM {_shared('s0', 'mix_domain, mix_lang', 'mix_source')}),
placed AS (SELECT *, budget - epochs * have AS rest, md5('{mix.seed}:' || CAST(epochs AS BIGINT) || ':' || doc_id) AS place FROM counted JOIN s1 USING (mix_domain, mix_lang, mix_source)),
summed AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY place) - sum(mix_tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source, place) AS before FROM placed),
taken AS (SELECT *, epochs + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END AS copies FROM summed)
SELECT doc_id, mix_domain, mix_lang, mix_source, mix_tokens, CAST(unnest(range(CAST(copies AS BIGINT))) AS INTEGER) AS mix_epoch FROM taken
"""


ORACLE_SQL = _oracle()
