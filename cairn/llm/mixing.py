"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' rows in a tree of domains, their languages, and their sources. A token budget
goes down the tree in proportion to weights. A node can't take more than its leaves hold in the
allowed number of epochs; what it can't take goes to its siblings by their weights, and only what
all siblings can't take is missing at the ancestor, which by the same rule has handed it to its own
siblings. Each leaf then takes whole epochs while its budget lasts, and of the next epoch the
longest prefix, in an order seeded by the epoch, whose tokens fit.

Budgets are whole numbers and the split is in closed form (children sorted by capacity over weight
saturate in that order), so it is a few window functions over the node tables. Only narrow rows are
ordered, in hash ranges that grow in number with the leaf, so that a source of any size is spread
over many tasks. All of it is built from DataFrame functions.

Defined results: a null language or source is a leaf of its own (``?``); null texts have no tokens;
documents without tokens always fit; rows of a leaf whose place ties, as those of one doc_id do, come and go together;
a domain, language or source without a stated weight has the default one; what has weight 0, and all below it, is
shut out, and its share goes to its siblings; empty inputs give no rows. A token here is a word between ASCII white
space, which SQL counts; `cutoffs` takes any other count as a column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.frames import materialise

#: Bits of the seeded hash that orders a leaf's documents, and documents a hash range; places that tie come and go together.
ORDER_BITS, RANGE_DOCS = 40, 1024
#: Parts that a leaf's rows are dealt out in where they meet its budget.
SALTS = 64
WORD = r"[^ \t\n\x0B\f\r]+"
UNKNOWN = "?"


@dataclass(frozen=True)
class Plan:
    """Relative weights by name at each level, the budget as thousandths of all tokens, and the most epochs."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 40, "books": 30, "code": 20, "reference": 10})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 60, "de": 14, "fr": 14, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 2
    budget_permille: int = 900
    max_epochs: int = 2
    seed: str = "mix-1"


def domain_of(source: Column, names: list[str]) -> Column:
    """Where no table says which domain a source is of: by the source's MD5."""
    return F.element_at(F.array(*map(F.lit, names)), F.pmod(F.conv(F.substr(F.md5(source), F.lit(1), F.lit(4)), 16, 10).cast("int"), F.lit(len(names))) + 1)


def tokens_in(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def _weight(column: str, weights: dict[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("bigint")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(known[F.col(column)], F.lit(default)).cast("bigint")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split ``budget`` (equal among siblings) over each parent's children by ``weight``, none above
    its ``capacity``: adds ``given``. ``name`` settles ties.

    Sorted by capacity over weight, the children that are filled come first; the others split what
    those leave, rounded down. A child of weight 0 has capacity 0 (see `budgets`) and is filled with that.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(0.0), name)
    used = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = nodes.withColumns({"__used": used, "__open": still})
    out = out.withColumn("__full", F.col("capacity") * F.col("__open") <= (F.col("budget") - F.col("__used")) * F.col("weight"))
    out = out.withColumns({
        "__taken": F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(by), F.lit(0)),
        "__rest": F.sum(F.when(~F.col("__full"), F.col("weight"))).over(by),
    })
    given = F.when(F.col("__full"), F.col("capacity")).otherwise(F.expr("(budget - __taken) * weight div __rest"))
    return out.withColumn("given", given).drop("__used", "__open", "__full", "__taken", "__rest")


LEAF = ["domain", "language", "origin"]


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Add ``given``, the leaf's token budget, and ``open``, whether all its weights are above 0, to
    ``(domain, language, origin, tokens, ...)`` rows."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    levels = (("domain", plan.domains), ("language", plan.languages), ("origin", plan.sources))
    open_ = F.lit(True)
    for name, weights in levels:
        open_ = open_ & (_weight(name, weights, plan.default) > 0)
    leaves = leaves.withColumn("open", open_).withColumn("__room", F.when(F.col("open"), F.col("tokens") * plan.max_epochs).otherwise(0))
    above: DataFrame | None = None
    for depth, (name, weights) in enumerate(levels):
        parent = LEAF[:depth]
        if depth < 2:
            nodes = leaves.groupBy(*parent, name).agg(F.sum("__room").alias("capacity"))
        else:
            nodes = leaves.withColumn("capacity", F.col("__room"))
        nodes = nodes.withColumn("weight", _weight(name, weights, plan.default))
        nodes = nodes.withColumn("budget", F.lit(total * plan.budget_permille // 1000).cast("bigint")) if above is None else nodes.join(above, parent)
        shared = share(nodes, parent, name)
        above = shared.select(*parent, name, F.col("given").alias("budget"))
    return shared.drop("capacity", "weight", "budget", "__room")


def _order(plan: Plan, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch, as a whole number of ORDER_BITS bits."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(plan.seed), epoch.cast("string"), doc_id.cast("string"))), F.lit(1), F.lit(ORDER_BITS // 4)), 16, 10).cast("bigint")


def leaf_columns(plan: Plan, lang: str = "lang", source: str = "source") -> list[Column]:
    origin = F.coalesce(F.col(source), F.lit(UNKNOWN))
    return [domain_of(origin, list(plan.domains)).alias("domain"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("language"), origin.alias("origin")]


def _spread(rows: DataFrame, per_leaf: DataFrame, keys: list[str]) -> DataFrame:
    """Join rows to their leaf's one row; leaves are dealt out in SALTS parts, so a hot one isn't one task's."""
    salted = per_leaf.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


def cutoffs(docs: DataFrame, plan: Plan, tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The narrow rows ``(doc_id, leaf, n_tokens)`` and, for each leaf, its ``whole`` epochs and the
    last place ``cut`` of the next epoch's prefix (-1: none)."""
    tokens = tokens_in(F.col("text")) if tokens is None else tokens
    narrow = materialise(docs.select("doc_id", *leaf_columns(plan), tokens.alias("n_tokens")), "narrow")
    leaves = materialise(narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "leaves")
    given = budgets(leaves, plan)
    whole = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.col("open").cast("int"))
    given = given.withColumn("whole", whole).withColumns({"rest": F.col("given") - F.col("whole") * F.col("tokens"), "ranges": F.ceil(F.col("n_docs") / RANGE_DOCS)})
    given = materialise(given.select(*LEAF, "whole", "rest", "ranges"), "budgets")

    placed = _spread(narrow, given.filter("rest > 0"), LEAF).withColumn("place", _order(plan, F.col("whole"), F.col("doc_id")))
    placed = placed.select(*LEAF, "rest", "ranges", "place", "n_tokens", F.expr(f"place * ranges div {1 << ORDER_BITS}").alias("range"))
    sums = placed.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest"), F.first("ranges").alias("ranges"))
    before = F.sum("held").over(Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    edge = sums.withColumn("before", before).filter("before <= rest and before + held > rest")
    edge = materialise(edge.select(*LEAF, "range", "before", F.expr(f"(range * {1 << ORDER_BITS} + ranges - 1) div ranges - 1").alias("below")), "edges")
    within = placed.join(edge.drop("below"), [*LEAF, "range"])
    reach = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("place"))
    last = within.withColumn("fits", reach <= F.col("rest")).filter("fits").groupBy(*LEAF).agg(F.max("place").alias("last"))
    cut = edge.join(last, LEAF, "left").select(*LEAF, F.coalesce("last", "below").alias("cut"))
    return narrow, materialise(given.join(cut, LEAF, "left").select(*LEAF, "whole", F.coalesce("cut", F.lit(-1)).alias("cut")), "cutoffs")


def _epochs(rows: DataFrame, plan: Plan) -> DataFrame:
    """One row an epoch that takes the document."""
    taken = F.col("whole") + F.when(_order(plan, F.col("whole"), F.col("doc_id")) <= F.col("cut"), 1).otherwise(0)
    return rows.withColumn("__taken", taken.cast("int")).filter("__taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__taken") - 1))).drop("__taken", "whole", "cut")


def mix(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """``(doc_id, domain, language, origin, n_tokens, epoch)``: one row for each time a document is taken."""
    narrow, cuts = cutoffs(docs, plan)
    return _epochs(_spread(narrow, cuts, LEAF), plan).select("doc_id", *LEAF, "n_tokens", "epoch")


def mixed_documents(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008
    """The documents themselves, all columns, once for each time they are taken. Texts aren't shuffled
    unless the leaf table is too large for Spark to broadcast."""
    _, cuts = cutoffs(docs, plan)
    names = {c: f"__{c}" for c in LEAF}
    keyed = docs.withColumns({f"__{c}": e for c, e in zip(LEAF, leaf_columns(plan), strict=True)})
    renamed = cuts.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    joined = _spread(keyed, renamed, list(names.values()))
    taken = F.col("__whole") + F.when(_order(plan, F.col("__whole"), F.col("doc_id")) <= F.col("__cut"), 1).otherwise(0)
    rows = joined.withColumn("__taken", taken.cast("int")).filter("__taken > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__taken"))))
    return rows.select(*docs.columns)
