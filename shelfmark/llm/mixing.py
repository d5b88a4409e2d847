"""Mixing sources to target weights by hierarchical budgeting, in DataFrame code only.

The leaves of a domain-language-source tree hold the documents. A token budget flows from
the root: each node's children share it in proportion to their weights, no child beyond what
its subtree holds (its tokens times max_epochs). What a child cannot take goes to its siblings;
only what all of them together cannot take has already gone, one level up, to the siblings
of their parent. A leaf spends its budget on whole epochs and then on a prefix of one more
epoch, whose order is seeded; the prefix ends before the first document that would pass
the budget.

Tokens are the words `[^\\x20\\x09-\\x0D]+` of the whole text.

Defined results: null and empty texts hold 0 tokens and get the copies that their place in the order
gives; null lang or source is the child named ''; a child without a stated weight has weight 1;
repeated rows stand at the same place and are taken together or not at all; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded, materialise, unused

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by child name; share of all tokens to spend; epochs at most."""

    domain: dict = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    lang: dict = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    source: dict = field(default_factory=dict)
    percent: int = 60
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The domain of a source: the remainder by 4 of the number that ends its name."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(digits != "", digits.cast("int") % 4).otherwise(0).cast("string"))


def _weight(level: str, weights: dict) -> Column:
    found = F.lit(1)
    for name in sorted(weights):
        found = F.when(F.col(level) == name, F.lit(int(weights[name]))).otherwise(found)
    return found.cast("bigint")


def share(children: DataFrame, parents: DataFrame, over: list[str], name: str) -> DataFrame:
    """Deal each parent's budget to its children by weight, none beyond its capacity.

    Sorted by capacity for each unit of weight, the children that fill up come first; the others
    share what is left in proportion, by differences of rounded running sums, so that the
    whole is dealt to the last token. Products stay below 2^63 for weights up to 1,000 and
    10^15 tokens.
    """
    if over:
        rows = children.join(bounded(parents, parents.count()), over)
    else:  # the root is one row
        rows = children.crossJoin(F.broadcast(parents))
    one = Window.partitionBy(*over) if over else Window.partitionBy(F.lit(0))
    order = one.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name).asc())
    rows = rows.withColumn("before", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("after", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("full", F.expr("capacity * after <= weight * (budget - before)"))
    rows = rows.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(one))
    rows = rows.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(one))
    names = one.orderBy(F.col(name).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(names))
    given = F.expr("case when full then capacity else (upto * `left`) div open - ((upto - weight) * `left`) div open end")
    return rows.withColumn("budget", given).select(*over, name, "budget")


def budgets(tokens: DataFrame, mix: Mix) -> DataFrame:
    """Tokens, budget, whole epochs and remainder of each leaf."""
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").cast("bigint").alias("tokens"))
    leaves = materialise(leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("c"))
    parents = total.select(F.least(F.expr(f"(t * {mix.percent}) div 100"), F.col("c")).cast("bigint").alias("budget"))
    for depth, level in enumerate(LEVELS):
        over = list(LEVELS[:depth])
        children = leaves.groupBy(*over, level).agg(F.sum("capacity").cast("bigint").alias("capacity"))
        children = children.withColumn("weight", _weight(level, getattr(mix, level)))
        parents = materialise(share(children, parents, over, level), "mix-shares")
    found = leaves.join(bounded(parents, parents.count()), list(LEVELS))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("bigint")
    return found.withColumn("whole", whole).withColumn("rest", F.expr("budget - whole * tokens")).drop("capacity")


def select(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, copies.

    No leaf meets in one task: an epoch's order is cut into 256 ranges by the first two digits of the
    seeded digest, and the one in which the prefix ends into 256 again; sums of ranges tell which,
    and only the last of them is sorted.
    """
    tokens = materialise(
        docs.select(
            F.col("doc_id"), domain_of(F.col("source")).alias("domain"),
            F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"),
            F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("n_tokens"),
        )
        .withColumn("domain", F.coalesce("domain", F.lit("d0"))),
        "mix-tokens",
    )
    plan = materialise(budgets(tokens, mix), "mix-budgets")
    n = plan.count()
    placed = (
        tokens.join(bounded(plan, n), list(LEVELS))
        .withColumn("place", F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("whole"), F.col("doc_id")).cast("binary")))
        .withColumn("bin", F.substring("place", 1, 4))
    )
    ends = placed.select(*LEVELS, F.lit("").alias("end_bin"), F.lit(0).cast("bigint").alias("before")).distinct()
    for digits in (2, 4):
        inside = placed.join(bounded(ends, n), list(LEVELS)).where(F.substring("place", 1, digits - 2) == F.col("end_bin"))
        ends = materialise(_ends(inside.withColumn("part", F.substring("place", 1, digits))), "mix-ends")
    keyed = placed.join(bounded(ends, n), list(LEVELS), "left")
    kept = ["doc_id", *LEVELS, "n_tokens"]
    clear = keyed.where("end_bin is null or bin <> end_bin").select(
        *kept, (F.col("whole") + F.when(F.expr("end_bin is null or bin < end_bin"), 1).otherwise(0)).alias("copies"), "whole"
    )
    # a leaf whose budget is spent by whole epochs ends in the first range that holds a token
    order = Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = keyed.where("bin = end_bin").withColumn("upto", F.col("before") + F.sum("n_tokens").over(order))
    edge = edge.select(*kept, (F.col("whole") + F.when(F.expr("upto <= rest"), 1).otherwise(0)).alias("copies"), "whole")
    found = clear.unionByName(edge)
    return found.select(*kept, F.least("copies", F.lit(mix.max_epochs)).cast("bigint").alias("copies"))


def _ends(rows: DataFrame) -> DataFrame:
    """Of each leaf the part of its order in which the running sum passes rest, and the sum before it."""
    sums = rows.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("in_part"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    run = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = sums.withColumn("upto", F.col("before") + F.sum("in_part").over(run)).where("upto > rest")
    end = passed.groupBy(*LEVELS).agg(F.min(F.struct("part", F.expr("upto - in_part").alias("before"))).alias("end"))
    return end.select(*LEVELS, F.col("end.part").alias("end_bin"), F.col("end.before").alias("before"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs with each row as often as select has copies of it; rows with null doc_id are not taken.

    Rows that share an identifier get the copies of their own leaf.
    """
    leaf = F.xxhash64(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    doc_id, key, copies = (unused(docs, f"_mix_{c}") for c in ("doc_id", "leaf", "copies"))
    chosen = select(docs, mix).where("copies > 0 and doc_id is not null").groupBy(F.col("doc_id").alias(doc_id), leaf.alias(key))
    chosen = materialise(chosen.agg(F.max("copies").alias(copies)), "mix-chosen")
    out = docs.join(bounded(chosen, chosen.count()), (F.col("doc_id") == F.col(doc_id)) & (leaf == F.col(key)))
    return out.withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).drop(doc_id, key, copies)


def oracle_sql(mix: Mix = Mix()) -> str:
    """The rows of select() in DuckDB SQL: the whole epoch order of each leaf is summed at once."""

    def weight(level: str) -> str:
        cases = " ".join(f"when {level} = '{k}' then {int(v)}" for k, v in getattr(mix, level).items())
        return f"case {cases} else 1 end" if cases else "1"

    steps = [
        r"""t as (select doc_id, 'd' || (case when regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' then 0
             else regexp_extract(source, '([0-9]{1,9})$', 1)::int % 4 end) as domain,
             coalesce(lang, '') as lang, coalesce(source, '') as source,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents)""",
        f"leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {mix.max_epochs})::bigint as capacity from t group by all)",
        f"p0 as (select least((sum(tokens) * {mix.percent}) // 100, sum(capacity))::bigint as budget from leaves)",
    ]
    for i, level in enumerate(LEVELS):
        over = ", ".join(LEVELS[:i])
        part = f"partition by {over}" if over else ""
        lead = f"{over}, " if over else ""
        join = f"join p{i} using ({over})" if over else f"cross join p{i}"
        steps += [
            f"c{i} as (select {lead}{level}, sum(capacity)::bigint as capacity, {weight(level)} as weight from leaves group by all)",
            f"""a{i} as (select *, coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0) as before,
                sum(weight) over (w rows between current row and unbounded following) as after_
                from c{i} {join} window w as ({part} order by capacity::double / weight, {level}))""",
            f"b{i} as (select *, capacity * after_ <= weight * (budget - before) as isfull from a{i})",
            f"""e{i} as (select *, budget - sum(case when isfull then capacity else 0 end) over ({part}) as left_,
                sum(case when isfull then 0 else weight end) over ({part}) as open_,
                sum(case when isfull then 0 else weight end) over ({part} order by {level} rows between unbounded preceding and current row) as upto from b{i})""",
            f"""p{i + 1} as (select {lead}{level}, (case when isfull then capacity else (upto * left_) // open_ - ((upto - weight) * left_) // open_ end)::bigint as budget from e{i})""",
        ]
    steps += [
        """f as (select *, case when tokens > 0 then budget // tokens else 0 end as whole from leaves join p3 using (domain, lang, source))""",
        f"""o as (select t.*, whole, budget - whole * tokens as rest,
              sum(n_tokens) over (partition by domain, lang, source order by md5('{mix.seed}:' || whole || coalesce(':' || doc_id, ''))) as upto
              from t join f using (domain, lang, source))""",
    ]
    return "with " + ",\n".join(steps) + f"\nselect doc_id, domain, lang, source, n_tokens, least(whole + (upto <= rest)::int, {mix.max_epochs})::bigint as copies from o"
