"""Mixing sources to target weights, in DataFrame functions alone.

Sizes are summed per source (a partial aggregate, so a source with a third of all rows is no hot
group), targets share the total by weight under a cap of ``max_repeats`` times a source's size, and
each document comes floor(rate) times plus once more where a hash of its id and the seed falls
below the rate's fraction. The same table, seed and weights give the same copies, whatever the
partitioning. Only the table of sources, one row each, is ordered as a whole.

Defined results: a null or empty text has size 0, and is emitted like any other document of its
source; a null source is a source of its own, last in order; documents of a source whose size is 0
are emitted once; rows that repeat an id draw alike; an empty table gives no rows. Where the total
is 0, all targets are 0. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.llm.tables import packed, written

WORD = r"[^\x20\x09-\x0D]+"
SEED = 7
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed."""
    key = F.md5(F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(src, source_size, target, rate) from rows of (src, size).

    Sources stand in order of their code points, null last, and take the weights in turn. In order
    of cap over weight, a source is capped as long as its share of what the earlier caps leave
    reaches its cap; all others split the rest by weight. (Past the first uncapped source the shares
    only fall, so the largest share of an uncapped source is the common level.)
    """
    table = written(sizes.groupBy("src").agg(F.sum("size").cast("bigint").alias("source_size")), "source-sizes")
    array = ", ".join(f"{w}L" for w in weights)
    ranked = table.selectExpr("*", "row_number() over (order by src nulls last) - 1 as nth").selectExpr(
        "src", "source_size", f"element_at(array({array}), cast(nth % {len(weights)} as int) + 1) as weight", f"{max_repeats}L * source_size as cap")
    poured = ranked.selectExpr(
        "*", "sum(source_size) over () as total", "row_number() over (order by cap / weight, src nulls last) as place").selectExpr(
        "*", "coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0) as before",
        "sum(weight) over (order by place rows between current row and unbounded following) as left_weight").selectExpr(
        "*", "(total - before) / left_weight as share").selectExpr("*", "share >= cap / weight as capped")
    level = poured.selectExpr("*", "max(case when not capped then share end) over () as level")
    target = level.selectExpr("src", "source_size", "case when capped then cast(cap as double) else weight * level end as target")
    return target.selectExpr("src", "source_size", "target", "case when source_size > 0 then target / source_size else 1.0D end as rate")


def _mixed(docs: DataFrame, weights: Sequence[int], max_repeats: int, seed: int) -> DataFrame:
    """(row, mix_size, mix_source_size, mix_target, mix_copies) of every document."""
    sized = packed(docs, mix_id=F.col("doc_id"), source=F.col("source"), mix_size=word_count(F.col("text")))
    targets = source_targets(sized.select(F.col("source").alias("src"), F.col("mix_size").alias("size")), weights, max_repeats)
    # a plain table again: its size on disk, not a guess, tells the planner whether it can be broadcast
    targets = written(targets.select(F.col("src").alias("mix_src"), F.col("source_size").alias("mix_source_size"),
                                     F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate")), "source-targets")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("mix_src")))
    rate = F.col("mix_rate")
    extra = (draw(F.col("mix_id"), seed) < rate - F.floor(rate)).cast("bigint")
    return joined.select("row", "mix_size", "mix_source_size", "mix_target", (F.floor(rate) + extra).alias("mix_copies"))


def _beside(docs: DataFrame, *own: str) -> list[str]:
    """The columns of ``docs`` that do not have a name of ``own``."""
    return [c for c in docs.columns if c.lower() not in own]


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The documents with their size, source_size, target and number of copies (columns ``mix_*``, in place of
    any of the same name)."""
    own = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    return _mixed(docs, weights, max_repeats, seed).select(*[F.col("row")[c].alias(c) for c in _beside(docs, *own)], *own)


def emit(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``copy`` (1, 2, ...; in place of a column of that name),
    one row for each copy."""
    mixed = _mixed(docs, weights, max_repeats, seed).where("mix_copies > 0")
    again = mixed.withColumn("nth_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return again.select(*[F.col("row")[c].alias(c) for c in _beside(docs, "copy")], F.col("nth_copy").alias("copy"))


MIX_SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), per_source as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select source, source_size, 3 * source_size as cap,
    [1, 2, 3][1 + ((row_number() over (order by encode(source) nulls last) - 1) % 3)] as weight
  from per_source
), placed as (
  select *, sum(source_size) over () as total,
    row_number() over (order by cap::double / weight, encode(source) nulls last) as place
  from ranked
), shares as (
  select *, (total - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by place rows between current row and unbounded following))::double as share
  from placed
), levels as (
  select *, share >= cap::double / weight as capped from shares
), targets as (
  select source, source_size,
    case when capped then cap::double else weight::double * max(case when not capped then share end) over () end as target
  from levels
), rates as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size::double else 1.0 end as rate,
    ('0x' || substring(md5('mix:{SEED}:' || coalesce(d.doc_id::varchar, 'null')), 1, 8))::bigint::double / 4294967296.0 as u
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size::bigint as source_size, target,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from rates
"""
