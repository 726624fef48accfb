"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule over training time u in [0, 1], given by
knots. Its integral, scaled to the source's token target, is the cumulative
token demand D(u). A source's documents, laid end to end in a fixed
pseudo-random order and repeated as often as the target asks, take the training
position D^-1(tokens before the middle of the document). Sorting by position is
a range sort.

Order within a source needs a prefix sum over all its tokens. It is taken in two
steps, over slices of the order key and inside each slice, so that a source with
a third of all rows is spread over as many tasks as it has slices. The order key is a
digest of id and text, so rows without an id or with the same one are spread too; equal
rows are one entry with a count, and get their places by arithmetic.

Defined results: null text has size 0; a null source is a source of its own,
sorted last; sources of size 0 have target 0 and take nothing; documents of size
0 take 0 words; rows that share id, source and text stand one after another, in
``mixed_documents`` by all their columns, each with copies of its own; texts may be of any length; an
empty table gives an empty result. Extra input columns are ignored by ``mix`` and kept by
``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import free_name, row_hash, stage, word_count

#: Rows that one slice of the order key should hold.
SLICE_ROWS = 20_000


def order_key(doc_id: Column, text: Column) -> Column:
    """The pseudo-random place of a row within its source; a null id or text counts as empty."""
    empty = F.lit("")
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), empty), F.lit("/"), F.md5(F.coalesce(text, empty))))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, place (the order key) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order_key(F.col(id_col), F.col(text_col)).alias("place"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3) -> DataFrame:
    """source, source_size, weight, target: shares of all tokens, capped and reshared.

    The capped shares are min(max_epochs * size, level * weight) for the one level
    at which they add up to all tokens. Sorted by size / weight the capped
    sources are a prefix, so the level follows from prefix sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", cycle)
    everything = Window.partitionBy()
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.sum("source_size").over(everything).cast("double")
    before = F.coalesce(F.sum("source_size").over(by_need), F.lit(0)) * F.lit(float(max_epochs))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_need), F.lit(0.0))
    per = per.withColumn("level", (tokens - before) / left)
    fits = F.col("source_size") * F.lit(float(max_epochs)) / F.col("weight") >= F.col("level")
    per = per.withColumn("level", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "level"))).over(everything)["level"])
    capped = F.col("source_size") * F.lit(float(max_epochs))
    return per.select("source", "source_size", "weight", F.when(capped == 0, F.lit(0.0)).otherwise(F.least(capped, F.col("level") * F.col("weight"))).alias("target"))


def tilted_schedule(per_source: DataFrame, tilts: Sequence[float] = (0.5, 0.0, -0.5)) -> DataFrame:
    """Adds ``knots``: weight falls or rises linearly over time, by source weight class in turn."""
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), (F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(len(tilts))) + 1).cast("int"))
    knot = lambda t, w: F.struct(F.lit(float(t)).alias("t"), w.alias("w"))
    return per_source.withColumn("knots", F.array(knot(0, 1 + tilt), knot(1, 1 - tilt)))


def _demand(per_source: DataFrame) -> DataFrame:
    """Adds ``legs``: per stretch between knots its times, weights and the demand before it, scaled to the target."""
    knots = F.array_sort("knots")
    legs = F.transform(
        F.slice(knots, 1, F.greatest(F.size(knots) - 1, F.lit(0))),
        lambda k, i: F.struct(k["t"].alias("t0"), k["w"].alias("w0"), knots[i + 1]["t"].alias("t1"), knots[i + 1]["w"].alias("w1")),
    )
    out = per_source.withColumn("_legs", legs)
    area = lambda x: (x["w0"] + x["w1"]) / 2 * (x["t1"] - x["t0"])
    out = out.withColumn("_area", F.aggregate("_legs", F.lit(0.0), lambda a, x: a + area(x)))
    scaled = F.transform(
        "_legs",
        lambda x, i: F.struct(
            x["t0"].alias("t0"), x["t1"].alias("t1"),
            (x["w0"] * F.col("target") / F.col("_area")).alias("w0"), (x["w1"] * F.col("target") / F.col("_area")).alias("w1"),
            (F.aggregate(F.slice("_legs", 1, i), F.lit(0.0), lambda a, y: a + area(y)) * F.col("target") / F.col("_area")).alias("before"),
        ),
    )
    return out.withColumn("legs", F.when((F.col("_area") > 0) & (F.col("target") > 0), scaled)).drop("_legs", "_area", "knots")


def _invert(legs, demand):
    """The time at which cumulative demand reaches ``demand``: the root of the leg's quadratic."""
    leg = F.element_at(F.filter(legs, lambda x: (x["before"] <= demand) | (x["before"] == 0)), -1)
    rest = F.greatest(demand - leg["before"], F.lit(0.0))
    slope = (leg["w1"] - leg["w0"]) / (leg["t1"] - leg["t0"])
    root = F.sqrt(F.greatest(leg["w0"] * leg["w0"] + 2 * slope * rest, F.lit(0.0)))
    # 2c / (b + sqrt(b^2 + 2ac)) stays exact for slopes near 0
    step = F.when(rest == 0, F.lit(0.0)).otherwise(F.try_divide(2 * rest, leg["w0"] + root))
    return F.least(leg["t0"] + F.coalesce(step, F.lit(0.0)), leg["t1"])


def _placed(sizes: DataFrame, per_source: DataFrame | None, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """Every entry (equal rows, ``rows`` of them) with the tokens before it in its source, and the source's target and legs."""
    entries = stage(sizes.groupBy(*sizes.columns).agg(F.count("*").alias("rows")), "mix-sizes")
    if per_source is None:
        per_source = tilted_schedule(targets(entries.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, max_epochs))
    digits = max(1, len(f"{max(entries.count(), 1) // SLICE_ROWS:x}"))
    tokens = F.col("size") * F.col("rows")
    keyed = entries.withColumn("_slice", F.substring("place", 1, digits))
    slices = keyed.groupBy("source", "_slice").agg(F.sum(tokens).alias("_n"))
    upto = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as slices
    slices = slices.select(F.col("source").alias("_source"), F.col("_slice").alias("_in"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    source = _demand(per_source).withColumnRenamed("source", "_of")
    inside = Window.partitionBy("source", "_slice").orderBy("place", *[c for c in sizes.columns if c not in ("source", "place")]).rowsBetween(Window.unboundedPreceding, -1)
    here = keyed.withColumn("_here", F.coalesce(F.sum(tokens).over(inside), F.lit(0)))
    here = here.join(slices, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_in"))).join(source, F.col("source").eqNullSafe(F.col("_of")))
    return here.withColumn("before", F.col("_before") + F.col("_here")).drop("_source", "_in", "_of", "_before", "_here", "_slice")


def _taken(placed: DataFrame) -> DataFrame:
    """Each row of each entry with its copies and their positions; adds ``copies``, ``positions``."""
    each = placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    middle = F.col("before") + F.col("_i") * F.col("size") + F.col("size") / 2
    copies = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.ceil((F.col("target") - middle) / F.col("source_size"))).otherwise(F.lit(0))
    each = each.withColumn("copies", F.greatest(copies, F.lit(0)).cast("int"))
    # a copy's middle in the token order, rescaled so that what is taken fills the demand exactly
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), lambda r: _invert(F.col("legs"), F.least(r * F.col("source_size") + middle, F.col("target"))))
    return each.withColumn("positions", F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<double>")))


def mix(sizes: DataFrame, per_source: DataFrame | None = None, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, positions (one for each copy) of every row of ``sized``.

    Copy r of a document whose source has c tokens before it stands at r * S + c;
    it is taken if its middle lies below the target. So a source takes its target
    to within half a document.
    """
    each = _taken(_placed(sizes, per_source, weights, max_epochs))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "positions")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy, range-sorted by training position."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame, per_source: DataFrame | None = None, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3) -> DataFrame:
    """The documents the mix takes, all columns kept, with ``copies`` and ``position``, that of the first, range-sorted by it.

    Rows are told apart by hashes of all columns; of rows that are equal in all of them one is repeated, with
    each one's own copies. Where ``docs`` has a column of either name, the new one gets a ``_`` at its end.
    """
    names = {c: free_name(docs, c) for c in ("copies", "position")}
    mark = [free_name(docs, f"_mark{k}") for k in (1, 2)]
    one, two, first, times = (free_name(docs, c) for c in ("_one", "_two", "_first", "_times"))
    marked = docs.withColumns({m: row_hash(docs, k) for k, m in enumerate(mark)})
    entries = marked.select("source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("place"), F.col(mark[0]).alias("one"), F.col(mark[1]).alias("two"))
    placed = stage(_placed(entries, per_source, weights, max_epochs).select("one", "two", "source_size", "target", "legs", "size", "before", "rows"), "mix-placed")
    taken = _taken(placed).where("copies > 0").select(F.col("one").alias(one), F.col("two").alias(two), "rows", F.element_at("positions", 1).alias(first), F.col("copies").alias(times))
    same = (F.col(mark[0]) == F.col(one)) & (F.col(mark[1]) == F.col(two))
    kept = [F.col(f"`{c}`") for c in docs.columns] + [F.col(times).alias(names["copies"]), F.col(first).alias(names["position"])]
    again = placed.where("rows > 1").select(F.col("one").alias(one), F.col("two").alias(two))
    one_of = marked.join(again, same, "left_semi").dropDuplicates(mark)
    out = marked.join(taken.where("rows = 1").drop("rows"), same).select(kept).unionByName(one_of.join(taken.where("rows > 1").drop("rows"), same).select(kept))
    return out.orderBy(names["position"], *(["doc_id"] if "doc_id" in docs.columns else []))
