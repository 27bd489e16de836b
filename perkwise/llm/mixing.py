"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source's target over its size is the expected number of copies of its documents. The whole copies are
certain; of the fractional ones, documents meet in pairs and word mass moves at random from one to the other
until one of the two is integral. The expectation of each document is kept, and so is the sum of words, so a
source misses its target by less than one document. Blocks of neighbours in size are folded at once, and the
residuals of 64 blocks are folded again, up to one residual per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkwise.llm.common import WORD, row_key
from perkwise.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK = 64
RESERVE = 32
# Fractions are whole numbers of 2**-32, so moving mass is exact.
UNIT = 1 << 32
_UNIT_STATE = "struct<key:bigint,size:bigint,mass:bigint>"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES,
                   source_col: str = "source", size_col: str = "size") -> DataFrame:
    """Target of each source: (source, source_size, target).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target
    stops at ``most`` times its source's size and the excess goes to the others by weight. With sources in
    order of limit over weight, those that stop are the first ones, so the level of the rest follows from
    running sums: one row per source, no loop.
    """
    per_source = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    turn = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(turn) - 1) % len(weights) + 1)
    rows = per_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (rows.withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            .withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
            .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = (F.col("total") - F.col("stopped")) / F.col("open")
    # The first source that stays below its limit sets the level for itself and all after it.
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    first = F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("limit"), F.coalesce(first * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", target.alias("target"))


def _draw(seed: int, level: int, a: Column, b: Column) -> Column:
    """A number in [0, 1) that depends only on the pair."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), a, b), 11) / F.lit(float(1 << 53))


def _fold(items: Column, seed: int, level: int) -> Column:
    """Documents of a block one after another against the residual: (residual, decided)."""

    def step(state: Column, new: Column) -> Column:
        old = state["residual"]
        to_old = F.least(old["size"] * UNIT - old["mass"], new["mass"])
        to_new = F.least(old["mass"], new["size"] * UNIT - new["mass"])
        moved = F.when(_draw(seed, level, old["key"], new["key"]) * (to_old + to_new) < to_new, to_old).otherwise(-to_new)
        # One array element, so that what was drawn is computed once.
        return F.transform(F.array(moved), lambda m: _settled(state, old, new, m))[0]

    def _settled(state: Column, old: Column, new: Column, moved: Column) -> Column:
        now = F.struct(old["key"].alias("key"), old["size"].alias("size"), (old["mass"] + moved).alias("mass"))
        then = F.struct(new["key"].alias("key"), new["size"].alias("size"), (new["mass"] - moved).alias("mass"))
        old_done = (now["mass"] == 0) | (now["mass"] == now["size"] * UNIT)
        return F.struct(
            F.when(old_done, then).otherwise(now).alias("residual"),
            F.concat(state["decided"], F.array(F.when(old_done, now).otherwise(then))).alias("decided"))

    start = F.struct(items[0].alias("residual"), F.array().cast(f"array<{_UNIT_STATE}>").alias("decided"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def _folded(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """Fold the rows (source, place, key, size, mass) of each place; larger documents first."""
    items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "size", "mass")))
    plain = F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"), x["mass"].alias("mass")))
    return (rows.groupBy("source", "place").agg(items.alias("items"))
            .withColumn("items", plain).withColumn("fold", _fold(F.col("items"), seed, level))
            .select("source", "place", "fold.*"))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def unit_copies(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int,
                id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(key, id, source, size, repeats, source_size, target, total): copies of all rows of one id, source and size."""
    units = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size"))
                  .groupBy("id", "source", "size").agg(F.count("*").alias("repeats"))
                  .withColumn("key", row_key("id", "source", "size")), "mixing-units")
    targets = stage(source_targets(units.withColumn("size", F.col("size") * F.col("repeats")), weights, most), "mixing-targets")
    same = units["source"].eqNullSafe(targets["source"])
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("repeats")
    joined = (units.join(targets, same, "left").drop(targets["source"])
              .withColumn("sure", F.when(F.col("size") > 0, F.floor(wanted)).otherwise(0))
              .withColumn("share", F.when(F.col("size") > 0, F.round((wanted - F.col("sure")) * UNIT).cast("long")).otherwise(0)))
    # Neighbours in size: classes an eighth of a doubling wide, cut by digest into blocks.
    open_rows = joined.filter("share > 0").select(
        "source", "key", "size", (F.col("share") * F.col("size")).alias("mass"),
        F.floor(F.log2("size") * 8).alias("class"))
    classes = open_rows.groupBy("source", "class").agg(F.count("*").alias("n"))
    # The smallest few documents of a source wait for its last residual, which they can then settle.
    up = Window.partitionBy("source").orderBy("class")
    classes = classes.withColumn("blocks", F.when(F.sum("n").over(up) > RESERVE, F.ceil(F.col("n") / BLOCK)).otherwise(0))
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    classes = stage(classes.withColumn("first", F.sum("blocks").over(down) - F.col("blocks")), "mixing-classes")
    last, some = classes.agg(F.max(F.col("first") + F.col("blocks")), F.count("*")).first()
    places = max(last or 0, min(some, 1))
    hit = open_rows["source"].eqNullSafe(classes["source"]) & (open_rows["class"] == classes["class"])
    place = F.when(F.col("blocks") > 0, F.col("first") + F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")))
    rows = open_rows.join(classes, hit).select(open_rows["source"], "key", "size", "mass", place.alias("place"))
    placed, reserve = rows.filter("place is not null"), rows.filter("place is null").withColumn("place", F.lit(0).cast("long"))
    level, parts = 0, []
    while places:
        if places == 1:
            placed = placed.unionByName(reserve)
        folded = stage(_folded(placed, seed, level), "mixing-fold")
        parts.append(folded.select("source", F.explode("decided").alias("x")).select("source", "x.*"))
        residuals = folded.select("source", "place", "residual.*")
        if places == 1:
            # The one residual of a source goes to the nearer whole number.
            whole = F.when(F.col("mass") * 2 >= F.col("size") * UNIT, F.col("size") * UNIT).otherwise(0)
            parts.append(residuals.select("source", "key", "size", whole.alias("mass")))
            break
        placed = residuals.withColumn("place", F.floor(F.col("place") / BLOCK))
        places, level = -(-places // BLOCK), level + 1
    out = joined.withColumn("extra", F.lit(0))
    if parts:
        decided = parts[0]
        for part in parts[1:]:
            decided = decided.unionByName(part)
        decided = decided.select("key", (F.col("mass") > 0).cast("int").alias("extra"))
        out = joined.join(decided, "key", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    return out.withColumn("total", (F.col("sure") + F.col("extra")).cast("long"))


def _copies(row: Column) -> Column:
    """Copies of row i (from 0) of a unit of n rows: (total + i) // n."""
    return F.floor((F.col("total") + row) / F.col("repeats")).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 42,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Copies of every document: (id, size, source, source_size, target, copies, taken).

    A null or text without words has size 0 and is taken 0 times. Rows of one id, source and size are one
    unit whose copies are shared evenly among them, so repeated rows, ties and null ids need no special
    order. Other columns are ignored; an empty table gives no rows. Reruns agree.
    """
    out = unit_copies(docs, weights, most, seed, id_col, source_col, text_col)
    return (out.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
            .withColumn("copies", _copies(F.col("row")))
            .select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 42,
                    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns, whatever their names.

    Rows of size 0 (null texts, texts without words) are taken 0 times and so are not in it. Rows of one id, source
    and size share their copies by the order of a digest of the text; of equal texts any may get one more, which
    shows in no text. An empty table gives no rows.
    """
    units = unit_copies(docs, weights, most, seed, id_col, source_col, text_col).select("key", "repeats", "total")
    own = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    named = docs.toDF(*own.values()).withColumn("size", _size(own[text_col]))
    rows = named.withColumn("key", row_key(own[id_col], own[source_col], "size")).join(units, "key")
    row = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(own[text_col]))) - 1
    copies = F.floor((F.col("total") + F.when(F.col("repeats") > 1, row).otherwise(0)) / F.col("repeats"))
    return (rows.withColumn("copies", copies.cast("int")).filter("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(n).alias(c) for c, n in own.items()]))
