"""Positions of regular-expression matches with built-in functions only."""

from pyspark.sql import Column, functions as F

from tracklens.llm.common import bound

BLOCK = 128


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs of start, end (code points, end exclusive) and value.

    The text is split at the matches; a match starts after all earlier gaps and matches. Lengths are summed inside blocks of
    `BLOCK` matches and then over the blocks, so no array grows match by match. Patterns must not match empty text.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def walked(pairs: Column) -> Column:
        """Length of a block's gaps and matches, and its matches with starts counted from the block's start."""
        return F.aggregate(
            pairs, F.struct(F.lit(0).alias("at"), none.alias("found")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["value"]), F.lit(0))).alias("at"),
                F.when(p["value"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(
                    (acc["at"] + F.length(p["gap"])).alias("start"), (acc["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("end"), p["value"].alias("value"),
                )))).alias("found"),
            ),
        )

    def moved(blocks: Column) -> Column:
        offsets = F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        )["starts"]
        return bound(offsets, lambda starts: F.flatten(F.transform(blocks, lambda b, i: bound(F.get(starts, i), lambda at: F.transform(
            b["found"], lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["value"].alias("value")),
        )))))

    def located(t: Column) -> Column:
        pairs = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("value"))
        cut = lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(BLOCK)), lambda i: walked(F.slice(p, i, BLOCK)))
        return bound(bound(pairs, cut), moved)

    return F.when(text.rlike(pattern), bound(text, located)).otherwise(none)
