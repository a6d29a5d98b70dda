"""Names in the order of arrival: each claim gets the first free one of ``name``, ``name 1``, ``name 2`` and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.staging import Scratch, stage, unstage

#: A name that another name leads to as well: the part before its number, and the number.
_NUMBERED = r"^(.*\S) ([1-9]\d{0,8})$"


def _both_readings(key: Column) -> Column:
    """A name as the first of its own row (number 0), and as a numbered one of a shorter name's row."""
    shorter, number = F.regexp_extract(key, _NUMBERED, 1), F.regexp_extract(key, _NUMBERED, 2).try_cast("int")
    return F.filter(F.array(F.struct(key.alias("row"), F.lit(0).alias("n")), F.struct(shorter.alias("row"), number.alias("n"))), lambda x: x["row"] != "")


def in_arrival_order(claims: DataFrame, reserved: DataFrame, folder: str = "folder", name: str = "name", ordinal: str = "ordinal", max_rounds: int = 200) -> DataFrame:
    """``claims`` with ``given``: the name that each would get if they came one by one, ordinals ascending.

    Names compare whatever their case, within a folder. ``reserved`` (``folder``, ``name``) is never given.
    All claims to one name stand in a row, and take its numbers in order; a number is passed over if it is
    reserved, or if an earlier claim to another name has it (``a 1`` may be asked for by itself). Which
    ones are passed over follows from the names given, and the other way round: both are worked out in
    rounds until nothing changes, which is what one by one gives, as the first claims are settled
    first. A round sees all claims at once; there are about as many as names that lead to each
    other in turn. Raises if they are more than ``max_rounds``. Ordinals are distinct.
    """
    keep = Scratch()
    key = lambda f, n: F.concat(F.coalesce(F.col(f), F.lit("")), F.lit("/"), F.lower(n))
    rows = claims.select(F.col(ordinal).alias("o"), key(folder, name).alias("row"))
    rows = keep(rows.withColumn("j", (F.row_number().over(Window.partitionBy("row").orderBy("o")) - 1).cast("int")), "claims")
    sizes = rows.groupBy("row").agg(F.max("j").alias("last"))
    taken = reserved.select(F.explode(_both_readings(key(folder, name))).alias("r")).select("r.row", "r.n", F.lit(None).cast("long").alias("by"))
    taken = keep(taken.distinct().join(sizes.select("row"), "row", "left_semi"), "taken")
    now, before = stage(rows.select("o", "row", "j", F.col("j").alias("n")), "given"), None
    passed = None  # row, n: numbers passed over in the last round
    for _ in range(max_rounds):
        reading = F.concat("row", F.when(F.col("n") > 0, F.concat(F.lit(" "), F.col("n").cast("string"))).otherwise(""))
        other = now.select("row", F.col("o").alias("by"), F.explode(_both_readings(reading)).alias("r")).where("r.row <> row")
        other = other.select("r.row", "r.n", "by").join(sizes.select("row"), "row", "left_semi").groupBy("row", "n").agg(F.min("by").alias("by"))
        asked = taken.unionByName(other).groupBy("row", "n").agg(F.max(F.col("by").isNull()).alias("reserved"), F.min("by").alias("by"))
        # The claim that would take a number: as many before it as smaller numbers that are not passed over.
        marked = asked.withColumn("was", F.lit(True)) if passed is None else asked.join(passed.withColumn("was", F.lit(True)), ["row", "n"], "left")
        earlier = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        marked = marked.withColumn("j", (F.col("n") - F.coalesce(F.count_if(F.coalesce("was", F.lit(False))).over(earlier), F.lit(0))).cast("int"))
        there = marked.join(rows.select("row", "j", "o"), ["row", "j"], "left")
        over = stage(there.where(F.col("reserved") | (F.col("by") < F.col("o"))).select("row", "n"), "passed")
        # A claim's number is its place and the passed numbers up to it.
        rank = F.row_number().over(Window.partitionBy("row").orderBy("n")) - 1
        steps = over.select("row", (F.col("n") - rank).cast("int").alias("j"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["o"].dataType).alias("o"))
        line = Window.partitionBy("row").orderBy("j", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = rows.select("row", "j", F.lit(1).alias("kind"), "o").unionByName(steps)
        new = every.withColumn("n", (F.col("j") + F.sum(1 - F.col("kind")).over(line)).cast("int")).where("kind = 1").select("o", "row", "j", "n")
        new = stage(new, "given")
        mark = new.agg(F.sum(F.xxhash64("o", "n").cast("decimal(38,0)")).alias("h")).first().h, over.agg(F.sum(F.xxhash64("row", "n").cast("decimal(38,0)")).alias("h")).first().h
        unstage(now, *([passed] if passed is not None else []))
        now, passed = new, over
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"names did not settle in {max_rounds} rounds")
    given = F.concat(F.col(name), F.when(F.col("n") > 0, F.concat(F.lit(" "), F.col("n").cast("string"))).otherwise(""))
    out = stage(claims.join(now.select(F.col("o").alias("_o"), "n"), F.col(ordinal) == F.col("_o")).withColumn("given", given).drop("_o", "n"), "named")
    unstage(now, passed)
    keep.clear()
    return out
