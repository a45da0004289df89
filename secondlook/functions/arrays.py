"""Column functions on sorted arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_up_to(values: Column, x: Column) -> Column:
    """How many entries of ``values``, an ascending array without nulls, are at most ``x``; null if either is null.

    A binary search: as many steps as the length has binary digits.
    """
    size = F.size(values)
    whole = F.struct(F.lit(0).alias("low"), size.alias("high"))

    def halved(found: Column, _: Column) -> Column:
        low, high = found["low"], found["high"]
        middle = F.shiftright(low + high, 1)
        open_, up = low < high, F.get(values, middle) <= x
        return F.struct(
            F.when(open_ & up, middle + 1).otherwise(low).alias("low"),
            F.when(open_ & ~up, middle).otherwise(high).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.length(F.bin(size)))
    found = F.aggregate(steps, whole, halved, lambda found: found["low"])
    return F.when(values.isNotNull() & x.isNotNull(), found)
