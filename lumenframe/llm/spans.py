"""Places of pattern matches, in Spark expressions. Offsets are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers whose running sums are taken together.
RUN = 512


def let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value evaluated once for each row."""
    return F.transform(F.array(value), use)[0]


def indexes(n: Column) -> Column:
    """0, 1, .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running(numbers: Column) -> Column:
    """The sum of the numbers before each place, and at last of all of them: array<int>.

    Sums are taken in runs, then over the runs, so n numbers cost n * RUN + (n / RUN)^2 steps."""
    acc = "struct<pos:int,out:array<int>>"

    def prefix(xs: Column, size) -> Column:  # noqa: ANN001
        zero = F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(acc)
        return F.aggregate(xs, zero, lambda a, x: F.struct((a["pos"] + size(x)).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")).cast(acc))

    def whole(xs: Column) -> Column:
        # get() reads one place, slice() would copy the whole array for each run
        part = lambda r: F.transform(indexes(F.least(F.lit(RUN), F.size(xs) - r * RUN)), lambda j: F.get(xs, r * RUN + j))
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / RUN).cast("int")), lambda r: prefix(part(r), lambda x: x))
        return let(runs, lambda rs: let(prefix(rs, lambda r: r["pos"]), lambda base: F.concat(F.flatten(F.zip_with(rs, base["out"], lambda r, b: F.transform(r["out"], lambda p: p + b))), F.array(base["pos"]))))

    return let(numbers, whole)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct(start, end, value, before)>; before is the text since the last match.

    What lies between matches and the matches themselves give the offsets, as the engine
    has no function for positions of all matches. pattern never matches the empty string."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(p: Column) -> Column:
        steps = F.transform(p["found"], lambda v, i: F.length(v) + F.length(F.get(p["gaps"], i)))

        def one(ends: Column) -> Column:
            def of(v: Column, i: Column) -> Column:
                end, gap = F.get(ends, i + 1), F.get(p["gaps"], i)
                return F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value"), gap.alias("before"))

            return F.transform(p["found"], of)

        return let(running(steps), one)

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)
