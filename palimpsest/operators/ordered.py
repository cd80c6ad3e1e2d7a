"""Order without a single task: global positions, cascades of log records, sections and stitched records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, bucket: str, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Each row's place from 1 in the order of (bucket, order). ``bucket`` is an ascending range of the order, such as
    the hour; a task numbers one bucket, and the running sum is over one row a bucket."""
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("__n"))
    before = sizes.select(bucket, (F.sum("__n").over(Window.orderBy(bucket)) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("__i", inside).join(before, bucket).withColumn(name, (F.col("__i") + F.col("__before")).cast("long")).drop("__i", "__before")


def near(roots: DataFrame, others: DataFrame, pos: str, before: int, after: int, width: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of a root and another row, of equal ``by``, whose position lies from ``before`` places ahead of it up to
    ``after`` behind.

    A band join as an equality join: positions are cut into blocks of the band's width, and a root looks into the
    blocks that its band touches. Positions are unique, so a block has a bounded number of rows whatever the data.
    """
    width = width or before + after + 1
    low, high = F.floor((F.col(pos) - before) / width), F.floor((F.col(pos) + after) / width)
    a = roots.select(*[F.col(c).alias(f"root_{c}") for c in roots.columns], *by, F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("__block"))
    b = others.withColumn("__block", F.floor(F.col(pos) / width).cast("long"))
    gap = F.col(pos) - F.col(f"root_{pos}")
    return a.join(b, ["__block", *by]).where((gap >= -before) & (gap <= after) & (gap != 0)).drop("__block")


def later_counts(rows: DataFrame, group: str, time: str, root: str, child: str, bucket: str) -> DataFrame:
    """For each root row how many child rows of its group come later: suffix sums in two levels (bucket, then inside),
    in place of a join of all pairs. Rows of equal time are not later."""
    marks = rows.withColumn("__c", F.when(F.expr(child), 1).otherwise(0))
    totals = marks.groupBy(group, bucket).agg(F.sum("__c").alias("__t"))
    after = Window.partitionBy(group).orderBy(bucket).rowsBetween(1, Window.unboundedFollowing)
    beyond = totals.select(group, bucket, F.coalesce(F.sum("__t").over(after), F.lit(0)).alias("__beyond"))
    inside = Window.partitionBy(group, bucket).orderBy(F.col(time).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy(group, bucket, time)
    own = F.sum("__c").over(inside) - F.sum("__c").over(level)
    return marks.withColumn("__in", own).join(beyond, [group, bucket]).where(root).withColumn("n_later", (F.col("__in") + F.col("__beyond")).cast("long")).drop("__c", "__in", "__beyond")


def latest_before(rows: DataFrame, marks: DataFrame, group: str, time: str, value: str, span: int, name: str) -> DataFrame:
    """Each row with the greatest ``value`` of the marks of its group whose time is less than the row's, null without one.

    Times are whole numbers. As in ``later_counts``, maxima of buckets of ``span`` are carried on from bucket to bucket, and
    inside one bucket a window looks back, so no task holds a group.
    """
    both = rows.withColumn("__v", F.lit(None).cast(marks.schema[value].dataType)).withColumn("__row", F.lit(True))
    added = marks.select(F.col(group), F.col(time), F.col(value).alias("__v"), F.lit(False).alias("__row"))
    both = both.unionByName(added, allowMissingColumns=True).withColumn("__b", F.floor(F.col(time) / span))
    upto = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(group, "__b").agg(F.max("__v").alias("__m")).select(group, "__b", F.max("__m").over(upto).alias("__before"))
    inside = F.max("__v").over(Window.partitionBy(group, "__b").orderBy(time).rangeBetween(Window.unboundedPreceding, -1))
    told = both.withColumn("__in", inside).where("__row").join(carried, [group, "__b"])
    return told.withColumn(name, F.greatest("__in", "__before")).drop("__v", "__row", "__b", "__in", "__before")


def stitch(lines: DataFrame, group: Sequence[str], order: Sequence[str], text: str, is_head: str, sep: str = " ", span: int | None = None) -> DataFrame:
    """Records of a head line and the lines up to the next one; lines before the first head are record 0.

    ``span``: the first of ``order`` is a whole number, and heads are counted in blocks of so many of them, sums of blocks
    carried on, so that no task holds a group (which is then not null); without it a task does.
    """
    head = F.when(F.expr(is_head), 1).otherwise(0)
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if span is None:
        numbered = lines.withColumn("record", F.sum(head).over(upto(*group)).cast("long"))
    else:
        blocks = lines.withColumn("__b", F.floor(F.col(order[0]) / span))
        earlier = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        before = blocks.groupBy(*group, "__b").agg(F.sum(head).alias("__n")).select(*group, "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
        inside = blocks.withColumn("__in", F.sum(head).over(upto(*group, "__b"))).join(before, [*group, "__b"])
        numbered = inside.withColumn("record", (F.col("__in") + F.col("__before")).cast("long")).drop("__in", "__before", "__b")
    entry = F.struct(*order, F.col(text).alias("__text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["__text"]), sep)
    return numbered.groupBy(*group, "record").agg(joined.alias("message"), F.count("*").alias("n_lines"))


def sections(lines: DataFrame, group: Sequence[str], order: Sequence[str], marker: str, name: str = "section", span: int | None = None) -> DataFrame:
    """Each line's section: the last marker (a nullable column) at or before it. ``span`` as in ``stitch``."""
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if span is None:
        return lines.withColumn(name, F.last(marker, ignorenulls=True).over(upto(*group)))
    blocks = lines.withColumn("__b", F.floor(F.col(order[0]) / span))
    last = F.max(F.when(F.col(marker).isNotNull(), F.struct(*order, F.col(marker).alias("__m"))))["__m"].alias("__m")
    earlier = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.groupBy(*group, "__b").agg(last).select(*group, "__b", F.last("__m", ignorenulls=True).over(earlier).alias("__before"))
    inside = blocks.withColumn("__in", F.last(marker, ignorenulls=True).over(upto(*group, "__b"))).join(before, [*group, "__b"])
    return inside.withColumn(name, F.coalesce("__in", "__before")).drop("__in", "__before", "__b")
