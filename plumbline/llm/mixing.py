"""Mixing sources to target weights along a curriculum, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise

#: Blanks between words.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A schedule is a list of (time, weight factor) from time 0 to 1, linear in between.
Schedule = Sequence[tuple[float, float]]
STEADY: Schedule = ((0.0, 1.0), (1.0, 1.0))
EARLY: Schedule = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
LATE: Schedule = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))


def _integrals(schedule: Schedule) -> list[float]:
    out = [0.0]
    for (t, v), (u, w) in zip(schedule, schedule[1:], strict=False):
        out.append(out[-1] + (u - t) * (v + w) / 2)
    return out


def _time_of(share: Column, schedule: Schedule) -> Column:
    """The time by which a source has met ``share`` (0 to 1) of its demand: the inverse of its integrated weights."""
    area = _integrals(schedule)
    wanted = share * F.lit(area[-1])
    found = F.lit(1.0)
    for k in reversed(range(len(schedule) - 1)):
        (t, v), (u, w) = schedule[k], schedule[k + 1]
        rest, slope = wanted - F.lit(area[k]), (w - v) / (u - t)
        # slope / 2 * x^2 + v * x = rest, in the form that also holds for slope 0
        x = 2 * rest / (F.lit(v) + F.sqrt(F.greatest(F.lit(0.0), F.lit(v * v) + F.lit(2 * slope) * rest)))
        here = F.when(rest <= 0, F.lit(t)).otherwise(F.least(F.lit(u), F.lit(t) + x))
        found = F.when(wanted < F.lit(area[k + 1]), here).otherwise(found) if k < len(schedule) - 2 else here
    return found


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    schedules: Sequence[Schedule] = (EARLY, STEADY, LATE),
    keep: Sequence[str] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """How much of each document a training run takes, and when: one row per document.

    Columns: ``doc`` (struct of the columns in ``keep``, by default all), size (words of the text), source_size, target
    (words that the source should give), taken, and copies (array of epoch, words, position).

    Sources in code point order, null last, weigh ``weights`` in turn. Together they give ``share`` times all words; a source
    stops at ``cap`` times its size, and what is above goes to the others by weight. A source's documents stand in the
    order of md5 of their id; the source is read in that order, up to ``cap`` times, until its target is met, so the last
    document may be taken in part (its first words). Each source's weight over time follows its schedule, in turn as
    well; a document's position is the time at which the integrated weight reaches the words before it.

    Prefix sums run in two levels, within and across about sqrt(rows) ranges of md5, so that a source with most rows is
    spread over as many tasks. A null or empty text has size 0 and is not taken. Null sources are one source. Rows with equal
    or null ids are documents of their own, ordered by text. An empty table gives no rows. Columns of the input keep
    their names inside ``doc``.
    """
    keep = list(docs.columns if keep is None else keep)
    bits = max(0, math.ceil(math.log2(max(1, docs.count())) / 2))
    spread = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    source = F.col(source_column).cast("string")
    rows = docs.select(
        F.struct(*keep).alias("doc"),
        # in code point order, null last
        F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), source)).alias("src"),
        n_words(F.col(text_column)).alias("size"),
        spread.alias("spread"),
        F.col(id_column).alias("id"),
        F.xxhash64(text_column).alias("tie"),
        F.shiftright(F.conv(F.substring(spread, 1, 8), 16, 10).cast("long"), 32 - bits).alias("cell"),
    )
    cells = materialise(rows.groupBy("src", "cell").agg(F.sum("size").alias("n")), "mix-cells")
    plan = targets(cells.groupBy("src").agg(F.sum("n").alias("source_size")), weights, share, cap).withColumn("schedule", (F.col("rank") - 1) % len(schedules))
    earlier = F.sum("n").over(Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("src", "cell", F.coalesce(earlier, F.lit(0)).alias("offset")).join(plan, "src")
    within = Window.partitionBy("src", "cell").orderBy("spread", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(cells, ["src", "cell"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    quota = F.round(F.col("target")).cast("long")

    def copy(epoch: int) -> Column:
        at = F.col("before") + F.lit(epoch) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), quota - at)).cast("long")
        time = F.lit(None).cast("double")
        for k, s in enumerate(schedules):
            time = F.when(F.col("schedule") == k, _time_of(at / quota, s)).otherwise(time)
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), time.alias("position"))

    copies = F.filter(F.array(*[copy(e) for e in range(cap)]), lambda c: c["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return placed.withColumn("copies", copies).select("doc", "size", "source_size", "target", taken.alias("taken"), "copies")


def targets(sources: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """Target of each row of (src, source_size): ``min(cap * size, level * weight)`` with the level that meets the total.

    With sources sorted by the level at which they stop, each prefix of stopped sources gives a level for the rest; the right
    one is the largest of these. One row per source, so a single task orders them.
    """
    order = Window.orderBy("src")
    every = Window.partitionBy()
    by_stop = Window.orderBy("stop", "rank")
    out = sources.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    out = out.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    out = out.withColumn("stop", F.col("most") / F.col("weight"))
    stopped = F.coalesce(F.sum("most").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    going = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(share) * F.sum("source_size").over(every)
    out = out.withColumn("level", (total - stopped) / going)
    out = out.withColumn("target", F.least(F.col("most"), F.max("level").over(every) * F.col("weight")))
    return out.select("src", "source_size", "rank", "target")


def in_order(mixed: DataFrame) -> DataFrame:
    """Documents of ``mix`` sorted by the position of their first copy; those that are not taken come last."""
    rows = mixed.withColumn("position", F.coalesce(F.get("copies", F.lit(0))["position"], F.lit(2.0)))
    rows = rows.withColumn("tie", F.xxhash64("doc")).repartitionByRange("position", "tie").sortWithinPartitions("position", "tie")
    return rows.drop("tie").withColumn("position", F.when(F.col("position") < 2, F.col("position")))


def stream(mixed: DataFrame, text_column: str = "text", n_chars_column: str = "n_chars") -> DataFrame:
    """The training stream: the kept columns of each copy that is taken, sorted by position.

    A copy taken in part holds its first words, joined by one blank, and ``n_chars_column``, if there is one, its length.
    """
    rows = mixed.select("doc", "size", F.explode("copies").alias("copy"))
    fields = mixed.schema["doc"].dataType.names
    first_words = F.array_join(F.slice(F.split(F.regexp_replace(F.col("doc")[text_column], rf"\A{BLANKS}", ""), BLANKS), 1, F.col("copy.words").cast("int")), " ")
    text = F.when(F.col("copy.words") < F.col("size"), first_words).otherwise(F.col("doc")[text_column])
    rows = rows.withColumn("own_text", text).withColumn("tie", F.xxhash64("doc"))
    rows = rows.repartitionByRange("copy.position", "tie").sortWithinPartitions("copy.position", "tie")
    whole = F.col("copy.words") >= F.col("size")

    def column(name: str) -> Column:
        if name == text_column:
            return F.col("own_text").alias(name)
        if name == n_chars_column:
            own = F.col("doc")[name]
            return F.when(whole, own).otherwise(F.length("own_text").cast(mixed.schema["doc"].dataType[name].dataType)).alias(name)
        return F.col("doc")[name].alias(name)

    return rows.select(*[column(n) for n in fields])


#: The same in SQL, without positions.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS no_source, md5(CAST(doc_id AS VARCHAR)) AS spread,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT no_source, s, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY no_source, s) AS rank FROM d GROUP BY no_source, s),
w AS (SELECT *, CAST([5, 2, 1][CAST((rank - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM s),
l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * (sum(source_size) OVER ())
             - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)))
            / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT no_source, s, source_size, least(most, max(level) OVER () * weight) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS quota,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.no_source, d.s ORDER BY d.spread, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t USING (no_source, s))
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, quota - before)) + greatest(0, least(size, quota - source_size - before)) AS BIGINT) AS taken
FROM p
"""
