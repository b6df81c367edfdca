"""Line deduplication by overlapping three-line windows.

Each run of three consecutive lines is hashed; a window found at an earlier place (by doc_id,
then position) is a repeat. All lines that some repeat covers are removed at once: covered
positions of overlapping repeats merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import Numbered, meet
from lattix.plans.storage import materialize, release

LINES = 3


def dedup_lines(docs: DataFrame, width: int = LINES) -> DataFrame:
    """``docs`` with the later occurrences of repeated windows cut out of ``text``, ``n_lines`` (before) and ``n_removed``.

    Lines end at U+000A only. Windows are compared by two independent 64-bit hashes of their
    lines. The first occurrence, by doc_id (null first), hash of the text and position, stays
    unless another repeat covers its lines. Documents of fewer lines than a window are unchanged.
    A null text stays null with 0 lines; an empty one has one empty line. Rows that repeat a
    doc_id with its text count as one document and get the same result. Columns named like results, in any
    case, are replaced.
    """
    results = ("text", "n_lines", "n_removed")
    table = Numbered(docs)
    held, plain, names = table.plain(results)
    whole = table["text"].cast("string")
    marked = table.df.select(*held, table["doc_id"].alias("d"), F.xxhash64(whole).alias("th"), whole.alias("body"))
    lines = marked.where("body is not null").select("d", "th", F.split("body", "\n", -1).alias("lines")).where(F.size("lines") >= width)
    window = F.transform(
        F.sequence(F.lit(0), F.size("lines") - width),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[F.get(F.col("lines"), i + k) for k in range(width)]).alias("a"),
            F.xxhash64(F.lit("b"), *[F.get(F.col("lines"), i + k) for k in reversed(range(width))]).alias("b"),
        ),
    )
    windows = materialize(lines.select("d", "th", F.explode(window).alias("w")).select("d", "th", "w.pos", "w.a", "w.b"), "line-windows")
    firsts = materialize(windows.groupBy("a", "b").agg(F.min(F.struct("d", "th", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-firsts")
    later = meet(windows, firsts, ["a", "b"], "n").where(~F.struct("d", "th", "pos").eqNullSafe(F.col("first")))
    span = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + width - 1))))
    cover = materialize(later.groupBy("d", "th").agg(F.collect_set("pos").alias("at")).select(F.col("d").alias("own"), F.col("th").alias("own_th"), span.alias("covered")), "line-covered")
    release(windows, firsts)
    # one way at every size: by exchange, since what is covered grows with the table
    joined = marked.join(cover.hint("merge"), F.col("d").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th")), "left").withColumn("lines", F.split("body", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    out = joined.select(
        *plain,
        F.when(F.col("covered").isNull(), F.col("body")).otherwise(left).alias("text"),
        F.when(F.col("body").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"),
    )
    return out.toDF(*names, *results)
