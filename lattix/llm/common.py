"""Row keys, held-out split and bounded label samples that the text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most labelled rows (in expectation) that a classifier is fitted on. The choice hangs on a
#: hash of doc_id alone, so it is the same however the table is partitioned.
FIT_ROWS = 20_000
#: Bytes of text and rows that a Python kernel works on at a time, whatever Spark's batches hold.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 2048


#: Bytes of an Arrow batch between Spark and Python. Spark's own default is a quarter of a gigabyte.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that neither many rows nor long texts fill a worker.

    The limit is a setting of the session; one that is lower already stays.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(conf.get(key, str(1 << 30))) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids (crc32 of the id as text, modulo 4, is 2) that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled(key: Column, share: float) -> Column:
    """True for about ``share`` of the distinct keys, chosen by hash."""
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1 << 30)) < int(share * (1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """``(text, y)`` of training rows: known label, id not held out, at most ``rows`` expected.

    Repeated label rows of an id count once, a positive one wins. The id table joined here
    is bounded by ``rows`` and so safe to broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    total = labels.where(F.col(label).isNotNull()).count()
    kept = known.where(sampled(F.col("doc_id"), rows / max(total, 1)))
    table = Numbered(docs)
    return table.df.select(table["doc_id"].alias("doc_id"), table["text"].alias("text")).join(F.broadcast(kept), "doc_id").select("text", "y")


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, part)`` for parts of at most ``rows`` rows and about ``limit`` bytes; nulls become empty."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and (held + size > limit or k - start >= rows):
            yield start, column.slice(start, k - start)
            start, held = k, 0
        held += int(size)
    if start < len(column):
        yield start, column.slice(start)


class Numbered:
    """A table with its columns renamed k0, k1, ..., so that no name of its own can clash with another or with a helper's.

    ``t[name]`` is the column of that name: the one spelt so, else the first that differs only in case.
    """

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.df = table.toDF(*[f"k{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str | None:
        same = [i for i, c in enumerate(self.names) if c.lower() == name.lower()]
        return next((f"k{i}" for i in same if self.names[i] == name), f"k{same[0]}" if same else None)

    def __getitem__(self, name: str) -> Column:
        if (k := self.at(name)) is None:
            raise KeyError(f"the table has no column {name}")
        return F.col(k)

    def kept(self, results: Iterable[str], only: Iterable[str] | None = None) -> list[Column]:
        """The table's columns under their names (or ``only`` those), but for names, whatever their case, that results take."""
        new = {r.lower() for r in results}
        wanted = None if only is None else {self.at(c) for c in only}
        return [F.col(f"k{i}").alias(c) for i, c in enumerate(self.names) if c.lower() not in new and (wanted is None or f"k{i}" in wanted)]

    def plain(self, results: Iterable[str], only: Iterable[str] | None = None) -> tuple[list[Column], list[str], list[str]]:
        """The columns of :meth:`kept` as h0, h1, ..., these names, and the names to return to."""
        kept = self.kept(results, only)
        short = [f"h{i}" for i in range(len(kept))]
        return [c.alias(h) for c, h in zip(kept, short, strict=True)], short, self.df.select(*kept).columns

    def shielded(self, *needed: str) -> DataFrame:
        """The table with columns k0, k1, ..., but for the ``needed`` ones, which are called so."""
        called = {self.at(n): n for n in needed if self.at(n)}
        return self.df.toDF(*[called.get(c, c) for c in self.df.columns])


def meet(many: DataFrame, one: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join on ``keys``, which are unique in ``one``; its column ``count`` tells how many rows of ``many`` have the key.

    A key above its share (one row in 2048 of all) is hot: its rows are dealt out by hash over as many parts as
    it has shares, and its row of ``one`` is copied to each. Hot keys are 2048 at most, so they are
    broadcast safely, and all copies together are no more than that again. The column ``count`` is dropped.
    """
    per = max(64, (one.agg(F.sum(count).alias("n")).first().n or 0) // 2048)
    parts = F.ceil(F.col(count) / per).cast("int")
    hot = one.where(F.col(count) > per).select(*keys, parts.alias("__parts"))
    spread = F.xxhash64(*([c for c, t in many.dtypes if "map<" not in t and c not in keys] or keys))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(spread, F.col("__parts")).cast("int"))).drop("__parts")
    copies = one.withColumn("__part", F.explode(F.when(F.col(count) > per, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))).drop(count)
    return dealt.join(copies, [*keys, "__part"], how).drop("__part")


def attach(docs: DataFrame, make, fields: str, keep: list[str] | None = None, also: tuple[str, ...] = (), text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Columns ``keep`` (default all) of each row and the result columns ``fields`` (DDL), in one narrow stage.

    ``make()`` runs once in each task and returns a function of (texts, more columns) for one
    slice, which gives one Arrow array per field. The further columns are ``also`` by name and the
    values of ``extra``, which are made from the columns of :class:`Numbered`. Rows stay where they are: nothing is
    shuffled and no text leaves its task unless it is kept. A result replaces input columns of its name in any case.
    """
    table, new = Numbered(docs), T.StructType.fromDDL(fields)
    held = table.kept(new.names, keep)
    more = [table[c] for c in also] + list((extra or {}).values())
    source = table.df.select(*[c.alias(f"c{i}") for i, c in enumerate(held)], *[c.alias(f"a{i}") for i, c in enumerate(more)], table[text].cast("string").alias("text"))
    names = table.df.select(*held).columns
    schema = T.StructType(source.schema.fields[: len(held)] + [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(new)])
    first, extras, labels = len(held), len(more), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            rows = batch.columns[:first]
            for at, part in slices(batch.column(batch.num_columns - 1)):
                beside = [batch.column(first + i).slice(at, len(part)) for i in range(extras)]
                yield pa.RecordBatch.from_arrays([c.slice(at, len(part)) for c in rows] + list(kernel(part, *beside)), names=labels)

    return map_arrow(source, run, schema).toDF(*names, *new.names)
