"""What stands inside what, as one ordered pass over the elements of a page.

Rows are shuffled and sorted by page and place; a task then folds them with the intervals that are open at
the place, so that work grows with the rows and not with pairs of them. Intervals may cross, as those of
misnested elements do."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLOSE, _POINT, _OPEN = 0, 1, 2


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, tuple]]:
    """(page_id, the other columns) of sorted rows."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[0], row[1:]


def emitted(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _folded(rows: DataFrame, fold: Callable[[Iterator[tuple[object, tuple]]], Iterator[tuple]], columns: str) -> DataFrame:
    """fold over rows(page_id, at, rank, ...), sorted by the three; it returns (page_id, columns). Rows are dealt by a hash
    of the page: over a union of parts that each lie by page_id, Spark leaves a shuffle by page_id itself out, though
    at run time the parts may be coalesced or joined in other ways, so that a page's rows lie apart."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([rows.schema["page_id"], *StructType.fromDDL(columns)])
    schema = to_arrow_schema(out)
    return rows.repartition(F.xxhash64("page_id")).sortWithinPartitions("page_id", "at", "rank").mapInArrow(lambda batches: emitted(fold(_pages(batches)), schema), out)


def innermost(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """(page_id, at, ord) for every row of points(page_id, at, until): of intervals(page_id, ord, end) with ord < at and until <
    end the one with the largest ord, null without one. A task holds the open intervals of one page. Repeated
    points give repeated rows."""
    none = F.lit(None).cast("long")
    row = lambda at, rank, own, until: (F.col("page_id"), F.col(at).alias("at"), F.lit(rank).alias("rank"), own.alias("ord"), until.alias("until"))
    events = intervals.select(*row("ord", _OPEN, F.col("ord"), F.col("end"))).unionAll(intervals.select(*row("end", _CLOSE, F.col("ord"), none))).unionAll(points.select(*row("at", _POINT, none, F.col("until"))))

    def fold(rows: Iterator[tuple[object, tuple]]) -> Iterator[tuple]:
        page, open_ = None, {}
        for page_id, (at, rank, own, until) in rows:
            if page_id != page:
                page, open_ = page_id, {}
            if rank == _OPEN:
                open_[own] = until
            elif rank == _CLOSE:
                open_.pop(own, None)
            else:
                yield page_id, at, next((o for o, end in reversed(open_.items()) if end > until), None)

    return _folded(events, fold, "at long, ord long")


def inner_text(nodes: DataFrame, where: Column) -> DataFrame:
    """(page_id, ord, end, tag, content) of the elements of nodes for which where holds: all text inside, by its place
    in the page's text; "" without any. A task holds the text of one page."""
    is_text = F.col("kind") == "text"
    wanted = F.col("kind").isin("open", "void") & F.coalesce(where, F.lit(False))
    rows = nodes.filter(is_text | wanted).select(
        "page_id", F.col("ord").alias("at"), F.when(is_text, _POINT).otherwise(_OPEN).alias("rank"), "end", F.when(wanted, F.col("tag")).alias("tag"), F.when(is_text, F.coalesce("text", F.lit(""))).alias("text")
    )

    def page_rows(page_id: object, found: list[tuple], texts: list[tuple]) -> Iterator[tuple]:
        places, text = [at for at, _ in texts], "".join(t for _, t in texts)
        starts = [0]
        for _, t in texts:
            starts.append(starts[-1] + len(t))
        for at, end, tag in found:
            yield page_id, at, end, tag, text[starts[bisect.bisect_right(places, at)] : starts[bisect.bisect_left(places, end)]]

    def fold(rows: Iterator[tuple[object, tuple]]) -> Iterator[tuple]:
        page, found, texts = None, [], []
        for page_id, (at, rank, end, tag, text) in rows:
            if page_id != page:
                yield from page_rows(page, found, texts)
                page, found, texts = page_id, [], []
            if rank == _OPEN:
                found.append((at, end, tag))
            else:
                texts.append((at, text))
        yield from page_rows(page, found, texts)

    return _folded(rows, fold, "ord long, end long, tag string, content string")


def outer_markup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, what, place, markup) for every row of wanted(page_id, what, place, ord, end, most): the first ``most``
    characters of the element's own tags and all inside, as the page has them. A task holds that much of each open element."""
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    rows = wanted.select("page_id", F.col("ord").alias("at"), F.lit(0).alias("rank"), "end", "what", F.col("place").cast("long").alias("place"), F.col("most").cast("long").alias("most"), *none(("raw", "string")))
    rows = rows.unionAll(nodes.select("page_id", F.col("ord").alias("at"), F.lit(1).alias("rank"), "end", *none(("what", "string"), ("place", "long"), ("most", "long")), "raw"))

    def fold(rows: Iterator[tuple[object, tuple]]) -> Iterator[tuple]:
        page, open_ = None, []
        for page_id, (at, rank, end, what, place, most, raw) in rows:
            if page_id != page:
                page, open_ = page_id, []
            if rank == 0:
                open_.append((end, what, place, most, []))
                continue
            going = []
            for one in open_:
                end, what, place, most, held = one
                held.append(raw[:most])
                if at >= end or sum(map(len, held)) >= most:
                    yield page_id, what, place, "".join(held)[:most]
                else:
                    going.append(one)
            open_ = going

    return _folded(rows, fold, "what string, place long, markup string")
