"""Ordered folds over long histories, many tasks for one symbol.

A history is cut into blocks of positions, and each block is folded on its own. A block
begins from a guess of its state: that of a fold which starts, empty, `halo` positions
earlier. Most folds forget, so the guess mostly is the true state. Whether it is shows
when the block before has ended: if its last state is another, the block is folded again
from that state, and so on until all agree. Then each block began from the state in which
the one before ended, the first from the empty one, so the rows are those of one fold from
the start, whatever the block size. Rows of blocks that agreed are not made again.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import kept

KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
ROW, STATE, LAST = 0, 1, 2


def in_blocks(df: DataFrame, keys: tuple[str, ...], fold: Callable, schema: str, size: int = 4096, halo: int = 1024, closes: bool = False) -> DataFrame:
    """Rows of `schema` (the keys first) that fold(*keys) makes of each group's rows.

    df has the keys, `at`, `until` and `event`, and columns of its own. Rows come in order
    of (at, event). Events, 1, happen at `at`; other rows, 0, must be known from there to
    `until`. An object that fold gives has step(row) -> rows, for (at, event, the columns
    of its own); state(at) -> str, all that later steps depend on as of that position;
    begin(state); and, with closes, end() -> rows, if nothing follows. No more than a batch
    and its state is held. Null keys are groups as well.
    """
    own_columns = [c for c in df.columns if c not in (*keys, "at", "until", "event")]
    fields = [f.split() for f in schema.split(", ")]
    names, n_keys = [f[0] for f in fields], len(keys)
    out_fields = [*fields, ["__block", "long"], ["__what", "long"], ["__start", "string"], ["__end", "string"]]
    block_of = lambda c: F.floor(F.col(c) / size).cast("long")
    until = F.greatest(F.col("until"), F.col("at"))
    blocks = F.sequence(block_of("at"), F.floor((until + halo) / size).cast("long"))
    spread = df.select(*keys, F.explode(blocks).alias("__block"), F.lit(None).cast("string").alias("__begin"), "at", "event", *own_columns)
    order = [*keys, "__block"]

    def run(batches):
        key, state, start, out = None, None, None, []

        def finish():
            if start is None:  # no events of its own
                return []
            block, nothing = key[-1], [None] * (len(names) - n_keys)
            rows = [(*key[:-1], *nothing, block, STATE, start, state.state((block + 1) * size))]
            return rows + [(*row, block, LAST, None, None) for row in (state.end() if closes else [])]

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[: n_keys + 1] != key:
                    out += finish() if state else []
                    key, start = row[: n_keys + 1], None
                    state = fold(*key[:-1])
                begin, at, event = row[n_keys + 1 : n_keys + 4]
                if begin is not None:
                    state.begin(begin)
                    start = begin
                    continue
                own = event == 1 and at >= key[-1] * size
                if own and start is None:
                    start = state.state(key[-1] * size)
                made = state.step(row[n_keys + 2 :])
                if own:
                    out += [(*r, key[-1], ROW, None, None) for r in made]
            if len(out) > 10_000:
                yield table(out)
                out = []
        out += finish() if state else []
        yield table(out)

    def table(rows):
        values = list(zip(*rows, strict=True)) or [[] for _ in out_fields]
        return pa.RecordBatch.from_arrays([pa.array(v, KINDS[kind]) for v, (_, kind) in zip(values, out_fields, strict=True)], names=[f[0] for f in out_fields])

    columns = spread.columns

    def folded(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(*order).sortWithinPartitions(*order, F.col("__begin").isNull(), "at", "event")
        return kept(dealt.mapInArrow(run, ", ".join(" ".join(f) for f in out_fields)))

    def same(a: DataFrame, b: DataFrame):
        on = a["__block"] == b["__block"]
        for k in keys:
            on &= a[k].eqNullSafe(b[k])
        return on

    tables = [folded(spread)]
    ends = tables[0].where(F.col("__what") == STATE).select(*order, "__start", "__end", F.lit(0).alias("__round"))
    while True:
        before = F.lag("__end").over(Window.partitionBy(*keys).orderBy("__block"))
        wrong = ends.withColumn("__begin", before).where(F.col("__begin") != F.col("__start")).select(*order, "__begin")
        if wrong.isEmpty():
            break
        wrong = kept(wrong)
        # events of its own, and what must be known at them
        again = spread.where((F.col("event") == 0) | (F.col("at") >= F.col("__block") * size))
        again = again.join(wrong.drop("__begin"), same(again, wrong), "left_semi")
        empty = [F.lit(None).cast(t).alias(c) for c, t in spread.dtypes if c not in (*order, "__begin")]
        tables.append(folded(again.select(*columns).union(wrong.select(*order, "__begin", *empty))))
        new = tables[-1].where(F.col("__what") == STATE).select(*order, "__start", "__end", F.lit(len(tables) - 1).alias("__round"))
        ends = kept(ends.join(wrong, same(ends, wrong), "left_anti").union(new))
    if len(tables) > 1:
        tables = [t.join(last := ends.where(F.col("__round") == i), same(t, last), "left_semi") for i, t in enumerate(tables)]
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.union(t)
    if not closes:
        return rows.where(F.col("__what") == ROW).select(*names)
    last = ends.groupBy(*keys).agg(F.max("__block").alias("__block"))
    rest = rows.where(F.col("__what") == LAST)
    rest = rest.join(last, same(rest, last), "left_semi")
    return rows.where(F.col("__what") == ROW).select(*names).union(rest.select(*names))
