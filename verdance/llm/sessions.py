"""Late session merging: every version of every session, as batches with late events arrive.

Events of one user, second and batch are first put together (their number and sum), so that a stretch of time holds a
bounded number of rows, whatever an user's number of events. Time is cut into slices of `slice_batches` batches. As an
event comes at most `late` batches late, the batches of slice i only change sessions that reach into slices i - 1 and i;
what lies before is as it stays, and of it only the session that reaches the end of slice i - 2 can still be joined: its
start, end and sums are the carry. Carries are running sums over slices, in blocks of `FAN` slices, then over blocks
of blocks, so no task sees all of a user's slices.

For the units (a user's slice with the one before it and the carry), many side by side, numpy builds a matrix of
batches by events: whether the event has arrived. maximum.accumulate along time gives when the user was last active before
each event; more than `gap` before is a break; cumulative sums of breaks number the sessions of all snapshots, and
reduceat sums them. A session that holds an event of the snapshot's batch is a version. The sessions of the snapshot
before that begin inside it are those that it retracts; they are named by their last batch and their start, and
joined to the versions by these.

Rows without user, time or batch are no events. Repeated rows count each. Events at equal times are neighbours. An
event before its batch's time, or later than `late` batches, is an error. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed, written

FAN = 256
VERSION = "batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long, retracts array<struct<batch: long, start_s: long>>"
NAMES = ["batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracts"]


def floor_div(a: Column, n: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def summaries(cells: DataFrame, gap: int) -> DataFrame:
    """A row a user and slice: first and last time, whether it has a break, and its last session: start, n, h, batch (its last)."""
    time = Window.partitionBy("user", "slice").orderBy("second")
    before = F.lag("second").over(time)
    rows = cells.withColumn("cut", F.coalesce((F.col("second") - before > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("part", F.sum("cut").over(time))
    parts = rows.groupBy("user", "slice", "part").agg(F.min("second").alias("start"), F.max("second").alias("last"), F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("batch").alias("batch"))
    tail = F.max_by(F.struct("start", "n", "h", "batch"), "part")
    out = parts.groupBy("user", "slice").agg(F.min("start").alias("first"), F.max("last").alias("last"), (F.count("*") > 1).alias("gapped"), tail.alias("tail"))
    return out.select("user", "slice", "first", "last", "gapped", "tail.*")


def tails(rows: DataFrame, gap: int, span: int) -> DataFrame:
    """Of each slice the session that holds its last event, with all that reaches into it from slices before: user, slice, last, start, n, h, batch. slice: from 0 to span."""
    x = rows.withColumn("block", floor_div(F.col("slice"), FAN))
    line = Window.partitionBy("user", "block").orderBy("slice")
    x = x.withColumn("open", F.lag("last").over(line))
    x = x.withColumn("run", F.sum((F.col("gapped") | F.col("open").isNull() | (F.col("first") - F.col("open") > gap)).cast("int")).over(line))
    sofar = Window.partitionBy("user", "block", "run").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("user", "block", "slice", "first", "last", "gapped", "run", F.first("start").over(sofar).alias("start"), F.sum("n").over(sofar).alias("n"), F.sum("h").over(sofar).alias("h"), F.max("batch").over(sofar).alias("batch"))
    if span < FAN:
        return x.select("user", "slice", "last", "start", "n", "h", "batch")
    x = written(x, "session-tails", compact=True)
    ends = F.max_by(F.struct("last", "start", "n", "h", "batch"), "slice").alias("end")
    blocks = x.groupBy("user", "block").agg(F.min("first").alias("first"), ((F.max("run") > 1) | F.min_by("gapped", "slice")).alias("gapped"), ends)
    above = tails(blocks.select("user", F.col("block").alias("slice"), "first", "gapped", "end.*"), gap, span // FAN)
    into = above.select("user", (F.col("slice") + 1).alias("block"), F.struct("last", "start", "n", "h", "batch").alias("c"))
    opening = x.groupBy("user", "block").agg(F.min_by(F.struct("first", "gapped"), "slice").alias("o"))
    joined = into.join(opening, ["user", "block"]).filter(~F.col("o.gapped") & (F.col("o.first") - F.col("c.last") <= gap)).select("user", "block", "c")
    x = x.join(joined, ["user", "block"], "left")
    on = (F.col("run") == 1) & F.col("c").isNotNull()
    add = lambda c: F.col(c) + F.when(on, F.col(f"c.{c}")).otherwise(0)
    return x.select("user", "slice", "last", F.when(on, F.col("c.start")).otherwise(F.col("start")).alias("start"), add("n").alias("n"), add("h").alias("h"), F.greatest("batch", F.when(on, F.col("c.batch"))).alias("batch"))


def snapshots(unit: np.ndarray, second: np.ndarray, start: np.ndarray, batch: np.ndarray, n: np.ndarray, h: np.ndarray, base: np.ndarray, w: int, gap: int):
    """Versions of many units at once, events sorted by (unit, second). unit: 0, 1, ... in the order of the rows; base: the first batch of the row's unit.

    Returns columns: a row of the version's unit, then those of NAMES, the last as (offsets, batches, starts).
    """
    arrived = batch[None, :] - base[None, :] < np.arange(w + 1)[:, None]  # row 0: the snapshot before the unit's first batch
    far = gap + 1 + (int(second.max()) - int(second.min()) if len(second) else 0)
    time = second - second.min() + unit * (2 * far)  # units lie further apart than any gap
    none = np.int64(-(2 * far))
    active = np.maximum.accumulate(np.where(arrived, time[None, :], none), axis=1)
    last = np.concatenate([np.full((w + 1, 1), none), active[:, :-1]], axis=1)
    opens = arrived & (time[None, :] - last > gap)
    at = np.flatnonzero(arrived.ravel())
    if not len(at):
        return None
    size = len(second)
    event, row = at % size, at // size
    head = np.flatnonzero(opens.ravel()[at])
    number = np.cumsum(opens.ravel()[at]) - 1  # of the session of each event that has arrived, over all snapshots
    new = np.add.reduceat(np.where(batch[event] == base[event] + row - 1, n[event], 0), head)
    before = np.zeros((w + 1, size), bool)
    before[1:] = opens[:-1]  # where sessions of the snapshot before begin
    gone = before.ravel()[at]
    starts, batches = np.minimum.reduceat(start[event], head), np.maximum.reduceat(batch[event], head)
    is_version = (new > 0) & (row[head] > 0)
    retracted = np.where(is_version, np.add.reduceat(gone.astype(np.int64), head), 0)
    of = at[gone & is_version[number]] - size  # the same events one snapshot before
    old = number[np.searchsorted(at, of)]
    v = np.flatnonzero(is_version)
    first = event[head][v]
    offsets = np.concatenate([[0], np.cumsum(retracted[v])])
    ends = np.maximum.reduceat(second[event], head)
    return first, base[first] + row[head][v] - 1, starts[v], ends[v], np.add.reduceat(n[event], head)[v], new[v], retracted[v], np.add.reduceat(h[event], head)[v], (offsets, batches[old], starts[old])


def _versions(w, gap, rows=1 << 14):
    """Batches sorted by user, unit and second; a unit's rows are kept together."""

    def made(t: pa.Table):
        user, col = t.column("user"), lambda c: t.column(c).to_numpy()
        key = t.column("user").combine_chunks().dictionary_encode().indices.to_numpy()
        at = col("unit")
        unit = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (at[1:] != at[:-1]))])
        found = snapshots(unit, col("second"), col("start"), col("batch"), col("n"), col("h"), at * w, w, gap)
        if found is None:
            return
        first, *plain, (offsets, batches, starts) = found
        gone = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(batches), pa.array(starts)], ["batch", "start_s"]))
        columns = [user.take(pa.array(first)).combine_chunks(), *(pa.array(c.astype(np.int64)) for c in plain), gone]
        yield from pa.Table.from_arrays(columns, ["user", *NAMES]).to_batches()

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < rows:
                continue
            t = pa.Table.from_batches(held)
            key = t.select(["user", "unit"])
            end = n - 1
            while end and key.slice(end - 1, 1).equals(key.slice(n - 1, 1)):  # the last unit may go on
                end -= 1
            if end:
                yield from made(t.slice(0, end))
            held, n = t.slice(end).to_batches(), n - end
        if n:
            yield from made(pa.Table.from_batches(held))

    return run


def session_versions(events: DataFrame, gap: int = 600, batch_s: int = 900, late: int = 3, slice_batches: int = 16) -> DataFrame:
    """events: user, second, batch, h. Per version: user, batch, start_s, end_s, n_events, n_new, n_retracted, h_sum, retracted_batch, retracted_start_s."""
    if slice_batches <= late or slice_batches * batch_s <= gap:
        raise ValueError("a slice has to be longer than any delay and any gap")
    width, second, batch = slice_batches * batch_s, F.col("second"), F.col("batch")
    delay = batch - floor_div(second, batch_s)
    known = F.when(delay.between(0, late), batch).otherwise(F.raise_error(F.lit(f"an event came before its time or more than {late} batches late")).cast("long"))
    rows = events.select("user", second.cast("long").alias("second"), batch.cast("long").alias("batch"), "h").dropna(subset=["user", "second", "batch"])
    cells = rows.groupBy("user", "second", "batch").agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("h")).withColumn("batch", known)
    cells = written(cells.withColumn("slice", floor_div(second, width)), "session-cells", compact=True)
    low, high = cells.agg(F.min("slice"), F.max("slice")).first()
    low, high = low or 0, high or 0
    carried = tails(summaries(cells, gap).withColumn("slice", F.col("slice") - low), gap, high - low)
    carried = carried.select("user", (F.col("slice") + low + 2).alias("unit"), F.col("last").alias("second"), "start", "batch", "n", "h")
    units = cells.select("user", F.explode(F.array("slice", F.col("slice") + 1)).alias("unit"), "second", second.alias("start"), "batch", "n", "h")
    ordered = units.unionByName(carried).repartition("user", "unit").sortWithinPartitions("user", "unit", "second", "batch")
    made = written(ordered.mapInArrow(trimmed(_versions(slice_batches, gap)), f"user {rows.schema['user'].dataType.simpleString()}, {VERSION}"), "session-versions", compact=True)
    gone = made.select("user", F.col("batch").alias("retracted_batch"), F.col("start_s").alias("retracted_start_s"), F.inline("retracts"))
    return made.drop("retracts").join(gone, ["user", "batch", "start_s"], "left").select("user", *NAMES[:-1], "retracted_batch", "retracted_start_s")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """user, second, batch, h of the rows with an id and a turn."""
    crc = lambda c: F.crc32(F.encode(c, "utf-8"))
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = conversations.filter(turn.isNotNull() & conv.isNotNull()).select(conv, turn, crc(conv.cast("string")).alias("c"), crc(F.concat_ws(":", conv.cast("string"), turn.cast("string"))).alias("h"))
    late = F.floor(F.col("h") / 600)
    rows = rows.select((2 * F.shiftright("conv_id", 3) + F.col("c") % 2).alias("user"), (F.shiftright("c", 1) % 7200 + 300 * F.col("turn") + F.col("h") % 600).alias("second"), F.when(late % 5 == 0, late % 4).otherwise(0).alias("late"), "h")
    return rows.select("user", "second", (floor_div(F.col("second"), 900) + F.col("late")).alias("batch"), "h")


def op13(conversations: DataFrame) -> DataFrame:
    return session_versions(conversation_events(conversations))
