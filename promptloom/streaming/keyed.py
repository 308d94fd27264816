"""Stateful operators on streams with event time: state is small, expires, and loses no late row.

Each keeps state per key with ``transformWithState`` and an event-time timer that ends a key once it has
been idle: the watermark has passed its newest row by ``idle``. The event time goes to the operator as
a plain number, so rows behind the watermark are not filtered out before it; they are counted and
used like any others. A key that gets rows after its end starts again with empty state, and what is
written then is merged with what was written before when it is read, since every row that is written
carries the number by which the latest is chosen. So after everything has arrived, the reading
functions below give what the batch operators give, whatever the order of arrival.

Start these queries with :func:`promptloom.streaming.jobs.run_to_table`, which sets the state store
they need, in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from promptloom.operators.conversation import completion_aggregates, completion_flags, with_complete
from promptloom.operators.run_state import data_events, latest_events


def _millis(interval: str) -> int:
    """An interval such as ``30 minutes`` in milliseconds."""
    seconds = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800}
    number, unit = interval.split()
    return int(float(number) * seconds[unit.lower().rstrip("s")] * 1000)


def _timed(rows: DataFrame, event_time: str, late: str) -> DataFrame:
    """Rows with a watermark, and their event time as the number ``at`` in its place."""
    timed = rows.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    return timed.withColumn("at", F.unix_millis(event_time)).drop(event_time)


def _type(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _clock(idle: int, kept: str = ""):
    """Base of the processors: counts rows and late rows, and keeps one timer per key, beside the columns ``kept``.

    Each look at the state is a call, so all that has one value per key is one value, and a timer is set anew
    only when it goes off before its key is over.
    """

    class Clock(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.clock = handle.getValueState("clock", "expires bigint, n_rows bigint, n_late bigint" + (kept and f", {kept}"))

        def state(self) -> tuple | None:
            return self.clock.get() if self.clock.exists() else None

        def seen(self, state: tuple | None, times: list[int | None], watermark: int, *kept: Any) -> None:
            """Counts rows, moves the key's end behind the newest of them and keeps the key's values."""
            expires, n_rows, n_late = state[:3] if state else (None, 0, 0)
            after = max([watermark, *[t for t in times if t is not None]]) + idle
            if expires is None:
                self.handle.registerTimer(after)
            n_late += sum(t is not None and t < watermark for t in times)
            self.clock.update((max(after, expires or after), n_rows + len(times), n_late, *kept))

        def ended(self, watermark: int) -> tuple | None:
            """The state of a key whose time is over, which goes; None where rows have moved its end."""
            state = self.state()
            if state is not None and state[0] > watermark:
                self.handle.registerTimer(state[0])
                return None
            self.clock.clear()
            return state

        def close(self) -> None:
            pass

    return Clock


# --- state of runs -------------------------------------------------------------------------------------


def run_state_stream(lines: DataFrame, event_time: str, idle: str, late: str) -> DataFrame:
    """Latest events of arriving frame lines ``(run_id, seq, line, event_time)``, as they change.

    ``(run_id, event, subtask_id, seq, status, payload, n_rows, n_late)``. State is a number for each kind
    of event and each subtask of a run that is not over; payloads pass through. When a run is over,
    one row without event tells how many event rows it had and how many of them were late.
    Read with :func:`latest_run_events` and :func:`closed_runs`.
    """
    events = _timed(data_events(lines, event_time), event_time, late)
    payload = F.when(F.col("event") != "subtask_update", F.col("payload"))
    events = events.withColumn("payload", payload)
    schema = (
        f"run_id {_type(events, 'run_id')}, event string, subtask_id string, seq {_type(events, 'seq')}, "
        "status string, payload string, n_rows bigint, n_late bigint"
    )

    class Latest(_clock(_millis(idle))):
        def init(self, handle: StatefulProcessorHandle) -> None:
            super().init(handle)
            self.numbers = handle.getMapState("numbers", "part string", "seq bigint")

        def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
            times, newest = [], {}
            for row in rows:
                times.append(row.at)
                part = row.event if row.subtask_id is None else f"{row.event}\0{row.subtask_id}"
                # rows of equal number are told apart when they are read
                newest.setdefault(part, []).append(row)
            for part, found in newest.items():
                known = self.numbers.getValue((part,)) if self.numbers.containsKey((part,)) else None
                least = [known[0]] if known else []
                numbers = least + [r.seq for r in found if r.seq is not None]
                if numbers:
                    self.numbers.updateValue((part,), (max(numbers),))
                for r in found:
                    if r.seq == max(numbers, default=None):
                        yield Row(
                            run_id=key[0], event=r.event, subtask_id=r.subtask_id, seq=r.seq, status=r.status,
                            payload=r.payload, n_rows=None, n_late=None,
                        )
            self.seen(self.state(), times, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
            if (state := self.ended(timerValues.getCurrentWatermarkInMs())) is None:
                return
            _, n_rows, n_late = state
            self.numbers.clear()
            yield Row(
                run_id=key[0], event=None, subtask_id=None, seq=None, status=None, payload=None, n_rows=n_rows, n_late=n_late
            )

    return events.groupBy("run_id").transformWithState(Latest(), schema, "Append", "EventTime")


def latest_run_events(rows: DataFrame) -> DataFrame:
    """The latest events in written rows of :func:`run_state_stream`, for ``operators.run_state``."""
    return latest_events(rows.where(F.col("event").isNotNull()))


def closed_runs(rows: DataFrame) -> DataFrame:
    """Runs that were over, ``(run_id, n_closed, n_rows, n_late)``; more than once where rows came after their end."""
    ends = rows.where(F.col("event").isNull())
    return ends.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_closed"), F.sum("n_rows").alias("n_rows"), F.sum("n_late").alias("n_late")
    )


# --- completion of conversations -----------------------------------------------------------------------------


_SIDES = {"user": ("user_turn", ("proceed",)), "reply": ("reply_turn", ("marked", "deliverable"))}


def completion_stream(turns: DataFrame, event_time: str, idle: str, late: str) -> DataFrame:
    """Flags of the latest user turn and the latest reply of arriving turns, as they change.

    ``(conv_id, user_turn, proceed, reply_turn, marked, deliverable, n_rows, n_late)``. State is the number of the
    latest turn of either side; texts are judged before, by column expressions. A row without turns
    tells the counts of a conversation that is over. Read with :func:`completion_rows`.
    """
    flags = _timed(completion_flags(turns, event_time), event_time, late)
    names = [n for turn, rest in _SIDES.values() for n in (turn, *rest)]
    schema = f"conv_id {_type(flags, 'conv_id')}, " + ", ".join(f"{n} {_type(flags, n)}" for n in names)
    sides = dict(_SIDES)

    class LatestTurns(_clock(_millis(idle), "user_turn bigint, reply_turn bigint")):
        def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
            state = self.state()
            latest = dict(zip((turn for turn, _ in sides.values()), state[3:] if state else (None, None), strict=True))
            times, new = [], {}
            for row in rows:
                times.append(row.at)
                for turn, _ in sides.values():
                    number = getattr(row, turn)
                    if number is not None and (latest[turn] is None or number >= latest[turn]):
                        latest[turn], new[turn] = number, row
            self.seen(state, times, timerValues.getCurrentWatermarkInMs(), *latest.values())
            if new or state is None:
                fields = {n: getattr(new[turn], n) if turn in new else None for turn, rest in sides.values() for n in (turn, *rest)}
                yield Row(conv_id=key[0], **fields, n_rows=None, n_late=None)

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
            if (state := self.ended(timerValues.getCurrentWatermarkInMs())) is None:
                return
            _, n_rows, n_late, *_ = state
            yield Row(conv_id=key[0], **dict.fromkeys(names), n_rows=n_rows, n_late=n_late)

    return flags.groupBy("conv_id").transformWithState(
        LatestTurns(), schema + ", n_rows bigint, n_late bigint", "Append", "EventTime"
    )


def completion_rows(rows: DataFrame) -> DataFrame:
    """The completion decision of every conversation in written rows of :func:`completion_stream`."""
    return with_complete(rows.groupBy("conv_id").agg(*completion_aggregates()))


# --- lines of byte chunks ------------------------------------------------------------------------------------


#: Chunks of a run that came early are kept in blocks of this many bits of their numbers. A block is written again when
#: another batch brings more of it.
BLOCK_BITS = 8


def line_stream(chunks: DataFrame, event_time: str, idle: str, late: str) -> DataFrame:
    """Lines of logs that arrive as byte chunks ``(run_id, part, data, event_time)``, cut anywhere and in any order.

    ``(run_id, seq, line, whole)``. ``part`` counts a run's chunks from 0; ``seq`` counts its lines, empty ones
    included, which are not returned. State holds the piece after the last line break and the
    chunks that came before their turn. A chunk that comes again is ignored. When a run has been idle, the piece
    that is left is its last line, unless it is blank. Where chunks are still missing then, what was held
    behind the gap is returned too, each piece up to its line break, and the pieces that the gap
    has cut are not ``whole``; chunks that come even later wait for their turn in the same way.
    """
    parts = _timed(chunks.select("run_id", "part", F.col("data").cast("binary").alias("data"), event_time), event_time, late)
    schema = f"run_id {_type(parts, 'run_id')}, seq bigint, line string, whole boolean"
    block_bits = BLOCK_BITS

    class Lines(_clock(_millis(idle), "part bigint, seq bigint, tail binary, n_blocks bigint")):
        def init(self, handle: StatefulProcessorHandle) -> None:
            super().init(handle)
            self.early = handle.getMapState("early", "block bigint", "parts array<bigint>, pieces array<binary>")

        def held(self, block: int) -> dict[int, bytes]:
            """The early chunks of a block, by number; none where the block is not kept."""
            if not self.early.containsKey((block,)):
                return {}
            return {n: bytes(d) for n, d in zip(*self.early.getValue((block,)), strict=True)}

        def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
            arrived, times = {}, []
            for row in rows:
                times.append(row.at)
                if row.part is not None:
                    arrived.setdefault(row.part, bytes(row.data or b""))
            state = self.state()
            part, seq, tail, n_blocks = state[3:] if state else (0, 0, b"", 0)
            pieces, known = [bytes(tail)], {}
            while True:
                block = part >> block_bits
                if n_blocks and block not in known:
                    known[block] = self.held(block)
                data = arrived.pop(part, None)
                data = known.get(block, {}).get(part, data)
                if data is None:
                    break
                pieces.append(data)
                part += 1
            changed = {}
            for number, data in arrived.items():
                if number > part:
                    changed.setdefault(number >> block_bits, {})[number] = data
            # blocks that the run has come through or into keep what is still ahead
            for block in [b for b, chunks in known.items() if chunks]:
                if block < part >> block_bits:
                    self.early.removeKey((block,))
                    n_blocks -= 1
                elif min(known[block]) < part:
                    changed.setdefault(block, {})
            for block, new in changed.items():
                old = known[block] if block in known else self.held(block) if n_blocks else {}
                chunks = {n: d for n, d in (old | new).items() if n > part}
                n_blocks += bool(chunks) - bool(old)
                if chunks:
                    self.early.updateValue((block,), (list(chunks), list(chunks.values())))
                elif old:
                    self.early.removeKey((block,))
            *lines, tail = b"".join(pieces).split(b"\n")
            for line in lines:
                if line:
                    yield Row(run_id=key[0], seq=seq, line=line.decode("utf-8", "replace"), whole=True)
                seq += 1
            self.seen(state, times, timerValues.getCurrentWatermarkInMs(), part, seq, tail, n_blocks)

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
            if (state := self.ended(timerValues.getCurrentWatermarkInMs())) is None:
                return
            part, seq, tail, n_blocks = state[3:]
            held, whole = bytes(tail), True
            left = sorted((n, bytes(d)) for _, v in self.early.iterator() for n, d in zip(*v, strict=True)) if n_blocks else []
            rest = []
            for number, data in left:
                if number != part:
                    rest.append((held, whole, False))
                    held, whole = b"", False
                *lines, held_next = (held + data).split(b"\n")
                for line in lines:
                    rest.append((line, whole, True))
                    whole = True
                held, part = held_next, number + 1
            rest.append((held, whole, True))
            for line, start, end in rest:
                if line.strip():
                    yield Row(run_id=key[0], seq=seq, line=line.decode("utf-8", "replace"), whole=start and end)
                seq += 1
            if n_blocks:
                self.early.clear()

    return parts.groupBy("run_id").transformWithState(Lines(), schema, "Append", "EventTime")


def lines_of_chunks(chunks: DataFrame, data: Column | str = "data") -> DataFrame:
    """The same lines ``(run_id, seq, line)`` of a table of text chunks, in batch."""
    from promptloom.functions.columns import as_column
    from promptloom.operators.grouping import ordered_text

    whole = ordered_text(chunks, ["run_id"], "part", as_column(data), "text")
    lines = whole.select("run_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    return lines.where("line <> ''").select("run_id", F.col("seq").cast("bigint").alias("seq"), "line")
