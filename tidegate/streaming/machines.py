"""Streams with a small state per key: the lives of a piece of all runs, and copies of a row across windows.

Both need the state store that holds state outside of the JVM's heap (RocksDB); ``stateful`` sets it for the session. A
state is one value that grows only with what is open at a time, and event-time timers clear it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegate.functions.text import is_blank
from tidegate.operators.quality import cell_texts, row_digest

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIVES = "run STRING, version INT, status STRING, started LONG, ended LONG"
# What a state holds of each run, and the pieces over which runs are dealt.
LIFE = {"runs": "STRING", "versions": "INT", "statuses": "STRING", "started": "LONG", "ended": "LONG", "due": "LONG"}
PIECES = 1024


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _micros(value) -> int | None:
    """Microseconds of a time, the unit in which states hold it; None for none."""
    return None if value is None or pd.isna(value) else pd.Timestamp(value).value // 1000


def _time(micros: int | None):
    return pd.NaT if micros is None else pd.Timestamp(micros * 1000)


class _Lives(StatefulProcessor):
    """The runs of one piece, each running -> finished, or running -> unfinished when the timeout passes -> late when an end
    comes after all. A call handles all runs of the piece that a batch has rows for; one timer stands at the first time
    (milliseconds) at which one of its runs is due.
    """

    def __init__(self, timeout: int, keep: int):
        self.timeout, self.keep = timeout, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lives", ", ".join(f"{name} ARRAY<{kind}>" for name, kind in LIFE.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lives, read, out = self.held(), {}, []
        timer = self.first_due(lives)
        for part in rows:
            for run, kind, at in zip(part["run"].tolist(), part["kind"].tolist(), part["micros"].tolist()):
                times = read.setdefault(run, [None, None])
                times[kind == "end"] = earlier(times[kind == "end"], at)
        for run, (begin, end) in read.items():
            version, status, started, ended, _ = lives.get(run, (0, None, None, None, None))
            before = status, started, self.real(started, ended)
            started, ended = earlier(started, begin), earlier(ended, end)
            real = self.real(started, ended)
            if real is not None:
                status = "finished" if real <= started + self.timeout else "late"
            elif started is not None and status is None:
                status = "running"
            now = status, started, real
            wait = started + self.timeout if status == "running" else max(x for x in (started, ended) if x is not None) + self.keep
            if status is not None and now != before:
                version += 1
                out.append((run, version, *now))
            lives[run] = version, status, started, ended, wait // 1000 + 1
        self.hold(lives, timer)
        yield self.table(out)

    def real(self, started: int | None, ended: int | None) -> int | None:
        """The end of the run; one that is read before its begin waits for it, one before it in time is another run's."""
        return None if ended is None or started is None or ended < started else ended

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lives, out = self.held(), []
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for run, (version, status, started, ended, due) in list(lives.items()):
            if due > passed:
                continue
            if status == "running":
                # Kept for a late end until as much time again has passed.
                lives[run] = version + 1, "unfinished", started, ended, due + self.keep // 1000
                out.append((run, version + 1, "unfinished", started, None))
            else:
                del lives[run]
        self.hold(lives, None)
        yield self.table(out)

    def held(self) -> dict[str, tuple]:
        """(version, status, started, ended, due) of each run."""
        runs, *life = self.state.get() if self.state.exists() else [[]] * len(LIFE)
        return dict(zip(runs, zip(*life)))

    def hold(self, lives: dict[str, tuple], timer: int | None) -> None:
        """Stores the runs; ``timer`` is the one that stands."""
        due = self.first_due(lives)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if not lives:
            self.state.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update((list(lives), *map(list, zip(*lives.values()))))

    def first_due(self, lives: dict[str, tuple]) -> int | None:
        return min((due for *_, due in lives.values()), default=None)

    def table(self, rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=["run", "version", "status", "started", "ended"], dtype=object)
        return found.astype({"version": "int32", "started": "Int64", "ended": "Int64"})


def earlier(a: int | None, b: int | None) -> int | None:
    """The smaller one of those that there are."""
    return b if a is None else a if b is None else min(a, b)


def run_lives(events: DataFrame, *, run: str = "run_id", kind: str = "kind", at: str = "ts", timeout_minutes: int = 30, keep_minutes: int = 1440,
              delay: str = "10 minutes", pieces: int = PIECES) -> DataFrame:
    """(run, version, status, started_at, ended_at, duration_ms): every change in the life of each run; the last version holds.

    A run is running from its first begin. With an end within the timeout it is finished; when the watermark passes the
    timeout it is unfinished; an end that comes later corrects it to late. Ends may be read before their begins; of
    several the first counts. A state is forgotten ``keep_minutes`` after its last change. Rows without a run or a time
    are ignored.

    Runs are dealt by hash over ``pieces``, and a state holds the runs of one piece that aren't forgotten: a call to the
    state store costs more than a run. A checkpoint holds for one number of pieces.
    """
    stateful(events.sparkSession)
    named = events.select(F.col(run).cast("string").alias("run"), F.col(kind).alias("kind"), F.col(at).alias("at"))
    plain = named.filter("kind IN ('begin', 'end') AND run IS NOT NULL AND at IS NOT NULL").withColumns({
        "micros": F.unix_micros(F.col("at").cast("timestamp")), "piece": F.pmod(F.xxhash64("run"), F.lit(pieces))})
    machine = _Lives(timeout_minutes * 60_000_000, keep_minutes * 60_000_000)
    lives = plain.withWatermark("at", delay).groupBy("piece").transformWithStateInPandas(machine, LIVES, "Append", "EventTime")
    started, ended = F.timestamp_micros("started"), F.timestamp_micros("ended")
    return lives.select("run", "version", "status", started.alias("started_at"), ended.alias("ended_at"),
                        (F.unix_millis(ended) - F.unix_millis(started)).alias("duration_ms"))


COPIES = "at TIMESTAMP, n LONG, blanks LONG, copies LONG"


def merged(chains: list[tuple[int, int]], first: int, last: int, within: int) -> tuple[list[tuple[int, int]], bool, list[int]]:
    """Chains of copies with a new one: (chains, whether its first copy has one before it, firsts of chains that now have).

    In a chain each copy has one at most ``within`` before it, but for the first.
    """
    follows, corrected, kept = False, [], []
    low, high = first, last
    for start, stop in chains:
        if stop < first - within or start > last + within:
            kept.append((start, stop))
            continue
        if start <= first:
            follows = True
        else:
            corrected.append(start)
        low, high = min(low, start), max(high, stop)
    return sorted([*kept, (low, high)]), follows, corrected


class _Copies(StatefulProcessor):
    """The chains of copies of one row."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chains", "firsts ARRAY<LONG>, lasts ARRAY<LONG>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chains = list(zip(*self.state.get())) if self.state.exists() else []
        mark, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        chains = [chain for chain in chains if chain[1] >= mark - self.within]
        for part in rows:
            for first, last, n, blanks in zip(part["first"], part["last"], part["n"], part["blanks"]):
                first, last = _micros(first), _micros(last)
                chains, follows, corrected = merged(chains, first, last, self.within)
                out.append((_time(first), int(n), int(blanks), int(n) - 1 + follows))
                out += [(_time(place), 0, 0, 1) for place in corrected]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((max(last for _, last in chains) + self.within) // 1000 + 1)
        self.state.update(([first for first, _ in chains], [last for _, last in chains]))
        yield pd.DataFrame(out, columns=["at", "n", "blanks", "copies"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies within a window as one row, before they are shuffled."""
    for batch in batches:
        found = batch.groupby(["digest", "start"], as_index=False).agg(first=("at", "min"), last=("at", "max"), n=("at", "size"), blanks=("blanks", "max"))
        yield found[["digest", "first", "last", "n", "blanks"]]


def quality_across_windows(rows: DataFrame, cells: list[str], *, at: str = "ts", delay: str = "10 minutes", width_minutes: int = 60,
                           within_minutes: int = 60) -> DataFrame:
    """(window_start, rows, blank_cells, blank_rows, duplicate_rows) of the given columns per window, where a copy at most
    ``within_minutes`` after an equal row is a duplicate also when that row lies in an earlier window.

    Copies of a window are combined before they are shuffled, and a state holds the first and last time of each chain of
    copies: a row that occurs very often is a few numbers. A late row is put in its place, and the copy after it counts
    from then on. ``within_minutes`` is at least the width of a window.
    """
    if within_minutes < width_minutes:
        raise ValueError("within_minutes must be at least width_minutes")
    stateful(rows.sparkSession)
    given, width = rows.select(*cells), f"{width_minutes} minutes"
    blanks = [is_blank(text).cast("long") for text in cell_texts(given)]
    total = sum(blanks[1:], blanks[0])
    judged = rows.filter(F.col(at).isNotNull()).select(
        F.hex(row_digest(given)).alias("digest"), F.window(at, width)["start"].alias("start"), F.col(at).alias("at"), total.alias("blanks"))
    combined = judged.mapInPandas(_combined, "digest STRING, first TIMESTAMP, last TIMESTAMP, n LONG, blanks LONG").withWatermark("first", delay)
    chained = combined.groupBy("digest").transformWithStateInPandas(
        _Copies(within_minutes * 60_000_000), COPIES, "Append", "EventTime", eventTimeColumnName="at")
    counted = chained.groupBy(F.window("at", width).alias("whole")).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("blanks")).alias("blank_cells"),
        F.sum(F.when(F.col("blanks") == len(blanks), F.col("n")).otherwise(0)).cast("long").alias("blank_rows"), F.sum("copies").alias("duplicate_rows"),
    )
    return counted.select(F.col("whole.start").alias("window_start"), "rows", "blank_cells", "blank_rows", "duplicate_rows")
