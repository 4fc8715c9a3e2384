"""Repair of conversation structure by the cheapest edits to the alternating grammar (s?(ua)+)?.

The role initials of a conversation are aligned to grammar strings: empty, (ua)+ and s(ua)+. A turn is kept, given
another role or deleted, and turns are inserted; the cheapest edits are found by Wagner and Fischer's table of turns by
places of the target. The strings of one kind are prefixes of one another, so one table per kind aligns the turns to every
length at once: a cell holds the least cost of the turns that are left against any string of the kind that is feasible
from that place. An incumbent (one pass that repairs each turn where it stands) bounds the table to Ukkonen's band: places
from which so many insertions or deletions would be needed already cost more. Both kinds are traced back to their
ASCII-least audit, and the better one is the repair.

Turns of a conversation stream through one task in order, twice: first their codes of one byte, of which the audit is
made, then their texts, which never gather.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Costs of the edits; what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"
# Cells of a table held at once, and audits that a task remembers.
CELLS, REMEMBERED = 4_000_000, 20_000
NEVER = 1 << 29
# A code: the initial (bits 0-1; 3 for any other), must go (bit 2), truncated (bit 3).
INITIALS, GOES, CUT = "sua", 4, 8
STATS = "gaps LONG, blank LONG, duplicate LONG, truncated LONG, illegal LONG, cost LONG, audit STRING"


def target(kind: int, place: int) -> int:
    """The initial (as in INITIALS) at a place of the grammar string; ``kind`` is 1 when it starts with s."""
    return 0 if kind and place == 0 else 1 + (place - kind) % 2


def incumbent(codes: bytes) -> int:
    """What it costs to keep a first s, give each other turn that may stay the role of its place, and end with a."""
    cost, place, kind = 0, 0, 0
    for code in codes:
        if code & GOES:
            cost += DELETE
            continue
        if place == 0 and code & 3 == 0:
            kind = 1
        cost += (REROLE if code & 3 != target(kind, place) else 0) + (TRUNCATED if code & CUT else 0)
        place += 1
    if place == kind == 1:
        return cost + 2 * INSERT
    return cost + (INSERT if (place - kind) % 2 else 0)


class Table:
    """Least costs of the turns from each on, against the rest of a grammar string; rows are made from the last turn back.

    A row holds the places whose distance from the number of turns that may stay so far lies in the band.
    """

    def __init__(self, codes: bytes, kind: int, limit: int):
        self.codes, self.kind, n = codes, kind, len(codes)
        given = np.frombuffer(codes, np.uint8)
        stays = (given & GOES) == 0
        cut = int((stays & ((given & CUT) > 0)).sum())
        self.before = np.concatenate([[0], np.cumsum(stays)]).tolist()
        slack = limit - DELETE * (n - self.before[n]) - TRUNCATED * cut
        # A deleted turn that is cut costs little more than one that stays.
        cheap = DELETE - TRUNCATED
        deletions = slack // cheap if slack <= cheap * cut else cut + (slack - cheap * cut) // DELETE
        self.low = -min(deletions, self.before[n])
        self.width = slack // INSERT - self.low + 1
        self.steps = INSERT * np.arange(self.width)
        # Costs of a target place by its parity: for an initial that matches u, a or neither.
        odd = np.arange(self.width + 1) % 2
        self.given = {1: REROLE * odd, 2: REROLE * (1 - odd), 0: np.full(self.width + 1, REROLE), 3: np.full(self.width + 1, REROLE)}
        self.block = max(1, CELLS // self.width)
        self.marks: dict[int, np.ndarray] = {}
        row = self.last()
        for i in range(n, -1, -1):
            if i < n:
                row = self.row(i, row)
            if i % self.block == 0 or i == n:
                self.marks[i] = row
        self.first, self.held, self.cost = -1, [], int(row[self.at(0, 0)]) if 0 <= self.at(0, 0) < self.width else NEVER

    def at(self, i: int, place: int) -> int:
        return place - self.before[i] - self.low

    def closed(self, i: int, row: np.ndarray) -> np.ndarray:
        """A row in which turns may also be inserted; places before the string are never reached, s is never inserted."""
        base = row
        row = np.minimum.accumulate((base + self.steps)[::-1])[::-1] - self.steps
        start = self.at(i, 0)
        if start > 0:
            row[:start] = NEVER
        if self.kind and 0 <= start < self.width:
            row[start] = base[start]
        return np.minimum(row, NEVER)

    def last(self) -> np.ndarray:
        n = len(self.codes)
        places = np.arange(self.width) + self.low + self.before[n]
        ends = (places >= 3) & (places % 2 == 1) if self.kind else (places >= 0) & (places % 2 == 0)
        return self.closed(n, np.where(ends, 0, NEVER))

    def row(self, i: int, after: np.ndarray) -> np.ndarray:
        """The costs from turn ``i`` on, from those after it."""
        code = self.codes[i]
        if code & GOES:
            return self.closed(i, after + DELETE)
        start = self.at(i, 0)
        shift = (start + self.kind) % 2
        stay = after + self.given[code & 3][shift:shift + self.width] + (TRUNCATED if code & CUT else 0)
        if self.kind and 0 <= start < self.width:
            stay[start] = after[start] + (TRUNCATED if code & CUT else 0) if code & 3 == 0 else NEVER
        gone = np.full(self.width, NEVER)
        gone[1:] = after[:-1] + DELETE
        return self.closed(i, np.minimum(stay, gone))

    def costs(self, i: int) -> np.ndarray:
        """Row ``i``; the rows of its block are made again from the one that was kept after it."""
        if not self.first <= i < self.first + len(self.held):
            block = i - i % self.block
            stop = min(block + self.block, len(self.codes))
            rows = [self.marks[stop]]
            for number in range(stop - 1, block - 1, -1):
                rows.append(self.row(number, rows[-1]))
            self.first, self.held = block, rows[::-1]
        return self.held[i - self.first]

    def audit(self) -> str:
        """The ASCII-least edits of the least cost: at each cell the first letter that stays on a cheapest way."""
        letters, i, place, n = [], 0, 0, len(self.codes)
        while True:
            here = self.costs(i)
            cost = here[self.at(i, place)]
            if i == n and cost == 0:
                return "".join(letters)
            letter = None
            if i < n:
                code, after = self.codes[i], self.costs(i + 1)
                gone, stay = self.at(i + 1, place), self.at(i + 1, place + 1)
                extra = TRUNCATED if code & CUT else 0
                if 0 <= gone < self.width and after[gone] + DELETE == cost:
                    letter = "D"
            if letter is None and self.at(i, place) + 1 < self.width and target(self.kind, place) and here[self.at(i, place) + 1] + INSERT == cost:
                letter = "I"
            if letter is None:
                kept = code & 3 == target(self.kind, place) and after[stay] + extra == cost
                letter = "K" if kept else "R"
            letters.append(letter)
            i, place = i + (letter != "I"), place + (letter != "D")


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of equal ones the ASCII-least audit."""
    limit, found = incumbent(codes), []
    for kind in (0, 1):
        if kind and not any(code & 7 == 0 for code in codes):
            continue
        table = Table(codes, kind, limit)
        if table.cost <= limit:
            found.append((table.cost, table))
            limit = table.cost
    least = min(cost for cost, _ in found)
    return least, min(table.audit() for cost, table in found if cost == least)


def ordered_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, pass, place, turn, role, text, code, illegal: each turn twice, by conversation, pass and place; the first time
    without its text. One exchange, by conversation."""
    rows = turns.select(
        F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).repartition("conv")
    at = F.col("turn").asc_nulls_first()
    copies = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(at)))
    body = F.rtrim("text", F.lit(SPACE))
    must_go, cut = (body == "") | (F.col("copy") > 1), ~F.right(body, F.lit(1)).isin(".", "!", "?")
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = number + F.when(must_go, GOES).otherwise(0) + F.when(~must_go & cut, CUT).otherwise(0)
    by_place = Window.partitionBy("conv").orderBy(at, "role", "text")
    pair = F.concat(F.lag(initial).over(by_place), initial)
    placed = copies.select(
        "conv", F.row_number().over(by_place).alias("place"), "turn", "role", "text", code.cast("int").alias("code"), (body == "").alias("blank"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    )
    twice = placed.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    light = F.when(F.col("pass") == 1, F.col("text"))
    return twice.select("conv", "pass", "place", "turn", "role", light.alias("text"), "code", "blank", "illegal").sortWithinPartitions("conv", "pass", "place")


class _Conversation:
    """What is known of one conversation while its turns stream by."""

    def __init__(self):
        self.codes, self.turns, self.first, self.last = bytearray(), 0, None, None
        self.blank = self.duplicate = self.illegal = 0

    def add(self, code: int, turn: int | None, blank: bool, illegal: bool) -> None:
        self.codes.append(code)
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.blank += blank
        self.duplicate += bool(code & GOES) and not blank
        self.illegal += illegal

    def settle(self, known: dict[bytes, tuple[int, str]]) -> None:
        codes = bytes(self.codes)
        if codes not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[codes] = cheapest(codes)
        self.cost, self.audit = known[codes]
        self.letter = self.place = 0
        kept = [code & 3 for code, letter in zip(codes, (x for x in self.audit if x != "I")) if letter == "K"]
        first = next((x for x in self.audit if x != "D"), "")
        self.kind = int(first == "K" and kept[0] == 0)

    def stats(self) -> list:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        truncated = sum(code & CUT > 0 for code in self.codes)
        return [gaps, self.blank, self.duplicate, truncated, self.illegal, self.cost, self.audit]

    def inserted(self) -> list[str]:
        """The roles of the turns that are inserted before the next turn."""
        roles = []
        while self.letter < len(self.audit) and self.audit[self.letter] == "I":
            roles.append(self.role())
            self.letter, self.place = self.letter + 1, self.place + 1
        return roles

    def role(self) -> str:
        return ("system", "user", "assistant")[target(self.kind, self.place)]

    def next(self) -> str:
        """The edit of the next turn."""
        letter = self.audit[self.letter]
        self.letter, self.place = self.letter + 1, self.place + (letter != "D")
        return letter


def repair_conversations(turns: DataFrame, *, conversation_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                         text_column: str = "text") -> DataFrame:
    """The edits of every conversation, each conversation's rows together and in order within a partition.

    Row 0 of a conversation (``step``) has its counts: gaps, blank, duplicate, truncated, illegal, cost and audit. Then
    comes one row per edit, deleted turns included: edit (K, R, D or I), turn, role (after the edit) and text.

    Turns are ordered by turn (null first), role and text. A turn without any character but ASCII white space is blank,
    one whose role and text came before is a duplicate, one whose last such character isn't . ! or ? is truncated; only the
    first of these counts. Null roles and texts are empty ones; roles count by their first letter. Rows with a null
    conversation are one conversation. Repeated rows are duplicates. An empty table gives no rows; other columns are
    ignored, whatever their names.

    A conversation's turns pass through one task, since they end in one audit and one order; of them a task holds a byte
    each, the audit, and blocks of a table of CELLS cells. Texts of any length pass by in batches.
    """
    kind = dict(turns.dtypes)[conversation_column]
    names = ["conv", "step", "edit", "turn", "role", "text", *[field.split()[0] for field in STATS.split(", ")]]

    def run(batches):
        known, now, at, state, step = {}, object(), 0, None, 0
        out: list[list] = [[] for _ in names]
        types = None

        def put(*values):
            for column, value in zip(out, (*values, *[None] * (len(names) - len(values)))):
                column.append(value)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(column, type_) for column, type_ in zip(out, types)], names=names)
            for column in out:
                column.clear()
            return batch

        def finish():
            nonlocal step
            for role in state.inserted():
                step += 1
                put(now, step, "I", None, role, "")

        for batch in batches:
            types = types or [batch.schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
                              *[pa.int64()] * 6, pa.string()]
            for conv, which, turn, role, text, code, blank, illegal in zip(*(batch.column(name).to_pylist() for name in (
                    "conv", "pass", "turn", "role", "text", "code", "blank", "illegal"))):
                if which == 0:
                    if state is None or at == 1 or conv != now:
                        if state is not None:
                            finish()
                        state, now, at = _Conversation(), conv, 0
                    state.add(code, turn, blank, illegal)
                    continue
                if at == 0:
                    state.settle(known)
                    at, step = 1, 0
                    put(conv, 0, None, None, None, None, *state.stats())
                finish()
                fitting = state.role()
                edit = state.next()
                step += 1
                put(conv, step, edit, turn, fitting if edit == "R" else role, text)
            yield flush()
        if state is not None:
            finish()
            yield flush()

    made = ordered_turns(turns, conversation_column, turn_column, role_column, text_column)
    schema = f"conv {kind}, step LONG, edit STRING, turn LONG, role STRING, text STRING, {STATS}"
    return made.mapInArrow(run, schema).withColumnRenamed("conv", conversation_column)


def repair_digests(repaired: DataFrame) -> DataFrame:
    """Per conversation of ``repair_conversations``: its counts and repaired_sha256, over role:text of the turns that stay or
    were inserted, joined by line ends. Reads the rows where they lie, without an exchange."""
    first, stats = repaired.columns[0], repaired.columns[6:]
    kind = dict(repaired.dtypes)[first]

    def run(batches):
        held, hashed, some, types = None, None, False, None
        for batch in batches:
            types = [batch.schema.field(name).type for name in (first, *stats)]
            done = []
            heads = list(zip(*(batch.column(name).to_pylist() for name in (first, *stats))))
            for head, step, edit, role, text in zip(heads, *(batch.column(name).to_pylist() for name in ("step", "edit", "role", "text"))):
                if step == 0:
                    if held is not None:
                        done.append((*held, hashed.hexdigest()))
                    held, hashed, some = head, hashlib.sha256(), False
                elif edit != "D":
                    hashed.update((("\n" if some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    some = True
            yield rows(done, types)
        if held is not None:
            yield rows([(*held, hashed.hexdigest())], types)

    def rows(done, types):
        columns = list(zip(*done)) or [[] for _ in range(len(stats) + 2)]
        arrays = [pa.array(column, type_) for column, type_ in zip(columns, [*types, pa.string()])]
        return pa.RecordBatch.from_arrays(arrays, names=[first, *stats, "repaired_sha256"])

    return repaired.mapInArrow(run, f"`{first}` {kind}, {STATS}, repaired_sha256 STRING")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` with faults in every fourth row or so, chosen by conv_id and turn.

    Null roles and texts become one space. Of 20 equal shares of the rows, one is dropped, one loses its text, one its
    full stops, one is there twice, and one gets the role user.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    share = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), share.alias("share"))
    text = F.when(F.col("share") == 1, "").when(F.col("share") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("share") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("share") == 3, 2).otherwise(1)
    faulty = rows.filter("share != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return faulty.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def every_conversation(conversations: DataFrame, digests: DataFrame) -> DataFrame:
    """``digests``, and a row of zeros, an empty audit and the hash of nothing for each conversation that has no turn left."""
    ids = conversations.select("conv_id").distinct().withColumnRenamed("conv_id", "every")
    joined = ids.join(digests, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("every").alias("conv_id"), *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
