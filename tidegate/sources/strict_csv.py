"""RFC 4180 records of any size of file.

Whether a byte lies inside quotes depends only on the number of quotes before it, so a split of a file can be summed up
before anybody knows in which state it starts: its quotes, and for either state how many records end in it and where its
first error is. Such sums can be chained. A first pass makes one row per split; a scan over these few rows gives every
split its state, its first record number and the file's first error; a second pass cuts each split in the order in which
it is read. Lines are never shuffled; only records that reach over a split's end meet in an exchange.

If the data is malformed, everything before the first error still counts right, so the first error is judged in its true
state. Splits start and end with lines, and hold at most spark.sql.files.maxPartitionBytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.results import GateError
from tidegate.scale import materialize
from tidegate.sources.checks import UTF8_MARK, file_heads
from tidegate.sources.paths import plain_path
from tidegate.sources.splits import split_files, split_lines, split_runs

# Signs put between fields while a record is cut; the data's own U+0001 is written as MARK + "a" meanwhile.
MARK = "\x01"
FIELD_END = MARK + "b"

STRAY_QUOTE = "Unexpected quote at CSV offset "
AFTER_QUOTE = "Unexpected character after closing CSV quote at offset "
UNTERMINATED = "Unterminated quoted CSV field."
QUOTE, LF, CR = 34, 10, 13
# Splits whose states (some 40 bytes each) every task gets; beyond that, lines are brought to them in order.
SENT_SPLITS = 200_000
SUMS = "number LONG, split LONG, quotes LONG, units LONG, records_out LONG, records_in LONG, error_out LONG, kind_out INT, error_in LONG, kind_in INT"


def check_delimiter(delimiter: str) -> str:
    if len(delimiter) != 1 or delimiter in '"\r\n\0':
        raise GateError("delimiter must be exactly one character other than a quote, newline or NUL")
    return delimiter


def _joined(lines: pa.Array) -> bytes:
    """Lines with their ends; a CR before an end belongs to it."""
    return b"\n".join([*lines.to_pylist(), b""])


def utf16_units(data: np.ndarray) -> int:
    """Length of UTF-8 bytes in UTF-16 code units, the unit of offsets in messages."""
    return int(((data & 0xC0) != 0x80).sum() + (data >= 0xF0).sum())


def record_ends(data: np.ndarray) -> np.ndarray:
    """Places of LF and of CR without LF; what lies inside quotes isn't sorted out yet."""
    bare = np.flatnonzero(data == CR)
    bare = bare[data[bare + 1] != LF] if len(bare) else bare
    ends = np.flatnonzero(data == LF)
    return np.sort(np.concatenate([ends, bare])) if len(bare) else ends


def first_error(data: np.ndarray, quotes: np.ndarray, inside: int, delimiter: bytes) -> tuple[int, int] | None:
    """(place, kind) of the first quoting error of lines that start inside quotes or not; kind 1 is text after a closing
    quote, 2 a quote within text."""
    def touches(places: np.ndarray, ahead: int) -> np.ndarray:
        """Whether a delimiter, a line end or a quote lies before (or after) each quote."""
        near = data[np.maximum(places + ahead, 0)]
        good = (near == QUOTE) | (near == CR) | (near == LF) | ((places == 0) & (ahead < 0))
        width = len(delimiter)
        starts = places - width if ahead < 0 else places + 1
        fits = (starts >= 0) & (starts + width <= len(data))
        match = fits.copy()
        for number, byte in enumerate(delimiter):
            match[fits] &= data[starts[fits] + number] == byte
        return good | match

    turn = (np.arange(len(quotes)) + inside) % 2
    opening, closing = quotes[turn == 0], quotes[turn == 1]
    stray, after = opening[~touches(opening, -1)], closing[~touches(closing, 1)]
    found = [(int(stray[0]), 2)] if len(stray) else []
    found += [(int(after[0]) + 1, 1)] if len(after) else []
    return min(found) if found else None


class _Sum:
    """What is known of one split: for both states it may start in."""

    def __init__(self, place: tuple[int, int]):
        self.place, self.quotes, self.units, self.records, self.errors = place, 0, 0, [0, 0], [None, None]

    def add(self, text: bytes, delimiter: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        quotes, ends = np.flatnonzero(data == QUOTE), record_ends(data)
        before = np.searchsorted(quotes, ends) if len(quotes) else np.zeros(len(ends), np.int64)
        for state in (0, 1):
            inside = (self.quotes + state) % 2
            self.records[state] += int(((before + inside) % 2 == 0).sum())
            if self.errors[state] is None and len(quotes):
                error = first_error(data, quotes, inside, delimiter)
                if error:
                    self.errors[state] = self.units + utf16_units(data[:error[0]]), error[1]
        self.quotes += len(quotes)
        self.units += utf16_units(data)

    def row(self) -> tuple:
        return (*self.place, self.quotes, self.units, *self.records, *(self.errors[0] or (None, None)), *(self.errors[1] or (None, None)))


def _sums(delimiter: str):
    sign = delimiter.encode()

    def run(batches):
        held = None

        def out(done):
            columns = list(zip(*[one.row() for one in done]))
            types = [pa.int32() if field.endswith("INT") else pa.int64() for field in SUMS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in SUMS.split(", ")])

        for batch in batches:
            done = []
            for place, rows in split_runs(batch):
                if held is None or place != held.place:
                    if held is not None:
                        done.append(held)
                    held = _Sum(place)
                held.add(_joined(rows.column("line")), sign)
            if done:
                yield out(done)
        if held is not None:
            yield out([held])

    return run


def split_states(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """One stored row per split: number, file, split, inside (the state it starts in), record (number of the record that
    starts or goes on there), units_before, and of its file: odd (an unclosed quote), error, kind (the first error), malformed."""
    check_delimiter(delimiter)
    sums = split_lines(spark, path).mapInArrow(_sums(delimiter), SUMS).join(split_files(spark, path), "number")
    by_file = Window.partitionBy("number")
    before, zero = by_file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1), F.lit(0).cast("long")
    chained = sums.withColumn("inside", (F.coalesce(F.sum("quotes").over(before), zero) % 2).cast("int"))

    def true(name: str) -> Column:
        return F.when(F.col("inside") == 0, F.col(f"{name}_out")).otherwise(F.col(f"{name}_in"))

    known = chained.select("number", "file", "split", "inside", "quotes", "units", true("records").alias("records"), true("error").alias("at"), true("kind").alias("found"))
    placed = known.withColumn("units_before", F.coalesce(F.sum("units").over(before), zero))
    error = F.min(F.when(F.col("at").isNotNull(), F.struct((F.col("units_before") + F.col("at")).alias("at"), "found"))).over(by_file)
    scanned = placed.select(
        "number", "file", "split", "inside", "units_before", (F.coalesce(F.sum("records").over(before), zero) + 1).alias("record"),
        (F.sum("quotes").over(by_file) % 2 == 1).alias("odd"), error.alias("first"),
    )
    out = scanned.select("*", F.col("first.at").alias("error"), F.col("first.found").alias("kind")).drop("first")
    return materialize(out.withColumn("malformed", F.col("odd") | F.col("error").isNotNull()), "splits")


def first_problem(spark: SparkSession, states: DataFrame) -> str | None:
    """The first quoting error in file order, with its offset from the start of the file."""
    bad = states.filter("malformed").groupBy("file").agg(F.first("error").alias("error"), F.first("kind").alias("kind"))
    first = bad.orderBy("file").first()
    if first is None:
        return None
    if first["error"] is None:
        return UNTERMINATED
    # The line reader has dropped a byte order mark, which counts as one character.
    head = file_heads(spark, plain_path(first["file"])).first()
    mark = 1 if head is not None and bytes(head["head"]) == UTF8_MARK else 0
    return f"{AFTER_QUOTE if first['kind'] == 1 else STRAY_QUOTE}{first['error'] + mark}"


def require_sound(spark: SparkSession, states: DataFrame) -> None:
    problem = first_problem(spark, states)
    if problem is not None:
        raise GateError(problem)


def require_well_formed(spark: SparkSession, path: str, delimiter: str = ",") -> None:
    """Raises the first quoting error in file order, with its offset from the start of the file."""
    require_sound(spark, split_states(spark, path, delimiter))


def _without_bare_cr(text: bytes, data: np.ndarray, quotes: np.ndarray, inside: int) -> bytes:
    """The text with LF for each CR that ends a record by itself."""
    bare = np.flatnonzero(data[:-1] == CR)
    bare = bare[data[bare + 1] != LF]
    if len(bare):
        bare = bare[(np.searchsorted(quotes, bare) + inside) % 2 == 0]
    if not len(bare):
        return text
    changed = bytearray(text)
    for place in bare.tolist():
        changed[place] = LF
    return bytes(changed)


class _Cutter:
    """Puts the lines of one split together to records."""

    def __init__(self, place: tuple[int, int], inside: int, record: int):
        self.place, self.inside, self.record, self.open, self.part = place, inside, record, [], bool(inside)

    def cut(self, lines: pa.Array) -> tuple[list[int], list[bytes], list[bool]]:
        """Numbers and bytes of the records that end here; the last list marks what goes on from the split before."""
        text = _joined(lines)
        data = np.frombuffer(text, np.uint8)
        quotes = np.flatnonzero(data == QUOTE)
        text = _without_bare_cr(text, data, quotes, self.inside)
        rows = text[:-1].split(b"\n")
        if not len(quotes) and not self.inside:
            first, self.record = self.record, self.record + len(rows)
            return list(range(first, self.record)), rows, [False] * len(rows)
        ends = np.cumsum([len(row) + 1 for row in rows])
        closed = ((np.searchsorted(quotes, ends) + self.inside) % 2 == 0).tolist()
        numbers, texts, parts = [], [], []
        for row, whole in zip(rows, closed):
            if whole and not self.open and not self.part:
                texts.append(row)
                parts.append(False)
            else:
                self.open.append(row)
                if not whole:
                    continue
                texts.append(b"\n".join(self.open))
                parts.append(self.part)
                self.open, self.part = [], False
            numbers.append(self.record)
            self.record += 1
        self.inside = (self.inside + len(quotes)) % 2
        return numbers, texts, parts


PIECES = "number LONG, split LONG, chunk LONG, text STRING, part BOOLEAN"


def _cut_splits(batches):
    """Records of each split in the order of its lines; ``part`` marks the pieces of records that reach over its ends."""
    held = None

    def out(columns):
        types = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        # The bytes came as text from Spark's reader and go back as they were.
        arrays[3] = pa.Array.from_buffers(pa.string(), len(arrays[3]), arrays[3].buffers())
        return pa.RecordBatch.from_arrays(arrays, names=["number", "split", "chunk", "text", "part"])

    def rest(columns):
        if held is not None and held.open:
            for column, value in zip(columns, (*held.place, held.record, b"\n".join(held.open), True)):
                column.append(value)

    for batch in batches:
        columns = [], [], [], [], []
        for place, rows in split_runs(batch):
            if held is None or place != held.place:
                rest(columns)
                held = _Cutter(place, rows.column("inside")[0].as_py(), rows.column("record")[0].as_py())
            numbers, texts, parts = held.cut(rows.column("line"))
            for column, values in zip(columns, ([place[0]] * len(numbers), [place[1]] * len(numbers), numbers, texts, parts)):
                column.extend(values)
        yield out(columns)
    columns = [], [], [], [], []
    rest(columns)
    if columns[0]:
        yield out(columns)


def pieces_of(spark: SparkSession, path: str, states: DataFrame, sent: int = SENT_SPLITS) -> DataFrame:
    """(file, chunk, text): each record of the sound files and its number; a malformed file has one row with chunk 0 and no
    text instead, so an unclosed quote gathers nothing."""
    place = ["number", "split"]
    sound, files = states.filter("NOT malformed").select(*place, "inside", "record"), states.select("number", "file").distinct()
    splits, names = states.agg(F.count(F.lit(1)), F.count_distinct("number")).first()
    lines = split_lines(spark, path)
    if splits <= sent:
        # Each task sees its lines in the order in which it reads them.
        known, files = lines.join(F.broadcast(sound), place), F.broadcast(files)
    else:
        known = lines.withColumn("at", F.monotonically_increasing_id()).join(sound, place).repartition(*place).sortWithinPartitions(*place, "at")
    named = known.select(*place, "inside", "record", "line").mapInArrow(_cut_splits, PIECES).join(files, "number")
    whole = named.filter("NOT part").select("file", "chunk", "text")
    joined = (
        named.filter("part").groupBy("file", "chunk").agg(F.sort_array(F.collect_list(F.struct("split", "text"))).alias("parts"))
        .select("file", "chunk", F.array_join(F.col("parts.text"), "\n").alias("text"))
    )
    malformed = states.filter("malformed").groupBy("file").agg(F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("string").alias("text"))
    # A file of one split has no record that reaches over its end.
    return (whole.unionByName(joined) if splits > names else whole).unionByName(malformed)


def pieces(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(file, chunk, text): whole records of each file, numbered from 1 in file order (see pieces_of)."""
    return pieces_of(spark, path, split_states(spark, path, delimiter))


def _literal(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cut(text: str, delimiter: str) -> Column:
    """array<string>: the fields of a record, quotes removed."""
    mark, held, field_end = (_literal(sign) for sign in (MARK, MARK + "a", FIELD_END))
    end, plain = _literal(delimiter), _literal(r"\Q" + delimiter + r"\E")
    segments = f"""split(replace({text}, {mark}, {held}), '"', -1)"""
    # Outer segments get their marks; an empty one between two quotes is an escaped quote.
    flat = f"""array_join(transform({segments}, (s, i) -> CASE
        WHEN i % 2 = 1 THEN s
        WHEN s = '' AND i > 0 AND i < char_length({text}) - char_length(replace({text}, '"', '')) THEN '"'
        ELSE replace(s, {end}, {field_end}) END), '')"""
    return F.expr(f"""
        CASE WHEN NOT contains({text}, '"') THEN split({text}, {plain}, -1)
        ELSE transform(split({flat}, {field_end}, -1), f -> replace(f, {held}, {mark})) END""")


def _fields(found: DataFrame, delimiter: str) -> DataFrame:
    """(file, chunk, fields) of pieces; a malformed file has one row without fields."""
    # The CR of a CRLF belongs to the line end.
    body = F.when(F.col("text").endswith("\r"), F.expr("left(text, char_length(text) - 1)")).otherwise(F.col("text"))
    cut = F.when(F.col("body").isNotNull(), _cut("body", delimiter))
    return found.select("file", "chunk", body.alias("body")).select("file", "chunk", cut.alias("fields"))


def records(spark: SparkSession, path: str, *, delimiter: str = ",") -> DataFrame:
    """(file, chunk, fields): every record with its number in its file.

    A malformed file has one record without fields: count such rows along with the rest, and let ``require_well_formed``
    name the first place when there are any.
    """
    return _fields(pieces(spark, path, delimiter), delimiter)


def is_first_record() -> Column:
    return F.col("chunk") == 1


def read_csv_rfc4180(spark: SparkSession, path: str, *, delimiter: str = ",") -> DataFrame:
    """(file, record_no, fields) of every record, header included; no field is ever null.

    CRLF, LF and CR end records, a blank line is a record with one empty field, a byte order mark is dropped. The first
    quoting error is raised at once, before anything is returned.
    """
    check_delimiter(delimiter)
    states = split_states(spark, path, delimiter)
    require_sound(spark, states)
    return _fields(pieces_of(spark, path, states), delimiter).withColumnRenamed("chunk", "record_no")


def checked_records(spark: SparkSession, path: str, *, delimiter: str = ",") -> DataFrame:
    """(file, record_no, fields) as of read_csv_rfc4180; a quoting error is raised when the records are read."""
    states = split_states(spark, path, delimiter)
    problem = first_problem(spark, states)
    found = _fields(pieces_of(spark, path, states), delimiter).withColumnRenamed("chunk", "record_no")
    if problem is None:
        return found
    return found.withColumn("fields", F.when(F.col("record_no") > 0, F.col("fields")).otherwise(F.raise_error(F.lit(problem)).cast("array<string>")))


def rectangular(numbered: DataFrame) -> DataFrame:
    """(file, record_no, width, expected) of the first record of each file that is not as wide as record 1."""
    widths = numbered.groupBy("file", F.size("fields").alias("width")).agg(F.min("record_no").alias("record_no"))
    by_file = Window.partitionBy("file").orderBy("record_no")
    ranked = widths.withColumn("expected", F.first("width").over(by_file)).withColumn("place", F.row_number().over(by_file))
    return ranked.filter("place = 2").select("file", "record_no", "width", "expected")


def ragged_message(record_no: int, width: int, expected: int, header: bool) -> str:
    def fields(count: int) -> str:
        return f"{count} field" if count == 1 else f"{count} fields"

    return f"CSV record {record_no} has {fields(width)} but {'the header' if header else 'record 1'} has {fields(expected)}"


def require_rectangular(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> None:
    numbered = records(spark, path, delimiter=delimiter).withColumnRenamed("chunk", "record_no")
    bad = rectangular(numbered).orderBy("file").first()
    if bad is not None:
        raise GateError(ragged_message(bad["record_no"], bad["width"], bad["expected"], header))
