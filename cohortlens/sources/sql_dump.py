"""Read star-schema rows held as SQL ``INSERT ... VALUES (..),(..);`` statements (K5).

A seed script of ``INSERT INTO <table> VALUES`` batches is ingested as a text source, not replayed through a database.
Files are read in splits, many tasks a file, though only the text before a place tells whether it stands inside
a quoted value, a comment or a statement of another table. What a split can't know is composed from small tables:

1. Each split is scanned once for every state the text before it may leave (code, three kinds of quotes, block
   comment), which gives a transition table of five numbers. Composing a file's tables in order gives the true state
   at each split's start.
2. From there each split reports the pieces around its edges: the first two segments (code up to a closing bracket or a
   semicolon), whether a statement ends in it, the two segments behind the last end, and the unfinished rest. Folding these by file
   gives the statement in force and the unfinished segment at each split's start.
3. Each split is then parsed from a known place: a segment that its neighbour began is taken whole by the split that
   ends it.

One row of a table meets no shuffle; per file one task folds its splits' reports (a hundred bytes or so for
each 128 MB, plus one row tuple), which are broadcast to the scans. The text is read three times. There
is no bound on the size of a file, a statement or a line's number of rows; one row tuple and one line must fit in memory.
Compressed files, which can't be split, are read by one task each.

INSERT statements of the table (schema-qualified or quoted names, with or without a column list) give row tuples and those
their fields. Values are taken by the column list, or by the fixed schema's order without one; columns that a list leaves out
are null. Comments before and inside a statement's head and between rows are skipped.

Nothing is dropped in silence: text after VALUES that is no row tuple, a row whose number of fields differs from its columns,
an INSERT without VALUES and a file that ends inside quotes or a comment all fail the query. Strings may use doubled quotes
and backslash escapes.

All patterns repeat possessively over runs of characters, so that long values cost neither backtracking nor stack depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.readers import normalize
from cohortlens.sources.schema import SCHEMAS

# Fixed patterns of the dump format.
_STRING = r"'(?:[^'\\]++|''|\\[\s\S])*+'"
_NAME = r"(?:`[^`]++`|\"[^\"]++\"|\w++)"
_COMMENT = r"(?:--[^\n]*+\n|#[^\n]*+\n|/\*(?:[^*]++|\*(?!/))*+\*/)"
_GAP = rf"(?:\s++|{_COMMENT})*+"
_BETWEEN = rf"(?:[\s,]++|{_COMMENT})*+"
_INTO = rf"{_GAP}(?i:INSERT)(?:\s++(?i:IGNORE))?+\s++(?i:INTO)\s++(?:{_NAME}\s*+\.\s*+)?+({_NAME})"
_FIELD = rf"{_STRING}|[^,\s()']++"

_NAMED = re.compile(_INTO)
_STARTED = re.compile(rf"{_INTO}{_GAP}(\([^()]*+\))?+{_GAP}")
_HEAD = re.compile(rf"{_INTO}{_GAP}(\([^()]*+\))?+{_GAP}(?i:VALUES)")
_ROW = re.compile(rf"{_BETWEEN}(\((?:{_STRING}|[^()'])*+\))\Z")
_END = re.compile(rf"{_BETWEEN};?\Z")

# Lexer states at the start of a line; line comments end with theirs.
CODE, SINGLE, DOUBLE, BACKTICK, COMMENT = range(5)
_OPENS = {"'": SINGLE, '"': DOUBLE, "`": BACKTICK, "/": COMMENT}
_CLOSE = {
    SINGLE: re.compile(r"(?:[^'\\]++|''|\\[\s\S])*+'"),
    DOUBLE: re.compile(r'[^"]*+"'),
    BACKTICK: re.compile(r"[^`]*+`"),
    COMMENT: re.compile(r"(?:[^*]++|\*(?!/))*+\*/"),
}
_PLAIN = re.compile(rf"(?:[^'\"`#/\-;)]++|{_STRING}|\"[^\"]*+\"|`[^`]*+`|{_COMMENT}|-(?!-)|/(?!\*))*+")


def scan(text: str, state: int) -> tuple[list[int], int]:
    """Ends of the segments of ``text`` (whole lines), behind each bracket or semicolon in code, and the state at its end."""
    at, ends = 0, []
    if state != CODE:
        closed = _CLOSE[state].match(text)
        if not closed:
            return ends, state
        at = closed.end()
    while (at := _PLAIN.match(text, at).end()) < len(text):
        if text[at] not in ");":
            return ends, _OPENS[text[at]]
        at += 1
        ends.append(at)
    return ends, CODE


class Statement:
    """The statement in force, fed segment by segment: its head so far, or the column list of an INSERT of the table."""

    def __init__(self, table: str, phase: str = "head", text: str = ""):
        self.table, self.phase, self.text = table, phase, text

    def feed(self, segment: str) -> str | None:
        """The row tuple that ``segment`` ends, if it ends one of the table."""
        rest, row = segment, None
        if self.phase == "head":
            self.text += segment
            rest = self._begin(self.text)
        if self.phase == "rows" and rest is not None:
            found = _ROW.match(rest)
            row = found[1] if found else None
            if not found and not _END.match(rest):
                self._fail(rest)
        if segment.endswith(";"):
            self.phase, self.text = "head", ""
        return row

    def _begin(self, text: str) -> str | None:
        named = _NAMED.match(text)
        if not named or named[1].strip('`"').lower() != self.table:
            self.phase, self.text = "other", ""
            return None
        head = _HEAD.match(text)
        if head:
            self.phase, self.text = "rows", head[2] or ""
            return text[head.end() :]
        if not _STARTED.fullmatch(text):
            self._fail(text)
        return None

    def _fail(self, text: str) -> None:
        raise ValueError(f"INSERT of {self.table} is not a list of rows: {text[:200]}")


def _splits(batches: Iterator[pa.RecordBatch], extra: int = 0) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(file, start, further columns) of each split in turn, with its text in parts of whole lines."""

    def parts():
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True))
            at = 0
            for key, run in groupby(keys):
                n = len(list(run))
                more = tuple(b.column(3 + i)[at].as_py() for i in range(extra))
                yield key + more, "\n".join(b.column(2).slice(at, n).to_pylist()) + "\n"
                at += n

    for key, run in groupby(parts(), key=lambda p: p[0]):
        yield key, (text for _, text in run)


def _tables(batches):
    """Per split the state at its end for each state at its start."""
    for (file, start), texts in _splits(batches):
        now = list(range(5))
        for text in texts:
            after = {s: scan(text, s)[1] for s in set(now)}
            now = [after[s] for s in now]
        yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "ends": [now]}, _schema(_TABLES))


_TABLES = [("file", pa.string()), ("start", pa.int64()), ("ends", pa.list_(pa.int32()))]
_REPORT = [
    ("file", pa.string()), ("start", pa.int64()), ("first", pa.list_(pa.string())), ("ended", pa.bool_()),
    ("last", pa.list_(pa.string())), ("rest", pa.string()), ("state", pa.int32()),
]


def _schema(columns: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema(columns)


def _segments(texts: Iterator[str], state: int, rest: str = "") -> Iterator[tuple[str | None, str, int]]:
    """Each segment of the split, the first one behind ``rest``; at last (None, unfinished rest, state)."""
    parts = [rest]
    for text in texts:
        ends, state = scan(text, state)
        at = 0
        for end in ends:
            yield "".join([*parts, text[at:end]]), "", state
            parts, at = [], end
        parts.append(text[at:])
    yield None, "".join(parts), state


def _reports(batches):
    """Per split its first two segments, whether a statement ends in it, the two segments behind the last end, and the rest."""
    for (file, start, state), texts in _splits(batches, 1):
        _known(file, state)
        first, last, ended = [], [], False
        for segment, rest, end in _segments(texts, state):
            if segment is None:
                row = [file, start, first, ended, last, rest, end]
                yield pa.RecordBatch.from_pydict({n: [v] for (n, _), v in zip(_REPORT, row, strict=True)}, _schema(_REPORT))
            elif segment.endswith(";"):
                ended, last = True, []
                first += [segment] if len(first) < 2 else []
            else:
                first += [segment] if len(first) < 2 else []
                last += [segment] if ended and len(last) < 2 else []


def _known(file: str, state: int | None) -> None:
    if state is None:
        raise ValueError(f"{file} was cut into other splits than before; read it again")


def _start_states(tables: pd.DataFrame) -> pd.DataFrame:
    """The state at each split's start, by composing a file's transition tables in order."""
    tables = tables.sort_values("start")
    states, now = [], CODE
    for ends in tables["ends"]:
        states.append(now)
        now = int(ends[now])
    return tables[["file", "start"]].assign(state=states)


def _start_statements(table: str):
    def fold(reports: pd.DataFrame) -> pd.DataFrame:
        """The statement in force and the unfinished segment at each split's start."""
        reports = reports.sort_values("start")
        before, state, rest, now = [], CODE, "", Statement(table)
        for r in reports.itertuples():
            before.append((state, rest, now.phase, now.text))
            state = r.state
            if not len(r.first):  # no segment ends here
                rest += r.rest
                continue
            if r.ended:
                now, segments = Statement(table), list(r.last)
            else:
                segments = [rest + r.first[0], *r.first[1:]]
            for s in segments:  # two are enough for any head
                if now.phase == "head":
                    now.feed(s)
            rest = r.rest
        out = reports[["file", "start"]].copy()
        out["state"], out["rest"], out["phase"], out["text"] = zip(*before, strict=True)
        out["final"] = [False] * (len(out) - 1) + [True]
        return out

    return fold


def _rows(table: str):
    def run(batches):
        for (file, _, state, rest, phase, text, final), texts in _splits(batches, 5):
            _known(file, state)
            now, listed, rows = Statement(table, phase, text), [], []
            for segment, left, end in _segments(texts, state, rest):
                if segment is None:
                    if not final:
                        break
                    if end != CODE:
                        raise ValueError(f"{file} ends inside a quoted value or a comment")
                    segment = f"{left};"
                row = now.feed(segment)
                if row is not None:
                    listed.append(now.text)
                    rows.append(row)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(listed, pa.string()), pa.array(rows, pa.string())], ["listed", "t"])
                    listed, rows = [], []
            yield pa.RecordBatch.from_arrays([pa.array(listed, pa.string()), pa.array(rows, pa.string())], ["listed", "t"])

    return run


def dump_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(listed, t): the column list (empty without one) and the text of each row tuple of ``table``."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    place = ["file", "start"]
    tables = lines.mapInArrow(_tables, "file string, start bigint, ends array<int>")
    states = tables.groupBy("file").applyInPandas(_start_states, "file string, start bigint, state int")
    reports = lines.join(F.broadcast(states), place, "left").select("file", "start", "value", "state").mapInArrow(
        _reports, "file string, start bigint, first array<string>, ended boolean, last array<string>, rest string, state int"
    )
    statements = reports.groupBy("file").applyInPandas(
        _start_statements(table), "file string, start bigint, state int, rest string, phase string, text string, final boolean"
    )
    known = lines.join(F.broadcast(statements), place, "left").select("file", "start", "value", "state", "rest", "phase", "text", "final")
    return known.mapInArrow(_rows(table), "listed string, t string")


def _unquoted(raw: Column) -> Column:
    """A quoted literal's text: escapes resolved between doubled backslashes."""
    inner = raw.substr(F.lit(2), F.length(raw) - 2)

    def resolve(part: Column) -> Column:
        for escape, char in (("''", "'"), ("\\'", "'"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\0"), ("\\Z", "\x1a"), ("\\b", "\b")):
            part = F.replace(part, F.lit(escape), F.lit(char))
        return F.replace(part, F.lit("\\"), F.lit(""))  # any other escaped character stands for itself

    return F.array_join(F.transform(F.split(inner, r"\\\\"), resolve), "\\")


def read_sql_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of ``table`` from the INSERT statements in the text file(s) at ``path``."""
    names = [f.name for f in SCHEMAS[table].fields]
    listed = F.transform(F.split(F.regexp_replace("listed", r"[()`\"\s]", ""), ","), F.lower)
    columns = F.when(F.col("listed") == "", F.array(*map(F.lit, names))).otherwise(listed)
    rows = dump_rows(spark, path, table).select(columns.alias("columns"), "t", F.regexp_extract_all("t", F.lit(_FIELD), 0).alias("f"))
    failed = F.raise_error(F.concat(F.lit(f"row of {table} has another number of fields than columns: "), F.substring("t", 1, 200)))
    matched = F.when(F.size("f") == F.size("columns"), F.map_from_arrays("columns", "f")).otherwise(failed.cast("map<string,string>"))
    values = rows.select(matched.alias("m"))

    def value(column: str) -> Column:
        raw = F.try_element_at("m", F.lit(column))
        return F.when(raw.startswith("'"), _unquoted(raw)).when(F.upper(raw) != "NULL", raw)

    return normalize(values.select(*[value(n).alias(n) for n in names]), table)
