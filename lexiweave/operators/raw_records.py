"""Rows that fail to parse: bulk columnar parsing with recursive bisection of failing blocks.

One vectorised look at a block of some megabytes picks the records that have nine well-formed fields. These are
joined and parsed by one call of the Arrow CSV reader; where it doesn't find a row for each record, the block is halved
until the record that it stumbles on is alone. The columns are checked at once. All records that failed at any of these
steps are diagnosed by a strict scanner that names the first fault, or finds them valid after all. The bulk path accepts a
record only if it passes vectorised forms of the same tests, so both paths agree.

Reasons, in this order: ``quoting``, ``column_count``, ``corp_id``, ``doc_id``, ``abstract``.

Edge cases: a null record is an empty one and has one column (``column_count``); repeated records come out once
for each row; line breaks inside quoted or bare fields are kept; extra columns of the input are ignored; very
long records are parsed alone, as the Arrow reader's block is made as large as the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["corp_id", "doc_id", "title", "acronym", "abstract", "doc_index_1", "doc_index_2", "doc_date", "doc_keywords"]
#: Records that are parsed together have about so many bytes.
BLOCK_BYTES = 16 << 20
LETTERS = 20
#: Periods are sent to each task up to about this size.
PERIOD_BYTES = 32 << 20

_FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'
_STRICT = re.compile(rf"{_FIELD}(?:,{_FIELD})*", re.S)
_CUT = re.compile(r'"((?:[^"]|"")*)"(?:,|$)|([^",]*)(?:,|$)', re.S)
_DOC_ID = re.compile(r"[1-9][0-9]{0,9}|0")
_NINE_RE2 = rf"(?s)\A(?:{_FIELD},){{8}}{_FIELD}\z"
_LATIN_LETTERS = rf"(?:[A-Za-z][^A-Za-z]*){{{LETTERS}}}"


def split_record(line: str) -> list[str] | None:
    """The fields of one record, or None where its quoting is broken."""
    if not _STRICT.fullmatch(line):
        return None
    out, pos = [], 0
    while True:
        m = _CUT.match(line, pos)
        out.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        if m.end() == len(line) and not m[0].endswith(","):
            return out
        pos = m.end()
        if pos == len(line):
            return [*out, ""]


def diagnose(line: str | None, corpora: frozenset[str] | None) -> tuple[str | None, list[str] | None]:
    """The first reason that a record isn't valid, and its fields if it has nine; ``corpora`` None: periods aren't looked at."""
    fields = split_record(line or "")
    if fields is None:
        return "quoting", None
    if len(fields) != len(COLUMNS):
        return "column_count", None
    if corpora is not None and fields[0] not in corpora:
        return "corp_id", fields
    if not _DOC_ID.fullmatch(fields[1]):
        return "doc_id", fields
    text = fields[4]
    if "\0" in text or "�" in text or sum(map(str.isalpha, text)) < LETTERS:
        return "abstract", fields
    return None, fields


def _blocks(lines: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of records that hold about ``BLOCK_BYTES`` together, one record at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
        yield first, last
        first = last


def _pick(lines: pa.Array, mask: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Places of true values of a mask, and the records there."""
    at = pa.array(np.nonzero(mask.fill_null(False).to_numpy(zero_copy_only=False))[0])
    return at, lines.take(at)


def _parsed(lines: pa.Array) -> pa.Table | None:
    """The columns of records by one call of the Arrow CSV reader, or None if it doesn't find one row for each."""
    # A list of all records, joined by line breaks without a detour by Python strings.
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_buffer()
    try:
        table = pcsv.read_csv(
            pa.BufferReader(text),
            pcsv.ReadOptions(column_names=COLUMNS, block_size=max(1 << 20, text.size + 1), use_threads=False),
            pcsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            pcsv.ConvertOptions(column_types=dict.fromkeys(COLUMNS, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
    except (pa.ArrowInvalid, pa.ArrowKeyError):
        return None
    return table if table.num_rows == len(lines) else None


def parse_block(lines: pa.Array) -> Iterator[tuple[int, pa.Table | None]]:
    """(number of records, their columns) in order; None for single records that the reader doesn't take.

    A block that fails is halved until it parses or one record is left.
    """
    table = _parsed(lines) if len(lines) else None
    if table is not None or len(lines) < 2:
        yield len(lines), table
        return
    half = len(lines) // 2
    yield from parse_block(lines[:half])
    yield from parse_block(lines[half:])


def _fine(table: pa.Table, corpora: pa.Array | None) -> np.ndarray:
    """Whether each parsed record has valid values."""
    fine = pc.match_substring_regex(table["doc_id"], r"^(?:[1-9][0-9]{0,9}|0)$")
    if corpora is not None:
        fine = pc.and_(pc.is_in(table["corp_id"], corpora), fine)
    fine = pc.and_(fine, pc.invert(pc.match_substring_regex(table["abstract"], r"[\x00\x{FFFD}]")))
    fine = fine.to_numpy(zero_copy_only=False) if isinstance(fine, pa.Array) else fine.combine_chunks().to_numpy(zero_copy_only=False)
    # Letters of the Latin alphabet are looked for at once; where they don't suffice, those of any script are counted.
    few = np.nonzero(fine & ~pc.match_substring_regex(table["abstract"], _LATIN_LETTERS).to_numpy(zero_copy_only=False))[0]
    out = fine.copy()
    out[few] = [sum(map(str.isalpha, t)) >= LETTERS for t in table["abstract"].take(pa.array(few)).to_pylist()]
    return out


def _parse_lines(ids: pa.Array, lines: pa.Array, known: frozenset[str] | None, corpora: pa.Array | None) -> Iterator[tuple[pa.Array, pa.Array | None, pa.Table | None]]:
    """Pieces of a block: (ids, None, columns) of records that are valid, or (ids, reasons, None) of ones that aren't.

    Without periods, the columns of one that isn't valid have its period, if it has nine fields.
    """
    # One look at the whole block: nine fields, each bare or quoted from end to end. A bare line break at the end of a
    # record would give the reader a row too many only after the next one, so such records go alone as well.
    shaped = pc.and_(pc.match_substring_regex(lines, _NINE_RE2), pc.invert(pc.match_substring_regex(lines, r"[\r\n]\z")))
    at, good = _pick(lines, shaped)
    rest = np.ones(len(lines), bool)
    start = 0
    for n, table in parse_block(good):
        if table is not None:
            fine = _fine(table, corpora)
            own = at[start : start + n].filter(pa.array(fine))
            rest[own.to_numpy()] = False
            if len(own):
                yield ids.take(own), None, table if fine.all() else table.filter(pa.array(fine))
        start += n
    left = np.nonzero(rest)[0]
    told = [diagnose(line, known) for line in lines.take(pa.array(left)).to_pylist()]
    bad = [k for k, (reason, _) in enumerate(told) if reason]
    if bad:
        period = None
        if known is None:
            cells = [told[k][1][0] if told[k][1] else None for k in bad]
            period = pa.table([pa.array(cells, pa.string()), *[pa.nulls(len(bad), pa.string())] * (len(COLUMNS) - 1)], names=COLUMNS)
        yield ids.take(pa.array(left[bad])), pa.array([told[k][0] for k in bad], pa.string()), period
    odd = [k for k, (reason, _) in enumerate(told) if not reason]
    if odd:
        yield ids.take(pa.array(left[odd])), None, pa.table([pa.array(c, pa.string()) for c in zip(*(told[k][1] for k in odd))], names=COLUMNS)


def load_records(raw: DataFrame, corpora: DataFrame, id_col: str = "raw_id", line_col: str = "line", most_bytes: int = PERIOD_BYTES) -> DataFrame:
    """Every record with ``reason`` null and its columns set, or with a reason and null columns.

    The known periods are sent to each task up to ``most_bytes``; beyond that they are joined by shuffle.
    """
    periods = corpora.select("corp_id").where("corp_id is not null").distinct()
    size = periods.agg(F.coalesce(F.sum(F.octet_length("corp_id") + 64), F.lit(0))).first()[0]
    known = array = None
    if size <= most_bytes:
        names = [r[0] for r in periods.collect()]
        known, array = frozenset(names), pa.array(names, pa.string())
    schema = f"raw_id long, reason string, {', '.join(f'{c} string' for c in COLUMNS)}"
    arrow = pa.schema([("raw_id", pa.int64()), ("reason", pa.string()), *((c, pa.string()) for c in COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines = b.column(0), b.column(1).cast(pa.string())
            for first, last in _blocks(lines):
                for i, reasons, table in _parse_lines(ids[first:last], lines[first:last], known, array):
                    if table is None:
                        cols = [i, reasons, *[pa.nulls(len(i), pa.string())] * len(COLUMNS)]
                    else:
                        cols = [i, pa.nulls(len(i), pa.string()) if reasons is None else reasons, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)]
                    yield from pa.table(cols, schema=arrow).to_batches()

    got = raw.selectExpr(f"cast({id_col} as long) raw_id", f"{line_col} line").mapInArrow(run, schema)
    if known is not None:
        return got
    # A period that isn't known comes before the reasons found in other fields.
    told = got.join(periods.withColumn("there", F.lit(True)), "corp_id", "left")
    early = F.coalesce("reason", F.lit("")).isin("quoting", "column_count")
    told = told.withColumn("reason", F.when(~early & F.col("there").isNull(), "corp_id").otherwise(F.col("reason")))
    return told.select("raw_id", "reason", *(F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in COLUMNS))


def rejects(raw: DataFrame, corpora: DataFrame) -> DataFrame:
    """raw_id and reason of each record that isn't valid."""
    return load_records(raw, corpora).where("reason is not null").select("raw_id", "reason")


def accepted(raw: DataFrame, corpora: DataFrame) -> DataFrame:
    """raw_id and the nine columns of each valid record."""
    return load_records(raw, corpora).where("reason is null").drop("reason")
