"""CSV files of any size, read in splits although quoted cells may hold line breaks.

A line begins a record exactly if an even number of quotes stands before it in its file. One pass counts the quotes of
every split and checks its bytes as UTF-8; a running sum over the splits of a file gives the parity at which each
begins. In the second pass every split joins its own lines into records, and the pieces of the few records that reach
over a split's end are put together by file. Neither pass needs a file in one task, and cells are parsed by Spark.

Quoted cells follow RFC 4180: quotes inside are doubled, and a cell without quotes around it has none inside. A file
whose quotes do not pair up is an error, as its last record never ends. Encodings are ASCII-compatible: a line break is
the byte 0x0A, and a record may end with 0x0D 0x0A.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agroclime.sources.scratch import as_table

# The code of this module travels with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FALLBACK = "ISO-8859-1"  # fixed value: the encoding of files that are not UTF-8


class TornFile(ValueError):
    """The quotes of a file do not pair up."""


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, line, value): all lines with the split they begin in; ``line`` ascends within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )


def block_table(spark: SparkSession, path) -> DataFrame:
    """One row per split: (file, block, quotes, utf8, head, odd); ``odd`` if it begins inside a quoted cell.

    ``utf8`` tells whether the whole file is UTF-8, ``head`` is the first line of a file that is not blank.
    """
    value = F.col("value")
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"')))
    head = F.when((F.col("block") == 0) & ~value.isin("", "\r"), F.struct("line", value.cast("binary").alias("value")))
    per_block = _lines(spark, path).groupBy("file", "block").agg(
        F.sum(quotes).alias("quotes"), F.bool_and(F.is_valid_utf8(value)).alias("utf8"), F.min(head)["value"].alias("head"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    return per_block.select(
        "file", "block", "quotes", F.bool_and("utf8").over(whole).alias("utf8"), "head",
        (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"))


def _record_parts(first: bool, odd: bool, values: pa.Array):
    """Lines of one split as parts of records: (begins, ends, number of the file's first line that is not blank, data)."""
    quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
    after = (np.cumsum(quotes) + odd) % 2 == 0           # the record ends with this line
    starts = np.concatenate([[not odd], after[:-1]])     # and the next line begins one
    if starts.all() and after.all():
        data = values
        begins = ends = np.ones(len(values), bool)
    else:
        at = np.flatnonzero(starts | (np.arange(len(values)) == 0))
        stop = np.append(at[1:], len(values))
        several = np.flatnonzero(stop - at > 1)
        joined = {int(i): b"\n".join(values.slice(at[i], stop[i] - at[i]).to_pylist()) for i in several}
        plain = values.take(pa.array(at)).to_pylist()
        data = pa.array([joined.get(i, v) for i, v in enumerate(plain)], values.type)
        begins, ends = starts[at], after[stop - 1]
    header = np.zeros(len(data), bool)
    if first:
        shown = ~pc.is_in(data, pa.array([b"", b"\r"], data.type)).to_numpy(zero_copy_only=False)
        if shown.any():
            header[int(np.argmax(shown))] = True
    return begins, ends, header, data


def record_table(spark: SparkSession, path, blocks: DataFrame) -> DataFrame:
    """(file, utf8, header, data): every record's bytes. ``blocks`` is the stored ``block_table`` of the same files."""
    keyed = blocks.select("file", "block", "utf8", "odd")
    # However the join is planned, a split's lines are in one task and sorted again before they are put together.
    known = _lines(spark, path).join(keyed, ["file", "block"]).select("file", "block", "line", "utf8", "odd", F.col("value").cast("binary").alias("value"))
    ordered = known.sortWithinPartitions("file", "block", "line")
    kind = "file string, block long, place long, utf8 boolean, begins boolean, ends boolean, header boolean, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A record that is open at the end of a batch goes on in the next one's first part.
        key, place, first, odd = None, 0, False, False
        for batch in batches:
            files, starts = batch.column(0), batch.column(1).to_numpy()
            if not batch.num_rows:
                continue
            edges = set(pc.run_end_encode(files).run_ends.to_pylist()[:-1])
            edges |= set((np.flatnonzero(starts[1:] != starts[:-1]) + 1).tolist())
            cuts = [0, *sorted(edges), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = (files[a].as_py(), int(starts[a]))
                if now != key:
                    key, place, first, odd = now, 0, now[1] == 0, batch.column(4)[a].as_py()
                begins, ends, header, data = _record_parts(first, odd, batch.column(5).slice(a, b - a))
                n = len(data)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key[0]] * n), pa.array(np.full(n, key[1])), pa.array(np.arange(place, place + n)),
                    pa.array([batch.column(3)[a].as_py()] * n), pa.array(begins), pa.array(ends), pa.array(header), data,
                ], names=["file", "block", "place", "utf8", "begins", "ends", "header", "data"])
                place, first, odd = place + n, first and not header.any(), not ends[-1]

    parts = ordered.mapInArrow(run, kind)
    whole = parts.filter("begins and ends").select("file", "utf8", "header", "data")
    turn = Window.partitionBy("file").orderBy("block", "place")
    torn = parts.filter("not (begins and ends)").withColumn("record", F.count_if("begins").over(turn))
    pieces = F.array_sort(F.collect_list(F.struct("block", "place", "data")))
    mended = torn.groupBy("file", "record").agg(F.first("utf8").alias("utf8"), F.max("header").alias("header"), pieces.alias("p"))
    joined = F.aggregate(
        F.slice("p", 2, F.size("p")), F.col("p")[0]["data"], lambda all_, e: F.concat(all_, F.lit(b"\n"), e["data"]))
    return whole.unionAll(mended.select("file", "utf8", "header", joined.alias("data")))


def _names(header: str) -> list[str]:
    """Column names of a header record; repeated ones are numbered, nameless ones take their position."""
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([header.removeprefix("\ufeff")]), [])):
        name = name or f"_c{i}"
        names.append(name if name not in names else f"{name}.{sum(n.split('.')[0] == name for n in names)}")
    return names


def read_csv(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """Files with a header, every cell text. ``path`` is a file, a folder, a pattern or a list of them.

    Without ``encoding`` a file that is not UTF-8 throughout is read as Latin-1, whatever the others are. Columns go by
    the header of their own file; a column that a file lacks is NULL there. Blank lines are no records, an empty cell
    is NULL, and files without any record give no rows.
    """
    if encoding is not None and "\n".encode(encoding) != b"\n":
        raise ValueError(f"{encoding} is not compatible with ASCII")
    blocks = as_table(block_table(spark, path), "csv-blocks")
    torn = blocks.groupBy("file").agg(F.sum("quotes").alias("n")).filter("n % 2 = 1").select("file").limit(5).collect()
    if torn:
        raise TornFile("a quoted cell never ends in " + ", ".join(r.file for r in torn))

    def decoded(data, utf8):
        if encoding is not None:
            return F.decode(data, encoding)
        return F.when(utf8, data.cast("string")).otherwise(F.decode(data, FALLBACK))

    records = record_table(spark, path, blocks)
    heads = blocks.filter("head is not null").select("file", decoded(F.col("head"), F.col("utf8")).alias("head"))
    if not heads.filter((F.length("head") - F.length(F.replace("head", F.lit('"')))) % 2 == 1).isEmpty():
        # A header with a line break inside: its record is put together first.
        heads = as_table(records.filter("header").select("file", decoded(F.col("data"), F.col("utf8")).alias("head")), "csv-heads")
    kinds = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]  # files of one kind share a header
    text = decoded(F.col("data"), F.col("utf8"))
    told = records.filter(~F.col("header")).select("file", F.when(text.endswith("\r"), text.substr(F.lit(1), F.length(text) - 1)).otherwise(text).alias("text"))
    told = told.filter("text <> ''")
    if len(kinds) > 1:
        told = told.join(heads, "file")
    found = None
    for kind in kinds:
        names = _names(kind.removesuffix("\r"))
        schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        cells = (told if len(kinds) == 1 else told.filter(F.col("head") == kind)).select(
            F.from_csv("text", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*")
        found = cells if found is None else found.unionByName(cells, allowMissingColumns=True)
    return found if found is not None else spark.createDataFrame([], "_c0 string")
