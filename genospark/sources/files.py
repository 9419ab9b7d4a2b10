"""Delimited files and parquet: genotype matrices, phenotypes and covariates in, result tables out."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import parse_value
from ..operators.calls import cells, individual_index, marker_index
from ..operators.ranks import numbered
from ..storage import discard, stored

#: Marker columns above which a file is parsed line by line instead of as columns.
WIDE = 4000


def _header(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    """That of the first file that has a line."""
    for file in sorted(spark.read.text(path).inputFiles()):
        if line := spark.read.text(file).first():
            return next(csv.reader([line[0]], delimiter=delimiter))
    raise ValueError(f"{path} is empty")


def _index(header: list[str], wanted: str | None, path: str) -> str:
    name = header[0] if wanted is None else wanted
    if name not in header:
        raise ValueError(f"{path} has no column {name!r}")
    return name


def _table(spark: SparkSession, path: str, header: list[str], delimiter: str, header_lines: bool = True, multiLine: bool = False) -> DataFrame:
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    return spark.read.csv(path, schema=schema, header=header_lines, sep=delimiter, maxColumns=max(20_480, len(header) + 1), quote='"', escape='"', multiLine=multiLine)


def _placed(table: DataFrame) -> DataFrame:
    """``table``, read from files, with ``row_idx``, which grows from line to line: the block's number and the place in it."""
    seen = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    blocks = numbered(seen.select("_file", "_start").distinct(), "_block", "_file", "_start")  # a row a block
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = seen.join(blocks, ["_file", "_start"]).withColumn("row_idx", F.shiftleft("_block", 33) + within)
    return placed.drop("_file", "_start", "_at", "_block")


def read_genotypes(spark: SparkSession, path: str, index_col: str | None = None, delimiter: str = ",", wide: int = WIDE) -> DataFrame:
    """``calls(individual, marker, dosage, row_idx, marker_idx)`` of a matrix file: a row per cell, missing cells null.

    The index column is the first unless named and may stand anywhere; all others are markers.  Repeated marker names
    are an error.  ``marker_idx`` is the column's place among the markers, ``row_idx`` grows with the lines of the files
    in the order of their names; the header may stand in each file or in the first.  A line break inside quotes belongs
    to its cell: files that have one are read whole, each by one task.  A file of more than ``wide`` columns is cut line
    by line, cells being read by the same rules, and such a line break is an error there.
    """
    header = _header(spark, path, delimiter)
    index = _index(header, index_col, path)
    at = header.index(index)
    markers = header[:at] + header[at + 1 :]
    if len(set(markers)) < len(markers):
        raise ValueError(f"{path} repeats a marker name")
    if len(header) > wide:
        long = _cells(spark, path, header, at, delimiter)
    else:
        quote = F.col("value")
        broken = spark.read.text(path).where((F.length(quote) - F.length(F.replace(quote, F.lit('"'), F.lit("")))) % 2 == 1)
        table = _table(spark, path, header, delimiter, header_lines=False, multiLine=not broken.isEmpty())
        quoted = [F.col(f"`{c.replace('`', '``')}`") for c in (index, *markers)]
        heading = F.lit(True)
        for c, name in zip(quoted[:2], (index, *markers), strict=False):
            heading &= c.eqNullSafe(F.lit(name))
        table = _placed(table).where(~heading).select("row_idx", quoted[0].alias("individual"), F.struct(*quoted[1:]).alias("_cells"))
        named = F.array(*[F.struct(F.lit(k).alias("marker_idx"), F.lit(m).alias("marker"), F.col(f"_cells.`{m.replace('`', '``')}`").alias("cell")) for k, m in enumerate(markers)])
        long = table.select("row_idx", "individual", F.explode(named).alias("c")).select("individual", "c.marker", "c.cell", "row_idx", "c.marker_idx") if markers else _cells(spark, path, header, at, delimiter)
    return long.select("individual", "marker", parse_value(F.col("cell")).alias("dosage"), "row_idx", F.col("marker_idx").cast("long").alias("marker_idx"))


def _cells(spark: SparkSession, path: str, header: list[str], at: int, delimiter: str) -> DataFrame:
    """(individual, marker, cell, row_idx, marker_idx) of a file of very many columns; cells that a line lacks are null."""
    told = spark.sparkContext.broadcast(header)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header = told.value
        names = pa.array(header[:at] + header[at + 1 :], pa.string())
        places = pa.array(range(len(names)), pa.int32())
        for batch in batches:
            for line, row in zip(batch.column("value").to_pylist(), batch.column("row_idx").to_pylist(), strict=True):
                if line.count('"') % 2:
                    raise ValueError(f"a line break inside quotes: {line[:50]}")
                cells = next(csv.reader([line], delimiter=delimiter), None)
                if not cells or cells == header:
                    continue
                found = [c or None for c in cells[: len(header)]] + [None] * (len(header) - len(cells))
                own = [pa.array([found[at]] * len(names), pa.string()), names, pa.array(found[:at] + found[at + 1 :], pa.string())]
                yield pa.record_batch([*own, pa.array([row] * len(names), pa.int64()), places], names=["individual", "marker", "cell", "row_idx", "marker_idx"])

    return _placed(spark.read.text(path)).mapInArrow(cut, "individual string, marker string, cell string, row_idx long, marker_idx int")


def read_phenotypes(spark: SparkSession, path: str, trait: str, index_col: str | None = None, delimiter: str = ",") -> DataFrame:
    """``pheno(individual, value, row_idx)``; rows without the trait are dropped, ``row_idx`` keeps the file's order."""
    header = _header(spark, path, delimiter)
    index = _index(header, index_col, path)
    _index(header, trait, path)
    table = _table(spark, path, header, delimiter).select(
        F.col(f"`{index}`").alias("individual"), parse_value(F.col(f"`{trait}`")).alias("value"), F.monotonically_increasing_id().alias("row_idx")
    )
    return table.where(F.col("value").isNotNull())


def read_covariates(spark: SparkSession, path: str, index_col: str | None = None, delimiter: str = ",") -> DataFrame:
    """``individual`` and a double per other column; a cell that is missing or no number fails, the last duplicate wins."""
    header = _header(spark, path, delimiter)
    index = _index(header, index_col, path)
    names = [c for c in header if c != index]
    cells = [F.when(parse_value(F.col(f"`{c}`")).isNull(), F.raise_error(F.lit(f"covariate {c} is missing")).cast("double")).otherwise(parse_value(F.col(f"`{c}`"))).alias(c) for c in names]
    table = _table(spark, path, header, delimiter).select(F.col(f"`{index}`").alias("individual"), *cells, F.monotonically_increasing_id().alias("_row"))
    last = Window.partitionBy("individual").orderBy(F.desc("_row"))
    return table.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank", "_row")


def read_calls(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Parquet with individual, marker and dosage; a repeated cell fails the job.

    The check shuffles every cell once; ``check=False`` leaves it out for tables that are known to be sound.
    """
    table = spark.read.parquet(path)
    if missing := {"individual", "marker", "dosage"} - set(table.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    table = table.select("individual", "marker", F.col("dosage").cast("double").alias("dosage"))
    return check_calls(table) if check else table


def check_calls(calls: DataFrame) -> DataFrame:
    """The calls, if no (individual, marker) occurs twice; else the job fails."""
    n, places = F.count(F.lit(1)), [c for c in ("row_idx", "marker_idx") if c in calls.columns]
    once = calls.groupBy("individual", "marker").agg(F.first("dosage").alias("dosage"), *[F.first(c).alias(c) for c in places], n.alias("n"))
    repeated = F.raise_error(F.concat_ws(" ", F.lit("repeated cell:"), "individual", "marker")).cast("double")
    return once.select("individual", "marker", F.when(F.col("n") > 1, repeated).otherwise(F.col("dosage")).alias("dosage"), *places)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A folder of CSV with headers, overwritten; missing values are empty.  ``single_file`` is for small tables."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_matrix(calls: DataFrame, path: str, delimiter: str = ",", everyone: DataFrame | None = None) -> None:
    """A folder of text, overwritten: a header ``id,<markers>`` at the start of the first file, then a line for each
    individual of ``calls`` (or of ``everyone``), both in the order of their indices; missing cells are empty.

    Any number of markers will do: cells are sorted by individual and marker across files, and a task puts one line
    together at a time.
    """
    spark = calls.sparkSession
    people = stored(individual_index(calls if everyone is None else everyone), "matrix-individuals")
    markers = stored(marker_index(calls), "matrix-markers")
    width, m = int(spark.conf.get("spark.sql.shuffle.partitions")), markers.count()
    none = F.lit(None).cast("string")
    heading = markers.select(F.lit(-1).cast("long").alias("row_idx"), F.lit("id").alias("name"), "marker_idx", F.col("marker").alias("cell"))
    empty = people.select("row_idx", F.col("individual").alias("name"), F.lit(-1).cast("long").alias("marker_idx"), none.alias("cell"))
    told = cells(calls).where("dosage is not null").join(markers, "marker").join(people, "individual")
    told = told.select("row_idx", F.col("individual").alias("name"), "marker_idx", F.col("dosage").cast("string").alias("cell"))
    ordered = heading.union(empty).union(told).repartitionByRange(width, "row_idx").sortWithinPartitions("row_idx", "marker_idx")

    def line(name: str, found: list[str]) -> pa.RecordBatch:
        out = io.StringIO()
        csv.writer(out, delimiter=delimiter, lineterminator="").writerow([name, *found])
        return pa.record_batch([pa.array([out.getvalue()])], names=["value"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, found = None, "", []
        for batch in batches:
            rows, at, text = (batch.column(c) for c in ("row_idx", "marker_idx", "cell"))
            rows, at, text = rows.to_numpy(), at.to_pylist(), text.to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(rows)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                if first == end:
                    continue
                if rows[first] != held:
                    if held is not None:
                        yield line(name, found)
                    held, name, found = rows[first], batch.column("name")[first].as_py(), [""] * m
                for k in range(first, end):
                    if at[k] >= 0:
                        found[at[k]] = text[k]
        if held is not None:
            yield line(name, found)

    ordered.mapInArrow(assemble, "value string").write.mode("overwrite").text(path)
    discard(people, markers)


def genotype_matrix(calls: DataFrame, markers: list[str]) -> DataFrame:
    """``id`` and a column per given marker, missing cells null: for matrices of few markers."""
    wide = calls.groupBy("individual").pivot("marker", markers).agg(F.first("dosage"))
    return wide.withColumnRenamed("individual", "id")


def array_columns(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    """Elements of an array column as columns of their own."""
    return df.select(*[c for c in df.columns if c != array], *[F.col(array)[i].alias(n) for i, n in enumerate(names)])
