"""Text, table and log files: strict and lenient readers, fixed-order writers. All go through Spark's own readers."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, required: list[str], sep: str = ",") -> DataFrame:
    """A delimited file with a header, all columns text. Raises ValueError if a required column is missing."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_prompts(spark: SparkSession, path: str, id_col: str = "prompt_id") -> DataFrame:
    """A tab-separated prompt list without the rows whose id is blank."""
    return read_table(spark, path, [id_col], sep="\t").where(F.trim(F.coalesce(id_col, F.lit(""))) != "")


def read_log(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """A JSON-lines log: a broken line raises, or is skipped where not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_artifact(spark: SparkSession, path: str, value: T.DataType, field: str = "phones") -> DataFrame:
    """A JSON artifact {field: {phone: payload}} as one row for each phone: phone, payload."""
    df = spark.read.schema(T.StructType([T.StructField(field, T.MapType(T.StringType(), value))])).json(path, multiLine=True)
    return df.select(F.explode(field).alias("phone", "payload"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of TextGrid files: path, i, start_ms, end_ms, label; without the empty ones."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    pattern = r'(?s)xmin\s*=\s*([0-9.]+)\s*xmax\s*=\s*([0-9.]+)\s*text\s*=\s*"((?:[^"]|"")*)"'
    group = lambda k: F.regexp_extract_all("value", F.lit(pattern), F.lit(k))
    rows = text.select("path", F.posexplode(F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"))).alias("i", "x"))
    ms = lambda c: F.bround(c.cast("double") * 1000).cast("long")
    label = F.trim(F.replace(F.col("x.c"), F.lit('""'), F.lit('"')))
    return rows.select("path", "i", ms(F.col("x.a")).alias("start_ms"), ms(F.col("x.b")).alias("end_ms"), label.alias("label")).where("label <> ''")


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """A delimited file with columns in a fixed order."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def append_log(df: DataFrame, path: str, day: str) -> None:
    """Appends rows to a log partitioned by the day of a timestamp column."""
    df.withColumn("day", F.date_format(day, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


#: Conditions under which Spark can't read a file as what it should be.
_MALFORMED = ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


def catalogue_audit(spark: SparkSession, tables: dict[str, str], required: dict[str, list[str]]) -> DataFrame:
    """table, exists, row_count, missing_columns, reasons, decision (reuse or rebuild) of named tables (Parquet folders).

    A table that isn't there, can't be read as Parquet, lacks a required column or has no row must be built again.
    """
    rows = []
    for name, path in tables.items():
        store = spark._jvm.org.apache.hadoop.fs.Path(path)
        exists = store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store)
        count, missing, reasons = None, [], [] if exists else [f"{name}_missing"]
        if exists:
            try:
                df = spark.read.parquet(path)
                missing = [c for c in required.get(name, []) if c not in df.columns]
                count = df.count()
            except (PySparkException, Py4JJavaError) as e:
                if not any(m in str(e) for m in _MALFORMED):  # what passes, or isn't the file's fault, is raised
                    raise
                reasons.append(f"{name}_malformed")
            if missing:
                reasons.append(f"{name}_missing_columns")
            elif count == 0:
                reasons.append(f"{name}_empty")
        rows.append((name, exists, count, missing, reasons, "rebuild" if reasons else "reuse"))
    return spark.createDataFrame(rows, "table string, exists boolean, row_count long, missing_columns array<string>, reasons array<string>, decision string")


def check_schema(df: DataFrame, expected: T.StructType) -> list[str]:
    """What a table lacks or types otherwise, as messages; empty if it may be used."""
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: missing" if f.name not in have else f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}" for f in expected if have.get(f.name) != f.dataType]


def open_tables(spark: SparkSession, folder: str, schemas: dict[str, T.StructType], version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a catalogue by name, read with their schemas. Raises ValueError if one is missing or differs, or if the
    catalogue's version (the value of schema_version in schema_meta) is another one."""
    out, wrong = {}, []
    for name, schema in schemas.items():
        try:
            df = spark.read.parquet(f"{folder}/{name}")
        except Exception as e:  # a folder that isn't there, or holds no table
            wrong.append(f"{name}: {type(e).__name__}")
            continue
        wrong += [f"{name}.{m}" for m in check_schema(df, schema)]
        out[name] = df.select(*schema.names) if not wrong else df
    if version is not None and "schema_meta" in out:
        row = out["schema_meta"].where("key = 'schema_version'").select("value").first()
        if row is None or row[0] != version:
            wrong.append(f"schema_version: {row and row[0]} instead of {version}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def init_tables(spark: SparkSession, folder: str, schemas: dict[str, T.StructType], version: str, force: bool = False) -> None:
    """Empty tables of a catalogue with its version. Raises where there are tables already, unless force is set."""
    mode = "overwrite" if force else "errorifexists"
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode(mode).parquet(f"{folder}/{name}")
    spark.createDataFrame([("schema_version", version)], "key string, value string").write.mode(mode).parquet(f"{folder}/schema_meta")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files that aren't blank: path, line."""
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.trim("value").alias("line"))
    return rows.where("line <> ''")


def recording_of(path: Column) -> Column:
    """session, prompt_id, attempt from a recording's path (.../<session>/<prompt>-a<number>.wav); nulls for other files."""
    part = lambda k: F.nullif(F.regexp_extract(path, r"([^/]+)/([^/]+)-a([0-9]+)\.(?i:wav)$", k), F.lit(""))
    return F.struct(part(1).alias("session"), part(2).alias("prompt_id"), part(3).cast("int").alias("attempt"))


def list_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """The recordings below a folder: path, length, session, prompt_id, attempt. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.withColumn("r", recording_of(F.col("path"))).where("r.prompt_id IS NOT NULL").select("path", "length", "r.*")


def write_instances(df: DataFrame, path: str, schema: T.StructType, rows_a_file: int = 100_000) -> int:
    """Parquet of a fixed schema (columns in its order, cast to its types), files of at most rows_a_file rows; returns the rows written."""
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    out.write.option("maxRecordsPerFile", rows_a_file).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path).count()


def report_json(report: DataFrame, most: int = 10_000) -> str:
    """A small report as JSON text, rows in the order of their text. Raises ValueError beyond `most` rows: that is no report."""
    rows = [r[0] for r in report.limit(most + 1).select(F.to_json(F.struct("*"))).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    return json.dumps(sorted((json.loads(r) for r in rows), key=lambda r: json.dumps(r, sort_keys=True)), ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def report_markdown(report: DataFrame, title: str, most: int = 10_000) -> str:
    """A small report as a Markdown table; nulls are dashes."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "—" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns)]
    return "\n".join([*lines, *sorted("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def filled_intervals(df: DataFrame, by: str, start: str, end: str, label: str, duration: str) -> DataFrame:
    """Intervals of a tier without gaps: by, i, start_ms, end_ms, label (empty in the gaps), from 0 to the segment's duration.

    An interval that starts before the end of one before it keeps its start, as the marks of a queue do.
    """
    a, b = F.greatest(F.col(start), F.lit(0)), F.least(F.col(end), F.col(duration))
    rows = df.select(by, F.col(duration).alias("_d"), a.alias("_a"), b.alias("_b"), F.col(label).alias("_l"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    w = Window.partitionBy(by).orderBy("_s", "_e", "_l")
    cursor = F.coalesce(F.last(F.when(F.col("_b") > F.col("_a"), F.col("_b")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    is_last = F.lead(F.lit(1)).over(w).isNull()
    rows = rows.withColumn("_c", cursor).withColumn("_last", is_last)
    piece = lambda s, e, text: F.struct(s.cast("long").alias("start_ms"), e.cast("long").alias("end_ms"), text.alias("label"))
    own = F.col("_b") > F.col("_a")
    reached = F.when(own, F.col("_b")).otherwise(F.col("_c"))
    gap = F.when(F.col("_a") > F.col("_c"), piece(F.col("_c"), F.col("_a"), F.lit("")))
    mark = F.when(own, piece(F.col("_a"), F.col("_b"), F.col("_l")))
    tail = F.when(F.col("_last") & (reached < F.col("_d")), piece(reached, F.col("_d"), F.lit("")))
    out = rows.select(by, "_s", "_e", "_l", F.posexplode(F.array_compact(F.array(gap, mark, tail))).alias("_k", "x"))
    return out.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy("_s", "_e", "_l", "_k"))).select(by, "i", "x.*")


def textgrids(intervals: DataFrame, by: str) -> DataFrame:
    """by, value: each segment's TextGrid as text, one tier. intervals: by, i, start_ms, end_ms, label without gaps."""
    seconds = lambda ms: F.regexp_replace(F.format_string("%.3f", ms / 1000), r"\.?0+$", "")
    quoted = F.replace("label", F.lit('"'), F.lit('""'))
    line = F.format_string('        intervals [%d]:\n            xmin = %s\n            xmax = %s\n            text = "%s"', "i", seconds(F.col("start_ms")), seconds(F.col("end_ms")), quoted)
    per = intervals.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))).alias("x"), F.max("end_ms").alias("d"), F.count(F.lit(1)).alias("n"))
    head = F.format_string('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = %s\ntiers? <exists>\nsize = 1\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "phones"\n        xmin = 0\n        xmax = %s\n        intervals: size = %d\n', seconds(F.col("d")), seconds(F.col("d")), "n")
    return per.select(by, F.concat(head, F.array_join(F.transform("x", lambda r: r["t"]), "\n"), F.lit("\n")).alias("value"))


def write_textgrids(intervals: DataFrame, by: str, path: str) -> None:
    """One text file for each segment, below a folder named by it."""
    textgrids(intervals, by).repartition(by).write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)


def isolated(value: Column, ok: Column, why: Column) -> Column:
    """value, error: a row's result, or null and why there is none; a bad row stops nothing."""
    return F.struct(F.when(ok, value).alias("value"), F.when(ok, None).otherwise(why).alias("error"))
