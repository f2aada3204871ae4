"""File sources and sinks: month folders, strict CSV, page stores, JSON lines, speaker scripts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def month_tables(spark: SparkSession, root: str, table: str, prefix: str = "") -> DataFrame:
    """One logical CSV table from ``root/<yyyy-mm>/<table>.csv``: all columns strings, empty is null.

    Folders may be named like partitions, ``month=<yyyy-mm>``; ``*`` is a table of any file names.
    ``source_month`` tells the folder; a column prefix goes and slashes become underscores.  Every
    month has the columns of all, absent ones null.
    """
    df = spark.read.option("header", True).option("nullValue", "").csv(f"{root}/*/{table}.csv")
    named = df.select(*[F.col(f"`{c}`").alias(c.removeprefix(prefix).replace("/", "_")) for c in df.columns], F.col("_metadata.file_path").alias("__path"))
    return named.withColumn("source_month", F.regexp_extract("__path", r"[/=](\d{4}-\d{2})/[^/]*$", 1)).drop("__path")


def strict_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file as trimmed strings, nothing read as null; raises if a required column is absent."""
    df = spark.read.option("header", True).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in df.columns])


def numbers(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Named columns as numbers; what is no number becomes null."""
    return df.withColumns({c: F.nullif(F.trim(c), F.lit("")).try_cast(kind) for c in columns})


def whole_or_fraction(c: Column) -> Column:
    """A number as text: whole numbers without a point, others as they are; blank is null."""
    value = F.nullif(F.trim(c), F.lit(""))
    number = value.try_cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(value)


def numbered_rows(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with the place of each row in its file, from 1."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_name").alias("file"), (F.col("_metadata.row_index") + 1).alias("row_number"))


PAGE = T.StructType([T.StructField("document", T.StringType()), T.StructField("version", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("lines", T.ArrayType(T.StructType([T.StructField("y", T.DoubleType()), T.StructField("block", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType())])))])


def page_store(spark: SparkSession, root: str) -> DataFrame:
    """Page entries, one JSON file each; entries without document, page or text don't count."""
    df = spark.read.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    return df.where("document is not null and page is not null and text is not null")


def write_pages(df: DataFrame, root: str) -> None:
    """Entries by document; the committer makes files appear whole or not at all."""
    df.write.mode("append").partitionBy("document").json(root)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log of JSON lines; damaged and incomplete lines are left out."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df.dropna("any")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def nested_items(df: DataFrame, key: str, array: str, columns: dict[str, str]) -> DataFrame:
    """A row for each element of a nested array, its fields flattened by name."""
    return df.select(key, F.explode(array).alias("__item")).select(key, *[F.col(f"__item.{f}").alias(n) for n, f in columns.items()])


def name_parts(df: DataFrame, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Attributes in a file's name as columns, by the groups of a pattern."""
    return df.withColumns({n: F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")) for i, n in enumerate(names)})


def speaker_lines(spark: SparkSession, path: str) -> DataFrame:
    """``A: ...`` and ``B: ...`` lines of scripts, numbered in their file; other lines don't count."""
    df = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return df.where(F.col("value").rlike("^[AB]:")).select("file", "line", F.left("value", F.lit(1)).alias("speaker"), F.trim(F.substring("value", 3, 1 << 30)).alias("text"))


def reference_texts(csv: DataFrame, scripts: DataFrame, key: str, text: str) -> DataFrame:
    """The CSV's text where it isn't empty, else the script's."""
    return csv.select(key, F.nullif(text, F.lit("")).alias("__a")).join(scripts.select(key, F.col(text).alias("__b")), key, "full_outer").select(key, F.coalesce("__a", "__b").alias(text))


def repeated_groups(df: DataFrame, groups: list[list[str]], names: list[str], keep: list[str]) -> DataFrame:
    """A wide row with the same columns several times as one row for each filled group."""
    items = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(g, names, strict=True)]) for g in groups])
    return df.select(*keep, F.explode(items).alias("__g")).select(*keep, "__g.*").where(F.coalesce(F.trim(names[0]), F.lit("")) != "")


def split_valid(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and rows with their errors in one column."""
    marked = df.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0).withColumn("errors", F.array_join("errors", "; "))


def write_rejected(parts: list[DataFrame], path: str) -> None:
    """Rejected rows of several tables in one CSV folder, with the columns of all of them.

    The byte order mark that spreadsheets look for stands before the first column's name.
    """
    every = list(dict.fromkeys(c for p in parts for c in p.columns))
    rows = [p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast("string").alias(c) for c in every]) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    out.withColumnRenamed(every[0], f"\ufeff{every[0]}").write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as a folder of CSV (with a header) or JSON lines; replaces the one before."""
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def zip_entries(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Entries of ZIP archives: (archive, name, size, content) of those whose name ends with ``suffix``.

    Every entry's length and CRC are held against the archive's directory; a damaged archive raises.
    """

    def run(batches):
        import io
        import zipfile

        for batch in batches:
            for archive, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as held:
                    for entry in held.infolist():
                        if entry.filename.endswith(suffix) and not entry.is_dir():
                            data = held.read(entry)  # checks the CRC
                            if len(data) != entry.file_size:
                                raise ValueError(f"{archive}: {entry.filename} is shorter than declared")
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([entry.filename]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["archive", "name", "size", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, size long, content binary")


def write_sample(df: DataFrame, path: str, order: list[str], n: int) -> None:
    df.orderBy(*order).limit(n).write.option("header", True).csv(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small report table as Markdown text; raises beyond ``most`` rows."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of over {most} rows")
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in found)


def collection_name(prefix: str, config: str, model: Column | str) -> Column:
    """prefix_config_xxxxxx, the end being six digits of the model name's sha1."""
    name = F.lit(model) if isinstance(model, str) else model
    return F.concat_ws("_", F.lit(prefix), F.lit(config), F.left(F.sha1(name), F.lit(6)))
