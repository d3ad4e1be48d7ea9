"""File readers: ordered lines, delimited, JSON, spec documents, tagged lines, audit and training logs, JDBC."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallyframe.functions import fixed
from tallyframe.session import TASKS_PER_CORE

AUDIT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("action", T.StringType()), T.StructField("spec", T.StringType()),
    T.StructField("user", T.StringType()), T.StructField("is_valid", T.BooleanType()), T.StructField("score", T.DoubleType()),
    T.StructField("records", T.LongType()), T.StructField("errors", T.LongType()), T.StructField("rows", T.LongType()),
    T.StructField("field_count", T.LongType()), T.StructField("filename", T.StringType())])


def raw_lines(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Text rows with the place they came from: path, part number, file name, split start. A stream takes at most
    ``files_per_batch`` new files at a time."""
    reader = spark.readStream if streaming else spark.read
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return reader.text(path).select(
        F.regexp_replace(F.make_valid_utf8("value"), r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("path"),
        part.alias("_part"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("_block"))


def numbered_lines(raw: DataFrame, file_id: Column) -> DataFrame:
    """(file_id, line_no, line): non-blank lines numbered from 1 in file order.

    Files stay splittable. Inside one split the row order is the file order, so lines are numbered per split, and the
    counts of the splits before it give the offset: no task sees more than one split of a file."""
    rows = raw.filter(F.trim("line") != "").select(
        file_id.alias("file_id"), "line", "_part", "_name", "_block", F.monotonically_increasing_id().alias("_at"))
    split = ["file_id", "_part", "_name", "_block"]
    local = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*split).orderBy("_at")))
    before = Window.partitionBy("file_id").orderBy("_part", "_name", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return local.join(offsets, split).select("file_id", (F.col("_before") + F.col("_rn")).alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str, file_id: Column | None = None) -> DataFrame:
    """Ordered lines of text files, bad bytes replaced. ``file_id`` defaults to the path; ``partition_file_id()`` takes
    the ordered part files of a ``file_id=...`` directory as one file."""
    return numbered_lines(raw_lines(spark, path), file_id if file_id is not None else F.col("path"))


def read_heads(spark: SparkSession, path: str, most_bytes: int = 65_536) -> DataFrame:
    """(path, length, head): the first ``most_bytes`` bytes of every file below ``path``, and no byte more is read of it: Spark lists
    the files with their lengths (the content column is pruned), and tasks open each one and read its beginning. Empty files have no row."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    # Spark counts a file as 4 MB or more, about 32 to a task; a beginning takes less than the start of a task's worker
    tasks, few = listed._jdf.rdd().getNumPartitions(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    listed = listed.coalesce(max(few, tasks // 16)) if tasks > few else listed

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, heads = batch.slice(at, 64), []
                for name in part.column(0).to_pylist():
                    store, inner = fs.FileSystem.from_uri(name)
                    with store.open_input_stream(inner, buffer_size=0) as file:
                        heads.append(file.read(most_bytes))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.binary())], names=["path", "length", "head"])

    return listed.mapInArrow(beginnings, "path string, length long, head binary")


def head_lines(heads: DataFrame, most_lines: int | None = None, file_id: Column | None = None) -> DataFrame:
    """(file_id, line_no, line): the non-blank whole lines of ``read_heads``, for detection on samples; a line that the bound cuts is
    left out, unless it is the file's only one."""
    lines = F.split(F.make_valid_utf8(F.col("head").cast("string")), "\r?\n")
    cut = (F.col("length") > F.length("head")) & (F.size("_lines") > 1)
    rows = heads.withColumn("_lines", lines).withColumn("_lines", F.when(cut, F.slice("_lines", F.lit(1), F.size("_lines") - 1)).otherwise(F.col("_lines")))
    kept = F.filter("_lines", lambda line: F.trim(line) != "")
    rows = rows.select((F.col("path") if file_id is None else file_id).alias("file_id"), F.posexplode(kept if most_lines is None else F.slice(kept, 1, most_lines)).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no").cast("long") + 1)


def partition_file_id() -> Column:
    return F.regexp_extract("path", "file_id=([^/]+)", 1)


def read_delimited(spark: SparkSession, path: str, delimiter: str, header: bool | None = True, schema: str | None = None) -> DataFrame:
    """Quoted delimited files; blank rows are skipped. ``header=None`` looks at the first row to tell whether it has names."""
    if header is None:
        header = has_header(spark, path, delimiter)
    reader = spark.read.option("sep", delimiter).option("header", header).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.filter(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns]).isNotNull())


def has_header(spark: SparkSession, path: str, delimiter: str) -> bool:
    """Whether the first row of the first file with rows looks like names."""
    rows = spark.read.option("sep", delimiter).option("quote", '"').option("escape", '"').csv(path)
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in rows.columns]
    if not cells:
        return False
    first = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), looks_like_header(cells).alias("header"))
    row = first.agg(F.min_by("header", F.struct("file", "at", "id")).alias("header")).first()
    return bool(row["header"])


def looks_like_header(first: list[Column]) -> Column:
    """A first row is a header when every cell has a letter or underscore."""
    ok = F.lit(True)
    for c in first:
        ok = ok & c.rlike("[A-Za-z_]")
    return ok


def read_json_rows(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = True) -> DataFrame:
    """A JSON array, a single object, or one object per line."""
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


SPEC_JSON = """spec_name string, description string, file_structure struct<format:string,delimiter:string>,
    records array<struct<record_type_id:string,name:string,category:string,ordering:int,fields:array<struct<
        name:string,type:string,length:int,start_pos:int,end_pos:int,min_length:int,max_length:int,
        min_value:double,max_value:double,pattern:string,allowed_values:array<string>,`enum`:array<string>,
        required:boolean,nullable:boolean,justification:string,pad_char:string,format_string:string,default_value:string,
        dependencies:array<struct<depends_on:string,type:string,condition:string,formula:string>>>>>>"""


def spec_fields(documents: DataFrame) -> DataFrame:
    """Spec documents (parsed with ``SPEC_JSON``) to field rows with defaults."""
    records = documents.select("spec_name", F.posexplode("records").alias("record_no", "r"))
    fields = records.select("spec_name", "record_no", "r.*").select(
        "spec_name", F.coalesce("record_type_id", F.concat(F.lit("REC"), F.col("record_no").cast("string"))).alias("record_type"),
        F.coalesce("name", F.concat(F.lit("Record "), F.col("record_no").cast("string"))).alias("record_name"),
        F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("ordering", F.col("record_no") * 10).alias("ordering"), F.posexplode("fields").alias("field_no", "f"))
    f = F.col("f")
    return fields.select(
        "spec_name", "record_type", "record_name", "category", "ordering", (F.col("field_no") + 1).alias("pos"),
        fixed.snake_name(F.coalesce(f["name"], F.concat(F.lit("field_"), F.col("field_no").cast("string")))).alias("field"),
        F.lower(F.coalesce(f["type"], F.lit("string"))).alias("field_type"), f["start_pos"].alias("start"), f["end_pos"].alias("end"),
        f["length"].alias("length"), f["min_length"].alias("min_len"), F.coalesce(f["max_length"], f["length"]).alias("max_len"),
        f["min_value"].alias("min_value"), f["max_value"].alias("max_value"), f["pattern"].alias("pattern"),
        F.coalesce(f["allowed_values"], f["enum"], F.array().cast("array<string>")).alias("allowed"),
        F.coalesce(f["required"], F.lit(True)).alias("required"), F.coalesce(f["nullable"], F.lit(False)).alias("nullable"),
        F.coalesce(f["justification"], F.lit("left")).alias("justify"), F.coalesce(f["pad_char"], F.lit(" ")).alias("pad"),
        f["format_string"].alias("format_string"), f["default_value"].alias("default_value"), f["dependencies"].alias("dependencies"))


def read_spec_documents(spark: SparkSession, path: str) -> DataFrame:
    """A directory of native JSON spec documents as one field table."""
    return spec_fields(spark.read.option("multiLine", True).schema(SPEC_JSON).json(path))


def spec_dependencies(fields: DataFrame) -> DataFrame:
    return fields.select("spec_name", "record_type", "field", F.explode("dependencies").alias("d")).select(
        "spec_name", "record_type", "field", "d.depends_on", F.coalesce("d.type", F.lit("conditional")).alias("kind"),
        "d.condition", "d.formula")


def tagged_pairs(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """KEY=VALUE pairs of tagged lines: (key, tag, value)."""
    pairs = F.expr(f"regexp_extract_all({line}, '[A-Z_]{{2,}}=[^|,\\n]*', 0)")
    return lines.select(key, F.explode(pairs).alias("pair")).select(
        key, F.expr("substring_index(pair, '=', 1) as tag"), F.expr("substring(pair, instr(pair, '=') + 1) as value"))


def unknown_tags(pairs: DataFrame, spec_fields_df: DataFrame) -> DataFrame:
    """Tags found minus field names known."""
    return pairs.select("tag").distinct().exceptAll(spec_fields_df.select(F.col("field").alias("tag")).distinct())


def append_tags(spec: DataFrame, tags: DataFrame) -> DataFrame:
    """Extend a layout (record_type, field, field_type) by the unknown tags as string fields of the detail record."""
    extra = tags.select(F.lit("DETAIL").alias("record_type"), fixed.snake_name(F.col("tag")).alias("field"),
                        F.lit("string").alias("field_type"))
    return spec.unionByName(extra.join(spec, ["record_type", "field"], "left_anti"))


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole text files as documents, one row per file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_audit(spark: SparkSession, path: str, action: str | None = None, spec: str | None = None) -> DataFrame:
    """Audit events; unreadable lines are skipped."""
    events = spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("action is not null")
    if action:
        events = events.filter(F.col("action") == action)
    return events.filter(F.col("spec") == spec) if spec else events


TRAINING_LOG = "iter bigint, train_loss double, val_loss double, lr double, elapsed_s double"


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_LOG).option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, limit: int | None = None, partition: dict | None = None,
              **options: str) -> DataFrame:
    """A database query as text-friendly rows: dates in ISO form; all rows, unless the caller sets a limit. ``partition`` names
    column, lowerBound, upperBound and numPartitions for a parallel read of a table."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", partition["column"])
        for key in ("lowerBound", "upperBound", "numPartitions"):
            reader = reader.option(key, partition[key])
    else:
        reader = reader.option("query", query)
    df = iso_text(reader.load())
    return df.limit(limit) if limit else df


def iso_text(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text; numbers, text and booleans stay; anything else becomes text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif not isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType)) or isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)
