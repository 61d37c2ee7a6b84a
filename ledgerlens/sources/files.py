"""Readers of metric records, text files and delimited files, and the file manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas, vocab
from ledgerlens.functions.records import RECORDS, file_records, header_names
from ledgerlens.functions.text import SPACE, squash, strip
from ledgerlens.operators.ordering import lookup
from ledgerlens.session import cut_lineage


def read_company_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Typed company metrics of JSON arrays, with `reason` for rows that miss a required field.

    `pos` keeps the order in the input.
    """
    rows = spark.read.schema(schemas.COMPANY_METRICS).json(path, multiLine=True)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in schemas.COMPANY_METRICS_REQUIRED]))
    return rows.withColumn("pos", F.monotonically_increasing_id()).withColumn(
        "reason", F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    )


def write_comparison(result: DataFrame, path: str) -> None:
    """Nested comparison results as JSON lines with null fields kept."""
    result.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pretty_comparison(result: DataFrame) -> DataFrame:
    """The same as one indented JSON text per result."""
    options = {"pretty": "true", "ignoreNullFields": "false"}
    return result.select(F.to_json(F.struct(*result.columns), options).alias("json"))


def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(name, "/", -1), r"(?<=.)(\.[^.]+)$", 1))


def detect_suffix(name: Column, head_hex: Column, mime: Column) -> Column:
    """File kind from a known suffix, else magic bytes, else mime type, else text or not."""
    suffix = file_suffix(name)
    low = F.lower(F.coalesce(mime, F.lit("")))
    kind = F.when((F.length(head_hex) > 0) & ~head_hex.rlike("^(..)*?00"), F.lit(".txt")).otherwise(suffix)
    for word, value in reversed(vocab.MIME_HINTS):
        kind = F.when(low.contains(word), value).otherwise(kind)
    for magic, value in reversed(vocab.MAGIC_PREFIXES):
        kind = F.when(head_hex.startswith(magic), value).otherwise(kind)
    kind = F.when(suffix.isin(*vocab.SUPPORTED_SUFFIXES), suffix).otherwise(kind)
    return F.when(kind == ".jpeg", ".jpg").otherwise(kind)


def manifest_rows(files: DataFrame) -> DataFrame:
    """name, size, head_hex, mime -> kind and the errors that rule a file out."""
    limit = vocab.MAX_FILE_BYTES
    df = files.withColumn("kind", detect_suffix(F.col("name"), F.col("head_hex"), F.col("mime")))
    errors = F.array_compact(
        F.array(
            F.when(F.col("size") == 0, F.lit("Empty file or text payload")),
            F.when(F.col("size") > limit, F.lit(f"File exceeds maximum size of {limit >> 20} MB")),
            F.when(
                ~F.col("kind").isin(*vocab.SUPPORTED_SUFFIXES),
                F.concat(F.lit("Unsupported file type: "), F.when(F.col("kind") != "", F.col("kind")).otherwise("unknown")),
            ),
        )
    )
    return df.withColumn("errors", errors)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of the files below a folder; only the first 4 KiB of each is kept.

    Files above the size limit are not opened: their rows come from the listing, their kind from the name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 4096))
    columns = [F.col("path").alias("name"), F.col("length").alias("size")]
    opened = files.filter(F.col("length") <= vocab.MAX_FILE_BYTES).select(*columns, head.alias("head_hex"))
    large = files.filter(F.col("length") > vocab.MAX_FILE_BYTES).select(*columns, F.lit("").alias("head_hex"))
    return manifest_rows(opened.unionByName(large).withColumn("mime", F.lit(None).cast("string")))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, stripped, tags left in; a warning where nothing remains."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), strip(F.col("value")).alias("text"))
    return rows.withColumn("warning", F.when(F.length("text") == 0, "TXT extraction returned no text"))


def detect_delimiter(sample: Column) -> Column:
    """The most frequent of , ; tab | in the sample; the comma when there is none."""
    counts = F.array(
        *[
            F.struct((F.length(sample) - F.length(F.replace(sample, F.lit(mark), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(mark).alias("mark"))
            for i, mark in enumerate([",", ";", "\t", "|"])
        ]
    )
    return F.array_max(counts)["mark"]


SAMPLE_CHARS = 8192  # of the first lines, to find the delimiter


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Rows of delimited files that share one header: (pos, cells), the header first (pos -1).

    Cells are collapsed text. A short line is filled with empty cells; a line with more
    cells than the header is left out, unless what it has more is one empty cell. Without
    `sep` the delimiter is found in the first lines. `pos` keeps the order in the input.
    """
    none = spark.createDataFrame([], "pos long, cells array<string>")
    if sep is None:
        lines = spark.read.text(path).limit(200).agg(F.left(F.array_join(F.collect_list("value"), "\n"), F.lit(SAMPLE_CHARS)).alias("sample"))
        sep = lines.select(detect_delimiter(F.col("sample"))).first()[0]
    head = spark.read.csv(path, sep=sep, header=False, inferSchema=False).first()
    if head is None:
        return none
    columns = [f"c{i}" for i in range(len(head))]
    schema = ", ".join(f"{c} string" for c in [*columns, "more"])
    # one column more than the header has: only a line with too many cells fills it
    lines = spark.read.schema(schema).csv(path, sep=sep, header=True, mode="PERMISSIVE").withColumn("pos", F.monotonically_increasing_id())
    rows = lines.filter("more IS NULL").select("pos", F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns]).alias("cells"))
    header = spark.createDataFrame([(-1, header_names(list(head)))], none.schema)
    return header.unionByName(rows).select("pos", F.transform("cells", squash).alias("cells"))


def read_delimited_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of all delimited files below a folder: (name, delimiter, row_no, cells), row 0 the header.

    Each file has its own delimiter, found in its first characters, and its own header; a
    file of blank lines gives an empty header, one of no bytes no row (the manifest names it). Cells are collapsed text; they may be
    quoted and hold line breaks, and `row_no` counts records, not lines. Short and long
    records are treated as in `read_delimited`. Files above the size limit, which the
    manifest rules out, are left unopened, so a file is a bounded row and stays in its task.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).filter(F.col("_metadata.file_size") <= vocab.MAX_FILE_BYTES)
    text = F.regexp_replace("value", "^\ufeff", "")
    named = files.select(F.col("_metadata.file_path").alias("name"), detect_delimiter(F.left(text, F.lit(SAMPLE_CHARS))).alias("delimiter"), text.alias("text"))
    return named.mapInArrow(file_records, RECORDS).withColumn("cells", F.transform("cells", squash))


def delimited_summary(records: DataFrame) -> DataFrame:
    """One row per file: its delimiter, data rows and columns, and a warning where it has no data."""
    n = F.count_if(F.col("row_no") > 0)
    found = records.groupBy("name", "delimiter").agg(n.alias("row_count"), F.max(F.when(F.col("row_no") == 0, F.size("cells"))).alias("column_count"))
    return found.withColumn("warning", F.when(F.col("row_count") == 0, NO_DATA_ROWS))


NO_DATA_ROWS = "CSV extraction found no data rows"


def normalise_cells(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda cell: squash(F.coalesce(cell, F.lit("")))))


def table_warning(rows: Column) -> Column:
    return F.when(F.size(rows) <= 1, NO_DATA_ROWS)


def extract_report_metrics(reports: DataFrame, text: str = "text", file_name: str = "file_name") -> DataFrame:
    """Company metrics from report text by ordered patterns; the first that parses wins."""

    def first(patterns) -> Column:
        values = []
        for pattern in patterns:
            raw = F.regexp_replace(F.regexp_extract(F.col(text), f"(?iu){pattern}", 1), ",", "")
            values.append(raw.try_cast("double"))
        return F.coalesce(*values)

    upper, lower_name = F.upper(text), F.lower(file_name)
    stem = F.regexp_replace(F.substring_index(file_name, "/", -1), r"(?<=.)\.[^.]*$", "")
    legal = F.regexp_extract(text, rf"([A-Z0-9{SPACE[1:-1]}]{{3,30}} LIMITED)", 1)
    company = F.when(legal != "", title_case(legal)).otherwise(title_case(F.replace(stem, F.lit("_"), F.lit(" "))))
    for word, name, by_file in reversed(vocab.REPORT_COMPANIES):
        hit = upper.contains(word)
        company = F.when(hit | lower_name.contains(word.lower()) if by_file else hit, name).otherwise(company)
    fy = F.regexp_extract(text, r"FY(20\d\d)", 1)
    march = F.regexp_extract(text, r"March 31, (20\d\d)", 1)
    year = F.concat(F.lit("FY"), F.when(fy != "", fy).when(march != "", march).otherwise("2025"))
    values = {field: first(patterns) for field, patterns in vocab.REPORT_PATTERNS.items()}
    revenue = values.pop("revenue_cr")
    return reports.select(
        "*", company.alias("company_name"), year.alias("fiscal_year"), F.col(file_name).alias("source_document"),
        F.lit("Extracted from PDF").alias("source_page"),
        F.coalesce(F.nullif(revenue, F.lit(0.0)), F.lit(vocab.REPORT_DEFAULT_REVENUE)).alias("revenue_cr"),
        *[v.alias(field) for field, v in values.items()],
    )


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first letter."""
    return F.array_join(
        F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), ""
    )


GRAM = 3  # letters under which a short name is filed


def _grams(name: Column, size: int) -> Column:
    """Distinct runs of `size` letters; none in a shorter name."""
    starts = F.when(F.length(name) >= size, F.sequence(F.lit(1), F.length(name) - (size - 1)))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(name, i, F.lit(size))))


def contained_names(short: DataFrame, long: DataFrame, scope: list[str] | None = None, shortest: int = 1) -> DataFrame:
    """(short, long) for every name of `long` that holds a name of `short`; both hold different, non-empty names.

    A short name is filed under its rarest run of three letters (a shorter name under
    itself); a long name asks with each of its own runs. Rows per name grow with its length.
    With `scope` columns names meet only within one scope. No short name has fewer letters than `shortest`.
    """
    scope = scope or []
    runs = F.concat(*[_grams(F.col("long"), n) for n in range(min(shortest, GRAM), GRAM + 1)])
    asked = long.select(*scope, "long", F.explode(runs).alias("gram"))
    counts = asked.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("short") < GRAM, F.array("short")).otherwise(_grams(F.col("short"), GRAM))
    # a run that no long name has rules the short name out
    counted = lookup(short.select(*scope, "short", F.explode(own).alias("gram")), counts, [*scope, "gram"], "left")
    filed = counted.groupBy(*scope, "short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    filed = filed.filter("rarest.n > 0").select(*scope, "short", F.col("rarest.gram").alias("gram"))
    return asked.join(filed, [*scope, "gram"]).filter(F.col("long").contains(F.col("short"))).select(*scope, "short", "long")


def curated_override(reports: DataFrame, curated: DataFrame, key: str) -> DataFrame:
    """Curated metrics in place of extracted ones where a name contains the other or the file matches.

    The first curated row in input order wins. An empty name is contained in every name; a
    null one in none. The report keeps its own source document. `key` is unique in `reports`.
    """
    metrics = [c for c in curated.columns if c not in ("pos",)]
    asked = cut_lineage(reports.select(key, F.lower("company_name").alias("name"), "source_document"))
    known = curated.select("pos", F.lower("company_name").alias("name"), F.col("source_document").alias("file"))
    names = asked.filter("name <> ''").select("name").distinct()
    curated_names = cut_lineage(known.filter("name <> ''").groupBy("name").agg(F.min("pos").alias("pos")))
    in_asked = contained_names(curated_names.select(F.col("name").alias("short")), names.select(F.col("name").alias("long")))
    in_known = contained_names(names.select(F.col("name").alias("short")), curated_names.select(F.col("name").alias("long")))
    pairs = in_asked.select(F.col("long").alias("asked"), F.col("short").alias("name")).unionByName(in_known.select(F.col("short").alias("asked"), F.col("long").alias("name")))
    by_name = lookup(pairs, curated_names, ["name"]).groupBy(F.col("asked").alias("name")).agg(F.min("pos").alias("pos"))
    by_file = known.filter("file IS NOT NULL").groupBy(F.col("file").alias("source_document")).agg(F.min("pos").alias("pos"))
    # one row: the first curated row of an empty name, and the first of any name for reports of an empty one
    empty = known.agg(F.min(F.when(F.col("name") == "", F.col("pos"))).alias("any_pos"), F.min(F.when(F.col("name").isNotNull(), F.col("pos"))).alias("first_pos"))
    by_empty = asked.filter("name IS NOT NULL").join(F.broadcast(empty)).select(key, F.when(F.col("name") == "", F.col("first_pos")).otherwise(F.col("any_pos")).alias("pos"))
    same_name = lookup(asked, by_name, ["name"]).select(key, "pos")
    same_file = lookup(asked, by_file, ["source_document"]).select(key, "pos")
    match = same_name.unionByName(same_file).unionByName(by_empty.filter("pos IS NOT NULL")).groupBy(key).agg(F.min("pos").alias("pos"))
    values = curated.select(F.col("pos").alias("_pos"), F.struct(*metrics).alias("_curated"))
    found = match.join(values, match["pos"] == values["_pos"]).select(key, "_curated")
    joined = reports.join(found, key, "left")
    replaced = [
        F.when(F.col("_curated").isNotNull(), F.col("_curated")[c]).otherwise(F.col(c)).alias(c) if c != "source_document" else F.col(c)
        for c in metrics if c in reports.columns
    ]
    rest = [c for c in reports.columns if c not in metrics]
    return joined.select(*rest, *replaced, F.col("_curated").isNotNull().alias("is_curated"))
