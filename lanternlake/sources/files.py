"""File sources: directory listings with checksums, JSON lists, manifests and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "source string, family_id string, document_date string, date_source string, version_rank int, subtype string,"
    " temporal_status string"
)
PAGE_OVERRIDES = MANIFEST + ", page int, verified_visual_fact string"


def listing(spark: SparkSession, folder: str, suffix: str = ".pdf", checksum: bool = True) -> DataFrame:
    """(file_name, file_size, checksum) of the files with ``suffix``, whatever its case, by name without case.

    Without a checksum the contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    files = files.filter(F.lower("path").endswith(suffix.lower()))
    name = F.element_at(F.split("path", "/"), -1)
    digest = F.sha2("content", 256) if checksum else F.lit(None).cast("string")
    return files.select(name.alias("file_name"), F.col("length").alias("file_size"), digest.alias("checksum")).orderBy(F.lower("file_name"))


def valid_name(name: Column, suffix: str = ".pdf") -> Column:
    """A plain file name: no folders, no control characters, the right suffix and something before it."""
    plain = ~name.rlike(r"[\x00-\x1f\x7f/\\]") & ~name.isin(".", "..")
    return F.coalesce(plain & F.lower(name).endswith(suffix) & (F.length(F.trim(name)) > len(suffix)), F.lit(False))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON list; what is no object of the schema is left out, and a broken file has none."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and page overrides of a manifest file, as two tables."""
    schema = f"documents array<struct<{MANIFEST.replace(' string', ':string').replace(' int', ':int')}>>, page_overrides array<struct<{PAGE_OVERRIDES.replace(' string', ':string').replace(' int', ':int')}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.inline("documents")), raw.select(F.inline("page_overrides"))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def needs_reading(text: Column, image_ratio: Column, has_images: Column, read_empty: bool = True) -> Column:
    """Whether a page is to be read from its images: empty, or about a release without a date in it."""
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    marked = F.lower(text).rlike(r"phiên bản|phien ban|version|release|cập nhật|cap nhat|update|download")
    dated = text.rlike(r"(?<!\d)\d{1,2}[./_-]\d{1,2}[./_-](?:20)?\d{2}(?!\d)")
    return F.coalesce(has_images & F.when(empty, F.lit(read_empty)).otherwise(marked & (image_ratio >= 0.25) & ~dated), F.lit(False))


def image_ratio(boxes: Column, page_area: Column) -> Column:
    """Share of a page that its images (array of struct<w, h>) cover, at most 1."""
    total = F.aggregate(boxes, F.lit(0.0), lambda t, b: t + F.greatest(b["w"], F.lit(0.0)) * F.greatest(b["h"], F.lit(0.0)))
    return F.least(F.coalesce(F.try_divide(total, page_area), F.lit(0.0)), F.lit(1.0))


def sure_lines(lines: DataFrame, min_confidence: float = 0.65) -> DataFrame:
    """Text of pages (page_id, position, line, confidence) from lines read with enough confidence, repeats dropped."""
    first = lines.filter(F.col("confidence") >= min_confidence).groupBy("page_id", "line").agg(F.min("position").alias("position"))
    parts = F.array_sort(F.collect_list(F.struct("position", "line")))
    return first.groupBy("page_id").agg(parts.alias("parts")).select("page_id", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))
