"""Texts in nested payloads of any depth, such as readers of scanned pages return."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import work_table

MIN_SCORE = 0.65
# Names of the lists of texts and of their scores.
TEXTS, SCORES = "rec_texts", "rec_scores"


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    """A string as it is, any other value as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def texts(payloads: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(id, path, text, score) of the texts in payloads (id, payload as JSON) whose score is ``min_score`` or more.

    An object's list of texts goes with its list of scores by position, a text without a score has 1; a pair of a
    string and a number is a text with its score wherever it stands; all other values of objects and lists are searched in
    turn, to any depth. ``path`` is the place of the text; texts of one payload stand in the order of their paths, in
    which an object's own texts come first and its other values by name. Texts are trimmed, empty ones of lists left
    out. Payloads that are no JSON have none. One round of joins-free plans for each level of nesting; each level is written.
    """
    level = payloads.select("id", F.try_parse_json("payload").alias("v"), F.array().cast("array<int>").alias("path"))
    level = level.filter("v is not null")
    parts = []
    while True:
        kinds = level.withColumn("kind", _kind(F.col("v")))
        objects, lists = kinds.filter("kind like 'OBJECT%'"), kinds.filter("kind like 'ARRAY%'")
        elements = F.try_variant_get("v", "$", "array<variant>")
        # Lists of texts with their scores.
        held = objects.select("id", "path", F.try_variant_get("v", f"$.{TEXTS}", "array<variant>").alias("t"), F.try_variant_get("v", f"$.{SCORES}", "array<variant>").alias("s"))
        each = held.filter("t is not null").select("id", "path", "s", F.posexplode("t").alias("at", "x"))
        given = F.try_element_at(F.coalesce("s", F.array().cast("array<variant>")), F.col("at") + 1)
        score = F.when(F.col("at") < F.size(F.coalesce("s", F.array().cast("array<variant>"))), F.try_variant_get(given, "$", "double")).otherwise(1.0)
        parts.append(each.select("id", F.concat("path", F.array(F.lit(0), F.col("at"))).alias("path"), F.trim(_text(F.col("x"))).alias("text"), score.alias("score")).filter("text <> ''"))
        # Pairs of a text and its score.
        pair = (F.size(elements) == 2) & (_kind(F.try_variant_get("v", "$[0]", "variant")) == "STRING") & F.rlike(_kind(F.try_variant_get("v", "$[1]", "variant")), F.lit("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"))
        marked = lists.withColumn("pair", F.coalesce(pair, F.lit(False)))
        parts.append(marked.filter("pair").select("id", "path", F.trim(F.try_variant_get("v", "$[0]", "string")).alias("text"), F.try_variant_get("v", "$[1]", "double").alias("score")))
        # Everything else, one level deeper.
        view = f"payload_level_{id(level)}"
        objects.select("id", "path", "v").createOrReplaceTempView(view)
        spark = payloads.sparkSession
        below = spark.sql(f"SELECT p.id, concat(p.path, array(t.pos + 1)) AS path, t.value AS v FROM {view} p, LATERAL variant_explode(p.v) t WHERE t.key NOT IN ('{TEXTS}', '{SCORES}')")
        inside = marked.filter("not pair").select("id", "path", F.posexplode(elements).alias("at", "v")).select("id", F.concat("path", F.array("at")).alias("path"), "v")
        level = work_table(below.unionByName(inside).filter(_kind(F.col("v")).rlike("^(OBJECT|ARRAY)")), "payload-level")
        spark.catalog.dropTempView(view)
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts).filter(F.col("score") >= min_score)
