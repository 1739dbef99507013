"""Queries over payload documents and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import documents, segmenter
from lodestone.plans.record import query
from lodestone.session import spread, table

_DOCUMENT = """CASE WHEN p_partkey % 11 = 0 THEN 'no json' WHEN p_partkey % 13 = 0 THEN NULL ELSE
    concat('{"id":', cast(p_partkey AS string), ',"name":"', p_name, '","prices":{"usd":', CASE WHEN p_partkey % 7 = 0 THEN 'null' WHEN p_partkey % 7 = 1 THEN '"n/a"' ELSE concat('"', cast(p_size AS string), '.25"') END,
    '},"foil":', CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"colors":[', CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '"W"' ELSE '"U","B"' END, ']}') END"""
_DUCK_DOCUMENT = _DOCUMENT.replace("cast(p_partkey AS string)", "p_partkey::VARCHAR").replace("cast(p_size AS string)", "p_size::VARCHAR")


def payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.expr(_DOCUMENT).alias("payload"))
    return documents.parsed(rows, "payload", "document")


@query("payload_variant_paths", f"""WITH p AS (SELECT p_partkey, {_DUCK_DOCUMENT} AS t FROM part), j AS (SELECT p_partkey, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM p)
    SELECT p_partkey, j ->> '$.name' AS name, try_cast(j ->> '$.prices.usd' AS DOUBLE) AS usd, try_cast(j ->> '$.foil' AS BOOLEAN) AS foil, j ->> '$.colors[0]' AS first_color, json_array_length(j, '$.colors')::BIGINT AS n_colors FROM j""")  # fmt: skip
def payload_variant_paths(spark: SparkSession, d: str) -> DataFrame:
    """Typed reads of several paths of one parsed document; texts that are no JSON, missing and ill-typed values are null."""
    paths = {"name": ("$.name", "string"), "usd": ("$.prices.usd", "double"), "foil": ("$.foil", "boolean"), "first_color": ("$.colors[0]", "string"), "_colors": ("$.colors", "array<string>")}
    rows = documents.fields(payloads(spark, d), "document", paths)
    return rows.select("p_partkey", "name", "usd", "foil", "first_color", F.when(F.col("_colors").isNotNull(), F.size("_colors")).cast("long").alias("n_colors"))


@query("payload_variant_entries", f"""WITH p AS (SELECT p_partkey, {_DUCK_DOCUMENT} AS t FROM part), c AS (SELECT p_partkey, json_extract_string(t::JSON, '$.colors[*]') AS c FROM p WHERE json_valid(t))
    SELECT unnest(c) AS color, count(*) AS n, min(p_partkey) AS low FROM c GROUP BY color""")  # fmt: skip
def payload_variant_entries(spark: SparkSession, d: str) -> DataFrame:
    colors = documents.entries(payloads(spark, d), "document", "$.colors", "string", ["p_partkey"])
    return colors.groupBy(F.col("value").alias("color")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("low"))


@query("variant_totals", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (json_extract_string(props, '$.none') IS NULL) AS n FROM events GROUP BY event_type")
def variant_totals(spark: SparkSession, d: str) -> DataFrame:
    events = documents.parsed(table(spark, d, "events").select("event_type", "props"), "props", "document")
    rows = documents.fields(events, "document", {"k": ("$.k", "long"), "none": ("$.none", "string")})
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("none").isNull()).alias("n"))


@query("frame_segments", r"""WITH w AS (SELECT p_partkey, p_name AS t, regexp_extract_all(p_name, '[^ ]+') AS runs FROM part WHERE p_partkey % 9 <> 0),
    e AS (SELECT p_partkey, t, unnest(runs) AS run, generate_subscripts(runs, 1) AS i, runs FROM w)
    SELECT p_partkey, round(coalesce(list_sum([length(x) + 1 for x in runs[1 : i - 1]]), 0), 6)::DOUBLE AS x, length(run)::DOUBLE AS width, round(list_avg([ascii(c) for c in string_split(run, '')]) / 255, 6) AS conf FROM e""")  # fmt: skip
def frame_segments(spark: SparkSession, d: str) -> DataFrame:
    """Names as frames of one row, whose words are bright and whose blanks are dark; each ninth frame is missing."""
    segmenter.register(spark, "bright_segments", lambda: segmenter.bright_runs(1 << 20, 32))
    frames = spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_name").cast("binary")).alias("frame"))
    found = spark.sql("SELECT p_partkey, s.conf, s.points FROM {frames}, LATERAL bright_segments(frame) s", frames=frames)
    return found.select("p_partkey", F.round(F.col("points")[0]["x"], 6).alias("x"), (F.col("points")[1]["x"] - F.col("points")[0]["x"]).alias("width"), F.round("conf", 6).alias("conf"))
