"""The supplied tables in the shapes that timeline operators take. Times are BIGINT milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomline.session import ship_package

EPOCH = "2024-01-01 00:00:00"
HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`script, ord, t, pos, kind, k`: one action for each event."""
    e = table(spark, sf_dir, "events")
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts"))
    return e.select(F.col("user_id").alias("script"), F.col("event_id").alias("ord"), micros.alias("us"), "value", "event_type", "props").select(
        "script", "ord", F.expr("us div 1000").alias("t"), (F.floor("value") % 101).cast("long").alias("pos"), F.col("event_type").alias("kind"), F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"), "value"
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`script, ord, s, e, kind, k, pos`: each action up to the next of its script; the last is dropped."""
    by = Window.partitionBy("script").orderBy("t", "ord")
    return actions(spark, sf_dir).select("script", "ord", F.col("t").alias("s"), F.lead("t").over(by).alias("e"), "kind", "k", "pos").where("e is not null")


def offsets(spark: SparkSession, hours: int = 6, count: int = 124) -> DataFrame:
    """`ord, s, e, off`: stretches of some hours with offsets 500, none, -1000 in turn; the last ones are missing."""
    d = hours * HOUR
    return spark.range(count - 6).select(F.col("id").alias("ord"), (F.col("id") * d).alias("s"), ((F.col("id") + 1) * d).alias("e"), F.expr("case id % 3 when 0 then 500L when 1 then null else -1000L end").alias("off"))


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc, ord, speaker, text, s, e`: turns of a conversation, 60 ms a character, with gaps of 100 to 999 ms."""
    c = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    base = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), text.alias("text"), (F.length(text) * 60).cast("long").alias("dur"), (F.col("turn") * 137 % 900 + 100).alias("gap"))
    by = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(by), F.lit(0))
    return base.withColumn("s", start).select("doc", "ord", "speaker", "text", "s", (F.col("s") + F.col("dur")).alias("e"))


#: The same derivations as DuckDB common table expressions.
SQL = {
    "actions": "actions AS (SELECT user_id AS script, event_id AS ord, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 1000 AS t, CAST(floor(value) AS BIGINT) % 101 AS pos, event_type AS kind, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, value FROM events)",
    "timings": "timings AS (SELECT * FROM (SELECT script, ord, t AS s, lead(t) OVER (PARTITION BY script ORDER BY t, ord) AS e, kind, k, pos FROM actions) WHERE e IS NOT NULL)",
    "offsets": "offsets AS (SELECT i AS ord, i * 21600000 AS s, (i + 1) * 21600000 AS e, CAST(CASE i % 3 WHEN 0 THEN 500 WHEN 1 THEN NULL ELSE -1000 END AS BIGINT) AS off FROM range(118) r(i))",
    "subtitles": "subtitles AS (SELECT doc, ord, speaker, text, s, s + dur AS e FROM (SELECT doc, ord, speaker, text, dur, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (SELECT conv_id AS doc, turn AS ord, role AS speaker, coalesce(text, '') AS text, length(coalesce(text, '')) * 60 AS dur, turn * 137 % 900 + 100 AS gap FROM conversations)))",
}
_NEEDS = {"timings": ["actions"]}


def with_sql(*names: str) -> str:
    """`WITH` and the named derivations, with what they need."""
    out: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in out:
                out.append(n)
    return "WITH " + ", ".join(SQL[n] for n in out) + " "
