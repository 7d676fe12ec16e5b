"""Reading and writing the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.alignment import read_turns

EVENT = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("reaction", T.StringType()), T.StructField("is_rare", T.BooleanType()), T.StructField("register", T.StringType()), T.StructField("slot", T.StringType())])
SCENARIO = T.StructType([
    T.StructField("scenario_id", T.StringType()), T.StructField("template_id", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("theme", T.StringType()), T.StructField("template_title", T.StringType()), T.StructField("template_description", T.StringType()),
    T.StructField("scene", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("gender_a", T.StringType()), T.StructField("gender_b", T.StringType()),
    T.StructField("scenario_idx_in_template", T.IntegerType()),
    T.StructField("llm_output", T.StructType([T.StructField("subject", T.StringType())])),
    T.StructField("speakers", T.StructType([T.StructField("A", T.StringType()), T.StructField("B", T.StringType())])),
    T.StructField("role_a", T.StringType()), T.StructField("role_b", T.StringType()),
    T.StructField("events", T.ArrayType(EVENT)), T.StructField("has_rare_event", T.BooleanType()), T.StructField("split", T.StringType()),
])
AUDIO = ("wav", "mp3", "flac", "ogg", "m4a", "opus", "aiff", "aif", "aac")


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Records of a JSON file: an array of objects, or one object whose values are the records.

    The two forms are told apart by the first character. Any other root raises when it is read. Of
    several records with one `key` the last stays.
    """
    whole = spark.read.text(path, wholetext=True).select(F.ltrim(F.col("value")).alias("v"))
    listed = F.from_json("v", T.ArrayType(schema), {"mode": "FAILFAST"})
    mapped = F.map_values(F.from_json("v", T.MapType(T.StringType(), schema), {"mode": "FAILFAST"}))
    rows = whole.select(F.posexplode(F.when(F.col("v").startswith("["), listed).when(F.col("v").startswith("{"), mapped).otherwise(F.raise_error(F.lit("neither a list nor a map of records")))).alias("ordinal", "r"))
    last = Window.partitionBy(f"r.{key}").orderBy(F.desc("ordinal"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").select("ordinal", "r.*")


def listed_ids(spark: SparkSession, path: str, key: str = "scenario_id") -> DataFrame:
    """(key) of a JSON file: the entries of a list, or the names of an object, each once, without empty ones. Anything else holds none."""
    whole = spark.read.text(path, wholetext=True).select(F.ltrim(F.col("value")).alias("v"))
    names = F.map_keys(F.from_json("v", "map<string,string>"))
    found = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).when(F.col("v").startswith("{"), names)
    return whole.select(F.explode(found).alias(key)).where(F.col(key) != "").distinct()


def themes(spark: SparkSession, path: str) -> DataFrame:
    """(topic, place, category, theme, theme_key) of a JSON file {topics: [{category, items}]}, places from 0; theme_key is category::theme."""
    rows = spark.read.schema("topics array<struct<category:string,items:array<string>>>").json(path, multiLine=True)
    topics = rows.select(F.posexplode("topics").alias("topic", "t"))
    listed = topics.select("topic", F.posexplode("t.items").alias("place", "theme"), F.col("t.category").alias("category"))
    return listed.select("topic", "place", "category", "theme", F.concat_ws("::", "category", "theme").alias("theme_key"))


def registers(spark: SparkSession, path: str) -> DataFrame:
    """(reaction, place, register, move, required_tags) of a JSON file {registers: {reaction: [{key, move, required_tags}]}}."""
    rows = spark.read.schema("registers map<string,array<struct<key:string,move:string,required_tags:array<string>>>>").json(path, multiLine=True)
    listed = rows.select(F.explode("registers").alias("reaction", "r")).select("reaction", F.posexplode("r").alias("place", "r"))
    return listed.select("reaction", "place", F.col("r.key").alias("register"), F.coalesce("r.move", F.lit("")).alias("move"), F.coalesce("r.required_tags", F.array().cast("array<string>")).alias("required_tags"))


def manifests(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Scene manifests (`*.manifest.json`) that have placed events, with the path they came from."""
    read = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.manifest.json").json(folder)
    return read.withColumn("manifest_path", F.input_file_name()).where(F.col("events_placed").isNotNull())


def turn_files(spark: SparkSession, folder: str, suffix: str = ".json", key: str = "scenario_id") -> DataFrame:
    """(key, turns) of the alignment files `<key><suffix>` of a folder; files that hold no turns have none."""
    read = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    named = read.select(F.url_decode(name).alias("_name"), read_turns(F.col("value")).alias("turns"))
    other = ~F.col("_name").endswith(".meta.json") if suffix == ".json" else F.lit(True)
    return named.where(other).select(F.substring("_name", F.lit(1), F.length("_name") - len(suffix)).alias(key), "turns")


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """(pool, name, path) of audio files below `folder`: pool is the sub-folder; hidden files are left out."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    parts = F.split("path", "/")
    named = listed.select(F.try_element_at(parts, F.lit(-2)).alias("pool"), F.try_element_at(parts, F.lit(-1)).alias("name"), "path")
    return named.where(F.lower("name").rlike(rf"^[^.].*\.({'|'.join(AUDIO)})$"))


def first_by_priority(found: DataFrame, key: str, priority: list[str], kind: str = "extension") -> DataFrame:
    """One row per `key`: the one whose `kind` comes first in `priority`, others after by name."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind))
    order = F.struct(F.when(rank > 0, rank).otherwise(len(priority) + 1), F.col("name"))
    return found.groupBy(key).agg(F.min_by(F.struct(*[c for c in found.columns if c != key]), order).alias("r")).select(key, "r.*")


def write_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A directory written whole or not at all (Spark's commit protocol)."""
    df.write.mode("overwrite").format(fmt).save(path)


def merge_summaries(before: DataFrame, now: DataFrame, key: str = "task") -> DataFrame:
    """Summaries of an earlier run with those of tasks just run in their place."""
    return now.unionByName(before.join(now.select(key), key, "left_anti").select(*now.columns))
