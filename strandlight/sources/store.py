"""Project tables, keyed caches and text outputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
MANIFEST = """
schema_version int, sources array<string>,
files map<string, struct<id:string,path:string,source_class:string,duration_s:double,width:int,height:int,rotation:int,fps:double,creation_time:string>>,
segments map<string, struct<id:string,file_id:string,start_s:double,end_s:double,trimmed_start_s:double,trimmed_end_s:double,score:double,outcome:string,reason:string,
  tags:array<struct<label:string,confidence:double,source:string,`group`:string,primary:boolean>>>>
"""


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a JSON manifest.  One of a newer version is refused."""
    doc = spark.read.schema(MANIFEST).json(path, multiLine=True)
    newest = doc.agg(F.max("schema_version")).first()[0]
    if newest is None or newest > SCHEMA_VERSION:
        raise ValueError(f"manifest of version {newest}; this engine reads up to {SCHEMA_VERSION}")
    tables = {}
    for name in ("files", "segments"):
        tables[name] = doc.select(F.explode(F.map_values(name)).alias("r")).select("r.*")
    return tables


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under the folder, put in place by Spark's commit."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_frames(frames: DataFrame, folder: str, sample_fps: float, long_side: int, version: int = SCHEMA_VERSION) -> None:
    """Append to the cache of frame metrics, in folders by what makes an entry valid."""
    keyed = frames.withColumns({"schema_version": F.lit(version), "sample_fps": F.lit(sample_fps), "long_side": F.lit(long_side)})
    keyed.write.mode("append").partitionBy("schema_version", "sample_fps", "long_side").parquet(folder)


def read_frames(spark: SparkSession, folder: str, sample_fps: float, long_side: int, version: int = SCHEMA_VERSION) -> DataFrame:
    """Entries of the version and settings; other folders are not read."""
    return spark.read.parquet(folder).where((F.col("schema_version") == version) & (F.col("sample_fps") == sample_fps) & (F.col("long_side") == long_side)).drop("schema_version", "sample_fps", "long_side")


def missing(files: DataFrame, cached: DataFrame, key: str = "content_key") -> DataFrame:
    """Files that the cache does not cover: what is left to analyse."""
    return files.join(cached.select(key).distinct(), key, "left_anti")


def cache_stats(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def prunable(listing: DataFrame, older_than_days: int, now) -> DataFrame:
    """Entries last written more than so many days before ``now``."""
    return listing.where(F.col("mtime") < F.lit(now) - F.make_dt_interval(F.lit(older_than_days)))


#: Keys of an address in the order in which they are asked for a name, and for a region.
NAME_KEYS = ("natural", "beach", "bay", "water", "hamlet", "village", "town", "suburb", "city", "municipality")
REGION_KEYS = ("island", "county", "province", "state", "region", "country")


def reverse_geocoded(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Places with name and region from a gazetteer (lat, lon, name, address map) keyed by coordinates to three places.

    name: the first key's value that is not blank, else the top-level name.  region: the first key's that is not blank and not the name.
    """
    key = [F.round(c, 3).alias(f"_{c}") for c in ("lat", "lon")]
    held = gazetteer.select(*key, F.nullif(F.btrim("name"), F.lit("")).alias("_top"), F.col("address").alias("_address"))
    joined = places.withColumns({f"_{c}": F.round(c, 3) for c in ("lat", "lon")}).join(held, ["_lat", "_lon"], "left")

    def values(keys: tuple[str, ...]) -> Column:
        """What the address has under the keys, in their order, without blanks."""
        found = F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.btrim(F.try_element_at(F.col("_address"), k)))
        return F.filter(found, lambda v: v.isNotNull() & (v != ""))

    named = joined.withColumn("_name", F.coalesce(F.get(values(NAME_KEYS), F.lit(0)), "_top"))
    region = F.get(F.filter(values(REGION_KEYS), lambda v: ~v.eqNullSafe(F.col("_name"))), F.lit(0))
    return named.select(*places.columns, F.col("_name").alias("name"), region.alias("region"))


def beatmap(clips: DataFrame, beats: DataFrame, path: str) -> None:
    """A text file: beat times, then the running start of each clip."""
    from strandlight.operators.series import running_start

    one = beats.select(F.lit(0).alias("part"), F.col("time_s").alias("at"), F.format_string("beat %.3f", "time_s").alias("value"))
    two = running_start(clips, ["order"]).select(F.lit(1).alias("part"), F.col("clip_start_s").alias("at"), F.format_string("clip %.3f", "clip_start_s").alias("value"))
    one.unionByName(two).orderBy("part", "at").select("value").coalesce(1).write.mode("overwrite").text(path)


def prompt_lines(prompts: DataFrame, ident: str = "edit") -> DataFrame:
    """(ident, variant, n, line): the lines of a prompt file: title, description and structure of each variant (title, description, lines)."""
    head = [F.concat(F.lit("## Variant "), F.col("variant").cast("string"), F.lit(" ("), F.coalesce("origin", F.lit("template")), F.lit(")")), F.lit("")]
    block = lambda title, text: [F.lit(f"**{title}**"), F.lit(""), text, F.lit("")]
    first = F.array(*head, *block("Title", F.col("title")), *block("Description", F.col("description")), F.lit("**Structure**"), F.lit(""), F.lit("```"))
    every = F.concat(first, "lines", F.array(F.lit("```"), F.lit("")))
    return prompts.select(ident, "variant", F.posexplode(every).alias("n", "line"))


def prompt_files(prompts: DataFrame, folder: str, ident: str = "edit") -> None:
    """A text file for each edit, in a folder of its name.  An edit's lines are a few dozen, and written in order by one task."""
    rows = prompt_lines(prompts, ident).repartition(ident).sortWithinPartitions(ident, "variant", "n")
    rows.select(ident, F.col("line").alias("value")).write.mode("overwrite").partitionBy(ident).text(folder)


def run_record(spark: SparkSession, kind: str, config, counts: dict) -> DataFrame:
    """One row for the table of runs."""
    return spark.createDataFrame([(kind, json.dumps(counts, sort_keys=True), repr(config))], "kind string, counts string, config string").withColumn("at", F.current_timestamp())
