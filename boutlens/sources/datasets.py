"""Readers and writers of the stored data set: parts, buffer, holdout, entities, weights, service tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens import schemas
from boutlens.functions.text import strip_map
from boutlens.operators.dataset import dedup_first


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: name, size and whole text.  Part files are small by rule (about 10 MB)."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("bytes"))


def is_table(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a stored table (Parquet, as the writers here leave it) and not landed JSON documents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return not found.select("path").isEmpty()


def _parsed(column: Column, name: str) -> Column:
    """A parsed document; one that does not parse stops the read instead of giving no rows."""
    return F.when(column.isNull(), F.raise_error(F.concat(F.lit(f"no {name} document: "), F.col("file_name")))).otherwise(column)


def _list_text() -> Column:
    """The file text when it is a JSON list; an object would otherwise be read as a list of one."""
    return F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value"))


def read_parts(spark: SparkSession, path: str, stats_as_map: bool = False) -> DataFrame:
    """Bouts of all part files with part, pos and seq.  Files that hold no list are left out.

    ``seq`` follows the numeric part and the position in it, so part 10 comes after
    part 2, and needs no sort.  ``stats_as_map`` keeps stats as maps of texts for the
    audit, where a missing key differs from a null.
    """
    schema = schemas.BOUT.replace(schemas.STATS, "map<string,string>") if stats_as_map else schemas.BOUT
    rows = _files(spark, path).withColumn("rows", F.from_json(_list_text(), f"array<struct<{as_struct(schema)}>>"))
    part = F.regexp_extract("file_name", r"part(\d+)\.json$", 1).try_cast("bigint")
    out = rows.filter(F.col("rows").isNotNull()).select("file_name", "bytes", F.coalesce(part, F.lit(0)).alias("part"), F.posexplode_outer("rows").alias("pos", "b"))
    out = out.filter(F.col("b").isNotNull()).select("file_name", "bytes", "part", "pos", "b.*")
    key = F.concat_ws("_", F.coalesce("fighter_a", F.lit("")), F.coalesce("fighter_b", F.lit("")), F.col("date"))
    return out.withColumns({"seq": F.shiftleft("part", 32) + F.col("pos"), "fight_key": key})


def as_struct(ddl: str) -> str:
    """Column DDL (name type, ...) as struct fields (name:type, ...), top level only."""
    out, depth, word_done = [], 0, False
    for ch in ddl.replace("\n", " "):
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == " " and depth == 0:
            if out and out[-1] not in (",", ":") and not word_done:
                out.append(":")
                word_done = True
            continue
        if ch == "," and depth == 0:
            word_done = False
        out.append(ch)
    return "".join(out)


def unreadable_parts(spark: SparkSession, path: str) -> DataFrame:
    """Files that are not a JSON list."""
    rows = _files(spark, path).withColumn("rows", F.from_json(_list_text(), "array<map<string,string>>"))
    return rows.filter(F.col("rows").isNull()).select("file_name", "bytes")


def with_seq(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a stored table with ``fight_key``; the order of ``order`` takes the place of the position in a file."""
    key = F.concat_ws("_", F.coalesce("fighter_a", F.lit("")), F.coalesce("fighter_b", F.lit("")), F.col("date"))
    return df.withColumns({"fight_key": key, "seq": F.struct(*order)})


def read_bouts(spark: SparkSession, path: str) -> DataFrame:
    """Bouts from JSON parts or from what `append_bouts` stored."""
    if is_table(spark, path):
        return with_seq(spark.read.parquet(path).drop("year"), ["date", "fighter_a", "fighter_b"])
    return read_parts(spark, path)


def append_bouts(df: DataFrame, path: str, max_rows: int = 1_000_000) -> None:
    """Append bouts as Parquet by year.  Files roll by row count; no reader has to find the active part."""
    dated = df.withColumn("year", F.substring("date", 1, 4))
    dated.write.mode("append").partitionBy("year").option("maxRecordsPerFile", max_rows).parquet(path)


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """The pending buffer, first row per key, from landed JSON lists or from `write_pending`.

    A landed file that is no list gives no rows; `unreadable_parts` reports it.
    """
    if is_table(spark, path):
        return dedup_first(spark.read.parquet(path), "fight_key", ["seq"])
    return dedup_first(read_parts(spark, path), "fight_key", ["seq"])


def write_pending(df: DataFrame, path: str) -> None:
    """Store the buffer with its keys and order."""
    df.write.mode("overwrite").parquet(path)


def with_legacy(current: DataFrame, *older: DataFrame) -> DataFrame:
    """Add older sources, whatever columns they have."""
    for df in older:
        current = current.unionByName(df, allowMissingColumns=True)
    return current


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    """(period, fight_key), from a JSON document or from `write_holdout`.

    Values that are not lists are ignored; a document that does not parse is an error, since held-out bouts would
    flow into training.
    """
    if is_table(spark, path):
        return spark.read.parquet(path).select("period", "fight_key")
    doc = _files(spark, path).select(F.explode(_parsed(F.from_json("value", schemas.HOLDOUT), "holdout")).alias("period", "v"))
    return doc.select("period", F.explode(F.from_json("v", "array<string>")).alias("fight_key"))


def write_holdout(df: DataFrame, path: str) -> None:
    df.select("period", "fight_key").distinct().write.mode("overwrite").parquet(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity dictionary with its scan position, from a JSON document or, in parallel, from `write_entities`."""
    if is_table(spark, path):
        return spark.read.parquet(path)
    doc = _files(spark, path).select(F.posexplode(F.map_entries(_parsed(F.from_json("value", schemas.ENTITIES), "entity"))).alias("pos", "e"))
    return doc.select(F.col("pos").cast("bigint").alias("pos"), F.col("e.key").alias("entity_id"), "e.value.*")


def write_entities(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weight bundles, one per file, or the versions that `write_weights` stored; keys may carry stray blanks."""
    if is_table(spark, path):
        names = ["model_id", "weights", "bias", "means", "stds", "names", "accuracy", "trained_on"]
        stored = spark.read.option("mergeSchema", True).parquet(path)
        return stored.withColumn("model_id", F.col("model_id").cast("string")).select(*[n for n in names if n in stored.columns])
    raw = _files(spark, path).select("file_name", strip_map(F.from_json("value", "map<string,string>")).alias("m"))

    def get(key: str, kind: str) -> Column:
        text = F.try_element_at("m", F.lit(key))
        return F.from_json(text, kind) if kind.startswith("array") else text.try_cast(kind)

    return raw.select(F.col("file_name").alias("model_id"), get("weights", "array<double>").alias("weights"),
                      F.coalesce(get("bias", "double"), F.lit(0.0)).alias("bias"), get("feature_means", "array<double>").alias("means"),
                      get("feature_stds", "array<double>").alias("stds"), get("feature_names", "array<string>").alias("names"),
                      F.coalesce(get("loocv_accuracy", "double"), F.lit(0.0)).alias("accuracy"),
                      F.coalesce(get("trained_on_fights", "int"), F.lit(0)).alias("trained_on"))


def write_weights(df: DataFrame, path: str) -> None:
    """Append versions, one folder per model; nothing is overwritten, so two writers cannot clash."""
    df.write.mode("append").partitionBy("model_id").parquet(path)


def read_recent_features(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot of recent feature rows: (pos, features)."""
    rows = _files(spark, path).select(F.posexplode(F.from_json("value", "array<array<double>>")).alias("pos", "features"))
    return rows.filter(F.size("features") > 0)


def read_tariffs(spark: SparkSession, path: str) -> DataFrame:
    """Tariff dimension; a document without tariffs gives no rows."""
    doc = F.from_json("value", "tariffs map<string,struct<predictions:int,days:int>>")
    rows = _files(spark, path).select(F.explode(doc["tariffs"]).alias("price", "t"))
    return rows.select(F.col("price").try_cast("int").alias("price"), F.coalesce("t.predictions", F.lit(0)).alias("predictions"), F.coalesce("t.days", F.lit(0)).alias("days"))


def default_tariffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.TARIFFS, schemas.TARIFFS)


def read_service_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """users, licenses, predictions or payments, from Parquet or over JDBC.

    For JDBC pass url, and partitionColumn / lowerBound / upperBound / numPartitions to
    read in parallel.
    """
    schema = {"users": schemas.USERS, "licenses": schemas.LICENSES, "predictions": schemas.PREDICTIONS, "payments": schemas.PAYMENTS}[name]
    if jdbc is not None:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.schema(schema).parquet(path)


def payment_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines ``time | sender=name | text`` of the payment log, batch or stream."""
    p = F.split(F.col(line), r" \| ", 3)
    return lines.select(F.try_to_timestamp(F.get(p, F.lit(0))).alias("ts"), F.regexp_replace(F.get(p, F.lit(1)), "^sender=", "").alias("sender"),
                        F.get(p, F.lit(2)).alias("text"))
