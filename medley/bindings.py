"""Canonical item and membership frames derived from the given tables.

Items are `part` rows (music track = part) and groups are suppliers, or items are `orders` rows whose
own columns name the groups they are in. Everything is read whole.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from medley.functions.arrays import or_empty
from medley.schema import ID, LIST_FIELDS, TRACK_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_tracks(df: DataFrame) -> DataFrame:
    """Add the track fields a frame lacks (null, or an empty list) and put all in the fixed order."""
    cells = []
    for f in TRACK_SCHEMA.fields:
        cell = F.col(f.name) if f.name in df.columns else F.lit(None)
        cell = or_empty(cell.cast(f.dataType)) if f.name in LIST_FIELDS else cell.cast(f.dataType)
        cells.append(cell.alias(f.name))
    return df.select("pos", *cells)


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items with genres, year and four audio fields; valence is null everywhere."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"),
        F.col("p_partkey").cast("string").alias(ID),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
        F.when(size > 10, F.concat_ws("-", "p_brand", "p_size", "p_type")).alias("isrc"),
        (F.lit(1950) + F.nullif(size, F.lit(50))).alias("year"),
        F.array_append(F.split("p_name", " "), F.col("p_type")).alias("genres"),
        ((price - 900e0) * 3e0).alias("tempo"),
        F.when(F.col("p_type") != "SMALL", size / F.lit(50e0)).alias("energy"),
        (F.lit(-0.7e0) * (price - 900e0)).alias("loudness"),
        F.lit(None).cast("double").alias("valence"),
    )


def supplier_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which supplier (group) delivers which part (item)."""
    sold = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return sold.join(suppliers, sold.l_suppkey == suppliers.s_suppkey).select(
        F.col("l_partkey").alias("pos"),
        F.col("l_suppkey").alias("m_idx"),
        F.col("l_partkey").cast("string").alias(ID),
        F.col("l_suppkey").cast("string").alias("group_id"),
        F.col("s_name").alias("group_name"),
    )


def part_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier memberships with the features of the part."""
    features = part_items(spark, sf_dir).drop("title", "artist", "album", "isrc", ID)
    return supplier_members(spark, sf_dir).join(features, "pos")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items in three groups each: customer, status and priority."""
    orders = table(spark, sf_dir, "orders")
    return as_tracks(
        orders.select(
            F.col("o_orderkey").alias("pos"),
            F.col("o_orderkey").cast("string").alias(ID),
            F.col("o_orderpriority").alias("title"),
            F.concat(F.lit("Customer "), F.col("o_custkey")).alias("artist"),
            F.col("o_orderstatus").alias("album"),
            F.array(
                F.concat(F.lit("c"), F.col("o_custkey")),
                F.concat(F.lit("status-"), F.col("o_orderstatus")),
                F.concat(F.lit("prio-"), F.substring("o_orderpriority", 1, 1)),
            ).alias("playlist_ids"),
            F.array(
                F.concat(F.lit("Customer "), F.col("o_custkey")),
                F.concat(F.lit("Status "), F.col("o_orderstatus")),
                F.substring("o_orderpriority", 3, 20),
            ).alias("playlist_names"),
            F.year("o_orderdate").alias("year"),
            F.col("o_totalprice").cast("long").alias("duration_ms"),
        )
    )


def word_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as groups, the distinct words of their whole text as items."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"),
        words.alias("words"),
        F.col("doc_id").cast("string").alias("group_id"),
        F.concat_ws("/", "source", "lang").alias("group_name"),
    )
    return docs.select("pos", F.lit(0).alias("m_idx"), F.explode("words").alias(ID), "group_id", "group_name")


def feature_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored feature answers for parts: one or two records, an empty list, not found, or absent."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    record = F.concat(
        F.lit('{"id":"x","tempo":'),
        ((price - 900e0) * 2e0).cast("string"),
        F.lit(',"energy":'),
        (size / F.lit(100e0)).cast("string"),
        F.lit(',"danceability":0.0}'),
    )
    payload = (
        F.when(size == 1, F.lit("{}"))
        .when(size == 2, F.lit('{"content":[]}'))
        .when(size > 40, F.concat(F.lit('{"content":['), record, F.lit(',{"tempo":1.0}]}')))
        .otherwise(F.concat(F.lit('{"content":['), record, F.lit("]}")))
    )
    return table(spark, sf_dir, "part").where(F.col("p_type") != "LARGE").select(
        F.lit("reccobeats").alias("service"),
        F.concat(F.lit("spotify:"), F.col("p_partkey")).alias("key"),
        payload.alias("payload"),
        F.lit(1).cast("long").alias("version"),
    )


def genre_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored genre answers per (brand, type) and per brand alone, covering every tier."""
    n = F.substring("p_brand", 7, 5).cast("int")
    kind = F.lower("p_type")
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in (kind, F.concat(F.lit("g"), n), F.concat(F.lit("u"), n))]
    top = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.concat(F.lit("["), quoted[0], F.lit("]"))).otherwise(F.lit("[]"))
    genres = F.when(n <= 15, F.concat(F.lit("["), quoted[0], F.lit(","), quoted[1], F.lit(',1,true,""]'))).otherwise(F.lit('"none"'))
    unsure = F.when(n > 20, F.concat(F.lit("["), quoted[2], F.lit("]"))).otherwise(F.lit("[]"))
    artists = F.when(
        n.between(16, 18),
        F.concat(
            F.lit('[{"top_genres":[],"genres":["a'), n, F.lit('"],"analysis":{"level":10}},{"genres":["a'), n, F.lit('","b"]}]')
        ),
    ).otherwise(F.lit("[]"))
    analysis = F.when(n != 3, F.concat(F.lit(',"analysis":{"level":'), n, F.lit("}"))).otherwise(F.lit(""))
    album = F.when(F.col("p_type") == "LARGE", F.lit("{}")).otherwise(
        F.concat(
            F.lit('{"top_genres":'), top, F.lit(',"genres":'), genres, F.lit(',"unvalidated_genres":'), unsure,
            F.lit(',"album_artists":'), artists, analysis, F.lit(',"exhausted":'), (n < 20).cast("string"), F.lit("}"),
        )
    )
    parts = table(spark, sf_dir, "part")
    pairs = parts.where(F.col("p_type") != "SMALL").select("p_brand", "p_type").distinct()
    by_album = pairs.select(
        F.concat(F.lit("getgenre:"), F.lower("p_brand"), F.lit(":"), kind).alias("key"), album.alias("payload")
    )
    solo = F.concat(F.lit('{"genres":["solo '), n, F.lit('"],"analysis":{"level":50}}'))
    by_artist = parts.select("p_brand").distinct().where(n < 12).select(
        F.concat(F.lit("getgenre:"), F.lower("p_brand")).alias("key"), solo.alias("payload")
    )
    return by_album.unionByName(by_artist).select(
        F.lit("getgenre").alias("service"), "key", "payload", F.lit(1).cast("long").alias("version")
    )


PAGE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw playlist-item pages: an order is a playlist, each of its lines one page of nested JSON."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    flag = F.col("l_returnflag")
    artist = F.struct(F.col("p_brand").alias("id"), F.when(F.col("l_discount") == 0.01, "").otherwise(F.col("p_brand")).alias("name"))
    release = (
        F.when(F.col("l_quantity") == 50, F.lit("1900-01-01"))
        .when(flag == "N", F.lit(""))
        .when(flag == "R", F.lit("c. 1999"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    )
    item = F.struct(
        F.when(F.col("l_tax") != 0, F.col("l_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.struct(F.col("p_type").alias("name"), release.alias("release_date")).alias("album"),
        F.when(F.col("l_discount") != 0, F.array(artist)).otherwise(F.array().cast("array<struct<id:string,name:string>>")).alias("artists"),
        (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"),
        F.struct(F.when(F.col("p_size") > 10, F.concat(F.lit("I"), "p_size")).alias("isrc")).alias("external_ids"),
    )
    gone = (F.col("l_linestatus") == "O") & (F.col("l_quantity") == 1)
    entry = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("added_at"), F.when(~gone, item).alias("item"))
    return lines.select(
        *PAGE_ORDER,
        F.col("l_orderkey").cast("string").alias("playlist_id"),
        F.concat(F.lit("Order "), F.col("l_orderkey")).alias("playlist_name"),
        F.to_json(F.struct(F.array(entry).alias("items"))).alias("page"),
    )


def raw_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw playlist records: orders, with the customer as owner."""
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("name"),
        F.when(status == "F", F.lit("")).otherwise(F.col("o_orderpriority")).alias("description"),
        F.struct(F.col("o_custkey").cast("int").alias("total")).alias("items"),
        F.struct(F.concat(F.lit("Customer "), F.col("o_custkey")).alias("display_name"), F.col("o_custkey").cast("string").alias("id")).alias("owner"),
        F.when(status == "O", F.lit(True)).alias("collaborative"),
        F.when(status != "P", F.date_format("o_orderdate", "yyyyMMdd")).alias("snapshot_id"),
    )


def line_library(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """Library of the lines with one return flag: a row per line, item = part, group = supplier.

    The same part occurs many times in one library. `pos` is the order key and the place of the line
    inside its order (orders have far fewer than 2**15 lines).
    """
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    parts = part_items(spark, sf_dir).drop("pos")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*PAGE_ORDER[1:]))
    numbered = lines.withColumn("pos", F.shiftleft("l_orderkey", 15) + place)
    rows = numbered.join(parts, F.col("l_partkey").cast("string") == F.col(ID))
    return as_tracks(
        rows.select(
            "pos",
            ID,
            "title",
            "artist",
            "album",
            F.array(F.concat(F.lit("s"), F.col("l_suppkey"))).alias("playlist_ids"),
            F.array(F.concat_ws(" ", F.lit("Supplier"), "l_suppkey", "l_returnflag")).alias("playlist_names"),
            F.when(F.col("l_linestatus") == "O", F.col("isrc")).alias("isrc"),
            F.when(F.col("l_quantity") > 25, F.col("year")).alias("year"),
            F.when(F.col("l_discount") > 0.05, (F.col("l_quantity") * 1000).cast("long")).alias("duration_ms"),
            F.array(F.lower("l_returnflag"), F.col("album"), F.concat(F.lit("q"), (F.col("l_quantity") / 10).cast("int"))).alias("genres"),
        )
    )


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as items: title from the markup, host as artist."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pos"),
        F.col("page_id").cast("string").alias(ID),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("url", "//([^/?#]*)", 1).alias("artist"),
        F.regexp_extract("url", r"//[^/?#]*([^?#]*)", 1).alias("isrc"),
    )


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as feature vectors, with their label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label"
    )
