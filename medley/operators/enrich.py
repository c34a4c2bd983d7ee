"""Join items with stored service answers: audio features by id, genres by artist and album."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from medley.operators.membership import is_selected
from medley.schema import AUDIO_FIELDS, ID
from medley.sources.lookups import FEATURE_SERVICE, GENRE_SERVICE, feature_key, lookup_key, newest_answers

LEVELS = ("top", "best", "clean", "all")
# Provenance texts.
UNMATCHED = "unmatched"


def enrich_features(
    tracks: DataFrame, answers: DataFrame, playlists: Sequence[str] | None = None, zero_is_missing: bool = True
) -> DataFrame:
    """Overwrite the audio fields from the first record of the answer's `content`.

    Of several stored versions of an answer the newest counts. A value that is absent (or 0, unless zero_is_missing is off) keeps the old one. Without an answer
    all nine fields become null. Rows outside the selected playlists stay as they are.
    """
    found = newest_answers(answers).select(
        F.col("key").alias("_key"),
        F.from_json("payload", "struct<content: array<map<string, string>>>")["content"].alias("_content"),
    )
    joined = tracks.withColumn("_key", feature_key(F.col(ID))).join(found, "_key", "left")
    record = F.try_element_at("_content", F.lit(1))
    matched = F.coalesce(F.size(record) > 0, F.lit(False))
    chosen = is_selected(playlists)

    def value(c: str) -> Column:
        fresh = F.try_element_at(record, F.lit(c)).try_cast("double")
        if zero_is_missing:
            fresh = F.nullif(fresh, F.lit(0.0))
        return F.when(matched, F.coalesce(fresh, F.col(c)))

    new = {c: value(c) for c in AUDIO_FIELDS}
    new["feature_source"] = F.when(matched, F.lit(FEATURE_SERVICE)).otherwise(F.lit(UNMATCHED))
    new["feature_match_confidence"] = F.when(matched, F.lit(1.0) / F.size("_content")).otherwise(F.lit(0.0))
    return joined.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in new.items()}).select(*tracks.columns)


def genre_texts(item: Column, key: str) -> Column:
    """Non-empty text values of one list of a genre record (a variant); anything else counts as empty."""
    values = F.try_variant_get(item, f"$.{key}", "array<variant>")
    texts = F.filter(values, lambda v: F.schema_of_variant(v) == "STRING")
    return F.filter(
        F.coalesce(F.transform(texts, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>")),
        lambda g: g != "",
    )


def union_genre_items(items: Column, keys: Sequence[str]) -> Column:
    """Genres of several records, tier by tier, each once in order of first appearance."""

    def tier(key: str) -> Column:
        return F.flatten(F.transform(items, lambda item: genre_texts(item, key)))

    tiers = [tier(key) for key in keys]
    return F.array_distinct(F.concat(*tiers))


def mean_level(items: Column) -> Column:
    """Mean of analysis.level over the records; a missing level counts 0, no records give 0."""
    levels = F.transform(items, lambda i: F.coalesce(F.try_variant_get(i, "$.analysis.level", "double"), F.lit(0.0)))
    total = F.aggregate(levels, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(F.lit(0.0))


# Tiers of each level: (lists taken together, word in the provenance text), tried in order for the
# album record and then for the artist records.
TIERS = {
    "top": ((("top_genres",), "top"),),
    "best": ((("top_genres",), "top"), (("genres",), "validated"), (("unvalidated_genres",), "unvalidated")),
    "clean": ((("top_genres", "genres"), "clean"),),
    "all": ((("top_genres", "genres", "unvalidated_genres"), "all"),),
}


def extract_genres(answers: DataFrame, level: str = "best") -> DataFrame:
    """(key, source, confidence, genres) picked from every genre answer: album tiers, then artist tiers.

    `answers` has key and payload (JSON text). Unmatched answers have source null.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    parsed = answers.select("key", F.try_parse_json(F.coalesce("payload", F.lit("{}"))).alias("_answer")).select(
        "key",
        F.array("_answer").alias("_album"),
        F.coalesce(
            F.try_variant_get("_answer", "$.album_artists", "array<variant>"), F.array().cast("array<variant>")
        ).alias("_artist"),
    )
    tiers = [(scope, word, keys) for scope in ("album", "artist") for keys, word in TIERS[level]]
    listed = parsed.select(
        "key",
        *[mean_level(F.col(f"_{scope}")).alias(f"_level_{scope}") for scope in ("album", "artist")],
        *[union_genre_items(F.col(f"_{scope}"), keys).alias(f"_{scope}_{word}") for scope, word, keys in tiers],
    )
    source, confidence, genres = F, F, F
    for scope, word, _ in tiers:
        found = F.size(f"_{scope}_{word}") > 0
        source = source.when(found, F.lit(f"{GENRE_SERVICE} {scope} {word}"))
        confidence = confidence.when(found, F.col(f"_level_{scope}"))
        genres = genres.when(found, F.col(f"_{scope}_{word}"))
    return listed.select(
        "key",
        source.alias("source"),
        confidence.otherwise(F.lit(0.0)).alias("confidence"),
        genres.otherwise(F.array().cast("array<string>")).alias("genres"),
    )


def enrich_genres(
    tracks: DataFrame, answers: DataFrame, level: str = "best", playlists: Sequence[str] | None = None
) -> DataFrame:
    """Set genres, source and confidence from the answer for (artist, album), else for the artist alone.

    Of several stored versions of an answer the newest counts. Always overwrites, so stale genres are cleared. The second lookup is joined only for rows the
    first left unmatched; the others get a key of their own that no answer has, which spreads them
    evenly over the tasks.
    """
    picks = extract_genres(newest_answers(answers), level).select(
        F.col("key").alias("_key"), F.when(F.col("source").isNotNull(), F.struct("source", "confidence", "genres")).alias("_pick")
    )
    artist, album = F.col("artist"), F.col("album")
    unused = F.concat(F.lit("\u0001"), F.col("pos").cast("string"))
    first = (
        tracks.withColumn("_key", F.coalesce(lookup_key(GENRE_SERVICE, artist, album), unused))
        .join(picks, "_key", "left")
        .withColumnRenamed("_pick", "_first")
        .drop("_key")
    )
    again = F.col("_first").isNull() & (F.coalesce(album, F.lit("")) != "")
    second = (
        first.withColumn("_key", F.coalesce(F.when(again, lookup_key(GENRE_SERVICE, artist)), unused))
        .join(picks, "_key", "left")
        .withColumn("_best", F.coalesce("_first", "_pick"))
    )
    chosen = is_selected(playlists)
    new = {
        "genres": F.coalesce(F.col("_best.genres"), F.array().cast("array<string>")),
        "genre_source": F.coalesce(F.col("_best.source"), F.lit(UNMATCHED)),
        "genre_match_confidence": F.coalesce(F.col("_best.confidence"), F.lit(0.0)) / 100.0,
    }
    return second.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in new.items()}).select(*tracks.columns)


def enrichment_summary(tracks: DataFrame) -> DataFrame:
    """How many rows each service matched."""
    return tracks.agg(
        F.count_if(F.col("feature_source") == FEATURE_SERVICE).alias("with_features"),
        F.count_if(F.startswith("genre_source", F.lit(GENRE_SERVICE))).alias("with_genres"),
        F.count(F.lit(1)).alias("tracks"),
    )
