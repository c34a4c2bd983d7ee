"""Column names, Spark types and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The track file format (names and order of the 26 fields).
ID = "spotify_id"
LIST_FIELDS = ("playlist_ids", "playlist_names", "genres")
AUDIO_FIELDS = (
    "tempo",
    "energy",
    "danceability",
    "valence",
    "acousticness",
    "instrumentalness",
    "liveness",
    "loudness",
    "speechiness",
)

_TEXTS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_AUDIO = dict.fromkeys(AUDIO_FIELDS, _DOUBLE)

TRACK_SCHEMA = _struct(
    spotify_id=_TEXT,
    title=_TEXT,
    artist=_TEXT,
    album=_TEXT,
    playlist_ids=_TEXTS,
    playlist_names=_TEXTS,
    isrc=_TEXT,
    year=_INT,
    duration_ms=_LONG,
    added_at=_TEXT,
    genres=_TEXTS,
    genre_source=_TEXT,
    genre_match_confidence=_DOUBLE,
    **_AUDIO,
    feature_source=_TEXT,
    feature_match_confidence=_DOUBLE,
    cluster_id=_INT,
    outlier_score=_DOUBLE,
)
TRACK_FIELDS = tuple(TRACK_SCHEMA.names)
SCALAR_FIELDS = tuple(f for f in TRACK_FIELDS if f != ID and f not in LIST_FIELDS)

# Raw service records as they arrive, before flattening.
RAW_PLAYLIST_SCHEMA = _struct(
    id=_TEXT,
    name=_TEXT,
    description=_TEXT,
    items=_struct(total=_INT),
    owner=_struct(display_name=_TEXT, id=_TEXT),
    collaborative=T.BooleanType(),
    snapshot_id=_TEXT,
)
_RAW_ITEM = _struct(
    id=_TEXT,
    name=_TEXT,
    album=_struct(name=_TEXT, release_date=_TEXT),
    artists=T.ArrayType(_struct(id=_TEXT, name=_TEXT)),
    duration_ms=_LONG,
    external_ids=_struct(isrc=_TEXT),
)
RAW_PAGE_SCHEMA = _struct(items=T.ArrayType(_struct(added_at=_TEXT, item=_RAW_ITEM)))


class MissingFeaturesError(ValueError):
    """Raised when no genre, audio or year column holds a value to cluster on."""

