"""Flatten raw playlist and playlist-item records and fold them into one library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from medley.operators.membership import number_memberships
from medley.plans.skew import materialized
from medley.schema import ID, RAW_PAGE_SCHEMA
from medley.sources.store import KeyedStore


def normalize_playlists(raw: DataFrame) -> DataFrame:
    """Nested playlist records as flat rows; records without content are dropped."""
    return raw.where(F.col("id").isNotNull()).select(
        F.col("id").alias(ID),
        "name",
        F.nullif("description", F.lit("")).alias("description"),
        F.col("items.total").alias("track_count"),
        F.col("owner.display_name").alias("owner"),
        F.col("owner.id").alias("owner_id"),
        F.coalesce("collaborative", F.lit(False)).alias("is_collaborative"),
        "snapshot_id",
    )


def changed_groups(playlists: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Playlists to pull: those whose (id, snapshot) is not stored; without a snapshot always."""
    if force:
        return playlists
    return playlists.join(stored.select(ID, "snapshot_id").distinct(), [ID, "snapshot_id"], "left_anti")


def unchanged_groups(playlists: DataFrame, stored: DataFrame) -> DataFrame:
    """Playlists whose stored rows can be reused."""
    return playlists.join(stored.select(ID, "snapshot_id").distinct(), [ID, "snapshot_id"], "left_semi")


def changed_in_store(playlists: DataFrame, store: KeyedStore, force: bool = False) -> DataFrame:
    """Playlists to pull, against a store keyed by id with a `snapshot_id`; only the buckets of these ids are read."""
    return changed_groups(playlists, store.lookup(playlists), force)


def release_year(release_date: Column) -> Column:
    """Year from the first four characters; null when unreadable or not after 1900.

    A year after 1900 takes all four as digits. Others are not cast: a cast that fails builds an error for its row first.
    """
    text = F.substring(release_date, 1, 4)
    year = F.when(text.rlike("^[0-9]{4}$"), text.try_cast("int"))
    return F.when(year > 1900, year)


def normalize_tracks(pages: DataFrame, order: Sequence[str]) -> DataFrame:
    """Nested item pages as rows of one item in one playlist.

    `pages` holds playlist_id, playlist_name, the order columns of the page and its JSON text
    `page`. Rows keep the order columns and `item_idx`, the place inside the page.
    """
    items = pages.withColumn("_p", F.from_json("page", RAW_PAGE_SCHEMA)).select(
        *order, "playlist_id", "playlist_name", F.posexplode("_p.items").alias("item_idx", "_i")
    )
    item = F.col("_i.item")
    artist = F.nullif(F.try_element_at(item["artists"], F.lit(1))["name"], F.lit(""))
    return items.where(item["id"] != "").select(
        *order,
        "item_idx",
        item["id"].alias(ID),
        item["name"].alias("title"),
        F.coalesce(artist, F.lit("Unknown")).alias("artist"),
        F.coalesce(item["album"]["name"], F.lit("")).alias("album"),
        F.col("playlist_id").alias("group_id"),
        F.col("playlist_name").alias("group_name"),
        item["external_ids"]["isrc"].alias("isrc"),
        release_year(item["album"]["release_date"]).alias("year"),
        item["duration_ms"].alias("duration_ms"),
        F.col("_i.added_at").alias("added_at"),
    )


ATTRIBUTES = ("title", "artist", "album", "isrc", "year", "duration_ms", "added_at")


def library_items(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per item with the attributes of its first occurrence."""
    at = F.struct(*order)
    items = rows.groupBy(ID).agg(
        F.min(at).alias("first_at"), F.min_by(F.struct(*ATTRIBUTES), at).alias("_a")
    )
    return items.select(ID, "first_at", "_a.*")


def library_members(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """All memberships of all items, numbered in order.

    They stay one row each (spotify_id, m_idx, group_id, group_name), as an item may be in any number of groups;
    implode_memberships turns them into list columns.
    """
    # Written, so that pages are parsed once and only for these columns.
    members = number_memberships(materialized(rows.select(ID, *order, "group_id", "group_name")), order)
    return members.select(ID, "m_idx", "group_id", "group_name")


def collect_library(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The items and the memberships of a library."""
    return library_items(rows, order), library_members(rows, order)
