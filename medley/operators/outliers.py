"""How far each item sits from the centre of its group.

The squared distance to the group centroid is a sum over features. A standardised column has mean 0
in its group, so it adds (weight * z)^2. The genre block adds weight^2 * (sum f^2 + sum over the
row's genres of (1 - 2 f)), where f is the share of the group's rows that carry the genre. So two
small aggregates per group replace the feature matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from medley.operators.features import (
    Weights,
    distinct_genres,
    finish_moments,
    moment_aggregates,
    numeric_fields,
    weighted_sql,
)
from medley.operators.membership import explode_memberships, filter_membership
from medley.plans.skew import materialized, top_per_group
from medley.schema import ID

# Distances are compared and ranked at this many digits, above double rounding noise.
DIGITS = 9
# Genres of a group whose shares a row of the group may carry; does not change results.
MOST_GENRES = 512


def group_distances(members: DataFrame, weights: Weights = Weights(), most_genres: int = MOST_GENRES) -> DataFrame:
    """Distance of every membership row to the centroid of its group.

    Adds `n` (group rows), `usable` (the group has a feature) and `distance`. Every row is opened
    into one part per genre plus a part named '-' that carries the numeric columns, so that one
    aggregate by (group, part) yields both the genre shares and the moments of the group. While no
    group has more than `most_genres` genres its shares go to its rows as one map, and rows stay
    whole; beyond that rows meet the shares genre by genre.
    """
    fields = numeric_fields(members)
    label = [c for c in ("group_name",) if c in members.columns]
    key = ["group_id", "pos", "m_idx", ID, *label]
    genres = F.transform(distinct_genres(), lambda g: F.concat(F.lit("+"), g))
    parts = members.select(*key, *fields, F.explode(F.concat(F.array(F.lit("-")), genres)).alias("part"))
    totals = materialized(
        parts.groupBy("group_id", "part").agg(
            F.count(F.lit(1)).alias("part_rows"), *moment_aggregates(fields, "part = '-'")
        )
    )
    squares = totals.groupBy("group_id").agg(
        F.sum(F.expr("if(part = '-', null, cast(part_rows as double) * part_rows)")).alias("squares")
    )
    moments = finish_moments(totals.where("part = '-'"), fields, ["group_id"]).withColumnRenamed("n", "rows_")
    numeric = " + ".join(f"power(coalesce({weighted_sql(c, weights)}, 0D), 2)" for c in fields) or "0D"
    weight = float(weights.genre) ** 2
    whole = f"{numeric} + {weight!r}D * coalesce(squares, 0D) / (cast(rows_ as double) * rows_)"
    own = f"{weight!r}D * (1D - 2D * (cast(part_rows as double) / rows_))"
    usable = " or ".join(["squares is not null", *[f"{c}_mean is not null" for c in fields]])
    scopes = moments.join(squares, "group_id")
    if (totals.groupBy("group_id").count().agg(F.max("count")).first()[0] or 0) <= most_genres:
        entry = F.when(F.col("part") != "-", F.struct("part", F.expr("cast(part_rows as double)").alias("part_rows")))
        lists = totals.groupBy("group_id").agg(F.map_from_entries(F.collect_list(entry)).alias("shares"))
        # Written, so that the join stands above two shuffles and a hot group can be split over tasks.
        shared = materialized(scopes.join(lists, "group_id"))
        rows = members.select(*key, *fields, genres.alias("parts")).join(shared, "group_id")
        pieces = f"aggregate(parts, 0D, (sum, part) -> sum + {own.replace('part_rows', 'element_at(shares, part)')})"
        return rows.selectExpr(*key, "rows_ as n", f"{usable} as usable", f"sqrt(greatest({whole} + {pieces}, 0D)) as distance")
    place = ["group_id", "pos", "m_idx"]
    cells = totals.select("group_id", "part", "part_rows").join(moments.select("group_id", "rows_"), "group_id")
    carried = members.select(*place, F.explode(genres).alias("part")).join(cells, ["group_id", "part"])
    pieces = carried.selectExpr(*place, f"{own} as piece").groupBy(*place).agg(F.sum("piece").alias("piece"))
    rows = members.select(*key, *fields).join(scopes, "group_id").selectExpr(*key, "rows_ as n", f"{usable} as usable", f"{whole} as whole")
    return rows.join(pieces, place, "left").selectExpr(*key, "n", "usable", "sqrt(greatest(whole + coalesce(piece, 0D), 0D)) as distance")


_COMPARABLE = "(n >= 3 and usable)"
_SCORE = f"if({_COMPARABLE} and far - near >= 1e-12D, (distance - near) / (far - near), 0D)"


def top_outliers(members: DataFrame, top_n: int = 5, weights: Weights = Weights()) -> DataFrame:
    """The `top_n` rows of every group that are farthest from its centre, scored 0..1.

    Groups of fewer than 3 rows or without features score 0 and keep the input order.
    """
    scored = materialized(group_distances(members, weights))
    bounds = scored.groupBy("group_id").agg(F.min("distance").alias("near"), F.max("distance").alias("far"))
    rank_by = F.expr(f"if({_COMPARABLE}, round(distance, {DIGITS}), 0D)")
    top = top_per_group(scored, ["group_id"], [rank_by.desc(), F.col("pos"), F.col("m_idx")], top_n)
    label = [c for c in ("group_name",) if c in members.columns]
    return top.join(bounds, "group_id").select(
        "group_id", *label, "rank", "pos", ID, F.expr(_SCORE).alias("outlier_score")
    )


def top_outliers_by_group(
    tracks: DataFrame, top_n: int = 5, weights: Weights = Weights(), playlists: Sequence[str] | None = None
) -> DataFrame:
    """top_outliers over rows that carry their memberships as lists; rows without one are left out."""
    chosen = filter_membership(tracks, playlists)
    return top_outliers(explode_memberships(chosen, ["genres", *numeric_fields(chosen)]), top_n, weights)


def score_outliers(tracks: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """All rows as one group: (pos, id, outlier_score), highest first, ties in input order."""
    members = tracks.withColumn("group_id", F.lit("all")).withColumn("m_idx", F.lit(0))
    scored = materialized(group_distances(members, weights))
    bounds = scored.groupBy("group_id").agg(  # one row
        F.min("distance").alias("near"), F.max("distance").alias("far")
    )
    return (
        scored.join(F.broadcast(bounds), "group_id")
        .select("pos", ID, F.expr(_SCORE).alias("outlier_score"))
        .orderBy(F.round("outlier_score", DIGITS).desc(), "pos")
    )
