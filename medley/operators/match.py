"""Resolve free-text descriptions (title, artist, album) to one catalogue item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from medley.functions.text import norm_text
from medley.plans.skew import materialized
from medley.schema import ID

SHORT = 4096  # items with a word up to which all are met at once; results do not depend on it


def _words(*texts: str) -> Column:
    parts = [F.split(norm_text(F.coalesce(F.col(t), F.lit(""))), " ") for t in texts]
    return F.array_distinct(F.filter(F.concat(*parts), lambda w: w != ""))


def _first_hits(queries: DataFrame, catalogue: DataFrame, fields: dict[str, str]) -> DataFrame:
    """First catalogue item (by pos) that holds, field by field, all words a query asks for.

    A hit must hold every asked word, so each query is joined on the one that is rarest in its field. Where that
    is a frequent word too, its items are met in blocks of rising pos, each as large as all before: a hit in a
    block is the first one, and the query takes no part in the next.
    """
    def tagged(columns: list[str]) -> Column:
        return F.concat(*[_tag(c, str(i)) for i, c in enumerate(columns)])

    index = catalogue.withColumn("_w", F.explode(tagged(list(fields.values()))))
    freq = index.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    opened = queries.select("query", F.explode(tagged(list(fields))).alias("_w")).join(freq, "_w", "left")
    rarest = (
        opened.groupBy("query")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_w")).alias("_r"))
        .where("_r.n > 0")
        .select("query", "_r._w", F.col("_r.n").alias("_n"))
    )
    holds = F.lit(True)
    for asked, held in fields.items():
        holds = holds & (F.size(F.array_except(asked, held)) == 0)

    def first(some: DataFrame, items: DataFrame) -> DataFrame:
        return some.join(items, "_w").where(holds).groupBy("query").agg(F.min(F.struct("pos", ID))[ID].alias(ID))

    keyed = materialized(queries.join(rarest, "query"))
    found = first(keyed.where(F.col("_n") <= SHORT), index)
    left = keyed.where(F.col("_n") > SHORT)
    if left.isEmpty():
        return found
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialized(index.repartitionByRange(parts, "pos").sortWithinPartitions("pos"))  # a block is a few row groups
    for block in _blocks(catalogue):
        some = materialized(first(left, ordered.where(block)))
        found = found.unionByName(some)
        left = materialized(left.join(some.select("query"), "query", "left_anti"))
        if left.isEmpty():
            break
    return found


def _blocks(catalogue: DataFrame) -> list[Column]:
    """Conditions that cut the items by pos into blocks, each about as large as all before; a few quantiles decide."""
    share = max(SHORT / max(catalogue.count(), 1), 1e-3)
    shares = []
    while share < 1:
        shares.append(share)
        share *= 2
    cuts = sorted(set(catalogue.approxQuantile("pos", shares, 5e-4))) if shares else []
    at = F.col("pos").cast("double")
    return [(F.lit(True) if a is None else at > a) & (F.lit(True) if b is None else at <= b) for a, b in zip([None, *cuts], [*cuts, None])]


def _tag(words: str, mark: str) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(mark), w))


def match_text(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(query_id, spotify_id, matched_by): strict pass per field, then any-field pass, else null.

    The strict pass wants every word of each given field in that field of the item; the second pass
    wants every word of title and artist anywhere in the item, for queries the first left open.
    Equal items and equal queries are looked at once.
    """
    items = catalogue.groupBy("title", "artist", "album").agg(F.min(F.struct("pos", ID)).alias("_first")).select(
        "_first.*",
        _words("title").alias("has_title"),
        _words("artist").alias("has_artist"),
        _words("album").alias("has_album"),
        _words("title", "artist", "album").alias("has_any"),
    )
    fields = [F.array_sort(_words(c)).alias(f"{c}_words") for c in ("title", "artist", "album")]
    asked = queries.select("query_id", F.struct(*fields).alias("query"))
    kinds = materialized(asked.select("query").distinct().where(F.size("query.title_words") > 0)).select(
        "query", "query.*", F.array_distinct(F.concat("query.title_words", "query.artist_words")).alias("loose_words")
    )
    strict = materialized(
        _first_hits(kinds, items, {"title_words": "has_title", "artist_words": "has_artist", "album_words": "has_album"})
    )
    rest = kinds.join(strict.select("query"), "query", "left_anti")
    loose = _first_hits(rest, items, {"loose_words": "has_any"})
    hits = strict.withColumn("matched_by", F.lit("fields")).unionByName(loose.withColumn("matched_by", F.lit("words")))
    return asked.join(hits, "query", "left").select("query_id", ID, "matched_by")
