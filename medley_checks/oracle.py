"""DuckDB SQL for the registered queries, on the given tables.

Doubles are compared at 6 digits. They are rounded to 12 digits first, on both sides, as the order in
which an engine adds up numbers would otherwise decide values that lie halfway between two results.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

# Items and memberships, as the bindings define them.
ITEMS = """
items AS (
  SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS spotify_id, p_name AS title, p_brand AS artist, p_type AS album,
         CASE WHEN p_size > 10 THEN p_brand || '-' || p_size || '-' || p_type END AS isrc,
         1950 + NULLIF(p_size, 50) AS year,
         list_append(string_split(p_name, ' '), p_type) AS genres,
         (p_retailprice - 900e0) * 3e0 AS tempo,
         CASE WHEN p_type <> 'SMALL' THEN p_size / 50e0 END AS energy,
         -0.7e0 * (p_retailprice - 900e0) AS loudness
  FROM part)
"""
SUPPLY = """
supply AS (
  SELECT l_partkey AS pos, l_suppkey AS m_idx, CAST(l_partkey AS VARCHAR) AS spotify_id,
         CAST(l_suppkey AS VARCHAR) AS group_id, s_name AS group_name
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey)
"""
# Range of each audio field.
CLIP = {
    "tempo": "least(greatest(({x} - 0e0) / 250e0, 0e0), 1e0)",
    "energy": "least(greatest(({x} - 0e0) / 1e0, 0e0), 1e0)",
    "loudness": "least(greatest(({x} + 60e0) / 60e0, 0e0), 1e0)",
    "year": "{x}",
}


def clip(c: str, x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {CLIP[c].format(x=x)} END"


def scaled(source: str, scope: str, fields: tuple[str, ...]) -> str:
    """CTEs that end in `z`: the standardised columns of every row of `source`, per scope."""
    means = ", ".join(f"avg({c}) OVER (PARTITION BY {scope}) AS {c}_mean" for c in fields)
    filled = ", ".join(f"{clip(c, f'coalesce(CAST({c} AS DOUBLE), {c}_mean)')} AS {c}_y" for c in fields)
    stats = ", ".join(
        f"avg({c}_y) OVER (PARTITION BY {scope}) AS {c}_mu, stddev_pop({c}_y) OVER (PARTITION BY {scope}) AS {c}_sd, "
        f"max({c}_y) OVER (PARTITION BY {scope}) = min({c}_y) OVER (PARTITION BY {scope}) AS {c}_flat"
        for c in fields
    )
    z = ", ".join(
        f"CASE WHEN {c}_y IS NULL THEN NULL WHEN {c}_flat THEN 0e0 ELSE ({c}_y - {c}_mu) / {c}_sd END AS {c}_z" for c in fields
    )
    return f"""
w1 AS (SELECT *, {means} FROM {source}),
w2 AS (SELECT *, {filled} FROM w1),
w3 AS (SELECT *, {stats} FROM w2),
z AS (SELECT *, {z} FROM w3)
"""


AUDIO = ("tempo", "energy", "loudness")
NUMERIC = (*AUDIO, "year")


def distances(scope: str) -> str:
    """CTEs after `z` that end in `dist`."""
    return f"""
g AS (SELECT z.*, unnest(list_distinct(genres)) AS genre FROM z),
share AS (SELECT {scope}, genre, count(*) AS c FROM g GROUP BY ALL),
sq AS (SELECT {scope}, sum(CAST(c AS DOUBLE) * c) AS squares FROM share GROUP BY ALL),
size AS (SELECT {scope}, count(*) AS n FROM z GROUP BY ALL),
own AS (SELECT g.{scope}, g.pos, g.m_idx, sum(1e0 - 2e0 * (CAST(c AS DOUBLE) / n)) AS own
        FROM g JOIN share ON g.{scope} = share.{scope} AND g.genre = share.genre JOIN size ON g.{scope} = size.{scope}
        GROUP BY ALL),
dist AS (SELECT z.*, n, sqrt(greatest(
            tempo_z * tempo_z + energy_z * energy_z + loudness_z * loudness_z + (year_z * 0.3e0) * (year_z * 0.3e0)
            + squares / (CAST(n AS DOUBLE) * n) + coalesce(own, 0e0), 0e0)) AS d
         FROM z JOIN size USING ({scope}) JOIN sq USING ({scope})
         LEFT JOIN own ON z.{scope} = own.{scope} AND z.pos = own.pos AND z.m_idx = own.m_idx),
scored AS (SELECT *, max(d) OVER (PARTITION BY {scope}) AS far, min(d) OVER (PARTITION BY {scope}) AS near FROM dist)
"""


SCORE = "round(round(CASE WHEN n < 3 OR far - near < 1e-12 THEN 0e0 ELSE (d - near) / (far - near) END, 12), 6) + 0e0"
MEMBERS = "rows_ AS (SELECT supply.m_idx, supply.group_id, supply.group_name, items.* FROM supply JOIN items USING (pos))"



def rounded(x: str) -> str:
    """A value in 0..1 to 3 digits by its exact binary value, ties to even."""
    n = f"(CAST({x} * 1152921504606846976e0 AS HUGEINT) * 1000)"
    unit = "1152921504606846976::HUGEINT"
    up = f"CASE WHEN 2 * ({n} % {unit}) > {unit} OR (2 * ({n} % {unit}) = {unit} AND ({n} // {unit}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST({n} // {unit} + {up} AS DOUBLE) / 1000e0"


SQL["F1_score_outliers"] = f"""
WITH {ITEMS}, one AS (SELECT *, 0 AS m_idx, 'all' AS group_id FROM items),
{scaled('one', 'group_id', NUMERIC)}, {distances('group_id')}
SELECT spotify_id, {SCORE} AS outlier_score FROM scored
"""
SQL["F2_top_outliers_by_group"] = f"""
WITH {ITEMS}, {SUPPLY}, {MEMBERS}, {scaled('rows_', 'group_id', NUMERIC)}, {distances('group_id')}
SELECT group_id, group_name, CAST(rank AS INTEGER) AS rank, spotify_id, outlier_score FROM (
  SELECT *, {SCORE} AS outlier_score,
         row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN n < 3 THEN 0e0 ELSE round(d, 9) END DESC, pos, m_idx) AS rank
  FROM scored) WHERE rank <= 5
"""

# Words as bags: copies of a set collapse to the first document that has it.
WORDS = """
words AS (SELECT doc_id, source || '/' || lang AS name,
                 list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS bag
          FROM documents),
sets AS (SELECT *, min(doc_id) OVER (PARTITION BY bag) AS leader FROM words WHERE len(bag) > 0),
tokens AS (SELECT doc_id, len(bag) AS n, unnest(bag) AS w FROM sets WHERE doc_id = leader),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS s
           FROM tokens a JOIN tokens b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2)
"""
SQL["G2_find_group_overlaps"] = f"""
WITH {WORDS}, pairs AS (
  SELECT a, b, s, CAST(s AS DOUBLE) / (na + nb - s) AS j FROM shared WHERE CAST(s AS DOUBLE) / (na + nb - s) >= 0.6e0
  UNION ALL SELECT leader, doc_id, len(bag), 1e0 FROM sets WHERE doc_id <> leader)
SELECT CAST(a AS VARCHAR) AS playlist_a_id, CAST(b AS VARCHAR) AS playlist_b_id, x.name AS playlist_a_name,
       y.name AS playlist_b_name, s AS shared_track_count, {rounded("j")} AS jaccard_similarity
FROM pairs JOIN words x ON x.doc_id = a JOIN words y ON y.doc_id = b
"""

SQL["D1_genre_onehot"] = f"""
WITH {ITEMS} SELECT spotify_id, 'genre:' || unnest(list_distinct(genres)) AS feature, 1.5e0 AS value FROM items
"""
_FILLED = ", ".join(
    f"round(round(coalesce(CAST({c} AS DOUBLE), avg({c}) OVER (PARTITION BY group_id)), 12), 6) + 0e0 AS {c}" for c in NUMERIC
)
SQL["D2_impute_mean"] = f"""
WITH {ITEMS}, {SUPPLY}, {MEMBERS}
SELECT group_id, spotify_id, {_FILLED}, CAST(NULL AS DOUBLE) AS valence FROM rows_
"""
SQL["D3_range_normalize"] = f"""
WITH {ITEMS} SELECT spotify_id, {", ".join(f"round(round({clip(c, c)}, 12), 6) + 0e0 AS {c}" for c in AUDIO)} FROM items
"""


def long_form(fields: tuple[str, ...], weights: dict[str, float], more: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {more} spotify_id, '{'year' if c == 'year' else 'audio:' + c}' AS feature, "
        f"round(round({c}_z * {weights[c]}e0, 12), 6) + 0e0 AS value FROM z WHERE {c}_z IS NOT NULL"
        for c in fields
    )


_ONE = "one AS (SELECT *, 0 AS scope FROM items)"
SQL["D4_standardize"] = f"WITH {ITEMS}, {_ONE}, {scaled('one', 'scope', AUDIO)} {long_form(AUDIO, dict.fromkeys(AUDIO, 1.0))}"
SQL["D5_feature_weights"] = (
    f"WITH {ITEMS}, {_ONE}, {scaled('one', 'scope', AUDIO)} "
    + long_form(AUDIO, {"tempo": 0.5, "energy": 2.0, "loudness": 2.0})
)
SQL["D6_year_feature"] = (
    f"WITH {ITEMS}, {SUPPLY}, {MEMBERS}, {scaled('rows_', 'group_id', ('year',))} "
    + long_form(("year",), {"year": 0.3}, "group_id,")
)
SQL["D7_build_feature_matrix"] = (
    f"WITH {ITEMS}, {_ONE}, {scaled('one', 'scope', NUMERIC)} "
    + long_form(NUMERIC, {**dict.fromkeys(AUDIO, 1.0), "year": 0.3})
    + " UNION ALL SELECT spotify_id, 'genre:' || unnest(list_distinct(genres)), 1e0 FROM items"
)

ORDER_ITEMS = """
order_items AS (
  SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS spotify_id, o_orderstatus AS album,
         ['c' || o_custkey, 'status-' || o_orderstatus, 'prio-' || substr(o_orderpriority, 1, 1)] AS ids,
         ['Customer ' || o_custkey, 'Status ' || o_orderstatus, substr(o_orderpriority, 3, 20)] AS names
  FROM orders)
"""
_HIT = " OR ".join(f"contains(lower({c}), '{s}')" for s in ("status f", "c12") for c in ("p.id", "p.name"))
_ZIP = "list_transform(list_zip(ids, names), lambda p: {'id': p[1], 'name': p[2]})"
SQL["B1_filter_membership"] = f"""
WITH {ORDER_ITEMS}, kept AS (SELECT spotify_id, list_filter({_ZIP}, lambda p: {_HIT}) AS m FROM order_items)
SELECT spotify_id, array_to_string(list_transform(m, lambda p: p.id), '|') AS playlist_ids,
       array_to_string(list_transform(m, lambda p: p.name), '|') AS playlist_names
FROM kept WHERE len(m) > 0
"""
SQL["B2_filter_rows_any_membership"] = f"""
WITH {ORDER_ITEMS} SELECT spotify_id, len(list_filter({_ZIP}, lambda p: {_HIT})) > 0 AS selected FROM order_items
"""
SQL["B3_filter_groups"] = """
SELECT CAST(c_custkey AS VARCHAR) AS spotify_id, c_mktsegment || ' ' || c_name AS name FROM customer
WHERE contains(lower(c_mktsegment || ' ' || c_name), 'furni') OR contains(CAST(c_custkey AS VARCHAR), '77')
   OR contains(c_name, '77')
"""
SQL["B4_group_name_of"] = f"""
WITH {ORDER_ITEMS} SELECT spotify_id, coalesce(names[list_position(ids, 'status-F')], 'status-F') AS name_of_status FROM order_items
"""
SQL["B5_membership_pairs"] = f"""
WITH {ORDER_ITEMS}
SELECT spotify_id, array_to_string(list_transform(list_zip(ids, names), lambda p: p[1] || '=' || p[2]), '|') AS pairs FROM order_items
"""
SQL["B6_membership_integrity"] = f"""
WITH {ORDER_ITEMS} SELECT spotify_id, 3 AS n_ids, 2 AS n_names FROM order_items WHERE album = 'P'
"""

# Stored genre answers, already split into their parts.
GENRES = """
brands AS (SELECT DISTINCT p_brand, p_type, CAST(substr(p_brand, 7) AS INTEGER) AS n, lower(p_type) AS kind FROM part),
answers AS (
  SELECT 'getgenre:' || lower(p_brand) || ':' || kind AS key, n, p_type = 'LARGE' AS none,
         CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN [kind] ELSE [] END AS top,
         CASE WHEN n <= 15 THEN [kind, 'g' || n] ELSE [] END AS good,
         CASE WHEN n > 20 THEN ['u' || n] ELSE [] END AS unsure,
         CASE WHEN n BETWEEN 16 AND 18 THEN ['a' || n, 'b'] ELSE [] END AS by_artist,
         CASE WHEN n = 3 THEN 0e0 ELSE n * 1e0 END AS level, 5e0 AS artist_level
  FROM brands WHERE p_type <> 'SMALL'
  UNION ALL
  SELECT DISTINCT 'getgenre:' || lower(p_brand), n, false, [], ['solo ' || n], [], [], 50e0, 0e0 FROM brands WHERE n < 12),
full_answers AS (
  SELECT key, n, none, CASE WHEN none THEN [] ELSE top END AS top, CASE WHEN none THEN [] ELSE good END AS good,
         CASE WHEN none THEN [] ELSE unsure END AS unsure, CASE WHEN none THEN [] ELSE by_artist END AS by_artist,
         CASE WHEN none THEN 0e0 ELSE level END AS level, artist_level,
         CASE WHEN none THEN [] ELSE top END || list_filter(CASE WHEN none THEN [] ELSE good END, lambda g: NOT list_contains(top, g)) AS clean
  FROM answers),
picks AS (
  SELECT key, 'top' AS lvl, CASE WHEN len(top) > 0 THEN 'getgenre album top' ELSE 'unmatched' END AS source,
         CASE WHEN len(top) > 0 THEN level ELSE 0e0 END AS confidence, top AS genres FROM full_answers
  UNION ALL
  SELECT key, 'best',
         CASE WHEN len(top) > 0 THEN 'getgenre album top' WHEN len(good) > 0 THEN 'getgenre album validated'
              WHEN len(unsure) > 0 THEN 'getgenre album unvalidated' WHEN len(by_artist) > 0 THEN 'getgenre artist validated'
              ELSE 'unmatched' END,
         CASE WHEN len(top) + len(good) + len(unsure) > 0 THEN level WHEN len(by_artist) > 0 THEN artist_level ELSE 0e0 END,
         CASE WHEN len(top) > 0 THEN top WHEN len(good) > 0 THEN good WHEN len(unsure) > 0 THEN unsure ELSE by_artist END
  FROM full_answers
  UNION ALL
  SELECT key, 'clean',
         CASE WHEN len(clean) > 0 THEN 'getgenre album clean' WHEN len(by_artist) > 0 THEN 'getgenre artist clean' ELSE 'unmatched' END,
         CASE WHEN len(clean) > 0 THEN level WHEN len(by_artist) > 0 THEN artist_level ELSE 0e0 END,
         CASE WHEN len(clean) > 0 THEN clean ELSE by_artist END
  FROM full_answers
  UNION ALL
  SELECT key, 'all',
         CASE WHEN len(clean) + len(unsure) > 0 THEN 'getgenre album all' WHEN len(by_artist) > 0 THEN 'getgenre artist all' ELSE 'unmatched' END,
         CASE WHEN len(clean) + len(unsure) > 0 THEN level WHEN len(by_artist) > 0 THEN artist_level ELSE 0e0 END,
         CASE WHEN len(clean) + len(unsure) > 0 THEN clean || unsure ELSE by_artist END
  FROM full_answers)
"""
SQL["C3_extract_genres"] = f"""
WITH {GENRES} SELECT key, lvl AS level, source, confidence, array_to_string(genres, '|') AS genres FROM picks
"""
SQL["C4_union_genre_items"] = f"""
WITH {GENRES} SELECT key, array_to_string(clean, '|') AS genres, level FROM full_answers
"""
ENRICHED = f"""
{ITEMS}, {GENRES}, best AS (SELECT * FROM picks WHERE lvl = 'best' AND source <> 'unmatched'),
with_genres AS (
  SELECT spotify_id, coalesce(a.source, b.source, 'unmatched') AS genre_source,
         coalesce(a.genres, b.genres, []) AS genres, coalesce(a.confidence, b.confidence, 0e0) / 100e0 AS genre_match_confidence
  FROM items LEFT JOIN best a ON a.key = 'getgenre:' || lower(artist) || ':' || lower(album)
             LEFT JOIN best b ON a.key IS NULL AND b.key = 'getgenre:' || lower(artist)),
with_features AS (
  SELECT items.*, p_size, p_type <> 'LARGE' AND p_size NOT IN (1, 2) AS hit, p_retailprice AS price
  FROM items JOIN part ON pos = p_partkey)
"""
SQL["C2_enrich_genres"] = f"""
WITH {ENRICHED} SELECT spotify_id, array_to_string(genres, '|') AS genres, genre_source, genre_match_confidence FROM with_genres
"""
SQL["C1_enrich_features"] = f"""
WITH {ENRICHED}
SELECT spotify_id, CASE WHEN hit THEN 'reccobeats' ELSE 'unmatched' END AS feature_source,
       round(round(CASE WHEN hit THEN coalesce(nullif((price - 900e0) * 2e0, 0e0), tempo) END, 12), 6) + 0e0 AS tempo,
       round(round(CASE WHEN hit THEN p_size / 100e0 END, 12), 6) + 0e0 AS energy,
       round(round(CASE WHEN hit THEN loudness END, 12), 6) + 0e0 AS loudness, CAST(NULL AS DOUBLE) AS danceability,
       CASE WHEN NOT hit THEN 0e0 WHEN p_size > 40 THEN 0.5e0 ELSE 1e0 END AS feature_match_confidence
FROM with_features
"""
SQL["H1_enrichment_summary"] = f"""
WITH {ENRICHED}
SELECT (SELECT count(*) FROM with_features WHERE hit) AS with_features,
       (SELECT count(*) FROM with_genres WHERE genre_source LIKE 'getgenre%') AS with_genres, (SELECT count(*) FROM items) AS tracks
"""
SQL["C5_lookup_key"] = """
SELECT CAST(p_partkey AS VARCHAR) AS spotify_id,
       'getgenre:' || lower(p_brand) || CASE WHEN p_type = 'SMALL' THEN '' ELSE ':' || lower(p_type) END AS key FROM part
"""
SQL["C6_pending_lookups"] = """
SELECT DISTINCT 'getgenre:' || lower(p_brand) || ':' || lower(p_type) AS key FROM part
WHERE p_type IN ('SMALL', 'LARGE') OR CAST(substr(p_brand, 7) AS INTEGER) >= 20
"""
SQL["C7_upsert_lookup"] = """
SELECT event_type AS service, CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS payload, max(event_id) AS version
FROM events GROUP BY 1, 2
"""


SQL["C7_stored_upsert"] = SQL["C7_upsert_lookup"]


def libraries(files: str) -> str:
    """CTE `lib`: the lines of each return flag as one library, in file order, with occurrence numbers."""
    order = "".join(f" WHEN '{f}' THEN {i}" for i, f in enumerate(files))
    return f"""
lines AS (
  SELECT *, (l_orderkey << 15) + row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
  FROM lineitem),
lib AS (
  SELECT CAST(l_partkey AS VARCHAR) AS spotify_id, p_name AS title, CASE l_returnflag {order} END AS file, pos,
         row_number() OVER (PARTITION BY l_returnflag, l_partkey ORDER BY pos) AS occ,
         's' || l_suppkey AS gid, 'Supplier ' || l_suppkey || ' ' || l_returnflag AS gname,
         CASE WHEN l_linestatus = 'O' AND p_size > 10 THEN p_brand || '-' || p_size || '-' || p_type END AS isrc,
         CASE WHEN l_quantity > 25 THEN 1950 + NULLIF(p_size, 50) END AS year,
         CASE WHEN l_discount > 0.05 THEN CAST(l_quantity * 1000 AS BIGINT) END AS duration_ms,
         [lower(l_returnflag), p_type, 'q' || CAST(trunc(l_quantity / 10) AS INTEGER)] AS genres
  FROM lines JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ({", ".join(f"'{f}'" for f in files)}))
"""


def merged(files: str, main: int) -> str:
    """First `main` files are libraries, the others metadata only."""
    first = ", ".join(f"arg_min({c}, file) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("title", "isrc", "year", "duration_ms"))
    return f"""
WITH {libraries(files)},
heads AS (SELECT spotify_id, occ, min(file) FILTER (WHERE file < {main}) AS f, {first} FROM lib GROUP BY 1, 2),
placed AS (SELECT heads.*, row_number() OVER (ORDER BY f, lib.pos) AS pos FROM heads JOIN lib ON heads.f = lib.file
       AND heads.spotify_id = lib.spotify_id AND heads.occ = lib.occ),
names AS (SELECT spotify_id, occ, gid, min(file) AS file, arg_min(gname, file) AS gname FROM lib WHERE file < {main} GROUP BY 1, 2, 3),
groups_ AS (SELECT spotify_id, occ, string_agg(gid, '|' ORDER BY file) AS ids, string_agg(gname, '|' ORDER BY file) AS names FROM names GROUP BY 1, 2),
words AS (SELECT spotify_id, occ, file, unnest(genres) AS g, generate_subscripts(genres, 1) AS i FROM lib),
once AS (SELECT spotify_id, occ, g, min(file * 10 + i) AS seen FROM words GROUP BY 1, 2, 3),
genre AS (SELECT spotify_id, occ, string_agg(g, '|' ORDER BY seen) AS genres FROM once GROUP BY 1, 2)
SELECT pos, spotify_id, title, isrc, year, duration_ms, ids AS playlist_ids, names AS playlist_names, genres
FROM placed JOIN groups_ USING (spotify_id, occ) JOIN genre USING (spotify_id, occ)
"""


SQL["C8_merge_libraries"] = merged("ANR", 3)
SQL["C9_merge_metadata_only"] = merged("ANR", 1)
SQL["C10_merge_row"] = merged("RAN", 2)
SQL["C11_ordered_union"] = f"""
WITH {ITEMS} SELECT spotify_id, array_to_string(genres || list_filter([lower(album), artist], lambda g: NOT list_contains(genres, g)), '|') AS genres
FROM items
"""
SQL["C12_match_text"] = """
WITH asked AS (
  SELECT p_partkey AS query_id, string_split(lower(p_name), ' ') || CASE WHEN p_size < 5 THEN [lower(p_type)] ELSE [] END AS t,
         CASE WHEN p_size < 25 THEN [lower(p_brand)] ELSE [] END AS a,
         CASE WHEN p_size < 10 THEN ['promo'] WHEN p_size > 45 THEN ['nowhere'] ELSE [] END AS b FROM part),
held AS (
  SELECT min(p_partkey) AS pos, string_split(lower(p_name), ' ') AS t, [lower(p_brand)] AS a, [lower(p_type)] AS b
  FROM part GROUP BY p_name, p_brand, p_type),
kinds AS (SELECT DISTINCT t, a, b FROM asked),
strict AS (SELECT k.t, k.a, k.b, min(h.pos) AS pos FROM kinds k JOIN held h
           ON list_has_all(h.t, k.t) AND list_has_all(h.a, k.a) AND list_has_all(h.b, k.b) GROUP BY ALL),
loose AS (SELECT k.t, k.a, k.b, min(h.pos) AS pos FROM kinds k JOIN held h
          ON list_has_all(h.t || h.a || h.b, k.t || k.a) GROUP BY ALL)
SELECT query_id, CAST(coalesce(s.pos, l.pos) AS VARCHAR) AS spotify_id,
       CASE WHEN s.pos IS NOT NULL THEN 'fields' WHEN l.pos IS NOT NULL THEN 'words' END AS matched_by
FROM asked q LEFT JOIN strict s ON q.t = s.t AND q.a = s.a AND q.b = s.b LEFT JOIN loose l ON q.t = l.t AND q.a = l.a AND q.b = l.b
"""

SQL["A7_normalize_playlists"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS spotify_id, 'Order ' || o_orderkey AS name,
       CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS description, CAST(o_custkey AS INTEGER) AS track_count,
       'Customer ' || o_custkey AS owner, CAST(o_custkey AS VARCHAR) AS owner_id, o_orderstatus = 'O' AS is_collaborative,
       CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y%m%d') END AS snapshot_id
FROM orders
"""
PULLED = """
pulled AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_partkey AS VARCHAR) AS spotify_id, p_name AS title,
         CASE WHEN l_discount IN (0, 0.01) THEN 'Unknown' ELSE p_brand END AS artist, p_type AS album,
         CAST(l_orderkey AS VARCHAR) AS group_id, 'Order ' || l_orderkey AS group_name,
         CASE WHEN p_size > 10 THEN 'I' || p_size END AS isrc,
         CASE WHEN l_quantity <> 50 AND l_returnflag = 'A' THEN CAST(year(l_shipdate) AS INTEGER) END AS year,
         CAST(l_quantity * 1000 AS BIGINT) AS duration_ms, strftime(l_shipdate, '%Y-%m-%d') AS added_at
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_tax <> 0 AND NOT (l_linestatus = 'O' AND l_quantity = 1))
"""
SQL["A8_normalize_tracks"] = f"WITH {PULLED} SELECT 0 AS item_idx, * FROM pulled"
_FIRST = "row_number() OVER (PARTITION BY spotify_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
SQL["A9_collect_library"] = f"""
WITH {PULLED} SELECT spotify_id, l_orderkey, l_linenumber, title, artist, album, isrc, year, duration_ms, added_at
FROM pulled QUALIFY {_FIRST} = 1
"""
SQL["A9_collect_library_memberships"] = f"""
WITH {PULLED} SELECT spotify_id, {_FIRST} - 1 AS m_idx, group_id, group_name FROM pulled
"""
SQL["A9_library_lists"] = f"""
WITH {PULLED}, placed AS (SELECT *, {_FIRST} - 1 AS m FROM pulled)
SELECT spotify_id, string_agg(group_id, '|' ORDER BY m) AS playlist_ids, string_agg(group_name, '|' ORDER BY m) AS playlist_names
FROM placed GROUP BY 1
"""
SQL["A10_changed_groups"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS spotify_id, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y%m%d') END AS snapshot_id
FROM orders WHERE o_orderstatus = 'P' OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
"""
SQL["A10_changed_in_store"] = SQL["A10_changed_groups"]
CLUSTERED = "clustered AS (SELECT p_partkey, CAST(NULLIF(floor(NULLIF(p_size, 50) / 10e0) - 1, 3) AS INTEGER) AS cluster_id FROM part)"
SQL["A11_group_export"] = f"""
WITH {CLUSTERED},
placed AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n
           FROM clustered WHERE cluster_id IS NOT NULL AND cluster_id <> -1)
SELECT cluster_id, CAST(i // 100 AS BIGINT) AS batch, string_agg(CAST(p_partkey AS VARCHAR), '|' ORDER BY p_partkey) AS track_ids,
       'Auto-Cluster ' || cluster_id AS group_name, 'Generated from cluster ' || cluster_id || ' (' || n || ' tracks).' AS description,
       n AS track_count
FROM placed GROUP BY cluster_id, i // 100, n
"""
SQL["A12_batched_export"] = f"""
WITH {SUPPLY}, placed AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pos) - 1 AS i FROM supply)
SELECT group_id, CAST(i // 100 AS BIGINT) AS batch, string_agg(spotify_id, '|' ORDER BY pos) AS track_ids FROM placed GROUP BY 1, 2
"""
SQL["H2_cluster_summary"] = f"WITH {CLUSTERED} SELECT count(*) AS tracks, count(DISTINCT cluster_id) AS clusters FROM clustered"
SQL["G5_merge_groups"] = f"""
WITH {ITEMS}, firsts AS (SELECT * FROM items QUALIFY isrc IS NULL OR row_number() OVER (PARTITION BY isrc ORDER BY pos) = 1),
placed AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i FROM firsts)
SELECT 'Everything' AS group_name, CAST(i // 100 AS BIGINT) AS batch, string_agg(spotify_id, '|' ORDER BY pos) AS track_ids,
       'Merged from: all playlists.' AS description FROM placed GROUP BY i // 100
"""
SQL["A14_outlier_listing"] = f"""
WITH {ITEMS}, {SUPPLY}, {MEMBERS}, {scaled('rows_', 'group_id', NUMERIC)}, {distances('group_id')}
SELECT group_id, group_name AS heading, CAST(rank AS INTEGER) AS rank, printf('  %.3f  %s — %s', score, artist, title) AS line FROM (
  SELECT *, CASE WHEN n < 3 OR far - near < 1e-12 THEN 0e0 ELSE (d - near) / (far - near) END AS score,
         row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN n < 3 THEN 0e0 ELSE round(d, 9) END DESC, pos, m_idx) AS rank
  FROM scored) WHERE rank <= 3
"""
_ORDER_ROWS = """
SELECT {pos} CAST(o_orderkey AS VARCHAR) AS spotify_id, o_orderpriority AS title, 'Customer ' || o_custkey AS artist, o_orderstatus AS album,
       CAST(year(o_orderdate) AS INTEGER) AS year, CAST(trunc(o_totalprice) AS BIGINT) AS duration_ms,
       {energy} AS energy, {nulls},
       'c' || o_custkey || '|status-' || o_orderstatus || '|prio-' || substr(o_orderpriority, 1, 1) AS playlist_ids,
       'Customer ' || o_custkey || '|Status ' || o_orderstatus || '|' || substr(o_orderpriority, 3, 20) AS playlist_names, '' AS genres
FROM orders
"""
_THIRD = "round(round(CAST(trunc(o_totalprice) AS BIGINT) / 3e0, 12), 6) + 0e0"
_NULLS = {
    "VARCHAR": "isrc added_at genre_source feature_source",
    "DOUBLE": "genre_match_confidence tempo danceability valence acousticness instrumentalness liveness loudness speechiness feature_match_confidence outlier_score",
    "INTEGER": "cluster_id",
}
_NULLS = ", ".join(f"CAST(NULL AS {kind}) AS {name}" for kind, names in _NULLS.items() for name in names.split())
_PLACE = "row_number() OVER (ORDER BY o_orderkey) AS pos,"
SQL["A2_read_json"] = _ORDER_ROWS.format(pos=_PLACE, energy=_THIRD, nulls=_NULLS)
SQL["A3_read_delimited"] = _ORDER_ROWS.format(pos=_PLACE, energy=_THIRD, nulls=_NULLS)
SQL["A4_write_json"] = _ORDER_ROWS.format(pos="", energy="CAST(NULL AS DOUBLE)", nulls=_NULLS)
SQL["A5_write_delimited"] = r"""
SELECT CAST(o_orderkey AS VARCHAR) || chr(9) || o_orderpriority || chr(9) || 'Customer ' || o_custkey || chr(9) || o_orderstatus || chr(9)
       || 'c' || o_custkey || ';status-' || o_orderstatus || ';prio-' || substr(o_orderpriority, 1, 1) || chr(9)
       || 'Customer ' || o_custkey || ';Status ' || o_orderstatus || ';' || substr(o_orderpriority, 3, 20) || chr(9)
       || chr(9) || year(o_orderdate) || chr(9) || CAST(trunc(o_totalprice) AS BIGINT) || repeat(chr(9), 5)
       || printf('%.8f', CAST(trunc(o_totalprice) AS BIGINT) / 4e0) || repeat(chr(9), 12) AS line
FROM orders
"""
SQL["A6_convert"] = _ORDER_ROWS.format(pos=_PLACE, energy="CAST(NULL AS DOUBLE)", nulls=_NULLS)

# Blanks as Unicode defines them.
BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{BLANKS}', ' ', 'g'))"


def token_sorted(x: str) -> str:
    return f"array_to_string(list_sort(string_split({norm(x)}, ' ')), ' ')"


def similarity(a: str, b: str) -> str:
    """2 * LCS / (len a + len b) of two texts of at most 120 characters, LCS by bit masks."""
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = ch THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT"
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    state = f"list_reduce(string_split({b}, ''), lambda s, ch: ((s + (s & {mask})) | (s - (s & {mask}))) & {full}, {full})"
    return (
        f"CASE WHEN {a} = {b} THEN 1e0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0e0 "
        f"ELSE (1e0 - (length({a}) + length({b}) - 2 * (length({a}) - bit_count({state}))) / CAST(length({a}) + length({b}) AS DOUBLE)) * 100e0 / 100e0 END"
    )


SQL["G3_norm_text"] = f"SELECT doc_id, {norm('text')} AS text FROM documents"
SQL["G4_token_sort_similarity"] = f"""
WITH t AS (SELECT p_partkey, {token_sorted("p_name || ' ' || p_type")} AS a, {token_sorted("upper(p_type || '  ' || p_brand || '  ' || p_name)")} AS b,
                  {token_sorted('p_name')} AS c, {token_sorted('p_brand')} AS d FROM part),
k AS (SELECT DISTINCT a, b, c, d FROM t), s AS (SELECT *, {similarity('a', 'b')} AS x, {similarity('c', 'd')} AS y FROM k)
SELECT p_partkey, round(round(x, 12), 6) + 0e0 AS whole, round(round(y, 12), 6) + 0e0 AS name FROM t JOIN s USING (a, b, c, d)
"""
SQL["G1_same_code"] = f"""
WITH {ITEMS}, led AS (SELECT *, first_value(spotify_id) OVER (PARTITION BY isrc ORDER BY pos) AS leader FROM items WHERE isrc IS NOT NULL)
SELECT leader AS track_a_id, spotify_id AS track_b_id, 1e0 AS similarity FROM led WHERE leader <> spotify_id
"""
DUPLICATES = f"""
found AS (
  SELECT page_id AS pos, CAST(page_id AS VARCHAR) AS id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
         regexp_extract(url, '//([^/?#]*)', 1) AS artist, nullif(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '') AS isrc FROM pages),
keyed AS (SELECT *, {token_sorted('title')} AS tk, {token_sorted('artist')} AS ak FROM found),
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY tk, ak ORDER BY pos) = 1),
titles AS (SELECT DISTINCT tk FROM keyed), artists AS (SELECT DISTINCT ak FROM keyed),
title_pairs AS (SELECT * FROM (SELECT x.tk AS p, y.tk AS q, {similarity('x.tk', 'y.tk')} AS s FROM titles x JOIN titles y ON x.tk < y.tk)
                WHERE s > 0.85e0),
title_sims AS (SELECT * FROM title_pairs UNION ALL SELECT q, p, s FROM title_pairs UNION ALL SELECT tk, tk, 1e0 FROM titles),
artist_sims AS (SELECT x.ak AS p, y.ak AS q, {similarity('x.ak', 'y.ak')} AS s FROM artists x JOIN artists y ON true),
text_pairs AS (
  SELECT a.pos AS pa, b.pos AS pb, {rounded('(t.s * 0.7e0 + r.s * 0.3e0)')} AS similarity, 'text' AS match
  FROM firsts a JOIN title_sims t ON t.p = a.tk JOIN firsts b ON b.tk = t.q AND b.pos > a.pos JOIN artist_sims r ON r.p = a.ak AND r.q = b.ak
  WHERE t.s * 0.7e0 + r.s * 0.3e0 >= 0.9e0),
listed AS (
  SELECT * FROM text_pairs
  UNION ALL SELECT f.pos, k.pos, 1e0, 'copy' FROM keyed k JOIN firsts f USING (tk, ak) WHERE f.pos <> k.pos
  UNION ALL SELECT l, pos, 1e0, 'isrc' FROM (SELECT pos, min(pos) OVER (PARTITION BY isrc) AS l FROM keyed WHERE isrc IS NOT NULL) WHERE l <> pos),
pairs AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY pa, pb ORDER BY similarity DESC, array_position(['isrc', 'copy', 'text'], match)) = 1)
"""
SQL["G1_find_duplicate_rows"] = f"""
WITH {DUPLICATES}
SELECT a.id AS track_a_id, b.id AS track_b_id, a.title AS title_a, b.title AS title_b, a.artist AS artist_a, b.artist AS artist_b,
       similarity, match, pa AS pos_a, pb AS pos_b
FROM pairs JOIN found a ON a.pos = pa JOIN found b ON b.pos = pb
"""
_OVERLAPS = "(SELECT a, b FROM shared WHERE CAST(s AS DOUBLE) / (na + nb - s) >= {t}e0 UNION ALL SELECT leader, doc_id FROM sets WHERE doc_id <> leader)"
SQL["G6_dedupe_command"] = f"""
WITH {DUPLICATES}, {WORDS}
SELECT 'duplicate_tracks' AS section, CAST(pa AS VARCHAR) AS a, CAST(pb AS VARCHAR) AS b FROM pairs
UNION ALL SELECT 'playlist_overlaps', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM {_OVERLAPS.format(t='0.8')}
"""
SQL["A13_dedupe_report"] = f"""
WITH {ITEMS}, {WORDS}
SELECT (SELECT count(*) - count(DISTINCT isrc) FROM items WHERE isrc IS NOT NULL) AS duplicate_tracks,
       (SELECT count(*) FROM {_OVERLAPS.format(t='0.9')}) AS playlist_overlaps
"""

SQL["G5_first_wins_two_keys"] = """
WITH RECURSIVE numbered AS (
  SELECT l_orderkey * 10 + l_linenumber AS pos, min(CAST(l_partkey AS VARCHAR)) AS spotify_id,
         min(CASE WHEN l_returnflag <> 'A' THEN l_suppkey || '-' || CAST(l_quantity AS INTEGER) END) AS isrc FROM lineitem GROUP BY 1),
lines AS (SELECT min(pos) AS pos, spotify_id, isrc FROM numbered GROUP BY 2, 3),
rounds AS (
  SELECT pos, spotify_id, isrc, false AS kept FROM lines
  UNION ALL
  SELECT pos, spotify_id, isrc, keep FROM (
    SELECT *, bool_or(keep) OVER (PARTITION BY spotify_id) AS id_taken, isrc IS NOT NULL AND bool_or(keep) OVER (PARTITION BY isrc) AS isrc_taken FROM (
      SELECT *, pos = min(pos) OVER (PARTITION BY spotify_id) AND (isrc IS NULL OR pos = min(pos) OVER (PARTITION BY isrc)) AS keep FROM rounds WHERE NOT kept))
  WHERE keep OR NOT (id_taken OR isrc_taken))
SELECT pos, spotify_id, isrc FROM rounds WHERE kept
"""
SQL["E2_silhouette"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v, label FROM embeddings),
sums AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(array_distance(a.v, b.v)) AS total, count(*) AS n
         FROM e a JOIN e b ON true GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN c = own THEN n END) AS n, max(CASE WHEN c = own THEN total / nullif(n - 1, 0) END) AS a,
              min(CASE WHEN c <> own THEN total / n END) AS b FROM sums GROUP BY ALL)
SELECT 'label' AS labelling, round(round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END), 12), 6) + 0e0 AS silhouette
FROM ab
"""
SQL["E5_cluster_command"] = """
SELECT count(*) AS tracks, CAST(4 AS BIGINT) AS clusters FROM orders WHERE o_orderstatus = 'F'
"""

SQL["F3_outlier_command"] = f"""
WITH listed AS (
  SELECT o_orderkey AS pos, year(o_orderdate) AS year, trunc(o_totalprice) / 2000e0 AS tempo, o_orderpriority AS title,
         'Customer ' || o_custkey AS artist,
         unnest([{{'i': 1, 'id': 'status-' || o_orderstatus, 'name': 'Status ' || o_orderstatus}},
                 {{'i': 2, 'id': 'prio-' || substr(o_orderpriority, 1, 1), 'name': substr(o_orderpriority, 3, 20)}}]) AS m
  FROM orders),
rows_ AS (SELECT pos, year, tempo, title, artist, m.i AS m_idx, m.id AS group_id, m.name AS group_name FROM listed),
{scaled('rows_', 'group_id', ('tempo', 'year'))},
dist AS (SELECT *, sqrt(tempo_z * tempo_z + (year_z * 0.3e0) * (year_z * 0.3e0)) AS d FROM z),
scored AS (SELECT *, max(d) OVER (PARTITION BY group_id) AS far, min(d) OVER (PARTITION BY group_id) AS near,
           row_number() OVER (PARTITION BY group_id ORDER BY round(d, 9) DESC, pos, m_idx) AS rank FROM dist)
SELECT group_id, group_name AS heading, CAST(rank AS INTEGER) AS rank,
       printf('  %.3f  %s — %s', (d - near) / (far - near), artist, title) AS line
FROM scored WHERE rank <= 4
"""

SQL["pull_command"] = f"""
WITH {PULLED}, chosen AS (SELECT * FROM pulled WHERE CAST(l_orderkey AS VARCHAR) LIKE '1%' AND l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT spotify_id, {_FIRST} - 1 AS m_idx, group_id, group_name FROM chosen
"""
SQL["enrich_command"] = SQL["C1_enrich_features"]
SQL["merge_command"] = SQL["C8_merge_libraries"]
SQL["split_command"] = f"""
WITH {CLUSTERED} SELECT cluster_id, 'Auto-Cluster ' || cluster_id AS group_name,
       'Generated from cluster ' || cluster_id || ' (' || count(*) || ' tracks).' AS description, count(*) AS track_count
FROM clustered WHERE cluster_id IS NOT NULL AND cluster_id <> -1 GROUP BY cluster_id
"""
SQL["push_merge_command"] = """
WITH placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_orderstatus = 'F')
SELECT 'All F' AS group_name, CAST(i // 100 AS BIGINT) AS batch, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS track_ids,
       'Merged from: status f.' AS description FROM placed GROUP BY i // 100
"""
SQL["D7_feature_vectors"] = SQL["D7_build_feature_matrix"]
