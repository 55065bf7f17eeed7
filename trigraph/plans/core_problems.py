"""Queries of the general data-processing operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigraph.operators.eager import Measure, chain_breaks, eager_join_aggregate
from trigraph.operators.nested import WHOLE_PEOPLE, flatten
from trigraph.operators.packed import unpack


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_breaks(read(spark, sf_dir, "kv_records"))


def _once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = read(spark, sf_dir, "kv_records").select(F.col("rec_key").alias("k"), "store_position", "value_link").distinct()
    edges = read(spark, sf_dir, "triples").select(F.col("s").alias("k"), "p", "o").distinct()
    return records, edges


def _bigints(df: DataFrame) -> DataFrame:
    """Decimals as bigint, which the test tables' sums fit."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


def p1_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of a key beside every triple of that vertex, aggregated per key without building the pairs."""
    records, edges = _once(spark, sf_dir)
    left = [Measure("first_position", "min", "store_position"), Measure("linked_pairs", "count", "value_link"), Measure("position_sum", "sum", "store_position")]
    return _bigints(eager_join_aggregate(records, edges, ["k"], left, [Measure("last_object", "max", "o")]))


def p1_kind_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rolled up to the kind of vertex (the key's text before the slash)."""
    records, edges = _once(spark, sf_dir)
    kind = {"kind": F.substring_index("k", "/", 1)}
    return _bigints(eager_join_aggregate(records, edges, ["k"], [Measure("last_position", "max", "store_position")], [Measure("objects", "count", "o")], "left", kind))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(read(spark, sf_dir, "books"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(read(spark, sf_dir, "people_raw")).person_phones()


def p5_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where persons are: a table with numbers beside texts, of the shape that holds all fields."""
    persons = flatten(read(spark, sf_dir, "people_raw"), shape=WHOLE_PEOPLE).persons
    return persons.select("raw_id", F.col("pk").alias("person_path"), "country", "lat", "lon")


def p5_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    colors = flatten(read(spark, sf_dir, "people_raw"), shape=WHOLE_PEOPLE).table("color")
    return colors.select("raw_id", F.col("parent").alias("person_path"), F.col("ordinal").alias("color_pos"), "color")


QUERIES = {"p1_found": p1_found, "p1_key_edges": p1_key_edges, "p1_kind_edges": p1_kind_edges, "p4_found": p4_found, "p5_found": p5_found, "p5_places": p5_places, "p5_colors": p5_colors}

_RECORDS = "r AS (SELECT DISTINCT rec_key AS k, store_position, value_link FROM kv_records), e AS (SELECT DISTINCT s AS k, p, o FROM triples)"

_PERSONS = r"""WITH RECURSIVE d AS (SELECT raw_id, max({'t': loaded_at, 'j': doc_json}).j AS j FROM people_raw WHERE raw_id IS NOT NULL AND doc_json IS NOT NULL GROUP BY raw_id),
p(raw_id, path, parent, j) AS (
  SELECT raw_id, '', '-', j::JSON FROM (SELECT raw_id, CASE WHEN json_valid(j) THEN j END AS j FROM d) WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT raw_id, CASE WHEN path = '' THEN '' ELSE path || '.' END || i::VARCHAR, path, f FROM (
    SELECT raw_id, path, unnest(range(len(fs))) AS i, unnest(fs) AS f FROM (
      SELECT raw_id, path, CASE json_type(j, '$.friends') WHEN 'ARRAY' THEN (j->'$.friends')::JSON[]
        WHEN 'OBJECT' THEN CASE WHEN len(json_keys(j, '$.friends')) > 0 THEN [j->'$.friends'] ELSE [] END
        WHEN 'VARCHAR' THEN CASE WHEN json_valid(j->>'$.friends') AND json_type(CASE WHEN json_valid(j->>'$.friends') THEN j->>'$.friends' END) = 'ARRAY' THEN (j->>'$.friends')::JSON[]
          WHEN trim(j->>'$.friends') = '' THEN [] ELSE [j->'$.friends'] END
        ELSE [] END AS fs FROM p WHERE json_type(j) = 'OBJECT'))
  WHERE json_type(f) IN ('OBJECT', 'VARCHAR'))"""

SQL = {
    "p1_found": """
WITH d AS (SELECT DISTINCT rec_key, store_position, value_link FROM kv_records WHERE rec_key IS NOT NULL AND store_position IS NOT NULL),
l AS (SELECT *, max(store_position) OVER (PARTITION BY rec_key ORDER BY store_position RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d)
SELECT DISTINCT rec_key, store_position FROM l WHERE value_link IS NOT NULL AND value_link <> -1 AND (prev IS NULL OR prev <> value_link)""",
    "p1_key_edges": f"""
WITH {_RECORDS}
SELECT k, count(*)::BIGINT AS pairs, min(store_position) AS first_position, count(value_link)::BIGINT AS linked_pairs,
       sum(store_position)::BIGINT AS position_sum, max(o) AS last_object
FROM r JOIN e USING (k) GROUP BY k""",
    "p1_kind_edges": f"""
WITH {_RECORDS}
SELECT split_part(k, '/', 1) AS kind, count(*)::BIGINT AS pairs, max(store_position) AS last_position, count(o)::BIGINT AS objects
FROM r LEFT JOIN e USING (k) WHERE k IS NOT NULL GROUP BY 1""",
    "p4_found": r"""
WITH t AS (SELECT DISTINCT book_id, authors FROM books WHERE book_id IS NOT NULL AND authors IS NOT NULL),
c AS (SELECT book_id, chr(2) || regexp_replace(authors, '([,;/|&\t\n\r]|\b[Aa][Nn][Dd]\b)', chr(2) || '\1' || chr(2), 'g') || chr(2) AS x FROM t),
m AS (SELECT book_id, string_split(regexp_replace(x, chr(2) || '\s*("(?:[^"]|"")*"|''(?:[^'']|'''')*''|“[^”]*”|«[^»]*»)\s*' || chr(2),
             chr(2) || chr(1) || '\1' || chr(1) || chr(2), 'g'), chr(1)) AS pieces FROM c),
v AS (SELECT book_id, list_filter(list_transform(flatten(list_transform(pieces, lambda p, i: CASE WHEN i % 2 = 0
        THEN [CASE WHEN p[1] IN ('"', '''') THEN replace(replace(p[2:-2], chr(2), ''), p[1] || p[1], p[1]) ELSE replace(p[2:-2], chr(2), '') END]
        ELSE string_split_regex(p, chr(2) || '(?:[,;/|&\t\n\r]|[Aa][Nn][Dd])' || chr(2) || '|' || chr(2)) END)),
        lambda n: trim(n, E' \t\n\r')), lambda n: n <> '') AS names FROM m)
SELECT DISTINCT book_id, unnest(range(1, len(names) + 1))::BIGINT AS pos, unnest(names) AS author FROM v WHERE len(names) > 1""",
    "p5_found": _PERSONS + r""",
x AS (SELECT raw_id, path, parent, json_type(j) = 'VARCHAR' AS bare, j,
  CASE json_type(j, '$.contact') WHEN 'ARRAY' THEN (j->'$.contact')::JSON[] WHEN 'OBJECT' THEN [j->'$.contact'] ELSE [] END AS cs,
  CASE WHEN json_type(j, '$.location') = 'ARRAY' THEN j->'$.location[0]' ELSE j->'$.location' END AS l FROM p),
y AS (SELECT *, list_filter(list_transform(flatten(list_transform(cs, lambda c: CASE json_type(c, '$.phone') WHEN 'ARRAY' THEN (c->'$.phone')::JSON[] ELSE [c->'$.phone'] END)),
  lambda v: CASE WHEN json_type(v) = 'NULL' THEN '' ELSE coalesce(v->>'$', '') END), lambda t: trim(t) <> '') AS ps FROM x),
z AS (SELECT *, CASE WHEN len(ps) > 0 THEN ps ELSE [''] END AS qs FROM y)
SELECT raw_id, path AS person_path, parent AS parent_path,
  CASE WHEN bare THEN '' WHEN json_type(j, '$._id') = 'OBJECT' THEN coalesce(json_extract_string(j, '$._id."' || json_keys(j, '$._id')[1] || '"'), '') ELSE coalesce(j->>'$._id', '') END AS id_text,
  CASE WHEN bare THEN j->>'$' ELSE coalesce(j->>'$.name', '') END AS person_name,
  CASE WHEN bare THEN '' WHEN json_type(l) = 'VARCHAR' THEN l->>'$' ELSE coalesce(l->>'$.city', '') END AS city,
  CASE WHEN len(ps) > 0 THEN unnest(range(len(qs))) ELSE -1 END::BIGINT AS phone_pos, unnest(qs) AS phone FROM z""",
    "p5_places": _PERSONS + r""",
x AS (SELECT raw_id, path, json_type(j) = 'VARCHAR' AS bare, CASE WHEN json_type(j, '$.location') = 'ARRAY' THEN j->'$.location[0]' ELSE j->'$.location' END AS l FROM p)
SELECT raw_id, path AS person_path, CASE WHEN bare THEN '' ELSE coalesce(l->>'$.country', '') END AS country,
  TRY_CAST(l->>'$.geo.lat' AS DOUBLE) AS lat, TRY_CAST(l->>'$.geo.lon' AS DOUBLE) AS lon FROM x""",
    "p5_colors": _PERSONS + r""",
x AS (SELECT raw_id, path, CASE json_type(j, '$.colors') WHEN 'ARRAY' THEN list_transform((j->'$.colors')::JSON[], lambda v: v->>'$') ELSE [j->>'$.colors'] END AS cs FROM p WHERE json_type(j) = 'OBJECT'),
y AS (SELECT raw_id, path, list_filter(cs, lambda c: trim(coalesce(c, '')) <> '') AS cs FROM x)
SELECT raw_id, path AS person_path, unnest(range(len(cs))) AS color_pos, unnest(cs) AS color FROM y""",
}
