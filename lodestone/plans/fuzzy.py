"""The fuzzy argmax join over all parts and all surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import fuzzy
from lodestone.plans.registry import query, r6, s6, table

#: A part's name as people write it: a letter lost, words turned round, the brand added, a word twice, letters swapped, or as it is.
_SPELT = """CASE p_partkey % 7 WHEN 0 THEN concat(left(s, k - 1), substring(s, k + 1)) WHEN 1 THEN concat(split_part(s, ' ', 3), ' ', split_part(s, ' ', 1), '  ', split_part(s, ' ', 2))
WHEN 2 THEN concat(s, ' ', p_brand) WHEN 3 THEN concat(split_part(s, ' ', 2), ' ', s) WHEN 4 THEN concat(left(s, k - 1), substring(s, k + 1, 1), substring(s, k, 1), substring(s, k + 2))
WHEN 5 THEN concat('the very ', s, ' of ', p_brand, ' by the same maker') ELSE upper(s) END"""
_PARTS = f"p AS (SELECT p_partkey, p_brand, s, cast(1 + p_partkey % length(s) AS INT) AS k FROM (SELECT *, concat(p_name, ' ', lower(p_type)) AS s FROM part) q), names AS (SELECT p_partkey, {_SPELT} AS name FROM p)"

_PLAIN = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
#: All names against all surfaces. The longest common subsequence goes by bits, one character of the second text a round.
_ALL = rf"""WITH RECURSIVE {_PARTS}, n AS (SELECT DISTINCT {_PLAIN.format("name")} AS name FROM names), f AS (SELECT DISTINCT {_PLAIN.format("concat(p_name, ' ', p_type)")} AS surface FROM part),
t AS (SELECT name, surface, string_split(surface, ' ') AS a, string_split(name, ' ') AS b, greatest(length(name), length(surface)) < 1.5 * least(length(name), length(surface)) AS near FROM n, f),
q AS (SELECT *, array_to_string(list_sort(a), ' ') AS ja, array_to_string(list_sort(b), ' ') AS jb, array_to_string(list_sort(list_distinct([w FOR w IN a IF list_contains(b, w)])), ' ') AS c, array_to_string(list_sort(list_distinct([w FOR w IN a IF NOT list_contains(b, w)])), ' ') AS u, array_to_string(list_sort(list_distinct([w FOR w IN b IF NOT list_contains(a, w)])), ' ') AS v FROM t WHERE near),
xy AS (SELECT surface AS x, name AS y FROM q UNION SELECT ja, jb FROM q UNION SELECT u, v FROM q),
bits AS (SELECT x, ch, sum(1::BIGINT << (i - 1))::BIGINT AS bits FROM (SELECT x, unnest(string_split(x, '')) AS ch, unnest(range(1, length(x) + 1)) AS i FROM (SELECT DISTINCT x FROM xy WHERE x <> '')) z GROUP BY 1, 2),
w AS (SELECT x, y, 1 AS j, (1::BIGINT << length(x)) - 1 AS h FROM xy UNION ALL SELECT x, y, j + 1, ((h + (h & m)) | (h - (h & m))) & ((1::BIGINT << length(x)) - 1) FROM (SELECT w.*, coalesce(bits, 0) AS m FROM w LEFT JOIN bits ON bits.x = w.x AND ch = substr(w.y, w.j, 1) WHERE w.j <= length(w.y)) s),
lcs AS (SELECT x, y, length(x) - bit_count(h) AS l FROM w WHERE j = length(y) + 1), ratio AS (SELECT x, y, 1 - (length(x) + length(y) - 2 * l)::DOUBLE / greatest(1, length(x) + length(y)) AS r, length(x) + length(y) - 2 * l AS d FROM lcs),
z AS (SELECT name, surface, greatest(r0.r, 0.95 * greatest(r1.r, CASE WHEN c <> '' AND (u = '' OR v = '') THEN 1 ELSE 1 - r2.d::DOUBLE / (CASE WHEN c = '' THEN 0 ELSE 2 * (length(c) + 1) END + length(u) + length(v)) END, CASE WHEN c = '' THEN 0 ELSE 1 - (1 + least(length(u), length(v)))::DOUBLE / (2 * length(c) + 1 + least(length(u), length(v))) END)) AS score
  FROM q JOIN ratio r0 ON r0.x = surface AND r0.y = name JOIN ratio r1 ON r1.x = ja AND r1.y = jb JOIN ratio r2 ON r2.x = u AND r2.y = v
  UNION ALL SELECT name, surface, 0.9 FROM t WHERE NOT near AND greatest(length(name), length(surface)) <= 8 * least(length(name), length(surface)) AND (contains(name, surface) OR contains(surface, name))),
best AS (SELECT name, surface, score FROM z WHERE score >= 0.9 - 1e-12 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, surface) = 1)
SELECT p_partkey, surface, {s6("score")} AS score FROM names LEFT JOIN best ON best.name = {_PLAIN.format("names.name")}"""


@query("j02_fuzzy_names", _ALL)
def j02(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    own = p.select("*", F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("s"))
    names = own.withColumn("k", F.expr("cast(1 + p_partkey % length(s) AS INT)")).select("p_partkey", F.expr(_SPELT).alias("name"))
    surfaces = p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("surface")).distinct()
    found = fuzzy.best_surfaces(names, "name", surfaces, "surface")
    return names.join(found.withColumnRenamed("name", "plain"), fuzzy.plain(F.col("name")) == F.col("plain"), "left").select("p_partkey", "surface", r6(F.col("score")).alias("score"))
