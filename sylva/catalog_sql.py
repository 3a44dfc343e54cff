"""DuckDB SQL of the queries over the order forest."""

from __future__ import annotations

_EDGES = """
forest AS MATERIALIZED (
  SELECT tree_id, v::INT AS v, CASE WHEN v = 0 THEN -1 ELSE l_partkey % greatest(v, 1) END::INT AS parent
  FROM (SELECT l_orderkey AS tree_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS v FROM lineitem)),
tree AS MATERIALIZED (SELECT tree_id, count(*)::INT AS n, list(parent ORDER BY v) AS shape FROM forest GROUP BY 1),
shapes AS MATERIALIZED (SELECT shape, any_value(n) AS n, min(tree_id) AS id FROM tree GROUP BY 1),
arc AS MATERIALIZED (SELECT id, unnest(shape) AS parent, generate_subscripts(shape, 1)::INT - 1 AS v, n FROM shapes),
degree AS MATERIALIZED (
  SELECT f.tree_id, f.v, (count(c.v) + CASE WHEN f.v > 0 THEN 1 ELSE 0 END)::INT AS degree
  FROM forest f LEFT JOIN forest c ON c.tree_id = f.tree_id AND c.parent = f.v GROUP BY f.tree_id, f.v),
leaf AS MATERIALIZED (SELECT tree_id, count(*) AS n, CASE WHEN count(*) = 1 THEN 1 ELSE count(*) FILTER (degree = 1) END AS leaves FROM degree GROUP BY 1)
"""


def _fold(steps: int, k: str, p: str = "") -> str:
    """Polynomials poly(id, d, x) of all shapes by a chain of steps, the last vertex first; k: the number of colours, p: a
    prefix of the names."""
    out = [f"{p}s{steps} AS MATERIALIZED (SELECT id, v, c::INT AS c, c::INT AS d, 1::HUGEINT AS x FROM (SELECT id, v, unnest(range(0, {k})) AS c FROM arc))"]
    for v in range(steps - 1, 0, -1):
        s, own, toll = f"{p}s{v + 1}", f"{p}own{v}", f"{p}toll{v}"
        out.append(f"""{own} AS MATERIALIZED (SELECT s.id, a.parent AS v, s.c, s.d, s.x FROM {s} s JOIN arc a ON a.id = s.id AND a.v = s.v WHERE s.v = {v}),
{toll} AS MATERIALIZED (SELECT t.id, t.v, k.c, t.d, (t.x - coalesce(o.x, 0))::HUGEINT AS x FROM (SELECT id, v, d, sum(x)::HUGEINT AS x FROM {own} GROUP BY ALL) t
  JOIN (SELECT DISTINCT id, c FROM {own}) k USING (id) LEFT JOIN {own} o ON o.id = t.id AND o.c = k.c AND o.d = t.d WHERE t.x <> coalesce(o.x, 0)),
{p}s{v} AS MATERIALIZED (
  SELECT s.* FROM {s} s WHERE s.v < {v} AND NOT EXISTS (FROM {own} o WHERE o.id = s.id AND o.v = s.v)
  UNION ALL SELECT s.id, s.v, s.c, s.d + t.d, sum(s.x * t.x)::HUGEINT FROM {s} s JOIN {toll} t ON t.id = s.id AND t.v = s.v AND t.c = s.c GROUP BY s.id, s.v, s.c, s.d + t.d)""")
    out.append(f"{p}poly AS MATERIALIZED (SELECT id, d, sum(x)::HUGEINT AS x FROM {p}s1 GROUP BY 1, 2)")
    out.append(f"{p}span AS (SELECT id, unnest(range(0, max(d) + 1)) AS d FROM {p}poly WHERE x <> 0 GROUP BY id)")
    out.append(f"{p}dense AS MATERIALIZED (SELECT s.id, s.d, coalesce(y.x, 0)::HUGEINT AS x FROM {p}span s LEFT JOIN {p}poly y USING (id, d))")
    out.append(f"{p}texts AS MATERIALIZED (SELECT id, string_agg(x::VARCHAR, ',' ORDER BY d) AS polynomial FROM {p}dense GROUP BY 1)")
    out.append(f"{p}named AS MATERIALIZED (SELECT tree_id, tree.n, shapes.id, polynomial FROM tree JOIN shapes USING (shape) JOIN {p}texts USING (id))")
    return ",\n".join(out)


def _cheapest(steps: int) -> str:
    """Least colour sums low(id, m) of all shapes, with as many colours as vertices."""
    out = [f"c{steps} AS MATERIALIZED (SELECT id, v, c::INT AS c, c::BIGINT AS x FROM (SELECT id, v, unnest(range(0, greatest(n, 1))) AS c FROM arc))"]
    for v in range(steps - 1, 0, -1):
        out.append(f"""w{v} AS MATERIALIZED (SELECT o.id, a.parent AS v, k.c, min(o.x) AS x FROM c{v + 1} o JOIN arc a ON a.id = o.id AND a.v = o.v JOIN c{v + 1} k ON k.id = o.id AND k.v = a.parent AND k.c <> o.c WHERE o.v = {v} GROUP BY ALL),
c{v} AS MATERIALIZED (SELECT s.id, s.v, s.c, s.x + coalesce(w.x, 0) AS x FROM c{v + 1} s LEFT JOIN w{v} w ON w.id = s.id AND w.v = s.v AND w.c = s.c WHERE s.v < {v})""")
    out.append("low AS MATERIALIZED (SELECT tree_id, tree.n, m FROM tree JOIN shapes USING (shape) JOIN (SELECT id, min(x) AS m FROM c1 GROUP BY 1) USING (id))")
    return ",\n".join(out)


_DISTANCES = """
up AS (SELECT id, v, v AS a, 0 AS d FROM arc UNION ALL SELECT u.id, u.v, x.parent, u.d + 1 FROM up u JOIN arc x ON x.id = u.id AND x.v = u.a WHERE x.parent >= 0),
dist AS MATERIALIZED (SELECT a.id, a.v, b.v AS w, min(a.d + b.d) AS d FROM up a JOIN up b ON a.id = b.id AND a.a = b.a GROUP BY 1, 2, 3),
ecc AS (SELECT id, v, max(d) AS e FROM dist GROUP BY 1, 2)
"""


_LABELS = """
slot AS (SELECT id, n, u, v, row_number() OVER (PARTITION BY id ORDER BY v, u) - 1 AS k FROM (SELECT id, n, v, unnest(range(0, v)) AS u FROM arc)),
bits AS (SELECT s.id, s.n, s.k, CASE WHEN a.parent = s.u THEN 1 ELSE 0 END AS b FROM slot s JOIN arc a ON a.id = s.id AND a.v = s.v),
six AS (SELECT id, k // 6 AS g, sum(b << (5 - k % 6))::INT AS x FROM bits GROUP BY 1, 2),
tail AS (SELECT id, string_agg(chr(63 + x), '' ORDER BY g) AS t FROM six GROUP BY 1),
label AS MATERIALIZED (SELECT id, n, chr(n + 63) || coalesce(t, '') AS graph6 FROM shapes LEFT JOIN tail USING (id))
"""
#: Free trees of 1, 2, ... vertices.
_FREE_TREES = [1, 1, 1, 2, 3, 6, 11, 23, 47, 106, 235, 551, 1301, 3159, 7741, 19320]


def _stacked(k: int, points) -> str:
    """The values of the polynomials of stacked orders at points (x, p): the fold over vertices with a number for each colour."""
    folds, values = [], []
    for i, (x, p) in enumerate(points):
        start = [pow(x, c, p) for c in range(k)]
        folds.append(f"""f{i} AS (
  SELECT c, up, n::INT AS v, list_transform(up, lambda u: {start}::BIGINT[]) AS st FROM stack
  UNION ALL
  SELECT c, up, v - 1, list_transform(st[1:v - 1], lambda s, j: CASE WHEN j = up[v] + 1 THEN list_transform(s, lambda y, d: y * (list_sum(st[v])::BIGINT % {p} + {p} - st[v][d]) % {p}) ELSE s END)
  FROM f{i} WHERE v > 1)""")
        values.append(f"JOIN (SELECT c, list_sum(st[1])::BIGINT % {p} AS value_{i} FROM f{i} WHERE v = 1) USING (c)")
    return f"""WITH RECURSIVE {_EDGES},
o AS (SELECT o_custkey AS c, o_orderkey AS id, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - n AS off FROM orders JOIN tree ON tree_id = o_orderkey),
e AS (SELECT c, off + v AS v, CASE WHEN v > 0 THEN off + parent WHEN off = 0 THEN -1 ELSE id % greatest(off, 1) END AS up FROM o JOIN forest ON tree_id = id),
stack AS MATERIALIZED (SELECT c, list(up::INT ORDER BY v) AS up, count(*) AS n FROM e GROUP BY c),
{", ".join(folds)}
SELECT c AS tree_id, n::BIGINT AS n, {", ".join(f"value_{i}" for i in range(len(points)))} FROM stack {" ".join(values)}"""


def oracles(steps: int, few: int, stack_colours: int, points) -> dict[str, str]:
    edges, recursive = f"WITH {_EDGES}", f"WITH RECURSIVE {_EDGES}"
    full, some, low = f"{edges},\n{_fold(steps, 'n')}\n", f"{edges},\n{_fold(steps, str(few))}\n", f"{edges},\n{_cheapest(steps)}\n"
    sha = "SELECT n::BIGINT AS n, sha256(polynomial) AS digest, tree_id FROM named"
    both = f"{low}, pair AS MATERIALIZED (SELECT low.tree_id, low.n, 'l=' || leaves || '|m=' || m AS lm, 'l=' || leaves AS l, 'm=' || m AS m, 'all' AS a FROM low JOIN leaf USING (tree_id))\n"
    count = lambda c: f"{both} SELECT n::BIGINT AS n, {c} AS bucket, count(*) AS count FROM pair GROUP BY 1, 2"
    # trees of one class have one polynomial in as many colours as vertices, and up to 14 vertices no other class has it
    classes = f"""{full},
{_fold(steps, str(few), "f")},
cls AS MATERIALIZED (SELECT a.n, a.polynomial AS full_text, b.polynomial AS few_text, min(a.tree_id) AS i FROM named a JOIN fnamed b USING (tree_id) GROUP BY 1, 2, 3),
rep AS (SELECT n, few_text, min(i) AS tree_index_a FROM cls GROUP BY 1, 2 HAVING count(*) > 1)
"""
    pairs = f"{classes} SELECT n::BIGINT AS n, tree_index_a, i AS tree_index_b FROM cls JOIN rep USING (n, few_text) WHERE i <> tree_index_a"
    side = lambda x: f"""
side_{x} AS (SELECT tree_id AS tree_index_{x}, graph6 AS graph6_{x}, '[' || string_agg(degree::VARCHAR, ',' ORDER BY degree DESC) || ']' AS degree_sequence_{x}, any_value(leaves) AS leaf_count_{x}, any_value(m) AS min_color_sum_{x}
  FROM degree JOIN leaf USING (tree_id) JOIN low USING (tree_id) JOIN tree USING (tree_id) JOIN shapes USING (shape) JOIN label USING (id) GROUP BY 1, 2)"""  # noqa: E731
    quoted = lambda c: f"""'"' || replace({c}, '{chr(92)}', '{chr(92) * 2}') || '"'"""
    fields = [("n", "n"), ("bucket", """'"all"'"""), ("tree_index_a", "tree_index_a"), ("tree_index_b", "tree_index_b"), ("graph6_a", quoted("graph6_a")), ("graph6_b", quoted("graph6_b"))]
    fields += [(f"{c}_{x}", f"{c}_{x}") for c in ("degree_sequence", "leaf_count", "min_color_sum") for x in "ab"] + [("coefficients", "'[' || few_text || ']'")]
    report = " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields)
    sizes = f"""{full}, free AS (SELECT unnest(range(1, {len(_FREE_TREES) + 1})) AS n, unnest({_FREE_TREES}) AS trees),
met AS (SELECT n, count(DISTINCT polynomial) AS classes, count(*) AS orders FROM named GROUP BY 1)
SELECT free.n::BIGINT AS n, trees::BIGINT AS trees, coalesce(classes, 0)::BIGINT AS classes, coalesce(orders, 0)::BIGINT AS orders FROM free LEFT JOIN met USING (n) WHERE free.n BETWEEN 2 AND (SELECT max(n) FROM tree)"""
    return {
        "order_forest_edges": f"{edges} SELECT * FROM forest",
        "vertex_degree": f"{edges} SELECT * FROM degree",
        "tree_attributes": f"""{edges} SELECT tree_id, count(*) AS n, count(*) - 1 AS m, any_value(leaves)::BIGINT AS leaves, max(degree)::BIGINT AS max_degree,
            string_agg(degree::VARCHAR, ',' ORDER BY degree DESC) AS degree_sequence, '(' || string_agg(degree::VARCHAR, ', ' ORDER BY degree DESC) || ')' AS degree_tuple FROM degree JOIN leaf USING (tree_id) GROUP BY tree_id""",
        "min_color_sum": f"{low} SELECT tree_id, m AS min_color_sum FROM low",
        "diameter_radius": f"{recursive}, {_DISTANCES} SELECT tree_id, diameter, radius FROM tree JOIN shapes USING (shape) JOIN (SELECT id, max(e)::BIGINT AS diameter, min(e)::BIGINT AS radius FROM ecc GROUP BY 1) USING (id)",
        "recursive_measures": f"""{recursive}, {_DISTANCES}, depth AS (SELECT id, v, max(d) AS depth FROM up GROUP BY 1, 2), mid AS (SELECT id, min(e) AS r FROM ecc GROUP BY 1)
SELECT tree_id, v::BIGINT AS v, nullif(parent, -1)::BIGINT AS parent, depth::BIGINT AS depth, e::BIGINT AS eccentricity, e = r AS is_centre
FROM tree JOIN shapes USING (shape) JOIN arc USING (id) JOIN depth USING (id, v) JOIN ecc USING (id, v) JOIN mid USING (id) WHERE tree.n > 1""",
        "graph6_text": f"{edges}, {_LABELS} SELECT tree_id, graph6 FROM tree JOIN shapes USING (shape) JOIN label USING (id)",
        "graph6_round_trip": f"{edges} SELECT tree_id, n::BIGINT AS n, n::BIGINT - 1 AS m, true AS same FROM tree",
        "tree_classes": f"{full} SELECT n::BIGINT AS n, count(DISTINCT polynomial) AS classes, count(*)::BIGINT AS trees FROM named GROUP BY 1",
        "relational_classes": f"{full} SELECT n::BIGINT AS n, count(DISTINCT polynomial) AS classes, count(*)::BIGINT AS trees FROM named WHERE n > 1 GROUP BY 1",
        "bucket_counts_leaves_minsum": count("lm"),
        "bucket_counts_leaves": count("l"),
        "bucket_counts_known": count("m"),
        "bucket_counts_none": count("a"),
        "bucket_summary": f"{both} SELECT n::BIGINT AS n, sum(k)::BIGINT AS trees, count(*) AS buckets, count(*) FILTER (k = 1) AS singletons, count(*) FILTER (k >= 2) AS multiple FROM (SELECT n, lm, count(*) AS k FROM pair GROUP BY 1, 2) GROUP BY 1",
        "nonsingleton_semi_join": f"{both} SELECT tree_id, lm AS bucket FROM pair QUALIFY count(*) OVER (PARTITION BY n, lm) >= 2",
        "bucket_cache": f"{both} SELECT l AS bucket, count(*) AS count FROM pair GROUP BY 1",
        "polynomials": f"{full} SELECT tree_id, polynomial FROM named",
        "polynomials_few_colours": f"{some} SELECT tree_id, polynomial FROM named",
        "polynomial_terms": f"{full} SELECT tree_id, terms FROM named JOIN (SELECT id, string_agg(x::VARCHAR || 'q^' || d, ' + ' ORDER BY d) AS terms FROM poly WHERE x <> 0 GROUP BY 1) USING (id)",
        "poly_coeffs_long": f"{full} SELECT tree_id, d::BIGINT AS degree, x::BIGINT AS coefficient FROM named JOIN poly USING (id) WHERE x <> 0",
        "coefficient_checks": f"{full} SELECT tree_id, coefficient_sum, min_exponent, length, sum_of_squares FROM named JOIN (SELECT id, sum(x)::BIGINT AS coefficient_sum, min(d) FILTER (x <> 0)::BIGINT AS min_exponent, count(*) AS length, (sum((x * x)::HUGEINT)::HUGEINT)::VARCHAR AS sum_of_squares FROM dense GROUP BY 1) USING (id)",
        "stacked_polynomials": _stacked(stack_colours, points),
        "digest_groups": f"{full} SELECT n, digest, count(*) AS trees, min(tree_id) AS first_tree FROM ({sha}) GROUP BY 1, 2",
        "collision_pairs": pairs,
        "pairs_by_values": pairs,
        "pairs_by_table_function": pairs,
        "collision_all_pairs": f"{classes} SELECT a.n::BIGINT AS n, a.i AS tree_index_a, b.i AS tree_index_b FROM cls a JOIN cls b USING (n, few_text) WHERE a.i < b.i",
        "limit_first_match": f"SELECT * FROM ({pairs}) ORDER BY tree_index_b, tree_index_a LIMIT 1",
        "keep_first_seen": f"{full} SELECT n, digest, min(tree_id) AS tree_id FROM ({sha}) GROUP BY 1, 2",
        "stream_first_seen": f"{full} SELECT n, digest, min(tree_id) AS tree_id FROM ({sha}) GROUP BY 1, 2",
        "stream_pairs": f"{full}, d AS ({sha}) SELECT n, digest, f AS tree_id_a, tree_id AS tree_id_b FROM (SELECT *, min(tree_id) OVER (PARTITION BY n, digest) AS f FROM d) WHERE tree_id <> f",
        "polynomial_arithmetic": f"""{edges},
{_fold(steps, '2')},
size AS (SELECT id, max(d) AS top FROM dense GROUP BY 1),
one AS (SELECT unnest([0, 1, 2]) AS e),
terms AS (SELECT id, d, x, 0 AS y FROM dense UNION ALL SELECT id, e, 0, 1 FROM size, one),
summed AS (SELECT id, d, sum(x + y)::HUGEINT AS x FROM terms GROUP BY 1, 2),
added AS (SELECT id, string_agg(x::VARCHAR, ',' ORDER BY d) AS added FROM summed GROUP BY 1),
prod AS (SELECT id, d + e AS d, sum(x)::HUGEINT AS x FROM dense, one GROUP BY 1, 2),
multiplied AS (SELECT id, string_agg(x::VARCHAR, ',' ORDER BY d) AS multiplied FROM prod GROUP BY 1)
SELECT tree_id, added, multiplied FROM tree JOIN shapes USING (shape) JOIN added USING (id) JOIN multiplied USING (id)""",
        "dataset_round_trip": f"{full}, {_LABELS} SELECT graph6, polynomial FROM label JOIN texts USING (id)",
        "dataset_decode": f"""{full}, {_LABELS}, total AS (SELECT id, sum(x)::BIGINT AS coefficient_sum FROM dense GROUP BY 1), leaves AS (SELECT id, leaves FROM tree JOIN shapes USING (shape) JOIN leaf ON leaf.tree_id = shapes.id WHERE tree.tree_id = shapes.id)
SELECT graph6, n::BIGINT AS n, n::BIGINT - 1 AS m, leaves::BIGINT AS leaves, coefficient_sum FROM label JOIN total USING (id) JOIN leaves USING (id)""",
        "collision_reports": f"""{classes},
{_cheapest(steps)}, {_LABELS}, {side("a")}, {side("b")},
pair AS (SELECT n, tree_index_a, i AS tree_index_b, few_text FROM cls JOIN rep USING (n, few_text) WHERE i <> tree_index_a)
SELECT tree_index_a, tree_index_b, '{{' || {report} || '}}' AS report FROM pair JOIN side_a USING (tree_index_a) JOIN side_b USING (tree_index_b)""",
        "enumeration_sizes": sizes,
        "tree_source_sizes": sizes,
        "shard_union_merge": f"{full} SELECT n, digest, min(tree_id) AS tree_id, count(DISTINCT tree_id % 4) AS shards FROM ({sha}) GROUP BY 1, 2",
        "resume_anti_join": f"{full} SELECT n, digest, min(tree_id) AS tree_id FROM ({sha}) GROUP BY 1, 2 HAVING min(tree_id) > (SELECT max(tree_id) // 2 FROM tree)",
        "meta_upsert": "SELECT user_id || '/' || event_type AS key, max(event_id) AS version, max(event_id)::VARCHAR AS value FROM events GROUP BY 1",
        "pair_equal": f"{full}, p AS (SELECT tree_id AS a, polynomial, lead(tree_id) OVER w AS b, lead(polynomial) OVER w AS q FROM named WINDOW w AS (PARTITION BY n, tree_id // 1024 ORDER BY tree_id)) SELECT a, b, polynomial = q AS equal, CASE WHEN polynomial = q THEN 'The special functions are equal.' ELSE 'The special functions are different.' END AS verdict FROM p WHERE b IS NOT NULL",
        "variance_groups": f"{some} SELECT n::BIGINT AS n, length, numerator, count(*) AS trees, min(tree_id) AS first_tree FROM named JOIN (SELECT id, count(*) AS length, (count(*) * sum(x * x) - sum(x) * sum(x))::HUGEINT::VARCHAR AS numerator FROM dense GROUP BY 1) USING (id) GROUP BY 1, 2, 3",
        "coefficient_moments": f"{some} SELECT tree_id, mean, variance FROM named JOIN (SELECT id, sum(x)::DOUBLE / count(*) AS mean, (count(*) * sum(x * x) - sum(x) * sum(x))::HUGEINT::DOUBLE / (count(*) * count(*)) AS variance FROM dense GROUP BY 1) USING (id)",
        "text_formats": """SELECT o_orderkey, CASE WHEN s >= 86400 THEN printf('%dd %02dh %02dm', s // 86400, s % 86400 // 3600, s % 3600 // 60)
            WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%dm %02ds', s // 60, s % 60) END AS duration, format('{:,}', s) AS count_text
            FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)""",
    }
