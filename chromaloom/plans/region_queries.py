"""Dithering, paint selection, regions and drawings over the images made from the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import dither, grid, regions, shapes
from ..operators.iterate import checkpoint
from .inputs import CELLS, CHIPS, PALETTE, PIXELS, grids, oklab_sql, palette, pixels, table
from .palette_queries import SNAPPED, cells, snapped
from .registry import query


_NOISE = f"('0x' || substr('{dither.blue_noise_tile().hex()}', ((y % 256 * 256 + x % 256) * 2 + 1)::INT, 2))::INT"


_OKC = oklab_sql("r", "g", "b")


def _pam_sql(k: int) -> str:
    """k-medoids as a walk: the best candidate joins while there are fewer than k, then the best exchange is made while it
    lowers the cost. A step's row has the medoids so far and their cost."""
    left = "list_transform(CASE WHEN len(f.chosen) < {k} THEN f.chosen ELSE list_filter(f.chosen, lambda x, i: i <> slot) END, lambda m: p.dl[m + 1])".format(k=k)
    return f"""WITH RECURSIVE {CELLS}, {PALETTE}, h AS (SELECT image_id, r, g, b, count(*) AS w, {_OKC[0]} AS l, {_OKC[1]} AS a, {_OKC[2]} AS bb FROM cells GROUP BY image_id, r, g, b),
pts AS (SELECT h.image_id, h.w, list(pow(h.l - p.ok_l, 2) + pow(h.a - p.ok_a, 2) + pow(h.bb - p.ok_b, 2) ORDER BY p.chip_idx) AS dl FROM h, palette p GROUP BY h.image_id, h.r, h.g, h.b, h.w),
pam AS (SELECT DISTINCT image_id, 0 AS step, []::BIGINT[] AS chosen, 'Infinity'::DOUBLE AS cost FROM pts
  UNION ALL SELECT image_id, step + 1, CASE WHEN len(chosen) < {k} THEN list_append(chosen, c) ELSE list_transform(chosen, lambda x, i: CASE WHEN i = slot THEN c ELSE x END) END, new FROM (
    SELECT f.image_id, f.step, f.chosen, f.cost, slot, c, sum(p.w * least(coalesce(list_min({left}), 'Infinity'::DOUBLE), p.dl[c + 1])) AS new
    FROM pam f JOIN pts p ON p.image_id = f.image_id, range(1, {k} + 1) s(slot), range({CHIPS}) t(c) WHERE (len(f.chosen) = {k} OR slot = 1) AND NOT list_contains(f.chosen, c) GROUP BY f.image_id, f.step, f.chosen, f.cost, slot, c
    QUALIFY row_number() OVER (PARTITION BY f.image_id ORDER BY new, slot, c) = 1) WHERE len(chosen) < {k} OR new < cost - 1e-12)
SELECT image_id, unnest(chosen)::INT AS chip_idx FROM pam QUALIFY step = max(step) OVER (PARTITION BY image_id)"""


@query(_pam_sql(6))
def d2_restrict_pam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.restrict_pam(cells(spark, sf_dir), palette(spark, sf_dir), 6)


@query(f"WITH {SNAPPED} SELECT image_id, cx, cy, chip_idx FROM snapped")
def d3_map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.map_cells(cells(spark, sf_dir), palette(spark, sf_dir), "none")


def _ky_sql(n: int) -> str:
    """Knoll-Yliluoma as n steps, each the nearest chip to what the running mean still lacks."""
    steps = ["k0 AS (SELECT r, g, b, l, a, bb, 0.0::DOUBLE AS sl, 0.0::DOUBLE AS sa, 0.0::DOUBLE AS sb, [] AS picks FROM colors)"]
    for i in range(1, n + 1):
        d = " + ".join(f"pow(p.{ok} - (k.{t} * {i} - k.{s}), 2)" for ok, t, s in (("ok_l", "l", "sl"), ("ok_a", "a", "sa"), ("ok_b", "bb", "sb")))
        steps.append(
            f"k{i} AS (SELECT k.r, k.g, k.b, l, a, bb, sl + p.ok_l AS sl, sa + p.ok_a AS sa, sb + p.ok_b AS sb, list_append(picks, {{'l': p.ok_l, 'i': {i}, 'c': chip_idx}}) AS picks"
            f" FROM k{i - 1} k, palette p QUALIFY row_number() OVER (PARTITION BY k.r, k.g, k.b ORDER BY {d}, chip_idx) = 1)"
        )
    t = _NOISE.replace("y % 256", "cy % 256").replace("x % 256", "cx % 256")
    return f"WITH {SNAPPED}, {', '.join(steps)} SELECT image_id, cx, cy, list_sort(picks)[({t}) * {n} // 256 + 1].c AS chip_idx FROM cells JOIN k{n} USING (r, g, b)".replace("[] AS picks", "[]::STRUCT(l DOUBLE, i INTEGER, c INTEGER)[] AS picks")


@query(_ky_sql(8))
def d4_dither_ky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.map_cells(cells(spark, sf_dir), palette(spark, sf_dir), "knoll_yliluoma", 0.75)


def _spread(work: str, e: str) -> str:
    """What is still to be done after cell k's error e has gone right, below left, below and below right."""
    return f"list_transform({work}, lambda v, i: CASE WHEN i = k + 2 AND k % w < w - 1 THEN v + 7 * {e} WHEN i = k + w AND k % w > 0 THEN v + 3 * {e} WHEN i = k + w + 1 THEN v + 5 * {e} WHEN i = k + w + 2 AND k % w < w - 1 THEN v + 1 * {e} ELSE v END)"


@query(f"""WITH RECURSIVE {CELLS}, {PALETTE}, t AS (SELECT image_id, cx, cy, cells_x, {_OKC[0]} AS l, {_OKC[1]} AS a, {_OKC[2]} AS bb FROM cells JOIN grids USING (image_id)),
fs AS (SELECT image_id, any_value(cells_x)::BIGINT AS w, count(*) AS n, 0::BIGINT AS k, list(l ORDER BY cy, cx) AS wl, list(a ORDER BY cy, cx) AS wa, list(bb ORDER BY cy, cx) AS wb, NULL::INT AS chip FROM t GROUP BY image_id
  UNION ALL SELECT image_id, w, n, k + 1, {_spread('wl', 'el')}, {_spread('wa', 'ea')}, {_spread('wb', 'eb')}, chip FROM (
    SELECT f.image_id, f.w, f.n, f.k, f.wl, f.wa, f.wb, p.chip_idx AS chip, (f.wl[f.k + 1] - p.ok_l) / 16.0::DOUBLE AS el, (f.wa[f.k + 1] - p.ok_a) / 16.0::DOUBLE AS ea, (f.wb[f.k + 1] - p.ok_b) / 16.0::DOUBLE AS eb FROM fs f,
      LATERAL (SELECT q.chip_idx, q.ok_l, q.ok_a, q.ok_b FROM palette q ORDER BY pow(q.ok_l - f.wl[f.k + 1], 2) + pow(q.ok_a - f.wa[f.k + 1], 2) + pow(q.ok_b - f.wb[f.k + 1], 2), q.chip_idx LIMIT 1) p WHERE f.k < f.n))
SELECT image_id, ((k - 1) % w)::INT AS cx, ((k - 1) // w)::INT AS cy, chip AS chip_idx FROM fs WHERE k > 0""")
def d5_dither_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.map_cells(cells(spark, sf_dir), palette(spark, sf_dir), "floyd_steinberg")


#: Grids of four paints, as the pixels' own.
PAINTED = f"{PIXELS}, painted AS (SELECT image_id, x, y, ((r + g) % 4)::INT AS chip_idx FROM pixels)"


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("image_id", "x", "y", ((F.col("r") + F.col("g")) % 4).cast("int").alias("chip_idx"))




@query(f"""WITH {PIXELS}, painted AS (SELECT image_id, x, y, CASE WHEN (r + g) % 16 < 13 THEN 0 ELSE ((r + g) % 16)::INT END AS c FROM pixels),
off1 AS (SELECT dx, dy FROM range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx <> 0 OR dy <> 0), off2 AS (SELECT dx, dy, (dy + 2) * 5 + dx + 2 AS at_ FROM range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx <> 0 OR dy <> 0),
same AS (SELECT p.image_id, p.x, p.y, p.c, sum((q.c = p.c)::INT) AS n FROM painted p, off1 JOIN painted q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY ALL),
gives AS (SELECT * FROM same WHERE ({_NOISE}) / 255.0::DOUBLE < 0.9::DOUBLE * pow(n / 8.0::DOUBLE, 3)),
votes AS (SELECT p.image_id, p.x, p.y, q.c, count(*) AS n, min(at_) AS at_ FROM gives p, off2 JOIN painted q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy WHERE q.c <> p.c GROUP BY ALL),
won AS (SELECT image_id, x, y, c FROM votes QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY n DESC, at_) = 1)
SELECT p.image_id, p.x AS cx, p.y AS cy, coalesce(w.c, p.c) AS chip_idx FROM painted p LEFT JOIN won w ON w.image_id = p.image_id AND w.x = p.x AND w.y = p.y""")
def d6_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("r") + F.col("g")) % 16
    own = pixels(spark, sf_dir).select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.when(k < 13, 0).otherwise(k).cast("int").alias("chip_idx"))
    return dither.texture(own, 0.9)


@query(f"""WITH {PIXELS}, {PALETTE}, colors AS (SELECT r, g, b, {_OKC[0]} AS l, {_OKC[1]} AS a, {_OKC[2]} AS bb FROM (SELECT DISTINCT r, g, b FROM pixels)),
near AS (SELECT c.r, c.g, c.b, chip_idx FROM colors c, palette QUALIFY row_number() OVER (PARTITION BY c.r, c.g, c.b ORDER BY round(pow(l - ok_l, 2) + pow(a - ok_a, 2) + pow(bb - ok_b, 2), 12), chip_idx) = 1)
SELECT image_id, chip_idx FROM pixels JOIN near USING (r, g, b) GROUP BY image_id, chip_idx QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, chip_idx) <= 6""")
def d7_select_paints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.select_paints(pixels(spark, sf_dir), palette(spark, sf_dir), 6)


def _kmeans_sql(k: int, rounds: int = 15) -> str:
    """Centres as a list in one row: the farthest colour joins while there are fewer than k, then means replace them."""
    gap = "(c.l - colors.l) * (c.l - colors.l) + (c.a - colors.a) * (c.a - colors.a) + (c.b - colors.bb) * (c.b - colors.bb)"
    here = "{'l': colors.l, 'a': colors.a, 'b': colors.bb}"
    mean = lambda v: f"((2 * sum(n * {v})::HUGEINT + sum(n)) // (2 * sum(n)))::BIGINT"
    return f"""WITH RECURSIVE {PIXELS}, colors AS (SELECT r, g, b, n, floor({_OKC[0]} * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT AS l, floor({_OKC[1]} * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT + {dither.SHIFT} AS a, floor({_OKC[2]} * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT + {dither.SHIFT} AS bb
  FROM (SELECT r, g, b, count(*) AS n FROM pixels GROUP BY ALL)),
start AS (SELECT 1 AS m, (SELECT [{here}] FROM colors ORDER BY n DESC, r, g, b LIMIT 1) AS cs
  UNION ALL SELECT m + 1, list_append(any_value(cs), arg_min({here}, [-list_min(list_transform(cs, lambda c: {gap})), r, g, b])) FROM start, colors WHERE m < {k} GROUP BY m),
means AS (SELECT 0 AS round, cs FROM start WHERE m = {k}
  UNION ALL (WITH near AS (SELECT list_sort(list_transform(cs, lambda c, i: [{gap}, i]))[1][2] AS i, colors.* FROM means, colors),
  new AS (SELECT i, {{'l': {mean('l')}, 'a': {mean('a')}, 'b': {mean('bb')}}} AS c FROM near GROUP BY i),
  both_ AS (SELECT any_value(round) AS round, any_value(cs) AS cs, list(coalesce(new.c, cs[k.i]) ORDER BY k.i) AS moved FROM means, range(1, {k} + 1) k(i) LEFT JOIN new ON new.i = k.i)
  SELECT round + 1, moved FROM both_ WHERE round < {rounds} AND moved <> cs))
SELECT (i - 1)::INT AS cluster, cs[i].l / 1e6::DOUBLE AS ok_l, (cs[i].a - {dither.SHIFT}) / 1e6::DOUBLE AS ok_a, (cs[i].b - {dither.SHIFT}) / 1e6::DOUBLE AS ok_b FROM (SELECT cs FROM means ORDER BY round DESC LIMIT 1), range(1, {k} + 1) t(i)"""


@query(_kmeans_sql(6))
def d8_kmeans_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dither.kmeans_colors(pixels(spark, sf_dir), 6)


@query()
def r1_flatten_l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.flatten_l0(pixels(spark, sf_dir), 0.25)


def _edges_sql(reach: float = 57.0, edge: float = 0.23, rounds: int = 3) -> str:
    """The recursive filter as walks along each line: there and back, by rows and then by columns, in three rounds."""
    now, parts = "dense", []
    for i in range(rounds):
        sigma = f"({reach}::DOUBLE * sqrt(3.0::DOUBLE) * {2.0 ** (rounds - 1 - i)}::DOUBLE / sqrt({4.0**rounds - 1}::DOUBLE))"
        for along, across, d, size in (("x", "y", "dx", "w"), ("y", "x", "dy", "h")):
            for way, first, keep in ((1, "0", f"p.{d}"), (-1, f"{size} - 1", f"f.{d}")):
                name = f"{along}{i}{'there' if way > 0 else 'back'}"
                mixed = ", ".join(f"p.{c} + pow(exp(-sqrt(2.0::DOUBLE) / {sigma}), {keep}) * (f.{c} - p.{c}) AS {c}" for c in "rgb")
                parts.append(f"{name} AS (SELECT image_id, x, y, w, h, dx, dy, r, g, b FROM {now} WHERE {along} = {first} UNION ALL SELECT p.image_id, p.x, p.y, p.w, p.h, p.dx, p.dy, {mixed} FROM {name} f JOIN {now} p ON p.image_id = f.image_id AND p.{across} = f.{across} AND p.{along} = f.{along} + {way})")
                now = name
    change = lambda o: " + ".join(f"abs(p.{c} - {o}.{c})" for c in "rgb")
    whole = lambda c: f"floor(greatest(0, least(1, s.{c})) * 255 + 0.5::DOUBLE)::INT AS {c}"
    return f"""WITH RECURSIVE {PIXELS}, size AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY image_id), spots AS (SELECT *, unnest(range(w))::INT AS x FROM size), places AS (SELECT *, unnest(range(h))::INT AS y FROM spots),
filled AS (SELECT image_id, q.x, q.y, w, h, coalesce(r, 0) / 255.0::DOUBLE AS r, coalesce(g, 0) / 255.0::DOUBLE AS g, coalesce(b, 0) / 255.0::DOUBLE AS b FROM places q LEFT JOIN pixels USING (image_id, x, y)),
dense AS (SELECT p.*, coalesce(1 + {reach}::DOUBLE / {edge}::DOUBLE * ({change('l')}), 1) AS dx, coalesce(1 + {reach}::DOUBLE / {edge}::DOUBLE * ({change('u')}), 1) AS dy
  FROM filled p LEFT JOIN filled l ON l.image_id = p.image_id AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN filled u ON u.image_id = p.image_id AND u.x = p.x AND u.y = p.y - 1),
{", ".join(parts)}
SELECT s.image_id, s.x, s.y, {whole('r')}, {whole('g')}, {whole('b')} FROM {now} s SEMI JOIN pixels USING (image_id, x, y)"""


@query(_edges_sql())
def r1_flatten_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.flatten_edges(pixels(spark, sf_dir))


#: Facets by reachability; a facet's number is its first pixel's, y * width + x, with the image's own width.
FACETS = f"""{PAINTED}, sizes AS (SELECT image_id, max(x) + 1 AS w FROM painted GROUP BY image_id), nodes AS (SELECT p.*, y * w + x AS n FROM painted p JOIN sizes USING (image_id)),
links AS (SELECT a.image_id, a.n AS a, b.n AS b FROM nodes a JOIN nodes b ON b.image_id = a.image_id AND b.chip_idx = a.chip_idx AND (abs(a.x - b.x) + abs(a.y - b.y)) = 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1),
reach AS (SELECT image_id, n AS a, n AS b FROM nodes UNION SELECT r.image_id, r.a, l.b FROM reach r JOIN links l ON l.image_id = r.image_id AND l.a = r.b),
facets AS (SELECT n.image_id, x, y, chip_idx, f.facet_id FROM nodes n JOIN (SELECT image_id, a, min(b)::BIGINT AS facet_id FROM reach GROUP BY ALL) f ON f.image_id = n.image_id AND f.a = n.n)"""


def faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.facets(painted(spark, sf_dir))


@query(f"WITH RECURSIVE {FACETS} SELECT * FROM facets")
def r2_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faceted(spark, sf_dir)


@query(f"WITH RECURSIVE {FACETS} SELECT image_id, facet_id, chip_idx, count(*) AS area FROM facets GROUP BY ALL")
def a4_facet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.facet_stats(faceted(spark, sf_dir))


@query(f"""WITH RECURSIVE {FACETS} SELECT DISTINCT p.image_id, least(p.facet_id, q.facet_id) AS a, greatest(p.facet_id, q.facet_id) AS b FROM facets p JOIN facets q ON q.image_id = p.image_id AND q.x BETWEEN p.x AND p.x + 1 AND q.y BETWEEN p.y AND p.y + 1 AND q.x + q.y = p.x + p.y + 1 AND q.facet_id <> p.facet_id""")
def j8_facet_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.facet_adjacency(faceted(spark, sf_dir))


#: Blocks of one paint, 7 x 6 pixels, as facets that are wide enough to have an inside.
BLOCKS = f"{PIXELS}, facets AS (SELECT image_id, x, y, ((y // 6) * 100 + x // 7 + image_id % 2)::BIGINT AS facet_id FROM pixels)"
_EDGE = """edges_ AS (SELECT p.* FROM facets p WHERE (SELECT count(*) FROM facets q WHERE q.image_id = p.image_id AND q.facet_id = p.facet_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1) < 4),
near AS (SELECT DISTINCT p.image_id, p.x, p.y FROM facets p JOIN edges_ e ON e.image_id = p.image_id AND pow(e.x - p.x, 2) + pow(e.y - p.y, 2) < 4.0)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.floor(F.col("y") / 6) * 100 + F.floor(F.col("x") / 7) + F.col("image_id") % 2
    return pixels(spark, sf_dir).select("image_id", "x", "y", f.cast("long").alias("facet_id"))


@query(f"WITH {BLOCKS}, {_EDGE} SELECT image_id, x, y, facet_id FROM facets p WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.image_id = p.image_id AND n.x = p.x AND n.y = p.y)")
def j9_wide_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.wide_pixels(blocks(spark, sf_dir), 2.0)


@query("SELECT o_orderkey AS id, round(greatest(pi() * (o_custkey % 5) * (o_custkey % 5), 0.003::DOUBLE * pow(0.0001::DOUBLE / 0.003::DOUBLE, (o_orderkey % 11) / 10.0::DOUBLE) * o_orderkey * 100), 6) AS least FROM orders")
def r3_min_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 5).cast("double")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.round(regions.min_area(k % 11 / 10.0, k * 100, c), 6).alias("least"))


@query(f"WITH {BLOCKS}, {_EDGE} SELECT image_id, facet_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM near n WHERE n.image_id = p.image_id AND n.x = p.x AND n.y = p.y)) > 0 AS wide FROM facets p GROUP BY image_id, facet_id")
def r4_has_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.has_width(blocks(spark, sf_dir), 2.0)


def _merge_sql(least: int, radius: float, rounds: int = 40) -> str:
    """Merges as rounds over all pixels: a round's rows have the facet that each pixel belongs to now. In a round each small
    or narrow facet picks a larger neighbour, and chains of picks are followed to their end."""
    ends = "".join(f", e{i + 1} AS (SELECT a.image_id, a.a, coalesce(b.b, a.b) AS b FROM e{i} a LEFT JOIN e{i} b ON b.image_id = a.image_id AND b.a = a.b)" for i in range(7))
    reach = int(radius)
    return f"""WITH RECURSIVE {FACETS}, {PALETTE}, paint AS (SELECT DISTINCT image_id, facet_id AS f, ok_l, ok_a, ok_b, f.chip_idx FROM facets f JOIN palette USING (chip_idx)),
s AS (SELECT image_id, x, y, facet_id AS f, 0 AS round FROM facets
  UNION ALL (WITH size AS (SELECT image_id, f, count(*) AS size FROM s GROUP BY ALL),
  inner_ AS (SELECT p.image_id, p.x, p.y, p.f FROM s p JOIN s q ON q.image_id = p.image_id AND q.f = p.f AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL HAVING count(*) = 4),
  near AS (SELECT dx, dy FROM range(-{reach}, {reach + 1}) a(dx), range(-{reach}, {reach + 1}) b(dy) WHERE dx * dx + dy * dy < {radius * radius}),
  wide AS (SELECT DISTINCT p.image_id, p.f FROM (SELECT p.image_id, p.x, p.y, p.f FROM inner_ p, near JOIN inner_ q ON q.image_id = p.image_id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM near)) p),
  weak AS (SELECT image_id, f, size FROM size WHERE size < {least} UNION SELECT image_id, f, size FROM size ANTI JOIN wide USING (image_id, f)),
  beside AS (SELECT p.image_id, p.f AS a, q.f AS b FROM s p JOIN s q ON q.image_id = p.image_id AND q.x = p.x + 1 AND q.y = p.y WHERE p.f <> q.f UNION SELECT p.image_id, p.f, q.f FROM s p JOIN s q ON q.image_id = p.image_id AND q.x = p.x AND q.y = p.y + 1 WHERE p.f <> q.f),
  touch AS (SELECT * FROM beside UNION SELECT image_id, b, a FROM beside),
  way AS (SELECT t.image_id, t.a, t.b, u.ok_l - v.ok_l AS l, pow(u.ok_l - v.ok_l, 2) + pow(u.ok_a - v.ok_a, 2) + pow(u.ok_b - v.ok_b, 2) AS d FROM touch t JOIN weak w ON w.image_id = t.image_id AND w.f = t.a JOIN size z ON z.image_id = t.image_id AND z.f = t.b
    JOIN paint u ON u.image_id = t.image_id AND u.f = t.a JOIN paint v ON v.image_id = t.image_id AND v.f = t.b WHERE z.size > w.size OR (z.size = w.size AND t.b < t.a)),
  fit AS (SELECT *, abs(l) <= 0.2::DOUBLE AS like_, bool_or(abs(l) <= 0.2::DOUBLE) OVER (PARTITION BY image_id) AS any_ FROM way),
  e0 AS (SELECT image_id, a, b FROM fit WHERE like_ OR NOT any_ QUALIFY row_number() OVER (PARTITION BY image_id, a ORDER BY d, b) = 1){ends}
  SELECT s.image_id, s.x, s.y, coalesce(e.b, s.f), s.round + 1 FROM s LEFT JOIN e7 e ON e.image_id = s.image_id AND e.a = s.f WHERE s.round < {rounds} AND s.image_id IN (SELECT image_id FROM e0))),
done AS (SELECT s.image_id, s.x, s.y, s.f, p.chip_idx FROM s JOIN paint p USING (image_id, f) QUALIFY round = max(round) OVER (PARTITION BY s.image_id)),
first_ AS (SELECT image_id, f, min(d.y * w + d.x) AS n FROM done d JOIN sizes USING (image_id) GROUP BY ALL),
same AS (SELECT DISTINCT p.image_id, p.f AS a, q.f AS b FROM done p JOIN done q ON q.image_id = p.image_id AND q.chip_idx = p.chip_idx AND q.f <> p.f AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND abs(q.x - p.x) + abs(q.y - p.y) = 1),
one AS (SELECT image_id, f AS a, f AS b FROM first_ UNION SELECT r.image_id, r.a, l.b FROM one r JOIN same l ON l.image_id = r.image_id AND l.a = r.b),
number AS (SELECT o.image_id, a AS f, min(n)::BIGINT AS facet_id FROM one o JOIN first_ f ON f.image_id = o.image_id AND f.f = o.b GROUP BY ALL)
SELECT image_id, x, y, chip_idx, facet_id FROM done JOIN number USING (image_id, f)"""


@query(_merge_sql(12, 1.5))
def r5_merge_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.merge_facets(painted(spark, sf_dir), palette(spark, sf_dir), 12, 1.5)


@query(f"""WITH {BLOCKS}, s AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM facets GROUP BY ALL),
d AS (SELECT p.image_id, p.facet_id, p.x, p.y, least((SELECT min(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) FROM facets q WHERE q.image_id = p.image_id AND q.facet_id <> p.facet_id), pow(least(p.x + 1, w - p.x, p.y + 1, h - p.y), 2)) AS d FROM facets p JOIN s ON s.image_id = p.image_id),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id, facet_id ORDER BY d DESC, y, x) AS n FROM d)
SELECT image_id, facet_id, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, max(x) FILTER (n = 1) AS pole_x, max(y) FILTER (n = 1) AS pole_y, round(sqrt(max(d)), 6) AS radius FROM b GROUP BY ALL""")
def r6_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = regions.regions(blocks(spark, sf_dir).withColumn("chip_idx", F.lit(0)))
    return own.withColumn("radius", F.round("radius", 6)).drop("chip_idx")


@query("""SELECT o_orderkey AS id, round(least(CASE WHEN o_custkey % 4 > 0 THEN least(1.4::DOUBLE * (o_custkey % 4), 24) ELSE least(1.4::DOUBLE * (o_orderkey % 50 + 1), 24) END, 1.4::DOUBLE * (o_orderkey % 50 + 1),
  1.8::DOUBLE * (o_orderkey % 50 + 1) / sqrt(pow(0.6::DOUBLE * greatest(1, o_orderkey % 4), 2) + 1)), 6) AS font FROM orders""")
def r7_label_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.round(regions.label_font(c % 4, k % 50 + 1, k % 4), 6).alias("font"))


EDGES = """edges AS (SELECT p.image_id, p.x AS x1, p.y AS y1, p.x + 1 AS x2, p.y AS y2, coalesce(q.facet_id, -1) AS a, p.facet_id AS b FROM facets p LEFT JOIN facets q ON q.image_id = p.image_id AND q.x = p.x AND q.y = p.y - 1 WHERE q.facet_id IS DISTINCT FROM p.facet_id
  UNION ALL SELECT p.image_id, p.x, p.y, p.x, p.y + 1, coalesce(q.facet_id, -1), p.facet_id FROM facets p LEFT JOIN facets q ON q.image_id = p.image_id AND q.x = p.x - 1 AND q.y = p.y WHERE q.facet_id IS DISTINCT FROM p.facet_id
  UNION ALL SELECT p.image_id, p.x, p.y + 1, p.x + 1, p.y + 1, p.facet_id, -1 FROM facets p LEFT JOIN facets q ON q.image_id = p.image_id AND q.x = p.x AND q.y = p.y + 1 WHERE q.facet_id IS NULL
  UNION ALL SELECT p.image_id, p.x + 1, p.y, p.x + 1, p.y + 1, p.facet_id, -1 FROM facets p LEFT JOIN facets q ON q.image_id = p.image_id AND q.x = p.x + 1 AND q.y = p.y WHERE q.facet_id IS NULL)"""


@query(f"WITH {BLOCKS}, {EDGES} SELECT * FROM edges")
def r8_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.boundary_edges(blocks(spark, sf_dir))


@query(f"""WITH {BLOCKS}, {EDGES}, ends AS (SELECT image_id, x1 AS x, y1 AS y FROM edges UNION ALL SELECT image_id, x2, y2 FROM edges), d AS (SELECT image_id, x, y, count(*) AS degree FROM ends GROUP BY ALL), s AS (SELECT image_id, max(x2) AS w, max(y2) AS h FROM edges GROUP BY ALL)
SELECT image_id, x, y, degree FROM d JOIN s USING (image_id) WHERE degree <> 2 OR (x IN (0, w) AND y IN (0, h))""")
def r9_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.junctions(regions.boundary_edges(blocks(spark, sf_dir)))


@query(f"""WITH RECURSIVE {BLOCKS}, {EDGES}, e AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, y2, x2) - 1 AS k FROM edges), s AS (SELECT image_id, max(x2) AS w, max(y2) AS h FROM edges GROUP BY ALL),
ends AS (SELECT image_id, k, x1 AS x, y1 AS y FROM e UNION ALL SELECT image_id, k, x2, y2 FROM e),
plain AS (SELECT image_id, x, y, min(k) AS k1, max(k) AS k2 FROM ends JOIN s USING (image_id) GROUP BY image_id, x, y HAVING count(*) = 2 AND NOT (x IN (0, any_value(w)) AND y IN (0, any_value(h)))),
links AS (SELECT image_id, k1 AS f, k2 AS t FROM plain UNION ALL SELECT image_id, k2, k1 FROM plain),
reach AS (SELECT image_id, k AS f, k AS t FROM e UNION SELECT r.image_id, r.f, l.t FROM reach r JOIN links l ON l.image_id = r.image_id AND l.f = r.t)
SELECT r.image_id, arc::INT AS arc_id, count(*) AS n_edges, min(least(a, b)) AS a, max(greatest(a, b)) AS b FROM (SELECT image_id, f, min(t) AS arc FROM reach GROUP BY ALL) r JOIN e ON e.image_id = r.image_id AND e.k = r.f GROUP BY r.image_id, arc""")
def r10_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs with their unit edges counted."""
    own = regions.arcs(regions.boundary_edges(blocks(spark, sf_dir)))
    return own.groupBy("image_id", "arc_id", "a", "b").agg((F.count("*") - 1).alias("n_edges"))


def _hexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = cells(spark, sf_dir)
    dims = grids(pixels(spark, sf_dir)).select("image_id", "cells_x", "cells_y")
    return own.withColumn("hex", color.to_hex(*(F.col(c) for c in "rgb"))).withColumn("inner_hex", color.to_hex(*((F.col(c) / 2).cast("int") for c in "rgb"))), dims


_HEX = "printf('#%02x%02x%02x', r, g, b)"
SQUARES = f"""SELECT image_id, 1 AS layer, (cy * cells_x + cx)::BIGINT AS seq, '<rect x="' || cx || '" y="' || cy || '" width="1" height="1" fill="' || {_HEX} || '"/>' AS shape FROM cells JOIN grids USING (image_id)
UNION ALL SELECT image_id, 2, i, '<path d="M' || i || ' 0V' || cells_y || '"/>' FROM (SELECT *, unnest(range(cells_x + 1)) AS i FROM grids) UNION ALL SELECT image_id, 2, cells_x + 1 + i, '<path d="M0 ' || i || 'H' || cells_x || '"/>' FROM (SELECT *, unnest(range(cells_y + 1)) AS i FROM grids)"""


@query(f"WITH {CELLS} {SQUARES}")
def o1_pixelate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, dims = _hexed(spark, sf_dir)
    return shapes.pixelate_shapes(own.select("image_id", "cx", "cy", "hex"), dims)


@query(f"""WITH {CELLS}, c AS (SELECT *, (cy * cells_x + cx)::BIGINT AS seq FROM cells JOIN grids USING (image_id))
SELECT image_id, 1 AS layer, seq, '<ellipse cx="' || cx || '.5" cy="' || cy || '.5" rx="0.425" ry="0.4" fill="' || {_HEX} || '" stroke="#000000" stroke-width="0.05"/>' AS shape FROM c
UNION ALL SELECT image_id, 2, seq, '<ellipse cx="' || cx || '.5" cy="' || cy || '.5" rx="0.25" ry="0.2" fill="' || printf('#%02x%02x%02x', r // 2, g // 2, b // 2) || '" stroke="#000000" stroke-width="0.05"/>' FROM c
UNION ALL SELECT image_id, 3, 0, '<rect x="0" y="0" width="' || cells_x || '" height="' || cells_y || '" fill="none" stroke="#000000"/>' FROM grids""")
def o2_circulate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, dims = _hexed(spark, sf_dir)
    return shapes.circulate_shapes(own, dims, (0.85, 0.8), (0.5, 0.4), 0.05)


@query(f"""WITH {SNAPPED}, l AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY chip_idx) AS label FROM snapped)
SELECT image_id, 4 AS layer, (cy * cells_x + cx)::BIGINT AS seq, '<text x="' || (cx * 2 + 1) || '" y="' || (cy * 2 + 1) || '" font-size="0.8">' || label || '</text>' AS shape FROM l JOIN grids USING (image_id)""")
def o3_label_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = grids(pixels(spark, sf_dir)).select("image_id", "cells_x")
    return shapes.label_shapes(grid.number_labels(snapped(spark, sf_dir)).join(dims, "image_id"), 2.0, 2.0)


@query(f"""WITH {CELLS}, s AS ({SQUARES}) SELECT image_id, md5('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || any_value(cells_x) || ' ' || any_value(cells_y) || '">' || string_agg(shape, '' ORDER BY layer, seq, shape) || '</svg>') AS svg_md5 FROM s JOIN grids USING (image_id) GROUP BY image_id""")
def o4_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, dims = _hexed(spark, sf_dir)
    docs = shapes.to_documents(shapes.pixelate_shapes(own.select("image_id", "cx", "cy", "hex"), dims), dims)
    return docs.select("image_id", F.md5("svg").alias("svg_md5"))


@query(f"WITH {CELLS} SELECT image_id, cx, cy, {_HEX} AS hex FROM cells")
def o5_read_pixelate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings made and read back."""
    own, dims = _hexed(spark, sf_dir)
    return shapes.read_pixelate(shapes.to_documents(shapes.pixelate_shapes(own.select("image_id", "cx", "cy", "hex"), dims), dims))


@query(f"""WITH {CELLS} SELECT image_id, cx, cy, 1 AS ring, {_HEX} AS hex, 0.425::DOUBLE AS rx, 0.4::DOUBLE AS ry FROM cells
UNION ALL SELECT image_id, cx, cy, 2, printf('#%02x%02x%02x', r // 2, g // 2, b // 2), 0.25::DOUBLE, 0.2::DOUBLE FROM cells""")
def o6_read_circulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, dims = _hexed(spark, sf_dir)
    return shapes.read_circulate(shapes.to_documents(shapes.circulate_shapes(own, dims, (0.85, 0.8), (0.5, 0.4), 0.05), dims))


@query()
def trace_linerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region trace end to end: working size, flatten, select paints, snap, merge facets, region table with each
    region's number and its font size."""
    flat = checkpoint(regions.flatten_l0(grid.to_work_size(pixels(spark, sf_dir), 1), 0.25))
    chips = palette(spark, sf_dir)
    paints = dither.select_paints(flat, chips, 6)
    found = grid.number_labels(checkpoint(regions.painted_regions(flat, paints, chips, 12, 1.0)))
    return found.withColumn("font", regions.label_font(F.lit(1.0), F.col("radius"), F.length(F.col("label").cast("string"))))


