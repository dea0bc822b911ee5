"""Registered queries of the column functions (projections and scalars)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import scalars as sc
from ..functions import scores as so
from .catalog import query
from .tables import BOXES, PREDICTIONS, READINGS, boxes, epoch_ms, predictions, readings, sql_intersection, sql_iou, table

KEY = ("frame_id", "box_id")


def _keyed(df, **columns):
    return df.select(*KEY, *(v.alias(k) for k, v in columns.items()))


def _as(b, tag):
    return {f"{tag}_{c}": getattr(b, c) for c in "xywh"}


_CLIP = "greatest(0, least(x{0}, {2})) AS {1}_l, greatest(0, least(y{0}, {3})) AS {1}_t"


@query("p1_box_clip_pad_inflate", f"""WITH {BOXES}, e AS (SELECT *, least(greatest(x,0),64) AS cl, least(greatest(y,0),64) AS ct, least(greatest(x+w,0),64) AS cr, least(greatest(y+h,0),64) AS cb,
  least(greatest(x-4,0),64) AS pl, least(greatest(y-4,0),64) AS pt, least(greatest(x+w+4,0),64) AS pr, least(greatest(y+h+4,0),64) AS pb FROM b)
SELECT frame_id, box_id, cl AS c_x, ct AS c_y, cr-cl AS c_w, cb-ct AS c_h, pl AS p_x, pt AS p_y, pr-pl AS p_w, pb-pt AS p_h, x-3 AS i_x, y-3 AS i_y, w+6 AS i_w, h+6 AS i_h FROM e""")
def p1(spark, sf):
    b = bx.Box.of()
    return _keyed(boxes(spark, sf), **_as(bx.clip(b, 64, 64), "c"), **_as(bx.pad(b, 4, 64, 64), "p"), **_as(bx.inflate(b, 3), "i"))


def _pairs(spark, sf):
    b = boxes(spark, sf)
    a, c = (b.select("frame_id", *(F.col(k).alias(f"{s}_{k}") for k in ("box_id", "x", "y", "w", "h"))) for s in "ab")
    return a.join(c, "frame_id").where("a_box_id < b_box_id")


@query("p2_box_iou", f"WITH {BOXES} SELECT a.frame_id, a.box_id AS a_box_id, c.box_id AS b_box_id, {sql_iou('a', 'c')} AS iou FROM b a JOIN b c ON a.frame_id = c.frame_id AND a.box_id < c.box_id")
def p2(spark, sf):
    return _pairs(spark, sf).select("frame_id", "a_box_id", "b_box_id", bx.iou(bx.Box.of("a_"), bx.Box.of("b_")).alias("iou"))


@query("p3_box_intersection_center", f"""WITH {BOXES} SELECT a.frame_id, a.box_id AS a_box_id, c.box_id AS b_box_id, {sql_intersection('a', 'c')} AS area,
  (a.x + a.w / 2 BETWEEN c.x AND c.x + c.w) AND (a.y + a.h / 2 BETWEEN c.y AND c.y + c.h) AS inside FROM b a JOIN b c ON a.frame_id = c.frame_id AND a.box_id < c.box_id""")
def p3(spark, sf):
    a, b = bx.Box.of("a_"), bx.Box.of("b_")
    return _pairs(spark, sf).select("frame_id", "a_box_id", "b_box_id", bx.intersection(a, b).alias("area"), bx.center_inside(a, b).alias("inside"))


@query("p4_boxes_overlap_padded", f"""WITH {BOXES} SELECT a.frame_id, a.box_id AS a_box_id, c.box_id AS b_box_id,
  NOT (a.x + a.w + 12 < c.x OR c.x + c.w + 12 < a.x OR a.y + a.h + 12 < c.y OR c.y + c.h + 12 < a.y) AS meets FROM b a JOIN b c ON a.frame_id = c.frame_id AND a.box_id < c.box_id""")
def p4(spark, sf):
    return _pairs(spark, sf).select("frame_id", "a_box_id", "b_box_id", bx.overlap_padded(bx.Box.of("a_"), bx.Box.of("b_"), 12).alias("meets"))


@query("p5_scene_point", f"WITH {BOXES} SELECT frame_id, box_id, (x + w / 2) / 32.0::DOUBLE - 1 AS sx, 1 - (y + h / 2) / 24.0::DOUBLE AS sy FROM b")
def p5(spark, sf):
    x, y = bx.scene_point(bx.Box.of(), 64.0, 48.0)
    return _keyed(boxes(spark, sf), sx=x, sy=y)


@query("p6_snap", f"WITH {BOXES} SELECT frame_id, box_id, floor(x / 2.5::DOUBLE + 0.5) * 2.5 AS gx, ((floor(y * 9 / 90.0::DOUBLE + 0.5) * 90)::BIGINT % 360) AS turn, x * 1.5 + 4 AS spaced FROM b")
def p6(spark, sf):
    return _keyed(boxes(spark, sf), gx=bx.snap(F.col("x"), 2.5), turn=bx.quarter_turn(F.col("y") * 9).cast("long"), spaced=F.col("x") * 1.5 + 4)


def _quad(spark, sf):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    b, q = bx.Box.of(), F.col("score") * 20
    given = F.array(point(b.right, b.y + q), point(b.x + q, b.bottom), point(b.x, b.y), point(b.right - q, b.bottom + q))
    return boxes(spark, sf).withColumn("pts", bx.ordered_quad(given))


_QUAD = BOXES + """, g AS (SELECT frame_id, box_id, list_value({'x': (x + w)::DOUBLE, 'y': y + score * 20}, {'x': x + score * 20, 'y': (y + h)::DOUBLE}, {'x': x::DOUBLE, 'y': y::DOUBLE}, {'x': x + w - score * 20, 'y': y + h + score * 20}) AS raw FROM b),
n AS (SELECT frame_id, box_id, unnest(raw) AS p, generate_subscripts(raw, 1) AS i FROM g),
o AS (SELECT frame_id, box_id, first(p ORDER BY p.x + p.y, i) AS tl, first(p ORDER BY p.y - p.x, i) AS tr, first(p ORDER BY p.x + p.y DESC, i) AS br, first(p ORDER BY p.y - p.x DESC, i) AS bl FROM n GROUP BY ALL)"""


@query("p7_order_points", f"WITH {_QUAD} SELECT frame_id, box_id, tl.x AS tl_x, tl.y AS tl_y, tr.x AS tr_x, tr.y AS tr_y, br.x AS br_x, br.y AS br_y, bl.x AS bl_x, bl.y AS bl_y FROM o")
def p7(spark, sf):
    pts = F.col("pts")
    return _keyed(_quad(spark, sf), **{f"{n}_{c}": pts[i][c] for i, n in enumerate(("tl", "tr", "br", "bl")) for c in "xy"})


@query("p8_quad_features", f"""WITH {_QUAD}, d AS (SELECT *, (sqrt((tr.x-tl.x)*(tr.x-tl.x)+(tr.y-tl.y)*(tr.y-tl.y)) + sqrt((br.x-bl.x)*(br.x-bl.x)+(br.y-bl.y)*(br.y-bl.y))) / 2 AS across,
  (sqrt((bl.x-tl.x)*(bl.x-tl.x)+(bl.y-tl.y)*(bl.y-tl.y)) + sqrt((br.x-tr.x)*(br.x-tr.x)+(br.y-tr.y)*(br.y-tr.y))) / 2 AS down FROM o)
SELECT frame_id, box_id, round((tl.x+tr.x+br.x+bl.x)/4, 6) AS cx, round((tl.y+tr.y+br.y+bl.y)/4, 6) AS cy, round(atan2(tr.y-tl.y, tr.x-tl.x), 6) AS angle,
  round(abs(tl.x*tr.y-tr.x*tl.y + tr.x*br.y-br.x*tr.y + br.x*bl.y-bl.x*br.y + bl.x*tl.y-tl.x*bl.y)/2, 4) AS area, round(greatest(across, down)/greatest(1e-9, least(across, down)), 6) AS aspect,
  round_even(least(tl.x, tr.x, br.x, bl.x), 0)::BIGINT AS x, round_even(least(tl.y, tr.y, br.y, bl.y), 0)::BIGINT AS y, greatest(0, round_even(greatest(tl.x, tr.x, br.x, bl.x), 0)::BIGINT - round_even(least(tl.x, tr.x, br.x, bl.x), 0)::BIGINT) AS w,
  greatest(0, round_even(greatest(tl.y, tr.y, br.y, bl.y), 0)::BIGINT - round_even(least(tl.y, tr.y, br.y, bl.y), 0)::BIGINT) AS h, round(-atan2(tr.y-tl.y, tr.x-tl.x) + CASE WHEN box_id % 2 = 0 THEN pi() ELSE 0.0 END, 6) AS layout_angle FROM d""")
def p8(spark, sf):
    f = bx.quad_features(F.col("pts"))
    angle = bx.layout_angle(F.col("pts"), F.col("box_id") % 2 == 0)
    return _keyed(_quad(spark, sf), **{k: F.round(v, 4 if k == "area" else 6) for k, v in f.items()}, **bx.quad_box(F.col("pts")), layout_angle=F.round(angle, 6))


@query("p9_expand_quad", f"""WITH {_QUAD}, c AS (SELECT *, (tl.x+tr.x+br.x+bl.x)/4 AS cx, (tl.y+tr.y+br.y+bl.y)/4 AS cy FROM o)
SELECT frame_id, box_id, round(least(greatest(cx + (tl.x-cx)*1.1, 0), 64), 6) AS tl_x, round(least(greatest(cy + (tl.y-cy)*1.1, 0), 64), 6) AS tl_y,
  round(least(greatest(cx + (br.x-cx)*1.1, 0), 64), 6) AS br_x, round(least(greatest(cy + (br.y-cy)*1.1, 0), 64), 6) AS br_y,
  abs(tl.x*tr.y-tr.x*tl.y + tr.x*br.y-br.x*tr.y + br.x*bl.y-bl.x*br.y + bl.x*tl.y-tl.x*bl.y)/2 >= 100 AND least(sqrt((tr.x-tl.x)*(tr.x-tl.x)+(tr.y-tl.y)*(tr.y-tl.y)), sqrt((br.x-tr.x)*(br.x-tr.x)+(br.y-tr.y)*(br.y-tr.y)),
  sqrt((bl.x-br.x)*(bl.x-br.x)+(bl.y-br.y)*(bl.y-br.y)), sqrt((tl.x-bl.x)*(tl.x-bl.x)+(tl.y-bl.y)*(tl.y-bl.y))) >= 2 AS valid FROM c""")
def p9(spark, sf):
    q = bx.expand_quad(F.col("pts"), 0.1, 64, 64)
    return _keyed(_quad(spark, sf), **{f"{n}_{c}": F.round(q[i][c], 6) for i, n in ((0, "tl"), (2, "br")) for c in "xy"}, valid=bx.valid_quad(F.col("pts")))


@query("p10_shape_filter", f"""WITH {BOXES}, s AS (SELECT *, CASE WHEN w*h < 200 THEN 'area_too_small' WHEN w*h > 1500 THEN 'area_too_large' WHEN abs(h/w::DOUBLE - 1.72) > 0.45 THEN 'aspect_mismatch' END AS reject_reason FROM b)
SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM s GROUP BY 1""")
def p10(spark, sf):
    b = bx.Box.of()
    return boxes(spark, sf).select(F.coalesce(so.shape_reject(b.area, b.h / b.w, 200, 1500), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("p11_size_filter", f"WITH {BOXES} SELECT frame_id, count(*) FILTER (w*h/4096.0 < 0.05) AS ignored_small, count(*) FILTER (w*h/4096.0 > 0.4) AS ignored_large, count(*) FILTER (w*h/4096.0 BETWEEN 0.05 AND 0.4) AS kept FROM b GROUP BY 1")
def p11(spark, sf):
    ratio = bx.Box.of().area / 4096.0
    kind = so.first_rule([("small", ratio < 0.05), ("large", ratio > 0.4)], "kept")
    n = lambda k: F.count_if(F.col("kind") == k)
    return boxes(spark, sf).withColumn("kind", kind).groupBy("frame_id").agg(n("small").alias("ignored_small"), n("large").alias("ignored_large"), n("kept").alias("kept"))


@query("p12_change_kind", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_discount < 0.05 AND l_tax >= 0.05 THEN 'added' WHEN l_discount >= 0.05 AND l_tax < 0.05 THEN 'removed'
  WHEN l_discount >= 0.05 THEN 'moved_or_replaced' ELSE 'noise_or_lighting' END AS kind FROM lineitem""")
def p12(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", so.change_kind(F.col("l_discount"), F.col("l_tax"), 0.05).alias("kind"))


@query("p13_target_range", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CASE WHEN l_quantity BETWEEN 10 AND 30 THEN 1.0 WHEN l_quantity < 5 OR l_quantity > 45 THEN 0.0 WHEN l_quantity < 10 THEN (l_quantity - 5) / 5 * 0.5 + 0.5
  ELSE (45 - l_quantity) / 15 * 0.5 + 0.5 END, 9) AS trapezoid, round((greatest(0, least(1, l_discount * 8)) * 0.7 + greatest(0, least(1, l_tax * 20)) * 0.3) / (0.7 + 0.3), 9) AS mean FROM lineitem""")
def p13(spark, sf):
    q = F.col("l_quantity")
    mean = so.weighted([(F.col("l_discount") * 8, 0.7), (F.col("l_tax") * 20, 0.3)])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(so.target_range(q, 10, 30, 5, 45), 9).alias("trapezoid"), F.round(mean, 9).alias("mean"))


@query("p14_geometry_confidence", f"""WITH {BOXES}, c AS (SELECT frame_id, box_id, greatest(0, least(1, 0.30 * greatest(0, 1 - least(1, abs(h/w::DOUBLE - 1.72))) + 0.25 * (w*h/2200.0::DOUBLE) + 0.20 * least(1, score * 8) + 0.15 * least(1, score * score * 8) + 0.10 * (x/40.0::DOUBLE)
  + CASE WHEN y % 5 = 4 THEN 0.15 ELSE 0 END)) AS c FROM b) SELECT frame_id, box_id, round(c, 9) AS confidence, CASE WHEN c >= 0.68 THEN 'PASS' WHEN c >= 0.35 THEN 'YELLOW' ELSE 'FAIL' END AS grade FROM c""")
def p14(spark, sf):
    b, s = bx.Box.of(), F.col("score")
    points = F.when(b.y % 5 == 4, 4).otherwise(3)
    c = so.geometry_confidence(b.area / 2200.0, s, s * s, b.x / 40.0, F.abs(b.h / b.w - 1.72), points)
    return _keyed(boxes(spark, sf), confidence=F.round(c, 9), grade=so.grade(c))


@query("p14_region_confidence", f"""WITH {BOXES}, m AS (SELECT frame_id, box_id, greatest(w, h) / least(w, h)::DOUBLE AS aspect, score * 10 AS fill, w * h / 4096.0::DOUBLE AS area, x / 40.0::DOUBLE AS rect, score * score AS support FROM b),
c AS (SELECT *, (0.35 * greatest(0, least(1, 1 - abs(aspect - 1.65) / 1.65 * 2.0)) + 0.25 * greatest(0, least(1, fill)) + 0.20 * CASE WHEN area BETWEEN 0.08 AND 0.75 THEN 1.0 WHEN area < 0.03 OR area > 0.90 THEN 0.0 WHEN area < 0.08 THEN (area - 0.03) / (0.08 - 0.03) * 0.5 + 0.5 ELSE (0.90 - area) / (0.90 - 0.75) * 0.5 + 0.5 END
  + 0.10 * greatest(0, least(1, rect)) + 0.10 * greatest(0, least(1, support * 8.0))) / (0.35 + 0.25 + 0.20 + 0.10 + 0.10) AS c, CASE WHEN area < 0.03 THEN 'card_area_too_small' WHEN aspect < 1.05 OR aspect > 2.40 THEN 'bad_aspect_ratio' WHEN fill < 0.12 THEN 'low_foreground_fill' END AS reject_reason FROM m)
SELECT frame_id, box_id, round(greatest(0, least(1, c)), 9) AS confidence, reject_reason, CASE WHEN reject_reason IS NOT NULL THEN 'FAIL' WHEN round(c, 12) >= 0.68 THEN 'PASS' WHEN round(c, 12) >= 0.35 THEN 'YELLOW' ELSE 'FAIL' END AS status FROM c""")
def p14_region(spark, sf):
    b, s = bx.Box.of(), F.col("score")
    c = so.region_confidence(F.greatest(b.w, b.h) / F.least(b.w, b.h), s * 10, b.area / 4096.0, b.x / 40.0, s * s)
    return _keyed(boxes(spark, sf), confidence=F.round(c["confidence"], 9), reject_reason=c["reject_reason"], status=c["status"])


@query("p15_signal_screen", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: 100 + 100 * x::DOUBLE) AS v FROM embeddings),
d AS (SELECT vec_id, v, list_transform(range(1, len(v) - 1), lambda i: v[i + 2] - v[i + 1] - (v[i + 1] - v[i])) AS s FROM v),
m AS (SELECT vec_id, list_avg(v) AS mean, list_stddev_pop(v) AS std, list_var_pop(s) AS blur FROM d)
SELECT vec_id, round(mean, 6) AS mean, round(std, 6) AS std, round(blur, 5) AS blur, CASE WHEN mean < 99 THEN 'too_dark' WHEN std < 12.4 THEN 'low_contrast' WHEN blur < 900 THEN 'too_blurry' END AS reason,
  round(CASE WHEN mean < 99 OR std < 12.4 OR blur < 900 THEN 0.0 ELSE least(1, 0.5 * blur / 200 + 0.5 * std / 80) END, 6) AS score FROM m""")
def p15(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: 100 + 100 * x.cast("double")).alias("v"))
    s = so.signal_screen(F.col("v"), least_mean=99, least_std=12.4, least_blur=900)
    return df.select("vec_id", F.round(s["mean"], 6).alias("mean"), F.round(s["std"], 6).alias("std"), F.round(s["blur"], 5).alias("blur"), s["reason"].alias("reason"), F.round(s["score"], 6).alias("score"))


def _measures():
    q, d, t, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
    return dict(zip(so.MEASURES, (d * 10, t * 12, q / 50, d, q / 50 + 0.3, t * 4, t * 3, d * 3, d * 4, q * 12, q * 3, p / 400, q * 1.5, q * 5, d, t, d * 2, 1.4 + t * 8, q / 20), strict=True))


@query("p16_quality_suite", """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount*10 AS bv, l_tax*12 AS bc, l_quantity/50 AS cv, least(1, l_discount*20) AS px, l_quantity/50+0.3 AS fr, greatest(0, least(1, 1-l_tax*4*3)) AS bg, l_tax*3 AS tm, l_discount*3 AS tr, l_discount*4 AS oe,
  greatest(0, least(1, l_quantity*12/500)) AS blur, greatest(0, least(1, l_quantity*3/80)) AS sharp, l_extendedprice/400 AS br, greatest(0, least(1, l_quantity*1.5/55)) AS con, greatest(0, least(1, l_quantity*5/190)) AS spr, l_discount AS ed, l_tax AS td, l_discount*2 AS det,
  greatest(0, least(1, 1 - abs(1.4 + l_tax*8 - 1.72)/1.72*3)) AS asp, greatest(0, least(1, l_quantity/20)) AS sz FROM lineitem),
n AS (SELECT *, CASE WHEN fr BETWEEN 0.70 AND 0.98 THEN 1.0 WHEN fr NOT BETWEEN 0.55 AND 1.0 THEN 0.0 WHEN fr < 0.70 THEN least(1, greatest(0, (fr-0.55)/(0.70-0.55)*0.5+0.5)) ELSE least(1, greatest(0, (1.0-fr)/(1.0-0.98)*0.5+0.5)) END AS fill,
  CASE WHEN br BETWEEN 45 AND 220 THEN 1.0 WHEN br NOT BETWEEN 25 AND 240 THEN 0.0 WHEN br < 45 THEN (br-25)/20*0.5+0.5 ELSE (240-br)/20*0.5+0.5 END AS light,
  least(1,bv)*0.35 + least(1,bc)*0.35 + least(1,cv)*0.20 + px*0.10 AS risk FROM m),
c AS (SELECT *, risk*0.25 + least(1,bv)*0.20 + least(1,bc)*0.15 + least(1,cv)*0.10 + fill*0.15 + asp*0.15 AS complete FROM n),
q AS (SELECT *, complete*0.35 + bg*0.15 + light*0.10 + con*0.10 + blur*0.10 + least(1,ed)*0.10 + sz*0.10 AS quality, blur*0.20 + sharp*0.20 + con*0.18 + light*0.12 + spr*0.10 + td*0.10 + least(1,det)*0.10 AS ready FROM c),
f AS (SELECT *, list_filter([CASE WHEN risk < 0.28 THEN 'EDGE_CUT_RISK' END, CASE WHEN bg < 0.45 THEN 'TOO_MUCH_BACKGROUND' END, CASE WHEN tm > 0.16 THEN 'TOP_MARGIN_RISK' END, CASE WHEN tr > 0.20 THEN 'TOP_REFLECTION_RISK' END,
  CASE WHEN con < 0.22 THEN 'LOW_CONTRAST' END, CASE WHEN br < 25 THEN 'TOO_DARK' END, CASE WHEN br > 240 OR oe > 0.35 THEN 'TOO_BRIGHT' END, CASE WHEN blur < 0.12 AND sharp < 0.12 THEN 'BLURRY' END, CASE WHEN ed < 0.006 AND td < 0.05 THEN 'LOW_DETAIL' END,
  CASE WHEN asp < 0.75 THEN 'BAD_ASPECT' END, CASE WHEN sz < 0.75 THEN 'UNEXPECTED_SIZE' END, CASE WHEN quality < 0.68 THEN 'LOW_QUALITY_SCORE' END, CASE WHEN ready < 0.5 THEN 'LOW_READINESS' END, CASE WHEN blur < 0.18 OR sharp < 0.18 THEN 'LOW_SHARPNESS' END,
  CASE WHEN con < 0.35 AND NOT con < 0.22 THEN 'LOW_CONTRAST' END, CASE WHEN (td < 0.12 OR det < 0.12) AND NOT (ed < 0.006 AND td < 0.05) THEN 'LOW_DETAIL' END, CASE WHEN light < 0.5 THEN 'LOW_BRIGHTNESS_SCORE' END, CASE WHEN spr < 0.35 THEN 'LOW_HISTOGRAM_SPREAD' END], lambda x: x IS NOT NULL) AS flags FROM q),
s AS (SELECT *, CASE WHEN (list_has_any(flags, ['EDGE_CUT_RISK','BAD_ASPECT','UNEXPECTED_SIZE']) AND quality < 0.35) OR quality < 0.40 OR ready < 0.30 THEN 'FAIL' WHEN len(flags) > 0 OR quality < 0.68 OR ready < 0.5 THEN 'YELLOW' ELSE 'PASS' END AS status FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(quality, 12) AS quality, round(ready, 12) AS readiness, array_to_string(flags, ';') AS flags, status, CASE WHEN status = 'FAIL' THEN flags[1] END AS reject_reason, CASE WHEN status = 'YELLOW' THEN flags[1] END AS warning_reason FROM s""")
def p16(spark, sf):
    s = so.quality_suite(_measures())
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *(v.alias(k) for k, v in s.items()))
    df = df.withColumn("status", so.quality_status(F.col("flags"), F.col("quality"), F.col("readiness")))
    first = lambda status: F.when(F.col("status") == status, F.get("flags", F.lit(0)))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round("quality", 12).alias("quality"), F.round("readiness", 12).alias("readiness"), F.array_join("flags", ";").alias("flags"), "status", first("FAIL").alias("reject_reason"), first("YELLOW").alias("warning_reason"))


@query("p17_quality_gate", """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount AS c, l_tax AS o, l_quantity/500 AS d, CASE WHEN l_linenumber > 1 THEN l_quantity/1000 END AS s, CASE WHEN l_suppkey % 3 > 0 THEN l_tax/10 END AS p FROM lineitem),
b AS (SELECT *, CASE WHEN c >= 0.065 OR (c >= 0.015 AND o >= 0.08) THEN 'RETRY' WHEN c >= 0.035 OR (c >= 0.012 AND o >= 0.055) OR d < 0.035 THEN 'MANUAL' ELSE 'ACCEPT' END AS base,
  CASE WHEN c >= 0.065 OR (c >= 0.015 AND o >= 0.08) THEN 'SPECULAR_OCCLUSION' WHEN c >= 0.035 OR (c >= 0.012 AND o >= 0.055) THEN 'SPECULAR_HIGHLIGHT_WARNING' WHEN d < 0.035 THEN 'LOW_USABLE_DETAIL' END AS r FROM g),
w AS (SELECT *, coalesce((base = 'ACCEPT' AND s < 0.03 AND p < 0.01) OR (base = 'MANUAL' AND s < 0.015 AND p < 0.005), false) AS weak FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN weak AND base = 'ACCEPT' THEN 'MANUAL' WHEN weak THEN 'RETRY' ELSE base END AS decision, concat_ws(';', r, CASE WHEN weak THEN 'LOW_MATCH_SIGNAL' END) AS reasons FROM w""")
def p17(spark, sf):
    g = so.quality_gate(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 500, F.when(F.col("l_linenumber") > 1, F.col("l_quantity") / 1000), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_tax") / 10))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", g["decision"].alias("decision"), F.array_join(g["reasons"], ";").alias("reasons"))


@query("p18_explain_status", f"""WITH {READINGS}, e AS (SELECT entity_id, seq, seq % 4 AS decks, confidence > 0.3 AS cal, seq % 5 AS markers, CASE WHEN seq % 11 = 0 THEN 'no_camera' WHEN item_id = 'click' THEN 'settling' ELSE 'holding_last_good' END AS layout, seq % 3 AS cand, seq % 2 AS cards FROM r),
a AS (SELECT *, CASE WHEN decks <= 0 THEN 'choose_decks' WHEN layout = 'no_camera' THEN 'check_camera' WHEN NOT cal THEN 'show_markers' WHEN layout = 'settling' THEN 'keep_still' WHEN cand < 1 AND cards <= 0 THEN 'improve_light' WHEN cards > 0 THEN 'run_session' ELSE 'check_diagnostics' END AS next_action FROM e)
SELECT seq, next_action, CASE WHEN next_action IN ('choose_decks','check_camera') THEN 'error' WHEN next_action = 'run_session' THEN 'ok' ELSE 'warn' END AS severity,
  concat_ws(',', 'decks=' || CASE WHEN decks > 0 THEN 'ok' ELSE 'error' END || ':' || decks, 'markers=' || CASE WHEN cal THEN 'ok' ELSE 'warn' END || ':' || markers || '/4', 'snapshot=' || CASE WHEN layout = 'settling' THEN 'wait' ELSE 'ok' END || ':' || layout,
  'candidates=' || CASE WHEN cand > 0 THEN 'ok' ELSE 'warn' END || ':' || cand, 'recognition=' || CASE WHEN cards > 0 THEN 'ok' ELSE 'wait' END || ':' || cards) AS steps FROM a""")
def p18(spark, sf):
    s = F.col("seq")
    layout = F.when(s % 11 == 0, "no_camera").when(F.col("item_id") == "click", "settling").otherwise("holding_last_good")
    e = so.explain_status(s % 4, F.col("confidence") > 0.3, s % 5, layout, s % 3, s % 2)
    steps = F.array_join(F.transform(e["steps"], lambda p: F.concat(p["step"], F.lit("="), p["state"], F.lit(":"), p["value"])), ",")
    return readings(spark, sf).select("seq", e["next_action"].alias("next_action"), e["severity"].alias("severity"), steps.alias("steps"))


@query("p18_messages", f"""WITH {READINGS}, e AS (SELECT seq, seq % 4 AS decks, confidence > 0.3 AS cal, CASE WHEN seq % 11 = 0 THEN 'no_camera' WHEN item_id = 'click' THEN 'settling' ELSE 'holding_last_good' END AS layout, seq % 3 AS cand, seq % 2 AS cards, CASE WHEN seq % 5 = 0 THEN 'warned at ' || seq END AS warned FROM r)
SELECT seq, CASE WHEN decks <= 0 THEN 'Wybierz 1-3 talie w Studio.' WHEN layout = 'no_camera' THEN 'Sprawdz kamere i launcher CV.' WHEN NOT cal THEN 'Pokaz wszystkie markery ArUco w kadrze.' WHEN layout = 'settling' THEN 'Zostaw mate nieruchomo przez kilka sekund.'
    WHEN cand < 1 AND cards <= 0 THEN 'Popraw swiatlo, kontrast albo polozenie kart.' WHEN cards > 0 THEN 'Mozna prowadzic sesje.' ELSE coalesce(warned, 'Sprawdz diagnostyke CV.') END AS advice,
  concat_ws(' | ', 'Aktywne talie: ' || CASE decks WHEN 0 THEN 'Brak aktywnej talii' WHEN 1 THEN 'deck-0' WHEN 2 THEN 'deck-0, deck-1' ELSE 'deck-0, deck-1, deck-2' END, 'ArUco: ' || CASE WHEN cal THEN 'Stol skalibrowany' ELSE 'Pokaz markery ArUco w kadrze' END,
    'Snapshot: ' || CASE WHEN layout = 'settling' THEN 'Czeka na stabilny snapshot' ELSE 'Snapshot gotowy' END, 'Kandydaci kart: ' || CASE WHEN cand > 0 THEN 'Wykryto kandydatow kart' ELSE 'Brak kandydatow kart' END,
    'Rozpoznanie: ' || CASE WHEN cards > 0 THEN 'Karty zaakceptowane' ELSE 'Czeka na rozpoznanie' END) AS messages FROM e""")
def p18_messages(spark, sf):
    s = F.col("seq")
    layout = F.when(s % 11 == 0, "no_camera").when(F.col("item_id") == "click", "settling").otherwise("holding_last_good")
    e = so.explain_status(s % 4, F.col("confidence") > 0.3, s % 5, layout, s % 3, s % 2)
    names = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, (s % 4).cast("int")), lambda n: F.concat(F.lit("deck-"), n.cast("string")))
    warned = F.when(s % 5 == 0, F.array(F.concat(F.lit("warned at "), s.cast("string")))).otherwise(F.array().cast("array<string>"))
    messages = F.array_join(F.transform(so.step_messages(e["steps"], names), lambda m: F.concat(m["label"], F.lit(": "), m["message"])), " | ")
    return readings(spark, sf).select("seq", so.action_text(e["next_action"], warned).alias("advice"), messages.alias("messages"))


@query("p19_count_verdict", f"""WITH {BOXES}, c AS (SELECT frame_id, count(*) AS n, min(score) AS least FROM b GROUP BY 1)
SELECT frame_id, CASE WHEN n = 4 AND least >= 0.01 THEN 'PASS' WHEN abs(n - 4) <= 1 THEN 'YELLOW' ELSE 'FAIL' END AS verdict FROM c""")
def p19(spark, sf):
    c = boxes(spark, sf).groupBy("frame_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    return c.select("frame_id", so.count_verdict(F.col("n"), F.lit(4), F.col("least") >= 0.01).alias("verdict"))


@query("p20_reverify_due", f"WITH {READINGS} SELECT seq, confidence < 0.1 OR value >= 120 AS due FROM r")
def p20(spark, sf):
    return readings(spark, sf).select("seq", so.reverify_due(F.col("confidence") < 0.1, F.col("value"), 120).alias("due"))


@query("p21_probable_cause", f"""WITH {PREDICTIONS}, e AS (SELECT *, CASE category WHEN 'A' THEN 'gilded_visually_similar' WHEN 'N' THEN 'gilded_yellow' ELSE 'plain' END AS cat FROM p WHERE NOT top1_correct)
SELECT method, CASE WHEN cat = 'gilded_visually_similar' AND confidence_score*4 >= 0.2 AND confidence_gap*4 >= 0.2 THEN 'ground_truth_mismatch_suspected' WHEN cat = 'gilded_yellow' THEN 'image_quality_or_crop' WHEN cat = 'gilded_visually_similar' THEN 'visual_similarity_or_matcher'
  WHEN confidence_score*4 < 0.03 THEN 'image_quality_or_crop' WHEN top3_contains_expected THEN 'matcher_ranking' ELSE 'crop_or_matcher' END AS cause, count(*) AS n FROM e GROUP BY ALL""")
def p21(spark, sf):
    cat = F.when(F.col("category") == "A", "gilded_visually_similar").when(F.col("category") == "N", "gilded_yellow").otherwise("plain")
    cause = so.probable_cause(cat, F.col("confidence_score") * 4, F.col("confidence_gap") * 4, F.col("top3_contains_expected"))
    return predictions(spark, sf).where(~F.col("top1_correct")).groupBy("method", cause.alias("cause")).agg(F.count("*").alias("n"))


@query("p22_orientation", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_tax > l_discount * 1.10 THEN 'reversed' ELSE 'upright' END AS orientation, abs(l_quantity * 7 - 180) > 90 AS flipped FROM lineitem")
def p22(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", so.orientation(F.col("l_discount"), F.col("l_tax")).alias("orientation"), so.flipped(F.col("l_quantity") * 7 - 180).alias("flipped"))


@query("p23_sample_score", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_discount*10*0.35 + l_tax*10*0.85 + CASE WHEN l_linenumber % 4 > 0 THEN (l_linenumber % 3) / (l_linenumber % 4)::DOUBLE ELSE 0.0 END * 0.70 + (l_linenumber % 3) * 0.10 - (l_suppkey % 2) * 2.0
  - greatest(0.0, l_quantity * 6 - 120.0) / 120.0 * 0.35, 9) + 0.0 AS score FROM lineitem""")
def p23(spark, sf):
    n = F.col("l_linenumber")
    score = so.sample_score(F.col("l_discount") * 10, F.col("l_tax") * 10, n % 4, n % 3, F.col("l_suppkey") % 2, F.col("l_quantity") * 6)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(score, 9).alias("score"))


@query("p23_tuning_scores", f"""WITH {BOXES}, m AS (SELECT *, CASE WHEN box_id % 3 > 0 THEN box_id * 11 END AS matches, w * h * 0.9::DOUBLE / 4096.0 AS share, abs(greatest(w, h) / least(w, h)::DOUBLE - 1.72) AS off, x + w / 2.0 - 32 AS dx, y + h / 2.0 - 32 AS dy FROM b)
SELECT frame_id, box_id, round(CASE WHEN box_id % 2 = 0 THEN 1000.0 ELSE 0.0 END + least(w, 80.0) * 2.0 - box_id % 4 * 20.0 - score * 120.0 - greatest(0.0, h * 5 - 120.0) * 0.5, 9) AS session_score,
  round(CASE WHEN matches IS NULL THEN score * 10 * 0.4 ELSE score * 10 * 0.45 + least(matches / 30.0, 1.0) * greatest(0, least(1, score * 12)) * 1.10 END, 9) AS candidate_score,
  round(CASE WHEN share < 0.0001 OR share > 0.6 OR off > 0.45 THEN 0.0 ELSE (1.0 - off / 0.45) * CASE WHEN share <= 0.15 THEN 1.0 ELSE greatest(0.0, 1.0 - (share - 0.15) / (0.6 - 0.15)) END * (0.8 + 0.2 * (1.0 - sqrt(dx * dx + dy * dy) / (sqrt(64.0 * 64 + 64 * 64) / 2))) END, 9) AS quad_score FROM m""")
def p23_tuning(spark, sf):
    b, s, n = bx.Box.of(), F.col("score"), F.col("box_id")
    session = so.session_score(n % 2 == 0, b.w, n % 4, s, b.h * 5)
    candidate = so.candidate_score(s * 10, F.when(n % 3 > 0, n * 11), s * 12)
    quad = so.quad_score(b.area * 0.9, b.x, b.y, b.w, b.h, 64, 64)
    return _keyed(boxes(spark, sf), session_score=F.round(session, 9), candidate_score=F.round(candidate, 9), quad_score=F.round(quad, 9))


@query("p24_normalise_document", """SELECT event_id, coalesce(json_extract_string(props, '$.state'), 'unknown') AS state, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS k,
  'fps=' || coalesce(json_extract_string(props, '$.k'), '0') || ';lag=0;mode=auto' AS metrics FROM events""")
def p24(spark, sf):
    doc = F.from_json("props", "state string, k int, cards array<string>")
    given = F.create_map(F.lit("fps"), F.coalesce(doc["k"].cast("string"), F.lit("0")))
    defaults = F.create_map(*map(F.lit, ("fps", "0", "lag", "0", "mode", "auto")))
    merged = F.array_sort(F.map_entries(sc.with_defaults(given, defaults)))
    text = F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, sf, "events").select("event_id", F.coalesce(doc["state"], F.lit("unknown")).alias("state"), F.coalesce(doc["k"], F.lit(0)).alias("k"), text.alias("metrics"))


PARAMS = [("click", 10.0, 0.0, 60.0, True), ("view", 12.0, 5.0, 80.0, False), ("purchase", 0.5, 0.0, 1.0, True)]


@query("p25_parameter_check", f"""WITH {READINGS}, v(name, lo, hi, live) AS (VALUES ('click', 0.0, 60.0, true), ('view', 5.0, 80.0, false), ('purchase', 0.0, 1.0, true))
SELECT seq, item_id AS name, CASE WHEN name IS NULL THEN 'unknown_parameter' WHEN value < lo OR value > hi THEN 'out_of_range' END AS error, name IS NOT NULL AND value BETWEEN lo AND hi AS applied, name IS NOT NULL AND value BETWEEN lo AND hi AND NOT live AS pending FROM r LEFT JOIN v ON name = item_id""")
def p25(spark, sf):
    from ..operators.quality import check_parameters

    params = spark.createDataFrame(PARAMS, "name string, default double, minimum double, maximum double, live_safe boolean").coalesce(1)
    given = readings(spark, sf).select("seq", F.col("item_id").alias("name"), "value")
    return check_parameters(given, params).select("seq", "name", "error", "applied", "pending")


@query("p26_usable_samples", f"""WITH {READINGS}, s AS (SELECT seq, ['empty','one_card','three_cards'][seq % 3 + 1] AS scenario, (seq % 5)::BIGINT AS detected, (seq // 5 % 3)::BIGINT AS accepted, [confidence, value / 1000] AS conf FROM r)
SELECT seq, scenario, CASE WHEN scenario = 'empty' AND accepted <> 0 THEN 'accepted_on_empty' WHEN scenario = 'one_card' AND detected <> 1 OR scenario = 'three_cards' AND detected <> 3 THEN 'wrong_count' END AS reject_reason,
  greatest(0, detected - CASE scenario WHEN 'empty' THEN 0 WHEN 'one_card' THEN 1 ELSE 3 END) AS false_positive_count, round((conf[1] + conf[2]) / 2, 9) AS recognition_score FROM s""")
def p26(spark, sf):
    from ..operators.quality import usable_samples

    s = F.col("seq")
    given = readings(spark, sf).select("seq", F.element_at(F.array(*map(F.lit, ("empty", "one_card", "three_cards"))), (s % 3 + 1).cast("int")).alias("scenario"), (s % 5).alias("detected_count"), (F.floor(s / 5) % 3).alias("accepted_count"), F.array("confidence", F.col("value") / 1000).alias("recognition_confidences"))
    return usable_samples(given).select("seq", "scenario", "reject_reason", "false_positive_count", F.round("recognition_score", 9).alias("recognition_score"))


@query("f_scalars", """SELECT event_id, substr(sha256(event_id || '|' || event_type), 1, 20) AS stable_id, ('0x' || substr(sha256(event_id || '|' || event_type), 1, 8))::BIGINT % 7 AS variant,
  lpad(((epoch_us(ts) // 1000) % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad(((epoch_us(ts) // 1000) % 3600000 // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS clock,
  coalesce(try_cast(nullif(regexp_extract(event_type || event_id % 13, '(\\d+)$', 1), '') AS INTEGER), 999) AS suffix, round(greatest(-96, least(0, 20 * log10(value / 1000))), 1) AS db FROM events""")
def f_scalars(spark, sf):
    ms = epoch_ms("ts") % 3600000
    e = table(spark, sf, "events")
    return e.select("event_id", sc.stable_id(F.col("event_id"), F.col("event_type")).alias("stable_id"), sc.variant(F.col("event_id"), F.col("event_type"), of=7).alias("variant"), sc.clock(ms).alias("clock"), sc.numeric_suffix(F.concat("event_type", (F.col("event_id") % 13).cast("string"))).alias("suffix"), sc.decibels(F.col("value") / 1000).alias("db"))
