"""Queries over the renderings of a page image: resampling, contrast, sharpness, the fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscan import dictionaries as D
from tillscan.operators import decode as C
from tillscan.operators import images as I
from tillscan.plans import rendered as R
from tillscan.plans.registry import query


def _sample(i: str) -> str:
    """A level from two columns of ``part`` and a place."""
    return f"((p_partkey * 7 + p_size * 3 + ({i}) * 31 + ({i}) * ({i}) * 17) % 256)"


def _images(spark, sf_dir, width: str, height: str):
    """Gray images of the given sizes, one for each part."""
    places = F.expr(f"transform(sequence(0, ({width}) * ({height}) - 1), i -> format_string('%02x', cast({_sample('i')} AS int)))")
    return R.spread(R.table(spark, sf_dir, "part")).select(
        "p_partkey", F.expr(f"int({width})").alias("width"), F.expr(f"int({height})").alias("height"),
        F.unhex(F.array_join(places, "")).alias("pixels"),
    )


def _levels(images):
    """(p_partkey, width, height, levels): samples as numbers with commas."""
    levels = F.transform(F.sequence(F.lit(1), F.length("pixels")), lambda i: F.conv(F.hex(F.substr("pixels", i, F.lit(1))), 16, 10))
    return images.select("p_partkey", "width", "height", F.array_join(levels, ",").alias("levels"))


_WIDE = "7 + p_partkey % 30"
_WEIGHT = "CASE WHEN x = 0 THEN 1 WHEN abs(x) < 3 THEN 3 * sin(pi() * x) * sin(pi() * x / 3) / (pi() * x * pi() * x) ELSE 0 END"


@query(
    f"""
WITH s AS (SELECT p_partkey, p_size, {_WIDE} AS w FROM part),
sized AS (SELECT *, CASE WHEN w <= 20 THEN w ELSE floor(w * (20.0::DOUBLE / w))::INT END AS n FROM s),
rows AS (SELECT *, unnest(range(n)) AS i, w::DOUBLE / n AS scale FROM sized),
taps AS (
  SELECT *, unnest(range(greatest(floor((i + 0.5) * scale - 3 * scale + 0.5), 0)::INT,
    least(floor((i + 0.5) * scale + 3 * scale + 0.5), w)::INT)) AS j FROM rows WHERE n < w
),
raw AS (SELECT *, (j - (i + 0.5) * scale + 0.5) / scale AS x, {_sample("j")} AS v FROM taps),
weighed AS (SELECT *, {_WEIGHT} AS k FROM raw),
fixed AS (SELECT *, floor(k / sum(k) OVER (PARTITION BY p_partkey, i) * 4194304 + 0.5)::BIGINT AS f FROM weighed),
made AS (
  SELECT p_partkey, i, greatest(0, least(255, (sum(f * v) + 2097152) // 4194304)) AS v FROM fixed GROUP BY ALL
  UNION ALL SELECT p_partkey, i, {_sample("i")} FROM rows WHERE n = w
)
SELECT p_partkey, n AS width, 1 AS height, string_agg(v::VARCHAR, ',' ORDER BY i) AS levels FROM made JOIN sized USING (p_partkey) GROUP BY p_partkey, n
"""
)
def image_resampled(spark, sf_dir):
    """Rows of pixels under a longest side, by sums over the rows of the kernel."""
    return _levels(I.transform_images(_images(spark, sf_dir, _WIDE, "1"), I.limited(20)))


_NINE = [_sample(str(i)) for i in range(9)]


@query(
    f"""
WITH v AS (SELECT p_partkey, [{", ".join(_NINE)}] AS v FROM part),
m AS (SELECT *, floor(list_sum(v) / 9.0::DOUBLE + 0.5) AS mean FROM v)
SELECT p_partkey, 3 AS width, 3 AS height,
  array_to_string(list_transform(v, lambda x: greatest(0, least(255, floor((10 * mean + 23 * (x - mean)) / 10 + 0.00001)))::INT), ',') AS levels FROM m
"""
)
def image_contrast(spark, sf_dir):
    """The contrast of I2: about the mean, cut to the range."""
    return _levels(I.transform_images(_images(spark, sf_dir, "3", "3"), I.contrasted(D.CONTRAST_FACTOR)))


@query(
    f"""
WITH v AS (SELECT p_partkey, [{", ".join(_NINE)}] AS v FROM part),
m AS (SELECT *, floor((list_sum(v) + 4 * v[5]) / 13.0::DOUBLE + 0.5)::INT AS smooth FROM v)
SELECT p_partkey, 3 AS width, 3 AS height,
  array_to_string([CASE WHEN i = 5 THEN greatest(0, least(255, 2 * v[5] - smooth)) ELSE v[i] END FOR i IN range(1, 10)], ',') AS levels FROM m
"""
)
def image_sharpness(spark, sf_dir):
    """The sharpness of I2: twice as far from the smoothed pixel; the border has no neighbours to be smoothed by."""
    return _levels(I.transform_images(_images(spark, sf_dir, "3", "3"), I.sharpened(D.SHARPNESS_FACTOR)))


_TURNS = ", ".join(f"({i}, '{suffix}', {str(turn in (90, 270)).lower()})" for i, (turn, suffix) in enumerate(D.VARIANT_TURNS))
_NAMES = ", ".join(f"({i}, '{name}')" for i, name in enumerate(D.VARIANT_NAMES))


@query(
    f"""
WITH p AS (
  SELECT s_suppkey, (5 + s_suppkey % 7)::INT AS w, (4 + s_suppkey % 5)::INT AS h, s_suppkey % 256 AS r, s_suppkey * 7 % 256 AS g, s_suppkey * 13 % 256 AS b FROM supplier
),
gray AS (SELECT *, (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 AS y FROM p),
v AS (
  SELECT *, t.i * 8 + n.i AS pos, n.name || '-' || t.suffix AS variant,
    CASE WHEN turned THEN h ELSE w END * CASE WHEN n.i BETWEEN 2 AND 5 THEN 2 ELSE 1 END AS width,
    CASE WHEN turned THEN w ELSE h END * CASE WHEN n.i BETWEEN 2 AND 5 THEN 2 ELSE 1 END AS height,
    CASE n.i WHEN 3 THEN CASE WHEN y > 172 THEN 255 ELSE 0 END WHEN 5 THEN CASE WHEN y > 150 THEN 255 ELSE 0 END ELSE y END AS level
  FROM gray, (VALUES {_TURNS}) t(i, suffix, turned), (VALUES {_NAMES}) n(i, name)
)
SELECT s_suppkey, pos::INT AS variant_pos, variant, CASE WHEN name IN ('cropped', 'small') THEN 3 ELSE 1 END AS channels, width, height,
  md5(CASE WHEN name IN ('cropped', 'small') THEN repeat(format('{{:02x}}{{:02x}}{{:02x}}', r, g, b), width * height)
    ELSE repeat(format('{{:02x}}', level), width * height) END) AS digest
FROM v
"""
)
def image_variants(spark, sf_dir):
    """The 32 renderings of pages of one colour, named, sized and in the order of trying."""
    w, h = F.expr("int(5 + s_suppkey % 7)"), F.expr("int(4 + s_suppkey % 5)")
    colour = F.concat(*[F.format_string("%02x", ((F.col("s_suppkey") * k) % 256).cast("int")) for k in (1, 7, 13)])
    pages = R.spread(R.table(spark, sf_dir, "supplier")).select(
        "s_suppkey", w.alias("width"), h.alias("height"), F.unhex(F.repeat(colour, w * h)).alias("pixels")
    )
    out = I.image_variants(pages, "s_suppkey")
    return out.withColumn("digest", F.md5(F.lower(F.hex("pixels")).cast("binary"))).drop("pixels")


@query(
    f"""
SELECT p_partkey, CASE WHEN p_partkey % 7 > 1 THEN 3 END::INT AS width, CASE WHEN p_partkey % 7 > 1 THEN 3 END::INT AS height,
  CASE WHEN p_partkey % 7 > 1 THEN {" || ".join(f"repeat(format('{{:02x}}', {v}), 3)" for v in _NINE)} END AS pixels,
  CASE WHEN p_partkey % 7 <= 1 THEN 'No se pudo leer la imagen.' END AS message
FROM part
"""
)
def image_files(spark, sf_dir):
    """Files written as PNG or PNM, decoded again; damaged ones and other files are errors."""
    images = _images(spark, sf_dir, "3", "3")
    key = F.col("p_partkey")
    png = C.encode_images(images, "p_partkey")
    pnm = images.select(key, F.concat(F.lit(b"P5 # gray\n3 3\n255\n"), F.col("pixels")).alias("pnm"))
    size = F.length("content")
    broken = F.concat(F.substr("content", F.lit(1), size - 20), F.lit(b"\x00"), F.substr("content", size - 18, F.lit(19)))
    content = F.when(key % 7 == 0, broken).when(key % 7 == 1, F.lit(b"no image")).when(key % 2 == 0, F.col("pnm")).otherwise(F.col("content"))
    # A stated number of parts: the join's own are few where files are small, and decoding is far more work.
    n = images.rdd.getNumPartitions()
    files = png.repartition(n, "p_partkey").join(pnm.repartition(n, "p_partkey"), "p_partkey")
    files = files.select("p_partkey", content.alias("content"))
    out = C.decode_images(files, "p_partkey")
    return out.select("p_partkey", "width", "height", F.lower(F.hex("pixels")).alias("pixels"), "message")
