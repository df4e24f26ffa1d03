"""Reports: phase timings, flaky tests, trace parameters, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import INNER_FILTERS
from ..functions.text import normalize_error

# Keys of old trace parameters, and the pattern sizes that strengths stand for.
LEGACY_KEYS = ("texture_enabled", "texture_strength", "dither_pattern_size")
PATTERN_STRENGTH = {2: 0.25, 4: 0.5, 8: 0.75, 16: 1.0}
DITHER_MODES = ("none", "knoll_yliluoma", "floyd_steinberg", "texture")

# Trace parameters as name -> (default, least, most) for numbers or (default, choices) for words.
_SHARED = {
    "color_mode": ("color", ("color", "bw")),
    "num_colors": (16, 2, 560),
    "pre_snap_chroma_scale": (1.0, 1.0, 1.5),
    "dither_mode": ("knoll_yliluoma", DITHER_MODES),
    "dither_strength": (0.5, (0.25, 0.5, 0.75, 1.0)),
    "distance_metric": ("oklab", ("oklab", "ciede2000")),
    "palette_restriction": ("top_n", ("top_n", "pam")),
}
PARAMS = {
    "pixelate": {"supercell_width_mm": (6.0, 4.0, None), "supercell_height_mm": (6.0, 4.0, None), **_SHARED},
    "circulate": {
        "outer_width_mm": (6.0, 1.0, None), "outer_height_mm": (6.0, 1.0, None), "inner_enabled": ("false", ("false", "true")), "inner_width_mm": (3.0, 1.0, None), "inner_height_mm": (3.0, 1.0, None),
        "spacing_left_mm": (0.0, 0.0, None), "spacing_right_mm": (0.0, 0.0, None), "spacing_top_mm": (0.0, 0.0, None), "spacing_bottom_mm": (0.0, 0.0, None),
        "contour_width_mm": (0.2, 0.0, None), "inner_filter": ("darker", tuple(INNER_FILTERS)), **_SHARED,
    },
    "linerate": {
        "line_thickness": (1.0, 0.1, 10.0), "flatten": (0.25, 0.0, 1.0), "detail": (0.75, 0.0, 1.0), "smoothness": (0.6, 0.0, 1.0), "radius": (0.333, 0.0, 1.0), "num_colors": (32, 2, 560),
        "palette_restriction": ("top_n", ("top_n", "pam")), "min_paintable_mm": (4.0, 0.0, 20.0), "color_mode": ("color", ("color", "bw")), "resolution": (2, (1, 2, 4)),
        "flatten_algo": ("l0", ("l0", "edge_preserving")), "sigma_s": (57.0, 1.0, 200.0), "sigma_r": (0.23, 0.01, 1.0), "ep_flag": ("recurs", ("recurs", "normconv")),
    },
}
# Old words for a resolution in megapixels.
RESOLUTION_WORDS = {"low": 1, "medium": 2, "high": 4}


def phase_medians(runs: DataFrame) -> DataFrame:
    """(phase, median): upper median of each phase over runs with a 'name=ms,...' header, and of their total.

    The upper median is element n div 2 of the sorted list. Equal values are counted first; a phase's values are
    summed in buckets of a binary logarithm, and only the bucket that holds the median is ranked, so that no task has
    all of a phase. Parts that are not name=number are left out."""
    parts = runs.select("run_id", F.explode(F.split("header", ",")).alias("p"))
    name, ms = F.trim(F.substring_index("p", "=", 1)), F.element_at(F.split("p", "="), -1).try_cast("double")
    parts = parts.select("run_id", name.alias("phase"), ms.alias("ms")).filter("ms is not null and phase <> ''")
    total = parts.groupBy("run_id").agg(F.sum("ms").alias("ms")).select(F.lit("total").alias("phase"), "ms")
    counts = parts.select("phase", "ms").unionByName(total).groupBy("phase", "ms").agg(F.count("*").alias("n"))
    # monotonic: negative values, zero, and 64 buckets to each doubling of the positive ones
    fine = F.when(F.col("ms") > 0, F.floor(F.log2(F.greatest(F.col("ms"), F.lit(1e-300))) * 64)).when(F.col("ms") == 0, -(1 << 40)).otherwise(-(1 << 41))
    counts = counts.withColumn("bucket", fine.cast("long"))
    sizes = counts.groupBy("phase", "bucket").agg(F.sum("n").alias("m"))
    upto = Window.partitionBy("phase").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumns({"upto": F.sum("m").over(upto), "every": F.sum("m").over(Window.partitionBy("phase"))})
    sizes = sizes.withColumn("place", F.floor(F.col("every") / 2)).filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("m") <= F.col("place")))
    own = counts.join(sizes.select("phase", "bucket", (F.col("upto") - F.col("m")).alias("before"), "place"), ["phase", "bucket"])
    upto = F.sum("n").over(Window.partitionBy("phase").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    return own.withColumn("upto", upto).filter("upto > place").groupBy("phase").agg(F.min("ms").alias("median"))


def flaky_summary(results: DataFrame, most: int, most_rate: float) -> DataFrame:
    """(n_specs, n_flaky, rate, breach): a spec is flaky if some retry of it passed. results: (spec_id, status, retry)."""
    specs = results.groupBy("spec_id").agg(F.bool_or((F.col("status") == "passed") & (F.col("retry") > 0)).alias("flaky"))
    out = specs.agg(F.count("*").alias("n_specs"), F.count_if(F.coalesce("flaky", F.lit(False))).alias("n_flaky"))
    rate = F.coalesce(F.try_divide(F.col("n_flaky"), F.col("n_specs")), F.lit(0.0))
    return out.withColumn("rate", rate).withColumn("breach", (F.col("n_flaky") > most) | (F.col("rate") > most_rate))


def _at(key: str) -> Column:
    return F.get_json_object("params", f"$.{key}")


def params_census(traces: DataFrame) -> DataFrame:
    """(texture_legacy, ky_legacy, double_state): grid traces in three old shapes, which overlap."""
    own = traces.filter(F.col("kind").isin("pixelate", "circulate"))
    texture = F.coalesce(_at("texture_enabled") == "true", F.lit(False))
    ky = (_at("dither_mode") == "knoll_yliluoma") & _at("dither_pattern_size").isNotNull() & ~texture
    both = texture & (_at("dither_mode") != "none")
    return own.agg(F.count_if(texture).alias("texture_legacy"), F.count_if(F.coalesce(ky, F.lit(False))).alias("ky_legacy"), F.count_if(F.coalesce(both, F.lit(False))).alias("double_state"))


def migrate_params(traces: DataFrame) -> DataFrame:
    """traces whose params lose the old keys and gain dither_mode and dither_strength; other rows stay as they are.

    params: JSON text, an object. ``touched`` tells the rows that changed. Values keep their JSON form."""
    raw = F.from_json("params", "map<string,string>")
    old = F.arrays_overlap(F.json_object_keys("params"), F.array(*map(F.lit, LEGACY_KEYS))) & F.col("kind").isin("pixelate", "circulate")
    texture = F.coalesce(_at("texture_enabled") == "true", F.lit(False))
    mode = F.when(texture, "texture").otherwise(F.coalesce(_at("dither_mode"), F.lit("knoll_yliluoma")))
    size = F.coalesce(_at("dither_pattern_size").try_cast("int"), F.lit(4))
    strength = F.lit(0.5)
    for n, s in PATTERN_STRENGTH.items():
        strength = F.when(size == n, s).otherwise(strength)
    strength = F.when(texture, F.coalesce(_at("texture_strength").try_cast("double"), F.lit(0.5))).when(_at("dither_mode") == "knoll_yliluoma", strength).otherwise(0.5)
    gone = [*LEGACY_KEYS, "dither_mode", "dither_strength"]
    kept = F.map_filter(raw, lambda k, v: ~k.isin(*gone))
    new = F.map_concat(kept, F.create_map(F.lit("dither_mode"), mode, F.lit("dither_strength"), strength.cast("string")))
    # numbers, booleans and nested values stand as they are; text is quoted
    value = lambda v: F.when(v.rlike(r"^(-?\d+(\.\d+)?([eE][-+]?\d+)?|true|false|null|[\[{].*)$"), v).otherwise(F.to_json(F.struct(v.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.alias("v")))) - 6))
    pairs = F.transform(F.sort_array(F.map_entries(new)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), value(e["value"])))
    text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    touched = F.coalesce(old, F.lit(False))
    return traces.withColumn("touched", touched).withColumn("params", F.when(F.col("touched"), text).otherwise(F.col("params")))


def validate_params(traces: DataFrame, kind: str) -> DataFrame:
    """traces of a kind plus one column for each parameter, its default where it is missing, and problems: the
    names of those out of range, of the wrong type or not among the choices (their columns are null)."""
    out = traces.filter(F.col("kind") == kind)
    problems, columns = [], {}
    for name, rule in PARAMS[kind].items():
        raw, default = _at(name), rule[0]
        if name == "resolution":
            for word, mp in RESOLUTION_WORDS.items():
                raw = F.when(_at(name) == word, str(mp)).otherwise(raw)
        if isinstance(default, str):
            value = F.when(raw.isin(*rule[1]), raw)
        else:
            number = raw.try_cast("double")
            if len(rule) == 2:
                good = number.isin(*map(float, rule[1]))
            else:
                good = (number >= float(rule[1])) & (F.lit(True) if rule[2] is None else number <= float(rule[2]))
            if isinstance(default, int):
                good = good & (number == F.floor(number))
            value = F.when(good, number.cast("int" if isinstance(default, int) else "double"))
        columns[name] = F.when(raw.isNull(), F.lit(default)).otherwise(value)
        problems.append(F.when(raw.isNotNull() & value.isNull(), name))
    return out.withColumns({"problems": F.array_compact(F.array(*problems)), **columns})


def normalize_errors(errors: DataFrame) -> DataFrame:
    """errors (message, stage, ...) plus norm_stage, norm_message, title and retriable."""
    v = normalize_error(F.col("message"), F.col("stage"))
    return errors.withColumn("__v", v).select(*errors.columns, F.col("__v.stage").alias("norm_stage"), F.col("__v.message").alias("norm_message"), "__v.title", "__v.retriable")
