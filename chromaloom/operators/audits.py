"""Data-quality gates over the catalogue: each returns the offending rows, none if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import FILTER_TYPES
from ..functions.geometry import MAX_U, MIN_U, pxu_to_px
from .catalog import live
from .iterate import above, checkpoint


def no_master(projects: DataFrame, images: DataFrame) -> DataFrame:
    """(id): projects with live images but no live master."""
    own = live(images)
    p = projects.select("id")
    has = p.join(own, p["id"] == own["project_id"], "left_semi")
    master = own.filter("kind = 'master'")
    return has.join(master, has["id"] == master["project_id"], "left_anti")


def multi_active(images: DataFrame) -> DataFrame:
    """(project_id, n): projects with more than one active live image."""
    return live(images).filter("is_active").groupBy("project_id").agg(F.count("*").alias("n")).filter("n > 1")


def dangling_source(images: DataFrame) -> DataFrame:
    """(project_id, id, source_image_id): live images whose source is no row at all."""
    ids = images.select(F.col("id").alias("__s"))
    return live(images).filter("source_image_id is not null").join(ids, F.col("source_image_id") == F.col("__s"), "left_anti").select("project_id", "id", "source_image_id")


def cross_project_source(images: DataFrame) -> DataFrame:
    """(id, project_id, source_project_id): live images whose live source is of another project."""
    src = live(images).select(F.col("id").alias("__s"), F.col("project_id").alias("source_project_id"))
    return live(images).join(src, F.col("source_image_id") == F.col("__s")).filter("project_id <> source_project_id").select("id", "project_id", "source_project_id")


def source_cycles(images: DataFrame) -> DataFrame:
    """(project_id, id): live images that lie on a cycle of source links, or lead into one.

    Links are doubled: after a round they reach twice as far. One that still leads somewhere after more steps
    than there are links goes round for ever, so log2 of their number is enough rounds."""
    own = live(images).select("project_id", "id", "source_image_id")
    links = own.select("id", F.col("source_image_id").alias("up")).filter("up is not null").distinct()
    links = checkpoint(links.join(own.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"))
    n, reach = links.count(), 1
    while reach <= n and not links.isEmpty():
        further = links.select(F.col("id").alias("up"), F.col("up").alias("further"))
        links, reach = checkpoint(links.join(further, "up").select("id", F.col("further").alias("up")).distinct()), reach * 2
    return own.join(links, "id", "left_semi").select("project_id", "id")


def unreachable_active(images: DataFrame) -> DataFrame:
    """(project_id, id): active live images that no live master of their project leads to, by however many links."""
    own = live(images)
    links = own.filter("source_image_id is not null").select("id", F.col("source_image_id").alias("up"))
    masters = own.filter("kind = 'master'").select("project_id", F.col("id").alias("stop"))
    led = above(links, masters.select(F.col("stop").alias("id"))).join(masters, "stop").select("project_id", "id")
    return own.filter("is_active").select("project_id", "id").join(led, ["project_id", "id"], "left_anti")


def state_binding(images: DataFrame, states: DataFrame) -> DataFrame:
    """(rule, project_id, image_id): several active masters; an active master without state; a state without image."""
    masters = live(images).filter("kind = 'master' and is_active")
    several = masters.groupBy("project_id").count().filter("count > 1").select(F.lit("several_active_masters").alias("rule"), "project_id", F.lit(None).cast(images.schema["id"].dataType).alias("image_id"))
    bare = masters.select("project_id", F.col("id").alias("image_id")).join(states, ["project_id", "image_id"], "left_anti").select(F.lit("master_without_state").alias("rule"), "project_id", "image_id")
    ids = images.select(F.col("id").alias("image_id"))
    orphan = states.join(ids, "image_id", "left_anti").select(F.lit("orphan_state").alias("rule"), "project_id", "image_id")
    return several.unionByName(bare).unionByName(orphan)


def filter_binding(filters: DataFrame, images: DataFrame) -> DataFrame:
    """(rule, id, project_id): bad type; several filters of a project (id null); lost images; other project's images."""
    i = images.select(F.col("id").alias("__i"), F.col("project_id").alias("__ip"))
    o = images.select(F.col("id").alias("__o"), F.col("project_id").alias("__op"))
    joined = filters.join(i, F.col("input_image_id") == F.col("__i"), "left").join(o, F.col("output_image_id") == F.col("__o"), "left")
    lost = F.col("__i").isNull() | F.col("__o").isNull()
    foreign = ~lost & ((F.col("__ip") != F.col("project_id")) | (F.col("__op") != F.col("project_id")))
    rules = F.array_compact(F.array(F.when(~F.coalesce(F.col("filter_type").isin(*FILTER_TYPES), F.lit(False)), "bad_type"), F.when(lost, "missing_image"), F.when(foreign, "cross_project")))
    rows = joined.select(F.explode(rules).alias("rule"), "id", "project_id")
    many = filters.groupBy("project_id").count().filter("count > 1").select(F.lit("several_filters").alias("rule"), F.lit(None).cast(filters.schema["id"].dataType).alias("id"), "project_id")
    return rows.unionByName(many)


def recipe_sums(components: DataFrame) -> DataFrame:
    """(recipe_id, total): shares that do not sum to 99.5..100.5; a sum of nought is let pass."""
    sums = components.groupBy("recipe_id").agg(F.coalesce(F.sum("share_pct"), F.lit(0)).alias("total"))
    return sums.filter("total <> 0 and (total < 99.5 or total > 100.5)")


def check_rows(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for each named rule that a row breaks. As in a CHECK, a rule that is null holds."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(True)), name) for name, c in rules.items())))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def image_rules() -> dict[str, Column]:
    """CHECK rules of an image row; crop_rect_px is JSON text."""
    rect = F.col("crop_rect_px")
    side = {k: F.get_json_object(rect, f"$.{k}") for k in "xywh"}
    keys = F.json_object_keys(rect)
    number = {k: v.try_cast("decimal(20,4)") for k, v in side.items()}
    shape = keys.isNotNull() & (F.sort_array(keys) == F.array(*map(F.lit, "hwxy")))
    none = rect.isNull()
    return {
        "crop_shape": none | F.coalesce(shape, F.lit(False)),
        "crop_whole": none | F.coalesce(sum(((n % 1 != 0).cast("int") for n in number.values()), F.lit(0)) == 0, F.lit(False)),
        "crop_least": none | F.coalesce((number["x"] >= 0) & (number["y"] >= 0) & (number["w"] >= 10) & (number["h"] >= 10), F.lit(False)),
        "crop_needs_source": none | F.col("source_image_id").isNotNull(),
        "master_has_source": (F.col("kind") != "master") | F.col("source_image_id").isNull(),
        "needs_source": (F.col("kind") == "master") | F.col("source_image_id").isNotNull(),
        "size": (F.col("width_px") > 0) & (F.col("height_px") > 0),
        "bytes": F.col("file_size_bytes") >= 0,
    }


def workspace_rules() -> dict[str, Column]:
    """CHECK rules of a workspace row: ranges, colour, and cached pixels equal to the exact sizes."""
    u = {c: F.col(f"{c}_px_u").try_cast("long") for c in ("width", "height")}
    pads = [F.col(f"padding_{s}_px_u").try_cast("long") for s in ("top", "right", "bottom", "left")]
    return {
        "size_range": (u["width"] >= MIN_U) & (u["width"] <= MAX_U) & (u["height"] >= MIN_U) & (u["height"] <= MAX_U),
        "padding_range": F.lit(True) & (F.least(*pads) >= 0) & (F.greatest(*pads) <= MAX_U),
        "cached_px": (F.col("width_px") == pxu_to_px(u["width"])) & (F.col("height_px") == pxu_to_px(u["height"])),
        "page_color": F.col("page_bg_color").rlike("^#([0-9a-fA-F]{6})$"),
        "page_opacity": (F.col("page_bg_opacity") >= 0) & (F.col("page_bg_opacity") <= 100),
        "value": (F.col("width_value") > 0) & (F.col("height_value") > 0),
    }


def state_rules() -> dict[str, Column]:
    return {"axis_pair": F.col("x_px_u").isNull() == F.col("y_px_u").isNull()}


def chip_rules() -> dict[str, Column]:
    return {"hex": F.col("hex").rlike("^#[0-9A-Fa-f]{6}$"), "index": F.col("palette_index") >= 0, "rgb": (F.least("rgb_r", "rgb_g", "rgb_b") >= 0) & (F.greatest("rgb_r", "rgb_g", "rgb_b") <= 255)}


def variant_rules() -> dict[str, Column]:
    return {
        "price": F.col("price_eur") >= 0,
        "price_pair": F.col("price_eur").isNull() == F.col("price_updated_at").isNull(),
        "size": F.col("size_ml") > 0,
        "stock": F.col("stock_count") >= 0,
        "weight": F.col("weight_g") > 0,
    }


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) that occur more than once; as in a UNIQUE rule, keys with a null never clash."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
