"""The project catalogue: dashboard, trace sources, recipes, lineage, and upkeep of images and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import checkpoint, above

#: Image kinds in the order in which rows may be deleted, filters before all of them.
DELETE_ORDER = ("trace_output", "trace_base", "filter_working_copy", "working_copy", "master")
DEFAULT_BUCKET = "project_images"


def live(images: DataFrame) -> DataFrame:
    return images.filter(F.col("deleted_at").isNull())


def _newest(df: DataFrame, keys: list[str], *more) -> DataFrame:
    """The newest row of each key: by updated_at, else created_at; ties to the least id."""
    at = F.coalesce("updated_at", "created_at")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*more, F.desc_nulls_last(at), "id"))
    return df.withColumn("__rank", place).filter("__rank = 1").drop("__rank")


def dashboard(projects: DataFrame, images: DataFrame, workspaces: DataFrame, states: DataFrame, limit: int = 100) -> DataFrame:
    """The newest projects with their master image, artboard and that master's state.

    (id, title, updated_at, status_label, size_label, has_thumbnail, artboard_w, artboard_h, rotation_deg)."""
    top = projects.orderBy(F.desc_nulls_last("updated_at"), "id").limit(limit)
    master = images.filter("kind = 'master'").groupBy(F.col("project_id").alias("p")).agg(F.min(F.struct("id", "file_size_bytes")).alias("m"))
    state = states.select(F.col("project_id").alias("sp"), F.col("image_id").alias("si"), "rotation_deg")
    ws = workspaces.select(F.col("project_id").alias("wp"), F.col("width_px").alias("artboard_w"), F.col("height_px").alias("artboard_h"))
    out = top.join(master, top["id"] == F.col("p"), "left").join(ws, top["id"] == F.col("wp"), "left")
    out = out.join(state, (top["id"] == F.col("sp")) & (F.col("m.id") == F.col("si")), "left")
    kb = F.floor(F.coalesce(F.col("m.file_size_bytes"), F.lit(0)) / 1024 + 0.5).cast("string")
    return out.select(
        top["id"], top["name"].alias("title"), top["updated_at"], F.when(top["status"] == "completed", "Completed").alias("status_label"),
        F.when(F.col("m.id").isNotNull(), F.concat(kb, F.lit(" kb"))).alias("size_label"), F.col("m.id").isNotNull().alias("has_thumbnail"), "artboard_w", "artboard_h", "rotation_deg",
    )


def display_target(images: DataFrame) -> DataFrame:
    """(project_id, target_id, working_id): the image to show, a filter's copy before a plain working copy; and
    the newest plain working copy."""
    rows = live(images).filter(F.col("kind").isin("filter_working_copy", "working_copy"))
    best = _newest(rows, ["project_id", "kind"])
    return best.groupBy("project_id").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "filter_working_copy", F.col("id"))), F.max(F.when(F.col("kind") == "working_copy", F.col("id")))).alias("target_id"),
        F.max(F.when(F.col("kind") == "working_copy", F.col("id"))).alias("working_id"),
    )


def trace_source(projects: DataFrame, images: DataFrame, filters: DataFrame, asked: DataFrame) -> DataFrame:
    """(project_id, source_id): the live image asked for, else the filter's live output, else the newest working
    copy, else the active master. asked: (project_id, image_id)."""
    own = live(images)
    ids = own.select(F.col("project_id").alias("p"), F.col("id").alias("i"))

    def named(df: DataFrame, column: str, name: str) -> DataFrame:
        hit = df.join(ids, (df["project_id"] == F.col("p")) & (df[column] == F.col("i")))
        return hit.groupBy(F.col("p").alias("project_id")).agg(F.min("i").alias(name))

    working = _newest(own.filter("kind = 'working_copy'"), ["project_id"]).select("project_id", F.col("id").alias("w"))
    master = own.filter("kind = 'master' and is_active").groupBy("project_id").agg(F.min("id").alias("m"))
    out = projects.select(F.col("id").alias("project_id"))
    for df in (named(asked, "image_id", "a"), named(filters, "output_image_id", "f"), working, master):
        out = out.join(df, "project_id", "left")
    return out.select("project_id", F.coalesce("a", "f", "w", "m").alias("source_id"))


def recipe_book(recipes: DataFrame, components: DataFrame, paints: DataFrame, munsell: DataFrame, custom: DataFrame) -> DataFrame:
    """(recipe_id, target, parts): each recipe's target chip, munsell or custom, and 'share% paint' by position.
    Recipes with both targets or none are left out."""
    good = recipes.filter(F.col("lab_munsell_id").isNull() != F.col("lab_custom_id").isNull())
    m = munsell.select(F.col("id").alias("mi"), F.col("notation").alias("mn"))
    c = custom.select(F.col("id").alias("ci"), F.col("notation").alias("cn"))
    target = good.join(m, F.col("lab_munsell_id") == F.col("mi"), "left").join(c, F.col("lab_custom_id") == F.col("ci"), "left")
    part = components.join(paints.select(F.col("id").alias("paint_id"), F.col("name").alias("paint")), "paint_id")
    text = F.concat(F.col("share_pct").cast("int").cast("string"), F.lit("% "), F.col("paint"))
    lists = part.groupBy("recipe_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", text.alias("t")))), lambda x: x["t"]), ", ").alias("parts"))
    return target.select(F.col("id").alias("recipe_id"), F.coalesce("mn", "cn").alias("target")).join(lists, "recipe_id", "left")


def keyed_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, side, changed): keys only in a (left) or b (right), and those whose columns differ (both), with
    the names of the columns that do."""
    left = a.select(F.col(key).alias("ka"), *(F.col(c).alias(f"a_{c}") for c in columns))
    right = b.select(F.col(key).alias("kb"), *(F.col(c).alias(f"b_{c}") for c in columns))
    j = left.join(right, F.col("ka") == F.col("kb"), "full_outer")
    side = F.when(F.col("kb").isNull(), "left").when(F.col("ka").isNull(), "right").otherwise("both")
    changed = F.concat_ws(",", *(F.when((F.col("ka").isNotNull() & F.col("kb").isNotNull()) & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in columns))
    return j.select(F.coalesce("ka", "kb").alias(key), side.alias("side"), changed.alias("changed")).filter("side <> 'both' or changed <> ''")


def filter_chain(filters: DataFrame, images: DataFrame) -> DataFrame:
    """(project_id, filter_id, step, tip, output_missing): the chain from a project's working image, in row order.

    filters: (id, project_id, input_image_id, output_image_id), ids unique. From the newest working copy, the next row
    in id order that takes the image so far is the next step. Rows off the chain have a null step; tip marks the last
    one. Each row's successor is found by one window over images, and steps are counted by doubling the links, so that
    a project's rows are never one group and a chain of n rows takes log2(n) rounds.
    """
    rows = filters.select("project_id", F.col("id").alias("filter_id"), F.col("input_image_id").alias("i"), F.col("output_image_id").alias("o"))
    able = rows.filter("o is not null")
    start = display_target(images).filter("working_id is not null").select("project_id", F.col("working_id").alias("image"), F.lit(None).cast(filters.schema["id"].dataType).alias("asks"), F.lit(None).cast(filters.schema["id"].dataType).alias("takes"))
    asks = able.select("project_id", F.col("o").alias("image"), F.col("filter_id").alias("asks"), F.lit(None).cast(filters.schema["id"].dataType).alias("takes"))
    takes = able.filter("i is not null").select("project_id", F.col("i").alias("image"), F.lit(None).cast(filters.schema["id"].dataType).alias("asks"), F.col("filter_id").alias("takes"))
    # of an image's rows in id order: the first that takes it after the one that makes it (the start comes first)
    line = Window.partitionBy("project_id", "image").orderBy(F.coalesce("asks", "takes").asc_nulls_first(), F.col("takes").asc_nulls_last())
    met = start.union(asks).union(takes).withColumn("next", F.first("takes", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)))
    met = checkpoint(met.filter("takes is null and next is not null and (asks is null or next > asks)").select("project_id", "asks", "next"))
    jumps = met.filter("asks is not null").select("project_id", F.col("asks").alias("filter_id"), "next")
    known, reach = checkpoint(met.filter("asks is null").select("project_id", F.col("next").alias("filter_id"), F.lit(1).alias("step"))), 1
    while not jumps.isEmpty():
        found = known.join(jumps, ["project_id", "filter_id"]).select("project_id", F.col("next").alias("filter_id"), (F.col("step") + reach).alias("step"))
        known = checkpoint(known.union(found))
        further = jumps.select("project_id", F.col("filter_id").alias("next"), F.col("next").alias("further"))
        jumps, reach = checkpoint(jumps.join(further, ["project_id", "next"]).select("project_id", "filter_id", F.col("further").alias("next"))), reach * 2
    last = known.groupBy("project_id").agg(F.max("step").alias("last"))
    there = live(images).filter("kind = 'filter_working_copy'").select("project_id", F.col("id").alias("o"), F.lit(True).alias("there")).distinct()
    out = rows.join(known, ["project_id", "filter_id"], "left").join(last, "project_id", "left").join(there, ["project_id", "o"], "left")
    tip = F.coalesce(F.col("step") == F.col("last"), F.lit(False))
    return out.select("project_id", "filter_id", "step", tip.alias("tip"), F.col("there").isNull().alias("output_missing"))


def delete_closure(images: DataFrame, roots: DataFrame) -> DataFrame:
    """(project_id, root_id, id, depth, storage_bucket, storage_path): live images below each live root, itself
    included, within its project. roots: (project_id, image_id). An image met twice keeps its least depth."""
    own = live(images).select("project_id", "id", "source_image_id", "storage_bucket", "storage_path")
    key = lambda c: F.struct("project_id", F.col(c).alias("id"))
    there = own.select(key("id").alias("up"))
    links = own.filter("source_image_id is not null").select(key("id").alias("id"), key("source_image_id").alias("up")).join(there, "up", "left_semi")
    start = roots.select("project_id", F.col("image_id").alias("id")).distinct().join(own, ["project_id", "id"], "left_semi")
    found = above(links, start.select(key("id").alias("id"))).select("id.project_id", F.col("stop.id").alias("root_id"), "id.id", F.col("depth").cast("int").alias("depth"))
    return found.join(own.drop("source_image_id"), ["project_id", "id"]).select("project_id", "root_id", "id", "depth", "storage_bucket", "storage_path")


def delete_plan(images: DataFrame, filters: DataFrame) -> DataFrame:
    """(project_id, step, what, n_rows, bucket): how many rows of a project with a live master go in each step, in the
    order in which they may; image steps are counted for each bucket. delete_paths has the files."""
    doomed = live(images).filter("kind = 'master'").select("project_id").distinct()
    f = filters.join(doomed, "project_id").groupBy("project_id").agg(F.count("*").alias("n_rows"))
    f = f.select("project_id", F.lit(0).alias("step"), F.lit("filters").alias("what"), "n_rows", F.lit(None).cast("string").alias("bucket"))
    i = delete_paths(images).groupBy("project_id", "step", "what", "bucket").agg(F.count("*").alias("n_rows"))
    return f.unionByName(i)


def delete_paths(images: DataFrame) -> DataFrame:
    """(project_id, step, what, bucket, path): one row for each stored image that delete_plan counts."""
    doomed = live(images).filter("kind = 'master'").select("project_id").distinct()
    order = F.lit(None).cast("int")
    for i, kind in enumerate(DELETE_ORDER):
        order = F.when(F.col("kind") == kind, i + 1).otherwise(order)
    i = images.join(doomed, "project_id").withColumn("step", order).filter("step is not null")
    return i.select("project_id", "step", F.col("kind").alias("what"), F.coalesce("storage_bucket", F.lit(DEFAULT_BUCKET)).alias("bucket"), F.col("storage_path").alias("path"))


def backfill_working_copies(images: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with a working copy for each live master whose project has none; states re-anchored to it).

    A new copy's id is the master's id with ':wc'. A state of a live master moves to the project's working copy,
    where that has none yet. The master is no longer active; the copy is, unless another live image is.
    """
    own = live(images)
    has = own.filter("kind = 'working_copy'").select("project_id").distinct()
    new = own.filter("kind = 'master'").join(has, "project_id", "left_anti")
    new = new.select(*(
        F.concat(F.col("id"), F.lit(":wc")).alias("id") if c == "id" else F.lit("working_copy").alias("kind") if c == "kind" else F.col("id").alias("source_image_id") if c == "source_image_id"
        else F.concat(F.coalesce("name", F.lit("image")), F.lit(" (working copy)")).alias("name") if c == "name" else F.lit(False).alias("is_active") if c == "is_active" else F.col(c) for c in images.columns
    ))
    every = images.unionByName(new)
    copies = live(every).filter("kind = 'working_copy'").groupBy("project_id").agg(F.min("id").alias("__copy"))
    tip = live(every).filter("is_active and kind in ('filter_working_copy', 'trace_output')").select("project_id", F.lit(True).alias("__tip")).distinct()
    out = every.join(copies, "project_id", "left").join(tip, "project_id", "left")
    alive = F.col("deleted_at").isNull() & F.col("__copy").isNotNull()
    active = F.when(alive & (F.col("kind") == "master"), False).when(alive & (F.col("id") == F.col("__copy")) & F.col("__tip").isNull(), True).otherwise(F.col("is_active"))
    out = out.withColumn("is_active", active).select(*images.columns)
    masters = own.filter("kind = 'master'").select(F.col("id").alias("__m"))
    moved = states.join(masters, states["image_id"] == F.col("__m"), "left").join(copies, "project_id", "left")
    moves = F.col("__m").isNotNull() & F.col("__copy").isNotNull()
    moved = moved.withColumns({"__new": moves.cast("int"), "image_id": F.when(moves, F.col("__copy")).otherwise(F.col("image_id"))})
    place = F.row_number().over(Window.partitionBy("project_id", "image_id").orderBy("__new", "__m"))
    moved = moved.withColumn("__rank", place).filter("__rank = 1")
    return out, moved.select(*states.columns)


def rebuild_active(images: DataFrame, activations: DataFrame) -> DataFrame:
    """images with is_active true for the one live image of each project named by its latest activation.

    activations: (project_id, image_id, at). Those of images that are not live, or of another project, are ignored;
    a project without any keeps its flags. Ties of time go to the larger image id."""
    ids = live(images).select("project_id", F.col("id").alias("image_id"))
    last = activations.join(ids, ["project_id", "image_id"]).groupBy("project_id").agg(F.max(F.struct("at", "image_id")).alias("l"))
    out = images.join(last, "project_id", "left")
    active = F.when(F.col("l").isNotNull() & F.col("deleted_at").isNull(), F.col("id") == F.col("l.image_id")).otherwise(F.col("is_active"))
    return out.withColumn("is_active", active).select(*images.columns)


def upsert_state(states: DataFrame, updates: DataFrame) -> DataFrame:
    """States after updates in order of ``at``: a null axis keeps the old value, the rest is replaced.

    Both: (project_id, image_id, x_px_u, y_px_u, width_px_u, height_px_u, rotation_deg); updates also have at.
    Folded as the last value that is not null for each axis, the last row for the rest."""
    keep, replace = ("x_px_u", "y_px_u"), ("width_px_u", "height_px_u", "rotation_deg")
    old = states.withColumn("at", F.lit(None).cast(updates.schema["at"].dataType)).withColumn("__new", F.lit(0))
    both = old.unionByName(updates.withColumn("__new", F.lit(1)))
    order = F.struct("__new", "at")
    return both.groupBy("project_id", "image_id").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in keep),
        *(F.max_by(c, order).alias(c) for c in replace),
    )
