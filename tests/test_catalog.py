"""Lineage, audits, listings, reports and streams on small tables."""

import datetime

import pytest
from chromaloom.operators import audits, catalog, iterate, reports, storage
from chromaloom.sources import catalogue
from chromaloom.streaming import errors
from pyspark.sql import functions as F

IMAGE = "id string, project_id string, source_image_id string, kind string, is_active boolean, deleted_at timestamp, name string, storage_bucket string, storage_path string, created_at timestamp, updated_at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def images(spark, rows):
    return spark.createDataFrame([(i, p, s, k, a, d, i, None, f"path/{i}", T0, None) for i, p, s, k, a, d in rows], IMAGE)


@pytest.fixture(scope="module")
def tree(spark):
    return images(spark, [
        ("m", "p", None, "master", True, None), ("w", "p", "m", "working_copy", False, None), ("f", "p", "w", "filter_working_copy", False, None), ("x", "p", "gone", "trace_base", True, None),
        ("a", "q", "b", "trace_base", False, None), ("b", "q", "c", "trace_base", False, None), ("c", "q", "b", "trace_base", False, None), ("d", "q", "m", "working_copy", False, T0),
    ]).cache()


def test_audits(spark, tree):
    projects = spark.createDataFrame([("p",), ("q",), ("r",)], "id string")
    assert [r.id for r in audits.no_master(projects, tree).collect()] == ["q"]
    assert [(r.project_id, r.n) for r in audits.multi_active(tree).collect()] == [("p", 2)]
    assert [r.id for r in audits.dangling_source(tree).collect()] == ["x"]
    assert audits.cross_project_source(tree).count() == 0
    assert sorted(r.id for r in audits.source_cycles(tree).collect()) == ["a", "b", "c"]
    assert [r.id for r in audits.unreachable_active(tree).collect()] == ["x"]
    empty = tree.limit(0)
    assert audits.source_cycles(empty).count() == 0 and audits.unreachable_active(empty).count() == 0


def test_closure_is_idempotent(spark, tree):
    roots = spark.createDataFrame([("p", "m"), ("p", "none"), ("q", "b")], "project_id string, image_id string")
    got = catalog.delete_closure(tree, roots)
    assert {(r.root_id, r.id, r.depth) for r in got.collect()} == {("m", "m", 0), ("m", "w", 1), ("m", "f", 2), ("b", "b", 0), ("b", "a", 1), ("b", "c", 1)}
    again = catalog.delete_closure(tree, got.filter("root_id = 'm'").select("project_id", F.col("root_id").alias("image_id")))
    assert {r.id for r in again.collect()} == {"m", "w", "f"}


def test_backfill_twice_is_once(spark):
    own = images(spark, [("m", "p", None, "master", True, None), ("n", "q", None, "master", True, None), ("v", "q", "n", "working_copy", False, None)])
    states = spark.createDataFrame([("p", "m", "1", "2", "3", "4", 0), ("q", "n", "5", "6", "7", "8", 0), ("q", "v", "9", "9", "9", "9", 0)], "project_id string, image_id string, x_px_u string, y_px_u string, width_px_u string, height_px_u string, rotation_deg int")
    new, moved = catalog.backfill_working_copies(own, states)
    assert {(r.id, r.is_active) for r in new.collect()} == {("m", False), ("m:wc", True), ("n", False), ("v", True)}
    assert {(r.image_id, r.x_px_u) for r in moved.collect()} == {("m:wc", "1"), ("v", "9")}
    again, same = catalog.backfill_working_copies(new, moved)
    assert sorted(map(str, again.collect())) == sorted(map(str, new.collect())) and same.count() == 2


def test_upsert_keeps_axis(spark):
    kind = "project_id string, image_id string, x_px_u string, y_px_u string, width_px_u string, height_px_u string, rotation_deg int"
    old = spark.createDataFrame([("p", "i", "1", "2", "3", "4", 5)], kind)
    new = spark.createDataFrame([("p", "i", None, "9", "30", "40", 50, 1), ("p", "i", None, None, "31", "41", 51, 2), ("p", "j", "1", "1", "1", "1", 1, 1)], kind + ", at int")
    assert {tuple(r) for r in catalog.upsert_state(old, new).collect()} == {("p", "i", "1", "9", "31", "41", 51), ("p", "j", "1", "1", "1", "1", 1)}


@pytest.mark.parametrize(
    ("committed", "fresh", "want"),
    [
        (["a", "b"], ["a", "b"], "match"), (["a", "b"], ["a"], "pending_addition"), (["x,", "CREATE INDEX i1 ON t (a)"], ["x", 'CREATE UNIQUE INDEX "i1" ON t (b)'], "pending_redefinition"),
        (["a"], ["a", "b"], "drift"), (['ADD CONSTRAINT "c" CHECK (a)'], ['ADD CONSTRAINT "c" CHECK (b)', 'ADD CONSTRAINT "c" CHECK (d)'], "drift"),
    ],
)
def test_drift(spark, committed, fresh, want):
    def lines(x):
        return spark.createDataFrame(list(enumerate(x)), "pos int, line string")

    assert storage.classify_drift(lines(committed), lines(fresh)).first().kind == want


def test_listing(spark):
    names = ["a/1", "a/2", "a.txt", "b", "c/d/e", "z"]
    objects = spark.createDataFrame([("k", n, T0, T0) for n in names], "bucket_id string, name string, created_at timestamp, updated_at timestamp")
    assert [(r.name, r.is_folder) for r in storage.list_objects(objects, "k").collect()] == [("a.txt", False), ("a", True), ("b", False), ("c", True), ("z", False)]
    assert [r.name for r in storage.list_objects(objects, "k", "a/").collect()] == ["a/1", "a/2"]
    assert [r.name for r in storage.list_objects(objects, "k", ascending=False, limit=2).collect()] == ["z", "c"]
    assert [r.name for r in storage.list_objects(objects, "k", after="b").collect()] == ["c", "z"]


def test_params(spark):
    rows = [("pixelate", '{"texture_enabled":true,"name":"a \\"b\\""}'), ("linerate", '{"texture_enabled":true}'), ("circulate", None), ("pixelate", "{}")]
    got = reports.migrate_params(spark.createDataFrame(rows, "kind string, params string")).collect()
    assert [r.touched for r in got] == [True, False, False, False] and got[0].params == '{"dither_mode":"texture","dither_strength":0.5,"name":"a \\"b\\""}'
    own = reports.validate_params(spark.createDataFrame([("pixelate", '{"num_colors":1,"color_mode":"bw","dither_strength":0.75}')], "kind string, params string"), "pixelate").first()
    assert own.problems == ["num_colors"] and own.num_colors is None and own.color_mode == "bw" and own.dither_strength == 0.75 and own.supercell_width_mm == 6.0


def test_write_traces(spark, tmp_path):
    kind = "project_id int, kind string, at int, n int"
    path = f"file://{tmp_path}/t"
    catalogue.write_traces(spark.createDataFrame([(1, "a", 1, 10), (1, "a", 2, 11), (2, "b", 1, 12)], kind), path)
    out = catalogue.write_traces(spark.createDataFrame([(1, "a", 0, 20)], kind), path)
    assert {(r.project_id, r.kind, r.n) for r in out.collect()} == {(1, "a", 20), (2, "b", 12)}


def trace_files(tmp_path):
    return {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "data").rglob("*.parquet")}


def test_a_run_of_one_project_writes_one_bucket(spark, tmp_path):
    kind, path = "project_id int, kind string, at int, n int", f"file://{tmp_path}/t"
    first = catalogue.write_traces(spark.createDataFrame([(p, k, 1, p) for p in range(40) for k in "ab"], kind), path, 8)
    before = trace_files(tmp_path)
    out = catalogue.write_traces(spark.createDataFrame([(7, "a", 0, 700)], kind), path)
    new = set(trace_files(tmp_path)) - set(before)
    assert len({f.parent.parent for f in new}) == 1 and {f: t for f, t in trace_files(tmp_path).items() if f in before} == before
    assert {(r.project_id, r.kind): r.n for r in out.collect()} == {(p, k): 700 if (p, k) == (7, "a") else p for p in range(40) for k in "ab"}
    assert {r.n for r in first.collect()} == set(range(40))  # a reader of the version before sees it still
    assert catalogue.write_traces(spark.createDataFrame([], kind), path).count() == 80
    assert catalogue.read_traces(spark, f"file://{tmp_path}/none", out.schema).count() == 0


def test_half_written_versions_are_not_read(spark, tmp_path):
    kind, path = "project_id int, kind string, at int, n int", f"file://{tmp_path}/t"
    out = catalogue.write_traces(spark.createDataFrame([(1, "a", 1, 1)], kind), path)
    (tmp_path / "t" / "manifest" / f"{2:012}").write_text('{"0/64": "run=lo')
    assert [tuple(r) for r in catalogue.read_traces(spark, path, out.schema).collect()] == [(1, "a", 1, 1)]


def test_of_two_runs_at_once_the_second_builds_on_the_first(spark, tmp_path, monkeypatch):
    kind, path = "project_id int, kind string, at int, n int", f"file://{tmp_path}/t"
    catalogue.write_traces(spark.createDataFrame([(1, "a", 1, 1)], kind), path, 1)
    commit, met = catalogue._commit, []

    def late(spark_, path_, version, buckets):
        if not met:  # another run commits between our reading and our commit
            met.append(version)
            catalogue.write_traces(spark.createDataFrame([(2, "b", 1, 2)], kind), path_)
        commit(spark_, path_, version, buckets)

    monkeypatch.setattr(catalogue, "_commit", late)
    out = catalogue.write_traces(spark.createDataFrame([(3, "c", 1, 3)], kind), path)
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1, 1), (2, "b", 1, 2), (3, "c", 1, 3)]
    monkeypatch.setattr(catalogue, "_manifest", lambda *a: (0, {}))
    with pytest.raises(catalogue.Lost):
        catalogue.write_traces(spark.createDataFrame([(4, "c", 1, 3)], kind), path, 1)


def test_ties_within_a_run_are_decided_by_the_row(spark, tmp_path):
    rows = [(1, "a", 5, n) for n in range(20)]
    kind = "project_id int, kind string, at int, n int"
    got = {catalogue.write_traces(spark.createDataFrame(r, kind).repartition(p), f"file://{tmp_path}/{i}").first().n for i, (r, p) in enumerate([(rows, 1), (rows[::-1], 7)])}
    assert len(got) == 1


def test_unknown_paint_is_an_error(spark):
    paints = spark.createDataFrame([("1", "x", "PB1", "2.5")], catalogue.PAINTS)
    variants = spark.createDataFrame([("9", "35", "s", None, None)], catalogue.VARIANTS)
    with pytest.raises(Exception, match="unknown paint"):
        catalogue.load_catalogue(paints, variants)[1].collect()


def test_rate_limit(spark):
    hits = [("a", t, i) for i, t in enumerate([0, 10, 20, 100, 101, 130, 205])] + [(None, 5, 1), ("b", 5, 1)]
    got = {(r.key, r.t): r.limited for r in errors.rate_limit(spark.createDataFrame(hits, "key string, t long, seq int"), 2, 100).collect()}
    assert [got["a", t] for t in (0, 10, 20, 100, 101, 130, 205)] == [False, False, True, True, False, False, False] and not got[None, 5] and not got["b", 5]


def test_rate_limit_of_a_stream(spark, tmp_path):
    """Three triggers give what a batch gives, for null and large keys too; states are buckets of keys, and go."""
    keys = [None, *(2**60 + k for k in range(40))]
    hits = [(key, 3000 * t + 3000 + 50 * (i % 7) + j * (20 + i), j) for t in range(3) for i, key in enumerate(keys) for j in range(1 + i % 5) if (i + t) % 3]
    for t in range(3):
        spark.createDataFrame([h for h in hits if h[1] // 3000 == t + 1], "key long, t long, seq int").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, t long, seq int").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    stream = errors.rate_limit_stream(stream.select("key", F.timestamp_millis("t").alias("at"), "seq"), 2, 100, "1 second", buckets=5)
    got = errors.run_to_table(stream, f"{tmp_path}/out").drop("batch")
    want = errors.rate_limit(spark.createDataFrame(hits, "key long, t long, seq int"), 2, 100)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema == want.schema
    states = lambda batch: spark.read.format("statestore").option("batchId", batch).load(f"{tmp_path}/out/checkpoint")
    assert states(0).count() == 5 and {r.key for r in want.collect() if r.t // 3000 == 1} == {as_key(k) for r in states(0).collect() for k in r.value.groupState.key}
    assert all(begun >= 6000 for r in states(2).collect() for begun in r.value.groupState.begun)


def as_key(text):
    return int(text[1:]) if text else None


def test_sanitize(spark):
    bodies = ['{"message":"m","name":5,"tags":{"a":1},"extra":[1],"digest":"x"}', "[1]", '{"message":""}', None, '{"message":"' + "y" * 40000 + '"}']
    got = errors.sanitize_events(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [r.problem for r in got] == [None, "missing_message", "missing_message", "invalid_json", "too_large"]
    assert (got[0].name, got[0].tags, got[0].extra, got[0].digest) == (None, '{"a":1}', "[1]", None)


def test_suites_of_any_depth_are_read(spark):
    import json

    from chromaloom.sources import events

    def suite(depth):
        spec = {"title": f"spec{depth}", "tests": [{"results": [{"status": "passed", "retry": depth}]}]}
        return {"title": f"s{depth}", "specs": [spec], "suites": [suite(depth - 1)] if depth > 1 else []}

    reports = spark.createDataFrame([(d, json.dumps({"suites": [suite(d)]})) for d in (1, 4, 5, 9)], "report_id int, body string")
    got = {(r.report_id, r.spec_id, r.title, r.retry) for r in events.read_test_report(reports).collect()}
    want = {(d, ".".join(["0"] * (d - i + 1)) + "#0", " > ".join([*(f"s{k}" for k in range(d, i - 1, -1)), f"spec{i}"]), i) for d in (1, 4, 5, 9) for i in range(1, d + 1)}
    assert got == want
    shallow = events.read_test_report(reports.filter("report_id <= 4"))
    assert "Union" not in shallow._jdf.queryExecution().optimizedPlan().toString()  # levels of one parse are read together


def test_lineage_deeper_than_any_cap(spark):
    """A chain of 80 images: all of it is below its master, and its end can be reached."""
    own = images(spark, [("i000", "p", None, "master", False, None)] + [(f"i{k:03}", "p", f"i{k - 1:03}", "working_copy", k == 79, None) for k in range(1, 80)])
    got = catalog.delete_closure(own, spark.createDataFrame([("p", "i000")], "project_id string, image_id string"))
    assert {(r.id, r.depth) for r in got.collect()} == {(f"i{k:03}", k) for k in range(80)}
    assert audits.unreachable_active(own).count() == 0
    assert [r.id for r in audits.unreachable_active(own.filter("id <> 'i040'")).collect()] == ["i079"]


def test_a_chain_of_ten_thousand_takes_few_jobs(spark):
    n = 10_000
    links = spark.range(1, n).select("id", (F.col("id") - 1).alias("up"))
    group = "ten thousand"
    spark.sparkContext.setJobGroup(group, group)
    got = iterate.above(links, spark.range(1).union(spark.range(7000, 7001)))
    assert got.count() == n + 3000 and got.filter("depth <> id - stop").count() == 0
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 400


@pytest.mark.parametrize("seed", range(3))
def test_ways_up_by_brute_force(spark, seed):
    """Random forests with cycles, links to nothing, stops above stops and stops on cycles."""
    import random

    rng = random.Random(seed)
    up = {i: rng.randrange(60) if rng.random() < 0.3 else i - 1 - rng.randrange(3) for i in range(50)}
    stops = set(rng.sample(range(55), 9))
    want = {}
    for i in {*up, *stops}:
        at, depth = i, 0
        while at is not None and depth <= 120:
            if at in stops:
                want.setdefault((i, at), depth)
            at, depth = up.get(at), depth + 1
    links = spark.createDataFrame([*up.items(), (3, None)], "id int, up int")
    got = iterate.above(links, spark.createDataFrame([(s,) for s in stops] * 2, "id int")).collect()
    assert {(r.id, r.stop): r.depth for r in got} == want and len(got) == len(want)
    assert iterate.above(links, spark.createDataFrame([], "id int")).count() == 0


def brute_chain(start, rows):
    at, step, out = start, 0, {}
    for i, o, fid in sorted(((i, o, f) for f, i, o in rows), key=lambda r: r[2]):
        if at is not None and i == at and o is not None:
            step += 1
            out[fid], at = step, o
    return out


@pytest.mark.parametrize("seed", range(3))
def test_filter_chain_by_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    rows = {p: [(f"f{k:02}", f"n{rng.randrange(5)}", f"n{rng.randrange(5)}" if rng.random() < 0.9 else None) for k in range(40)] for p in ("p", "q", "none")}
    filters = spark.createDataFrame([(f"{p}-{f}", p, i, o) for p, l in rows.items() for f, i, o in l], "id string, project_id string, input_image_id string, output_image_id string")
    own = images(spark, [("n0", "p", None, "working_copy", True, None), ("n3", "q", None, "working_copy", True, None), ("n1", "p", "n0", "filter_working_copy", False, None)])
    got = {r.filter_id: r for r in catalog.filter_chain(filters, own).collect()}
    assert len(got) == 120
    for p, start in (("p", "n0"), ("q", "n3"), ("none", None)):
        want = brute_chain(start, rows[p])
        assert {f: got[f"{p}-{f}"].step for f, _, _ in rows[p]} == {f: want.get(f) for f, _, _ in rows[p]}
        assert [f for f, _, _ in rows[p] if got[f"{p}-{f}"].tip] == [f for f in want if want[f] == max(want.values())]
        assert all(got[f"{p}-{f}"].output_missing == (not (p == "p" and o == "n1")) for f, _, o in rows[p])


def test_places_over_ranges(spark):
    from chromaloom.operators.iterate import numbered

    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), (F.col("id") % 3).alias("b"))
    got = [(r.a, r.place) for r in numbered(rows, ["a", "b"], "place").collect()]
    assert [a for a, _ in sorted(got, key=lambda r: r[1])] == sorted(a for a, _ in got) and sorted(p for _, p in got) == list(range(1, 5001))
    assert numbered(rows.limit(0), ["a"], "place").count() == 0


def test_phase_medians_by_brute_force(spark):
    import random

    rng = random.Random(1)
    runs = [(i, ",".join([f"a={rng.choice([0, -2, 1.5, rng.random() * 100])}", f"b={rng.randrange(5)}", "c=x", "d"][: rng.randrange(1, 5)])) for i in range(301)]
    got = {r.phase: r.median for r in reports.phase_medians(spark.createDataFrame(runs, "run_id int, header string")).collect()}
    lists = {"total": []}
    for _, h in runs:
        own = [(p.split("=")[0], float(p.split("=")[1])) for p in h.split(",") if "=" in p and p[0] != "c"]
        for k, v in own:
            lists.setdefault(k, []).append(v)
        lists["total"].append(sum(v for _, v in own))
    assert got == {k: pytest.approx(sorted(v)[len(v) // 2]) for k, v in lists.items()}


def test_late_hits_are_counted():
    class Query:
        recentProgress = [{"stateOperators": [{"numRowsDroppedByWatermark": 2}]}, {"stateOperators": []}, {"stateOperators": [{"numRowsDroppedByWatermark": 3}]}]

    assert errors.late_hits(Query()) == 5
