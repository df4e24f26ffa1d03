"""Grading, boxes, generators and decks."""

import pytest
from chromaloom.functions import text
from chromaloom.operators import learning
from chromaloom.streaming import srs
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("answer", "target", "want"),
    [
        ("perro", "el perro", "correct"), ("El Perro!", "el perro", "correct"), ("cafe", "café", "almost"), ("strasse", "die Straße", "almost"), ("hundt", "der Hund", "almost"),
        ("es", "su", "wrong"), ("", "a", "wrong"), (None, "a", "wrong"), ("a", None, "wrong"), ("etwas machen", "etw. machen; tun", "almost"), ("tun", "etw. machen; tun", "correct"), ("lehrer", "der Lehrer, -in", "correct"), ("gehen", "(zu Fuß) gehen", "correct"),
    ],
)
def test_grade(spark, answer, target, want):
    df = spark.createDataFrame([(answer, target)], "a string, t string")
    assert df.select(text.grade(F.col("a"), F.col("t"))).first()[0] == want


def test_boxes():
    assert [srs.moved(b, r) for b, r in ((5, "correct"), (1, "correct"), (4, "wrong"), (4, "almost"), (1, "almost"))] == [5, 2, 1, 2, 1]


def test_generator_is_the_published_one():
    draw = learning.generator(1)
    got = [draw() for _ in range(3)]
    assert all(0 <= x < 1 for x in got) and got == [(lambda d: [d() for _ in range(3)])(learning.generator(1))][0]
    assert sorted(learning.shuffled(range(20), learning.generator(7))) == list(range(20))


def test_shuffle_and_decks(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (1, []), (2, None)], "s long, l array<string>")
    rows = df.select(learning.seeded_shuffle(F.col("l"), F.col("s"))).collect()
    assert sorted(rows[0][0]) == ["a", "b", "c", "d"] and not rows[1][0] and not rows[2][0]
    items = spark.createDataFrame([("u", i) for i in range(12)], "user string, item_id int")
    boxes = spark.createDataFrame([("u", i, 5 if i % 2 else 2) for i in range(10)], "user string, item_id int, box int")
    deck = learning.mc_deck(items, boxes, 4).orderBy("place").collect()
    box = [dict((r.item_id, r.box) for r in boxes.collect()).get(r.item_id, 1) for r in deck]
    assert sorted(r.item_id for r in deck) == list(range(12)) and box == sorted(box)
    session = [r.item_id for r in learning.session_deck(items, boxes, 4).collect()]
    assert len(session) == len(set(session)) and {i for i in range(0, 12, 2)} | {11} <= set(session)


def test_choices(spark):
    items = spark.createDataFrame([(i, "noun" if i < 3 else "verb", f"w{i % 9}") for i in range(12)], "id int, kind string, answer string")
    for r in learning.build_choices(items, 3).join(items, "id").collect():
        assert len(r.options) == 5 == len(set(r.options)) and r.answer in r.options


def test_choices_come_from_the_whole_pool(spark):
    rows = [(i, "noun" if i % 2 else "verb", f"w{i}") for i in range(600)] + [(900 + i, "few", f"f{i % 3}") for i in range(6)] + [(1, "noun", "w1"), (990, None, "w1")]
    items = spark.createDataFrame(rows, "id int, kind string, answer string")
    got = learning.build_choices(items, 3).collect()
    kind, answer, options = {i: k for i, k, _ in rows}, {i: a for i, _, a in rows}, {r.id: list(r.options) for r in got}
    assert sorted(r.id for r in got) == sorted(i for i, _, _ in rows)
    offered = {x for i in range(600) for x in options[i] if x != answer[i]}
    assert len(offered) > 500 and len({frozenset(o) for o in options.values()}) > 550
    assert len({options[i].index(answer[i]) for i in range(600)}) == 5
    of_kind = {k: {a for _, k2, a in rows if k2 == k} for k in ("noun", "verb", "few")}
    for i, o in options.items():
        assert len(o) == len(set(o)) == 5 and answer[i] in o
        assert kind[i] is None or set(o) <= of_kind[kind[i]] or (kind[i] == "few" and of_kind["few"] <= set(o))
    assert learning.build_choices(items.limit(0), 3).count() == 0


def test_hints(spark):
    df = spark.createDataFrame([(1, "der Hund", "noun", "Tiere", "Ich sehe den Hund.", None, None, None), (2, "hablo", "conjugation", None, None, "hablar", "presente", "yo")], "id int, target string, kind string, topic string, sentence string, infinitive string, tense string, person string")
    one, two = (r.layers for r in learning.hints(df).orderBy("id").collect())
    assert one == ["Thema: Tiere · Nomen", "Artikel: der  ·  _ _ _   ·   _ _ _ _", "„Ich sehe den _____.“", "d _ _   _ _ _ _", "d e r   H _ _ _"]
    assert two[0] == "Verb-Konjugation" and two[-1] == "Infinitiv: hablar · presente · yo"


def test_hints_of_long_targets(spark):
    """Work grows with a target's length: 20,000 letters took minutes when each counted the letters before it."""
    import time

    long = spark.createDataFrame([("aé 😀_-" * 4000,), ("_ß1\t😀",), ("",), (None,)], "t string")
    start = time.monotonic()
    got = long.select(text.letter_reveal(F.col("t"), 0.5), text.length_mask(F.col("t"))).collect()
    assert time.monotonic() - start < 20
    assert got[0][0] == "   ".join(["a é", "😀 _ - a é"] + ["😀 _ - a é"] * 1998 + ["😀 _ - _ _"] * 2000 + ["😀 _ -"]) and got[0][1].count("   ·   ") == 4000
    assert [tuple(r) for r in got[1:]] == [("_ ß 1 \t 😀", "_ _ 1   ·   😀"), ("", ""), (None, None)]


def test_scores(spark):
    rows = [("u", 1, i, r, "noun") for i, r in enumerate(["correct"] * 4 + ["almost"] + ["wrong"] * 5 + ["correct"])]
    got = learning.score_answers(spark.createDataFrame(rows, "user string, run_id int, seq int, result string, kind string")).orderBy("seq").collect()
    assert [r.gain for r in got] == [10, 10, 10, 15, 0, 0, 0, 0, 0, 0] and got[-1].mistakes == 5 and got[-1].best_streak == 4 and [r.level for r in got][7:9] == [1, 2]


def test_accents_are_dropped_by_the_rule(spark):
    import re
    import unicodedata

    from chromaloom.functions import text

    words = ["őr", "Ǆ", "ǻ", "ễ", "й", "é", "straße", "Ångström", "ÿ", "한국", "ḱ", "ﬁ"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    got = {r.i: r.n for r in df.select("i", text.norm_loose(F.col("w")).alias("n")).collect()}
    for i, w in enumerate(words):
        plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", w.lower().replace("ß", "ss")))
        assert unicodedata.normalize("NFD", got[i]) == plain
    graded = spark.createDataFrame([("őr", "or")], "a string, t string").select(text.grade(F.col("a"), F.col("t")).alias("g")).first().g
    assert graded != "wrong"


def test_answers_streamed_in_triggers(spark, tmp_path):
    """Three triggers end where a replay of all answers ends; a user has one state at most, whatever the number of items."""
    from chromaloom.streaming import errors

    results = ("correct", "almost", "wrong", "correct", "correct")
    rows = [(u, None if i == 7 else i + 2**60, 10 * t + k, k, results[(u + i * 3 + t * 2 + k) % 5]) for t in range(3) for u in range(3) for i in range(5 + t, 9) for k in range(1 + (u + i) % 3)]
    schema = "user int, item_id long, at long, seq int, result string"
    for t in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 10 == t], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = srs.srs_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"))
    got = srs.latest(errors.run_to_table(stream, f"{tmp_path}/out", "update"))
    want = learning.replay_srs(spark.createDataFrame(rows, schema))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.schema == want.schema
    states = spark.read.format("statestore").load(f"{tmp_path}/out/checkpoint")
    assert 1 <= states.count() <= 3
