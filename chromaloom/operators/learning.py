"""Learning runs: grading, scoring, Leitner boxes, statistics, decks and choices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

MOST_BOX, MOST_MISTAKES, CARDS_A_LEVEL, BASE_POINTS, CONJUGATION_POINTS = 5, 5, 8, 10, 5
OPTIONS, TYPED_FROM = 5, 3
#: Tests whose totals are sent to every task.
MOST_TESTS = 100_000


def combo(streak: Column) -> Column:
    """Factor of a streak as it was before the answer."""
    return F.when(streak >= 10, 3.0).when(streak >= 6, 2.0).when(streak >= 3, 1.5).otherwise(1.0)


def score_answers(answers: DataFrame) -> DataFrame:
    """(user, run_id, seq, result, kind) plus streak, gain, score, best_streak, level and mistakes.

    Streaks run between answers that are not correct; gains use the streak before the answer; answers after
    the fifth mistake are left out. seq is unique in a run."""
    run = Window.partitionBy("user", "run_id").orderBy("seq")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    right = F.col("result") == "correct"
    df = answers.withColumn("mistakes", F.sum((F.col("result") == "wrong").cast("int")).over(upto))
    df = df.withColumn("__before", F.col("mistakes") - (F.col("result") == "wrong").cast("int")).filter(F.col("__before") < MOST_MISTAKES)
    df = df.withColumn("__island", F.sum((~right).cast("int")).over(upto))
    stretch = Window.partitionBy("user", "run_id", "__island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("streak", F.sum(right.cast("int")).over(stretch))
    points = F.lit(BASE_POINTS) + F.when(F.col("kind") == "conjugation", CONJUGATION_POINTS).otherwise(0)
    df = df.withColumn("gain", F.when(right, F.floor(points * combo(F.col("streak") - 1) + 0.5)).otherwise(0))
    index = F.row_number().over(run) - 1
    df = df.withColumns({"score": F.sum("gain").over(upto), "best_streak": F.max("streak").over(upto), "level": (F.floor(index / CARDS_A_LEVEL) + 1).cast("int")})
    return df.drop("__before", "__island")


def replay_srs(answers: DataFrame) -> DataFrame:
    """(user, item_id, box, seen, correct) after all answers in order of (at, seq): a fold for each item.

    Correct moves up to box 5 at most, wrong falls to box 1, almost to box 2 at most."""
    own = answers.groupBy("user", "item_id").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "result"))).alias("l"))
    start = F.struct(F.lit(1).alias("box"), F.lit(0).alias("seen"), F.lit(0).alias("correct"))

    def step(s: Column, x: Column) -> Column:
        box = F.when(x["result"] == "correct", F.least(F.lit(MOST_BOX), s["box"] + 1)).when(x["result"] == "wrong", 1).otherwise(F.least(s["box"], F.lit(2)))
        return F.struct(box.alias("box"), (s["seen"] + 1).alias("seen"), (s["correct"] + (x["result"] == "correct").cast("int")).alias("correct"))

    return own.withColumn("s", F.aggregate("l", start, step)).select("user", "item_id", "s.box", "s.seen", "s.correct")


def test_stats(items: DataFrame, srs: DataFrame) -> DataFrame:
    """(user, test_id, total, practiced, mastered, accuracy) for each learner and test: items (test_id, item_id)."""
    users = srs.select("user").distinct()
    totals = items.groupBy("test_id").agg(F.count("*").alias("total"))
    got = items.join(srs, "item_id").groupBy("user", "test_id").agg(
        F.sum((F.col("seen") > 0).cast("int")).alias("practiced"), F.sum((F.col("box") >= MOST_BOX).cast("int")).alias("mastered"), F.sum("seen").alias("s"), F.sum("correct").alias("c")
    )
    few = totals.limit(MOST_TESTS + 1).count() <= MOST_TESTS  # else Spark finds its own way for the grid
    out = users.crossJoin(F.broadcast(totals) if few else totals).join(got, ["user", "test_id"], "left")
    return out.select("user", "test_id", "total", F.coalesce("practiced", F.lit(0)).alias("practiced"), F.coalesce("mastered", F.lit(0)).alias("mastered"), F.when(F.col("s") > 0, F.col("c") / F.col("s")).alias("accuracy"))


def run_stats(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """(user, test_id, runs, best_score, last_at) for each pair of grid; pairs without a run have 0, 0 and null."""
    got = runs.groupBy("user", "test_id").agg(F.count("*").alias("runs"), F.greatest(F.lit(0), F.max("score")).alias("best_score"), F.max("at").alias("last_at"))
    return grid.join(got, ["user", "test_id"], "left").select("user", "test_id", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("best_score", F.lit(0)).alias("best_score"), "last_at")


def learner_summary(srs: DataFrame, runs: DataFrame) -> DataFrame:
    """(user, answered, accuracy, mastered, runs, last_at) of every learner with entries or runs."""
    a = srs.groupBy("user").agg(F.sum("seen").alias("answered"), F.sum("correct").alias("c"), F.sum((F.col("box") >= MOST_BOX).cast("int")).alias("mastered"))
    b = runs.groupBy("user").agg(F.count("*").alias("runs"), F.max("at").alias("last_at"))
    out = a.join(b, "user", "full_outer")
    return out.select("user", F.coalesce("answered", F.lit(0)).alias("answered"), F.when(F.col("answered") > 0, F.col("c") / F.col("answered")).alias("accuracy"), F.coalesce("mastered", F.lit(0)).alias("mastered"), F.coalesce("runs", F.lit(0)).alias("runs"), "last_at")


def high_scores(runs: DataFrame) -> DataFrame:
    """(user, score, seq): each learner's best run over 0, the first of equals; seq is the order of storing."""
    best = runs.filter("score > 0").groupBy("user").agg(F.min(F.struct((-F.col("score")).alias("s"), "seq")).alias("b"))
    return best.select("user", (-F.col("b.s")).alias("score"), F.col("b.seq").alias("seq"))


def cap_runs(runs: DataFrame, most: int = 500) -> DataFrame:
    """The newest ``most`` runs of each learner, by (at, seq)."""
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("at"), F.desc("seq")))
    return runs.withColumn("__rank", place).filter(F.col("__rank") <= most).drop("__rank")


def generator(seed: int):
    """Published 32-bit generator (mulberry32): a function that gives the next number in 0..1."""
    a = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal a
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = (a ^ (a >> 15)) * (a | 1) & 0xFFFFFFFF
        t = ((t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        return (t ^ (t >> 14)) / 4294967296

    return draw


def shuffled(items: list, draw) -> list:
    """Fisher-Yates from the end."""
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def shuffled_places(n: pd.Series, seed: pd.Series) -> pd.Series:
    """For each row, 0..n-1 in the seed's order."""
    return pd.Series([np.array(shuffled(range(int(k)), generator(int(s))), np.int32) for k, s in zip(n, seed, strict=True)])


def seeded_shuffle(array: Column, seed: Column) -> Column:
    """An array in the seed's order; the same seed gives the same order."""
    return F.transform(shuffled_places(F.coalesce(F.size(array), F.lit(0)), seed), lambda i: F.get(array, i))


@F.pandas_udf(T.DoubleType())
def first_draw(seed: pd.Series) -> pd.Series:
    """The seed's first number."""
    return pd.Series([generator(int(s))() for s in seed])


def mc_deck(items: DataFrame, srs: DataFrame, seed: int) -> DataFrame:
    """(user, place, item_id): all items of a learner, shuffled and then stably sorted by box (1 if unknown)."""
    own = items.select("user", "item_id").join(srs.select("user", "item_id", "box"), ["user", "item_id"], "left")
    lists = own.groupBy("user").agg(F.sort_array(F.collect_list(F.struct("item_id", F.coalesce("box", F.lit(1)).alias("box")))).alias("l"))
    order = lists.select("user", F.posexplode(seeded_shuffle(F.col("l"), F.lit(seed))).alias("rank", "x"))
    place = F.row_number().over(Window.partitionBy("user").orderBy("x.box", "rank"))
    return order.select("user", place.alias("place"), F.col("x.item_id").alias("item_id"))


def session_deck(items: DataFrame, srs: DataFrame, seed: int) -> DataFrame:
    """(user, place, item_id): boxes under 4 always, box 4 at odds of .8 and box 5 of .5; all where none is left;
    shuffled with the same generator."""

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame, draw = frame.sort_values("item_id"), generator(seed)
        odds = np.where(frame["box"] >= 5, 0.5, np.where(frame["box"] >= 4, 0.8, 1.0))
        chosen = [i for i, p in zip(frame["item_id"], odds, strict=True) if draw() < p]
        deck = shuffled(chosen or list(frame["item_id"]), draw)
        return pd.DataFrame({"user": key[0], "place": np.arange(1, len(deck) + 1), "item_id": deck})

    own = items.select("user", "item_id").join(srs.select("user", "item_id", "box"), ["user", "item_id"], "left").fillna({"box": 1})
    kind = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    return own.groupBy("user").applyInPandas(build, f"user {kind['user']}, place int, item_id {kind['item_id']}")


@F.pandas_udf(T.ArrayType(T.LongType()))
def drawn_places(n: pd.Series, k: pd.Series, seed: pd.Series) -> pd.Series:
    """For each row, the first k of 0..n-1 in the seed's order (all, if n is less), without listing the others."""

    def draws(n: int, k: int, seed: int) -> list[int]:
        draw, moved, out = generator(seed), {}, []
        for i in range(min(n, k)):
            j = i + int(draw() * (n - i))
            out.append(moved.get(j, j))
            moved[j] = moved.get(i, i)
        return out

    return pd.Series([draws(int(a), int(b), int(s)) for a, b, s in zip(n, k, seed, strict=True)])


def _numbered(texts: DataFrame) -> DataFrame:
    """Distinct (list, answer) -> (list, answer, pos): places from 0 in each list, counted in buckets of a hash."""
    texts = texts.withColumn("bucket", F.conv(F.substring(F.md5("answer"), 1, 3), 16, 10).cast("int"))
    sizes = texts.groupBy("list", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("list").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("list", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("list", "bucket").orderBy("answer"))
    return texts.join(sizes, ["list", "bucket"]).select("list", "answer", (F.col("before") + place - 1).alias("pos"))


def build_choices(items: DataFrame, seed: int) -> DataFrame:
    """(id, options): the answer and four other texts, drawn for each item from all distinct texts of its type, and
    from the whole list where the type has too few, in an order of the item's own.

    items: (id, kind, answer). Texts are numbered once; each item draws seeded places and fetches them by a join,
    so the whole pool is open to every item and no item meets all others. Repeated rows have the same options."""
    every = F.lit("*")  # the whole list; a type's list begins with "=" or is "", without a type
    rows = items.withColumn("list", F.coalesce(F.concat(F.lit("="), F.col("kind").cast("string")), F.lit("")))
    rows = rows.groupBy("id", "list", "answer").agg(F.count("*").alias("times"))
    known = rows.filter("answer is not null")
    texts = _numbered(known.select("list", "answer").distinct().union(known.select(every, "answer").distinct()))
    sizes = texts.groupBy("list").agg(F.count("*").alias("n"))
    whole = sizes.filter(F.col("list") == every).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_all"))
    df = rows.join(sizes, "list", "left").crossJoin(F.broadcast(whole)).withColumn("n", F.coalesce("n", F.lit(0)))
    named = F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), "list", "answer")
    df = df.withColumn("own", F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long"))
    # one place more than needed, as the item's own text may be drawn; of the whole list also for its type's others
    near = drawn_places(F.col("n"), F.lit(OPTIONS), F.col("own"))
    far = drawn_places(F.col("n_all"), F.when(F.col("n") < OPTIONS, 2 * OPTIONS).otherwise(0), F.col("own") + 1)
    df = df.withColumns({"near": near, "far": far})
    near = F.transform("near", lambda x, i: F.struct(i.alias("no"), F.col("list").alias("from"), x.alias("at")))
    far = F.transform("far", lambda x, i: F.struct((i + OPTIONS).alias("no"), every.alias("from"), x.alias("at")))
    df = df.select("id", "answer", "list", "times", "own", F.explode_outer(F.concat(near, far)).alias("x"))
    found = texts.select(F.col("list").alias("__list"), F.col("pos").alias("__pos"), F.col("answer").alias("text"))
    df = df.join(found, (F.col("x.from") == F.col("__list")) & (F.col("x.at") == F.col("__pos")), "left")
    df = df.groupBy("id", "list", "answer", "times", "own").agg(F.sort_array(F.collect_list(F.struct("x.no", "text"))).alias("l"))
    others = F.array_distinct(F.filter(F.col("l.text"), lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("answer"))))
    options = F.concat(F.array("answer"), F.slice(others, 1, OPTIONS - 1))
    df = df.select("id", seeded_shuffle(options, F.col("own") + 2).alias("options"), "times")
    return df.select("id", "options", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")


def pick_mode(cards: DataFrame, seed: int) -> DataFrame:
    """cards (index, level, es, de) plus direction and mode: typed from level 3 on, single words only, at odds
    that rise with the level."""
    way = F.when(first_draw(F.lit(seed) + F.col("index") * 7919) < 0.5, "es-de").otherwise("de-es")
    df = cards.withColumn("direction", way)
    target = F.when(F.col("direction") == "es-de", F.col("de")).otherwise(F.col("es"))
    odds = F.when(F.col("level") >= 5, 0.85).when(F.col("level") == 4, 0.7).when(F.col("level") == 3, 0.5).otherwise(0.0)
    typed = (F.col("level") >= TYPED_FROM) & text.is_single_word(target) & (first_draw(F.lit(seed) + F.col("index") * 40503 + 17) < odds)
    return df.withColumn("mode", F.when(typed, "type").otherwise("choice"))


def hints(items: DataFrame) -> DataFrame:
    """(id, layers): hints from vague to strong. items: (id, target, kind, topic, sentence, infinitive, tense, person)."""
    kind = F.lit(text.TYPE_WORDS["other"])
    for name, word in text.TYPE_WORDS.items():
        kind = F.when(F.col("kind") == name, word).otherwise(kind)
    target = F.col("target")
    topic = F.when(F.coalesce(F.col("topic"), F.lit("")) != "", F.concat(F.lit("Thema: "), F.col("topic"), F.lit(" · "), kind)).otherwise(kind)
    article = text.article_of(target)
    shape = F.concat_ws("  ·  ", F.when(article.isNotNull(), F.concat(F.lit("Artikel: "), article)), text.length_mask(target))
    example = F.when(F.col("sentence").isNotNull(), F.concat(F.lit("„"), text.blank_word(F.col("sentence"), target), F.lit("“")))
    grammar = F.concat_ws(" · ", *(F.nullif(F.col(c), F.lit("")) for c in ("infinitive", "tense", "person")))
    last = F.when(F.col("kind") != "conjugation", text.letter_reveal(target, 0.5)).when(grammar != "", F.concat(F.lit("Infinitiv: "), grammar))
    return items.select("id", F.array_compact(F.array(topic, shape, example, text.letter_reveal(target, 0.0), last)).alias("layers"))
