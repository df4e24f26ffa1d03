"""Leitner boxes kept up to date by a stream of answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .errors import as_it_was, never_null

MOST_BOX = 5
#: Groups of users that a stream keeps as one state each. States do not end, so there are more of them than of a limiter's.
BUCKETS = 16384


def moved(box: int, result: str) -> int:
    """The box after an answer."""
    if result == "correct":
        return min(MOST_BOX, box + 1)
    return 1 if result == "wrong" else min(box, 2)


def srs_stream(answers: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(user, item_id, box, seen, correct) of each item answered in a trigger, update mode. answers: (user, item_id,
    at, seq, result); within a trigger answers are taken in order of (at, seq).

    Users are dealt into buckets by hash; a bucket's items are one state, so a trigger costs at most a call for each
    bucket, not one for each item."""
    kinds = {f.name: f.dataType.simpleString() for f in answers.schema.fields}

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decks = {(user, item): entry for user, item, *entry in zip(*state.get, strict=True)} if state.exists else {}
        frame, answered = pd.concat(list(frames)).sort_values(["at", "seq"]), {}
        for user, item, result in zip(frame["user"].tolist(), frame["item_id"].tolist(), frame["result"].tolist(), strict=True):
            box, seen, correct = decks.get((user, item), (1, 0, 0))
            decks[user, item] = answered[user, item] = (moved(box, result), seen + 1, correct + (result == "correct"))
        state.update(tuple(map(list, zip(*((*names, *entry) for names, entry in decks.items()), strict=True))))
        yield pd.DataFrame([(*names, *entry) for names, entry in answered.items()], columns=["user", "item_id", "box", "seen", "correct"])

    own = answers.select(never_null("user").alias("user"), never_null("item_id").alias("item_id"), "at", "seq", "result")
    own = own.withColumn("bucket", F.pmod(F.xxhash64("user"), F.lit(buckets)))
    schema, held = "user string, item_id string, box int, seen int, correct int", "user array<string>, item_id array<string>, box array<int>, seen array<int>, correct array<int>"
    out = own.groupBy("bucket").applyInPandasWithState(run, schema, held, "update", GroupStateTimeout.NoTimeout)
    return out.withColumns({name: as_it_was(name, kinds[name]) for name in ("user", "item_id")})


def latest(updates: DataFrame) -> DataFrame:
    """The last state of each item among all updates a stream has written."""
    last = updates.groupBy("user", "item_id").agg(F.max(F.struct("seen", "box", "correct")).alias("l"))
    return last.select("user", "item_id", F.col("l.box").alias("box"), F.col("l.seen").alias("seen"), F.col("l.correct").alias("correct"))
