"""Error streams: cleaning, rate limits, alerts; each also runs on a batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Lengths to which text fields are cut (null: kept whole), the largest body, and alert limits.
TEXT_FIELDS = {"schemaVersion": None, "timestamp": None, "message": 4000, "stack": 16000, "name": 200, "scope": 50, "code": 100, "stage": 100, "severity": None}
NESTED_FIELDS = ("context", "tags", "extra")
MOST_BYTES, ALERT_MESSAGE, ALERT_CONTEXT = 32 * 1024, 600, 800
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
# Marks of severities.
MARKS = {"error": "🔴", "warn": "🟡"}
MOST_HITS, WINDOW_MS = 60, 60_000
#: Groups of keys that a stream keeps as one state each. A call costs some milliseconds, as much as thousands of rows.
BUCKETS = 4096


def sanitize_events(events: DataFrame, body: str = "body") -> DataFrame:
    """events plus problem and the fields of their JSON body: text cut to length, a digest only if it is a UUID, nested
    values as JSON text. problem: too_large, invalid_json, missing_message, or null for an event that is taken.

    A field of another type than its own is left out. Works on streams and batches alike."""
    v = F.try_parse_json(body)

    def typed(key: str) -> tuple[Column, Column]:
        x = F.try_variant_get(v, f"$.{key}", "variant")
        return F.schema_of_variant(x), x

    out: dict[str, Column] = {}
    for key, most in TEXT_FIELDS.items():
        kind, x = typed(key)
        text = F.when(kind == "STRING", F.try_variant_get(x, "$", "string"))
        out[key] = F.substring(text, 1, most) if most else text
    kind, x = typed("digest")
    digest = F.when(kind == "STRING", F.try_variant_get(x, "$", "string"))
    out["digest"] = F.when(digest.rlike(UUID), digest)
    for key in NESTED_FIELDS:
        kind, x = typed(key)
        out[key] = F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(x))
    problem = F.when(F.octet_length(body) > MOST_BYTES, "too_large").when(v.isNull(), "invalid_json").when(F.coalesce(out["message"], F.lit("")) == "", "missing_message")
    return events.withColumn("problem", problem).withColumns(out)


def alerts(clean: DataFrame) -> DataFrame:
    """clean events of severity error or warn, as the text of a message: client and text."""
    mark = F.lit("🔵")
    for name, sign in MARKS.items():
        mark = F.when(F.col("severity") == name, sign).otherwise(mark)
    unknown = F.lit("?")
    head = F.concat(mark, F.lit(" *"), F.upper("severity"), F.lit("* — "), F.coalesce("scope", unknown), F.lit(" / "), F.coalesce("code", unknown))
    lines = [
        head,
        F.when(F.coalesce("stage", F.lit("")) != "", F.concat(F.lit("stage: `"), F.col("stage"), F.lit("`"))),
        F.concat(F.lit("> "), F.substring("message", 1, ALERT_MESSAGE)),
        F.when(F.col("context").isNotNull(), F.concat(F.lit("```json\n"), F.substring("context", 1, ALERT_CONTEXT), F.lit("\n```"))),
    ]
    return clean.filter(F.col("problem").isNull() & F.col("severity").isin(*MARKS)).select("client", F.concat_ws("\n", *lines).alias("text"))


def rate_limit(hits: DataFrame, most: int = MOST_HITS, window_ms: int = WINDOW_MS) -> DataFrame:
    """hits (key, t, seq) plus limited: whether a key has had more than ``most`` hits in its window. t: milliseconds.

    A window opens at a key's first hit and, past its end (> window_ms), at the next. Rows are walked in order of
    (t, seq) within sorted partitions: the walk holds one key's window, not its rows. Null keys are one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, n = object(), 0, 0
        for batch in batches:
            out = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != last or t - begun > window_ms:
                    last, begun, n = key, t, 0
                n += 1
                out.append(n > most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "limited"])

    own = hits.select("key", F.col("t").cast("long").alias("t"), "seq")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.repartition("key").sortWithinPartitions("key", "t", "seq").mapInArrow(run, f"{schema}, limited boolean")


def rate_limit_stream(hits: DataFrame, most: int = MOST_HITS, window_ms: int = WINDOW_MS, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """rate_limit on a stream (key, at timestamp, seq): (key, t, seq, limited) for each hit, append mode.

    Keys are dealt into buckets by hash; a bucket's state is the start and count of each open window. A window goes when
    event time has passed its end, so the state does not grow with the keys ever seen, and a trigger costs at most a call
    for each bucket. Within a trigger hits are taken in order of (t, seq). Hits that come later than ``late`` behind the
    newest have no row here, as their window may be gone, while rate_limit counts them: late_hits tells how many a query
    has left out."""
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        windows = {key: (begun, n) for key, begun, n in zip(*state.get, strict=True)} if state.exists else {}
        frame, out = pd.concat(list(frames)).sort_values(["t", "seq"]), []
        for key, t in zip(frame["key"].tolist(), frame["t"].tolist(), strict=True):
            begun, n = windows.get(key, (t, 0))
            if t - begun > window_ms:
                begun, n = t, 0
            windows[key] = begun, n + 1
            out.append(n >= most)
        now = state.getCurrentWatermarkMs()
        still = [(key, begun, n) for key, (begun, n) in windows.items() if begun + window_ms >= now]
        state.update(tuple(map(list, zip(*still, strict=True))) if still else ([], [], []))
        state.setTimeoutTimestamp(max([now, *(begun + window_ms for _, begun, _ in still)]) + 1)
        yield frame.assign(limited=out)[["key", "t", "seq", "limited"]]

    timed = hits.withWatermark("at", late).select(never_null("key").alias("key"), "at", F.unix_millis("at").alias("t"), "seq")
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    out = timed.groupBy("bucket").applyInPandasWithState(run, f"key string, t long, seq {kinds['seq']}, limited boolean", "key array<string>, begun array<long>, n array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("key", as_it_was("key", kinds["key"]))


def never_null(name: str) -> Column:
    """A column's values as texts, none of them null: so any whole number or text goes through pandas unchanged."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def as_it_was(name: str, kind: str) -> Column:
    """The value that never_null has made a text."""
    return F.when(F.col(name) != "", F.expr(f"substring({name}, 2)")).cast(kind)


def late_hits(query: StreamingQuery) -> int:
    """Rows that a stream has dropped because they came behind its watermark, over the progress reports it keeps."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in map(_as_dict, query.recentProgress) for op in p.get("stateOperators", []))


def _as_dict(progress) -> dict:
    return json.loads(progress.json) if hasattr(progress, "json") else dict(progress)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is and return what it wrote: Parquet with its checkpoint in a shared folder."""
    spark, to = stream.sparkSession, f"{folder}/rows"

    def put(frame: DataFrame, batch: int) -> None:
        frame.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{to}/batch={batch}")  # a rerun of a batch replaces it

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "integer")).parquet(to)
