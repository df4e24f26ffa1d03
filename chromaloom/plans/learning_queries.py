"""Learning runs made from events and orders; answers and hints over the texts of parts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import learning
from .inputs import derived, plain, table
from .registry import query

_EVENTS = """SELECT user_id AS user, cast(event_id % 3 AS int) AS run_id, event_id AS seq, {item} AS item_id, ts AS at, CASE WHEN event_type IN ('purchase', 'signup') THEN 'correct' WHEN event_type = 'view' THEN 'almost' ELSE 'wrong' END AS result,
  CASE WHEN event_id % 4 = 0 THEN 'conjugation' ELSE 'noun' END AS kind FROM {events}"""
ANSWERS = "answers AS (" + _EVENTS.replace("{item}", "cast(json_extract_string(props, '$.k') AS int)").replace("{events}", "events").replace(" AS user,", ' AS "user",').replace("ts AS at,", "ts AS stamp,") + ")"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _EVENTS.replace("{item}", "cast(get_json_object(props, '$.k') AS int)"), "events")


_RUNS = "SELECT o_custkey AS user, o_orderpriority AS test_id, o_orderdate AS at, cast(floor(o_totalprice) AS bigint) - 100000 AS score, o_orderkey AS seq FROM {orders}"
RUNS = "runs AS (" + plain(_RUNS, "orders").replace("AS user", 'AS "user"').replace("AS at", "AS stamp") + ")"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _RUNS, "orders")


def _draw_sql(seed: str) -> str:
    """The first number of the published 32-bit generator, in whole-number arithmetic."""
    m = 4294967296
    a = f"((({seed}) + 1831565813) % {m})"
    t = f"((xor({a}, {a} >> 15)::HUGEINT * ({a} | 1) % {m})::BIGINT)"
    u = f"xor((({t} + (xor({t}, {t} >> 7)::HUGEINT * ({t} | 61) % {m})::BIGINT) % {m}), {t})"
    return f"(xor({u}, {u} >> 14) / {m}.0::DOUBLE)"


_INC = 1831565813  # the generator's step: its k-th number is the first one of seed + (k - 1) * step


def _shuffle_ctes(source: str, key: str, seed: str) -> str:
    """CTEs whose last, ``shuffled`` (key, l), has the lists l of ``source`` (key, l, n) after Fisher-Yates from the end.
    seed: SQL, by i and the rest of the row, of the step that moves place i."""
    return f"""fy AS (SELECT {key}, l, n, len(l) - 1 AS i FROM {source}
  UNION ALL SELECT {key}, list_transform(l, lambda x, k: CASE WHEN k = i + 1 THEN l[j + 1] WHEN k = j + 1 THEN l[i + 1] ELSE x END), n, i - 1 FROM (SELECT *, floor({_draw_sql(seed)} * (i + 1))::BIGINT AS j FROM fy WHERE i >= 1)),
shuffled AS (SELECT {key}, l FROM fy WHERE i < 1)"""


#: The Leitner fold as a recursive walk over each item's answers.
SRS = f"""{ANSWERS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY "user", item_id ORDER BY stamp, seq) AS n FROM answers),
walk AS (SELECT "user", item_id, 0::BIGINT AS n, 1 AS box, 0 AS seen, 0 AS correct FROM numbered WHERE n = 1
  UNION ALL SELECT w."user", w.item_id, x.n, CASE x.result WHEN 'correct' THEN least(5, w.box + 1) WHEN 'wrong' THEN 1 ELSE least(w.box, 2) END, w.seen + 1, w.correct + CASE WHEN x.result = 'correct' THEN 1 ELSE 0 END
  FROM walk w JOIN numbered x ON x."user" = w."user" AND x.item_id = w.item_id AND x.n = w.n + 1),
srs AS (SELECT "user", item_id, box, seen, correct FROM walk QUALIFY n = max(n) OVER (PARTITION BY "user", item_id))"""


def srs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.replay_srs(answers(spark, sf_dir))


@query(f"""WITH {ANSWERS}, m AS (SELECT *, sum((result = 'wrong')::INT) OVER (PARTITION BY "user", run_id ORDER BY seq) AS mistakes FROM answers),
k AS (SELECT *, row_number() OVER (PARTITION BY "user", run_id ORDER BY seq) - 1 AS idx, sum((result <> 'correct')::INT) OVER (PARTITION BY "user", run_id ORDER BY seq) AS isl FROM m WHERE mistakes - (result = 'wrong')::INT < 5),
s AS (SELECT *, sum((result = 'correct')::INT) OVER (PARTITION BY "user", run_id, isl ORDER BY seq) AS streak FROM k),
g AS (SELECT *, CASE WHEN result = 'correct' THEN floor((10 + CASE WHEN kind = 'conjugation' THEN 5 ELSE 0 END) * CASE WHEN streak > 10 THEN 3 WHEN streak > 6 THEN 2 WHEN streak > 3 THEN 1.5::DOUBLE ELSE 1 END + 0.5) ELSE 0 END AS gain FROM s)
SELECT "user", run_id, seq, result, streak, gain::BIGINT AS gain, (sum(gain) OVER w)::BIGINT AS score, max(streak) OVER w AS best_streak, (idx // 8 + 1)::INT AS level, mistakes FROM g WINDOW w AS (PARTITION BY "user", run_id ORDER BY seq)""")
def w6_score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.score_answers(answers(spark, sf_dir)).select("user", "run_id", "seq", "result", "streak", "gain", "score", "best_streak", "level", "mistakes")


@query(f"WITH RECURSIVE {SRS} SELECT * FROM srs")
def w7_replay_srs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srs(spark, sf_dir)


#: Each learner's items with their boxes; every fourth item has no entry.
_BOXED = """boxed AS (SELECT "user", item_id, CASE WHEN item_id % 4 <> 0 THEN box ELSE 1 END AS box FROM srs)"""


@query(f"""WITH RECURSIVE {SRS}, {_BOXED}, lists AS (SELECT "user", list({{'item_id': item_id, 'box': box}} ORDER BY item_id) AS l, 0 AS n FROM boxed GROUP BY "user"), {_shuffle_ctes('lists', '"user"', f'11 + (len(l) - 1 - i) * {_INC}')},
ranked AS (SELECT "user", unnest(l) AS x, unnest(range(len(l))) AS r FROM shuffled) SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY x.box, r)::INT AS place, x.item_id AS item_id FROM ranked""")
def w8_mc_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = srs(spark, sf_dir)
    return learning.mc_deck(own.select("user", "item_id"), own.filter("item_id % 4 <> 0"), 11)


@query(f"""WITH {RUNS} SELECT "user", test_id, score, seq FROM runs QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY stamp DESC, seq DESC) <= 5""")
def w9_cap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.cap_runs(runs(spark, sf_dir), 5).select("user", "test_id", "score", "seq")


_ITEMS = "items AS (SELECT DISTINCT 't' || item_id % 7 AS test_id, item_id FROM answers)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select(F.concat(F.lit("t"), (F.col("item_id") % 7).cast("string")).alias("test_id"), "item_id").distinct()


@query(f"""WITH RECURSIVE {SRS}, {_ITEMS}, t AS (SELECT test_id, count(*) AS total FROM items GROUP BY ALL), g AS (SELECT "user", test_id, sum((seen > 0)::INT) AS p, sum((box >= 5)::INT) AS m, sum(seen) AS s, sum(correct) AS c FROM items JOIN srs USING (item_id) GROUP BY ALL)
SELECT u."user", t.test_id, total, coalesce(p, 0)::BIGINT AS practiced, coalesce(m, 0)::BIGINT AS mastered, round(CASE WHEN s > 0 THEN c / s END, 6) AS accuracy FROM (SELECT DISTINCT "user" FROM srs) u CROSS JOIN t LEFT JOIN g ON g."user" = u."user" AND g.test_id = t.test_id""")
def a5_test_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.test_stats(_items(spark, sf_dir), srs(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {RUNS}, grid AS (SELECT "user", test_id FROM (SELECT DISTINCT "user" FROM runs) CROSS JOIN (SELECT DISTINCT test_id FROM runs)), g AS (SELECT "user", test_id, count(*) AS n, greatest(0, max(score)) AS b, max(stamp) AS l FROM runs GROUP BY ALL)
SELECT "user", test_id, coalesce(n, 0) AS runs, coalesce(b, 0) AS best_score, l AS last_at FROM grid LEFT JOIN g USING ("user", test_id)""")
def a6_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = runs(spark, sf_dir)
    grid = own.select("user").distinct().crossJoin(F.broadcast(own.select("test_id").distinct()))
    return learning.run_stats(own, grid)


@query(f"""WITH RECURSIVE {SRS}, {RUNS}, a AS (SELECT "user", sum(seen) AS s, sum(correct) AS c, sum((box >= 5)::INT) AS m FROM srs GROUP BY ALL), b AS (SELECT "user", count(*) AS n, max(stamp) AS l FROM runs GROUP BY ALL)
SELECT coalesce(a."user", b."user") AS "user", coalesce(s, 0)::BIGINT AS answered, round(CASE WHEN s > 0 THEN c / s END, 6) AS accuracy, coalesce(m, 0)::BIGINT AS mastered, coalesce(n, 0) AS runs, l AS last_at FROM a FULL JOIN b ON a."user" = b."user" """)
def a7_learner_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.learner_summary(srs(spark, sf_dir), runs(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {RUNS} SELECT "user", score, seq FROM runs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY score DESC, seq) = 1""")
def a13_high_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.high_scores(runs(spark, sf_dir))


#: An answer and its target for each part: the name with articles, endings, alternatives and typos.
_CARDS = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'der ' || p_name || '; die Größe (f)' WHEN 2 THEN '(' || p_type || ') ' || p_name || ', -in' WHEN 3 THEN 'etw. ' || p_name || ' méß' ELSE 'el ' || p_name END AS target,
  CASE p_partkey % 7 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN substr(p_name, 1, length(p_name) - 1) WHEN 2 THEN 'Grosse' WHEN 3 THEN 'etwas ' || p_name || ' mess' WHEN 4 THEN '  ' WHEN 5 THEN p_type ELSE p_name || 'x' END AS answer,
  CASE p_partkey % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' ELSE 'conjugation' END AS kind, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS topic, p_name FROM {part}"""
CARDS = f"cards AS ({plain(_CARDS, 'part')})"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _CARDS, "part")


def _exact(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[.,;:!¡?¿\"''`´()/]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _loose(c: str) -> str:
    out = f"translate(replace({_exact(c)}, 'ß', 'ss'), '{text.ACCENTED}', '{text.PLAIN}')"
    for short, full in text.SHORT_FORMS:
        out = f"regexp_replace({out}, '\\b{short}\\b', '{full}', 'g')"
    return out


def _forms(c: str) -> str:
    """SQL for all accepted forms of a target."""
    alts = f"list_filter(list_transform(string_split({c}, ';'), lambda x: trim(x)), lambda x: x <> '')"
    bare = "trim(regexp_replace(regexp_replace(a, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'))"
    ungender = f"list_transform([a, {bare}], lambda y: trim(regexp_replace(y, ',\\s*-\\w+', '', 'g')))"
    return f"flatten(list_transform({alts}, lambda a: flatten(list_transform({ungender}, lambda z: [z, trim(regexp_replace(z, '(?i)^\\(?(der|die|das|los|las|el|la)\\)?\\s+', ''))]))))"


@query(f"SELECT conv_id, turn, role, {_exact('text')} AS exact, {_loose('text')} AS loose FROM conversations")
def x1_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.norm_exact(F.col("text")).alias("exact"), text.norm_loose(F.col("text")).alias("loose"))


@query(f"""WITH {CARDS}, f AS (SELECT id, {_exact('answer')} AS e, {_loose('answer')} AS l, unnest(list_filter({_forms('target')}, lambda x: x <> '')) AS form FROM cards),
m AS (SELECT id, bool_or({_exact('form')} = e) AS hit, bool_or({_loose('form')} = l) AS near, bool_or(length(l) >= 4 AND length({_loose('form')}) >= 4 AND levenshtein({_loose('form')}, l) <= 1) AS typo FROM f GROUP BY id)
SELECT id, CASE WHEN {_exact('answer')} = '' THEN 'wrong' WHEN hit THEN 'correct' WHEN near OR typo THEN 'almost' ELSE 'wrong' END AS result FROM cards LEFT JOIN m USING (id)""")
def x2_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select("id", text.grade(F.col("answer"), F.col("target")).alias("result"))


@query(f"""WITH RECURSIVE w AS (SELECT p_partkey AS id, string_split(concat_ws(' ', p_name, p_type, p_brand), ' ') AS l, 0 AS n FROM part), {_shuffle_ctes('w', 'id', f'id + (len(l) - 1 - i) * {_INC}')}
SELECT id, array_to_string(l, ' ') AS words FROM shuffled""")
def x3_seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each part's name and type in the order of a seed."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(learning.seeded_shuffle(words, F.col("p_partkey")), " ").alias("words"))


@query(f"""WITH {CARDS}, a AS (SELECT id, target, list_filter(list_transform(string_split(target, ';'), lambda x: trim(x)), lambda x: x <> '')[1] AS first FROM cards),
f AS (SELECT id, coalesce(first, trim(target)) AS shown, list_filter({_forms('coalesce(first, target)')}, lambda x: x <> '') AS forms FROM a)
SELECT id, shown, NOT regexp_matches(list_filter(forms, lambda x: length(x) = list_min(list_transform(forms, lambda y: length(y))))[1], '\\s') AS single FROM f""")
def x4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select("id", text.correct_display(F.col("target")).alias("shown"), text.is_single_word(F.col("target")).alias("single"))


#: Every item draws places in the list of its type, and in the whole list where its type has too few; a draw that moves
#: nothing but what it takes, so that no list is copied.
_CHOICES = f"""{CARDS}, items AS (SELECT id, '=' || kind AS list, p_name AS answer FROM cards),
texts AS (SELECT list, answer, row_number() OVER (PARTITION BY list ORDER BY ('0x' || substr(md5(answer), 1, 3))::BIGINT, answer) - 1 AS pos FROM (SELECT list, answer FROM items UNION SELECT '*', answer FROM items)),
sizes AS (SELECT list, count(*) AS n FROM texts GROUP BY list),
own AS (SELECT i.*, s.n, w.n AS n_all, ('0x' || substr(md5('5|' || id || '|' || i.list || '|' || answer), 1, 8))::BIGINT AS own FROM items i JOIN sizes s ON s.list = i.list JOIN sizes w ON w.list = '*'),
asked AS (SELECT id, list AS place, n, least(n, 5) AS k, own AS seed, 0 AS base FROM own UNION ALL SELECT id, '*', n_all, CASE WHEN n < 5 THEN least(n_all, 10) ELSE 0 END, own + 1, 5 FROM own),
draws AS (SELECT id, place, n, k, seed, base, 0::BIGINT AS i, map([]::BIGINT[], []::BIGINT[]) AS moved, []::BIGINT[] AS taken FROM asked
  UNION ALL SELECT id, place, n, k, seed, base, i + 1, map_concat(moved, map([j], [coalesce(moved[i], i)])), list_append(taken, coalesce(moved[j], j)) FROM (SELECT *, i + floor({_draw_sql(f'seed + i * {_INC}')} * (n - i))::BIGINT AS j FROM draws WHERE i < k)),
picked AS (SELECT id, place, base, unnest(taken) AS pos, unnest(range(len(taken))) AS no FROM draws WHERE i = k),
others AS (SELECT p.id, t.answer, min(base + no) AS no FROM picked p JOIN texts t ON t.list = p.place AND t.pos = p.pos JOIN own o ON o.id = p.id WHERE t.answer <> o.answer GROUP BY p.id, t.answer QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY min(base + no)) <= 4),
lists AS (SELECT o.id, list_concat([any_value(o.answer)], coalesce(list(x.answer ORDER BY x.no) FILTER (x.answer IS NOT NULL), [])) AS l, any_value(own) AS n FROM own o LEFT JOIN others x ON x.id = o.id GROUP BY o.id)"""


@query(f"WITH RECURSIVE {_CHOICES}, {_shuffle_ctes('lists', 'id', f'n + 2 + (len(l) - 1 - i) * {_INC}')} SELECT id, array_to_string(l, '|') AS options FROM shuffled")
def x5_build_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cards(spark, sf_dir).select("id", "kind", F.col("p_name").alias("answer"))
    return learning.build_choices(own, 5).withColumn("options", F.array_join("options", "|"))


@query(f"""WITH {CARDS}, w AS (SELECT id, id % 7 AS level, CASE WHEN {_draw_sql('3 + id * 7919')} < 0.5 THEN 'es-de' ELSE 'de-es' END AS direction, {_draw_sql('3 + id * 40503 + 17')} AS d, target, p_name FROM cards),
a AS (SELECT *, list_filter(list_transform(string_split(CASE direction WHEN 'es-de' THEN p_name ELSE target END, ';'), lambda x: trim(x)), lambda x: x <> '')[1] AS first FROM w),
f AS (SELECT *, list_filter({_forms('first')}, lambda x: x <> '') AS forms FROM a)
SELECT id AS "index", level::INT AS level, direction, CASE WHEN level >= 3 AND NOT regexp_matches(list_filter(forms, lambda x: length(x) = list_min(list_transform(forms, lambda y: length(y))))[1], '\\s')
  AND d < CASE WHEN level >= 5 THEN 0.85 WHEN level = 4 THEN 0.7 ELSE 0.5 END THEN 'type' ELSE 'choice' END AS mode FROM f""")
def x6_pick_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cards(spark, sf_dir).select(F.col("id").alias("index"), (F.col("id") % 7).cast("int").alias("level"), F.col("target").alias("es"), F.col("p_name").alias("de"))
    return learning.pick_mode(own, 3).select("index", "level", "direction", "mode")


@query(f"""WITH RECURSIVE {SRS}, {_BOXED}, k AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY item_id) AS k FROM boxed),
drawn AS (SELECT *, {_draw_sql(f'11 + (k - 1) * {_INC}')} < CASE WHEN box >= 5 THEN 0.5 WHEN box >= 4 THEN 0.8 ELSE 1 END AS chosen FROM k),
lists AS (SELECT "user", CASE WHEN bool_or(chosen) THEN list(item_id ORDER BY item_id) FILTER (chosen) ELSE list(item_id ORDER BY item_id) END AS l, count(*) AS n FROM drawn GROUP BY "user"),
{_shuffle_ctes('lists', '"user"', f'11 + (n + len(l) - 1 - i) * {_INC}')} SELECT "user", unnest(range(1, len(l) + 1))::INT AS place, unnest(l) AS item_id FROM shuffled""")
def x7_session_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = srs(spark, sf_dir)
    return learning.session_deck(own.select("user", "item_id"), own.filter("item_id % 4 <> 0"), 11)


def _mask(c: str) -> str:
    return f"array_to_string(list_transform(regexp_split_to_array(trim({c}), '\\s+'), lambda w: array_to_string(list_transform(list_filter(string_split(w, ''), lambda q: q <> ''), lambda x: CASE WHEN regexp_full_match(x, '\\p{{L}}') THEN '_' ELSE x END), ' ')), '   ·   ')"


def _reveal(c: str, fraction: str) -> str:
    chars = f"list_filter(string_split({c}, ''), lambda q: q <> '')"
    letter = "regexp_full_match(x, '\\p{L}')"
    total = f"len(list_filter({chars}, lambda x: {letter}))"
    shown = f"greatest(1, floor({total} * {fraction} + 0.5)::INT)"
    seen = f"len(list_filter({chars}[1:i - 1], lambda x: {letter}))"
    return f"regexp_replace(array_to_string(list_transform({chars}, lambda x, i: CASE WHEN NOT {letter} OR {seen} < {shown} THEN x ELSE '_' END), ' '), ' {{2,}}', '   ', 'g')"


_LABEL = "CASE kind WHEN 'noun' THEN 'Nomen' WHEN 'verb' THEN 'Verb' ELSE 'Verb-Konjugation' END"
_ARTICLE = "nullif(lower(regexp_extract(trim(target), '(?i)^\\(?(der|die|das|el|la|los|las)\\)?\\b', 1)), '')"


@query(f"""WITH {CARDS} SELECT id, array_to_string(list_filter([CASE WHEN coalesce(topic, '') <> '' THEN 'Thema: ' || topic || ' · ' || {_LABEL} ELSE {_LABEL} END,
  concat_ws('  ·  ', CASE WHEN {_ARTICLE} IS NOT NULL THEN 'Artikel: ' || {_ARTICLE} END, {_mask('target')}), {_reveal('target', '0.0')},
  CASE WHEN kind <> 'conjugation' THEN {_reveal('target', '0.5')} WHEN p_name <> '' THEN 'Infinitiv: ' || p_name || CASE WHEN id % 2 = 0 THEN ' · presente' ELSE '' END END], lambda q: q IS NOT NULL), chr(10)) AS layers FROM cards""")
def x8_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cards(spark, sf_dir).select("id", "target", "kind", "topic", F.lit(None).cast("string").alias("sentence"), F.col("p_name").alias("infinitive"), F.when(F.col("id") % 2 == 0, "presente").alias("tense"), F.lit(None).cast("string").alias("person"))
    return learning.hints(own).withColumn("layers", F.array_join("layers", "\n"))
