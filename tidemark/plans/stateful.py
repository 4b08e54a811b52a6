"""Registered queries of jobs, edits, dynamic documents and plans; they enter the catalogue's registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import cost, dynamic, edits, highlights, panels, placed, scan, tracks
from tidemark.plans.catalogue import query
from tidemark.sources import carriers as C
from tidemark.sources import measures, probes, work
from tidemark.streaming import jobs

# ---------------------------------------------------------------- jobs

#: Events as what a job says: every sixteenth one starts a side operation, and so on.
SQL_LINES = """l AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, event_type AS label,
    CASE event_id % 16 WHEN 0 THEN 'side' WHEN 3 THEN 'memory' WHEN 5 THEN 'side end' WHEN 9 THEN 'end' ELSE 'progress' END AS what,
    CAST(round(value * 100) AS DOUBLE) AS done, 10000.0::DOUBLE AS total FROM events)"""


def lines_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events of the folder as a stream of lines (key, id, t, line)."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path + "*")  # a stream wants a folder or a pattern
    return as_lines(events)


def as_lines(events: DataFrame) -> DataFrame:
    kind = F.col("event_id") % 16
    line = (
        F.when(kind == 0, F.concat(F.lit("@parallele "), F.col("event_id"), F.lit(" "), F.col("event_type")))
        .when(kind == 3, F.concat(F.lit("@memoire "), F.col("event_type")))
        .when(kind == 5, F.concat(F.lit("@parallele-fin "), F.col("event_type")))
        .when(kind == 9, F.lit(jobs.END))
        .otherwise(F.concat(F.lit("@progression "), F.round(F.col("value") * 100).cast("long"), F.lit(" 10000 "), F.col("event_type")))
    )
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), C.micros("ts").alias("t"), line.alias("line"))


SQL_PERIODS = f"""WITH {SQL_LINES},
    starts AS (SELECT *, sum((what = 'side')::INT) OVER own AS run FROM l WINDOW own AS (PARTITION BY key, label ORDER BY t, id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, coalesce(last_value(CASE WHEN what IN ('side', 'side end') THEN what END IGNORE NULLS) OVER (PARTITION BY key, label ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'side', false) AS along FROM starts),
    shares AS (SELECT key, label, run, min_by(least(1.0, done / total), struct_pack(t := t, id := id)) AS start FROM s WHERE what = 'progress' AND along GROUP BY key, label, run),
    begun AS (SELECT key, label, run, t AS began FROM s WHERE what = 'side'),
    sides AS (SELECT s.key, 'side' AS what, s.label, began, s.t AS ended, coalesce(start, 0.0) AS start FROM s JOIN begun USING (key, label, run) LEFT JOIN shares USING (key, label, run) WHERE s.what = 'side end' AND s.along),
    m AS (SELECT *, lag(what) OVER (PARTITION BY key ORDER BY t, id) AS last FROM s WHERE what = 'end' OR (what = 'progress' AND NOT along)),
    labelled AS (SELECT *, last_value(CASE WHEN what = 'progress' THEN label END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
    turns AS (SELECT *, sum((what = 'progress' AND before IS DISTINCT FROM label)::INT) OVER (PARTITION BY key ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS island FROM labelled),
    first AS (SELECT key, island, min(t) AS began, min_by(label, struct_pack(t := t, id := id)) AS label, min_by(least(1.0, done / total), struct_pack(t := t, id := id)) AS start FROM turns WHERE what = 'progress' GROUP BY key, island),
    closing AS (SELECT key, t, CASE WHEN what = 'end' THEN island ELSE island - 1 END AS island FROM turns WHERE last = 'progress' AND (what = 'end' OR before IS DISTINCT FROM label)),
    phases AS (SELECT key, 'phase' AS what, label, began, t AS ended, start FROM closing JOIN first USING (key, island)),
    flags AS (SELECT s.key, s.t, s.id, coalesce(last_value(m.what IGNORE NULLS) OVER w = 'progress', false) AS main,
        sum(CASE WHEN s.what = 'side' AND NOT s.along THEN 1 WHEN s.what = 'side end' AND s.along THEN -1 ELSE 0 END) OVER w > 0 AS side
        FROM s LEFT JOIN m ON m.key = s.key AND m.id = s.id WINDOW w AS (PARTITION BY s.key ORDER BY s.t, s.id ROWS UNBOUNDED PRECEDING)),
    turned AS (SELECT key, t, id, main OR side AS busy, lag(main OR side, 1, false) OVER (PARTITION BY key ORDER BY t, id) AS was FROM flags),
    edges AS (SELECT key, busy, t, lead(t) OVER (PARTITION BY key ORDER BY t, id) AS ended FROM turned WHERE busy <> was),
    idle AS (SELECT key, 'busy' AS what, NULL::VARCHAR AS label, t AS began, ended, NULL::DOUBLE AS start FROM edges WHERE busy AND ended IS NOT NULL),
    periods AS (SELECT * FROM phases UNION ALL SELECT * FROM sides UNION ALL SELECT * FROM idle)"""


@query("job_periods", f"{SQL_PERIODS} SELECT key, what, label, began, ended, start FROM periods")
def _(spark, d):
    return jobs.replayed(lines_stream(spark, d))


@query(
    "job_time",
    f"""{SQL_PERIODS} SELECT key, coalesce(label, 'busy') AS label, CAST(sum(ended - began) AS BIGINT) AS micros, count(*) AS periods FROM periods GROUP BY ALL""",
)
def _(spark, d):
    told = jobs.replayed(lines_stream(spark, d))
    return told.groupBy("key", F.coalesce("label", F.lit("busy")).alias("label")).agg(F.sum(F.col("ended") - F.col("began")).alias("micros"), F.count("*").alias("periods"))


# ---------------------------------------------------------------- documents of unknown shape

#: Documents made of events: ids in every type, and patches of settings, some of which are refused.
SQL_DOCS = r"""d AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS t, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 7 AS m FROM events),
    l AS (SELECT *, CASE m WHEN 0 THEN '[' || k || ', "x"]' WHEN 1 THEN '[' || k || '.0]' WHEN 2 THEN '["' || k || '/2", 1]' WHEN 3 THEN '[true, "' || (k + 1) || '"]' WHEN 4 THEN '[]' WHEN 5 THEN 'null' ELSE '{"a": ' || k || '}' END AS doc,
        CASE m WHEN 0 THEN '{"voice": ' || k || '.125}' WHEN 1 THEN '{"voice": " 1.2_5 ", "denoise": ' || k || '}' WHEN 2 THEN '{"denoise": null, "highpass": ' || (k % 2) || '}' WHEN 3 THEN '{"loudness": false, "other": 1}'
        WHEN 4 THEN '{"loudness": -' || k || '.5, "clarity": "yes"}' WHEN 5 THEN '{"voice": [1], "clarity": true}' ELSE '{"clarity": "", "denoise": "2"}' END AS body FROM d)"""


def shaped(spark: SparkSession, d: str) -> DataFrame:
    """(key, id, t, kind, k, m, doc, body): the same documents as VARIANT columns."""
    e = C.states(spark, d).withColumn("k", F.col("k").cast("long")).withColumn("m", F.col("id") % 7)
    k, m = F.col("k").cast("string"), F.col("m")
    doc = F.when(m == 0, F.concat(F.lit("["), k, F.lit(', "x"]'))).when(m == 1, F.concat(F.lit("["), k, F.lit(".0]"))).when(m == 2, F.concat(F.lit('["'), k, F.lit('/2", 1]')))
    doc = doc.when(m == 3, F.concat(F.lit('[true, "'), (F.col("k") + 1).cast("string"), F.lit('"]'))).when(m == 4, F.lit("[]")).when(m == 5, F.lit("null")).otherwise(F.concat(F.lit('{"a": '), k, F.lit("}")))
    body = F.when(m == 0, F.concat(F.lit('{"voice": '), k, F.lit(".125}"))).when(m == 1, F.concat(F.lit('{"voice": " 1.2_5 ", "denoise": '), k, F.lit("}")))
    body = body.when(m == 2, F.concat(F.lit('{"denoise": null, "highpass": '), (F.col("k") % 2).cast("string"), F.lit("}"))).when(m == 3, F.lit('{"loudness": false, "other": 1}'))
    body = body.when(m == 4, F.concat(F.lit('{"loudness": -'), k, F.lit('.5, "clarity": "yes"}'))).when(m == 5, F.lit('{"voice": [1], "clarity": true}')).otherwise(F.lit('{"clarity": "", "denoise": "2"}'))
    return e.select("key", "id", "t", "kind", "k", "m", F.parse_json(doc).alias("doc"), F.parse_json(body).alias("body"))


@query(
    "variant_ids",
    f"""WITH {SQL_DOCS} SELECT id, (m IN (0, 1) OR (m = 2 AND k = 1) OR (m = 3 AND k = 1)) AS has, (m IN (0, 1, 2) OR (m = 3 AND k = 1)) AS kept, m NOT IN (4, 5) AS truthy,
    CASE m WHEN 4 THEN 'array' WHEN 5 THEN 'null' WHEN 6 THEN 'object' ELSE 'array' END AS shape, CASE WHEN m NOT IN (4, 5) THEN json_type(doc::JSON) ELSE json_type(body::JSON) END = 'OBJECT' AS object FROM l""",
)
def _(spark, d):
    doc, k = F.col("doc"), F.col("k")
    return shaped(spark, d).select(
        "id",
        dynamic.contains(doc, k).alias("has"),
        dynamic.kept(doc, k).alias("kept"),
        dynamic.truthy(doc).alias("truthy"),
        dynamic.kind(doc).alias("shape"),
        (dynamic.kind(dynamic.either(doc, F.col("body"))) == "object").alias("object"),
    )


@query(
    "variant_settings",
    rf"""WITH {SQL_DOCS}, good AS (SELECT * FROM l WHERE m <> 5), named AS (SELECT key, t, id, n.name, json_extract(body, '$."' || n.name || '"') AS v, json_type(body, '$."' || n.name || '"') AS ty FROM good, (VALUES ('voice'), ('denoise'), ('loudness'), ('highpass'), ('clarity')) n(name)),
    last AS (SELECT key, name, max_by(struct_pack(v := CAST(v AS VARCHAR), ty := ty), struct_pack(t := t, id := id)) AS x FROM named WHERE ty IS NOT NULL GROUP BY key, name),
    plain AS (SELECT key, name, x.ty AS ty, replace(trim(trim(x.v, '"')), '_', '') AS s FROM last WHERE x.ty <> 'NULL')
    SELECT key, name, CASE name WHEN 'voice' THEN round_even(greatest(0, least(2, CAST(s AS DOUBLE))), 2) WHEN 'denoise' THEN greatest(0, least(3, CAST(s AS BIGINT)))::DOUBLE WHEN 'loudness' THEN CASE WHEN s <> 'false' THEN round(greatest(-30, least(-8, CAST(s AS DOUBLE)))) END END AS number,
    CASE WHEN name IN ('highpass') THEN s <> '0' WHEN name = 'clarity' THEN s <> '' WHEN name = 'loudness' AND s = 'false' THEN false END AS flag FROM plain""",
)
def _(spark, d):
    return dynamic.checked(dynamic.last_values(shaped(spark, d).select("key", "t", "id", "body"), dynamic.SOUND), dynamic.SOUND).select("key", "name", "number", "flag")


#: Presets as rows: (preset, setting, what it adds).
SQL_PRESETS = "p(look, name, adds) AS (VALUES " + ", ".join(f"('{look}', '{name}', {adds}::DOUBLE)" for look, some in dynamic.PRESETS.items() for name, adds in some.items()) + ")"
SQL_COLOURS = "c(name, usual, low, high) AS (VALUES " + ", ".join(f"('{n}', {u}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for n, u, a, b in dynamic.COLOURS) + ")"
LOOKS = ("", *dynamic.PRESETS)


@query(
    "colour_presets",
    f"""WITH {SQL_PRESETS}, {SQL_COLOURS}, names(i, look) AS (VALUES {', '.join(f"({i}, '{look}')" for i, look in enumerate(LOOKS))}),
    e AS (SELECT event_id AS id, a.look AS old, b.look AS new, event_id % 101 / 100.0::DOUBLE AS k_old, user_id % 101 / 100.0::DOUBLE AS k_new, event_id % 3 = 0 AS old_form, (event_id % 40 - 20)::DOUBLE AS slider
        FROM events JOIN names a ON a.i = event_id % 9 JOIN names b ON b.i = user_id % 9),
    s AS (SELECT e.*, c.*, coalesce(po.adds, 0) AS before, coalesce(pn.adds, 0) AS after FROM e, c LEFT JOIN p po ON po.look = e.old AND po.name = c.name LEFT JOIN p pn ON pn.look = e.new AND pn.name = c.name WHERE c.name IN ('temperature', 'contraste', 'saturation', 'noirs')),
    v AS (SELECT *, CASE WHEN name = 'contraste' THEN slider ELSE usual END AS x FROM s),
    f AS (SELECT *, greatest(low, least(high, CASE WHEN NOT old_form THEN x WHEN name = 'saturation' THEN x * greatest(0, 1 + k_old * before / 100) ELSE x + k_old * before END)) AS now FROM v)
    SELECT id, name, round(now, 4) AS now, round(greatest(low, least(high, now - k_old * before + k_new * after)), 4) AS then FROM f""",
)
def _(spark, d):
    e = C.table(spark, d, "events")
    looks = F.array(*[F.lit(x) for x in LOOKS])
    number = lambda name, c: F.concat(F.lit(f', "{name}": '), c.cast("string"))
    text = F.concat(F.lit('{"look": "'), F.get(looks, (F.col("event_id") % 9).cast("int")), F.lit('"'), number("intensite", F.col("event_id") % 101), number("contraste", F.col("event_id") % 40 - 20), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit(', "v": 2')), F.lit("}"))
    docs = e.select(F.col("event_id").alias("id"), "user_id", F.parse_json(text).alias("doc"))
    then = dynamic.with_preset(F.col("colours"), F.get(looks, (F.col("user_id") % 9).cast("int")), (F.col("user_id") % 101).cast("double"))
    both = dynamic.colours(docs, "doc").withColumn("then", then)
    rows = [F.struct(F.lit(n).alias("name"), F.round(F.col(f"colours.{n}"), 4).alias("now"), F.round(F.col(f"then.{n}"), 4).alias("then")) for n in ("temperature", "contraste", "saturation", "noirs")]
    return both.select("id", F.inline(F.array(*rows)))


@query(
    "transitions_checked",
    """WITH e AS (SELECT event_id AS id, event_id % 6 AS m, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
    SELECT id, CASE m WHEN 0 THEN 'iris' WHEN 1 THEN 'flash' WHEN 2 THEN '' WHEN 5 THEN '' END AS kind, CASE WHEN m IN (0, 1) THEN greatest(0.2, least(1.5, cents % 300 / 100.0::DOUBLE)) WHEN m IN (2, 5) THEN 0.5 END AS dur FROM e""",
)
def _(spark, d):
    e = C.points(spark, d).select("id", (F.col("id") % 6).alias("m"), ((F.col("cents") % 300).cast("double") / 100).cast("string").alias("dur"))
    m = F.col("m")
    text = F.when(m == 0, F.concat(F.lit('{"kind": "iris", "dur": '), "dur", F.lit("}"))).when(m == 1, F.concat(F.lit('{"kind": "flash", "dur": "'), "dur", F.lit('"}'))).when(m == 2, F.lit('{"dur": true}'))
    text = text.when(m == 3, F.lit('{"kind": "none of them"}')).when(m == 4, F.lit("[1]")).otherwise(F.lit('{"kind": ""}'))
    told = e.select("id", dynamic.transition(F.parse_json(text)).alias("x"))
    return told.select("id", "x.kind", "x.dur")


# ---------------------------------------------------------------- one key over many tasks


def samples(spark: SparkSession, d: str) -> DataFrame:
    """All events as the samples of one key."""
    return C.points(spark, d).select(F.lit(1).alias("key"), F.col("id").alias("i"), F.col("cents").cast("double").alias("x"))


@query(
    "run_down_signal",
    """WITH s AS (SELECT event_id AS i, CAST(round(value * 100) AS DOUBLE) AS x, count(*) OVER () AS n FROM events),
    p AS (SELECT i, n, sum(CAST(round((1 - 0.45::DOUBLE * pow(i / n, 1.6::DOUBLE)) * 1048576) AS BIGINT)) OVER (ORDER BY i) AS position FROM s),
    k AS (SELECT i, CAST(position // 1048576 AS BIGINT) AS i0, CAST(position % 1048576 AS BIGINT) / 1048576.0::DOUBLE AS f, max(i) OVER () + 1 AS n_out FROM p WHERE position < (n - 1) * 1048576)
    SELECT 1 AS key, k.i, round((a.x * (1 - f) + b.x * f) * (1 - 0.25::DOUBLE * k.i / n_out), 6) AS x FROM k JOIN s a ON a.i = i0 JOIN s b ON b.i = i0 + 1""",
)
def _(spark, d):
    return scan.run_down(samples(spark, d), 1.0, 4096).select("key", "i", F.round("x", 6).alias("x"))


@query(
    "clock_positions",
    f"""{C.sql_with('points')}, k AS (SELECT key % 3 AS key, t, max(cents) AS p FROM points WHERE id % 5 = 0 GROUP BY 1, 2), q AS (SELECT key % 3 AS key, id, t FROM points WHERE id % 5 <> 0),
    a AS (SELECT q.*, k.t AS a_t, k.p AS ap FROM q ASOF LEFT JOIN k ON q.key = k.key AND q.t >= k.t), b AS (SELECT a.*, k.t AS b_t, k.p AS bp FROM a ASOF LEFT JOIN k ON a.key = k.key AND a.t < k.t)
    SELECT key, id, round(CASE WHEN a_t IS NULL THEN bp WHEN b_t IS NULL THEN ap ELSE ap + (bp - ap)::DOUBLE / (b_t - a_t) * (t - a_t) END::DOUBLE, 4) AS p FROM b""",
)
def _(spark, d):
    p = C.points(spark, d).withColumn("key", F.col("key") % 3)
    knots = p.where("id % 5 = 0").groupBy("key", "t").agg(F.max("cents").alias("p"))
    return scan.clock_read(knots, p.where("id % 5 <> 0").select("key", "id", "t"), 6 * C.HOUR).select("key", "id", F.round("p", 4).alias("p"))


@query(
    "smoothed_signal",
    """WITH s AS (SELECT event_id AS i, CAST(round(value * 100) AS DOUBLE) AS x FROM events)
    SELECT 1 AS key, a.i, round(sum(b.x * CASE WHEN b.i = 0 THEN 1 ELSE 0.7 END * pow(0.3, a.i - b.i)), 6) AS smooth FROM s a JOIN s b ON b.i BETWEEN a.i - 45 AND a.i GROUP BY a.i""",
)
def _(spark, d):
    return scan.smoothed(samples(spark, d), ["key"], ["i"], F.floor(F.col("i") / 4096), "x", 0.3).select("key", "i", F.round("smooth", 6).alias("smooth"))


# ---------------------------------------------------------------- plans, marked words, measurements, edits


@query(
    "render_plans",
    f"""{C.sql_with('points')}, n AS (SELECT key, sum(cents) * 3 AS free, min(cents) AS fixed, max(cents) AS each, 1 + key % 40 AS wanted FROM points GROUP BY key),
    g AS (SELECT n.*, w, c FROM n, generate_series(1, 12) a(w), generate_series(1, 40) b(c) WHERE c <= wanted AND (fixed + w * (each + 150 * c)) * 100 <= free * 80),
    m AS (SELECT key, w, max(c) AS c FROM g GROUP BY key, w), f AS (SELECT n.key, max(w) AS w FROM n JOIN m ON m.key = n.key AND m.c >= least(wanted, 8) AND w >= 2 GROUP BY n.key)
    SELECT n.key, CAST(coalesce(f.w, 1) AS BIGINT) AS workers, CAST(coalesce(m.c, 1) AS BIGINT) AS clips FROM n LEFT JOIN f USING (key) LEFT JOIN m ON m.key = n.key AND m.w = coalesce(f.w, 1)""",
)
def _(spark, d):
    needs = C.points(spark, d).groupBy("key").agg((F.sum("cents") * 3).alias("free"), F.min("cents").alias("fixed"), F.max("cents").alias("each")).withColumn("wanted", 1 + F.col("key") % 40)
    return cost.render_plans(needs, lambda w, c: F.col("fixed") + w * (F.col("each") + 150 * c), 12)


@query(
    "needs_beside",
    """WITH o AS (SELECT user_id AS key, event_type AS op, min(event_id) AS position, CAST(sum(round(value * 100)) AS BIGINT) AS need FROM events GROUP BY 1, 2),
    p AS (SELECT a.key, a.position AS s, b.position AS j, a.need AS extra FROM o a JOIN o b ON a.key = b.key AND a.op = 'view' AND b.op = 'error')
    SELECT o.key, o.position, op, need, CAST(need + CASE WHEN position > s AND position < j THEN extra ELSE 0 END AS BIGINT) AS total FROM o LEFT JOIN p USING (key)""",
)
def _(spark, d):
    ops = C.points(spark, d).groupBy("key", F.col("kind").alias("op")).agg(F.min("id").alias("position"), F.sum("cents").alias("need"))
    return cost.with_beside(ops, (("view", "error"),))


SQL_CAPTIONS = r"""c AS (SELECT conv_id % 20 AS key, conv_id * 100 + turn AS id, (conv_id // 20) * 60 + turn * 7 AS s, string_split(lower(text), ' ')[1:12] AS words, role FROM conversations),
    h AS (SELECT key, id, s, s + 40 AS e, words FROM c WHERE role = 'user' AND id % 3 = 0)"""


def captioned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First words of turns as captions, and of some users' turns as highlights."""
    t = C.table(spark, d, "conversations")
    words = F.slice(F.split(F.lower("text"), " ", -1), 1, 12)
    c = t.select((F.col("conv_id") % 20).alias("key"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.expr("conv_id div 20") * 60 + F.col("turn") * 7).alias("s"), words.alias("words"), "role")
    h = c.where("role = 'user' and id % 3 = 0").select("key", "id", "s", (F.col("s") + 40).alias("e"), "words")
    return c.drop("role"), h


@query(
    "marked_words",
    f"""WITH {SQL_CAPTIONS}, p AS (SELECT key, id, s, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM c)
    SELECT p.key, p.id AS caption, CAST(place AS INTEGER) AS place, min(h.id) AS highlight FROM p JOIN h ON p.key = h.key AND p.s >= h.s - 2 AND p.s < h.e AND list_contains(h.words, word) WHERE word <> '' GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return highlights.marked_words(*captioned(spark, d), 60, 2)


@query(
    "shared_words",
    f"""WITH {SQL_CAPTIONS}, p AS (SELECT DISTINCT key, id, s, unnest(words) AS word FROM c)
    SELECT p.key, p.id AS caption, h.id AS highlight, count(*) AS n FROM p JOIN h ON p.key = h.key AND p.s >= h.s - 2 AND p.s < h.e AND list_contains(h.words, word) WHERE word <> '' GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return highlights.shared_words(*captioned(spark, d), 60, 2)


@query("kept_measurements", f"{C.sql_with('points')} SELECT op, t, id, peak FROM (SELECT kind AS op, t, id, cents AS peak, row_number() OVER (PARTITION BY kind ORDER BY t DESC, id DESC) AS r FROM points) WHERE r <= 10")
def _(spark, d):
    rows = C.points(spark, d).select(F.col("kind").alias("op"), "t", "id", F.col("cents").alias("peak"))
    path = work.folder(spark, "measurements")
    for part in (1, 0, 2, 1):  # batches out of order, and one of them twice
        measures.record(rows.where(F.col("id") % 3 == part), path)
    return measures.read(spark, path, "op string, t long, id long, peak long")


def recordings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Conversations as recordings: turns as segments with a word every 0.3 s, effects, two variants, and a log of edits."""
    t = C.table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("i"), F.array_remove(F.split("text", r"\s+"), "").alias("w"))
    start = F.col("i") * 1000.0
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda k: F.array(start + k * 3 / 10, start + k * 3 / 10 + 0.25))
    segments = t.select("key", (F.col("i") + 1).alias("id"), F.to_json(F.struct(start.alias("start"), (start + 900).alias("end"), ends.alias("words"))).alias("body"))
    effects = F.array(*[F.struct((F.col("i") % 3 + x).alias("at"), F.lit(f"e{k}").alias("name")) for k, x in enumerate((0.25, 1.5, 4.0))])
    documents = t.select("key", (F.col("i") + 1).alias("id"), F.to_json(F.struct(F.lit("r").alias("rush"), effects.alias("sfx"), F.struct(F.lit(0.1).alias("in"), F.lit(30.0).alias("out")).alias("trim"))).alias("body"))
    keep = t.groupBy("key").agg(F.sort_array(F.collect_list(F.col("i") + 1)).alias("keep"))
    variants = keep.select("key", F.explode(F.array(F.lit("long"), F.lit("short"))).alias("id"), "keep").select("key", "id", F.to_json(F.struct(F.when(F.col("id") == "long", F.col("keep")).otherwise(F.slice("keep", 1, 2)).alias("keep"))).alias("body"))
    edit = lambda op, **fields: F.to_json(F.struct(F.lit(op).alias("op"), *[c.alias(n) for n, c in fields.items()]))
    log = [edit("split", id=F.col("i") + 1, t=F.col("i") + 1.0), edit("unsplit", id=1_000_000 + 1000 * (F.col("i") + 1) + 3), edit("split", id=F.col("i") + 1, t=F.lit(0.7)), edit("restore", to=F.col("i") * 4)]
    edits_of = t.select("key", (F.col("i") * 4).alias("n"), F.posexplode(F.array(*log)).alias("k", "body")).select("key", (F.col("n") + F.col("k")).alias("id"), F.when((F.col("k") < 3) | (F.col("key") % 2 == 0), F.col("body")).alias("body"))
    return segments, documents, variants, edits_of


@query("edited_recordings")
def _(spark, d):
    return edits.replayed(*recordings(spark, d))


# ---------------------------------------------------------------- probes

SQL_FILES = """f AS (SELECT o_orderkey AS id, o_custkey % 50 AS key, 100 + o_orderkey % 4 AS w, 200 + o_custkey % 2 AS h, (ARRAY['25', '29.97', '23.976', '60', '12.5', '500'])[1 + o_orderkey % 6] AS tbr, o_custkey % 3 AS tracks, (o_orderkey % 4) * 90 - 90 AS turn, o_orderkey % 1000 AS kbps FROM orders)"""


def probed(spark: SparkSession, d: str) -> DataFrame:
    """(id, key, probe): what a tool might say of a file for each order."""
    o = C.table(spark, d, "orders")
    tbr = F.get(F.array(*[F.lit(x) for x in ("25", "29.97", "23.976", "60", "12.5", "500")]), (F.col("o_orderkey") % 6).cast("int"))
    video = F.format_string("  Stream #0:0(und): Video: h264 (High (x, y)) (avc1 / 0x31637661), yuv420p(tv, bt709), %dx%d [SAR 1:1 DAR 16:9], %d kb/s, 24 fps, %s tbr, 90k tbn\n", 100 + F.col("o_orderkey") % 4, 200 + F.col("o_custkey") % 2, F.col("o_orderkey") % 1000, tbr)
    audio = F.when(F.col("o_custkey") % 3 > 0, F.lit("  Stream #0:1: Audio: none (apac), 48000 Hz\n  Stream #0:2: Audio: aac (LC), 48000 Hz, stereo, fltp, 128 kb/s\n")).otherwise(F.lit(""))
    turn = F.format_string("  Side data: displaymatrix: rotation of %d.00 degrees\n", (F.col("o_orderkey") % 4) * 90 - 90)
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("key"), F.concat(F.lit("  Duration: 00:01:02.50, start: 0\n"), video, audio, turn).alias("probe"))


@query(
    "probed_media",
    f"""WITH {SQL_FILES} SELECT id, 62.5::DOUBLE AS lasting, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, CAST(kbps AS DOUBLE) AS video_kbps, tracks > 0 AS has_audio, CASE WHEN tracks > 0 THEN 'none' ELSE '' END AS audio_codec,
    CASE WHEN tracks > 0 THEN 1 ELSE 0 END AS tracks, CAST(CASE WHEN turn % 180 <> 0 THEN h ELSE w END AS INTEGER) AS shown FROM f""",
)
def _(spark, d):
    p = probed(spark, d).withColumn("m", probes.media(F.col("probe")))
    return p.select("id", F.col("m.duration").alias("lasting"), "m.width", "m.height", "m.video_kbps", "m.has_audio", "m.audio_codec", F.size(probes.audio_tracks(F.col("probe"))).alias("tracks"), probes.example(F.col("probe"))["width"].alias("shown"))


@query(
    "joinable_files",
    f"""WITH {SQL_FILES} SELECT key, count(*) AS files, bool_and(tracks > 0) AND count(DISTINCT (w, h, turn, tracks > 0)) = 1 AS same, CAST(sum(CASE WHEN tracks > 0 THEN 1 END) AS BIGINT) AS heard FROM f GROUP BY key""",
)
def _(spark, d):
    told = probed(spark, d).withColumn("settings", probes.settings(F.col("probe")))
    return probes.same_settings(told, ["key"], F.sum(F.when(F.col("settings.rate") == "48000 Hz", 1)).alias("heard"))


@query(
    "exact_rates",
    f"""WITH {SQL_FILES} SELECT id, CAST(CASE tbr WHEN '25' THEN 25 WHEN '29.97' THEN 30000 WHEN '23.976' THEN 24000 WHEN '60' THEN 60 WHEN '12.5' THEN 25 ELSE 24 END AS BIGINT) AS n, CAST(CASE WHEN tbr IN ('29.97', '23.976') THEN 1001 WHEN tbr = '12.5' THEN 2 ELSE 1 END AS BIGINT) AS d FROM f""",
)
def _(spark, d):
    return probes.with_rate(probed(spark, d), "probe").select("id", "rate.n", "rate.d")


# ---------------------------------------------------------------- places, shapes, digests

SQL_LEAST = r"greatest(80, least(250, 40 * length(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g'))))"


@query(
    "placed_words",
    rf"""WITH RECURSIVE {C.sql_with('words').removeprefix('WITH ')}, t AS (SELECT key, i // 20 AS segment, i % 20 AS i, w, i * 300 - 500 + (key * 7 + i * 13) % 400 AS a, i * 300 AS b, (i // 20) * 6000 AS s, (i // 20) * 6000 + 5000 AS e, {SQL_LEAST} AS least FROM words),
    r AS (SELECT *, greatest(a, s) AS raw, least(e, greatest(a, s)) AS start, a < s AS piled FROM t WHERE i = 0
      UNION ALL SELECT x.*, x.a, least(x.e, greatest(x.a, CASE WHEN r.piled THEN r.start + r.least ELSE r.start END)), r.piled AND x.a < x.s FROM r JOIN t x ON x.key = r.key AND x.segment = r.segment AND x.i = r.i + 1),
    p AS (SELECT key, segment, i, start, coalesce(lead(start) OVER (PARTITION BY key, segment ORDER BY i), least(e, greatest(b, start + 300))) AS stop FROM r)
    SELECT key, segment, count(*) AS words, CAST(sum(start * (i + 1)) AS BIGINT) AS starts, CAST(sum(stop * (i + 1)) AS BIGINT) AS ends FROM p GROUP BY key, segment""",
)
def _(spark, d):
    i = F.col("i")
    segment = F.expr("i div 20")
    words = C.words(spark, d).select(
        "key", segment.alias("segment"), (i % 20).alias("i"), "w", (i * 300 - 500 + (F.col("key") * 7 + i * 13) % 400).alias("a"), (i * 300).alias("b"), (segment * 6000).alias("s"), (segment * 6000 + 5000).alias("e")
    )
    told = placed.placed_in_segment(words)
    return told.groupBy("key", "segment").agg(F.count("*").alias("words"), F.sum(F.col("start") * (F.col("i") + 1)).alias("starts"), F.sum(F.col("end") * (F.col("i") + 1)).alias("ends"))


@query("waveform", f"{C.sql_with('points')} SELECT key, id AS n, CAST(round_even(100 * pow(cents / greatest(max(cents) OVER (PARTITION BY key), 1)::DOUBLE, 0.6), 0) AS BIGINT) AS height FROM points")
def _(spark, d):
    return placed.waveform(C.points(spark, d).select("key", F.col("id").alias("n"), F.col("cents").alias("peak")))


@query(
    "frame_times",
    """WITH v AS (SELECT o_orderkey AS id, o_custkey % 90 / 4.0::DOUBLE AS d, o_custkey % 60 AS n FROM orders), c AS (SELECT *, CASE WHEN d > 0 THEN list_transform(generate_series(0, 17), lambda i: d * (i + 0.5) / 18) ELSE [0.0::DOUBLE] END AS regular, list_transform(generate_series(1, n), lambda i: least(d - 0.05::DOUBLE, i * 0.75::DOUBLE + 0.15::DOUBLE)) AS after FROM v),
    t AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(list_concat(regular, after), lambda t: t >= 0 AND t < greatest(d, 0.1)), lambda t: round_even(t, 2)))) AS times FROM c)
    SELECT id, CAST(len(x) AS INTEGER) AS n, round(list_sum(x), 6) AS total FROM (SELECT id, CASE WHEN len(times) > 36 THEN list_sort(list_distinct(list_concat(list_transform(after[1:18], lambda t: round_even(t, 2)), list_filter(times, lambda t, i: i % 2 = 1))))[1:36] ELSE times END AS x FROM t)""",
)
def _(spark, d):
    o = C.table(spark, d, "orders")
    n = (F.col("o_custkey") % 60).cast("int")
    cuts = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i * 0.75)).otherwise(F.array().cast("array<double>"))
    told = o.select(F.col("o_orderkey").alias("id"), placed.frame_times(F.col("o_custkey") % 90 / 4.0, cuts).alias("x"))
    return told.select("id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, t: s + t), 6).alias("total"))


@query(
    "captions_in_clips",
    f"""{C.sql_with('intervals')}, c AS (SELECT key, id, s, s + {2 * C.HOUR} AS e FROM intervals WHERE id % 3 = 0), k AS (SELECT key, id, s, e + {C.HOUR} AS e FROM intervals WHERE id % 3 = 1),
    m AS (SELECT c.key, c.id, min(struct_pack(s := k.s, id := k.id, e := k.e)) AS clip FROM c JOIN k ON c.key = k.key AND k.s <= c.s AND c.s < k.e GROUP BY 1, 2)
    SELECT c.key, c.id, c.s, least(c.e, coalesce(m.clip.e, c.e)) AS e, m.clip.id AS clip FROM c LEFT JOIN m USING (key, id)""",
)
def _(spark, d):
    iv = C.intervals(spark, d)
    captions = iv.where("id % 3 = 0").select("key", "id", "s", (F.col("s") + 2 * C.HOUR).alias("e"))
    return placed.in_clips(captions, iv.where("id % 3 = 1").select("key", "id", "s", (F.col("e") + C.HOUR).alias("e")), 4 * C.HOUR)


@query(
    "cuts_at_words",
    f"""{C.sql_with('words')}, n AS (SELECT key, i, row_number() OVER (PARTITION BY key ORDER BY i) AS r, count(*) OVER (PARTITION BY key) AS n FROM words), c AS (SELECT key, min(i) AS id, min(i) * 300 + (key * 97) % (300 * min(n)) AS t FROM n GROUP BY key),
    d AS (SELECT c.*, w.i, row_number() OVER (PARTITION BY c.key ORDER BY abs(w.i * 300 - t), w.i) AS best FROM c JOIN n w ON w.key = c.key AND w.r > 1)
    SELECT c.key, c.id, CAST(c.t AS BIGINT) AS t, d.i AS word FROM c LEFT JOIN d ON d.key = c.key AND d.best = 1""",
)
def _(spark, d):
    words = C.words(spark, d).select("key", "i", (F.col("i") * 300).alias("a"))
    cuts = words.groupBy("key").agg(F.min("i").alias("id"), F.count("*").alias("n")).select("key", "id", (F.col("id") * 300 + (F.col("key") * 97) % (300 * F.col("n"))).alias("t"))
    return placed.nearest_word(cuts, words)


@query(
    "scored_vectors",
    """WITH v AS (SELECT vec_id % 7 AS key, vec_id AS id, vec_id % 50 AS energy, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    top AS (SELECT *, max(energy) OVER (PARTITION BY key, k) AS top FROM v), s AS (SELECT key, k, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM top WHERE energy > top - 40 GROUP BY key, k)
    SELECT v.key, v.id, CAST(v.k AS INTEGER) AS k, round((x - m) / sd, 5) AS mean, round(1 / sd, 5) AS deviation FROM v JOIN s USING (key, k)""",
)
def _(spark, d):
    each = C.vectors(spark, d).select((F.col("id") % 7).alias("key"), "id", (F.col("id") % 50).alias("energy"), F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    told = placed.scored(each.select("key", "id", "k", F.col("x").alias("mean"), F.lit(1.0).alias("deviation")), each.select("key", "k", "energy", "x"))
    return told.select("key", "id", "k", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"))


@query(
    "digests",
    "SELECT doc_id AS id, substr(sha1(coalesce(text, '')), 1, 16) AS digest, substr(sha256(coalesce(text, '')), 1, 16) AS content, substr(sha1(concat(source, coalesce(lang, ''))), 1, 16) AS part FROM documents",
)
def _(spark, d):
    t = C.table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    return t.select(F.col("doc_id").alias("id"), placed.digest(text).alias("digest"), placed.content_id(text).alias("content"), placed.part_key(F.col("source"), F.col("lang")).alias("part"))


@query(
    "whole_fractions",
    """WITH f AS (SELECT event_id AS id, CAST(round(value * 100) AS BIGINT) - 2000 AS n, 1 + event_id % 8 AS d, 1 + user_id % 5 AS m FROM events)
    SELECT id, CAST(floor(n * 2 / (d * m)::DOUBLE) AS BIGINT) AS divided, CAST(round_even(n / d::DOUBLE, 0) AS BIGINT) AS rounded FROM f""",
)
def _(spark, d):
    f = C.points(spark, d).select("id", (F.col("cents") - 2000).alias("n"), (1 + F.col("id") % 8).alias("d"), (1 + F.col("key") % 5).alias("m"))
    return f.select("id", placed.floor_divided(F.col("n"), F.col("d"), F.col("m"), F.lit(2)).alias("divided"), placed.rounded_fraction(F.col("n"), F.col("d")).alias("rounded"))


@query(
    "speakers_shown",
    f"""WITH RECURSIVE {C.sql_with('points').removeprefix('WITH ')}, k AS (SELECT key % 40 AS key, length(kind) % (1 + key % 4) AS speaker, id % 5 AS person, CAST(sum(cents) AS DOUBLE) AS total, count(*) AS n FROM points GROUP BY 1, 2, 3),
    g AS (SELECT *, total / (sum(total) OVER (PARTITION BY key, speaker)) AS part, total / n / 1000 AS lips FROM k), l AS (SELECT *, min(speaker) OVER (PARTITION BY key) = max(speaker) OVER (PARTITION BY key) AS single FROM g),
    w AS (SELECT key, speaker, person, 0 AS phase, -part AS a, -person::DOUBLE AS b, 0::DOUBLE AS c FROM l WHERE single AND part >= 0.3 UNION ALL SELECT key, speaker, person, 1, -lips, speaker, person FROM l WHERE NOT single AND lips >= 1.15
      UNION ALL SELECT key, speaker, person, 2, speaker, -part * 3, -person FROM l WHERE NOT single AND part * 3 >= 0.6),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY phase, a, b, c) AS r FROM w),
    t AS (SELECT key, speaker, person, r, true AS free, [speaker] AS ss, [person] AS ps FROM o WHERE r = 1
      UNION ALL SELECT o.key, o.speaker, o.person, o.r, NOT (list_contains(t.ss, o.speaker) OR list_contains(t.ps, o.person)),
        CASE WHEN list_contains(t.ss, o.speaker) OR list_contains(t.ps, o.person) THEN t.ss ELSE list_append(t.ss, o.speaker) END, CASE WHEN list_contains(t.ss, o.speaker) OR list_contains(t.ps, o.person) THEN t.ps ELSE list_append(t.ps, o.person) END FROM t JOIN o ON o.key = t.key AND o.r = t.r + 1)
    SELECT key, CAST(speaker AS BIGINT) AS speaker, person FROM t WHERE free""",
)
def _(spark, d):
    k = C.points(spark, d).groupBy((F.col("key") % 40).alias("key"), (F.length("kind") % (1 + F.col("key") % 4)).cast("long").alias("speaker"), (F.col("id") % 5).alias("person")).agg(F.sum("cents").cast("double").alias("total"), F.count("*").alias("n"))
    part = F.col("total") / F.sum("total").over(Window.partitionBy("key", "speaker"))
    links = k.select("key", "speaker", "person", (F.col("total") / F.col("n") / 1000).alias("lips"), (part * 3).alias("alone"), part.alias("seen"))
    return tracks.speakers_shown(links)


# ---------------------------------------------------------------- panels

SQL_FACES = f"""{C.sql_with('points').removeprefix('WITH ')}, f AS (SELECT key % 10 AS key, t, id, cents % 97 / 10.0::DOUBLE AS x, cents % 89 / 10.0::DOUBLE AS y, CASE WHEN (id + key) % 7 < 1 + key % 5 THEN cents % 31 / 10.0::DOUBLE END AS x0,
    CASE WHEN (id + key) % 7 < 1 + key % 5 THEN cents % 29 / 10.0::DOUBLE END AS y0, CASE WHEN (id + key) % 7 < 1 + key % 5 THEN 6 + cents % 37 / 10.0::DOUBLE END AS x1, CASE WHEN (id + key) % 7 < 1 + key % 5 THEN 6 + cents % 23 / 10.0::DOUBLE END AS y1 FROM points)"""
RANGE = f"OVER (PARTITION BY key ORDER BY t RANGE BETWEEN {6 * C.HOUR} PRECEDING AND {6 * C.HOUR} FOLLOWING)"


def faces_of(spark: SparkSession, d: str) -> DataFrame:
    p = C.points(spark, d)
    some = (F.col("id") + F.col("key")) % 7 < 1 + F.col("key") % 5
    part = lambda m, plus=0: plus + (F.col("cents") % m).cast("double") / 10.0
    return p.select((F.col("key") % 10).alias("key"), "t", "id", part(97).alias("x"), part(89).alias("y"), *[F.when(some, part(m, plus)).alias(e) for e, m, plus in (("x0", 31, 0), ("y0", 29, 0), ("x1", 37, 6), ("y1", 23, 6))])


@query(
    "steady_panels",
    f"""WITH {SQL_FACES}, u AS (SELECT *, count(*) {RANGE} AS n, count(x0) {RANGE} AS found, quantile_cont(x0, 0.7) {RANGE} AS u0, quantile_cont(y0, 0.7) {RANGE} AS u1, quantile_cont(x1, 0.3) {RANGE} AS u2, quantile_cont(y1, 0.3) {RANGE} AS u3 FROM f),
    w AS (SELECT key, count(*) AS n, count(x0) AS found, quantile_cont(x0, 0.7) AS w0, quantile_cont(y0, 0.7) AS w1, quantile_cont(x1, 0.3) AS w2, quantile_cont(y1, 0.3) AS w3 FROM f GROUP BY key),
    a AS (SELECT u.key, t, id, u.found > 0 AND u.found >= 0.4 * u.n AS near, w.found >= 0.25 * w.n AND x BETWEEN w0 AND w2 AND y BETWEEN w1 AND w3 AS own, u0, u1, u2, u3, w0, w1, w2, w3 FROM u JOIN w USING (key))
    SELECT key, t, id, round(CASE WHEN near THEN u0 ELSE w0 END, 6) AS x0, round(CASE WHEN near THEN u1 ELSE w1 END, 6) AS y0, round(CASE WHEN near THEN u2 ELSE w2 END, 6) AS x1, round(CASE WHEN near THEN u3 ELSE w3 END, 6) AS y1 FROM a WHERE near OR own""",
)
def _(spark, d):
    told = panels.steady_panels(faces_of(spark, d), 6 * C.HOUR)
    return told.select("key", "t", "id", *[F.round(e, 6).alias(e) for e in panels.EDGES])


@query(
    "filled_panels",
    f"""WITH {SQL_FACES}, p AS (SELECT * FROM f WHERE x0 IS NOT NULL), m AS (SELECT f.*, row_number() OVER (PARTITION BY f.key, f.t, f.id ORDER BY abs(p.t - f.t), p.t) AS r, p.t AS pt, p.x0 AS a, p.y0 AS b, p.x1 AS c, p.y1 AS d FROM f JOIN p ON f.key = p.key WHERE f.x0 IS NULL AND f.id % 2 = 0)
    SELECT key AS person, t, id, x0, y0, x1, y1 FROM p UNION ALL SELECT key, t, id, a, b, c, d FROM m WHERE r = 1 AND abs(pt - t) <= {C.HOUR} AND x BETWEEN a AND c AND y BETWEEN b AND d""",
)
def _(spark, d):
    f = faces_of(spark, d).withColumnRenamed("key", "person").withColumn("alone", F.col("id") % 2 == 1)
    return panels.filled_panels(f, f.where("x0 is not null"), C.HOUR)
