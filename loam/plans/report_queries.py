"""Reports: counts, cross tables, percentiles, running totals, comparisons. Rows are events (stage: event_type, latency: value) and exchanges."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators.ranks import at_ranks, percent, places
from ..sources.tables import EXCHANGES_SQL, MEMORIES_SQL, exchanges, memories, table, with_checkpoints
from .registry import query

EX = "WITH " + EXCHANGES_SQL


def events(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


EV = "WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) "
STAGES = ["click", "error", "purchase", "signup", "view"]


@query("rejection_stats", "WITH " + EXCHANGES_SQL + ", x AS (SELECT 's' || (conv_id % 3) AS stage, user_msg, answer FROM ex) SELECT stage, count(*) AS n, round(avg(octet_length(encode(user_msg))), 1) AS user_len, round(avg(octet_length(encode(answer))), 1) AS answer_len FROM x GROUP BY stage")
def rejection_stats(spark, sf):
    stage = F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string"))
    return exchanges(spark, sf).groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg(F.octet_length("user_msg")), 1).alias("user_len"), F.round(F.avg(F.octet_length("answer")), 1).alias("answer_len"))


@query("top_first_words", EX + ", w AS (SELECT lower(regexp_extract(trim(answer), '^([^ \\t\\n.,!?;:]*)', 1)) AS word FROM ex) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 15")
def top_first_words(spark, sf):
    return exchanges(spark, sf).groupBy(T.first_word(F.col("answer")).alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query("stage_shares", "SELECT event_type AS stage, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM events GROUP BY event_type")
def stage_shares(spark, sf):
    counted = table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("stage", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


@query("class_by_stage", "SELECT user_id % 4 AS class, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{s}') AS {s}" for s in STAGES) + " FROM events GROUP BY 1")
def class_by_stage(spark, sf):
    counted = table(spark, sf, "events").groupBy((F.col("user_id") % 4).alias("class")).pivot("event_type", STAGES).count()
    return counted.select("class", *[F.coalesce(s, F.lit(0)).alias(s) for s in STAGES])


@query("leak_rates", "SELECT user_id % 4 AS class, round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / count(*), 3) AS leak, round(100.0 * count(*) FILTER (WHERE event_type IN ('error', 'view')) / count(*), 3) AS lost FROM events GROUP BY 1")
def leak_rates(spark, sf):
    share = lambda test: F.round(100.0 * F.count_if(test) / F.count("*"), 3)
    return table(spark, sf, "events").groupBy((F.col("user_id") % 4).alias("class")).agg(share(F.col("event_type") == "purchase").alias("leak"), share(F.col("event_type").isin("error", "view")).alias("lost"))


BUCKETS = [(0, 100), (100, 500), (500, 1000), (1000, 5000), (5000, 32001)]


@query("length_buckets", "WITH b AS (SELECT doc_id, CASE " + " ".join(f"WHEN octet_length(encode(text)) >= {a} AND octet_length(encode(text)) < {b} THEN '{a}-{b}'" for a, b in BUCKETS) + " END AS bucket FROM documents) SELECT bucket, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS stored FROM b WHERE bucket IS NOT NULL GROUP BY bucket")
def length_buckets(spark, sf):
    size, bucket = F.octet_length("text"), F.lit(None)
    for a, b in BUCKETS:
        bucket = F.when((size >= a) & (size < b), F.lit(f"{a}-{b}")).otherwise(bucket)
    rows = table(spark, sf, "documents").select("doc_id", bucket.alias("bucket")).filter("bucket is not null")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 3 == 0).alias("stored"))


@query("compression", EX + ", c AS (SELECT octet_length(encode(user_msg)) * 1.0 / octet_length(encode(answer)) AS r, octet_length(encode(answer)) AS before, octet_length(encode(user_msg)) AS after FROM ex WHERE answer <> '') SELECT count(*) AS n, round(avg(r), 6) AS mean, round(list_sort(list(r))[count(*) // 2 + 1], 6) AS median, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after FROM c")
def compression(spark, sf):
    rows = exchanges(spark, sf).filter("answer <> ''").select((F.octet_length("user_msg") / F.octet_length("answer")).alias("r"), F.octet_length("answer").alias("b"), F.octet_length("user_msg").alias("a"))
    counted = rows.agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.sum("b").alias("before"), F.sum("a").alias("after"))
    middle = at_ranks(rows, [], "r", {"median": lambda n: F.floor(n / 2) + 1}).select(F.round("median", 6).alias("median"))
    return counted.crossJoin(F.broadcast(middle)).select("n", "mean", "median", "before", "after")


PERCENTS = (50, 90, 95, 99)


RANKS = {f"p{p}": percent(p) for p in PERCENTS}


LAT = ", ".join(f"quantile_disc(value, {p / 100}) AS p{p}" for p in PERCENTS)


@query("latency_overall", f"SELECT count(*) AS n, {LAT}, round(avg(value), 6) AS mean, max(value) AS most FROM events")
def latency_overall(spark, sf):
    rows = table(spark, sf, "events")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most")).crossJoin(at_ranks(rows, [], "value", RANKS)).select("n", *RANKS, "mean", "most")


@query("latency_by_stage", f"SELECT event_type AS stage, count(*) AS n, {LAT} FROM events GROUP BY event_type")
def latency_by_stage(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("stage"), "value")
    return rows.groupBy("stage").agg(F.count("*").alias("n")).join(at_ranks(rows, ["stage"], "value", RANKS), "stage").select("stage", "n", *RANKS)


@query("floor_percentiles", "WITH s AS (SELECT event_type AS stage, list_sort(list(value)) AS v FROM events GROUP BY event_type) SELECT stage, v[greatest(1, len(v) * 50 // 100)] AS p50, v[greatest(1, len(v) * 95 // 100)] AS p95 FROM s")
def floor_percentiles(spark, sf):
    """The value at floor(n * p / 100) - 1, from 0, of each sorted group."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("stage"), "value")
    return at_ranks(rows, ["stage"], "value", {f"p{p}": lambda n, p=p: F.greatest(F.lit(1), F.floor(n * p / 100)) for p in (50, 95)})


@query("score_distribution", "WITH s AS (SELECT list_sort(list(value)) AS v FROM events) SELECT v[1] AS low, round(list_avg(v), 6) AS mean, v[CAST(floor(len(v) * 0.1) AS BIGINT) + 1] AS p10, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.9) AS BIGINT) + 1] AS p90 FROM s")
def score_distribution(spark, sf):
    rows = table(spark, sf, "events")
    total = rows.agg(F.min("value").alias("low"), F.round(F.avg("value"), 6).alias("mean"))
    return total.crossJoin(at_ranks(rows, [], "value", {f"p{p}": lambda n, p=p: F.floor(n * p / 100) + 1 for p in (10, 50, 90)}))


@query("counter_sums", EV + "SELECT sum(k)::BIGINT AS k, count(*) FILTER (WHERE k > 50) AS high, round(sum(value), 4) AS total FROM ev WHERE event_type = 'purchase'")
def counter_sums(spark, sf):
    return events(spark, sf).filter("event_type = 'purchase'").agg(F.sum("k").alias("k"), F.count_if(F.col("k") > 50).alias("high"), F.round(F.sum("value"), 4).alias("total"))


@query("score_buckets", EV + "SELECT least(4, k // 20) AS bucket, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM ev GROUP BY 1")
def score_buckets(spark, sf):
    return events(spark, sf).groupBy(F.least(F.lit(4), F.expr("k div 20")).alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query("ab_totals", EV + "SELECT round(sum(value) FILTER (WHERE k % 2 = 0), 4) AS a, round(sum(value) FILTER (WHERE k % 2 = 1), 4) AS b, round(sum(value) FILTER (WHERE k % 2 = 1) - sum(value) FILTER (WHERE k % 2 = 0), 4) AS delta, round(100.0 * (sum(value) FILTER (WHERE k % 2 = 1) - sum(value) FILTER (WHERE k % 2 = 0)) / sum(value) FILTER (WHERE k % 2 = 0), 3) AS pct FROM ev")
def ab_totals(spark, sf):
    a, b = F.sum(F.when(F.col("k") % 2 == 0, F.col("value"))), F.sum(F.when(F.col("k") % 2 == 1, F.col("value")))
    return events(spark, sf).agg(F.round(a, 4).alias("a"), F.round(b, 4).alias("b"), F.round(b - a, 4).alias("delta"), F.round(100.0 * (b - a) / a, 3).alias("pct"))


@query("dashboard", "WITH " + MEMORIES_SQL + "SELECT count(*) AS memories, count(DISTINCT source) AS sources, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events) < 50 AS learning FROM mem")
def dashboard(spark, sf):
    own = memories(spark, sf).agg(F.count("*").alias("memories"), F.count_distinct("source").alias("sources"))
    log = table(spark, sf, "events").agg(F.count("*").alias("events"))
    return own.crossJoin(log).withColumn("learning", F.col("events") < 50)


GRID = [(least, share) for least in (100, 200, 400, 800, 1600, 3200, 6400) for share in (0.3, 0.6)]
GRID_SQL = ", ".join(f"({a}, {b})" for a, b in GRID)


@query("threshold_sweep", "WITH " + EXCHANGES_SQL + f", g(least, share) AS (VALUES {GRID_SQL}), r AS (SELECT least, share, round(avg(CASE WHEN octet_length(encode(answer)) < least AND score < share THEN 1.0 ELSE 0.0 END) - 2 * avg(CASE WHEN octet_length(encode(answer)) < least AND score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS gain FROM ex, g GROUP BY ALL) SELECT CAST(least AS INTEGER) AS least, CAST(share AS DOUBLE) AS share, gain FROM r ORDER BY gain DESC, least, share LIMIT 1")
def threshold_sweep(spark, sf):
    """All settings of the grid in one pass: the rows are read once, the settings are columns."""
    size, score = F.octet_length("answer"), F.col("score")
    share_of = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    gains = [F.struct(F.round(share_of((size < a) & (score < b)) - 2 * share_of((size < a) & (score >= 0.5)), 6).alias("gain"), F.lit(-a).alias("a"), F.lit(-b).alias("b")) for a, b in GRID]
    best = exchanges(spark, sf).agg(F.array_max(F.array(*gains)).alias("x"))
    return best.select((-F.col("x.a")).alias("least"), (-F.col("x.b")).alias("share"), F.col("x.gain").alias("gain"))


@query("label_matrix", "SELECT quality, count(*) AS n, count(*) FILTER (WHERE length(text) >= 200) AS stored, round(count(*) FILTER (WHERE length(text) >= 200) * 1.0 / count(*), 6) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def label_matrix(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    stored = F.count_if(F.length("text") >= 200)
    return rows.groupBy("quality").agg(F.count("*").alias("n"), stored.alias("stored"), F.round(stored / F.count("*"), 6).alias("recall"))


@query("labelled_rows", "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'unknown' WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def labelled_rows(spark, sf):
    label = F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "good").otherwise("bad")
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", label.alias("label"))


@query("matched_by_prefix", "WITH s AS (SELECT substr(text, 1, 100) AS key, count(*) AS matches FROM documents GROUP BY 1) SELECT d.doc_id, s.matches FROM documents d JOIN s ON substr(d.text, 1, 100) = s.key")
def matched_by_prefix(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 100).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("matches"))
    return keyed.join(sizes, "key").select("doc_id", "matches")


@query("run_comparison", EV + "SELECT coalesce(a.stage, b.stage) AS stage, coalesce(a.n, 0) AS first_run, coalesce(b.n, 0) AS second_run, round(coalesce(a.mean, 0), 6) AS first_mean FROM (SELECT event_type AS stage, count(*) AS n, avg(value) AS mean FROM ev WHERE k % 2 = 0 AND event_type <> 'view' GROUP BY 1) a FULL JOIN (SELECT event_type AS stage, count(*) AS n FROM ev WHERE k % 2 = 1 AND event_type <> 'click' GROUP BY 1) b USING (stage)")
def run_comparison(spark, sf):
    rows, stage = events(spark, sf), F.col("event_type").alias("stage")
    first = rows.filter("k % 2 = 0 and event_type <> 'view'").groupBy(stage).agg(F.count("*").alias("n1"), F.avg("value").alias("mean"))
    second = rows.filter("k % 2 = 1 and event_type <> 'click'").groupBy(stage).agg(F.count("*").alias("n2"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.join(second, "stage", "full").select("stage", zero("n1").alias("first_run"), zero("n2").alias("second_run"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("first_mean"))


@query("prompt_prefixes", "SELECT substr(text, 1, 12) AS prefix, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10")
def prompt_prefixes(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").groupBy(F.substring("text", 1, 12).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(10)


@query("stage_tallies", EV + "SELECT k % 3 AS run, event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean FROM ev GROUP BY ALL")
def stage_tallies(spark, sf):
    return events(spark, sf).groupBy((F.col("k") % 3).alias("run"), F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("prompt_lengths", "WITH s AS (SELECT role, list_sort(list(length(text))) AS v FROM conversations GROUP BY role) SELECT role, len(v)::BIGINT AS n, v[1] AS least, v[len(v) // 4 + 1] AS low, v[len(v) // 2 + 1] AS middle, v[3 * len(v) // 4 + 1] AS high, v[len(v)] AS most FROM s")
def prompt_lengths(spark, sf):
    """Quartiles of the texts' lengths."""
    rows = table(spark, sf, "conversations").select("role", F.length("text").cast("bigint").alias("size"))
    at = {"least": lambda n: F.lit(1), "low": lambda n: F.floor(n / 4) + 1, "middle": lambda n: F.floor(n / 2) + 1, "high": lambda n: F.floor(3 * n / 4) + 1, "most": lambda n: n}
    return rows.groupBy("role").agg(F.count("*").alias("n")).join(at_ranks(rows, ["role"], "size", at), "role").select("role", "n", *at)


@query("steward_totals", "SELECT sum(s)::BIGINT AS scored, sum(p)::BIGINT AS pruned, max(t) AS elapsed FROM (SELECT event_type, count(*) AS s, count(*) FILTER (WHERE value < 1) AS p, max(value) AS t FROM events GROUP BY 1)")
def steward_totals(spark, sf):
    by = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("s"), F.count_if(F.col("value") < 1).alias("p"), F.max("value").alias("t"))
    return by.agg(F.sum("s").alias("scored"), F.sum("p").alias("pruned"), F.max("t").alias("elapsed"))


@query("checkpoints", EV + "SELECT k // 10 AS wave, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, round(count(*) FILTER (WHERE event_type = 'error') * 1.0 / count(*), 6) AS error_rate FROM ev GROUP BY 1")
def checkpoints(spark, sf):
    rows = events(spark, sf).select(F.expr("k div 10").alias("wave"), "event_type", "value")
    counted = rows.groupBy("wave").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("error_rate"))
    at = at_ranks(rows, ["wave"], "value", {"p50": percent(50), "p99": percent(99)}).withColumnRenamed("wave", "own")
    return counted.join(at, F.col("wave").eqNullSafe(F.col("own")), "left").select("wave", "n", "p50", "p99", "error_rate")


@query("wave_deltas", EV + "SELECT wave, n, n - coalesce(lag(n) OVER (ORDER BY wave), 0) AS delta FROM (SELECT k // 10 AS wave, count(*) AS n FROM ev GROUP BY 1)")
def wave_deltas(spark, sf):
    waves = events(spark, sf).groupBy(F.expr("k div 10").alias("wave")).agg(F.count("*").alias("n"))
    return waves.withColumn("delta", F.col("n") - F.coalesce(F.lag("n").over(Window.orderBy("wave")), F.lit(0)))


@query("running_duplicates", EV + "SELECT event_id, sum(CASE WHEN k < 10 THEN 1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT AS cumulative FROM ev")
def running_duplicates(spark, sf, run: int = 4096):
    """Running totals of all rows: inside runs of ids, plus what the runs before come to, which is added up in runs of runs alike, so that no task orders all rows."""
    rows = events(spark, sf).select("event_id", F.expr(f"event_id div {run}").alias("run"), (F.col("k") < 10).cast("bigint").alias("n"))

    def before(table, group):
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy("run"))
        return table.withColumn("before", upto - F.col("n"))

    runs = rows.groupBy("run").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("above", F.expr(f"run div {run}"))
    higher = before(runs.groupBy(F.col("above").alias("run")).agg(F.sum("n").alias("n")), []).select(F.col("run").alias("above"), F.col("before").alias("far"))
    offsets = before(runs, ["above"]).join(F.broadcast(higher), "above").select("run", (F.col("before") + F.col("far")).alias("offset"))
    inside = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("run").orderBy("event_id"))
    return rows.withColumn("inside", inside).join(offsets, "run").select("event_id", (F.col("inside") + F.col("offset")).alias("cumulative"))


@query("recent_log", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_log(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type")


@query("export_files", "WITH " + MEMORIES_SQL + ", x AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality_score, 0) DESC, created_at, id) AS place, count(*) OVER (PARTITION BY source) AS n FROM mem WHERE coalesce(quality_score, 0) = 0 OR quality_score >= 0.5) SELECT id, source, place, n FROM x")
def export_files(spark, sf):
    with_checkpoints(spark)
    kept = memories(spark, sf).filter((F.coalesce("quality_score", F.lit(0.0)) == 0) | (F.col("quality_score") >= 0.5)).select("id", "source", "created_at", F.coalesce("quality_score", F.lit(0.0)).alias("quality"))
    sizes = kept.groupBy("source").agg(F.count("*").alias("n"))
    return places(kept, ["source"], [F.desc("quality"), F.asc("created_at"), F.asc("id")]).join(sizes, "source").select("id", "source", "place", "n")
