"""Runs, captures, jobs, listings and the site catalogue, mostly as SQL that Spark and DuckDB read alike.

Runs and jobs come from events (a day is a run, a user a job or site, `error` a failure), captures from documents (the
text is the image, the source the page). Nothing depends on the present time: the as-of date is 2024-01-31.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.functions.feeds import escaped, sitemap_entries
from weftline.plans.twin import Registry, read
from weftline.streaming.jobs import STAGES, job_states, progress
from weftline.streaming.logs import IDLE, LAPSE, frames
from weftline.streaming.pairing import LIMIT, paired

runs = Registry()

_DAY = "CAST(CAST(ts AS DATE) AS STRING)"
_RUNS = f"""(SELECT event_id, {_DAY} AS run, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS category, user_id AS site,
  event_type <> 'error' AS success, value AS duration, event_id % 101 AS success_rate FROM events)"""
_CAPTURES = """(SELECT doc_id, source AS page, text AS image, n_chars AS size, CASE WHEN doc_id % 3 = 0 THEN 'fullpage' WHEN doc_id % 3 = 1 THEN '1920x1080' ELSE '375x667' END AS viewport,
  CASE WHEN doc_id % 2 = 0 THEN '2024-01-30' ELSE '2023-12-15' END AS day FROM documents)"""


def same(name: str, sql: str, doc: str = "") -> None:
    """A query whose one text both engines read; tables are those it names."""
    tables = [t for t in ("events", "documents", "pages") if re.search(rf"\bFROM {t}\b|\bJOIN {t}\b", sql)]

    def query(spark, d):
        text = sql.replace("{", "{{").replace("}", "}}")
        return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables) or 'none'})\b", r"\1 {\2}", text), **{t: read(spark, d, t) for t in tables})

    query.__name__, query.__doc__ = name, doc
    runs(sql)(query)


_AVG = "coalesce(round(avg({0}), 4), 0.0)"
same("latest_run", f"SELECT run, count(*) AS total FROM {_RUNS} r WHERE run = (SELECT max(run) FROM {_RUNS} x) GROUP BY run")
same("last_two_runs", f"SELECT run, nth FROM (SELECT run, CAST(row_number() OVER (ORDER BY run DESC) AS INT) AS nth FROM (SELECT DISTINCT run FROM {_RUNS} r ORDER BY run DESC LIMIT 2) u) v", "Two rows are numbered; the limit is the feature.")
same(
    "summary_stats",
    f"""SELECT count(*) AS total, count(CASE WHEN success THEN 1 END) AS ok, count(CASE WHEN NOT success THEN 1 END) AS failed,
  round(CASE WHEN count(*) > 0 THEN 100e0 * count(CASE WHEN success THEN 1 END) / count(*) ELSE 0e0 END, 4) AS success_rate,
  round(sum(CASE WHEN success THEN duration END), 2) AS total_duration, {_AVG.format("CASE WHEN success THEN duration END")} AS avg_duration,
  min(CASE WHEN success THEN duration END) AS min_duration, max(CASE WHEN success THEN duration END) AS max_duration FROM {_RUNS} r""",
    "Sums and means are over successful rows; totals over all.",
)
same("stats_by_category", f"SELECT coalesce(category, 'unknown') AS category, count(*) AS n, {_AVG.format('duration')} AS avg_duration, {_AVG.format('success_rate')} AS avg_success_rate FROM {_RUNS} r WHERE success GROUP BY coalesce(category, 'unknown')")
same(
    "run_change_labels",
    f"""SELECT run, CASE WHEN before > 0 THEN round((mean - before) / before * 100, 4) ELSE 0e0 END AS change,
  CASE WHEN mean < before THEN 'FASTER' WHEN mean > before THEN 'SLOWER' ELSE 'SAME' END AS label,
  CASE WHEN rate > rate_before THEN 'BETTER' WHEN rate < rate_before THEN 'WORSE' ELSE 'SAME' END AS success_label
  FROM (SELECT run, mean, lag(mean) OVER (ORDER BY run) AS before, rate, lag(rate) OVER (ORDER BY run) AS rate_before
  FROM (SELECT run, coalesce(avg(CASE WHEN success THEN duration END), 0e0) AS mean, coalesce(avg(CASE WHEN success THEN success_rate END), 0e0) AS rate FROM {_RUNS} r GROUP BY run) c) l""",
    "Each run against the one before it: mean duration and mean success rate of its successful rows. One row a run is put in order.",
)
@runs(f"""SELECT site, rate, up = 1 AS best FROM (SELECT site, rate, row_number() OVER (ORDER BY rate DESC, site) AS up, row_number() OVER (ORDER BY rate, site) AS down
  FROM (SELECT site, round(100e0 * count(CASE WHEN success THEN 1 END) / count(*), 4) AS rate FROM {_RUNS} r GROUP BY site) s) t WHERE up = 1 OR down = 1""")
def best_worst(spark, d):
    """The sites with the highest and the lowest rate, ties to the smaller site; no window, so no task sees all sites."""
    rows = spark.sql(_RUNS[1:-1].replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))
    rates = rows.groupBy("site").agg(F.round(100.0 * F.count_if("success") / F.count("*"), 4).alias("rate"))
    both = rates.agg(F.max(F.struct("rate", (-F.col("site")).alias("key"))).alias("top"), F.min(F.struct("rate", F.col("site").alias("key"))).alias("low"))
    best = both.select((-F.col("top.key")).alias("site"), F.col("top.rate").alias("rate"), F.lit(True).alias("best")).where("site is not null")
    worst = both.where("low.key <> -top.key").select(F.col("low.key").alias("site"), F.col("low.rate").alias("rate"), F.lit(False).alias("best"))
    return best.union(worst)


_DOCUMENT = "SELECT run, count(*) AS total_experiments, count(CASE WHEN success THEN 1 END) AS successful, count(CASE WHEN NOT success THEN 1 END) AS failed FROM {0} r GROUP BY run"


@runs(f"""SELECT run || '.json' AS filename, '{{"timestamp":"' || run || 'T00:00:00","total_experiments":' || total_experiments || ',"successful":' || successful || ',"failed":' || failed || '}}' AS metadata FROM ({_DOCUMENT.format(_RUNS)}) m""")
def run_documents(spark, d):
    """The metadata of each run's document as JSON; sources.files.write_run() writes whole documents."""
    from weftline.sources.files import run_metadata

    rows = spark.sql(_RUNS[1:-1].replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))
    return rows.groupBy("run").agg(*run_metadata(F.concat("run", F.lit("T00:00:00")), F.col("success"))).select(F.concat("run", F.lit(".json")).alias("filename"), F.to_json("metadata").alias("metadata"))


same("union_schema", f"SELECT event_id, run, CAST(NULL AS STRING) AS page FROM {_RUNS} r UNION ALL SELECT doc_id, day, page FROM {_CAPTURES} c")
same("batch_summary", f"SELECT success, count(*) AS n, round(sum(duration), 2) AS duration FROM {_RUNS} r GROUP BY success")
@runs(f"""SELECT job, start, CASE WHEN near THEN nxt END AS "end", CASE WHEN near AND after = 'purchase' THEN 'success' WHEN near AND after = 'error' THEN 'error' ELSE 'failed' END AS outcome FROM (SELECT user_id AS job, event_id AS start, event_type, nxt, after,
  after IN ('purchase', 'error') AND epoch_us(at_next) - epoch_us(ts) <= {LIMIT * 1_000_000} AS near FROM (SELECT *, lead(event_id) OVER w AS nxt, lead(event_type) OVER w AS after, lead(ts) OVER w AS at_next FROM events WHERE event_type IN ('view', 'purchase', 'error')
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) e) f WHERE event_type = 'view'""")
def batch_pairing(spark, d):
    """Each start with the end that follows it at once in its job, and what that makes of it; streaming.pairing has the same on a stream."""
    kind = F.expr("CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'completed' ELSE event_type END")
    return paired(read(spark, d, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n"), kind.alias("kind")))


same("bulk_summary", "SELECT count(CASE WHEN event_type = 'purchase' THEN 1 END) AS completed, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, count(CASE WHEN event_type = 'view' THEN 1 END) AS skipped FROM events")
same("bulk_progress", "SELECT event_id, CAST(floor(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 100 / count(*) OVER (PARTITION BY user_id)) AS INT) AS progress FROM events")
@runs("""SELECT regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS bulk, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status IS NULL) AS skipped
  FROM (SELECT url, CASE page_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN NULL ELSE 'completed' END AS status FROM (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url) p) j GROUP BY 1""")
def bulk_status(spark, d):
    """Bulk jobs, one a host, with what became of the job of each of their URLs; a job goes by its URL in base64, and one that is not known was skipped."""
    pages = read(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    jobs = pages.where("page_id % 4 <> 1").select(U.job_id(F.col("url")).alias("job"), F.expr("CASE page_id % 4 WHEN 0 THEN 'error' ELSE 'completed' END").alias("status"))
    bulk = pages.select(F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1).alias("bulk"), U.job_id(F.col("url")).alias("job"))
    return bulk.join(jobs, "job", "left").groupBy("bulk").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status").isNull()).alias("skipped")
    )


_STATE = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cancelled' ELSE 'cloning' END"
_LAST = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"
@runs(f"SELECT user_id, {_STATE} AS status FROM {_LAST} e WHERE r = 1")
def job_status(spark, d):
    """The last state of each job, as on a stream."""
    return job_states(read(spark, d, "events")).select("user_id", "status")


#: The stages of a clone and the share done when each begins, in order; the twelfth is no stage.
_STAGE = "CASE CAST(event_id % 12 AS INT) " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STAGES)) + " ELSE 'unknown' END"
_DONE = "CASE CAST(event_id % 12 AS INT) " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(STAGES.values())) + " END"


@runs(f"SELECT user_id AS job, coalesce(arg_max(done, (ts, event_id)) FILTER (done IS NOT NULL), 0) AS percentage FROM (SELECT *, {_DONE} AS done FROM events) e GROUP BY user_id")
def progress_latest(spark, d):
    """The share done of each job by the latest of its known stages."""
    events = read(spark, d, "events").select("user_id", F.expr(_STAGE).alias("stage"), F.struct("ts", "event_id").alias("at"))
    return progress(events, "user_id", "stage", "at")


same("event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
same(
    "event_dispatch",
    "SELECT l.listener, count(*) AS n FROM events e JOIN (SELECT 'view' AS kind, 'a' AS listener UNION ALL SELECT 'view', 'b' UNION ALL SELECT 'error', 'a') l ON e.event_type = l.kind GROUP BY l.listener",
    "Each event goes to every listener of its type.",
)
_END = "(SELECT user_id AS job, ts AS stop, event_id AS nth FROM (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('purchase', 'error')) x WHERE r = 1)"
same("log_stream", f"SELECT e.user_id, e.event_id FROM events e LEFT JOIN {_END} t ON e.user_id = t.job WHERE t.stop IS NULL OR e.ts < t.stop OR (e.ts = t.stop AND e.event_id <= t.nth)", "Messages of a job until its first terminal one.")
def messages(spark, d):
    """Events as the log of their jobs: a purchase completes one, an error ends it."""
    status = F.expr("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' END")
    return read(spark, d, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n"), status.alias("status"), F.concat("event_type", F.lit(' "'), "event_id", F.lit('"')).alias("message"))


@runs(f"""WITH m AS (SELECT user_id AS job, epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-01') AS ms, event_id AS n, event_type IN ('purchase', 'error') AS stops, event_type, ts FROM events),
  b AS (SELECT *, lag(ms) OVER (PARTITION BY job ORDER BY ms, n) AS before FROM m), l AS (SELECT *, coalesce(ms - before > {LAPSE} * 1000, false) AS lapsed FROM b),
  o AS (SELECT *, coalesce(sum(CASE WHEN stops OR lapsed THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY ms, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ends FROM l),
  k AS (SELECT *, CASE WHEN lapsed THEN before + {LAPSE} * 1000 ELSE ms END AS shut FROM o WHERE ends = 0)
  SELECT job, unnest(range(before + {IDLE} * 1000, shut, {IDLE} * 1000)) AS ms, CAST(NULL AS BIGINT) AS n, ': heartbeat' || chr(10) || chr(10) AS frame FROM k WHERE before IS NOT NULL
  UNION ALL SELECT job, shut, CASE WHEN NOT lapsed THEN n END, 'data: ' || CASE WHEN lapsed THEN '{{"type":"status","status":"lapsed"}}' WHEN event_type = 'purchase' THEN '{{"type":"status","status":"completed"}}' WHEN stops THEN '{{"type":"status","status":"error"}}'
  ELSE '{{"type":"log","message":"' || event_type || ' \\"' || n || '\\""}}' END || chr(10) || chr(10) FROM k""")
def log_frames(spark, d):
    """The log of each job as frames: messages until the end, heartbeats where nothing is said, the status at last."""
    zero = F.unix_millis(F.lit("2024-01-01").cast("timestamp"))
    return frames(messages(spark, d)).select("job", (F.unix_millis("at") - zero).alias("ms"), "n", "frame")


@runs("SELECT user_id, count(*) AS total, round(100e0 * count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_rate, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS duration FROM events GROUP BY user_id")
def monitor_stats(spark, d):
    """Tries, share of good ones and whole seconds from first to last, by session."""
    seconds = F.unix_timestamp(F.max(F.col("ts").cast("timestamp"))) - F.unix_timestamp(F.min(F.col("ts").cast("timestamp")))
    rate = F.round(100.0 * F.count_if(F.col("event_type") != "error") / F.count("*"), 4)
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), rate.alias("success_rate"), seconds.alias("duration"))


_SESSION = f"""(SELECT user_id, event_id, ts, event_type <> 'error' AS ok, coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
  min(ts) OVER (PARTITION BY user_id) AS began FROM events)"""


@runs(f"""SELECT user_id, tries, captures, tries - captures AS failed, round(100e0 * captures / tries, 4) AS success_rate, array_to_string(e[greatest(len(e) - 9, 1):], ',') AS errors FROM (SELECT user_id, count(*) AS tries, count(*) FILTER (ok) AS captures,
  coalesce(list(CAST(done + 1 AS BIGINT) ORDER BY ts, event_id) FILTER (NOT ok), []) AS e FROM {_SESSION} s WHERE done < 5 AND ts < began + INTERVAL 10 DAY GROUP BY user_id) t""")
def monitor_sessions(spark, d):
    """A session ends with its fifth successful capture or after ten days, whichever is first; failures do not count. errors has the numbers of the captures that the last ten failures were tries of."""
    return monitored(read(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok")), "user_id", most=5, seconds=10 * 86400)


def monitored(tries, key: str, most: int | None = None, seconds: int | None = None):
    """(key, tries, captures, failed, success_rate, errors) of sessions of tries (key, ts, event_id, ok) that stop at `most` captures, or `seconds` after their first try."""
    by = Window.partitionBy(key).orderBy("ts", "event_id")
    rows = tries.withColumn("done", F.coalesce(F.count_if("ok").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("began", F.min("ts").over(Window.partitionBy(key)))
    if most:
        rows = rows.where(F.col("done") < most)
    if seconds:
        rows = rows.where(F.col("ts") < F.col("began") + F.make_dt_interval(secs=F.lit(seconds)))
    lost = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("ts", "event_id", (F.col("done") + 1).cast("string").alias("number")))))
    out = rows.groupBy(key).agg(F.count("*").alias("tries"), F.count_if("ok").alias("captures"), lost["number"].alias("e"))
    last = F.slice("e", F.greatest(F.size("e") - 9, F.lit(1)), 10)
    return out.select(key, "tries", "captures", (F.col("tries") - F.col("captures")).alias("failed"), F.round(100.0 * F.col("captures") / F.col("tries"), 4).alias("success_rate"), F.array_join(last, ",").alias("errors"))


same("last_errors", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error') e WHERE r <= 10 ORDER BY user_id, ts, event_id", "The last ten errors of a job, oldest first.")
@runs("SELECT event_id, 'data: ' || to_json({'type': event_type, 'job': user_id, 'message': event_type || ' \"' || user_id || '\"'}) || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark, d):
    """Server-sent frames: a JSON object, escaped, and an empty line."""
    said = F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("job"), F.concat("event_type", F.lit(' "'), "user_id", F.lit('"')).alias("message"))
    return read(spark, d, "events").select("event_id", F.concat(F.lit("data: "), F.to_json(said), F.lit("\n\n")).alias("frame"))


@runs("""SELECT event_id, '[' || repeat('█', filled) || repeat('░', 40 - filled) || '] ' || lpad(printf('%.1f', share), 5, ' ') || '% - ' || rpad(event_type, 20, ' ') AS bar FROM (SELECT *, CAST(floor(40 * share / 100) AS INTEGER) AS filled
  FROM (SELECT event_id, event_type, 100e0 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / count(*) OVER (PARTITION BY user_id) AS share FROM events) s) f""")
def progress_bar(spark, d):
    """How far each job had come with each of its events, as a bar."""
    by = Window.partitionBy("user_id")
    share = 100.0 * F.row_number().over(by.orderBy("ts", "event_id")) / F.count("*").over(by)
    return read(spark, d, "events").withColumn("share", share).select("event_id", bar(F.col("share"), F.col("event_type")).alias("bar"))


def bar(share, stage, width: int = 40):
    """[███░░░]  50.0% - stage, the stage to twenty characters. The signs and widths."""
    filled = F.floor(share * width / 100).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled), F.lit("] "), F.format_string("%5.1f", F.bround(share, 1)), F.lit("% - "), F.rpad(stage, F.greatest(F.length(stage), F.lit(20)), F.lit(" ")))



@runs(f"SELECT doc_id, original FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY page, image ORDER BY doc_id) AS original FROM {_CAPTURES} c) t WHERE doc_id <> original")
def detect_duplicates(spark, d):
    """Captures of a page whose image an earlier one has; images go by their sha256, not as texts."""
    rows = spark.sql(_CAPTURES[1:-1].replace("FROM documents", "FROM {documents}"), documents=read(spark, d, "documents"))
    rows = rows.select("doc_id", "page", F.coalesce(F.sha2("image", 256), F.lit("")).alias("hash"))
    first = rows.groupBy("page", "hash").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, ["page", "hash"]).where("doc_id <> original").select("doc_id", "original")


same("storage_stats", f"SELECT count(*) AS files, sum(size) AS bytes, round(sum(size) / 1048576e0, 2) AS mb, count(DISTINCT page) AS pages FROM {_CAPTURES} c")
same("retention_expired", f"SELECT count(*) AS expired FROM {_CAPTURES} c WHERE CAST(day AS DATE) < DATE '2024-01-01'")
same("gallery_stats", f"SELECT count(*) AS total, count(CASE WHEN day = '2024-01-30' THEN 1 END) AS today, count(DISTINCT page) AS pages, round(sum(size) / 1048576e0, 2) AS mb FROM {_CAPTURES} c")


@runs()
def file_scan(spark, d):
    """Files below a folder, by name, with their sizes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(d)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


#: The site catalogue by category: names and difficulties, in order. Fixed values.
SITES = {
    "static": (("Example.com", "easy"), ("Motherfucking Website", "easy"), ("Python Docs", "easy")),
    "server-rendered": (("WordPress.org News", "medium"), ("Django Project", "medium"), ("Ruby on Rails", "medium"), ("Wikipedia Article", "medium")),
    "single-page-app": (("React.dev", "hard"), ("Vue.js", "hard"), ("Angular.io", "hard")),
    "hybrid": (("Next.js", "hard"), ("Nuxt", "hard"), ("Remix", "hard")),
    "heavy-javascript": (("Figma Blog", "very hard"), ("Notion Features", "very hard"), ("Linear Features", "very hard")),
    "special-case": (("Tailwind CSS", "medium"), ("Google Fonts", "very hard"), ("Unsplash", "very hard"), ("MDN Web Docs", "medium")),
}
#: Named sets, in order; the third site of `quick` is not in the catalogue. Fixed values.
NAMED_SETS = {"quick": ("Example.com", "React.dev", "WordPress.org"), "competitive": ("Example.com", "WordPress.org News", "React.dev", "Vue.js", "Tailwind CSS")}
_ROWS = [(name, kind, level, i + 1) for kind, own in SITES.items() for i, (name, level) in enumerate(own)]
_SITES = "(SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', '{d}', {i}, {place})" for place, (n, k, d, i) in enumerate(_ROWS)) + ") AS v(name, category, difficulty, nth, place))"


def sites_named(names: list[str]) -> list[tuple[str, str, str, int]]:
    """Sites by name, whatever the case, in the order of the names; an unknown name is an error."""
    by = {row[0].lower(): row for row in _ROWS}
    lost = [n for n in names if n.lower() not in by]
    if lost:
        raise ValueError(f"no such sites: {', '.join(lost)}")
    return [by[n.lower()] for n in names]


#: Events as visits of the sites, by their user.
_VISITED = f"(SELECT s.name, s.category, s.difficulty, s.nth, s.place, e.event_id, e.event_type FROM {_SITES} s LEFT JOIN events e ON e.user_id % 20 = s.place)"


def visited(name: str, sql: str, doc: str) -> None:
    """A query over sites and their visits; the 20 sites go to the events, not the events to the sites."""
    same(name, sql.format(sites=_VISITED), doc)


visited("site_catalogue", "SELECT name, category, difficulty, nth, count(event_id) AS visits FROM {sites} s GROUP BY name, category, difficulty, nth", "The catalogue with the visits of each site.")
visited("site_counts", "SELECT category, difficulty, count(DISTINCT name) AS n, count(event_id) AS visits FROM {sites} s GROUP BY category, difficulty", "Sites and visits by category and difficulty.")
visited("sites_by_difficulty", "SELECT name, count(event_id) AS visits FROM {sites} s WHERE difficulty = 'hard' GROUP BY name", "Hard sites and their visits.")
visited("custom_set", "SELECT s.name, l.place, count(s.event_id) AS visits FROM {sites} s JOIN (SELECT * FROM (VALUES ('VUE.JS', 1), ('example.com', 2)) AS v(name, place)) l ON lower(s.name) = lower(l.name) GROUP BY s.name, l.place", "Sites by name, whatever the case, with their place in the list and their visits.")
visited("union_sites", "SELECT name, event_id FROM {sites} s WHERE category = 'static' UNION ALL SELECT name, event_id FROM {sites} s WHERE category = 'server-rendered'", "The visits of two tiers, one after the other.")
_SETS = "(SELECT * FROM (VALUES " + ", ".join(f"('{s}', {i + 1}, '{n}')" for s, own in NAMED_SETS.items() for i, n in enumerate(own)) + ") AS v(set_name, place, name))"
visited("named_sets", f"SELECT v.set_name, v.place, v.name, count(s.event_id) AS visits FROM {_SETS} v LEFT JOIN {{sites}} s ON s.name = v.name GROUP BY v.set_name, v.place, v.name", "The sites of each named set, in order, with their visits; one of them is in no catalogue.")

# Discovery: robots files, sitemaps and platforms, over text made from pages.

#: Where sitemaps and feeds usually are.
CANDIDATES = (
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.xml.gz", "/sitemap1.xml", "/sitemaps.xml", "/sitemap/sitemap.xml", "/sitemap/index.xml", "/wp-sitemap.xml",
    "/wp-sitemap-posts-post-1.xml", "/wp-sitemap-pages-1.xml", "/post-sitemap.xml", "/page-sitemap.xml", "/category-sitemap.xml", "/tag-sitemap.xml", "/author-sitemap.xml", "/sitemap.rss",
    "/sitemap.html", "/news-sitemap.xml", "/sitemap-news.xml", "/video-sitemap.xml", "/sitemap-video.xml", "/image-sitemap.xml", "/sitemap-image.xml", "/sitemap-en.xml", "/sitemap-us.xml",
    "/feed/", "/rss.xml", "/atom.xml", "/rss/", "/index.xml",
)
_SITE = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"


@runs(f"SELECT DISTINCT concat({_SITE}, c) AS candidate FROM pages, unnest([{', '.join(map(repr, CANDIDATES))}]) AS u(c)")
def sitemap_candidates(spark, d):
    return read(spark, d, "pages").select(F.expr(_SITE).alias("site")).distinct().select("site", F.explode(F.array(*map(F.lit, CANDIDATES))).alias("c")).select(F.concat("site", "c").alias("candidate"))


#: The titles of pages, as they stand in their markup.
_HEADED = "(SELECT page_id, url, regexp_replace(regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1), '&(amp|lt|gt|quot);', 'and') AS title FROM pages) headed"


@runs("SELECT page_id, url AS loc, nullif(title, '') AS title, 'Mon' AS lastmod FROM " + _HEADED.replace("'and')", "'and', 'g')"))
def parse_rss(spark, d):
    """A feed of each page with its address and title."""
    title, url = escaped(F.coalesce("title", F.lit(""))), escaped(F.col("url"))
    xml = F.concat(F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><pubDate>Mon</pubDate></item><item><title>no link</title></item></channel></rss>"))
    return _headed(spark, d).select("page_id", F.inline(sitemap_entries(xml))).select("page_id", "loc", "title", "lastmod")


@runs("SELECT page_id, url AS loc, nullif(title, '') AS title FROM " + _HEADED.replace("'and')", "'and', 'g')"))
def parse_atom(spark, d):
    """The same in the other form; the first link of an entry counts."""
    title, url = escaped(F.coalesce("title", F.lit(""))), escaped(F.col("url"))
    xml = F.concat(F.lit("<feed><entry><title>"), title, F.lit('</title><link href="'), url, F.lit('"/><link href="http://h/b"/></entry></feed>'))
    return _headed(spark, d).select("page_id", F.inline(sitemap_entries(xml))).select("page_id", "loc", "title")


def _headed(spark, d):
    return spark.sql("SELECT * FROM " + _HEADED.replace("FROM pages", "FROM {pages}"), pages=read(spark, d, "pages"))


same(
    "sitemap_union",
    "SELECT url AS loc FROM pages WHERE url LIKE 'https:%' UNION SELECT concat(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1), '/sitemap.xml') FROM pages UNION SELECT url FROM pages WHERE NOT url LIKE 'https:%'",
    "Addresses that markup and the usual places give, each once.",
)
same("except_frontier", "SELECT url FROM pages EXCEPT SELECT url FROM pages WHERE length(html) > 2000", "The frontier less what has been processed: pages that were stored with some content.")
