"""Sources and sinks. Queries that write use a fresh path in the shared scratch folder."""

from pyspark.sql import functions as F

from corpusdeck.operators.patterns import mine_patterns
from corpusdeck.session import scratch_path
from corpusdeck.sources import files, pages, patterns, records as store, runs
from corpusdeck.sources.tables import read_table
from workload import fixtures as fx
from workload.registry import ORACLES, query
from workload.rollup_queries import RECORDS, records


@query(
    "assemble_pages",
    """SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id""",
)
def assemble_pages(spark, sf):
    turns = read_table(spark, sf, "conversations")
    return pages.assemble_pages(turns, doc="conv_id", page="turn")


@query(
    "assemble_pages_fallback",
    """WITH answers AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text || chr(10) END, '' ORDER BY turn), '') AS text
           FROM conversations WHERE turn > 0 GROUP BY conv_id),
         everything AS (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
       SELECT conv_id, coalesce(nullif(a.text, ''), e.text) AS text FROM answers a FULL JOIN everything e USING (conv_id)""",
)
def assemble_pages_fallback(spark, sf):
    turns = read_table(spark, sf, "conversations")
    # Without the first turns some conversations are in the fallback only.
    answers = turns.filter("turn > 0").withColumn("text", F.when(F.col("role") == "assistant", F.col("text")).otherwise(""))
    return pages.assemble_pages(answers, turns, doc="conv_id", page="turn")


@query(
    "page_metadata",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
          nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), '') AS title FROM pages)
        SELECT host, coalesce(arg_min(title, page_id) FILTER (title IS NOT NULL), 'Unknown') AS title, 'Unknown' AS author,
          count(*) AS pages, '2024-06-30' AS extraction_date FROM p GROUP BY host""",
)
def page_metadata(spark, sf):
    raw = read_table(spark, sf, "pages")
    rows = raw.select(
        "page_id",
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
        pages.html_title(F.col("html")).alias("title"),
        pages.html_author(F.col("html")).alias("author"),
    )
    return pages.page_metadata(rows, fx.as_of(), doc="host", page="page_id")


@query(
    "training_sink",
    f"WITH {RECORDS} SELECT type, source_file, count(*) AS records FROM records GROUP BY type, source_file",
)
def training_sink(spark, sf):
    path = scratch_path(spark, "training-sink")
    store.write_training(records(spark, sf), path)
    stored = store.read_training(spark, path)
    return stored.groupBy("type", "source_file").agg(F.count("*").alias("records"))


@query(
    "training_scan",
    f"WITH {RECORDS} SELECT type, text, sentiment, confidence, category, score, source_file, timestamp FROM records",
)
def training_scan(spark, sf):
    path = scratch_path(spark, "training-scan")
    store.write_training(records(spark, sf), path)
    return store.read_training(spark, path).withColumn("confidence", F.round("confidence", 6))


@query("training_scan_list", ORACLES["training_scan"])
def training_scan_list(spark, sf):
    """The list layout, beside a file that breaks off and one that holds an object alone."""
    path = scratch_path(spark, "training-list")
    store.write_training(records(spark, sf), path, layout="list")
    strays = [('[{"type": "sentiment", "text": "cut"}, {"type"',), ('{"type": "sentiment", "text": "alone"}',)]
    for k, row in enumerate(strays):
        spark.createDataFrame([row], "value string").coalesce(1).write.text(f"{path}/stray-{k}")
    return store.read_training(spark, path, "part", "list", ".txt").withColumn("confidence", F.round("confidence", 6))


@query("patterns_sink", ORACLES["mine_patterns"])
def patterns_sink(spark, sf):
    path = scratch_path(spark, "patterns")
    patterns.write_patterns(mine_patterns(fx.docs(spark, sf), fx.category_lexicon), path)
    return patterns.read_patterns(spark, path).select("category", F.array_join("keywords", ",").alias("keywords"))


@query(
    "run_metadata",
    """SELECT '2024-06-30T12:00:00' AS training_date, count(*) AS samples, 3 AS epochs, 'models/sentiment' AS artifact, '2.0' AS version
       FROM documents""",
)
def run_metadata(spark, sf):
    path = scratch_path(spark, "runs")
    info = fx.raw_docs(spark, sf).agg(F.count("*").alias("samples")).withColumn("epochs", F.lit(3))
    earlier = F.lit("2024-01-01 00:00:00").cast("timestamp")
    runs.append_run(runs.run_record(info.withColumn("epochs", F.lit(1)), {"sentiment": "models/old"}, earlier), path)
    runs.append_run(runs.run_record(info, {"sentiment": "models/sentiment"}, fx.as_of()), path)
    latest = runs.latest_run(spark, path)
    return latest.withColumn("artifact", F.col("artifacts")["sentiment"]).drop("artifacts")


@query(
    "model_metrics",
    """WITH m AS (SELECT 'quality' AS model, avg(quality) AS share FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels)
       SELECT model, '2024-06-30T12:00:00' AS training_date, 3 AS epochs, round(greatest(share, 1 - share), 6) AS majority_accuracy,
         (SELECT count(*) FROM labels)::DOUBLE AS samples FROM m""",
)
def model_metrics(spark, sf):
    """The latest figures of each model: here of the one that always says the more frequent label."""
    path = scratch_path(spark, "metrics")
    labels = read_table(spark, sf, "labels")
    shares = labels.agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.count("*").alias("samples"))
    each = shares.select("samples", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("model", "share"))
    measured = each.select("model", F.lit(3).alias("epochs"), F.greatest("share", 1 - F.col("share")).alias("majority_accuracy"), "samples")
    earlier = measured.withColumn("epochs", F.lit(1)).withColumn("majority_accuracy", F.lit(0.0))
    runs.append_run(runs.metrics_record(earlier, F.lit("2024-01-01 00:00:00").cast("timestamp")), path)
    runs.append_run(runs.metrics_record(measured, fx.as_of()), path)
    latest = runs.latest_metrics(spark, path)
    figures = [F.col("metrics")[m].alias(m) for m in ("majority_accuracy", "samples")]
    return latest.select("model", "training_date", "epochs", *figures).withColumn("majority_accuracy", F.round("majority_accuracy", 6))
