"""Benchmark logs as tables: lines are cut at their first colon, fields at equals signs, table rows from the right.

What a log holds: a sweep line names the system and fields for all blocks after
it; a result line, in a frame of equals signs, opens a block; within it, lines of
fields (the last that gives a field counts), a line of queries per second, lines
of latency fields and tables of samples; a recall line closes it. A block whose
recall is missing is a point only if the log ends with it (its recall is null):
otherwise the run was broken off. Lines before a block, and after its recall
until the next, belong to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed words of the log lines.
SWEEP, RESULT, SAMPLES, QPS, RECALL = "Sweep", "Result", "Tech-Analysis Samples", "QPS", "Recall @"
LATENCY = {"QueryLatency(ms)": "query", "BatchLatency(ms)": "batch"}
OPENS_FIELDS = ("topk=", "num_blocks=", "batch=", "mini_batch=")
STATISTICS = ("avg", "p50", "p90", "p99", "max")
#: Columns of a point and the fields they come from.
FIELDS = {"ef": "ef_search", "num_blocks": "num_blocks", "mini_batch": "mini_batch", "batch": "batch", "queries_per_block": "queries_per_block", "pipe_width": "pipe_width"}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """stem, line, text of log files."""
    rows = spark.read.option("wholetext", True).text(path).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1))
    return rows.select("stem", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))


def _fields(text: Column) -> Column:
    """name -> value of a line's name=value words; of a repeated name, the last."""
    words = F.filter(F.split(F.translate(text, ",\t", "  "), " "), lambda w: F.instr(w, "=") > 1)
    pairs = F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.substring_index(w, "=", -1).alias("v")))
    return F.map_from_entries(F.aggregate(pairs, F.slice(pairs, 1, 0), lambda kept, x: F.concat(F.filter(kept, lambda y: y["k"] != x["k"]), F.array(x))))


def marked(lines: DataFrame) -> DataFrame:
    """Lines with their head (before the first colon), rest, block, the sweep line the block began under, and whether a table of samples or the recall came before.

    lines: stem, line, text. A log is the unit of order; logs are as many as runs.
    """
    plain = F.trim(F.translate(F.regexp_replace("text", "\\e\\[[^m]*m", ""), "\r\t", "  "))
    rows = lines.select("stem", "line", plain.alias("said"))
    colon = F.instr("said", ":")
    rows = rows.withColumn("head", F.when(colon > 0, F.trim(F.substring_index("said", ":", 1))).otherwise("")).withColumn("rest", F.when(colon > 0, F.expr("trim(substring(said, instr(said, ':') + 1))")))
    framed = F.col("said").startswith("=") & F.col("said").endswith("=")
    title = F.trim(F.expr("trim(BOTH '=' FROM said)"))
    sweep = F.size(F.split("head", " ")) == 2
    sweep = sweep & (F.substring_index("head", " ", -1) == SWEEP)
    opens = framed & title.endswith(f" {RESULT}")
    along = Window.partitionBy("stem").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.sum(opens.cast("int")).over(along))
    rows = rows.withColumn("under", F.last(F.when(sweep, F.struct(F.substring_index("head", " ", 1).alias("system"), "rest")), True).over(along)).where("block > 0")
    rows = rows.withColumn("opens", opens).withColumn("title", F.when(opens, F.substring_index(title, " ", 1)))
    within = Window.partitionBy("stem", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    table = F.col("said").startswith("=") & F.contains(F.col("said"), F.lit(SAMPLES))
    seen = lambda c: F.coalesce(F.max(c).over(within), F.lit(False))
    rows = rows.withColumn("is_recall", F.col("head").startswith(f"{RECALL} ") & F.expr("try_cast(get(split(rest, ' '), 0) AS DOUBLE) IS NOT NULL"))
    return rows.withColumn("in_table", seen(table)).withColumn("closed", seen(F.col("is_recall")))


def parse_points(lines: DataFrame) -> DataFrame:
    """stem, block, system and the numbers of each result block.

    blocks is the mini-batch or else the number of blocks or else the batch; the
    pipe width is 1 where none is said.
    """
    rows = marked(lines).where("not closed")
    fields = F.when(F.greatest(*(F.col("said").startswith(w) for w in OPENS_FIELDS)), _fields(F.col("said")))
    kind = F.substring_index("head", " ", -1)
    first = lambda text: F.expr(f"try_cast(get(split({text}, ' '), 0) AS DOUBLE)")
    rows = rows.withColumn("own", fields).withColumn("number", first("rest")).withColumn("latency", F.when(kind.isin(*LATENCY), _fields(F.col("rest"))))

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("line")))

    def number(of: Column, name: str) -> Column:
        return F.try_element_at(of, F.lit(name)).try_cast("double")

    points = rows.groupBy("stem", "block").agg(
        F.coalesce(F.max_by("under.system", F.when(F.col("opens"), F.col("line"))), F.max("title")).alias("system"),
        F.max_by("under.rest", F.when(F.col("opens"), F.col("line"))).alias("sweep"),
        last(F.when(F.col("head") == QPS, F.col("number"))).alias("qps"),
        last(F.when(F.col("is_recall"), F.col("number"))).alias("recall"),
        *(last(F.when(kind == word, number(F.col("latency"), s))).alias(f"{name}_{s}") for word, name in LATENCY.items() for s in STATISTICS),
        *(last(number(F.col("own"), field)).alias(name) for name, field in FIELDS.items()),
    )
    said = F.when(F.col("sweep").isNotNull(), _fields(F.col("sweep")))
    points = points.withColumns({name: F.coalesce(F.col(name), number(said, field)).cast("long") for name, field in FIELDS.items()})
    ends = F.col("block") == F.max("block").over(Window.partitionBy("stem"))
    points = points.withColumn("ends", ends).where("qps is not null and (recall is not null or ends)").drop("sweep", "ends")
    return points.withColumn("pipe_width", F.coalesce("pipe_width", F.lit(1).cast("long"))).withColumn("blocks", F.coalesce("mini_batch", "num_blocks", "batch", F.lit(0).cast("long")))


def parse_samples(lines: DataFrame) -> DataFrame:
    """stem, block, line, metric, count, avg, p50, p90, p99, max of the rows of sample tables: six numbers at the right, the metric left of them."""
    words = F.filter(F.split("said", " "), lambda w: w != "")
    rows = marked(lines).where("in_table and not closed").withColumn("words", words).where(F.size("words") > 6)
    numbers = F.transform(F.slice("words", -6, 6), lambda w: w.try_cast("double"))
    rows = rows.select("stem", "block", "line", F.array_join(F.slice("words", 1, F.size("words") - 6), " ").alias("metric"), numbers.alias("n"))
    rows = rows.where(F.forall("n", lambda x: x.isNotNull()) & (F.get("n", 0) == F.floor(F.get("n", 0))) & F.col("metric").rlike("^[A-Za-z]"))
    return rows.select("stem", "block", "line", "metric", *(F.get("n", i).alias(c) for i, c in enumerate(("count", *STATISTICS))))
