"""The registered queries over the driver's tables, each beside the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lines as L
from weftline.operators import merge, order
from weftline.options import GeneratorOptions
from weftline.sinks.files import concat_parts, write_parts, write_run
from weftline.sources import generator
from weftline.sources.text_lines import parse_lines, read_run, scan_text
from weftline.staging import staged_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Runs, merge width, shards and the prefix length that the queries use.
RUNS, WIDTH, SHARDS, PREFIX = 16, 4, 16, 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").cast("bigint").alias("number"), F.col("event_type").alias("text"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("number"), F.col("p_name").alias("text"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("number"), "text")


def through_files(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The lines written as text and scanned again, so that the real source is what runs."""
    lines.write.option("lineSep", "\n").text(path := staged_path(spark, "lines"))
    return scan_text(spark, path)


EVENTS_RANKED = "SELECT event_id AS number, event_type AS text, row_number() OVER (ORDER BY event_type NULLS FIRST, event_id NULLS FIRST) AS rn FROM events"


@query(EVENTS_RANKED)
def sort_full(spark, d):
    return order.ranked(order.sort_lines(events(spark, d)))


@query(EVENTS_RANKED)
def sort_single(spark, d):
    return order.ranked(order.sort_single(events(spark, d)))


@query(EVENTS_RANKED)
def sort_shard(spark, d):
    return order.ranked(order.sort_shard(events(spark, d), SHARDS))


@query("SELECT doc_id AS number, text, row_number() OVER (ORDER BY text NULLS FIRST, doc_id NULLS FIRST) AS rn FROM documents")
def sort_unicode(spark, d):
    return order.ranked(order.sort_lines(documents(spark, d)))


@query("SELECT turn AS number, role AS text, row_number() OVER (ORDER BY role NULLS FIRST, turn NULLS FIRST) AS rn FROM conversations")
def sort_ties(spark, d):
    return order.ranked(order.sort_lines(table(spark, d, "conversations").select(F.col("turn").alias("number"), F.col("role").alias("text"))))


@query(f"""WITH p AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS pos FROM events)
SELECT event_id AS number, event_type AS text, row_number() OVER (ORDER BY event_type NULLS FIRST, event_id) AS rn FROM p WHERE pos <= {PREFIX}
UNION ALL SELECT event_id, event_type, pos FROM p WHERE pos > {PREFIX}""")
def sort_prefix_n(spark, d):
    return order.sort_prefix(events(spark, d), PREFIX)


def runs(spark, d):
    return events(spark, d).withColumn("run", F.pmod("number", F.lit(RUNS)))


@query(f"SELECT event_id AS number, event_type AS text, event_id % {RUNS} AS run, row_number() OVER (PARTITION BY event_id % {RUNS} ORDER BY event_type NULLS FIRST, event_id) AS rn FROM events")
def sorted_runs(spark, d):
    return order.sorted_runs(runs(spark, d), "run", RUNS)


@query(f"""SELECT event_id AS number, event_type AS text, (event_id % {RUNS}) // {WIDTH} AS merge_group,
row_number() OVER (PARTITION BY (event_id % {RUNS}) // {WIDTH} ORDER BY event_type NULLS FIRST, event_id) AS rn FROM events""")
def merge_groups(spark, d):
    grouped = runs(spark, d).withColumn("merge_group", order.merge_groups(F.col("run"), WIDTH)).drop("run")
    return order.sorted_runs(grouped, "merge_group", RUNS // WIDTH)


@query(f"SELECT event_id AS number, event_type AS text, event_id % {RUNS} AS run, row_number() OVER (ORDER BY event_type NULLS FIRST, event_id) AS rn FROM events")
def merge_runs(spark, d):
    """Sixteen sorted runs in files, merged four at a time: one level to four runs, then the last merge."""
    merge.write_runs(runs(spark, d).withColumn("of", F.col("run")), path := staged_path(spark, "runs"), "run")
    return order.ranked(merge.merge_runs(spark, path, WIDTH)).withColumnRenamed("of", "run")


@query("SELECT concat(p_partkey, '. ', p_name) AS value FROM part")
def scan_lines(spark, d):
    return through_files(spark, parts(spark, d).select(L.format_line(F.col("number"), F.col("text")).alias("value")))


@query("SELECT CASE WHEN p_partkey % 3 = 1 THEN concat(p_partkey, '. ', p_name, chr(13)) ELSE concat(p_partkey, '. ', p_name) END AS value FROM part")
def scan_crlf(spark, d):
    """One of three lines ends in CR LF, another in CR CR LF, of which one CR is data."""
    k = F.col("number") % 3
    cr = F.when(k == 0, "\r").when(k == 1, "\r\r").otherwise("")
    return through_files(spark, parts(spark, d).select(F.concat(L.format_line(F.col("number"), F.col("text")), cr).alias("value")))


@query("SELECT p_partkey AS number, p_name AS text FROM part WHERE p_partkey % 5 <> 0")
def scan_skip_blank(spark, d):
    line = F.when(F.col("number") % 5 == 0, "").otherwise(L.format_line(F.col("number"), F.col("text")))
    return parse_lines(through_files(spark, parts(spark, d).select(line.alias("value"))), blank_lines="skip")


#: How the lines of the parse queries are damaged, by p_partkey modulo 16: Spark's and DuckDB's expression of it.
DAMAGE = {
    0: "concat({k}, '.', {t})", 1: "concat('. ', {t})", 2: "concat('abc. ', {t})", 3: "''", 4: "{t}", 5: "concat({k}, 'abc. ', {t})",
    6: "concat('-', {k}, '. ', {t})", 7: "concat('+', {k}, '. ', {t})", 8: "concat('007. ', {t})", 9: "concat('9223372036854775808. ', {t})",
    10: "concat(' ', {k}, '. ', {t})", 11: "concat({k}, '.  ', {t}, '. B. c')", 12: "concat({k}, '. ')", 13: "concat({k}, '.5. ', {t})",
}
LINE = "CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN {x.format(k='p_partkey', t='p_name')}" for i, x in DAMAGE.items()) + " ELSE concat(p_partkey, '. ', p_name) END"
DAMAGED = f"WITH l AS (SELECT p_partkey, {LINE} AS v FROM part), q AS (SELECT *, instr(v, '.') AS dot FROM l), r AS (SELECT *, substring(v, 1, greatest(dot - 1, 0)) AS pre, substring(v, 1, greatest(instr(v, '. ') - 1, 0)) AS spre FROM q)"
LENIENT_OK = "dot > 1 AND substring(v, dot + 1, 1) = ' ' AND try_cast(nullif(regexp_extract(pre, '^[+-]?[0-9]+'), '') AS BIGINT) IS NOT NULL"
STRICT_NUMBER = "CASE WHEN regexp_matches(spre, '^\\s*[+-]?[0-9]+\\s*$') THEN try_cast(trim(spre) AS BIGINT) END"


def damaged(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.expr(LINE).alias("value"))


@query(f"""{DAMAGED} SELECT CASE WHEN ok THEN try_cast(regexp_extract(pre, '^[+-]?[0-9]+') AS BIGINT) END AS number, CASE WHEN ok THEN substring(v, dot + 2) END AS text, CASE WHEN NOT ok THEN v END AS bad_line
FROM (SELECT *, {LENIENT_OK} AS ok FROM r)""")
def parse_lenient(spark, d):
    return parse_lines(damaged(spark, d), on_error="quarantine")


@query(f"""{DAMAGED} SELECT CASE WHEN ok THEN num END AS number, CASE WHEN ok THEN substring(v, instr(v, '. ') + 2) END AS text, CASE WHEN NOT ok THEN v END AS bad_line
FROM (SELECT *, num IS NOT NULL AND instr(v, '. ') > 1 AS ok FROM (SELECT *, {STRICT_NUMBER} AS num FROM r))""")
def parse_strict(spark, d):
    return parse_lines(damaged(spark, d), strict=True, on_error="quarantine")


@query(f"{DAMAGED} SELECT p_partkey, try_cast(regexp_extract(pre, '^[+-]?[0-9]+') AS BIGINT) AS number, CAST(dot + 1 AS INTEGER) AS text_offset FROM r WHERE {LENIENT_OK}")
def parse_offset(spark, d):
    v = F.col("value")
    return damaged(spark, d).filter(L.lenient_ok(v)).select("p_partkey", L.leading_number(v).alias("number"), L.text_offset(v).alias("text_offset"))


@query(f"{DAMAGED} SELECT count(*) FILTER (NOT ({LENIENT_OK})) AS malformed, count(*) AS line_count FROM r")
def malformed_count(spark, d):
    return damaged(spark, d).agg(F.count_if(~L.lenient_ok(F.col("value"))).alias("malformed"), F.count("*").alias("line_count"))


@query("SELECT concat(p_partkey, '. ', p_name) AS line FROM part")
def format_lines(spark, d):
    return parts(spark, d).select(L.format_line(F.col("number"), F.col("text")).alias("line"))


@query("SELECT p_partkey AS number, p_name AS text FROM part")
def run_roundtrip(spark, d):
    lines = parts(spark, d).select(L.format_line(F.col("number"), F.col("text")).alias("value"))
    write_run(order.sort_lines(parse_lines(lines)), path := staged_path(spark, "run"))
    return read_run(spark, path)


@query("SELECT doc_id, rpad(left(hex(encode(text)), 16), 16, '0') AS key8 FROM documents")
def sort_key8(spark, d):
    return table(spark, d, "documents").select("doc_id", L.sort_key8(F.col("text")).alias("key8"))


KEY2 = "CAST('0x' || rpad(left(hex(encode(text)), 4), 4, '0') AS INTEGER)"
SHARD = f"CAST((({KEY2} + 1)::BIGINT * {SHARDS} + 65535) // 65536 - 1 AS INTEGER)"


@query(f"SELECT doc_id, {KEY2} AS key2 FROM documents")
def shard_key2(spark, d):
    return table(spark, d, "documents").select("doc_id", L.shard_key2(F.col("text")).alias("key2"))


@query(f"SELECT doc_id, {SHARD} AS shard FROM documents")
def shard_id(spark, d):
    return table(spark, d, "documents").select("doc_id", L.shard_id(L.shard_key2(F.col("text")), SHARDS).alias("shard"))


@query(f"SELECT {SHARD} AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_histogram(spark, d):
    return table(spark, d, "documents").groupBy(L.shard_id(L.shard_key2(F.col("text")), SHARDS).alias("shard")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id AS number, text, {SHARD} AS shard, row_number() OVER (ORDER BY text NULLS FIRST, doc_id) AS rn FROM documents")
def shard_rank(spark, d):
    return order.shard_rank(documents(spark, d), SHARDS)


ONE_LINE = "translate(coalesce(text, ''), chr(10) || chr(13), '  ')"


@query(f"SELECT doc_id AS number, {ONE_LINE} AS text, row_number() OVER (ORDER BY {ONE_LINE}, doc_id) AS rn FROM documents")
def shard_concat(spark, d):
    """Shards sorted apart, written as files, joined to one in their order; the rank is the line's place in it."""
    lines = documents(spark, d).withColumn("text", F.translate(F.coalesce("text", F.lit("")), "\n\r", "  "))
    write_parts(order.sort_shard(lines, SHARDS), parts := staged_path(spark, "parts"))
    concat_parts(spark, parts, target := staged_path(spark, "joined"))
    return order.ranked(parse_lines(scan_text(spark, target)))


@query("SELECT event_id AS number, event_type AS text, row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 1 AS seen_before FROM events")
def first_seen(spark, d):
    return order.first_seen(events(spark, d))


@query("SELECT turn AS number, role AS text, count(*) AS n, count(*) - CASE WHEN min(turn) OVER (PARTITION BY role) = turn THEN 1 ELSE 0 END AS seen_before FROM conversations GROUP BY turn, role")
def first_seen_ties(spark, d):
    """Turns repeat: of all rows that share a role's first turn just one is the first."""
    seen = order.first_seen(table(spark, d, "conversations").select(F.col("turn").alias("number"), F.col("role").alias("text")))
    return seen.groupBy("number", "text").agg(F.count("*").alias("n"), F.count_if("seen_before").alias("seen_before"))


@query("SELECT count(DISTINCT p_name) AS distinct_texts FROM part")
def distinct_texts(spark, d):
    return parts(spark, d).agg(F.count_distinct("text").alias("distinct_texts"))


@query("SELECT CAST(sum(n * 32) + sum(40 + 2 * length(p_name)) AS BIGINT) AS estimate FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def chunk_estimate(spark, d):
    return order.chunk_estimate(parts(spark, d))


@query("SELECT count(*) AS line_count FROM lineitem")
def line_count(spark, d):
    """The accumulator that a running job fills: what is counted is what a job reads, with no pass of its own."""
    seen = Observation()
    table(spark, d, "lineitem").select("l_orderkey").observe(seen, F.count(F.lit(1)).alias("line_count")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["line_count"],)], "line_count bigint")


@query(f"SELECT event_id % {RUNS} AS run, count(*) AS records FROM events GROUP BY 1")
def chunk_records(spark, d):
    """Records of each run, from the files that were written for it."""
    merge.write_runs(runs(spark, d), path := staged_path(spark, "runs"), "run")
    return merge.read_runs(spark, path).groupBy(F.col("run").cast("bigint").alias("run")).agg(F.count("*").alias("records"))


@query("SELECT CAST(sum(length(CAST(doc_id AS VARCHAR)) + 2 + octet_length(encode(text)) + 1) AS BIGINT) AS line_bytes FROM documents")
def line_bytes(spark, d):
    return table(spark, d, "documents").agg(F.sum(L.line_bytes(F.col("doc_id"), F.col("text"))).alias("line_bytes"))


@query("SELECT 0::BIGINT AS violations")
def sortedness_check(spark, d):
    return order.violations(sort_unicode(spark, d))


@query("""SELECT count(*) FILTER (pt > event_type OR (pt = event_type AND pn > event_id)) AS violations
FROM (SELECT event_type, event_id, lag(event_type) OVER (ORDER BY event_id) AS pt, lag(event_id) OVER (ORDER BY event_id) AS pn FROM events)""")
def violations_found(spark, d):
    """The same check where rows are out of order: events by their id."""
    return order.violations(order.with_rank(events(spark, d), "number"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(substring(text, 1, 80), '...') ELSE text END AS shown FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", L.truncate_text(F.col("text")).alias("shown"))


@query("SELECT p_partkey, concat(upper(substring(p_name, 1, 1)), substring(p_name, 2)) AS text FROM part")
def capitalize_first(spark, d):
    return parts(spark, d).select(F.col("number").alias("p_partkey"), L.capitalize_first(F.col("text")).alias("text"))


@query("""WITH s AS (SELECT p_partkey, (p_partkey * p_partkey * p_partkey)::BIGINT AS size FROM part)
SELECT p_partkey, size, CASE WHEN size >= 1073741824 THEN concat(((size * 20 + 1073741824) // 2147483648) // 10, '.', ((size * 20 + 1073741824) // 2147483648) % 10, ' GB')
WHEN size >= 1048576 THEN concat((size * 2 + 1048576) // 2097152, ' MB') WHEN size >= 1024 THEN concat((size * 2 + 1024) // 2048, ' KB') ELSE concat(size, ' B') END AS shown FROM s""")
def size_format(spark, d):
    n = F.col("number")
    return parts(spark, d).select(n.alias("p_partkey"), (n * n * n).alias("size")).withColumn("shown", L.size_format(F.col("size")))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat(p_partkey, 'KB') WHEN 1 THEN concat(' ', p_partkey, '.5 mb ') WHEN 2 THEN concat(p_partkey, ' GB') WHEN 3 THEN CAST(p_partkey AS VARCHAR) ELSE concat(p_partkey, 'TB') END AS given FROM part)
SELECT p_partkey, given, CASE p_partkey % 5 WHEN 0 THEN p_partkey * 1024 WHEN 1 THEN p_partkey * 1048576 + 524288 WHEN 2 THEN p_partkey * 1073741824 WHEN 3 THEN p_partkey END::BIGINT AS size FROM s""")
def size_parse(spark, d):
    k = F.col("p_partkey")
    given = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat(p_partkey, 'KB') WHEN 1 THEN concat(' ', p_partkey, '.5 mb ') WHEN 2 THEN concat(p_partkey, ' GB') WHEN 3 THEN CAST(p_partkey AS STRING) ELSE concat(p_partkey, 'TB') END")
    return table(spark, d, "part").select(k.cast("bigint").alias("p_partkey"), given.alias("given")).withColumn("size", L.size_parse(F.col("given")))


def _generated_sql(options: GeneratorOptions) -> str:
    """The generator's law in SQL: phrases by first occurrence among the attempts, then numbers and phrases of each line."""
    draw = lambda what, i: f"CAST('0x' || left(md5('{options.seed}:{what}:' || {i}), {generator.DIGITS}) AS BIGINT)"
    vocabulary = generator.words()
    listed = "[" + ", ".join(f"'{w}'" for w in vocabulary) + "]"
    word = lambda k: f"{listed}[{draw(f'word{k}', 'i')} % {len(vocabulary)} + 1]"
    phrase = " || ".join(f"CASE WHEN n > {k} THEN '{' ' if k else ''}' || {word(k)} ELSE '' END" for k in range(4))
    return f"""WITH tried AS (SELECT i, {phrase} AS p FROM (SELECT i, {draw('words', 'i')} % 4 + 1 AS n FROM range({max(1000, 100 * options.phrases)}) t(i))),
pool AS (SELECT p, row_number() OVER (ORDER BY min(i)) - 1 AS k FROM (SELECT i, upper(left(p, 1)) || substring(p, 2) AS p FROM tried) GROUP BY p),
lines AS (SELECT i AS id, {draw('number', 'i')} % {options.max_number} + 1 AS number, {draw('text', 'i')} % {options.phrases} AS k FROM range((SELECT count(*) FROM part)) t(i))
SELECT id, number, p AS text FROM lines JOIN pool USING (k)"""


@query(_generated_sql(GeneratorOptions()))
def generate_lines(spark, d):
    """As many synthetic lines as there are parts."""
    return generator.generate_rows(spark, parts(spark, d).count(), GeneratorOptions())
