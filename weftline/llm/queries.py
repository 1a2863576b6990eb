"""One query an operator, over its whole table with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, langid, licenses, lm, search, sentencepieces, sharding, simhash, toxicity, urls
from weftline.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_sentencepiece(spark, d):
    e = sentencepieces.encode(documents(spark, d))
    return e.select("doc_id", "n_tokens", F.crc32(F.array_join("token_ids", " ").cast("binary")).alias("ids_crc32"), "round_trip")


@query
def op2_toxicity(spark, d):
    docs = documents(spark, d)
    return toxicity.score(docs, toxicity.train(docs, documents(spark, d, "labels")))


@query
def op3_license_scan(spark, d):
    return licenses.scan(documents(spark, d))


@query
def op4_url_filter(spark, d):
    return urls.judge_urls(documents(spark, d, "pages"))


@query
def op5_sharding(spark, d):
    placed = sharding.shuffle_into_shards(documents(spark, d).select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", "grown_shard")


@query
def op6_topk_search(spark, d):
    return search.top_k(documents(spark, d))


@query
def op7_lm_score(spark, d):
    docs = documents(spark, d)
    return lm.score(docs, lm.train(docs))


@query
def op8_simhash(spark, d):
    return simhash.near_duplicates(documents(spark, d))


@query
def op9_language_id(spark, d):
    docs = documents(spark, d)
    return langid.identify(docs, langid.train(docs))


@query
def op10_decontamination(spark, d):
    c = decontaminate.contamination(documents(spark, d), documents(spark, d, "benchmark"))
    return c.select("doc_id", "contaminated", "n_items", "items")


def _regex(text: str) -> str:
    return text.replace("'", "''")


def _url_sql() -> str:
    """The rules and the vocabulary as SQL; boundaries as the ends of the URL or what is neither letter nor digit."""
    hit = lambda t: f"CAST(regexp_matches(lower(url), '(^|[^\\p{{L}}\\p{{N}}]){t}([^\\p{{L}}\\p{{N}}]|$)') AS INTEGER)"
    count = lambda t: f"len(regexp_extract_all(regexp_replace(lower(url), '[^\\p{{L}}\\p{{N}}]', '  ', 'g'), '(^| ){t}( |$)'))"
    fits = lambda host, path: f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}'))"
    ordered = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in ordered) + f" ELSE CASE WHEN strict_hits > 0 OR soft_terms >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END END"
    return f"""WITH a AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
e AS (SELECT *, {rule} AS rule, CAST({' + '.join(count(t) for t in urls.STRICT)} AS INTEGER) AS strict_hits, {' + '.join(hit(t) for t in urls.SOFT)} AS soft_terms FROM c)
SELECT page_id, host, path, rule, {action} AS verdict, strict_hits, soft_terms FROM e"""


ORACLES["op4_url_filter"] = _url_sql()


def _license_sql() -> str:
    def folded(s: str) -> str:
        s = f"trim(regexp_replace(lower({s}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for a, b in licenses.EQUIVALENT:
            if a != b:
                s = f"replace({s}, '{a}', '{b}')"
        return s

    def canonical(s: str) -> str:
        return folded(f"regexp_replace(replace({s}, chr(13), ''), '(?im){_regex(licenses.COPYRIGHT_LINE)}', '', 'g')")

    values = lambda known: ", ".join(f"('{k}', '{v}')" for k, v in sorted(known.items()))
    return f"""WITH texts(digest, license) AS (VALUES {values(licenses.digests())}), known(digest, license) AS (SELECT * FROM texts UNION ALL VALUES {values(licenses.DIGESTS)}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256(coalesce({canonical('text')}, '')) AS digest FROM documents),
l AS (SELECT r, p, sha256({canonical('x')}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d)),
n AS (SELECT r, string_agg(license, ',' ORDER BY p) AS notices, count(*) AS n FROM l JOIN texts USING (digest) GROUP BY r)
SELECT doc_id, d.digest, license, coalesce(notices, '') AS notices, CAST(coalesce(n, 0) AS INTEGER) AS n_notices FROM d LEFT JOIN known ON known.digest = d.digest LEFT JOIN n ON n.r = d.r"""


ORACLES["op3_license_scan"] = _license_sql()
