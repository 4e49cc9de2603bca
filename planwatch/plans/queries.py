"""Queries over the driver's tables, each with its equivalent in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import defaults as D
from ..functions import hashing
from ..functions import text as T
from ..functions import time as TM
from ..operators import badges as B
from ..operators import classify as C
from ..operators import excerpt as E
from ..operators import filters as P
from ..operators import nearby
from ..operators import reports as R
from ..sources import paging
from ..state import budget, snapshot, upserts, window
from . import counters as CT
from . import recall as RC
from . import runs as RN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Word lists for the synthetic texts: they stand where the domain's own words do.
KEYWORDS = ("thea", "eau de", "schung", "mente la")
OWN, LET = ("ofthe", "THAN"), ("andhe", "keit")
HOME = ("the", "der", "de la")
PERMIT, START, FUTURE = ("ention", "ungen"), ("there", "einer", "eau la"), ("for ", "und ", "des ")
YEAR = 2026


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def any_of(column: str, values: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{v.lower()}')" for v in values) + ")"


def quoted(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- filters and text ----


@query(f"SELECT lang, count(*) AS n FROM documents WHERE {any_of('text', KEYWORDS)} GROUP BY lang")
def keyword_prefilter(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(T.contains_any(F.col("text"), KEYWORDS)).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, array_to_string(list_filter({quoted(KEYWORDS)}, lambda k: contains(lower(text), k)), '|') AS words FROM documents")
def matched_keywords(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.found_words(F.col("text"), KEYWORDS), "|").alias("words"))


@query("SELECT p_partkey, p_type FROM part WHERE p_size <> 7 AND regexp_matches(trim(regexp_replace(p_type, '\\s+', ' ', 'g')), '(?i)(?:brass)|(?:^eco.*)|(?:\\bsteel\\b)')")
def committee_filter(spark, sf_dir):
    return read(spark, sf_dir, "part").where(P.relevant_meeting(F.col("p_type"), F.col("p_size") == 7, ("brass", "^eco.*", r"\bsteel\b"))).select("p_partkey", "p_type")


KEY_SQL = r"trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def first_line_key():
    none = F.lit(None).cast("string")
    return T.project_key(none, none, none, F.substring_index("text", "\n", 1), F.concat(F.lit("unnamed "), F.col("doc_id").cast("string")))


@query(f"SELECT doc_id, {KEY_SQL} AS key FROM documents")
def project_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", first_line_key().alias("key"))


@query(f"SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, {KEY_SQL} AS key FROM documents) GROUP BY key")
def key_dedup_first_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", first_line_key().alias("key"))
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT l_orderkey, sha256(array_to_string(list_sort(list(sha256(l_partkey::VARCHAR || '-' || l_linenumber::VARCHAR))), '|')) AS h FROM lineitem GROUP BY l_orderkey")
def content_hash_groups(spark, sf_dir):
    one = F.sha2(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")), 256)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(hashing.content_hash(F.collect_list(one)).alias("h"))


@query("SELECT h, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def exact_dup_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


U = r"^\s*(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
URL_SQL = f"""
SELECT page_id, CASE WHEN s <> '' THEN s || ':' ELSE '' END || CASE WHEN h <> '' THEN '//' || h ELSE '' END || CASE WHEN p <> '' THEN p ELSE '/' END
  || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url
FROM (SELECT page_id, lower(regexp_extract(trim(url), '{U}', 1)) AS s, lower(regexp_extract(trim(url), '{U}', 2)) AS h,
  regexp_replace(regexp_replace(regexp_extract(trim(url), '{U}', 3), ';[^/]*$', ''), '/+$', '') AS p,
  array_to_string(list_filter(string_split(regexp_extract(trim(url), '{U}', 4), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')), '&') AS q FROM pages)
"""


@query(URL_SQL)
def url_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))


DOMAIN_SQL = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '{U}', 2)), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', '')"


@query(f"SELECT {DOMAIN_SQL} AS host, count(*) AS n FROM pages GROUP BY host")
def url_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(T.domain(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, host FROM (SELECT page_id, {DOMAIN_SQL} AS host FROM pages) WHERE NOT (host = 'example.org' OR ends_with(host, '.example.org') OR host = 'blog.com' OR ends_with(host, '.blog.com'))")
def domain_exclusion(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("host"))
    return rows.where(~P.excluded_domain(F.col("host"), ("example.org", "blog.com")))


@query(r"""SELECT doc_id, list_extract(list_filter(list_transform(regexp_extract_all(text, '(?:^|[^\d.,])(\d{1,4})\s+[a-zA-Z]', 1), lambda n: n::INT), lambda n: n BETWEEN 2 AND 5000), 1) AS units FROM documents""")
def unit_count_extract(spark, sf_dir):
    hit = T.first_number(F.col("text"), r"(?<![\d.,])(\d{1,4})\s+[a-zA-Z]", 2, 5000)
    return read(spark, sf_dir, "documents").select("doc_id", hit["n"].alias("units"))


UNITS_RE = r"(?:^|[^\d.,])(\d{1,4})\s+[a-zA-Z]"


@query(
    rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{UNITS_RE}') AS hits, string_split_regex(text, '{UNITS_RE}') AS parts,
      list_position(list_transform(regexp_extract_all(text, '{UNITS_RE}', 1), lambda n: n::INT BETWEEN 2 AND 5000), true) AS k FROM documents),
    p AS (SELECT *, list_sum(list_transform(parts[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda s: length(s))), 0) + 1 AS place FROM d WHERE k > 0),
    q AS (SELECT *, greatest(place - 80, 1) AS a, least(place + length(hits[k]) - 1 + 80, length(text)) AS b FROM p)
    SELECT d.doc_id, substr(CASE WHEN a > 1 THEN '…' ELSE '' END || trim(regexp_replace(substr(q.text, a::BIGINT, (b - a + 1)::BIGINT), '\s+', ' ', 'g')) || CASE WHEN b < length(q.text) THEN '…' ELSE '' END, 1, 200) AS quote
    FROM d LEFT JOIN q ON d.doc_id = q.doc_id"""
)
def unit_quotes(spark, sf_dir):
    """The first number that could be one of homes, as it stands in its text."""
    hit = T.first_number(F.col("text"), UNITS_RE, 2, 5000)
    return read(spark, sf_dir, "documents").select("doc_id", T.bound(hit, lambda h: T.quoted(F.col("text"), h)).alias("quote"))


def happened_sql(low: str) -> str:
    parts = []
    for w in START:
        n = len(w)
        clause = (
            f"regexp_extract(substr({low}, greatest(1, i - 25), i - greatest(1, i - 25)), '[^.,;:!?\\n]*$', 0) || '{w}' || regexp_extract(substr({low}, i + {n}, 45), '^[^.,;:!?\\n]*', 0)"
        )
        future = " OR ".join(f"contains(c, '{f}')" for f in FUTURE)
        parts.append(
            f"(contains({low}, '{w}') AND len(list_filter(list_transform(list_filter(range(1, length({low}) + 1), lambda i: substr({low}, i, {n}) = '{w}'), lambda i: {clause}), lambda c: NOT ({future}))) > 0)"
        )
    return "(" + " OR ".join(parts) + ")"


@query(f"SELECT doc_id, {happened_sql('low')} AS happened FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def clause_announced(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.happened(F.col("text"), START, FUTURE, YEAR).alias("happened"))


def tenure_sql(text: str) -> str:
    own = f"(contains(lower({text}), 'ofthe') OR regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])than'))"
    let = any_of(text, LET)
    return f"CASE WHEN {own} AND {let} THEN 'GEMISCHT' WHEN {own} THEN 'EIGENTUM' WHEN {let} THEN 'MIETE' ELSE 'UNKLAR' END"


@query(f"SELECT doc_id, {tenure_sql('text')} AS tenure FROM documents")
def tenure_class(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.tenure(F.col("text"), OWN, LET).alias("tenure"))


@query(
    f"""SELECT page_id, CASE WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'Website ausgeschlossen (' || host || ')'
  WHEN NOT regexp_matches(html, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])de([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') THEN 'Ort de nicht genannt'
  WHEN NOT {any_of('html', HOME)} THEN 'kein Wohnbau'
  WHEN NOT ({happened_sql('low')} OR {any_of('html', PERMIT)}) THEN 'keine Baugenehmigung und kein Baubeginn im Text (Frühphase)' END AS reject_reason
FROM (SELECT *, lower(html) AS low FROM (SELECT page_id, {DOMAIN_SQL} AS host, '' || chr(10) || html AS html FROM pages))"""
)
def judge_reason(spark, sf_dir):
    """All tests' reasons, as the operator gives them; null is a find. No page names a number of homes, so the last test never fails in the SQL either."""
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.lit("").alias("title"), F.col("html").alias("content"), F.lit("de").alias("place"))
    return C.judged(rows, YEAR, HOME, ("example.net",), starts=START, permits=PERMIT, future=FUTURE).select("page_id", "reject_reason")


#: Places of nations by rule, from their keys.
PLACES_SQL = "(SELECT n_nationkey AS k, n_nationkey * 37 % 150 - 60.0 AS lat, n_nationkey * 61 % 330 - 150.0 AS lon FROM nation) AS c"
KM_SQL = "2 * 6371.0 * asin(sqrt(least(pow(sin((radians(lat) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians(lat)) * pow(sin((radians(lon) - radians({1})) / 2), 2), 1.0)))"


def places(spark, sf_dir):
    at = F.col("n_nationkey").cast("double")
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (at * 37 % 150 - 60).alias("lat"), (at * 61 % 330 - 150).alias("lon"))


@query(f"SELECT n_name AS name, round({KM_SQL.format('50.0', '8.0')}, 1) AS distance_km FROM nation JOIN {PLACES_SQL} ON n_nationkey = k WHERE {KM_SQL.format('50.0', '8.0')} <= 9000")
def radius_filter(spark, sf_dir):
    return C.places_within(places(spark, sf_dir), 50.0, 8.0, 9000.0).select("name", "distance_km")


NEAR = [("the", 30.5), ("der", 12.0), ("de la", 7.5), ("of", 3.0), ("nowhere", 1.0)]


@query(
    f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {km})" for w, km in NEAR)}) AS p(word, km)),
m AS (SELECT doc_id, word, km FROM documents JOIN p ON regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || word || '([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)'))
SELECT d.doc_id, b.place, b.distance_km FROM documents d LEFT JOIN (SELECT doc_id, arg_min(word, km) AS place, min(km)::DOUBLE AS distance_km FROM m GROUP BY doc_id) b USING (doc_id)"""
)
def nearest_place(spark, sf_dir):
    places_ = spark.createDataFrame(NEAR, "name string, distance_km double")
    return C.nearest_place(read(spark, sf_dir, "documents"), places_, "doc_id", F.col("text")).select("doc_id", "place", "distance_km")


@query(
    """SELECT r_name AS place, c_mktsegment AS phase, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"""
)
def canned_results(spark, sf_dir):
    """Jobs of regions for two market segments, and the customers there as their stored results."""
    held = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    held = held.select(F.col("r_name").alias("place"), F.col("c_mktsegment").alias("phase"), F.col("c_custkey").cast("string").alias("url"), F.col("c_name").alias("title"), F.lit("").alias("content"), F.col("c_custkey").alias("seq"))
    jobs = C.search_jobs(read(spark, sf_dir, "region").select(F.col("r_name").alias("name")), {"BUILDING": ["{ort} building"], "MACHINERY": ["{ort} machines"]}).withColumnRenamed("name", "place")
    found = RN.canned(held)(jobs)
    return found.select("place", F.when(F.endswith("query", F.lit("building")), "BUILDING").otherwise("MACHINERY").alias("phase"), F.col("seq").alias("c_custkey"))


@query("SELECT count(*) FILTER (o_orderstatus IN ('F', 'P')) AS real, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS invented FROM orders")
def real_and_invented(spark, sf_dir):
    return R.provenance(read(spark, sf_dir, "orders"), "o_orderstatus", ["F", "P"])


@query("SELECT r_name AS name, phase, replace(template, '{ort}', r_name) AS query FROM region, (VALUES ('PERMIT', '{ort} permit'), ('START', '{ort} start'), ('START', 'works {ort}')) AS t(phase, template)")
def job_expansion(spark, sf_dir):
    return C.search_jobs(read(spark, sf_dir, "region").select(F.col("r_name").alias("name")), {"PERMIT": ["{ort} permit"], "START": ["{ort} start", "works {ort}"]}).select("name", "phase", "query")


@query(
    """WITH p AS (SELECT doc_id, i, list_extract(pages, i::BIGINT) AS page FROM (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents), LATERAL (SELECT unnest(range(1, len(pages) + 1)) AS i)),
hit AS (SELECT doc_id, i FROM p WHERE contains(lower(page), 'thea') OR contains(lower(page), 'schung')),
near AS (SELECT DISTINCT p.doc_id, p.i, p.page FROM p JOIN hit h ON p.doc_id = h.doc_id AND abs(p.i - h.i) <= 1),
run AS (SELECT *, sum(length(page)) OVER (PARTITION BY doc_id ORDER BY i) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM near)
SELECT d.doc_id, coalesce(x.excerpt, '') AS excerpt FROM documents d LEFT JOIN (SELECT doc_id, string_agg(page, chr(10) || chr(10) ORDER BY i) AS excerpt FROM run WHERE total <= 600 OR n = 1 GROUP BY doc_id) x USING (doc_id)"""
)
def page_excerpt(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("pages"))
    return rows.select("doc_id", E.excerpt(F.col("pages"), ("thea", "schung"), 1, 600).alias("excerpt"))


@query("SELECT DISTINCT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1 WHERE contains(lower(b.text), 'thea')")
def page_hits_context(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    hits = rows.where(T.contains_any(F.col("text"), ("thea",))).select("conv_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    return rows.select("conv_id", "turn").join(hits.distinct(), ["conv_id", "turn"], "left_semi").distinct()


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#23') AND p_size IN (1, 5, 10, 15, 20)")
def multi_filter(spark, sf_dir):
    return P.multi_filter(read(spark, sf_dir, "part"), {"p_brand": ["Brand#11", "Brand#23"], "p_size": [1, 5, 10, 15, 20], "p_type": []}).select("p_partkey", "p_brand", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(p_name, '')), 're') OR contains(lower(coalesce(p_type, '')), 're')")
def free_text_search(spark, sf_dir):
    return P.search(read(spark, sf_dir, "part"), " RE ", ["p_name", "p_type"]).select("p_partkey", "p_name")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey IN (1, 3, 5, 7) AND s_acctbal <= 5000 AND s_name IS NOT NULL")
def web_filter(spark, sf_dir):
    return P.web_filter(read(spark, sf_dir, "supplier"), {"s_nationkey": [1, 3, 5, 7]}, "s_acctbal", 5000, "s_name").select("s_suppkey", "s_acctbal")


# ---- joins ----


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS date, CASE WHEN o_orderstatus <> 'P' THEN 'x' END AS url, o_orderpriority = '1-URGENT' AS cancelled FROM orders)
SELECT o_orderkey FROM o WHERE date < DATE '1998-01-01' AND date >= DATE '1993-01-01' AND NOT cancelled
AND (url IS NULL OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))"""
)
def open_items_not_exists(spark, sf_dir):
    meetings = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("meeting_id"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") != "P", F.lit("x")).alias("url"), (F.col("o_orderpriority") == "1-URGENT").alias("cancelled")
    )
    docs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_returnflag").alias("kind"))
    out = P.open_meetings(meetings, docs, F.lit("1998-01-01").cast("date"), F.lit("1993-01-01").cast("date"), minutes="R")
    return out.select(F.col("meeting_id").alias("o_orderkey"))


@query("SELECT o_custkey, min(o_orderdate::DATE) AS first_date FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45) GROUP BY o_custkey")
def exists_earliest(spark, sf_dir):
    big = read(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= 45).select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first_date"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, o_orderdate::DATE AS date, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def bridge_join(spark, sf_dir):
    bridge = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("project_id"), F.col("l_orderkey").alias("paper_id"), "l_linenumber")
    papers = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("meeting_id"), F.to_date("o_orderdate").alias("date"))
    meetings = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("meeting_id"), "c_name")
    return R.papers_of_project(bridge, papers, meetings).select(F.col("project_id").alias("l_partkey"), F.col("paper_id").alias("l_orderkey"), "l_linenumber", "date", "c_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def anti_join_unknown(spark, sf_dir):
    known = read(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    return R.unknown_requested(read(spark, sf_dir, "orders"), known, "o_custkey").select("o_orderkey")


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), 'strasse|str\\.', 'str', 'g'), '[‐-―]', '-', 'g'), '[\\s\\v\\p{{Z}}]+', ' ', 'g'))"


RECALL_SQL = f"""terms AS (SELECT item_id, {norm_sql('text')} AS term FROM benchmark),
texts AS (SELECT 'document' AS kind, doc_id AS id, {norm_sql('text')} AS norm FROM documents UNION ALL SELECT 'conversation', conv_id, {norm_sql('text')} FROM conversations),
hits AS (SELECT item_id, id, kind FROM terms JOIN texts ON CASE WHEN contains(norm, term) THEN NOT regexp_matches(term, '[0-9]$') OR regexp_matches(norm, regexp_escape(term) || '([^0-9]|$)') ELSE false END),
r AS (SELECT item_id, x.id IS NOT NULL AS found, x.kind, x.id FROM benchmark LEFT JOIN (SELECT item_id, min(id) AS id, first(kind ORDER BY id, kind) AS kind FROM hits GROUP BY item_id) x USING (item_id))"""


@query(f"WITH {RECALL_SQL} SELECT item_id, found, kind, id FROM r")
def recall_theta(spark, sf_dir):
    known = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), F.array("text").alias("terms"))
    docs = read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit("").alias("label"), "text")
    turns = read(spark, sf_dir, "conversations").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), F.lit("").alias("label"), "text")
    return RC.recall(known, docs.unionByName(turns)).select(F.col("name").alias("item_id"), "found", "kind", "id")


@query(f"WITH {RECALL_SQL} SELECT count(*) FILTER (found) AS found, count(*) AS known FROM r")
def recall_summary(spark, sf_dir):
    return RC.recall_counts(recall_theta(spark, sf_dir))


# ---- aggregates ----


@query(
    """SELECT count(*) AS projects, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END)::BIGINT AS units, sum(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 50 END)::BIGINT AS units_subsidised,
count(*) FILTER (o_orderstatus IN ('O', 'P')) AS open, count(*) FILTER (o_orderpriority = '1-URGENT') AS leads FROM orders"""
)
def kpis(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("units"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 50).alias("units_subsidised"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("x")).otherwise("").alias("lead")
    )
    return R.key_figures(rows, ["O", "P"])


@query("SELECT o_orderstatus, count(*) AS n, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END::BIGINT AS position FROM orders GROUP BY o_orderstatus")
def count_by_status_ordered(spark, sf_dir):
    return R.count_by_status(read(spark, sf_dir, "orders"), "o_orderstatus", ["O", "P"])


@query("SELECT c_mktsegment, coalesce(sum(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END), 0)::BIGINT AS total FROM customer GROUP BY c_mktsegment")
def sum_by_region_zero(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")))
    return R.sum_or_zero(rows, "c_mktsegment", "v")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def run_counters(spark, sf_dir):
    return R.run_counters(read(spark, sf_dir, "events"), "event_type", {"high": F.col("value") > 50}, {"users": "user_id"})


@query("SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY day")
def daily_usage(spark, sf_dir):
    return R.daily_usage(read(spark, sf_dir, "events"), "ts")


@query("SELECT count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-15'")
def usage_on_day(spark, sf_dir):
    return R.usage_on(read(spark, sf_dir, "events"), "ts", F.lit("2024-01-15").cast("date"))


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
def distinct_options(spark, sf_dir):
    return R.distinct_sorted(read(spark, sf_dir, "part"), "p_brand")


@query(
    """SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ',') AS parts,
  list_extract(list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag), 1) AS number FROM lineitem GROUP BY l_orderkey"""
)
def documents_by_paper(spark, sf_dir):
    # Line numbers repeat within an order here, so part and flag complete the position.
    rows = read(spark, sf_dir, "lineitem").withColumn("number", F.col("l_returnflag")).withColumn("position", F.struct("l_linenumber", "l_partkey", "l_returnflag"))
    out = R.documents_by_paper(rows, "l_orderkey", "position", ["l_partkey"])
    return out.select("l_orderkey", F.array_join(F.transform("documents", lambda d: d["l_partkey"].cast("string")), ",").alias("parts"), "number")


# ---- derived columns, leads, changes ----


@query(
    """WITH r AS (SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'UNKLAR' END AS tenure, l.quality AS units, CASE WHEN l.toxic = 1 THEN 0.25 END AS share, CASE WHEN l.quality = 1 THEN 0.9 END AS confidence
FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, concat_ws(' · ', CASE WHEN tenure = 'UNKLAR' THEN 'Wohnform unklar: ' || CASE WHEN share IS NULL THEN 'Die Quelle sagt nicht, ob Miete, gefördert oder Eigentum.' ELSE 'Geförderter Anteil bekannt (ca. 25%), für den Rest nennt die Quelle nicht, ob Miete oder Eigentum.' END || ' Prüfen: beim Bauträger oder in den Anlagen klären - relevant ab 6 Miet-/geförderten WE bzw. 12 Eigentums-WE.' END,
  CASE WHEN units IS NULL THEN 'Keine Zahl der Wohneinheiten gefunden. Prüfen: Anzahl in den Anlagen (Begründung, städtebaulicher Vertrag) oder beim Bauträger nachsehen.' END, CASE WHEN coalesce(confidence, 0) < 0.6 THEN 'Die KI war sich unsicher (Konfidenz 0%). Prüfen: WE-Zahl, Adresse und Verfahrensstand mit der Originalquelle abgleichen.' END) AS review_task,
  CASE WHEN tenure = 'UNKLAR' OR units IS NULL OR coalesce(confidence, 0) < 0.6 THEN '⚠ prüfen' ELSE '' END AS review FROM r"""
)
def review_reasons(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("lang") == "en", F.lit("UNKLAR")).alias("tenure"), F.col("quality").alias("units"), F.when(F.col("toxic") == 1, F.lit(0.25)).alias("subsidised_share"), F.when(F.col("quality") == 1, F.lit(0.9)).alias("confidence")
    )
    return B.with_review(rows).select("doc_id", "review_task", "review")


STAGE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'BAUGENEHMIGUNG' WHEN '2-HIGH' THEN 'BAUANTRAG' WHEN '3-MEDIUM' THEN 'AUSLEGUNG' WHEN '5-LOW' THEN NULL ELSE 'VORBERATUNG' END"
BADGE_SQL = f"CASE {STAGE_SQL} WHEN 'BAUGENEHMIGUNG' THEN '🟢 Baugenehmigung' WHEN 'BAUANTRAG' THEN '🔵 Bauantrag' WHEN 'AUSLEGUNG' THEN '' ELSE CASE WHEN o_orderstatus = 'O' THEN '🔎 Hinweis im Text' ELSE '' END END"


def badged(spark, sf_dir):
    p = F.col("o_orderpriority")
    stage = F.when(p == "1-URGENT", F.lit("BAUGENEHMIGUNG")).when(p == "2-HIGH", F.lit("BAUANTRAG")).when(p == "3-MEDIUM", F.lit("AUSLEGUNG")).when(p != "5-LOW", F.lit("VORBERATUNG"))
    text = F.when(F.col("o_orderstatus") == "O", F.lit("Der Vorbescheid liegt vor"))
    rows = read(spark, sf_dir, "orders").withColumn("lead", B.lead_badge(stage, [text]))
    return rows.withColumn("units", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey"))).withColumn("status", F.when(F.col("o_orderstatus") == "P", F.lit("Archiviert")))


@query(f"SELECT o_orderkey, {BADGE_SQL} AS lead FROM orders")
def lead_badges(spark, sf_dir):
    return badged(spark, sf_dir).select("o_orderkey", "lead")


@query(f"SELECT o_orderkey, lead, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS units FROM (SELECT *, {BADGE_SQL} AS lead FROM orders) WHERE lead <> '' AND o_orderstatus <> 'P'")
def leads_sorted(spark, sf_dir):
    return R.short_term_leads(badged(spark, sf_dir), "o_orderkey").select("o_orderkey", "lead", "units")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'BAUBEGINN' ELSE 'BAUGENEHMIGUNG' END AS phase FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'")
def web_leads_sorted(spark, sf_dir):
    p = F.col("o_orderpriority")
    rows = badged(spark, sf_dir).withColumn("phase", F.when(p == "1-URGENT", F.lit("BAUBEGINN")).when(p == "2-HIGH", F.lit("BAUGENEHMIGUNG")))
    return R.web_leads(rows, "o_orderkey").select("o_orderkey", "phase")


@query(
    """WITH a AS (SELECT c_custkey, c_mktsegment AS status, c_name AS notes FROM customer), b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'BUILDING' WHEN c_custkey % 7 = 1 THEN 'bad' ELSE c_mktsegment END AS status,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS notes FROM customer), e AS (SELECT b.c_custkey, CASE WHEN b.status = 'bad' THEN a.status ELSE b.status END AS status, left(b.notes, 2000) AS notes, a.status AS s, a.notes AS n FROM b JOIN a USING (c_custkey))
SELECT c_custkey, status, notes FROM e WHERE status IS DISTINCT FROM s OR notes IS DISTINCT FROM n"""
)
def change_detection(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"), F.col("c_name").alias("notes"))
    k = F.col("c_custkey")
    b = a.select("c_custkey", F.when(k % 7 == 0, F.lit("BUILDING")).when(k % 7 == 1, F.lit("bad")).otherwise(F.col("status")).alias("status"), F.when(k % 5 != 0, F.col("notes")).alias("notes"))
    return R.changes(a, b, "c_custkey", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


# ---- state ----

BASE_SQL = """base AS (SELECT *, -1 AS seq FROM (SELECT user_id, arg_max(event_type, event_id) AS kind, CASE WHEN user_id % 3 <> 0 THEN arg_max(value, event_id) END AS v FROM events WHERE event_id % 2 = 0 GROUP BY user_id)),
batch AS (SELECT user_id, event_type AS kind, CASE WHEN event_id % 3 <> 0 THEN value END AS v, event_id AS seq FROM events WHERE event_id % 2 = 1),
u AS (SELECT * FROM base UNION ALL SELECT * FROM batch)"""


def base_and_batch(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    base = events.where("event_id % 2 = 0").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("kind"), F.max_by("value", "event_id").alias("v")).withColumn("v", F.when(F.col("user_id") % 3 != 0, F.col("v")))
    batch = events.where("event_id % 2 = 1").select("user_id", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.col("event_id").alias("seq"))
    return base, batch


@query(f"WITH {BASE_SQL} SELECT user_id, arg_max(kind, seq) AS kind, arg_max_null(v, seq) AS v, min(seq) >= 0 AS is_new FROM u GROUP BY user_id")
def upsert_overwrite(spark, sf_dir):
    return snapshot.merged(*base_and_batch(spark, sf_dir), ["user_id"], {"kind": "overwrite", "v": "overwrite"})


@query(f"WITH {BASE_SQL} SELECT user_id, arg_min(kind, seq) AS kind, arg_max(v, seq) FILTER (v IS NOT NULL) AS v, min(seq) >= 0 AS is_new FROM u GROUP BY user_id")
def upsert_coalesce(spark, sf_dir):
    return snapshot.merged(*base_and_batch(spark, sf_dir), ["user_id"], {"kind": "keep", "v": "fill"})


RANKS = {"purchase": 4, "click": 3, "view": 2}


@query(f"WITH {BASE_SQL}, r AS (SELECT *, CASE kind WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END AS rank FROM u) SELECT user_id, arg_max(kind, rank * 100000000 - seq) AS kind, min(seq) >= 0 AS is_new FROM r GROUP BY user_id")
def upsert_rank_max(spark, sf_dir):
    return snapshot.merged(*base_and_batch(spark, sf_dir), ["user_id"], {"kind": "rank"}, ranks=RANKS)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    return upserts.latest(read(spark, sf_dir, "events"), "user_id", "event_type", ["event_id"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 2 = 1")
def insert_or_ignore(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return upserts.insert_or_ignore(rows.where("c_custkey % 2 = 0"), rows.withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("SELECT event_type, least(min(ts)::DATE, CASE WHEN event_type <> 'view' THEN DATE '2020-01-01' END) AS covered_from FROM events GROUP BY event_type")
def high_water_mark(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.to_date(F.min("ts")).alias("new"))
    old = F.when(F.col("event_type") != "view", F.lit("2020-01-01").cast("date"))
    return rows.select("event_type", window.earlier(old, F.col("new")).alias("covered_from"))


@query(
    """WITH s AS (SELECT event_type, CASE WHEN event_type = 'click' THEN NULL ELSE max(ts)::DATE END AS last_success, CASE WHEN event_type = 'view' THEN DATE '2024-01-01' END AS backfill_from, CASE WHEN event_type = 'purchase' THEN DATE '2023-06-15' END AS oldest_open FROM events GROUP BY event_type)
SELECT event_type, least(CASE WHEN backfill_from IS NOT NULL THEN backfill_from WHEN last_success IS NOT NULL THEN last_success - 42 ELSE (DATE '2026-08-31' - INTERVAL 6 MONTH)::DATE END, DATE '2026-08-31' - 42, oldest_open) AS start,
  (DATE '2026-08-31' + INTERVAL 3 MONTH)::DATE AS "end" FROM s"""
)
def scan_window(spark, sf_dir):
    kind, none = F.col("event_type"), F.lit(None).cast("date")
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.to_date(F.max("ts")).alias("last"))
    rows = rows.select(
        "event_type", none.alias("covered_from"), F.when(kind == "view", F.lit("2024-01-01").cast("date")).alias("backfill_from"), F.when(kind != "click", F.col("last")).alias("last_success"), F.when(kind == "purchase", F.lit("2023-06-15").cast("date")).alias("oldest_open")
    )
    return window.scan_windows(rows, F.lit("2026-08-31").cast("date")).select("event_type", "start", "end")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS m FROM r WHERE n <= 400)
SELECT e.event_id, coalesce(m <= 1500, false) AS admitted FROM events e LEFT JOIN a USING (event_id)"""
)
def budget_admission(spark, sf_dir):
    return budget.admitted(read(spark, sf_dir, "events"), "event_type", ["event_id"], 400, 1500).select("event_id", "admitted")


@query(
    """WITH r AS (SELECT *, value > 30 AS failed, sum((NOT (value > 30))::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY event_id) AS n FROM r WHERE failed) SELECT event_type, min(event_id) AS event_id FROM n WHERE n = 5 GROUP BY event_type"""
)
def consecutive_error_brake(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("failed", F.col("value") > 30)
    return budget.braked_after(rows, "event_type", ["event_id"], "failed", 5).select("event_type", "stopped_at.event_id")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, 1 AS failures, false AS locked, NULL::BIGINT AS locked_until, [s] AS held FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, len(h)::INT, len(h) >= 3, CASE WHEN len(h) >= 3 THEN s + 86400 ELSE locked_until END, CASE WHEN len(h) >= 3 THEN [] ELSE h END
  FROM (SELECT e.user_id, e.event_id, e.n, e.s, f.locked_until, list_append(list_filter(f.held, lambda t: e.s - t <= 86400), e.s) AS h FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, event_id, failures, locked, CASE WHEN locked_until >= s THEN locked_until END AS locked_until FROM f JOIN (SELECT event_id, floor(epoch(ts))::BIGINT AS s FROM events) USING (event_id)"""
)
def failure_limiter(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return budget.locked_out(rows, "user_id", "ts", ["event_id"], 3, 86400, 86400)


@query("SELECT o_orderstatus AS source_id, min(o_orderdate::DATE) AS oldest_open FROM orders WHERE o_orderdate::DATE < DATE '1998-01-01' AND o_orderdate::DATE >= DATE '1993-01-01' AND o_orderpriority <> '1-URGENT' AND (o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) GROUP BY o_orderstatus")
def oldest_open(spark, sf_dir):
    meetings = read(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("source_id"), F.col("o_orderkey").alias("meeting_id"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") != "P", F.lit("x")).alias("url"), (F.col("o_orderpriority") == "1-URGENT").alias("cancelled")
    )
    docs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_returnflag").alias("kind"))
    return R.oldest_open(P.open_meetings(meetings, docs, F.lit("1998-01-01").cast("date"), F.lit("1993-01-01").cast("date"), minutes="R"))


@query("SELECT user_id AS source, string_agg(event_type, ',' ORDER BY first_at) AS warnings FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def warning_dedup(spark, sf_dir):
    out = R.distinct_warnings(read(spark, sf_dir, "events").withColumnRenamed("user_id", "source"), "source", "event_type", "event_id")
    return out.select("source", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT event_id, coalesce(printf('%.0f', round_even(CASE WHEN event_id % 9 <> 0 THEN value END, 0)), '?') AS shown FROM events")
def number_display(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.number_shown(F.when(F.col("event_id") % 9 != 0, F.col("value"))).alias("shown"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'manuell' ELSE 'radar' END ELSE 'radar' END AS origin FROM customer")
def origin_setter(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.lit("radar").alias("origin"))
    wanted = rows.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("manuell")).otherwise(F.lit("radar")).alias("origin"), F.lit(2).alias("at"))
    earlier = wanted.select("c_custkey", F.lit("radar").alias("origin"), F.lit(1).alias("at"))
    return upserts.set_values(rows, earlier.unionByName(wanted), "c_custkey", "origin", "at", D.ORIGINS)


# ---- order and calendar ----


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def top_k(spark, sf_dir):
    return read(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select("s_suppkey", "s_acctbal")


@query("SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 1 MONTH)::DATE AS before, (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE AS after FROM orders")
def month_shift(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", TM.months_on(d, -1).alias("before"), TM.months_on(d, 3).alias("after"))


@query("SELECT event_id, strftime(timezone('Europe/Berlin', ts AT TIME ZONE 'UTC'), '%d.%m.%Y %H:%M') AS local FROM events")
def local_time_format(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", TM.local_format(F.col("ts").cast("timestamp")).alias("local"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_prop(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(text, '[^\x{0}-\x{FF}]', '?', 'g') AS latin1 FROM documents")
def slug_and_latin1(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"), T.latin1_safe(F.col("text")).alias("latin1"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda p, i: '[Seite ' || i::VARCHAR || ']' || chr(10) || p), chr(10) || chr(10)) AS marked FROM documents")
def page_markers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.page_marked(F.split("text", "\n")).alias("marked"))


@query(
    """WITH e AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer),
    g AS (SELECT c_custkey, c_acctbal + c_custkey % 3 AS b, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE c_mktsegment END AS m FROM customer WHERE c_custkey % 11 > 0),
    f AS (SELECT e.c_custkey, coalesce(abs(c_acctbal - b) <= 1.0001, false) AS ok FROM e LEFT JOIN g ON e.c_custkey = g.c_custkey WHERE c_acctbal IS NOT NULL
      UNION ALL SELECT e.c_custkey, c_mktsegment IS NOT DISTINCT FROM m FROM e LEFT JOIN g ON e.c_custkey = g.c_custkey WHERE c_mktsegment IS NOT NULL),
    c AS (SELECT c_custkey, bool_and(ok) AS ok_all, count(*) AS n, count(*) FILTER (ok) AS k FROM f GROUP BY c_custkey)
    SELECT count(*) FILTER (ok_all) AS hits, count(*) AS total, sum(k) / sum(n) AS fields_right FROM c"""
)
def gold_hits(spark, sf_dir):
    """Customers as expected cases, and what was got for most of them, with some values off."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    expected = rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")))
    got = rows.where(F.col("c_custkey") % 11 > 0).withColumns({"c_acctbal": F.col("c_acctbal") + F.col("c_custkey") % 3, "c_mktsegment": F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.col("c_mktsegment"))})
    return RC.gold_hits(RC.compared(expected, got, "c_custkey", ["c_acctbal", "c_mktsegment"], {"c_acctbal": 1.0001}), "c_custkey")


# ---- pages and state ----


@query(
    """WITH p AS (SELECT conv_id, turn, lead(turn) OVER w AS following, conv_id::VARCHAR || '/' || turn::VARCHAR AS url FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    c AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM p)
    SELECT url, last_value(url) OVER w AS chain, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1 AS position,
      CASE WHEN last_value(following) OVER w IS NOT NULL THEN conv_id::VARCHAR || '/' || (last_value(turn) OVER w + 1)::VARCHAR END AS missing
    FROM c WINDOW w AS (PARTITION BY conv_id, island ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def page_chains(spark, sf_dir):
    """A conversation's turns as pages that point at the turn after them, until the last one."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"))
    last = turns.groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("last"))
    url = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    pages = turns.join(last, F.col("conv_id") == F.col("c")).select(url(F.col("turn")).alias("url"), F.when(F.col("turn") < F.col("last"), url(F.col("turn") + 1)).alias("next"))
    return paging.page_order(pages, most_pages=None).select("url", "chain", "position", "missing")


#: Places by rule: every key of a table lies somewhere on the globe, the poles and the date line included.
LAT, LON = "({0} * 7919 % 18001) / 100.0 - 90", "({0} * 104729 % 36001) / 100.0 - 180"


@query(
    f"""WITH s AS (SELECT s_suppkey, {LAT.format('s_suppkey')} AS a, {LON.format('s_suppkey')} AS b FROM supplier), c AS (SELECT c_custkey, {LAT.format('c_custkey')} AS x, {LON.format('c_custkey')} AS y FROM customer),
    d AS (SELECT s_suppkey, c_custkey, 2 * {D.EARTH_RADIUS_KM} * asin(sqrt(least(pow(sin((radians(x) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(x)) * pow(sin((radians(y) - radians(b)) / 2), 2), 1.0))) AS km FROM s, c)
    SELECT s_suppkey, c_custkey, round(km, 3) AS km FROM d WHERE km <= 750"""
)
def nearby_pairs(spark, sf_dir):
    """Suppliers and the customers within 750 km of them."""
    at = lambda key: [F.col(key).cast("long") * step % n / 100 - most for step, n, most in ((7919, 18001, 90), (104729, 36001, 180))]
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", at("s_suppkey")[0].alias("a"), at("s_suppkey")[1].alias("b"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", at("c_custkey")[0].alias("x"), at("c_custkey")[1].alias("y"))
    return nearby.within_km(suppliers, customers, 750, ("a", "b"), ("x", "y")).select("s_suppkey", "c_custkey", (F.floor(F.col("distance_km") * 1000 + 0.5) / 1000).alias("km"))


@query(
    """SELECT stage, rows, high, no_type FROM (SELECT 'read' AS stage, count(*) AS rows, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type IS NULL) AS no_type, 1 AS n FROM events
    UNION ALL SELECT 'kept', count(*), count(*) FILTER (value > 50), count(*) FILTER (event_type IS NULL), 2 FROM events WHERE value > 20 AND event_type <> 'view')"""
)
def counted_stages(spark, sf_dir):
    """Counts of two stages, taken while the second one's rows are worked through: the events are read once."""
    counters = CT.Counters()
    what = {"high": F.count_if(F.col("value") > 50), "no_type": F.count_if(F.col("event_type").isNull())}
    events = counters.on(read(spark, sf_dir, "events").select("event_type", "value"), "read", **what)
    counters.on(events.where("value > 20 and event_type <> 'view'"), "kept", **what).write.format("noop").mode("overwrite").save()
    rows = [(stage, n["rows"], n["high"], n["no_type"]) for stage, n in counters.all().items()]
    return spark.createDataFrame(rows, "stage string, rows long, high long, no_type long")
