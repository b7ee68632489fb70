"""Queries over the given tables, each beside SQL with the same result.

Tables stand in for the roles of the corpus: lineitem with part for result rows, orders and customers for the catalog,
events for waveforms (user: case, event type: channel), embeddings for feature vectors, documents for page text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waveloom.functions import stats
from waveloom.functions import text as T
from waveloom.operators import clusters, documents, marts, relational, signal, similarity
from waveloom.plans import audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: case, table type, label, quality status and measures; parts are joined by their key, no row is lost."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line.l_partkey == part.p_partkey, "left").select(F.col("l_suppkey").alias("case_id"), F.col("p_type").alias("table_type"), F.col("p_name").alias("normalized_label"), F.when(F.col("l_returnflag") == "R", "review").when(F.col("l_returnflag") == "A", "ok").alias("quality_status"), F.col("l_extendedprice").alias("result_number"), F.col("l_quantity").alias("left_number"), (F.col("l_discount") * 100).alias("right_number"), F.when(F.col("l_tax") > 0, F.col("l_tax") * 100 - 3).alias("time_number"))


ROWS = """r AS (SELECT l_suppkey AS case_id, p_type AS table_type, p_name AS normalized_label,
  CASE WHEN l_returnflag = 'R' THEN 'review' WHEN l_returnflag = 'A' THEN 'ok' END AS quality_status,
  l_extendedprice AS result_number, l_quantity AS left_number, l_discount * 100 AS right_number,
  CASE WHEN l_tax > 0 THEN l_tax * 100 - 3 END AS time_number
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""

METRICS = (
    marts.Metric("large_max", "LARGE", "result_number"),
    marts.Metric("large_widget_max", "LARGE", "result_number", "widget", pattern=True),
    marts.Metric("large_ring_or_bolt_max", "LARGE", "left_number", "ring|bolt", pattern=True),
    marts.Metric("small_red_max", "SMALL", "left_number", r"\bred\b", pattern=True),
    marts.Metric("small_exact_max", "SMALL", "right_number", "small ring"),
    marts.Metric("promo_first_time", "PROMO", "time_number", None, "min_positive"),
    marts.Metric("promo_bolt_time", "PROMO", "time_number", "bolt", "min_positive", True),
)


@query(f"""WITH {ROWS}, c AS (SELECT DISTINCT s_suppkey AS case_id FROM supplier),
 m AS (SELECT case_id, max(CASE WHEN table_type = 'LARGE' THEN abs(result_number) END) AS large_max,
  max(CASE WHEN table_type = 'LARGE' AND regexp_matches(normalized_label, 'widget') THEN abs(result_number) END) AS large_widget_max,
  max(CASE WHEN table_type = 'LARGE' AND regexp_matches(normalized_label, 'ring|bolt') THEN abs(left_number) END) AS large_ring_or_bolt_max,
  max(CASE WHEN table_type = 'SMALL' AND regexp_matches(normalized_label, '\\bred\\b') THEN abs(left_number) END) AS small_red_max,
  max(CASE WHEN table_type = 'SMALL' AND normalized_label = 'small ring' THEN abs(right_number) END) AS small_exact_max,
  min(CASE WHEN table_type = 'PROMO' AND time_number >= 0 THEN time_number END) AS promo_first_time,
  min(CASE WHEN table_type = 'PROMO' AND time_number >= 0 AND regexp_matches(normalized_label, 'bolt') THEN time_number END) AS promo_bolt_time,
  count(DISTINCT CASE WHEN table_type = 'PROMO' AND time_number IS NOT NULL THEN normalized_label END) AS events
  FROM r WHERE quality_status IS DISTINCT FROM 'review' AND table_type IN ('LARGE', 'SMALL', 'PROMO') GROUP BY case_id),
 j AS (SELECT c.case_id, large_max, large_widget_max, large_ring_or_bolt_max, small_red_max, CASE WHEN small_exact_max <= 5 THEN small_exact_max END AS small_exact_max, promo_first_time, promo_bolt_time, events FROM c LEFT JOIN m USING (case_id))
 SELECT *, greatest(large_widget_max, large_ring_or_bolt_max) AS widest, least(promo_first_time, promo_bolt_time) AS earliest,
  round(((large_max IS NOT NULL)::INT + (small_red_max IS NOT NULL)::INT + (small_exact_max IS NOT NULL)::INT + (promo_first_time IS NOT NULL)::INT) / 4.0, 6)::DOUBLE AS quality FROM j""")
def outcome_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result_rows(spark, sf_dir)
    events = F.count_distinct(F.when((F.col("table_type") == "PROMO") & F.col("time_number").isNotNull(), F.col("normalized_label"))).alias("events")
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id")).distinct()
    out = cases.join(marts.conditional_metrics(rows, "case_id", METRICS, [events]), "case_id", "left")
    out = out.withColumn("small_exact_max", F.when(F.col("small_exact_max") <= 5, F.col("small_exact_max")))
    return out.withColumns({"widest": F.greatest("large_widget_max", "large_ring_or_bolt_max"), "earliest": F.least("promo_first_time", "promo_bolt_time"), "quality": F.round(stats.completeness("large_max", "small_red_max", "small_exact_max", "promo_first_time"), 6)})


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, round(avg(c_acctbal), 6) AS mean_balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def row_catalog_join(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderpriority) AS priorities, max(o_totalprice) AS largest FROM orders GROUP BY 1),
 l AS (SELECT o_custkey, count(*) AS lines, count_if(l_returnflag = 'R') AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
 SELECT c_custkey, coalesce(n_name, '[unclassified]') AS nation, coalesce(orders, 0) AS orders, coalesce(priorities, 0) AS priorities, largest, coalesce(lines, 0) AS lines, coalesce(returned, 0) AS returned
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey""")
def workbook_inventory(spark, sf_dir):
    c, n, o, li = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders", "lineitem"))
    per_order = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_distinct("o_orderpriority").alias("priorities"), F.max("o_totalprice").alias("largest"))
    per_line = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(per_order.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").join(per_line.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    return out.fillna(0, ["orders", "priorities", "lines", "returned"]).select("c_custkey", F.coalesce("n_name", F.lit("[unclassified]")).alias("nation"), "orders", "priorities", "largest", "lines", "returned")


@query("""SELECT source, count(DISTINCT (lang, coalesce(quality::VARCHAR, ''))) AS kinds, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS langs, round(avg(n_chars), 2) AS mean_chars, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def metric_summary_listagg(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count_distinct("lang", F.coalesce(F.col("quality").cast("string"), F.lit(""))).alias("kinds"), F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("langs"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.count("quality").alias("labelled"))


@query("""WITH d AS (SELECT DISTINCT ON (o_orderpriority, o_custkey) o_orderpriority, o_custkey FROM orders)
 SELECT coalesce(o_orderpriority, '[all]') AS o_orderpriority, count(*) AS customers, min(o_custkey) AS least, max(o_custkey) AS most FROM d GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def coverage_with_total(spark, sf_dir):
    return relational.with_total(table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey"), "o_orderpriority", "o_custkey", [F.count("*").alias("customers"), F.min("o_custkey").alias("least"), F.max("o_custkey").alias("most")])


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1, 2""")
def share_of_all(spark, sf_dir):
    return rounded(relational.share_of_total(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]), 9)


@query("""SELECT conv_id, turn, role, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS rn FROM conversations) WHERE rn = 1""")
def latest_assignment(spark, sf_dir):
    return relational.first_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.col("role")]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("""SELECT o_custkey, CAST(rn AS INTEGER) AS rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def top_k_per_group(spark, sf_dir):
    return relational.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5, "rank").select("o_custkey", "rank", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority ILIKE '%urgent' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def pending_work(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    queue = relational.pending(o.filter(F.col("o_orderpriority").ilike("%urgent")), "o_orderstatus", ("O", "P"))
    return relational.anti(queue, li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("""WITH d AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS s FROM orders GROUP BY 1) SELECT c_custkey FROM customer LEFT JOIN d ON c_custkey = o_custkey WHERE s IS NULL OR s <> ['F', 'O', 'P']""")
def mode_set_pending(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return relational.pending_sets(table(spark, sf_dir, "customer"), done, "c_custkey", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(lower(concat_ws(' ', c_name, c_mktsegment)), '#00000001')""")
def keyword_filter(spark, sf_dir):
    return relational.passes(table(spark, sf_dir, "customer"), within={"c_mktsegment": ["BUILDING", "MACHINERY"]}, keyword="#00000001", search=["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query(f"""WITH {ROWS}, s AS (SELECT case_id, normalized_label, table_type, left_number, time_number, result_number FROM r WHERE quality_status IS DISTINCT FROM 'review')
 SELECT table_type, count(*) AS n, count(time_number) AS timed FROM s WHERE ((left_number IS NOT NULL)::INT + (time_number IS NOT NULL)::INT + (result_number IS NOT NULL)::INT) / 3.0 >= 0.8 GROUP BY 1""")
def coverage_filter(spark, sf_dir):
    rows = result_rows(spark, sf_dir).filter(relational.not_equal("quality_status", "review"))
    return relational.coverage_at_least(rows, ["left_number", "time_number", "result_number"], 0.8).groupBy("table_type").agg(F.count("*").alias("n"), F.count("time_number").alias("timed"))


@query("""SELECT s_suppkey, 'balance' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier""")
def unpivot_long(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return relational.unpivot(s, ["s_suppkey"], ["balance", "nation"])


@query("""SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'click') AS click, arg_min(value, event_id) FILTER (event_type = 'view') AS view, arg_min(value, event_id) FILTER (event_type = 'purchase') AS purchase, arg_min(value, event_id) FILTER (event_type = 'signup') AS signup, arg_min(value, event_id) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""")
def pivot_first_non_null(spark, sf_dir):
    return relational.first_values(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id", ["click", "view", "purchase", "signup", "error"])


@query("""SELECT c_nationkey, count_if(c_mktsegment = 'BUILDING') AS "BUILDING", count_if(c_mktsegment = 'MACHINERY') AS "MACHINERY" FROM customer GROUP BY 1""")
def pivot_counts(spark, sf_dir):
    return relational.pivot(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", ["BUILDING", "MACHINERY"], F.count(F.lit(1))).fillna(0)


@query("""WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_name AS label FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(p_name), lower(p_name)) AS rn FROM c) WHERE rn = 1""")
def preferred_label(spark, sf_dir):
    return relational.preferred_text(table(spark, sf_dir, "part"), ["p_brand"], "p_name", "label")


@query("""WITH s AS (SELECT p_brand, p_name, min(p_partkey) AS pos FROM part GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS rn FROM s) SELECT p_brand, string_agg(p_name, ', ' ORDER BY rn) AS samples FROM t WHERE rn <= 5 GROUP BY 1""")
def first_samples(spark, sf_dir):
    return relational.first_distinct(table(spark, sf_dir, "part"), ["p_brand"], "p_name", ["p_partkey"], 5, "samples")


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn, sum(n) OVER (PARTITION BY p_brand) AS total FROM c) SELECT p_brand, p_type, n, round(n / total, 6) AS share FROM t WHERE rn = 1""")
def top_share(spark, sf_dir):
    return rounded(relational.top_share(table(spark, sf_dir, "part"), ["p_brand"], "p_type"))


@query("""WITH o AS (SELECT o_custkey AS family, o_orderstatus AS side, floor(o_totalprice / 50000) AS v, year(o_orderdate) AS y, o_orderkey AS id, (o_orderkey % 97)::DOUBLE AS r FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY family, side) AS n FROM o),
 u AS (SELECT *, side AS grp FROM n WHERE n >= 2 UNION ALL SELECT *, '' FROM n WHERE family NOT IN (SELECT family FROM n WHERE n >= 2)),
 g AS (SELECT family, grp, arg_min({'id': id, 'v': v, 's': side, 'r': r}, (v, y, id)) AS lo, arg_max({'id': id, 'v': v, 's': side, 'r': r}, (v, y, id)) AS hi FROM u GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT family, CASE WHEN lo.s = hi.s THEN lo.s ELSE 'mixed' END AS side, lo.id AS low_id, lo.v AS low_value, hi.id AS high_id, hi.v AS high_value, hi.v - lo.v AS gap, hi.r - lo.r AS ratio_gap FROM g ORDER BY gap DESC, ratio_gap DESC, family, low_id LIMIT 12""")
def extremes_pairing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("side"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("value"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97).cast("double").alias("ratio"))
    return relational.extreme_pairs(o, "family", "side", "value", "id", "year", "ratio")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring') THEN 'round' WHEN regexp_matches(p_name, 'bolt|screw') THEN 'fastener' ELSE 'other' END AS kind, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k,
 regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS slug, sha256(concat_ws('|', p_name, p_brand, p_size::VARCHAR)) AS signature, split_part(p_name, ' ', 1) AS colour FROM part""")
def classify_rules(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.classified("p_name", [("ring", "round"), ("bolt|screw", "fastener")], "other").alias("kind"), T.key("p_name").alias("k"), T.slug("p_brand").alias("slug"), T.signature("p_name", "p_brand", "p_size").alias("signature"), T.first_match("p_name", r"^(\S+)").alias("colour"))


@query(r"""WITH c AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN '2013 ' || c_mktsegment || ' 4-door (LX) - Small Overlap retest' WHEN 1 THEN c_mktsegment || ' 1500/2500 into pole into wall' WHEN 2 THEN ' ' || c_mktsegment || ' small overlap R&D, ' WHEN 3 THEN '(x) - ' || c_mktsegment || ' - (y) z' ELSE c_mktsegment || ' Small Overlapped - 2' END AS title FROM customer)
 SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(regexp_replace(trim(title), '^\d{4}\s+', ''), ' into ', 1), '\([^)]*\)', '', 'g'), '\bSmall Overlap\b', '', 'gi'), '\bR&D\b', '', 'gi'), '\s*-\s*', ' ', 'g'), '\s+', ' ', 'g'), ' ,') AS family,
 concat(CASE WHEN c_nationkey % 7 > 0 THEN c_mktsegment ELSE 'unknown-era' END, '|', CASE WHEN c_custkey % 3 = 0 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'driver' ELSE 'passenger' END, '|', CASE WHEN c_custkey % 4 > 1 THEN 'signal-ready' ELSE 'signal-missing' END) AS cohort, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM c""")
def family_label(spark, sf_dir):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    shapes = [("2013 ", " 4-door (LX) - Small Overlap retest"), ("", " 1500/2500 into pole into wall"), (" ", " small overlap R&D, "), ("(x) - ", " - (y) z"), ("", " Small Overlapped - 2")]
    title = F.coalesce(*(F.when(k % 5 == i, F.concat(F.lit(a), seg, F.lit(b))) for i, (a, b) in enumerate(shapes)))
    c = table(spark, sf_dir, "customer").withColumns({"title": title, "era": F.when(F.col("c_nationkey") % 7 > 0, seg), "side": F.when(k % 3 == 0, F.lit(None)).when(k % 2 == 0, "driver").otherwise("passenger"), "ready": F.when(k % 4 > 1, 1).when(k % 4 == 1, 0)})
    return c.select("c_custkey", T.family("title").alias("family"), T.cohort("era", "side", "ready").alias("cohort"), T.side_factor("side").alias("factor"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '-?\d+(?:\.\d+)?')) AS numbers, nullif(regexp_extract(text, '([A-Za-z0-9._]+@[A-Za-z0-9.]+)', 1), '') AS address, len(string_split(text, chr(10))) AS lines, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS chars FROM documents""")
def number_scan(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.numbers_in("text")).cast("long").alias("numbers"), T.first_match("text", r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)").alias("address"), F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length(T.collapse("text")).cast("long").alias("chars"))


@query(r"""WITH n AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, o_orderkey % 9 AS m FROM orders)
 SELECT o_orderkey, CASE m WHEN 0 THEN ('1' || k)::DOUBLE WHEN 1 THEN k::DOUBLE WHEN 4 THEN k::DOUBLE WHEN 6 THEN (k || '.5')::DOUBLE WHEN 8 THEN 20.0 END AS plain, CASE m WHEN 0 THEN ('1' || k)::DOUBLE WHEN 1 THEN k::DOUBLE WHEN 4 THEN k::DOUBLE WHEN 6 THEN (k || '.5')::DOUBLE WHEN 8 THEN 21.0 END AS sheet,
 CASE m WHEN 2 THEN 4.0 WHEN 4 THEN k::DOUBLE WHEN 7 THEN -1.0 WHEN 8 THEN 20.0 END AS loose, CASE m WHEN 0 THEN ('1' || k)::DOUBLE WHEN 1 THEN round(o_orderkey / 100.0, 6)::DOUBLE WHEN 4 THEN k::DOUBLE WHEN 6 THEN (k || '.5')::DOUBLE WHEN 8 THEN 20.0 END AS share, CASE m WHEN 5 THEN 8.0::DOUBLE WHEN 8 THEN 20.0 END AS version FROM n""")
def number_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    shapes = [F.concat(F.lit("1,"), k), F.concat(k, F.lit("%")), F.lit("3-5"), F.lit("--"), F.concat(F.lit("±"), k), F.lit("VIII"), F.concat(k, F.lit(".5mm")), F.lit("3--5"), F.lit("2e1")]
    n = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(*(F.when(k % 9 == i, x) for i, x in enumerate(shapes))).alias("raw"))
    return n.select("o_orderkey", T.plain_number("raw").alias("plain"), T.plain_number("raw", exponent=False).alias("sheet"), T.loose_number("raw").alias("loose"), F.round(T.share("raw"), 6).alias("share"), T.version_number("raw").alias("version"))


@query(f"""WITH {ROWS}, q AS (SELECT table_type, quantile_cont(left_number, 0.25) AS q1, quantile_cont(left_number, 0.75) AS q3 FROM r GROUP BY 1)
 SELECT table_type, round(avg(result_number) FILTER (left_number >= q3) - avg(result_number) FILTER (left_number <= q1), 4) AS gap FROM r JOIN q USING (table_type) GROUP BY 1""")
def quantile_gap(spark, sf_dir):
    return rounded(stats.quartile_gap(result_rows(spark, sf_dir), "left_number", "result_number", ["table_type"]), 4)


@query("""WITH s AS (SELECT c_mktsegment, median(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer GROUP BY 1) SELECT c_custkey, round((c_acctbal - m) / CASE WHEN d > 1e-9 THEN d ELSE 1 END, 6) AS z FROM customer JOIN s USING (c_mktsegment)""")
def robust_z(spark, sf_dir):
    return rounded(stats.robust_z(table(spark, sf_dir, "customer"), {"z": "c_acctbal"}, ["c_mktsegment"]).select("c_custkey", "z"))


@query(f"""WITH {ROWS}, c AS (SELECT case_id, max(result_number) AS a, avg(left_number) AS b, min(time_number) AS t FROM r GROUP BY 1),
 s AS (SELECT median(a) ma, stddev_pop(a) da, median(b) mb, stddev_pop(b) db, median(t) mt, stddev_pop(t) dt FROM c)
 SELECT case_id, round(((a - ma) / CASE WHEN da > 1e-9 THEN da ELSE 1 END + (b - mb) / CASE WHEN db > 1e-9 THEN db ELSE 1 END + (t - mt) / CASE WHEN dt > 1e-9 THEN dt ELSE 1 END) / 3, 6) AS severity FROM c, s""")
def composite_score(spark, sf_dir):
    per = result_rows(spark, sf_dir).groupBy("case_id").agg(F.max("result_number").alias("a"), F.avg("left_number").alias("b"), F.min("time_number").alias("t"))
    return rounded(marts.composites(per, {"severity": ["a", "b", "t"]}).select("case_id", "severity"))


@query(f"""WITH {ROWS}, b AS (SELECT quality_status, normalized_label AS label, result_number AS v FROM r), m AS (SELECT quality_status, avg(v) AS m FROM b GROUP BY 1), g AS (SELECT quality_status, label, count(*) AS n, avg(v) AS lm FROM b GROUP BY 1, 2)
 SELECT coalesce(quality_status, 'none') AS quality_status, round((SELECT sum(n * (lm - m.m) * (lm - m.m)) FROM g WHERE g.quality_status IS NOT DISTINCT FROM m.quality_status) / (SELECT sum((v - m.m) * (v - m.m)) FROM b WHERE b.quality_status IS NOT DISTINCT FROM m.quality_status), 8) AS eta_squared FROM m""")
def eta_squared(spark, sf_dir):
    rows = result_rows(spark, sf_dir).withColumn("quality_status", F.coalesce("quality_status", F.lit("none")))
    return rounded(stats.eta_squared(rows, "normalized_label", "result_number", ["quality_status"]), 8)


@query("""WITH t AS (SELECT o_orderstatus AS label, unnest([{'dimension': 'priority', 'category': coalesce(o_orderpriority, '[missing]')}, {'dimension': 'year', 'category': coalesce(year(o_orderdate)::VARCHAR, '[missing]')}], recursive := true) FROM orders),
 c AS (SELECT label, dimension, category, count(*) AS n FROM t GROUP BY ALL)
 SELECT label, dimension, category, n, round(n / sum(n) OVER (PARTITION BY label, dimension), 8) AS share, round((n / sum(n) OVER (PARTITION BY label, dimension)) / (sum(n) OVER (PARTITION BY dimension, category) / sum(n) OVER (PARTITION BY dimension)), 8) AS enrichment FROM c""")
def enrichment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    return rounded(stats.enrichment(o, "label", ["priority", "year"]), 8)


@query(f"""WITH {ROWS} SELECT table_type, round(covar_pop(left_number, result_number) / nullif(stddev_pop(left_number) * stddev_pop(result_number), 0), 8) AS r, count(*) AS n FROM r GROUP BY 1""")
def pearson(spark, sf_dir):
    return rounded(result_rows(spark, sf_dir).groupBy("table_type").agg(stats.pearson("left_number", "result_number").alias("r"), F.count("*").alias("n")), 8)


@query(f"""WITH {ROWS}, k AS (SELECT table_type, rank() OVER (PARTITION BY table_type ORDER BY left_number) + (count(*) OVER (PARTITION BY table_type, left_number) - 1) / 2.0 AS a, rank() OVER (PARTITION BY table_type ORDER BY result_number) + (count(*) OVER (PARTITION BY table_type, result_number) - 1) / 2.0 AS b FROM r)
 SELECT table_type, round(corr(a::DOUBLE, b::DOUBLE), 8) AS spearman FROM k GROUP BY 1""")
def spearman(spark, sf_dir):
    return rounded(stats.spearman(result_rows(spark, sf_dir), "left_number", "result_number", ["table_type"]), 8)


@query(f"""WITH {ROWS} SELECT table_type, count(*) AS n, round(regr_r2(result_number, left_number), 8) AS r2, round(1 - (1 - regr_r2(result_number, left_number)) * (count(*) - 1) / (count(*) - 2), 8) AS adj_r2, round(regr_intercept(result_number, left_number), 3) AS b0, round(regr_slope(result_number, left_number), 4) AS b1 FROM r GROUP BY 1""")
def ols_simple(spark, sf_dir):
    out = stats.least_squares(result_rows(spark, sf_dir), ["left_number"], "result_number", ["table_type"])
    return out.withColumns({"r2": F.round("r2", 8), "adj_r2": F.round("adj_r2", 8), "b0": F.round("b0", 3), "b1": F.round("b1", 4)})


@query(f"""WITH {ROWS}, s AS (SELECT table_type, count(*) AS n, regr_sxx(result_number, left_number) AS a, regr_sxx(result_number, right_number) AS b, covar_pop(left_number, right_number) * count(*) AS c, covar_pop(left_number, result_number) * count(*) AS d, covar_pop(right_number, result_number) * count(*) AS e, regr_syy(result_number, left_number) AS y FROM r GROUP BY 1)
 SELECT table_type, n, round((d * (d * b - e * c) / (a * b - c * c) + e * (e * a - d * c) / (a * b - c * c)) / y, 8) AS r2, round((d * b - e * c) / (a * b - c * c), 4) AS b1, round((e * a - d * c) / (a * b - c * c), 4) AS b2 FROM s""")
def ols_multi(spark, sf_dir):
    out = stats.least_squares(result_rows(spark, sf_dir), ["left_number", "right_number"], "result_number", ["table_type"])
    return out.select("table_type", "n", F.round("r2", 8).alias("r2"), F.round("b1", 4).alias("b1"), F.round("b2", 4).alias("b2"))


@query()
def bootstrap_r2(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_type").alias("table_type"), F.col("l_quantity").alias("left_number"), F.col("l_extendedprice").alias("result_number"), "l_orderkey", "l_linenumber")
    return stats.bootstrap_r2(rows, ["left_number"], "result_number", ["table_type"], ["l_orderkey", "l_linenumber"])


@query(f"""WITH {ROWS}, q AS (SELECT table_type, quantile_cont(time_number, 0.25) AS q1, quantile_cont(time_number, 0.75) AS q3 FROM r GROUP BY 1)
 SELECT table_type, CASE WHEN time_number >= q3 THEN 'high' WHEN time_number <= q1 THEN 'low' ELSE 'mid' END AS band, count(*) AS n, round(regr_slope(result_number, left_number), 4) AS slope FROM r JOIN q USING (table_type) GROUP BY 1, 2""")
def band_regression(spark, sf_dir):
    banded = stats.quantile_band(result_rows(spark, sf_dir), "time_number", ["table_type"])
    return rounded(banded.groupBy("table_type", "band").agg(F.count("*").alias("n"), F.regr_slope("result_number", "left_number").alias("slope")), 4)


@query(f"""WITH {ROWS}, z AS (SELECT table_type, unnest([{{'metric': 'time', 'v': time_number}}, {{'metric': 'status', 'v': CASE WHEN quality_status IS NULL THEN NULL ELSE 1 END}}], recursive := true) FROM r) SELECT metric, round(count(v) / count(*), 8) AS coverage FROM z GROUP BY 1""")
def coverage_ratio(spark, sf_dir):
    rows = result_rows(spark, sf_dir).select(F.col("time_number").alias("time"), F.col("quality_status").alias("status"))
    return rounded(marts.coverage_summary(rows, ["time", "status"]), 8)


@query(f"""WITH {ROWS}, s AS (SELECT table_type AS scenario, normalized_label AS domain, avg(result_number) AS v FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS rn, lead(v) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY scenario ORDER BY v DESC, domain)) SELECT scenario, domain AS winner, round(v, 4) AS best, round(v - nxt, 4) AS margin FROM k WHERE rn = 1""")
def scenario_winner(spark, sf_dir):
    scores = result_rows(spark, sf_dir).groupBy("table_type", "normalized_label").agg(F.avg("result_number").alias("v"))
    return rounded(marts.winners(scores, "table_type", "normalized_label", "v").withColumnRenamed("table_type", "scenario"), 4)


@query(r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '12 ' || p_name WHEN 1 THEN 'Table 3 ' || p_name WHEN 2 THEN p_name || ' do or' WHEN 3 THEN '2013' ELSE p_name END AS label, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS norm, CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN 'abc' ELSE 'n/a' END AS res, CASE p_partkey % 7 WHEN 0 THEN '12-x' WHEN 1 THEN '15' WHEN 2 THEN '-3' END AS tim FROM part),
 f AS (SELECT p_partkey, list_sort(list_filter([CASE WHEN norm IS NULL THEN 'missing_label' END, CASE WHEN p_partkey % 6 = 0 THEN 'label_numeric_prefix' END, CASE WHEN p_partkey % 6 = 1 THEN 'label_table_prefix' END, CASE WHEN trim(res) = '' AND tim IS NULL THEN 'missing_primary_value' END, CASE WHEN res = 'abc' THEN 'unparsed_result' END, CASE WHEN tim IN ('12-x', '-3') THEN 'unparsed_time' END], lambda x: x IS NOT NULL)) AS flags FROM p)
 SELECT p_partkey, coalesce(list_aggregate(flags, 'string_agg', ','), '') AS quality_flags, greatest(0, round(1.0 - list_sum(list_transform(list_concat(['none'], flags), lambda x: CASE x WHEN 'none' THEN 0 WHEN 'missing_label' THEN 0.45 WHEN 'missing_primary_value' THEN 0.35 WHEN 'unparsed_result' THEN 0.1 WHEN 'unparsed_time' THEN 0.1 ELSE 0.15 END)), 3))::DOUBLE AS quality_score, CASE WHEN len(flags) > 0 THEN 'review' ELSE 'ok' END AS quality_status FROM f""")
def row_quality(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    label = F.when(k % 6 == 0, F.concat(F.lit("12 "), name)).when(k % 6 == 1, F.concat(F.lit("Table 3 "), name)).when(k % 6 == 2, F.concat(name, F.lit(" do or"))).when(k % 6 == 3, "2013").otherwise(name)
    found = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.col("p_size").cast("string")).when(k % 4 == 2, "abc").otherwise("n/a")
    rows = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), F.when(k % 5 > 0, name).alias("normalized"), found.alias("result_text"), F.when(k % 4 == 1, F.col("p_size").cast("double")).alias("result_number"), F.when(k % 7 == 0, "12-x").when(k % 7 == 1, "15").when(k % 7 == 2, "-3").alias("time_text"), F.lit(None).cast("double").alias("time_number"))
    out = marts.row_quality(rows, "label", "normalized", ["result_text", "time_text"], {"result": ("result_text", "result_number"), "time": ("time_text", "time_number")}, ("time",))
    return out.select("p_partkey", "quality_flags", "quality_score", "quality_status")


@query("""WITH s AS (SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'N') AS a, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49.5 AND l_discount > 0.09) AS b, s_acctbal > 5000 AS c FROM supplier)
 SELECT s_suppkey, a::INT AS shipped, b::INT AS bulk, c::INT AS funded, concat_ws(',', CASE WHEN NOT a THEN 'shipped' END, CASE WHEN NOT b THEN 'bulk' END, CASE WHEN NOT c THEN 'funded' END) AS gaps, (a AND b AND c)::INT AS complete FROM s""")
def stage_audit(spark, sf_dir):
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    return audit.stage_audit(s, {"shipped": li.filter("l_returnflag = 'N'"), "bulk": li.filter("l_quantity > 49.5 AND l_discount > 0.09"), "funded": s.filter("s_acctbal > 5000")}, "s_suppkey")


@query("""SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS "F", count_if(o_orderstatus = 'O') AS "O", count_if(o_orderstatus = 'P') AS "P", count(*) AS total FROM orders GROUP BY 1""")
def status_crosstab(spark, sf_dir):
    return audit.status_crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), y AS (SELECT *, (length(trim(line)) < 40)::INT AS h FROM x)
 SELECT doc_id, line_no, sum(h) OVER w AS section, length(last_value(CASE WHEN h = 1 THEN trim(regexp_replace(line, '\\s+', ' ', 'g')) END IGNORE NULLS) OVER w) AS heading_chars FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)""")
def section_carry(spark, sf_dir):
    rows = documents.lines(table(spark, sf_dir, "documents"), ["doc_id"])
    out = documents.sections(rows, ["doc_id"], F.length(F.trim("raw")) < 40)
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "section", F.length("heading").cast("long").alias("heading_chars"))


@query()
def document_tables(spark, sf_dir):
    rows = documents.lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return documents.table_rows(rows, "single", ["doc_id"])


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(url, 'https?://([^/:?#]+)', 1), '') AS host, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS lang, regexp_matches(substr(lower(html), 1, 512), '<!doctype html|<html') AS is_page FROM pages""")
def page_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.first_match("html", "<title>([^<]*)</title>").alias("title"), T.first_match("url", r"https?://([^/:?#]+)").alias("host"), T.first_match("html", 'lang="([a-z]+)"').alias("lang"), F.substring(F.lower("html"), 1, 512).rlike("<!doctype html|<html").alias("is_page"))


# --- signals: events as series ---------------------------------------------------------------------------------------

BY = ["case_id", "channel"]
SERIES = """e AS (SELECT user_id AS case_id, event_type AS channel, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value - 20 AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx FROM events)"""
W = "WINDOW w AS (PARTITION BY case_id, channel ORDER BY idx)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("channel"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6).alias("t"), (F.col("value") - 20).alias("v"), "event_id")
    return signal.numbered(e, BY, ["t", "event_id"]).drop("event_id").withColumn("idx", F.col("idx").cast("long"))


@query(f"""WITH {SERIES}, s AS (SELECT *, v * 9.80665 * coalesce(t - lag(t) OVER w, 0) AS d FROM e {W}) SELECT case_id, channel, idx, round(sum(d) OVER (PARTITION BY case_id, channel ORDER BY idx ROWS UNBOUNDED PRECEDING), 2) AS delta_v FROM s""")
def delta_v(spark, sf_dir):
    return rounded(signal.cumulative_delta_v(series(spark, sf_dir), BY).select(*BY, "idx", "delta_v"), 2)


@query(f"""WITH {SERIES}, s AS (SELECT *, coalesce((t - lag(t) OVER w) * (v + lag(v) OVER w) / 2, 0) AS d FROM e {W}) SELECT case_id, channel, idx, round(sum(d) OVER (PARTITION BY case_id, channel ORDER BY idx ROWS UNBOUNDED PRECEDING), 2) AS integral FROM s""")
def cumulative_trapezoid(spark, sf_dir):
    return rounded(signal.cumulative_trapezoid(series(spark, sf_dir), BY).select(*BY, "idx", "integral"), 2)


@query(f"""WITH {SERIES}, s AS (SELECT *, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b, v - lag(v) OVER w AS p, lead(v) OVER w - v AS q FROM e {W})
 SELECT case_id, channel, idx, round(coalesce((a * a * (v + q) + (b * b - a * a) * v - b * b * (v - p)) / (a * b * (a + b)), q / b, p / a), 6) AS slope FROM s""")
def gradient(spark, sf_dir):
    return rounded(signal.gradient(series(spark, sf_dir), BY).select(*BY, "idx", "slope"))


@query(f"""WITH {SERIES} SELECT case_id, channel, idx, round(v - coalesce(avg(CASE WHEN t >= 0 AND t < 432000 THEN v END) OVER (PARTITION BY case_id, channel), 0), 6) AS corrected FROM e""")
def baseline_subtract(spark, sf_dir):
    return rounded(signal.baseline(series(spark, sf_dir), BY, 0.0, 432000.0).select(*BY, "idx", "corrected"))


@query(f"""WITH {SERIES}, s AS (SELECT *, stddev_pop(v) OVER f AS sd, avg(v) OVER f AS m, count(v) OVER f AS n, greatest(floor(count(*) OVER (PARTITION BY case_id, channel) * 0.5), 4) - 4 AS last FROM e WINDOW f AS (PARTITION BY case_id, channel ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
 k AS (SELECT *, row_number() OVER (PARTITION BY case_id, channel ORDER BY round(sd, 12), idx) AS rn FROM s WHERE n = 4 AND idx <= last) SELECT case_id, channel, idx AS start_idx, round(sd, 6) AS deviation, round(m, 6) AS bias FROM k WHERE rn = 1""")
def rolling_bias(spark, sf_dir):
    return rounded(signal.rolling_bias(series(spark, sf_dir), BY, 4, 0.5, None))


@query(f"""WITH {SERIES}, a AS (SELECT *, min(CASE WHEN v < -15 THEN idx END) OVER (PARTITION BY case_id, channel) AS anchor FROM e)
 SELECT case_id, channel, max(anchor) AS anchor, CASE WHEN max(anchor) IS NOT NULL THEN coalesce(max(CASE WHEN v > -5 AND idx <= anchor THEN idx END) + 1, 0) ELSE coalesce(min(CASE WHEN v < -5 THEN idx END), 0) END AS start_idx FROM a GROUP BY 1, 2""")
def t0_anchor(spark, sf_dir):
    return signal.anchor_start(series(spark, sf_dir), BY, -15.0, -5.0)


@query(f"""WITH {SERIES} SELECT case_id, channel, round(max(abs(v)), 6) AS peak_abs, round(arg_max(t, (abs(v), -idx)), 6) AS peak_abs_t, round(max(v), 6) AS peak_positive, round(arg_max(t, (v, -idx)), 6) AS peak_positive_t, round(min(v), 6) AS peak_negative, round(arg_min(t, (v, idx)), 6) AS peak_negative_t, count(*) AS n, round(arg_min(v, idx), 6) AS first_value, round(arg_max(v, idx), 6) AS end_value FROM e GROUP BY 1, 2""")
def peaks(spark, sf_dir):
    return rounded(signal.peaks(series(spark, sf_dir), BY))


@query(f"""WITH {SERIES}, p AS (SELECT *, max(abs(v)) OVER (PARTITION BY case_id, channel) AS m FROM e)
 SELECT case_id, channel, round(min(t) FILTER (abs(v) >= m * 0.1), 6) AS onset, round(min(t) FILTER (abs(v) >= m * 0.9) - min(t) FILTER (abs(v) >= m * 0.1), 6) AS rise, round(max(t) FILTER (abs(v) >= m * 0.1) - min(t) FILTER (abs(v) >= m * 0.1), 6) AS width_10, round(max(t) FILTER (abs(v) >= m * 0.5) - min(t) FILTER (abs(v) >= m * 0.5), 6) AS duration_50 FROM p GROUP BY 1, 2""")
def onset_rise(spark, sf_dir):
    return rounded(signal.thresholds(series(spark, sf_dir), BY))


@query(f"""WITH {SERIES}, s AS (SELECT *, coalesce(last_value(nullif(sign(v), 0) IGNORE NULLS) OVER (PARTITION BY case_id, channel ORDER BY idx ROWS UNBOUNDED PRECEDING), first_value(nullif(sign(v), 0) IGNORE NULLS) OVER (PARTITION BY case_id, channel ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM e), f AS (SELECT *, g * lag(g) OVER w < 0 AS x FROM s {W}) SELECT case_id, channel, count_if(x) AS crossings FROM f GROUP BY 1, 2""")
def zero_crossings(spark, sf_dir):
    return signal.zero_crossings(series(spark, sf_dir), BY)


@query(f"""WITH {SERIES}, s AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r, max(abs(v)) OVER (PARTITION BY case_id, channel) AS m FROM e {W}) SELECT case_id, channel, count_if(((v >= l AND v > r) OR (v <= l AND v < r)) AND abs(v) >= greatest(m * 0.2, 1e-9)) AS extrema FROM s GROUP BY 1, 2""")
def extrema(spark, sf_dir):
    return signal.extrema(series(spark, sf_dir), BY)


@query(f"""WITH {SERIES}, s AS (SELECT *, abs(v) <= 19 AS ok FROM e), g AS (SELECT *, idx - row_number() OVER (PARTITION BY case_id, channel, ok ORDER BY idx) AS island FROM s), r AS (SELECT case_id, channel, min(idx) AS pos FROM g WHERE ok GROUP BY case_id, channel, island HAVING count(*) >= 5), m AS (SELECT case_id, channel, min(pos) AS pos FROM r GROUP BY 1, 2)
 SELECT case_id, channel, coalesce(any_value(pos), max(idx)) AS settle_idx FROM e LEFT JOIN m USING (case_id, channel) GROUP BY 1, 2""")
def settle_run(spark, sf_dir):
    return signal.first_quiet_run(series(spark, sf_dir), BY, 19.0, 5)


@query(f"""WITH {SERIES}, s AS (SELECT *, t - lag(t) OVER w AS d, lag(v) OVER w AS l, lag(t) OVER w AS lt FROM e {W}) SELECT case_id, channel, round(coalesce(sum(d * (v + l) / 2), 0), 2) AS area, round(coalesce(sum(d * (abs(v) + abs(l)) / 2), 0), 2) AS area_abs, round(coalesce(sum(d * (v * v + l * l) / 2), 0), 0) AS energy, round(sum(d * (t * abs(v) + lt * abs(l)) / 2) / nullif(sum(d * (abs(v) + abs(l)) / 2), 0), 4) AS centroid FROM s GROUP BY 1, 2""")
def pulse_integrals(spark, sf_dir):
    return signal.integrals(series(spark, sf_dir), BY).select(*BY, F.round("area", 2).alias("area"), F.round("area_abs", 2).alias("area_abs"), F.round("energy", 0).alias("energy"), F.round("centroid", 4).alias("centroid"))


@query(f"""WITH {SERIES}, k AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY case_id, channel) - 1 AS n FROM e {W}), z AS (SELECT * FROM k WHERE i % 3 = 0 OR i = n) SELECT case_id, channel, idx, round((v - avg(v) OVER p) / CASE WHEN stddev_pop(v) OVER p > 1e-9 THEN stddev_pop(v) OVER p ELSE 1 END, 6) AS z FROM z WINDOW p AS (PARTITION BY case_id, channel)""")
def downsample(spark, sf_dir):
    return rounded(signal.thinned(series(spark, sf_dir), BY, 3).select(*BY, "idx", "z"))


@query(f"""WITH {SERIES}, p AS (SELECT o_orderkey AS probe, user_id AS case_id, event_type AS channel, (o_orderkey * 137 % 2592000)::DOUBLE AS t FROM orders JOIN (SELECT DISTINCT user_id, event_type FROM events) ON user_id = o_orderkey % 150)
 SELECT probe, p.case_id, p.channel, p.t, round(e.v, 6) AS seen FROM p ASOF LEFT JOIN e ON p.case_id = e.case_id AND p.channel = e.channel AND p.t >= e.t""")
def asof_value(spark, sf_dir):
    s = series(spark, sf_dir)
    probes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("probe"), (F.col("o_orderkey") % 150).alias("case_id"), (F.col("o_orderkey") * 137 % 2592000).cast("double").alias("t")).join(s.select(*BY).distinct(), "case_id")
    return rounded(signal.as_of(probes.select("probe", *BY, "t"), s, BY, "v", "seen"))


@query(f"""WITH {SERIES}, u AS (SELECT case_id, channel, t, arg_min(v, idx) AS v FROM e GROUP BY ALL), g AS (SELECT DISTINCT case_id, channel, x * 86400.0 AS g FROM e, range(0, 31) r(x)),
 b AS (SELECT g.*, u.t AS t0, u.v AS v0 FROM g ASOF LEFT JOIN u ON g.case_id = u.case_id AND g.channel = u.channel AND g.g >= u.t), c AS (SELECT b.*, u.t AS t1, u.v AS v1 FROM b ASOF LEFT JOIN u ON b.case_id = u.case_id AND b.channel = u.channel AND b.g <= u.t)
 SELECT case_id, channel, CAST(g AS DOUBLE) AS g, round(CASE WHEN g = t0 THEN v0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + (v1 - v0) * (g - t0) / (t1 - t0) END, 6) AS v, (t0 IS NOT NULL AND t1 IS NOT NULL) AS is_observed FROM c""")
def grid_interpolate(spark, sf_dir):
    s = series(spark, sf_dir)
    grid = s.select(*BY).distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(30)))).select(*BY, (F.col("day") * 86400.0).alias("g"))
    return rounded(signal.interpolated(s, grid, BY))


@query(f"""WITH {SERIES}, r AS (SELECT *, coalesce(min(CASE WHEN t >= 86400 THEN idx END) OVER p, arg_min(idx, (abs(t - 86400), idx)) OVER p) AS pos FROM e WINDOW p AS (PARTITION BY case_id, channel)), k AS (SELECT * FROM r WHERE idx >= pos)
 SELECT case_id, channel, idx - pos AS idx, round(t - first_value(t) OVER w, 6) AS t, round(v - first_value(v) OVER w, 6) AS v FROM k {W}""")
def re_origin(spark, sf_dir):
    shifted = series(spark, sf_dir).withColumn("t", F.col("t") - 86400)
    return rounded(signal.from_reference(shifted, BY).select(*BY, "idx", "t", "v"))


def wide_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event of a user, its value in the column of its channel."""
    channels = {"click": "vehicle_longitudinal_accel_g", "view": "vehicle_lateral_accel_g", "purchase": "vehicle_vertical_accel_g", "signup": "seat_mid_deflection_mm", "error": "foot_left_x_accel_g"}
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6 / 1e7).alias("t"), "value", "event_type", "event_id")
    none = F.lit(None).cast("double")
    out = signal.numbered(e, ["case_id"], ["t", "event_id"]).withColumns({c: F.when(F.col("event_type") == k, F.col("value")) for k, c in channels.items()})
    return out.withColumns({c: none for c in ("vehicle_resultant_accel_g", "seat_inner_deflection_mm", "foot_left_z_accel_g", "foot_right_x_accel_g", "foot_right_z_accel_g")}).withColumns({"side": F.when(F.col("case_id") % 2 == 0, "driver").otherwise("passenger"), "v0": F.lit(17.0)})


@query("""WITH e AS (SELECT user_id AS case_id, (epoch_us(ts) - 1704067200000000) / 1e6 / 1e7 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CASE WHEN event_type = 'click' THEN value END AS ax, CASE WHEN event_type = 'view' THEN value END * CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS ay, CASE WHEN event_type = 'purchase' THEN value END AS az FROM events),
 s AS (SELECT *, coalesce(ax, 0) * 9.80665 * coalesce(t - lag(t) OVER w, 0) AS dx, coalesce(ay, 0) * 9.80665 * coalesce(t - lag(t) OVER w, 0) AS dy FROM e WINDOW w AS (PARTITION BY case_id ORDER BY idx)),
 c AS (SELECT *, sum(dx) OVER w AS dvx, sum(dy) OVER w AS dvy FROM s WINDOW w AS (PARTITION BY case_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT case_id, arg_max(dvx, idx) FILTER (t <= 0.1) AS x100, arg_max(dvy, idx) FILTER (t <= 0.1) AS y100, arg_max(dvx, idx) FILTER (t <= 0.06) AS x60, arg_max(dvy, idx) FILTER (t <= 0.06) AS y60, max(abs(ax)) FILTER (t <= 0.1) AS ax100, max(abs(az)) FILTER (t <= 0.1) AS az100, count(*) FILTER (t <= 0.1) AS n FROM c GROUP BY 1)
 SELECT case_id, round(x100, 6) AS window_100_delta_vx_mps, round(y100, 6) AS window_100_delta_vy_away_mps, round(CASE WHEN abs(x60) >= 0.25 THEN abs(y60) / abs(x60) END, 6) AS ri, round(abs(x100) / 17, 6) AS window_100_lr, round(ax100, 6) AS window_100_max_abs_ax_g, round(az100, 6) AS window_100_max_abs_az_g FROM a""")
def window_features(spark, sf_dir):
    out = signal.default_metrics(signal.window_metrics(wide_series(spark, sf_dir), ["case_id"], "side", "v0"), ["case_id"])
    return rounded(out.select("case_id", "window_100_delta_vx_mps", "window_100_delta_vy_away_mps", "ri", "window_100_lr", "window_100_max_abs_ax_g", "window_100_max_abs_az_g"))


@query()
def channel_features(spark, sf_dir):
    return signal.channel_features(series(spark, sf_dir), BY)


@query()
def phase_points(spark, sf_dir):
    return signal.phase_points(series(spark, sf_dir), BY, settle_run=3)


# --- vectors ---------------------------------------------------------------------------------------------------------

VECTORS = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) AS n FROM embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("e"))


@query(f"""WITH {VECTORS}, p AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.e, b.e) / (CASE WHEN a.n > 0 THEN a.n ELSE 1 END * CASE WHEN b.n > 0 THEN b.n ELSE 1 END) AS c, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.id < b.id)
 SELECT a, count(*) AS pairs, round(max(c), 6) AS best_cosine, round(avg(c), 6) AS mean_cosine, round(min(d), 6) AS least_distance, round(avg(d), 6) AS mean_distance FROM p GROUP BY 1""")
def cosine_pairs(spark, sf_dir):
    return rounded(clusters.pair_summary(vectors(spark, sf_dir), "id", "e"))


@query(f"""WITH {VECTORS}, p AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.e, b.e) / (a.n * b.n) AS c, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.id <> b.id),
 m AS (SELECT median(d) AS s FROM p WHERE a < b AND d > 0), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rc, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rd FROM p),
 h AS (SELECT a, b, (0.18 * (c + 1) / 2 + 0.10 / (1 + d / greatest(s, 1e-6))) / 0.28 AS sim, 0.32 * d / greatest(s, 1e-6) + 0.68 AS far FROM k, m WHERE rc <= 24 OR rd <= 24), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM h)
 SELECT a, CAST(rank AS INTEGER) AS rank, b, round(sim, 6) AS similarity, round(far, 6) AS hybrid_distance FROM r WHERE rank <= 10""")
def hybrid_similarity(spark, sf_dir):
    from waveloom.plans.paths import neighbour_path

    return rounded(neighbour_path(vectors(spark, sf_dir), "id", "e").select("a", "rank", "b", "similarity", "hybrid_distance"))


@query(f"""WITH {VECTORS}, u AS (SELECT label, n, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) SELECT label, CAST(i - 1 AS INTEGER) AS i, count(*) AS n, round(avg(x), 6) AS centre FROM u GROUP BY 1, 2""")
def centroids(spark, sf_dir):
    out = similarity.centroids(vectors(spark, sf_dir), "label", "e")
    return rounded(out.select("label", "n", F.posexplode("centre").alias("i", "centre")))


@query(f"""WITH {VECTORS}, m AS (SELECT a.id AS a, a.label AS la, b.label AS lb, avg(list_distance(a.e, b.e)) AS m FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3), s AS (SELECT a, la, max(m) FILTER (la = lb) AS own, min(m) FILTER (la <> lb) AS other FROM m GROUP BY 1, 2)
 SELECT a, la AS label, round(coalesce((other - own) / greatest(own, other), 0), 6) AS silhouette FROM s""")
def silhouette_exact(spark, sf_dir):
    out = clusters.silhouette(vectors(spark, sf_dir), "id", "e", "label")
    return rounded(out.withColumn("label", F.col("label").cast("int")))


@query(f"""WITH {VECTORS}, c AS (SELECT label, count(*) AS m FROM v GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, a.label AS l, m, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.id <> b.id AND a.label = b.label JOIN c ON c.label = a.label WHERE m > 2), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM p) WHERE rn <= least(greatest(5, ceil(m * 0.12)), m - 1)),
 n AS (SELECT a, any_value(l) AS l, avg(d) AS knn FROM k GROUP BY 1), z AS (SELECT k.a, avg(1 / greatest(n.knn, 1e-6)) AS db FROM k JOIN n ON k.b = n.a GROUP BY 1)
 SELECT a, l AS label, round(knn, 6) AS knn, round(db / greatest(1 / greatest(knn, 1e-6), 1e-6), 6) AS density_ratio, round(1 / (1 + knn), 6) AS stability FROM n JOIN z USING (a) UNION ALL SELECT id, label, NULL, 1.0, 1.0 FROM v JOIN c USING (label) WHERE m <= 2""")
def density_outliers(spark, sf_dir):
    return rounded(clusters.local_density(vectors(spark, sf_dir), "id", "e", "label"))


@query(f"""WITH {VECTORS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n, id) AS a, row_number() OVER (PARTITION BY label ORDER BY n DESC, id) AS b, row_number() OVER (ORDER BY n DESC, id) AS g FROM v)
 SELECT 'least' AS kind, label, id, CAST(a AS INTEGER) AS rank FROM k WHERE a <= 3 UNION ALL SELECT 'most', label, id, CAST(b AS INTEGER) FROM k WHERE b <= 3 UNION ALL SELECT 'global_most', label, id, CAST(g AS INTEGER) FROM k WHERE g <= 10""")
def representatives(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("n", F.sqrt(similarity.dot("e", "e")))
    return similarity.representatives(v, "label", "id", {"least": [F.col("n")], "most": [F.desc("n")]}, overall=("most", 10))
