"""More queries beside their SQL: catalog lookups, reviews of clusters, series bookkeeping, waveform scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waveloom.functions import order
from waveloom.operators import marts, relational, signal, similarity
from waveloom.plans import audit
from waveloom.plans.registry import BY, ROWS, SERIES, VECTORS, query, result_rows, rounded, series, table, vectors


@query("""WITH n AS (SELECT l_suppkey AS source, l_partkey AS target, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM n)
 SELECT source, CAST(rank AS INTEGER) AS rank, target, score, s_name, n_name, p_brand, p_type FROM k JOIN supplier ON s_suppkey = source JOIN nation ON s_nationkey = n_nationkey JOIN part ON p_partkey = target WHERE rank <= 3""")
def neighbor_lookup(spark, sf_dir):
    li, s, n, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "part"))
    scored = li.groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.max("l_extendedprice").alias("score"))
    top = relational.first_per_key(scored, ["source"], [F.desc("score"), "target"], 3, "rank")
    return top.join(s, top.source == s.s_suppkey).join(n, F.col("s_nationkey") == n.n_nationkey).join(p, top.target == p.p_partkey).select("source", "rank", "target", "score", "s_name", "n_name", "p_brand", "p_type")


@query("""WITH w(standard_name, alias, place) AS (VALUES ('ring', 'red ring', 0), ('ring', 'blue-ring', 1), ('bolt', 'SMALL BOLT', 0), ('none', 'no such part', 0)),
 h AS (SELECT p_size AS case_id, standard_name, p_brand AS group_name, p_name AS channel_name, p_type = 'SMALL' AS is_raw, row_number() OVER (PARTITION BY p_size, standard_name ORDER BY p_type = 'SMALL', place, length(p_name), p_brand, p_name) AS rn
  FROM part JOIN w ON regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g'))
 SELECT case_id, standard_name, group_name, channel_name, is_raw FROM h WHERE rn = 1""")
def resolve_channels(spark, sf_dir):
    wanted = spark.createDataFrame([("ring", "red ring", 0), ("ring", "blue-ring", 1), ("bolt", "SMALL BOLT", 0), ("none", "no such part", 0)], "standard_name string, alias string, place int")
    channels = table(spark, sf_dir, "part").select(F.col("p_size").alias("case_id"), F.col("p_brand").alias("group_name"), F.col("p_name").alias("channel_name"), (F.col("p_type") == "SMALL").alias("is_raw"))
    return relational.resolved(wanted, channels)[0]


@query(f"""WITH {ROWS}, m AS (SELECT case_id, max(CASE WHEN starts_with(lower(normalized_label), 'red') THEN abs(right_number) END) AS red, max(CASE WHEN contains(lower(normalized_label), 'small') AND contains(lower(normalized_label), 'bolt') THEN left_number END) AS small_bolt FROM r GROUP BY 1)
 SELECT case_id, red, small_bolt, CASE WHEN small_bolt IS NULL THEN NULL WHEN small_bolt <= 46 THEN 'good' WHEN small_bolt <= 48 THEN 'acceptable' WHEN small_bolt <= 49 THEN 'marginal' ELSE 'poor' END AS rating FROM m""")
def rule_overlay(spark, sf_dir):
    rules = [{"name": "red", "prefix": "red", "how": "abs"}, {"name": "small_bolt", "terms": ["small", "bolt"]}]
    rows = result_rows(spark, sf_dir)
    reds = relational.rule_join(rows, rules[:1], "normalized_label", "right_number")
    bolts = relational.rule_join(rows, rules[1:], "normalized_label", "left_number")
    return reds.join(bolts, "case_id").withColumn("rating", relational.rating("small_bolt", 46, 48, 49))


@query("""WITH o AS (SELECT o_custkey, max((o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT')::INT) AS a, max((o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT')::INT) AS b, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS id FROM orders GROUP BY 1),
 d AS (SELECT o_custkey, max((o_orderpriority = '2-HIGH')::INT) AS p, max((o_orderpriority = '3-MEDIUM')::INT) AS x FROM orders GROUP BY 1)
 SELECT c_custkey AS filegroup_id, coalesce(a, 0) AS standard_baseline_flag, coalesce(b, 0) AS strict_origin_flag, id AS preprocessing_case_id, coalesce(p, 0) AS pdf_flag, coalesce(x, 0) AS excel_flag, c_name AS family, concat(c_mktsegment, '|driver|', CASE WHEN coalesce(a, 0) = 1 THEN 'signal-ready' ELSE 'signal-missing' END) AS cohort FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN d ON c_custkey = d.o_custkey""")
def case_master(spark, sf_dir):
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("filegroup_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("era"), F.lit("driver").alias("test_side"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "filegroup_id")
    signals = o.select("filegroup_id", F.when(F.col("o_orderstatus") == "F", "standard_baseline").when(F.col("o_orderstatus") == "O", "strict_origin").alias("mode"), F.when(F.col("o_orderpriority") == "1-URGENT", "error").otherwise("done").alias("status"), F.col("o_orderkey").alias("preprocessing_case_id"))
    papers = o.select("filegroup_id", F.when(F.col("o_orderpriority") == "2-HIGH", "pdf").when(F.col("o_orderpriority") == "3-MEDIUM", "excel").otherwise("other").alias("kind"))
    return marts.case_master(cases, signals, papers).select("filegroup_id", "standard_baseline_flag", "strict_origin_flag", "preprocessing_case_id", "pdf_flag", "excel_flag", "family", "cohort")


@query(f"""WITH {SERIES}, d AS (SELECT case_id, channel, t - lag(t) OVER w AS dt, t, v FROM e WINDOW w AS (PARTITION BY case_id, channel ORDER BY idx)) SELECT case_id, channel, count(*) AS samples, count(v) AS present, round(min(t), 6) AS start_t, round(max(t), 6) AS end_t, round(median(dt), 6) AS step, round(coalesce(stddev_samp(v), 0), 6) AS std FROM d GROUP BY 1, 2""")
def series_catalog(spark, sf_dir):
    w = Window.partitionBy(*BY).orderBy("idx")
    d = series(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(w))
    steps = order.quantiles(d, {"step": ("dt", 0.5)}, BY)
    return rounded(d.groupBy(*BY).agg(F.count("*").alias("samples"), F.count("v").alias("present"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std")).join(steps, BY))


@query("""SELECT o_custkey, count_if(o_orderstatus = 'P') AS errors, count(*) AS files, CASE WHEN count_if(o_orderstatus = 'P') > 0 THEN 'error' ELSE 'downloaded' END AS state FROM orders GROUP BY 1""")
def status_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "error").otherwise("done"))
    return audit.rolled_up(o, "o_custkey")


@query("""WITH s AS (SELECT s_suppkey, [CASE WHEN s_acctbal <= 5000 THEN 'funded' END, CASE WHEN s_nationkey >= 12 THEN 'local' END] AS g FROM supplier), x AS (SELECT unnest(g) AS gap FROM s) SELECT gap, count(*) AS n FROM x WHERE gap IS NOT NULL GROUP BY 1""")
def gap_reasons(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return audit.gap_reasons(audit.stage_audit(s, {"funded": s.filter("s_acctbal > 5000"), "local": s.filter("s_nationkey < 12")}, "s_suppkey"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY 1""")
def json_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"), F.max("p.k").alias("k_max"))


@query("""WITH s AS (SELECT c_mktsegment AS label, c_custkey AS id, c_acctbal AS v, 1 + (c_custkey % 10) / 10.0 AS ratio, median(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer), d AS (SELECT label, median(abs(v - m)) * 1.4826 AS s FROM s GROUP BY 1)
 SELECT id, round((v - m) / d.s, 6) AS robust_distance, ((v - m) / d.s >= 1.2 OR ratio >= 1.65)::INT AS is_outlier, round(greatest((v - m) / d.s, (ratio - 1) * 5), 6) AS outlier_score FROM s JOIN d USING (label)""")
def outlier_flags(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), (1 + (F.col("c_custkey") % 10) / 10).alias("ratio"))
    return rounded(similarity.outliers(c, "v", "ratio", "label", far=1.2).select("id", "robust_distance", "is_outlier", "outlier_score"))


@query(f"""WITH {VECTORS}, u AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2) GROUP BY 1) SELECT id, round(list_distance(e, c), 6) AS centroid_distance FROM v JOIN c USING (label)""")
def centroid_distances(spark, sf_dir):
    return rounded(similarity.centroid_distances(vectors(spark, sf_dir), "label", "e").select("id", "centroid_distance"))


@query("""WITH n AS (SELECT o_orderkey, 'closed' AS state, 1 AS version FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT o_orderkey, o_orderstatus AS state FROM orders) SELECT o_orderkey, state, NULL::INTEGER AS version FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT o_orderkey, state, version FROM n""")
def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return relational.upsert(o.select("o_orderkey", F.col("o_orderstatus").alias("state")), o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("closed").alias("state"), F.lit(1).alias("version")), ["o_orderkey"])


@query(f"""WITH {ROWS}, c AS (SELECT case_id, max(result_number) AS a, avg(left_number) AS b, avg(right_number) AS c, min(time_number) AS d FROM r GROUP BY 1),
 z AS (SELECT d, (a - median(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - median(b) OVER ()) / stddev_pop(b) OVER () AS b, (c - median(c) OVER ()) / stddev_pop(c) OVER () AS c, b AS drv FROM c)
 SELECT 'all' AS scenario, 'one' AS domain, round(corr((a + b) / 2, drv), 6) AS r FROM z UNION ALL SELECT 'a', 'one', round(corr(b, drv), 6) FROM z UNION ALL SELECT 'all', 'two', round(corr(c, drv), 6) FROM z UNION ALL SELECT 'a', 'two', round(corr(c, drv), 6) FROM z""")
def domain_sensitivity(spark, sf_dir):
    per = result_rows(spark, sf_dir).groupBy("case_id").agg(F.max("result_number").alias("a"), F.avg("left_number").alias("b"), F.avg("right_number").alias("c"))
    return rounded(marts.sensitivity(per, {"one": ["a", "b"], "two": ["c"]}, "b", [None, "a"]))


@query(f"""WITH {SERIES}, p AS (SELECT case_id, channel, arg_max(t, (abs(v), -idx)) AS t FROM e GROUP BY 1, 2), w AS (SELECT case_id, max(t) FILTER (channel = 'click') AS base, max(t) FILTER (channel = 'view') AS view, max(t) FILTER (channel = 'error') AS error FROM p GROUP BY 1)
 SELECT case_id, round(view - base, 6) AS view_minus_click, round(error - base, 6) AS error_minus_click, round(greatest(view, error) - least(view, error), 6) AS spread FROM w""")
def cross_channel_lags(spark, sf_dir):
    return rounded(signal.lag_features(signal.peaks(series(spark, sf_dir), BY), "case_id", "channel", "peak_abs_t", "click", ["view", "error"]))


@query(f"""WITH {SERIES}, f AS (SELECT case_id, channel, arg_max(v, idx) FILTER (t <= 1296000) AS fin FROM e GROUP BY 1, 2)
 SELECT case_id, channel, round(min(t) FILTER (abs(fin) > 0 AND abs(v) >= abs(fin) / 2), 6) AS half_t FROM e JOIN f USING (case_id, channel) WHERE t <= 1296000 GROUP BY 1, 2""")
def half_time(spark, sf_dir):
    return rounded(signal.half_time(series(spark, sf_dir), BY, 1296000.0))


@query(f"""WITH {SERIES}, x AS (SELECT a.case_id AS a, b.case_id AS b, a.channel, count(*) AS n, corr(a.v, b.v) AS r, sqrt(avg((a.v - b.v) * (a.v - b.v))) AS d, greatest(max(abs(a.v)), max(abs(b.v))) AS m FROM e a JOIN e b ON a.channel = b.channel AND a.idx = b.idx AND a.case_id < b.case_id GROUP BY 1, 2, 3),
 y AS (SELECT *, CASE channel WHEN 'click' THEN 1.3 WHEN 'view' THEN 0.85 ELSE 1 END AS w FROM x WHERE n >= 8)
 SELECT a, b, round(sum(w * r) / sum(w), 6) AS correlation, round(sum(w * d / m) / sum(w), 6) AS rmse, count(*) AS overlap FROM y GROUP BY 1, 2""")
def waveform_scores(spark, sf_dir):
    s = series(spark, sf_dir).withColumnRenamed("case_id", "case")
    return rounded(similarity.all_waveforms(s, {"click": 1.3, "view": 0.85}, 8))


@query(f"""WITH {SERIES}, h AS (SELECT case_id, channel FROM e GROUP BY 1, 2 HAVING count(*) >= 12), p AS (SELECT a.case_id AS a, b.case_id AS b FROM (SELECT DISTINCT case_id FROM e) a, (SELECT DISTINCT case_id FROM e) b WHERE a.case_id < b.case_id)
 SELECT a, b, count(DISTINCT x.channel) FILTER (y.channel IS NOT NULL) AS both, (SELECT count(DISTINCT channel) FROM h WHERE h.case_id IN (p.a, p.b)) AS either FROM p LEFT JOIN h x ON x.case_id = a LEFT JOIN h y ON y.case_id = b AND y.channel = x.channel GROUP BY a, b""")
def availability_overlap(spark, sf_dir):
    s = series(spark, sf_dir).withColumnRenamed("case_id", "case")
    return similarity.all_availability(s, 12)


@query("""WITH c AS (SELECT o_orderpriority AS band, o_orderstatus AS label, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY n, label) AS rn FROM c) SELECT band, label AS minor, n, round(m, 4) AS mean_price FROM k WHERE rn = 1""")
def minor_cluster(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("band"), F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"))
    return relational.first_per_key(per, ["band"], ["n", "label"]).select("band", F.col("label").alias("minor"), "n", F.round("m", 4).alias("mean_price"))


@query()
def pca_reduced(spark, sf_dir):
    return similarity.reduced(vectors(spark, sf_dir), "id", "e", 64)
