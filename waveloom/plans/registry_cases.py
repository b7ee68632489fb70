"""Queries of catalog rules, labels, channel roles, derived signals, modes and domain scenarios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waveloom.functions import labels
from waveloom.functions import text as T
from waveloom.operators import channels, clusters, embedding, marts, mixed, relational, signal
from waveloom.plans import modes, paths
from waveloom.plans.registry import BY, ROWS, SERIES, VECTORS, W, query, result_rows, rounded, series, table, vectors
from waveloom.session import kept


@query(f"""WITH {SERIES}, s AS (SELECT *, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b, v - lag(v) OVER w AS p, lead(v) OVER w - v AS q, coalesce((t - lag(t) OVER w) * (v + lag(v) OVER w) / 2, 0) AS d FROM e {W}), g AS (SELECT *, coalesce((a * a * (v + q) + (b * b - a * a) * v - b * b * (v - p)) / (a * b * (a + b)), q / b, p / a) AS slope, sum(d) OVER (PARTITION BY case_id, channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS total FROM s)
 SELECT case_id, channel || CASE WHEN channel = 'view' THEN '__rate' ELSE '__jerk' END AS channel, idx, round(slope, 6) AS v FROM g WHERE channel IN ('click', 'view') UNION ALL SELECT case_id, channel || '__delta_v', idx, round(total, 2) FROM g WHERE channel IN ('click', 'error')""")
def derived_signals(spark, sf_dir):
    specs = {"click__jerk": ("click", "slope"), "view__rate": ("view", "slope"), "click__delta_v": ("click", "sum"), "error__delta_v": ("error", "sum")}
    out = signal.derived_signals(series(spark, sf_dir), "case_id", "channel", specs)
    return out.select("case_id", "channel", "idx", F.when(F.col("channel").endswith("delta_v"), F.round("v", 2)).otherwise(F.round("v", 6)).alias("v"))


#: What scanning broke and how it should read: one case of each pattern and of each joined word.
BROKEN = (
    *labels.JOINED, ("hea de r", "header"), ("head er", "header"), ("abdom en", "abdomen"), ("do or", "door"), ("d oor", "door"), ("k nee", "knee"), ("a nkle", "ankle"), ("an gle", "angle"), ("s ide", "side"), ("wind ow", "window"), ("win dow", "window"),
    ("verti cal", "vertical"), ("hori zontal", "horizontal"), ("das h", "dash"), ("p oint", "point"), ("whee l", "wheel"), ("whe el", "wheel"), ("wh ee l", "wheel"), ("r oof", "roof"), ("seat-beltcrash", "seat belt crash"), ("headcontacts", "Head contacts"), ("A - pillar", "A-pillar"),
)
_MENDED = f"[{', '.join(chr(39) + good + chr(39) for _, good in BROKEN)}][p_partkey % {len(BROKEN)} + 1] || ' ' || p_name"


@query(f"""SELECT p_partkey, '(' || p_name || ') A-pillar door, (mm)' AS clean, trim(regexp_replace(lower(p_name), '[^0-9a-z]+', ' ', 'g')) || ' a pillar door mm' AS canonical, CASE WHEN p_partkey % 3 = 0 THEN 'Nij ' || p_name ELSE '' END AS other, {_MENDED} AS mended, trim(regexp_replace(lower({_MENDED}), '[^0-9a-z]+', ' ', 'g')) AS mended_key FROM part""")
def label_canonical(spark, sf_dir):
    k = F.col("p_partkey")
    broken = F.concat_ws(" ", F.element_at(F.array(*(F.lit(bad) for bad, _ in BROKEN)), (k % len(BROKEN) + 1).cast("int")), "p_name")
    p = table(spark, sf_dir, "part").withColumns({"raw": F.concat(F.lit("( "), "p_name", F.lit(" ) A - pillar do  or , ( mm ) 988 Dairy Road x")), "odd": F.when(k % 3 == 0, F.concat(F.lit("N "), "p_name", F.lit("  ij"))).otherwise("2013"), "broken": broken})
    return p.select("p_partkey", labels.clean_label("raw").alias("clean"), labels.canonical_label("raw").alias("canonical"), labels.clean_label("odd").alias("other"), labels.clean_label("broken").alias("mended"), labels.canonical_label("broken").alias("mended_key"))


CHANNELS = """c AS (SELECT p_size AS case_id, p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_name || '_RAW_data_time_axis' WHEN 1 THEN p_name || '_raw_data_time_axis_2' WHEN 4 THEN p_name || ' time' WHEN 5 THEN 'analysis_' || p_name WHEN 6 THEN p_name || ' upper_bound' ELSE p_name || p_partkey::VARCHAR END AS series_key,
 CASE p_partkey % 9 WHEN 2 THEN 'Time Axis' WHEN 3 THEN 'time axis 2' END AS series_name, CASE WHEN p_partkey % 2 = 0 THEN 'Raw data' WHEN p_partkey % 11 = 0 THEN 'corridors' END AS source_group, CASE WHEN p_partkey % 3 = 1 THEN 's' END AS unit, p_partkey % 13 > 0 AS is_present, p_partkey % 17 > 0 AS is_numeric FROM part)"""


@query(f"""WITH {CHANNELS}, m AS (SELECT *, p_partkey % 9 AS m, coalesce(source_group = 'Raw data', false) AS raw, coalesce(unit = 's', false) AND contains(lower(series_key), 'time') AS sec FROM c),
 r AS (SELECT *, CASE WHEN m = 0 THEN 0 WHEN m = 1 THEN 1 WHEN m = 2 AND raw THEN 2 WHEN m = 3 AND raw THEN 3 WHEN m = 2 THEN 4 WHEN m = 3 THEN 5 WHEN sec AND raw THEN 6 WHEN sec THEN 7 END AS rank FROM m), k AS (SELECT case_id, arg_min(series_key, (rank, series_key)) AS time_key FROM r WHERE rank IS NOT NULL GROUP BY 1)
 SELECT p_partkey, rank, CASE WHEN series_key = time_key THEN 'primary_time_axis' WHEN NOT is_present THEN 'column_missing_in_parquet' WHEN NOT is_numeric THEN 'non_numeric' WHEN m = 2 OR sec THEN 'auxiliary_time_axis' WHEN coalesce(source_group = 'corridors', false) OR m IN (5, 6) THEN 'reference' ELSE 'signal' END AS role FROM r LEFT JOIN k USING (case_id)""")
def channel_roles(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    keys = {0: F.concat(name, F.lit("_RAW_data_time_axis")), 1: F.concat(name, F.lit("_raw_data_time_axis_2")), 4: F.concat(name, F.lit(" time")), 5: F.concat(F.lit("analysis_"), name), 6: F.concat(name, F.lit(" upper_bound"))}
    c = table(spark, sf_dir, "part").select(F.col("p_size").alias("case_id"), k, F.coalesce(*(F.when(k % 9 == m, x) for m, x in keys.items()), F.concat(name, k.cast("string"))).alias("series_key"), F.when(k % 9 == 2, "Time Axis").when(k % 9 == 3, "time axis 2").alias("series_name"), F.when(k % 2 == 0, "Raw data").when(k % 11 == 0, "corridors").alias("source_group"), F.when(k % 3 == 1, "s").alias("unit"), (k % 13 > 0).alias("is_present"), (k % 17 > 0).alias("is_numeric"))
    return channels.roles(c, "case_id").select("p_partkey", channels.time_rank().alias("rank"), "role")


@query(f"""WITH {ROWS} SELECT quality_status IS DISTINCT FROM 'ok' AS is_rest, count(*) AS n, round(sum(left_number), 2) AS total FROM r GROUP BY 1""")
def complement_split(spark, sf_dir):
    return rounded(relational.complement(result_rows(spark, sf_dir), "quality_status", "ok").groupBy("is_rest").agg(F.count("*").alias("n"), F.sum("left_number").alias("total")), 2)


@query(r"""SELECT nullif(regexp_extract(url, 'https?://([^/:?#]+)', 1), '') AS host, max(coalesce(starts_with(lower(url), 'https://'), false)::INT) AS secure, max(coalesce(ends_with(lower(url), '.html'), false)::INT) AS html, max(coalesce(ends_with(lower(url), '1'), false)::INT) AS one FROM pages GROUP BY 1""")
def asset_flags(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("host", T.first_match("url", r"https?://([^/:?#]+)"))
    return relational.asset_flags(pages, "host", "url", {"secure": "HTTPS://"}, {"html": ".html", "one": "1"})


@query("""WITH l AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 2 END AS side, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, s_acctbal AS own FROM supplier), r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AS side, c_name AS name, c_acctbal AS weight FROM customer)
 SELECT l.id, l.side, coalesce(l.name, r.name) AS name, own, weight FROM l LEFT JOIN r ON l.id = r.id AND l.side IS NOT DISTINCT FROM r.side""")
def fallback_merge(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    left = table(spark, sf_dir, "supplier").select(s.alias("id"), F.when(s % 3 > 0, s % 2).alias("side"), F.when(s % 2 == 0, F.col("s_name")).alias("name"), F.col("s_acctbal").alias("own"))
    right = table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 3 > 0, c % 4).alias("side"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("weight"))
    return relational.merged_with_fallback(left, right, ["id", "side"])


@query("""SELECT 'rows' AS metric, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'last', max(o_orderkey)::VARCHAR FROM orders UNION ALL SELECT 'states', string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders UNION ALL SELECT 'none', NULL""")
def summary_rows(spark, sf_dir):
    return relational.summary_rows(table(spark, sf_dir, "orders"), {"rows": F.count("*"), "last": F.max("o_orderkey"), "states": F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ","), "none": F.max(F.lit(None).cast("int"))})


@query("""SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 ELSE 2 END, turn, role) AS INTEGER) AS place FROM conversations""")
def kind_order(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy(relational.case_rank("role", ["assistant", "system"]), "turn", "role")).alias("place"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def top_outliers(spark, sf_dir):
    return relational.capped(table(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000), [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, c_nationkey) / 3.6, 6) AS speed, CASE WHEN c_acctbal / 5000 > -1 AND c_acctbal / 5000 <= 0.2 THEN '<=0.2' WHEN c_acctbal / 5000 > 0.2 AND c_acctbal / 5000 <= 0.35 THEN '0.2-0.35' WHEN c_acctbal / 5000 > 0.35 AND c_acctbal / 5000 <= 0.5 THEN '0.35-0.5' WHEN c_acctbal / 5000 > 0.5 AND c_acctbal / 5000 <= 1 THEN '0.5-1.0' WHEN c_acctbal / 5000 > 1 AND c_acctbal / 5000 <= 10 THEN '>1.0' END AS band FROM customer""")
def speeds_and_bands(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumns({"actual": F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")), "target": F.col("c_nationkey").cast("double")})
    return c.select("c_custkey", F.round(T.metres_per_second("actual", "target"), 6).alias("speed"), T.banded(F.col("c_acctbal") / 5000, [-1, 0.2, 0.35, 0.5, 1.0, 10.0], ["<=0.2", "0.2-0.35", "0.35-0.5", "0.5-1.0", ">1.0"]).alias("band"))


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 49) SELECT o_orderkey, o_custkey, o_orderkey IN (SELECT k FROM n) AS is_large FROM orders""")
def semi_join(spark, sf_dir):
    o, large = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.case_set(o, "o_orderkey", None, large).withColumn("is_large", F.lit(True)).union(relational.anti(o, large, "o_orderkey").withColumn("is_large", F.lit(False)))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def fan_out_counts(spark, sf_dir):
    # Each side is counted before it is joined, so the rows of one never multiply those of the other.
    n = table(spark, sf_dir, "nation")
    for name, key, by in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        n = n.join(table(spark, sf_dir, name).groupBy(F.col(by).alias("n_nationkey")).agg(F.count_distinct(key).alias(f"{name}s")), "n_nationkey", "left")
    return n.groupBy("n_name").agg(F.sum(F.coalesce("customers", F.lit(0))).alias("customers"), F.sum(F.coalesce("suppliers", F.lit(0))).alias("suppliers"))


@query("""SELECT p_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS place FROM part GROUP BY 1""")
def most_common(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_type")))  # one row a kind


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_totalprice DESC, o_orderkey LIMIT 40""")
def work_queue(spark, sf_dir):
    return relational.pending(table(spark, sf_dir, "orders"), "o_orderstatus", ("O", "P"), [F.desc("o_totalprice"), "o_orderkey"], 40).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"""WITH {VECTORS}, c AS (SELECT least(20, greatest(5, count(*) // 20)) AS k FROM v), p AS (SELECT a.id AS a, b.id AS b, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.id <> b.id), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM p), c WHERE rn <= k),
 h AS (SELECT a AS b, max(d) AS kth FROM n GROUP BY 1), l AS (SELECT n.a, 1 / (avg(greatest(d, kth)) + 1e-10) AS density FROM n JOIN h USING (b) GROUP BY 1), f AS (SELECT n.a, avg(o.density) / any_value(s.density) AS lof FROM n JOIN l o ON o.a = n.b JOIN l s ON s.a = n.a GROUP BY 1)
 SELECT a, round(lof, 6) AS lof, (lof > (SELECT quantile_cont(lof, 0.96) FROM f))::INT AS is_outlier FROM f""")
def embedding_outliers(spark, sf_dir):
    return rounded(clusters.local_outlier_factor(vectors(spark, sf_dir), "id", "e"))


@query()
def embedding_clusters(spark, sf_dir):
    """Three to twelve k-means clusters over standardised vectors, and how far out each row lies."""
    return embedding.embedding_clusters(vectors(spark, sf_dir), "id", "e")[0]


@query()
def embedding_views(spark, sf_dir):
    """Each user's series, resampled and reduced in four views; shares of the views' variance beside the embedding."""
    s = series(spark, sf_dir).withColumnRenamed("case_id", "case")
    order = ["click", "view", "purchase", "signup", "error"]
    specs = {"global": (12, 0.10, (0, 1, 2, 3, 4)), "pulse": (8, 0.55, (0, 1)), "occupant": (6, 0.05, (2, 3)), "lower_extremity": (4, 0.30, (4,))}
    out, told = embedding.view_embeddings(embedding.resampled(s, ["case", "channel"], 64), order, specs)
    return out.select("case", "embedding", *(F.lit(t["explained"]).alias(f"{v}_explained") for v, t in told.items()))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT id, [e[1:30], e[31:50], e[51:64]] AS w, list_transform(e, lambda x: x - list_avg(e)) AS c FROM v), n AS (SELECT id, list_transform(w, lambda x: list_transform(x, lambda y: y / greatest(sqrt(list_inner_product(x, x)), 1e-8))) AS w, c, sqrt(list_inner_product(c, c)) AS s FROM u),
 p AS (SELECT a.id AS a, b.id AS b, 0.6 * list_inner_product(a.w[1], b.w[1]) + 0.1 * list_inner_product(a.w[2], b.w[2]) + 0.3 * list_inner_product(a.w[3], b.w[3]) AS views, (list_inner_product(a.c, b.c) / (a.s * b.s) + 1) / 2 AS r FROM n a JOIN n b ON a.id <> b.id),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY views DESC, b) AS rn FROM p) WHERE rn <= 80),
 f AS (SELECT s_suppkey AS id, 'balance' AS f, s_acctbal AS x, 2000.0 AS s FROM supplier UNION ALL SELECT c_custkey, 'nation', c_nationkey, 5.0 FROM customer), h AS (SELECT k.a, k.b, avg(exp(-abs(x.x - y.x) / x.s)) AS phase FROM k JOIN f x ON x.id = k.a JOIN f y ON y.id = k.b AND y.f = x.f GROUP BY 1, 2),
 z AS (SELECT k.a, k.b, views, r, phase, 0.82 * views + 0.10 * r + coalesce(0.08 * phase, 0) AS score FROM k LEFT JOIN h ON h.a = k.a AND h.b = k.b), o AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM z)
 SELECT a, CAST(rank AS INTEGER) AS rank, b, round(score, 6) AS score, round(views, 6) AS views, round(r, 6) AS correlation, round(phase, 6) AS phase FROM o WHERE rank <= 10""")
def embedding_neighbours(spark, sf_dir):
    """Neighbours over three weighted views of the vectors, with correlation and phase scores of the candidates."""
    balance = table(spark, sf_dir, "supplier").groupBy(F.col("s_suppkey").alias("id")).agg(F.max(F.col("s_acctbal").cast("double")).alias("balance"))
    nation = table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("id")).agg(F.max(F.col("c_nationkey").cast("double")).alias("nation"))
    v = vectors(spark, sf_dir).join(balance, "id", "left").join(nation, "id", "left")
    cut = v.select("id", F.slice("e", 1, 30).alias("one"), F.slice("e", 31, 20).alias("two"), F.slice("e", 51, 14).alias("three"), "balance", "nation")
    missing = F.lit(float("nan"))
    chosen = embedding.view_candidates(cut, "id", {"one": 0.6, "two": 0.1, "three": 0.3}, values=F.array(F.coalesce("balance", missing), F.coalesce("nation", missing)))
    scored = kept(chosen.select("a", "b", "views", "correlation", embedding.phase_score("x", "y", (2000.0, 5.0)).alias("phase")), "candidates")
    return rounded(embedding.best_views(scored))


#: The ten channels of the window features; each kind of event stands for two of them, by its number.
TEN = ("vehicle_longitudinal_accel_g", "vehicle_lateral_accel_g", "vehicle_vertical_accel_g", "vehicle_resultant_accel_g", "seat_mid_deflection_mm", "seat_inner_deflection_mm", "foot_left_x_accel_g", "foot_left_z_accel_g", "foot_right_x_accel_g", "foot_right_z_accel_g")


def ten_channels(spark, sf_dir):
    """One row for each event of a user, its value in the column of one of ten channels."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6 / 1e7).alias("t"), "value", "event_type", "event_id")
    kinds = ("click", "view", "purchase", "signup", "error")
    at = 2 * (F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1) + F.col("event_id") % 2
    out = signal.numbered(e, ["case_id"], ["t", "event_id"]).withColumns({c: F.when(at == i, F.col("value")) for i, c in enumerate(TEN)})
    return out.withColumns({"side": F.when(F.col("case_id") % 2 == 0, "driver").otherwise("passenger"), "v0": F.lit(17.0)})


def _modes(spark, sf_dir, windows=signal.WINDOWS_MS):
    """Window features of the cases, made ready under the rules of eligibility and coverage as they stand."""
    features = signal.default_metrics(signal.window_metrics(ten_channels(spark, sf_dir), ["case_id"], "side", "v0"), ["case_id"])
    outcome = result_rows(spark, sf_dir).groupBy("case_id").agg(F.avg("result_number").alias("outcome"))
    return modes.ready(features.join(outcome, "case_id", "left"), windows)


@query()
def window_sweep(spark, sf_dir):
    """All eight windows, two to four clusters, twenty tries each; the best of each window and the chosen window."""
    rows = modes.sweep(_modes(spark, sf_dir), "case_id", "outcome")
    schema = "window_ms int, k int, sample_count long, silhouette double, inertia double, smallest long, largest long, size_ratio double, eta_squared double, composite double, operating boolean, robustness boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@query()
def kmeans_sweep(spark, sf_dir):
    """Clusters of the chosen number at 150 ms, named."""
    labelled, rows = modes.runs(_modes(spark, sf_dir, (150,)), "case_id", (150,))
    best = modes.chosen(rows)
    label = f"c150_{best['k']}"
    return modes.named(labelled.filter(F.col(label).isNotNull()), label, 150, best["k"]).select("case_id", F.col(label).alias("cluster"), "working_mode_label", F.lit(best["k"]).alias("k"))


@query()
def kmedoids(spark, sf_dir):
    return clusters.kmedoids(vectors(spark, sf_dir), "id", "e", 4)


#: The views of the given vectors: weights as those of cases, and a share of the components each.
VECTOR_VIEWS = {"pulse": (paths.VIEW_WEIGHTS["pulse"], list(range(30))), "occupant": (paths.VIEW_WEIGHTS["occupant"], list(range(30, 50))), "lower_extremity": (paths.VIEW_WEIGHTS["lower_extremity"], list(range(50, 64)))}


@query()
def cluster_choice(spark, sf_dir):
    """Two to ten clusters over the mixed distance, chosen by silhouette and size; each case's medoid, density and outlier score."""
    frame = mixed.mixed_frame(vectors(spark, sf_dir), "id", "e", VECTOR_VIEWS)
    return mixed.cluster_rows(frame, mixed.choose(frame))


@query()
def cluster_representatives(spark, sf_dir):
    """Of each chosen cluster the central, outermost, most stable and best covered cases, and the ten most central of all."""
    v = vectors(spark, sf_dir)
    frame = mixed.mixed_frame(v, "id", "e", VECTOR_VIEWS)
    rows = kept(mixed.cluster_rows(frame, mixed.choose(frame)), "cluster-rows")
    coverage = v.select(F.col("id").alias("case"), F.aggregate("e", F.lit(0.0), lambda s, x: s + (F.abs(x) > 0.1).cast("double")).alias("coverage"))
    return mixed.representatives(frame, rows, coverage)


def _domain_frame(spark, sf_dir):
    """Each supplier's lines as outcomes: the largest and smallest of four measures by line number."""
    li = table(spark, sf_dir, "lineitem")
    needed = sorted({c for cols, _ in marts.COMPONENTS.values() for c in cols})
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    aggs = [F.avg(F.when(F.col("l_linenumber") == i % 7 + 1, F.col(measures[i % 4]))).alias(c) for i, c in enumerate(needed)]
    scores = [F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f"{d}_score") for d, f in zip(marts.DOMAINS, ("A", "N", "R", "A"), strict=True)]
    x = [F.avg("l_discount").alias("p1"), F.avg("l_tax").alias("p2"), F.avg("l_quantity").alias("p3")]
    key = F.col("l_suppkey")
    return li.groupBy(key.alias("case_id")).agg(*aggs, *scores, *x).withColumns({"test_side": F.when(F.col("case_id") % 2 == 0, "passenger").otherwise("driver"), "era": F.when(F.col("case_id") % 3 == 0, "2015-2017").otherwise("2018-")})


@query()
def domain_scenarios(spark, sf_dir):
    return marts.domain_scenarios(_domain_frame(spark, sf_dir), ["p1", "p2", "p3"])


@query()
def lower_extremity_variants(spark, sf_dir):
    return marts.lower_extremity_variants(_domain_frame(spark, sf_dir), ["p1", "p2", "p3"])


@query()
def case_neighbours(spark, sf_dir):
    """The ten most similar cases by all seven parts of the hybrid similarity, over the series of all channels."""
    s = series(spark, sf_dir).withColumnRenamed("case_id", "case")
    return paths.full_neighbours(s, {"pulse": ["click", "view"], "occupant": ["purchase", "signup"], "lower_extremity": ["error"]}, {"click": 1.3, "view": 0.85}, least=8)


@query()
def dtw_neighbors(spark, sf_dir):
    """The five nearest cases by time warping, over all channels that two cases have."""
    s = series(spark, sf_dir).withColumnRenamed("case_id", "case")
    chosen = kept(clusters.nearest(paths.feature_vectors(s), "case", "vector", 24).select("a", "b"), "candidates")
    found = paths.channel_dtw(chosen, s, {})
    return relational.first_per_key(found.filter("dtw IS NOT NULL"), ["a"], ["dtw", "b"], 5, "rank")
