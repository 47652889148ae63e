"""Queries over tables: cascades, quality grids, joins, sets, text, hashing, configuration rules, contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contracts as C
from ..operators import relational as R
from ..sources.tables import reconcile, table, unpivot_wide
from ..streaming.incremental import work_list as remaining_work
from .base import query, rounded

CASCADE = ["p_type NOT LIKE 'STANDARD%'", "p_size <= 40", "p_brand <> 'Brand#11'", "p_name LIKE '%1%'"]


@query(
    "WITH m AS (SELECT CASE " + " ".join(f"WHEN NOT coalesce({c}, false) THEN {k}" for k, c in enumerate(CASCADE, 1)) + " END AS f FROM part), s AS (SELECT CAST(unnest([1, 2, 3, 4]) AS INT) AS step, unnest(['type', 'size', 'brand', 'name']) AS name)"
    " SELECT step, name, count(f) AS removed, CAST((SELECT count(*) FROM part) - sum(count(f)) OVER (ORDER BY step) AS BIGINT) AS remaining FROM s LEFT JOIN m ON f = step GROUP BY step, name"
)
def filter_cascade(spark, sf):
    return R.filter_cascade(table(spark, sf, "part"), list(zip(("type", "size", "brand", "name"), map(F.expr, CASCADE), strict=True)))[1]


CUTS = [10.0, 25.0, 50.0, 75.0, 100.0]


@query("SELECT CAST(cut AS DOUBLE) AS cut, count(value) AS n_below, round(100.0 * count(value) / (SELECT count(value) FROM events), 2) + 0.0 AS pct_below FROM (SELECT unnest([10.0, 25.0, 50.0, 75.0, 100.0]) AS cut) LEFT JOIN events ON value < cut GROUP BY cut")
def qc_grid(spark, sf):
    return R.below_grid(table(spark, sf, "events"), "value", CUTS)


@query("SELECT CAST(cut AS DOUBLE) AS cut, count(value) AS n_below, round(median(CAST(user_id AS DOUBLE)), 6) AS median_user_id FROM (SELECT unnest([10.0, 25.0, 50.0, 75.0, 100.0]) AS cut) LEFT JOIN events ON value < cut GROUP BY cut")
def qc_medians_below(spark, sf):
    return R.below_grid(table(spark, sf, "events"), "value", CUTS, ["user_id"]).drop("pct_below")


@query("SELECT value >= 25.0 AS keep, count(*) AS n FROM events GROUP BY 1")
def qc_apply(spark, sf):
    return table(spark, sf, "events").withColumn("keep", F.col("value") >= 25.0).groupBy("keep").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 25.0) AS n_keep, round(100.0 * count(*) FILTER (WHERE value < 25.0) / count(*), 2) + 0.0 AS pct_lost FROM events GROUP BY 1")
def class_impact(spark, sf):
    """Verdicts joined back 1:1, once both key sets are known to be equal."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    verdicts = table(spark, sf, "events").select("event_id", (F.col("value") >= 25.0).alias("keep"))
    C.unique_key(verdicts, "event_id")
    C.same_keys(e, verdicts, "event_id")
    r = e.join(verdicts, "event_id", "left").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("n_keep"), F.count_if(~F.col("keep")).alias("_lost"))
    return rounded(r.withColumn("pct_lost", 100 * F.col("_lost") / F.col("n")).drop("_lost"), "pct_lost", places=2)


@query("SELECT c_nationkey, c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 10) + 1 AS BIGINT) AS batch FROM customer")
def batch_plan(spark, sf):
    return R.batch_numbers(table(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 10)


@query("SELECT n_nationkey, lower(trim(regexp_replace('  ' || n_name || '   land ', '\\s+', ' ', 'g'))) AS label, trim(split_part(n_name || ', north', ',', 1)) AS family, CASE n_regionkey WHEN 0 THEN 'FFPE' WHEN 1 THEN 'Frozen' ELSE 'other' END AS material FROM nation")
def label_harmonise(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", F.lower(S.clean_label(F.concat(F.lit("  "), F.col("n_name"), F.lit("   land ")))).alias("label"), S.first_part(F.concat("n_name", F.lit(", north"))).alias("family"), F.when(F.col("n_regionkey") == 0, "FFPE").when(F.col("n_regionkey") == 1, "Frozen").otherwise("other").alias("material"))


@query("WITH a AS (SELECT o_orderkey, o_orderpriority AS l FROM orders), e AS (SELECT '1-URGENT' AS l, 'urgent' AS k), al AS (SELECT '2-HIGH' AS l, 'urgent' AS k) SELECT coalesce(e.k, al.k, 'none') AS matched, CASE WHEN e.k IS NOT NULL THEN 'exact' WHEN al.k IS NOT NULL THEN 'alias' ELSE 'none' END AS how, count(*) AS n FROM a LEFT JOIN e USING (l) LEFT JOIN al USING (l) GROUP BY 1, 2")
def alias_fallback(spark, sf):
    """Labels matched as they are, else by an alias; an alias that is never used stops the run."""
    known = lambda label: spark.range(1).select(F.lit(label).alias("label"), F.lit("urgent").alias("key"))
    met = R.match_labels(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", known("1-URGENT"), known("2-HIGH"))
    return met.groupBy(F.coalesce("matched", F.lit("none")).alias("matched"), "how").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE regexp_replace(p_name, ' [0-9]+$', '') <> p_brand) AS n_mismatch FROM part")
def title_consistency(spark, sf):
    return table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.regexp_replace("p_name", " [0-9]+$", "") != F.col("p_brand")).alias("n_mismatch"))


KV = """WITH c AS (SELECT unnest(['type: ' || event_type, 'user: ' || user_id || ':x', 'plain']) AS cell FROM events), kv AS (SELECT CASE WHEN instr(cell, ':') > 0 THEN trim(split_part(cell, ':', 1)) ELSE 'unlabeled' END AS key, CASE WHEN instr(cell, ':') > 0 THEN trim(substr(cell, instr(cell, ':') + 1)) ELSE cell END AS value FROM c),
 n AS (SELECT key, value, count(*) AS n FROM kv GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS r FROM n)"""


@query(KV + " SELECT key, CAST(sum(n) AS BIGINT) AS n_present, count(*) AS n_distinct, string_agg(value || ' (' || n || ')', '; ' ORDER BY r) FILTER (WHERE r <= 3) AS top FROM r GROUP BY key")
def kv_parse_profile(spark, sf):
    e = table(spark, sf, "events")
    cell = F.explode(F.array(F.concat(F.lit("type: "), F.col("event_type")), F.concat(F.lit("user: "), F.col("user_id").cast("string"), F.lit(":x")), F.lit("plain"))).alias("cell")
    return R.top_k_text(e.select(cell).select(S.key_of("cell").alias("key"), S.value_of("cell").alias("value")), "key", "value", 3)


@query("SELECT page_id, regexp_extract(url, '//([a-z0-9.]+)/', 1) AS host, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number FROM pages")
def regex_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([a-z0-9.]+)/", 1).alias("host"), F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS bigint)").alias("number"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug, CASE WHEN regexp_matches(regexp_replace(p_brand, '[^A-Za-z0-9._]', '.', 'g'), '^([A-Za-z]|\\.([^0-9]|$))') THEN regexp_replace(p_brand, '[^A-Za-z0-9._]', '.', 'g') ELSE 'X' || regexp_replace(p_brand, '[^A-Za-z0-9._]', '.', 'g') END AS name, regexp_full_match(p_brand, 'Brand#[0-9]+') AS valid, starts_with(p_type, 'S') AS starts FROM part")
def string_suite(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.slug("p_type").alias("slug"), S.syntactic_name("p_brand").alias("name"), F.col("p_brand").rlike("^Brand#[0-9]+$").alias("valid"), F.col("p_type").startswith("S").alias("starts"))


@query("SELECT event_id, md5(event_type || '|' || user_id) AS m, sha256(event_type) AS s FROM events")
def hash_suite(spark, sf):
    return table(spark, sf, "events").select("event_id", F.md5(F.concat_ws("|", "event_type", F.col("user_id").cast("string"))).alias("m"), F.sha2("event_type", 256).alias("s"))


@query("SELECT event_id, event_type AS a, user_id AS b FROM events")
def json_roundtrip(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("a"), F.col("user_id").alias("b"))).alias("j"))
    return e.select("event_id", F.from_json("j", "a string, b long").alias("x")).select("event_id", "x.a", "x.b")


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def inner_join_dims(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    r = per.join(c, "c_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.sum("t").alias("total"))
    return rounded(r, "total", places=2)


@query("SELECT lang, count(*) AS n, count(quality) AS n_labelled, count(*) FILTER (WHERE quality IS NULL) AS n_missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def left_join_missing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.count_if(F.col("quality").isNull()).alias("n_missing"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_keep(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unknown(spark, sf):
    """Documents whose id the labels don't know."""
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS only_left, count(*) FILTER (WHERE d.doc_id IS NULL) AS only_right, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS in_both FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def full_outer_keys(spark, sf):
    return C.key_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("WITH i AS (SELECT n_nationkey AS col, n_name AS a FROM nation), j AS (SELECT n_nationkey AS col, CASE WHEN n_nationkey % 7 = 3 THEN 'moved' ELSE n_name END AS b FROM nation) SELECT col, a, b FROM i JOIN j USING (col) WHERE a <> b")
def positional_check(spark, sf):
    n = table(spark, sf, "nation")
    moved = n.select(F.col("n_nationkey").alias("col"), F.when(F.col("n_nationkey") % 7 == 3, "moved").otherwise(F.col("n_name")).alias("b"))
    return n.select(F.col("n_nationkey").alias("col"), F.col("n_name").alias("a")).join(moved, "col").filter("a <> b")


@query("SELECT 'customer' AS source, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_sources(spark, sf):
    part = lambda t, c: table(spark, sf, t).groupBy(F.col(c).alias("nation")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("source"), "nation", "n")
    return part("customer", "c_nationkey").unionByName(part("supplier", "s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def distinct_keep_first(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("WITH o AS (SELECT o_orderkey AS k, 'old' AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, 'new' AS v FROM orders WHERE o_orderkey % 2 = 0) SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n")
def upsert_keep_last(spark, sf):
    k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return R.upsert(k.filter("k % 3 <> 0").withColumn("v", F.lit("old")), k.filter("k % 2 = 0").withColumn("v", F.lit("new")), ["k"])


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def pivot_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS size, max(n) OVER (PARTITION BY c_nationkey) AS m FROM n) SELECT c_nationkey, min(c_mktsegment) AS c_mktsegment, max(n) AS n, CAST(max(size) AS BIGINT) AS size, count(*) > 1 AS tie FROM t WHERE n = m GROUP BY 1")
def mode_per_group(spark, sf):
    return R.mode_per(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment")


@query("WITH n AS (SELECT l_shipdate AS d, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(d AS VARCHAR) AS d, n FROM n ORDER BY n DESC, d LIMIT 10")
def topk_values(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "d").limit(10).select(F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("d"), "n")


@query("SELECT l_returnflag, printf('%.3f (%.3f-%.3f)', avg(l_discount), quantile_cont(l_discount, 0.025), quantile_cont(l_discount, 0.975)) AS text FROM lineitem GROUP BY 1")
def interval_text(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("v"), F.percentile("l_discount", 0.025).alias("lo"), F.percentile("l_discount", 0.975).alias("hi"))
    return a.select("l_returnflag", S.interval_text("v", "lo", "hi").alias("text"))


@query("""WITH t AS (SELECT l_returnflag, l_linestatus, printf('%.3f (%.3f-%.3f)', avg(l_discount), quantile_cont(l_discount, 0.025), quantile_cont(l_discount, 0.975)) AS text FROM lineitem GROUP BY 1, 2)
 SELECT l_returnflag, coalesce(max(text) FILTER (WHERE l_linestatus = 'F'), '') AS "F", coalesce(max(text) FILTER (WHERE l_linestatus = 'O'), '') AS "O" FROM t GROUP BY 1""")
def report_pivot(spark, sf):
    """Values with intervals as a table of text: a row per flag, a column per status."""
    a = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("v"), F.percentile("l_discount", 0.025).alias("lo"), F.percentile("l_discount", 0.975).alias("hi"))
    return R.report_pivot(a.withColumn("text", S.interval_text("v", "lo", "hi")), "l_returnflag", "l_linestatus", ["F", "O"], "text")


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) + 0.0 AS price FROM lineitem GROUP BY 1")
def weighted_avg_price(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_returnflag").agg((F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity")).alias("price"))
    return rounded(r, "price", places=4)


@query("SELECT l_linestatus, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1")
def distinct_per_group(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_suppkey").alias("n_suppliers"))


@query("SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) + 0.0 AS r FROM lineitem GROUP BY 1")
def corr_price_qty(spark, sf):
    return rounded(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.corr("l_extendedprice", "l_quantity").alias("r")), "r")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, unnest(['size', 'price']) AS measure, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS value FROM part")
def wide_unpivot(spark, sf):
    wide = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return unpivot_wide(wide, "id", ("measure", "value"))


@query("WITH a AS (SELECT doc_id, md5(text) AS m FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE md5(text) END AS m FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.m AS \"old\", b.m AS \"new\", CASE WHEN a.m IS NULL THEN 'added' WHEN b.m IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.m IS DISTINCT FROM b.m")
def manifest_reconcile(spark, sf):
    """Two made-up states of one manifest over all documents: rows are lost, added and changed by rule."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("m"))
    return reconcile(d.filter("doc_id % 11 <> 0"), d.filter("doc_id % 7 <> 0").withColumn("m", F.when(F.col("doc_id") % 13 == 0, "x").otherwise(F.col("m"))), "doc_id", "m")


@query("""SELECT 'unique_key' AS "check", count(*) - count(DISTINCT doc_id) AS n_bad FROM documents UNION ALL SELECT 'no_missing', count(*) FILTER (WHERE text IS NULL) FROM documents UNION ALL SELECT 'closed_domain', count(*) FILTER (WHERE lang NOT IN ('en', 'de')) FROM documents
 UNION ALL SELECT 'finite', count(*) FILTER (WHERE NOT isfinite(value)) FROM events UNION ALL SELECT 'dense_index', max(o_orderkey) - min(o_orderkey) + 1 - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'labels_known', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def contracts_report(spark, sf):
    d, e, o, lab = (table(spark, sf, t) for t in ("documents", "events", "orders", "labels"))
    v = F.col("value")
    checks = {
        "unique_key": d.agg((F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("n_bad")),
        "no_missing": d.agg(F.count_if(F.col("text").isNull()).alias("n_bad")),
        "closed_domain": d.agg(F.count_if(~F.col("lang").isin("en", "de")).alias("n_bad")),
        "finite": e.agg(F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("n_bad")),
        "dense_index": o.agg((F.max("o_orderkey") - F.min("o_orderkey") + 1 - F.countDistinct("o_orderkey")).alias("n_bad")),
        "labels_known": lab.join(d.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_bad")),
    }
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("check"), "n_bad")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def group_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) SELECT round(sum(c_acctbal) FILTER (WHERE r <= 100) / nullif(sum(c_acctbal), 0), 6) + 0.0 AS share FROM r")
def share_of_total(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).agg(F.sum("c_acctbal").alias("t")).withColumn("one", F.lit(1))
    return rounded(c.agg(F.sum("c_acctbal").alias("all")).withColumn("one", F.lit(1)).join(top, "one").select(S.ratio("t", "all").alias("share")), "share")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 7")
def lowest_n(spark, sf):
    return table(spark, sf, "supplier").orderBy("s_acctbal", "s_suppkey").limit(7).select("s_suppkey", "s_acctbal")


@query()
def map_per_group(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("o_orderpriority").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n")))).alias("counts"))


@query("SELECT event_id, abs(value - 50) AS a, CAST(sign(value - 50) AS DOUBLE) AS s, round(ln(value + 1000), 6) + 0.0 AS l, round(exp(-abs(value) / 100), 6) + 0.0 AS e, CASE WHEN value IS NOT NULL THEN greatest(least(value, 60.0), 40.0) END AS c FROM events")
def scalar_math_suite(spark, sf):
    v = F.col("value")
    r = table(spark, sf, "events").select("event_id", F.abs(v - 50).alias("a"), F.signum(v - 50).alias("s"), F.log(v + 1000).alias("l"), F.exp(-F.abs(v) / 100).alias("e"), S.clip("value", 40.0, 60.0).alias("c"))
    return rounded(r, "l", "e")


@query("SELECT doc_id, quality = 1 AS flag FROM labels")
def bool_text(spark, sf):
    text = F.when(F.col("quality") == 1, "True").otherwise("False")
    return table(spark, sf, "labels").select("doc_id", S.text_bool(text).alias("flag"))


@query("SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, 'Brand#', '') AS INT) AS number, TRY_CAST(p_name AS INT) AS none FROM part")
def safe_cast(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_brand", "Brand#", "").try_cast("int").alias("number"), F.col("p_name").try_cast("int").alias("none"))


@query("SELECT CAST(least(floor(l_discount / 0.1001 * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf):
    return table(spark, sf, "lineitem").groupBy(S.bin_index(F.col("l_discount") / 0.1001, 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, 'https://example.org/' || substr('GSE' || (1000 + n_nationkey), 1, 5) || 'nnn/' || n_name AS url FROM nation")
def url_build(spark, sf):
    series = F.concat(F.lit("GSE"), (1000 + F.col("n_nationkey")).cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("https://example.org/"), F.substring(series, 1, 5), F.lit("nnn/"), F.col("n_name")).alias("url"))


@query("SELECT segment, count(*) AS n_common FROM (SELECT DISTINCT c_mktsegment AS segment, c_custkey AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate < DATE '1998-04-01' INTERSECT SELECT DISTINCT c_mktsegment, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1998-04-01') GROUP BY 1")
def cohort_disjoint(spark, sf):
    """Customers of an early and a late cohort, and how many stand in both; contracts.disjoint() refuses that."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"), (F.col("o_orderdate").cast("date") < F.lit("1998-04-01").cast("date")).alias("early"))
    return o.filter("early").select("segment", "k").intersect(o.filter("not early").select("segment", "k")).groupBy("segment").agg(F.count(F.lit(1)).alias("n_common"))


@query("SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS INT) AS rank FROM orders GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 5")
def largest_k(spark, sf):
    """The largest groups with ties at the cut-off, which a caller can refuse."""
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    fifth = n.orderBy(F.desc("n")).limit(5).agg(F.min("n").alias("least")).withColumn("one", F.lit(1))
    top = n.withColumn("one", F.lit(1)).join(F.broadcast(fifth), "one").filter("n >= least").select("o_custkey", "n")
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc("n"))))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1")
def largest_language(spark, sf):
    """The largest group, which must be one: a tie at the cut-off stops the run."""
    return R.largest_groups(table(spark, sf, "documents"), "lang", 1)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def work_list(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return remaining_work(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (3, 4) GROUP BY 1")
def membership_filter(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(3, 4)).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS kind FROM orders")
def case_precedence(spark, sf):
    kind = F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderstatus") == "F", "done").otherwise("other")
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def single_row_lookup(spark, sf):
    return C.single_row(table(spark, sf, "nation"), F.col("n_nationkey") == 7).select("n_nationkey", "n_name")


@query("""WITH f AS (SELECT unnest([10, 20]) AS n_features, unnest([0, 1]) AS i), t AS (SELECT unnest([100, 500]) AS trees, unnest([0, 1]) AS j)
 SELECT 's00' || (2 * i + j) AS setting, CAST(n_features AS INT) AS n_features, '{"trees": ' || trees || '}' AS model_params FROM f, t""")
def settings_grid(spark, sf):
    return R.settings_grid(spark, [10, 20], [("trees", [100, 500])])


@query("WITH m AS (SELECT unnest(['forest', 'centroid']) AS model), l AS (SELECT unnest(['class', 'family']) AS level), k AS (SELECT unnest(['accuracy', 'ece']) AS metric) SELECT model, level, metric FROM m, l, k WHERE (level = 'class' OR model = 'forest') AND (model <> 'centroid' OR metric = 'accuracy')")
def metric_suppression(spark, sf):
    each = lambda *v: F.explode(F.array(*map(F.lit, v)))
    rows = spark.range(1).select(each("forest", "centroid").alias("model")).select("model", each("class", "family").alias("level")).select("model", "level", each("accuracy", "ece").alias("metric"))
    return rows.filter("(level = 'class' or model = 'forest') and (model <> 'centroid' or metric = 'accuracy')")


@query("SELECT d.lang, round((sum(rk) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) + 0.0 AS auc FROM (SELECT lang, (rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0) * quality AS rk, sum(quality) OVER (PARTITION BY lang) AS n1, sum(1 - quality) OVER (PARTITION BY lang) AS n0 FROM documents JOIN labels USING (doc_id)) d GROUP BY lang, n1, n0 HAVING n1 * n0 > 0")
def auc_by_lang(spark, sf):
    from ..operators.metrics import auc

    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rounded(auc(d, "n_chars", "quality", "lang").filter("auc is not null").select("lang", "auc"), "auc")


@query("SELECT o_orderkey, CAST(('0x' || substr(md5('9|' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1 AS masked FROM orders")
def hashed_draws(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (S.uniform(9, "o_orderkey") < 0.1).alias("masked"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf):
    """An addition: tumbling windows, the same plan for a stream and a table."""
    from ..streaming.incremental import windowed_counts

    w = windowed_counts(table(spark, sf, "events"))
    return rounded(w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total"), "total", places=4)


@query("SELECT event_type, user_id, count(*) AS n, min(rank) AS best_rank FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) GROUP BY 1, 2")
def inverse_rank(spark, sf):
    """The best rank that each user's events have among all events of their type."""
    ranked = R.inverse_rank(table(spark, sf, "events").select("event_type", "event_id", "user_id", "value"), ["event_type"], "value", "event_id")
    return ranked.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best_rank"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def log_times(spark, sf):
    return table(spark, sf, "events").select("event_id", S.log_time("ts").alias("at"))


CRC = "WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"


@query(CRC + " SELECT p_partkey, substr(sha1(p_name), 1, 10) AS name, xor(list_reduce(list_concat([4294967295], list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(t[CAST(xor(a, b) & 255 AS INT) + 1], a >> 8)), 4294967295) AS crc FROM part, t")
def content_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.sha1_prefix("p_name").alias("name"), F.crc32("p_name").alias("crc"))


@query("SELECT o_orderkey, round(pow(0.001, 1 - CAST(('0x' || substr(md5('17|0|' || o_orderkey), 1, 8)) AS BIGINT) / 4294967296.0), 9) + 0.0 AS share FROM orders")
def mask_shares(spark, sf):
    from ..operators.splits import mask_shares as shares

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return rounded(shares(o).withColumnRenamed("sample_id", "o_orderkey"), "share", places=9)


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'af' WHEN 1 THEN 'am' WHEN 2 THEN 'as' WHEN 3 THEN 'eu' WHEN 4 THEN 'me' END AS code, CAST(regexp_replace(CAST(n_nationkey AS VARCHAR), 'x', '') AS INT) AS number FROM nation")
def strict_mapping(spark, sf):
    """A closed mapping and a cast that must both succeed: an unknown value stops the run."""
    code = F.get(F.array(*map(F.lit, ("af", "am", "as", "eu", "me"))), F.col("n_regionkey").cast("int"))
    text = F.col("n_nationkey").cast("string")
    return table(spark, sf, "nation").select("n_nationkey", S.must("n_regionkey", code, "unknown region").alias("code"), S.must("n_nationkey", text.try_cast("int"), "not a number").alias("number"))
