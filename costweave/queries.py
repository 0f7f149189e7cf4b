"""Registry of the library's queries: name -> function(spark, sf_dir), and the oracle SQL by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave import streaming
from costweave.functions import text
from costweave.operators import abbreviations, analytics, build, cascade, catalogue, codes, context, fuzzy, fuzzy_keywords as nearly, fuzzy_top, gate, hierarchy, lifecycle, masters, matching, profiles, review, rules, sections, specs, units, updates, vector_index
from costweave.session import shared_dir, spread, stage, table
from costweave.sources import sinks, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with the SQL that must give the same rows (the views are in front of it)."""

    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = views.SQL + sql
        return function

    return add


@query("SELECT sec_code, count(*) AS item_count, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount FROM line_items GROUP BY sec_code")
def sec_distribution(spark, sf_dir):
    return analytics.by_code(views.line_items(spark, sf_dir))


@query("SELECT method, count(*) AS item_count, CAST(sum(confidence) AS DOUBLE) / count(confidence) AS avg_confidence FROM facts GROUP BY method")
def classification_breakdown(spark, sf_dir):
    return analytics.by_method(views.facts(spark, sf_dir))


@query("SELECT file_id, line_number, confidence, sec_code FROM line_items WHERE confidence < 80 OR sec_code IS NULL")
def needs_review_items(spark, sf_dir):
    return analytics.needs_review(views.line_items(spark, sf_dir)).select("file_id", "line_number", "confidence", "sec_code")


@query("""SELECT CASE WHEN confidence < 80 THEN 'low' WHEN confidence < 95 THEN 'medium' ELSE 'high' END AS band,
  count(*) AS item_count, min(confidence) AS lowest, max(confidence) AS highest FROM facts GROUP BY 1""")
def confidence_band_counts(spark, sf_dir):
    return analytics.confidence_bands(views.facts(spark, sf_dir))


@query("SELECT CAST(least((confidence // 10) * 10, 90) AS INTEGER) AS range_from, count(*) AS item_count FROM facts GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return analytics.confidence_histogram(views.facts(spark, sf_dir))


@query(""", f AS (SELECT project_id, count(*) AS file_count FROM files GROUP BY 1),
i AS (SELECT project_id, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS s FROM files JOIN facts USING (file_id) GROUP BY 1)
SELECT p.project_id, project_name, region, coalesce(file_count, 0) AS file_count, coalesce(n, 0) AS item_count, coalesce(s, 0.0) AS total_amount
FROM projects p LEFT JOIN f USING (project_id) LEFT JOIN i USING (project_id)""")
def project_summary_view(spark, sf_dir):
    return analytics.project_summary(views.projects(spark, sf_dir), views.files(spark, sf_dir), views.facts(spark, sf_dir))


@query("""SELECT i.file_id, line_number, description, amount, status, project_name, region
FROM line_items i LEFT JOIN files f ON i.file_id = f.file_id LEFT JOIN projects p ON f.project_id = p.project_id""")
def line_items_detailed_view(spark, sf_dir):
    rows = views.line_items(spark, sf_dir).join(views.files(spark, sf_dir), "file_id", "left").join(views.projects(spark, sf_dir), "project_id", "left")
    return rows.select("file_id", "line_number", "description", "amount", "status", "project_name", "region")


@query(""", s AS (SELECT sec_code, list_sort(list(unit_price)) AS v FROM line_items WHERE unit_price > 0 GROUP BY 1)
SELECT sec_code, len(v) AS n_prices, v[1] AS min_price, v[len(v)] AS max_price,
  CASE WHEN len(v) >= 4 THEN v[len(v) // 4 + 1] END AS p25, CASE WHEN len(v) >= 4 THEN v[3 * len(v) // 4 + 1] END AS p75 FROM s""")
def price_distribution(spark, sf_dir):
    return analytics.price_distribution(views.line_items(spark, sf_dir))


@query("SELECT DISTINCT region FROM projects")
def available_regions(spark, sf_dir):
    return analytics.regions(views.projects(spark, sf_dir))


@query("""SELECT event_type AS action, count(*) AS n, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50) AS n_large,
  max(value) AS max_value FROM events GROUP BY 1""")
def training_log_stats(spark, sf_dir):
    return analytics.log_stats(table(spark, sf_dir, "events"))


_FREQUENCY = ", g AS (SELECT description, unit, count(*) AS frequency, count(DISTINCT file_id) AS n_files FROM line_items GROUP BY 1, 2) "


@query(_FREQUENCY + "SELECT * FROM g WHERE frequency >= 2")
def aggregate_descriptions(spark, sf_dir):
    return catalogue.aggregate(views.line_items(spark, sf_dir), 2)


@query(_FREQUENCY + """SELECT CASE WHEN frequency <= 1 THEN '1' WHEN frequency <= 5 THEN '2-5' WHEN frequency <= 10 THEN '6-10' WHEN frequency <= 50 THEN '11-50' ELSE '50+' END AS bucket,
  count(*) AS n_items, CAST(sum(frequency) AS BIGINT) AS n_rows FROM g GROUP BY 1""")
def frequency_buckets(spark, sf_dir):
    return analytics.frequency_buckets(catalogue.aggregate(views.line_items(spark, sf_dir)))


@query(_FREQUENCY + """, c AS (SELECT *, sum(frequency) OVER (ORDER BY frequency DESC, description, unit ROWS UNBOUNDED PRECEDING) - frequency AS before, sum(frequency) OVER () AS whole FROM g)
SELECT description, unit, frequency, before * 100 < whole * 80 AS is_top FROM c""")
def pareto_top_items(spark, sf_dir):
    return catalogue.pareto(catalogue.aggregate(views.line_items(spark, sf_dir)))


@query("SELECT description, min(master_id) AS master_id FROM catalogue GROUP BY 1")
def first_wins_dedup(spark, sf_dir):
    return catalogue.first_of(views.catalogue(spark, sf_dir), ["description"], ["master_id"]).select("description", "master_id")


@query("SELECT description, max(master_id) AS master_id FROM catalogue GROUP BY 1")
def last_wins_dedup(spark, sf_dir):
    return catalogue.first_of(views.catalogue(spark, sf_dir), ["description"], [F.desc("master_id")]).select("description", "master_id")


_VERSION = ", v AS (SELECT file_id, project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY uploaded_at, file_id) AS INTEGER) AS version FROM files) "


@query(_VERSION + "SELECT * FROM v")
def version_numbers(spark, sf_dir):
    return catalogue.versions(views.files(spark, sf_dir)).select("file_id", "project_id", "version")


_DIFFS = _VERSION + """, r AS (SELECT project_id, version, lower(trim(description)) AS item, quantity, unit_price AS price,
  row_number() OVER (PARTITION BY project_id, version, lower(trim(description)) ORDER BY line_number DESC, master_id DESC, amount DESC) AS k FROM line_items JOIN v USING (file_id) WHERE trim(description) <> ''),
n AS (SELECT project_id, max(version) AS newest FROM v GROUP BY 1),
a AS (SELECT project_id, version + 1 AS version, item, quantity, price FROM r JOIN n USING (project_id) WHERE k = 1 AND version < newest), b AS (SELECT * FROM r WHERE k = 1 AND version > 1),
d AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.version, b.version) AS version, coalesce(a.item, b.item) AS item,
  a.quantity AS quantity_old, a.price AS price_old, b.quantity AS quantity_new, b.price AS price_new,
  CASE WHEN a.item IS NULL THEN 'added' WHEN b.item IS NULL THEN 'removed'
    WHEN abs(b.quantity - a.quantity) > abs(a.quantity) * CAST(0.01 AS DOUBLE) OR abs(b.price - a.price) > abs(a.price) * CAST(0.05 AS DOUBLE) THEN 'modified' ELSE 'unchanged' END AS status
  FROM a FULL OUTER JOIN b ON a.project_id = b.project_id AND a.version = b.version AND a.item = b.item) """


@query(_DIFFS + "SELECT * FROM d")
def version_diff_items(spark, sf_dir):
    return catalogue.version_diffs(views.line_items(spark, sf_dir), views.files(spark, sf_dir))


@query(_DIFFS + "SELECT project_id, version, status, count(*) AS n_items FROM d GROUP BY 1, 2, 3")
def version_diff_summary(spark, sf_dir):
    return version_diff_items(spark, sf_dir).groupBy("project_id", "version", "status").agg(F.count("*").alias("n_items"))


@query(""", n AS (SELECT master_id, sec_code, CAST(row_number() OVER (PARTITION BY sec_code ORDER BY master_id) AS VARCHAR) AS n FROM (SELECT DISTINCT master_id, sec_code FROM catalogue))
SELECT master_id, sec_code || '-' || CASE WHEN length(n) < 4 THEN lpad(n, 4, '0') ELSE n END AS work_code FROM n""")
def next_work_code(spark, sf_dir):
    return catalogue.next_codes(views.catalogue(spark, sf_dir), "sec_code", "master_id").select("master_id", "work_code")


@query(", k AS (SELECT lower(trim(description)) AS key, max(master_id) AS matched_id FROM catalogue GROUP BY 1) SELECT file_id, line_number, matched_id FROM line_items LEFT JOIN k ON lower(trim(description)) = key")
def exact_match_join(spark, sf_dir):
    return matching.exact(views.line_items(spark, sf_dir), views.catalogue(spark, sf_dir)).select("file_id", "line_number", "matched_id")


_WORDS = "list_distinct(string_split_regex(lower(trim({})), ' +'))"
_A, _B = _WORDS.format("description"), _WORDS.format("unit || ' ' || sec_code || ' ' || description")


@query(f"SELECT master_id, CAST(len(list_intersect({_A}, {_B})) AS DOUBLE) / greatest(len({_A}), len({_B})) AS similarity FROM catalogue")
def token_overlap_similarity(spark, sf_dir):
    rows = views.catalogue(spark, sf_dir).withColumn("other", F.concat_ws(" ", "unit", "sec_code", "description"))
    return rows.select("master_id", matching.overlap("description", "other").alias("similarity"))


@query("SELECT master_id, levenshtein(lower(description), lower(unit)) AS distance FROM catalogue")
def edit_distance(spark, sf_dir):
    return views.catalogue(spark, sf_dir).select("master_id", F.levenshtein(F.lower("description"), F.lower("unit")).cast("long").alias("distance"))


@query("SELECT master_id, description FROM catalogue WHERE sec_code LIKE 'Brand#1%'")
def glob_code_search(spark, sf_dir):
    return views.catalogue(spark, sf_dir).where(F.col("sec_code").like("Brand#1*".replace("*", "%"))).select("master_id", "description")


@query("SELECT master_id, description FROM catalogue WHERE description ILIKE '%RED%'")
def contains_search(spark, sf_dir):
    return views.catalogue(spark, sf_dir).where(F.col("description").ilike("%RED%")).select("master_id", "description")


_RAW = """, raw AS (SELECT file_id, line_number, CASE WHEN file_id % 17 = 0 THEN ' nan ' ELSE description END AS description,
  CASE WHEN file_id % 13 = 0 THEN 0.0 WHEN file_id % 11 = 0 THEN -quantity ELSE quantity END AS quantity, unit_price, amount FROM line_items),
c AS (SELECT file_id, line_number, trim(description) AS description, quantity * unit_price AS amount,
  concat_ws('; ', CASE WHEN quantity < 0 THEN 'Negative quantity' END, CASE WHEN quantity = 0 THEN 'Zero quantity' END, CASE WHEN unit_price < 0 THEN 'Negative price' END,
    CASE WHEN amount <> 0 AND abs(amount - quantity * unit_price) > CAST(0.01 AS DOUBLE) * abs(amount) THEN 'Amount mismatch' END) AS issues FROM raw WHERE lower(trim(description)) NOT IN ('', 'nan')) """


def _raw(spark, sf_dir):
    """Line items with defects: the given tables have none."""
    f = F.col("file_id")
    bad = F.when(f % 13 == 0, 0.0).when(f % 11 == 0, -F.col("quantity")).otherwise(F.col("quantity"))
    return views.line_items(spark, sf_dir).withColumns({"description": F.when(f % 17 == 0, " nan ").otherwise(F.col("description")), "quantity": bad})


@query(_RAW + "SELECT * FROM c")
def clean_line_items(spark, sf_dir):
    return matching.clean(_raw(spark, sf_dir)).select("file_id", "line_number", "description", "amount", "issues")


@query(_RAW + "SELECT issues, count(*) AS n FROM c GROUP BY 1")
def validation_issue_counts(spark, sf_dir):
    return matching.clean(_raw(spark, sf_dir)).groupBy("issues").agg(F.count("*").alias("n"))


# Tiered matching. The catalogue knows the descriptions of some brands only; synonyms are their words in reverse order.
_METRICS = """, tiers AS (SELECT * FROM (VALUES (0, 'exact'), (1, 'synonym'), (2, 'token')) AS v(ord, stage)),
r AS (SELECT ord, tiers.stage, count(m.stage) AS resolved FROM tiers LEFT JOIN m ON m.stage = tiers.stage GROUP BY 1, 2),
i AS (SELECT stage, resolved, CAST((SELECT count(*) FROM m) - coalesce(sum(resolved) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS items_in FROM r)
SELECT stage, items_in, resolved, CASE WHEN items_in > 0 THEN resolved / CAST(items_in AS DOUBLE) ELSE 0.0 END AS hit_rate FROM i"""


# Items altered by a rule, against the whole catalogue and all its synonyms; what no tier knows are descriptions with a word of their own.
_CASCADE = """, items AS (SELECT file_id, line_number, CASE WHEN line_number = 7 THEN description || ' bespoke' WHEN line_number % 3 = 1 THEN description || ' type'
  WHEN line_number % 3 = 2 THEN split_part(description, ' ', 2) || ' ' || split_part(description, ' ', 1) ELSE description END AS description FROM line_items),
e AS (SELECT lower(trim(description)) AS k, max(master_id) AS id FROM catalogue GROUP BY 1),
s AS (SELECT lower(trim(description || ' type')) AS k, max(master_id) AS id FROM catalogue GROUP BY 1),
t AS (SELECT array_to_string(list_sort(list_distinct(string_split_regex(lower(trim(description)), ' +'))), ' ') AS k, max(master_id) AS id FROM catalogue GROUP BY 1),
m AS (SELECT file_id, line_number, i.description, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN s.id IS NOT NULL THEN 'synonym' WHEN t.id IS NOT NULL THEN 'token' ELSE 'new' END AS stage, coalesce(e.id, s.id, t.id) AS matched_id
  FROM items i LEFT JOIN e ON lower(trim(i.description)) = e.k LEFT JOIN s ON lower(trim(i.description)) = s.k
  LEFT JOIN t ON array_to_string(list_sort(list_distinct(string_split_regex(lower(trim(i.description)), ' +'))), ' ') = t.k) """


def _as_altered():
    line, words = F.col("line_number"), F.split("description", " ")
    text = F.when(line == 7, F.concat("description", F.lit(" bespoke"))).when(line % 3 == 1, F.concat("description", F.lit(" type")))
    return text.when(line % 3 == 2, F.concat_ws(" ", words[1], words[0])).otherwise(F.col("description"))


def _altered(spark, sf_dir):
    """Line items whose descriptions are written as a synonym, in reverse, with a word no catalogue has, or as they are."""
    return views.line_items(spark, sf_dir).select("file_id", "line_number", _as_altered().alias("description"))


def _cascaded(spark, sf_dir):
    masters = views.catalogue(spark, sf_dir)
    return cascade.cascade(_altered(spark, sf_dir), masters, masters.select("master_id", F.concat("description", F.lit(" type")).alias("synonym")))


@query(_CASCADE + "SELECT file_id, line_number, stage, matched_id FROM m")
def tier_cascade(spark, sf_dir):
    return _cascaded(spark, sf_dir).select("file_id", "line_number", "stage", "matched_id")


@query(_CASCADE + "SELECT file_id, line_number, matched_id FROM m WHERE stage = 'synonym'")
def synonym_match_join(spark, sf_dir):
    return _cascaded(spark, sf_dir).where("stage = 'synonym'").select("file_id", "line_number", "matched_id")


@query(_CASCADE + _METRICS)
def funnel_stage_metrics(spark, sf_dir):
    return cascade.stage_metrics(_cascaded(spark, sf_dir))


@query(_CASCADE + "SELECT file_id, line_number, description FROM items WHERE lower(trim(description)) NOT IN (SELECT k FROM e)")
def unmatched_items(spark, sf_dir):
    known = matching.lookup(views.catalogue(spark, sf_dir))
    return _altered(spark, sf_dir).join(known, F.lower(F.trim("description")) == F.col("key"), "left_anti").select("file_id", "line_number", "description")


@query("""SELECT file_id, line_number, 'PRJ.' || project_id || '-TEMP-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS temp_code
FROM (SELECT file_id, line_number, project_id, row_number() OVER (PARTITION BY project_id ORDER BY file_id, line_number) AS k FROM line_items JOIN files USING (file_id))""")
def temp_codes(spark, sf_dir):
    rows = views.line_items(spark, sf_dir).join(views.files(spark, sf_dir).select("file_id", "project_id"), "file_id")
    return cascade.temp_codes(rows, "project_id", "file_id", ["line_number"]).select("file_id", "line_number", "temp_code")


@query(_FREQUENCY + """, r AS (SELECT *, row_number() OVER (PARTITION BY split_part(description, ' ', 1), unit ORDER BY length(trim(description)) < 3, frequency DESC, length(description) DESC, description) AS k,
  CAST(sum(frequency) OVER (PARTITION BY split_part(description, ' ', 1), unit) AS BIGINT) AS total_frequency FROM g)
SELECT split_part(description, ' ', 1) AS cluster, unit, description, frequency, total_frequency FROM r WHERE k = 1""")
def elect_canonical(spark, sf_dir):
    rows = catalogue.aggregate(views.line_items(spark, sf_dir)).withColumn("cluster", F.split("description", " ")[0])
    return cascade.elect_canonical(rows, ["cluster", "unit"]).select("cluster", "unit", "description", "frequency", "total_frequency")


@query("""SELECT file_id, line_number, array_to_string(list_sort(list(other)), '|') AS neighbours FROM (SELECT a.file_id, a.line_number, a.k, b.line_number || ':' || b.description AS other FROM
  (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number, master_id, amount) AS k FROM line_items) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number, master_id, amount) AS k FROM line_items) b ON a.file_id = b.file_id AND b.k - a.k BETWEEN -2 AND 2 AND a.k <> b.k) GROUP BY 1, 2, k""")
def neighbors_window(spark, sf_dir):
    return hierarchy.neighbours(views.line_items(spark, sf_dir), "file_id", ["line_number", "master_id", "amount"]).select("file_id", "line_number", F.array_join("neighbours", "|").alias("neighbours"))


_PRICES = """, p AS (SELECT unit_price AS x FROM facts WHERE unit_price > 0), e AS (SELECT min(x) AS low, max(x) AS high, count(*) AS n FROM p),
edges AS (SELECT CAST(i AS INTEGER) AS bucket, low + i * ((high - low) / 10) AS bucket_from, low + (i + 1) * ((high - low) / 10) AS bucket_to, n FROM e, range(10) AS r(i)) """


@query(_PRICES + """SELECT bucket, bucket_from, bucket_to, count(x) AS n_prices FROM edges LEFT JOIN p ON x >= bucket_from AND (x < bucket_to OR bucket = 9) GROUP BY 1, 2, 3""")
def price_histogram(spark, sf_dir):
    return analytics.price_histogram(views.facts(spark, sf_dir), 10)


@query("""SELECT i.file_id, line_number, unit_price, recorded_at, project_name, region FROM facts i JOIN files f ON i.file_id = f.file_id JOIN projects p ON f.project_id = p.project_id
WHERE region = 'ASIA' AND recorded_at >= TIMESTAMP '1997-01-01' ORDER BY recorded_at DESC, i.file_id, line_number, unit_price LIMIT 50 OFFSET 100""")
def price_sources_page(spark, sf_dir):
    prices = views.price_history(spark, sf_dir).where((F.col("region") == "ASIA") & (F.col("recorded_at") >= F.lit("1997-01-01").cast("timestamp")))
    page = prices.orderBy(F.desc("recorded_at"), "file_id", "line_number", "unit_price").offset(100).limit(50)
    return page.select("file_id", "line_number", "unit_price", "recorded_at", "project_name", "region")


@query("""SELECT region, project_type, count(*) AS n_prices, min(unit_price) AS min_price, max(unit_price) AS max_price, quantile_cont(unit_price, 0.5) AS median_price
FROM facts JOIN files USING (file_id) JOIN projects USING (project_id) WHERE unit_price > 0 AND recorded_at >= TIMESTAMP '1996-01-01' AND recorded_at <= TIMESTAMP '1999-12-31' GROUP BY 1, 2""")
def price_distribution_filtered(spark, sf_dir):
    return analytics.prices_by(views.price_history(spark, sf_dir), ["region", "project_type"], "1996-01-01", "1999-12-31")


_TREE = """, links AS (SELECT r_name AS code, NULL AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT n_name || '/' || c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) """


@query(_TREE + """SELECT code, parent, CAST(CASE WHEN parent IS NULL THEN 1 WHEN strpos(code, '/') > 0 THEN 3 ELSE 2 END AS INTEGER) AS level,
  CASE WHEN parent IS NULL THEN code WHEN strpos(code, '/') > 0 THEN (SELECT any_value(u.parent) FROM links u WHERE u.code = links.parent) || ' > ' || parent || ' > ' || code ELSE parent || ' > ' || code END AS path FROM links""")
def sec_tree_recursive(spark, sf_dir):
    return hierarchy.tree(views.code_links(spark, sf_dir))


@query("SELECT vec_id, label, n_id FROM (SELECT a.vec_id, a.label, b.vec_id AS n_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE k <= 5")
def vector_topk(spark, sf_dir):
    return hierarchy.vector_topk(table(spark, sf_dir, "embeddings"), 5).select("vec_id", "label", "n_id")


@query("SELECT vec_id, label, n_id FROM (SELECT a.vec_id, a.label, b.vec_id AS n_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE k <= 5")
def vector_topk_all(spark, sf_dir):
    return hierarchy.vector_topk(table(spark, sf_dir, "embeddings"), 5, in_label=False).select("vec_id", "label", "n_id")


# Work-item states and quality of rows.
@query("""SELECT f.status, count(*) AS n_items, count(*) FILTER (WHERE confidence >= 90) AS green, count(*) FILTER (WHERE confidence >= 60 AND confidence < 90) AS yellow,
  count(*) FILTER (WHERE confidence < 60) AS red FROM facts JOIN files f USING (file_id) GROUP BY 1""")
def work_item_stats(spark, sf_dir):
    return analytics.gate_counts(views.facts(spark, sf_dir).join(views.files(spark, sf_dir).select("file_id", "status"), "file_id"), "status")


@query("""SELECT (SELECT count(*) FROM projects) AS n_projects, (SELECT count(*) FROM files) AS n_files, count(*) AS n_items, count(*) FILTER (WHERE confidence < 80 OR sec_code IS NULL) AS n_review,
  count(DISTINCT sec_code) AS n_codes, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount FROM line_items""")
def dashboard_stats(spark, sf_dir):
    return analytics.dashboard(views.projects(spark, sf_dir), views.files(spark, sf_dir), views.line_items(spark, sf_dir))


@query("""SELECT project_id, count(*) AS n_items, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount, CAST(sum(confidence) AS DOUBLE) / count(confidence) AS avg_confidence,
  count(*) FILTER (WHERE method = 'A') AS n_auto, count(*) FILTER (WHERE method = 'R') AS n_manual FROM facts JOIN files USING (file_id) GROUP BY 1""")
def project_stats(spark, sf_dir):
    return analytics.project_stats(views.facts(spark, sf_dir).join(views.files(spark, sf_dir).select("file_id", "project_id"), "file_id"))


@query("SELECT sec_code, count(*) AS n_masters, count(DISTINCT description) AS n_descriptions, min(ref_price) AS lowest, max(ref_price) AS highest FROM catalogue GROUP BY 1")
def master_stats(spark, sf_dir):
    return analytics.master_stats(views.catalogue(spark, sf_dir))


@query("SELECT master_id, description FROM catalogue WHERE starts_with(sec_code, 'Brand#2')")
def prefix_search(spark, sf_dir):
    return views.catalogue(spark, sf_dir).where(F.col("sec_code").startswith("Brand#2")).select("master_id", "description")


_FOLD = f"regexp_replace(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '{text.MARKS}', '', 'g')"


@query(f"SELECT doc_id, md5({_FOLD}) AS folded_md5 FROM documents WHERE text IS NOT NULL")
def fold_diacritics(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(text.fold("text")).alias("folded_md5"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({_FOLD}, '(^|[^a-z0-9])(eeai|fur|e)($|[^a-z0-9])')")
def fold_keyword_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(text.has_word("text", ["eeai", "fur", "e"])).select("doc_id")


@query("SELECT file_id, count(*) AS n_rows, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount FROM facts GROUP BY file_id")
def file_totals(spark, sf_dir):
    return analytics.file_totals(views.facts(spark, sf_dir))


@query("""SELECT description, unit, count(*) AS occurrences, min(unit_price) AS min_price, max(unit_price) AS max_price,
  round(avg(unit_price), 4) AS avg_price, md5(array_to_string(list_sort(list(DISTINCT file_id)), ',')) AS files_md5
FROM line_items GROUP BY description, unit""")
def item_price_ranges(spark, sf_dir):
    rows = catalogue.price_ranges(views.line_items(spark, sf_dir))
    return rows.withColumn("files_md5", F.md5(F.array_join(F.transform("file_ids", lambda x: x.cast("string")), ","))).drop("file_ids")


@query("SELECT master_id, count(*) AS occurrences FROM facts GROUP BY master_id ORDER BY occurrences DESC, master_id LIMIT 100")
def top_masters(spark, sf_dir):
    return analytics.most_used(views.facts(spark, sf_dir), 100)


@query(f"SELECT master_id, CAST(len(list_intersect({_A}, {_B})) AS DOUBLE) / len(list_distinct(list_concat({_A}, {_B}))) AS similarity FROM catalogue")
def keyword_jaccard(spark, sf_dir):
    rows = views.catalogue(spark, sf_dir).withColumn("other", F.concat_ws(" ", "unit", "sec_code", "description"))
    return rows.select("master_id", matching.jaccard("description", "other").alias("similarity"))


@query("SELECT file_id, line_number, description, confidence FROM line_items WHERE method = 'R' AND sec_code = 'Brand#13' AND confidence >= 60 AND confidence <= 90 AND description ILIKE '%e%'")
def line_item_filter(spark, sf_dir):
    found = matching.select_items(views.line_items(spark, sf_dir), equal={"method": "R", "sec_code": "Brand#13", "file_id": None}, low=60, high=90, search="e")
    return found.select("file_id", "line_number", "description", "confidence")


@query("SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents WHERE text IS NOT NULL")
def duplicate_files(spark, sf_dir):
    return catalogue.same_content(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(""", g AS (SELECT file_id, line_number, CASE WHEN length(trim(description)) < 3 THEN 'too short' WHEN unit_price <= 0 OR quantity <= 0 THEN 'no price' WHEN confidence < 60 THEN 'low confidence' END AS reason, confidence FROM line_items)
SELECT coalesce(reason, CASE WHEN confidence >= 90 THEN 'green' ELSE 'yellow' END) AS route, count(*) AS n_items, min(confidence) AS lowest FROM g GROUP BY 1""")
def routing_counts(spark, sf_dir):
    return cascade.route(views.line_items(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n_items"), F.min("confidence").alias("lowest"))


# Quality gate: rules over the catalogue's text, category by the leading word of the unit.
GATE = gate.Rules(
    device=r"^[a-z]{1,3}-?\d+$",
    forbidden={"old bolt": r"\bold bolt\b", "reclaimed": r"\bhot (?:rod|ring)\b"},
    accepted={"plate": r"\bcold plate\b"},
    indicators={"has_verb": r"\b(?:economy|promo|standard)\b", "has_material": r"\b(?:bolt|gear|plate|ring|rod)\b", "has_location": r"\b(?:cold|hot|blue|red)\b", "has_specs": r"\bbrand#1\d?\b"},
    categories={"economy": gate.Category(1, 25, "K95"), "small": gate.Category(2, 0, "M250"), "large": gate.Category(1, 25), "promo": gate.Category(2, 15, "B20")},
)
_GATE = """, t AS (SELECT master_id, lower(unit || ' ' || sec_code || ' ' || description) AS d, lower(unit) AS category FROM catalogue),
i AS (SELECT *, regexp_matches(d, '\\b(economy|promo|standard)\\b') AS v, regexp_matches(d, '\\b(bolt|gear|plate|ring|rod)\\b') AS m,
  regexp_matches(d, '\\b(cold|hot|blue|red)\\b') AS l, regexp_matches(d, '\\bbrand#1[0-9]?\\b') AS s FROM t),
n AS (SELECT *, v::INT + m::INT + l::INT + s::INT AS k FROM i),
b AS (SELECT *, 25 * k + CASE WHEN category IN ('economy', 'large') AND k >= 1 THEN 25 WHEN category = 'promo' AND k >= 2 THEN 15 ELSE 0 END AS base FROM n),
g AS (SELECT *, CASE WHEN base < 90 AND NOT s THEN CASE category WHEN 'economy' THEN 'K95' WHEN 'small' THEN 'M250' WHEN 'promo' THEN 'B20' END END AS put FROM b),
p AS (SELECT *, least(100, base + CASE WHEN put IS NOT NULL THEN 25 ELSE 0 END) AS points FROM g),
r AS (SELECT master_id, CASE WHEN regexp_matches(d, '\\bold bolt\\b') THEN 1 WHEN regexp_matches(d, '\\bhot (rod|ring)\\b') THEN 2 WHEN regexp_matches(d, '\\bcold plate\\b') THEN 3 ELSE 0 END AS c, points, put FROM p),
q AS (SELECT master_id, CASE WHEN c IN (1, 2) THEN 'REJECTED' WHEN c = 3 OR points >= 90 THEN 'APPROVED' WHEN points >= 60 THEN 'PENDING_REVIEW' ELSE 'REJECTED' END AS status,
  CAST(CASE WHEN c IN (1, 2) THEN 0 WHEN c = 3 THEN 75 ELSE points END AS INTEGER) AS score,
  CASE WHEN c = 1 THEN 'forbidden: old bolt' WHEN c = 2 THEN 'forbidden: reclaimed' WHEN c = 3 THEN 'accepted: plate' WHEN points < 60 THEN 'few indicators' END AS reason,
  CASE WHEN c = 0 THEN put END AS default_grade FROM r) """


def _gated(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "unit", "sec_code", "description"))
    return gate.destination(gate.score(views.catalogue(spark, sf_dir).select("master_id", text.alias("description"), F.lower("unit").alias("category")), GATE))


@query(_GATE + "SELECT * FROM q")
def gatekeeper_scores(spark, sf_dir):
    return _gated(spark, sf_dir).select("master_id", "status", "score", "reason", "default_grade")


@query(_GATE + """SELECT status, CASE status WHEN 'APPROVED' THEN 'master' WHEN 'PENDING_REVIEW' THEN 'pending' ELSE CASE WHEN reason LIKE 'forbidden%' THEN 'quarantine' ELSE 'red work item' END END AS destination,
  count(*) AS n_items FROM q GROUP BY 1, 2""")
def gatekeeper_routing(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("status", "destination").agg(F.count("*").alias("n_items"))


@query(_GATE + "SELECT reason, count(*) AS n FROM q WHERE reason LIKE 'forbidden%' GROUP BY 1")
def quarantine_by_reason(spark, sf_dir):
    return gate.quarantine_counts(_gated(spark, sf_dir))


@query(_GATE + "SELECT status, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM q GROUP BY 1")
def pending_stats(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


# Units: spellings by a rule, since the given tables have none.
_SPELLED = ["Sqm ", "khối", "EA", "tonne", "Lump Sum", "ngày", "running metres", "m"]
_SPELLED_SQL = "[" + ", ".join(f"'{s}'" for s in _SPELLED) + "]"
_MAP_SQL = "MAP {" + ", ".join(f"'{s}': '{unit}'" for unit, spellings in units.SPELLINGS.items() for s in spellings) + "}"


@query(f""", u AS (SELECT master_id, CASE WHEN master_id % 9 < 8 THEN {_SPELLED_SQL}[master_id % 9 + 1] END AS raw FROM catalogue)
SELECT master_id, CASE WHEN raw IS NULL THEN 'pcs' ELSE coalesce({_MAP_SQL}[lower(trim(raw))], substr(lower(trim(raw)), 1, 10)) END AS unit FROM u""")
def unit_standardized(spark, sf_dir):
    raw = F.when(F.col("master_id") % 9 < 8, F.array(*map(F.lit, _SPELLED))[(F.col("master_id") % 9).cast("int")])
    return views.catalogue(spark, sf_dir).select("master_id", units.standard(raw).alias("unit"))


_CODED = ", c AS (SELECT master_id, unit, 'SEC-' || substr(sec_code, 7, 1) || '-' || substr(sec_code, 8) AS code FROM catalogue) "


def _coded(spark, sf_dir):
    """Catalogue rows with codes of three parts, made of their brand's digits."""
    return views.catalogue(spark, sf_dir).withColumn("code", F.concat(F.lit("SEC-"), F.substr("sec_code", F.lit(7), F.lit(1)), F.lit("-"), F.substr("sec_code", F.lit(8))))


@query(_CODED + """, own AS (SELECT code, min(unit) AS unit FROM c WHERE code LIKE '%-%-_' GROUP BY 1 HAVING count(*) % 2 = 0), up AS (SELECT substr(code, 1, 5) AS code, max(unit) AS unit FROM c WHERE code LIKE 'SEC-1%' GROUP BY 1)
SELECT c.master_id, c.code, coalesce(own.unit, up.unit, '') AS default_unit, CASE WHEN own.unit IS NOT NULL THEN 'own' WHEN up.unit IS NOT NULL THEN 'parent' ELSE 'none' END AS default_from
FROM c LEFT JOIN own ON c.code = own.code LEFT JOIN up ON substr(c.code, 1, 5) = up.code""")
def unit_default_from_parent(spark, sf_dir):
    rows = _coded(spark, sf_dir)
    own = rows.where(F.col("code").like("%-%-_")).groupBy("code").agg(F.min("unit").alias("unit"), F.count("*").alias("n")).where("n % 2 = 0").drop("n")
    up = rows.where(F.col("code").like("SEC-1%")).groupBy(F.substring_index("code", "-", 2).alias("code")).agg(F.max("unit").alias("unit"))
    return units.with_default(rows, own.union(up)).select("master_id", "code", "default_unit", "default_from")


@query("""SELECT split_part(w, '-', 3) AS grade, count(*) AS n FROM (SELECT sec_code || '-' || substr(unit, 1, 3) || '-M' || CAST(CAST(floor(ref_price / 50) AS BIGINT) * 50 AS VARCHAR) || '-' || CAST(master_id AS VARCHAR) AS w FROM catalogue)
WHERE w LIKE '%-M%-%' GROUP BY 1""")
def material_grade_stats(spark, sf_dir):
    grade = F.concat(F.lit("M"), (F.floor(F.col("ref_price") / 50) * 50).cast("string"))
    return analytics.by_grade(views.catalogue(spark, sf_dir).select(F.concat_ws("-", "sec_code", F.substring("unit", 1, 3), grade, F.col("master_id").cast("string")).alias("work_code")))


@query(_VERSION + """, a AS (SELECT file_id, count(*) AS n, sum(CAST(amount AS DECIMAL(18,2))) AS s FROM facts GROUP BY 1),
w AS (SELECT project_id, version, coalesce(n, 0) AS n_lines, coalesce(CAST(s AS DOUBLE), 0.0) AS total_amount FROM v LEFT JOIN a USING (file_id)),
x AS (SELECT *, lag(total_amount) OVER (PARTITION BY project_id ORDER BY version) AS before FROM w)
SELECT project_id, version, n_lines, total_amount, round(total_amount - before, 2) AS change, round(CASE WHEN before <> 0 THEN (total_amount - before) / before * 100 END, 4) AS change_pct FROM x""")
def version_totals(spark, sf_dir):
    return catalogue.version_totals(views.facts(spark, sf_dir), views.files(spark, sf_dir))


# Sections: rows of a large quantity head what follows.
_PLACED = """, p AS (SELECT file_id, line_number, row_number() OVER (PARTITION BY file_id ORDER BY line_number, master_id, amount) AS pos,
  CASE WHEN quantity >= 40 THEN 1 WHEN quantity >= 30 THEN 2 WHEN quantity >= 15 THEN 3 ELSE 4 END AS lev FROM facts) """


@query(_PLACED + """, s AS (SELECT *, sum(CASE WHEN lev = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS section FROM p)
SELECT file_id, CAST(section AS BIGINT) AS section, CAST(min(pos) AS INTEGER) AS first_row, CAST(max(pos) AS INTEGER) AS last_row, count(*) FILTER (WHERE lev > 1) AS n_items FROM s GROUP BY 1, 2""")
def section_segments(spark, sf_dir):
    return sections.segments(views.facts(spark, sf_dir), "file_id", ["line_number", "master_id", "amount"], F.col("quantity") >= 40)


@query(_PLACED + """, e AS (SELECT a.file_id, a.pos, string_agg(CAST(b.pos AS VARCHAR), '>' ORDER BY b.pos) AS path FROM p a JOIN p b ON a.file_id = b.file_id AND b.pos < a.pos AND b.lev < a.lev
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.file_id = a.file_id AND c.pos > b.pos AND c.pos < a.pos AND c.lev <= b.lev) GROUP BY 1, 2)
SELECT p.file_id, CAST(p.pos AS INTEGER) AS position, coalesce(path, '') AS path FROM p LEFT JOIN e ON p.file_id = e.file_id AND p.pos = e.pos""")
def section_paths(spark, sf_dir):
    q = F.col("quantity")
    rows = views.facts(spark, sf_dir).withColumn("level", F.when(q >= 40, 1).when(q >= 30, 2).when(q >= 15, 3).otherwise(4))
    found = sections.enclosing(rows, "file_id", ["line_number", "master_id", "amount"], 4)
    return found.select("file_id", "position", F.array_join(F.transform("path", lambda p: p.cast("string")), ">").alias("path"))


# Rule classification: terms of some codes, longer texts made of unit and description.
TERMS = {"STRUCTURE": ["rod", "bolt", "red bolt", "economy"], "PIPES": ["ring", "cold", "gear"], "FINISH": ["plate", "blue plate", "promo", "large"], "MISC": ["new", "old", "wid", "giz"]}
_TERMS = ", ".join(f"({i}, '{code}', '{term}')" for i, (code, words) in enumerate(TERMS.items()) for term in words)


@query(f""", terms AS (SELECT * FROM (VALUES {_TERMS}) AS v(ord, code, term)), d AS (SELECT master_id, lower(unit || ' ' || description) AS t FROM catalogue),
s AS (SELECT master_id, ord, code, round(least(sum(length(term) * CAST(100 AS DOUBLE) / length(t) + CASE WHEN regexp_matches(t, '\\b' || term || '\\b') THEN 20 ELSE 0 END) / count(*), 95), 6) AS score
  FROM d JOIN terms ON contains(t, term) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY score DESC, ord) AS place FROM s) SELECT master_id, CAST(place AS INTEGER) AS place, code, score FROM r WHERE place <= 3""")
def rule_classify(spark, sf_dir):
    rows = spread(views.catalogue(spark, sf_dir).select("master_id", F.concat_ws(" ", "unit", "description").alias("description")))
    # an outer generator: for a plain one Spark works all classes out a second time, before rows are spread, to filter
    each = rules.by_terms(rows, TERMS, 3).select("master_id", F.posexplode_outer("classes").alias("at", "c"))
    return each.where("c is not null").select("master_id", (F.col("at") + 1).alias("place"), "c.code", "c.score")


@query("""SELECT vec_id, code, place FROM (SELECT vec_id, code, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), m), 9) DESC, code) AS INTEGER) AS place
FROM embeddings, (SELECT label AS code, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY 1)) WHERE place <= 3""".replace("label AS code", "CAST(label AS BIGINT) AS code"))
def vector_classify(spark, sf_dir):
    return rules.by_class_mean(table(spark, sf_dir, "embeddings"), 3).select("vec_id", "code", "place")


# Fuzzy matching: the altered descriptions against the catalogue of their code, and clusters of near-equal descriptions.
def _variants(spark, sf_dir):
    """Distinct descriptions and units, with a letter doubled or dropped in some by a rule."""
    rows, d = views.line_items(spark, sf_dir), F.col("description")
    text = F.when(F.col("line_number") == 2, F.concat(d, F.substring(d, -1, 1))).when(F.col("line_number") == 3, F.expr("substr(description, 1, length(description) - 1)")).otherwise(d)
    return rows.select(text.alias("description"), "unit").distinct()


_CLUSTERS = """, x AS (SELECT DISTINCT unit, CASE WHEN line_number = 2 THEN description || right(description, 1) WHEN line_number = 3 THEN left(description, length(description) - 1) ELSE description END AS description FROM line_items),
w AS (SELECT unit, description, string_split(lower(description), '') AS ch, (1::BIGINT << length(description)) - 1 AS whole FROM x),
pairs AS (SELECT a.unit, a.description AS a, b.description AS b, a.whole AS whole, list_prepend(a.whole, list_transform(b.ch, lambda c: CAST(coalesce(list_sum(list_transform(range(1, len(a.ch) + 1), lambda i: CASE WHEN a.ch[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END)), 0) AS BIGINT))) AS steps
  FROM w a JOIN w b ON a.unit = b.unit AND a.description < b.description),
links AS (SELECT unit, a, b FROM (SELECT *, length(a) - bit_count(list_reduce(steps, lambda v, k: ((v + (v & k)) | (v - (v & k))) & ((1::BIGINT << length(a)) - 1))) AS lcs FROM pairs) WHERE 2.0 * lcs / (length(a) + length(b)) >= 0.85),
both_ways AS (SELECT unit, a, b FROM links UNION SELECT unit, b, a FROM links) """


@query(_CLUSTERS + """, walk AS (SELECT unit, description AS a, description AS b FROM x UNION SELECT walk.unit, walk.a, both_ways.b FROM walk JOIN both_ways ON walk.unit = both_ways.unit AND walk.b = both_ways.a)
SELECT unit, a AS description, min(b) AS cluster FROM walk GROUP BY 1, 2""")
def cluster_descriptions(spark, sf_dir):
    return fuzzy.clusters(_variants(spark, sf_dir)).select("unit", "description", "cluster")


ORACLES["cluster_descriptions"] = ORACLES["cluster_descriptions"].replace("WITH", "WITH RECURSIVE", 1)


def fuzzy_topk(spark, sf_dir):
    """No SQL: the score holds a sequence ratio that SQL engines lack; tests compare the scored pairs with plain Python on a small fixture."""
    masters = views.catalogue(spark, sf_dir)
    items = views.line_items(spark, sf_dir).withColumn("description", _as_altered())
    return fuzzy.top_matches(items, masters, "sec_code", 5).select("sec_code", "text", "unit", "master_id", "score", "place", "tier")


def fuzzy_best_match(spark, sf_dir):
    """The first of ``fuzzy_topk``; texts without a match are left out."""
    return fuzzy_topk(spark, sf_dir).where("place = 1").drop("place")


def fuzzy_top5_all(spark, sf_dir):
    """Line items as altered, with unit and code in their text, against the whole catalogue; no SQL for the same reason, tests compare with all pairs."""
    whole = lambda df: df.select("*", F.concat_ws(" ", "description", F.lower("unit"), "sec_code").alias("_text")).drop("description").withColumnRenamed("_text", "description")
    items = views.line_items(spark, sf_dir).withColumn("description", _as_altered())
    return fuzzy_top.top_matches(whole(items), whole(views.catalogue(spark, sf_dir)), 5)


QUERIES |= {f.__name__: f for f in (fuzzy_topk, fuzzy_best_match, fuzzy_top5_all)}


# Specifications: catalogue rows with what a work description says, by a rule.
SPECIFIED = ["Bê tông cốt thép dầm M300", "ống HDPE D110 PN10", "Cáp điện Cu/XLPE 4x16mm2", "gach lat 600 X 600", "excavation 2.5m", "thép cột CB400 D16", "painted", "concrete B22.5 20cm"]


def _specified(spark, sf_dir):
    said = F.array(*map(F.lit, SPECIFIED))[(F.col("master_id") % len(SPECIFIED)).cast("int")]
    rows = spread(views.catalogue(spark, sf_dir).select("master_id", F.concat_ws(" ", said, "description").alias("description")))
    return specs.with_key(specs.extract(rows))


def _spec_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = lambda names: "[" + ", ".join("{'w': " + quoted(f" {w} ") + ", 'n': " + quoted(n) + "}" for n, own in names.items() for w in own) + "]"
    named = lambda names: "list_sort(list_filter(list_transform(" + words(names) + ", lambda x: {'at': strpos(f, x.w), 'size': -length(x.w), 'n': x.n}), lambda y: y.at > 0))[1].n"
    held = lambda pattern: f"nullif(regexp_extract(t, {quoted(pattern)}, 1), '')"
    said = "[" + ", ".join(map(quoted, SPECIFIED)) + "]"
    return f""", t AS (SELECT master_id, {said}[master_id % {len(SPECIFIED)} + 1] || ' ' || description AS t FROM catalogue), f AS (SELECT *, ' ' || trim(regexp_replace({_FOLD.replace("text", "t")}, '[^a-z0-9]+', ' ', 'g')) || ' ' AS f FROM t),
s0 AS (SELECT master_id, {named(specs.CATEGORIES)} AS category, {named(specs.MATERIALS)} AS material, upper({held(specs.GRADE)}) AS grade, translate({held(specs.SIZE)}, 'X× ', 'xx') AS d FROM f),
s AS (SELECT *, CASE WHEN regexp_matches(d, '^[0-9]') THEN lower(d) ELSE d END AS dimension FROM s0),
k AS (SELECT *, lower(concat_ws('|', coalesce(category, 'x'), coalesce(material, 'x'), coalesce(grade, 'x'), coalesce(dimension, 'x'))) AS matching_key,
  (CASE WHEN category IS NULL THEN 0 ELSE 25 END + CASE WHEN material IS NULL THEN 0 ELSE 25 END + CASE WHEN grade IS NULL THEN 0 ELSE 30 END + CASE WHEN dimension IS NULL THEN 0 ELSE 20 END) / CAST(100 AS DOUBLE) AS completeness FROM s) """


@query(_spec_sql() + "SELECT master_id, category, material, grade, dimension FROM k")
def spec_extract(spark, sf_dir):
    return _specified(spark, sf_dir).select("master_id", "category", "material", "grade", "dimension")


@query(_spec_sql() + "SELECT matching_key, count(*) AS n_masters, min(master_id) AS first_id FROM k GROUP BY 1")
def matching_key(spark, sf_dir):
    return _specified(spark, sf_dir).groupBy("matching_key").agg(F.count("*").alias("n_masters"), F.min("master_id").alias("first_id"))


@query(_spec_sql() + "SELECT completeness, count(*) AS n_masters FROM k GROUP BY 1")
def spec_completeness(spark, sf_dir):
    return _specified(spark, sf_dir).groupBy("completeness").agg(F.count("*").alias("n_masters"))


@query(_spec_sql() + "SELECT master_id, completeness FROM k WHERE completeness < 0.75 ORDER BY completeness, master_id LIMIT 100")
def incomplete_specs(spark, sf_dir):
    # staged, since the condition would be worked out from the texts in front of all else, before rows are spread
    rows = stage(_specified(spark, sf_dir).select("master_id", "completeness"), "completeness")
    return rows.where("completeness < 0.75D").orderBy("completeness", "master_id").limit(100).select("master_id", "completeness")


# Codes, text rules and reviews: catalogue rows with what a work description says, and a normalised form by a rule.
_NORMALISED = """CASE WHEN master_id % 11 = 0 THEN NULL WHEN master_id % 5 = 0 THEN said WHEN master_id % 5 = 1 THEN unit || ' - ' || said || ' - ' || name WHEN master_id % 5 = 2 THEN unit || ' - ' || name
  WHEN master_id % 5 = 3 THEN said || ' - ' || name ELSE unit || ' - [' || said || '] - (' || name || ') - ' || sec_code || ';;--x' END"""
_WORKS = f""", said AS (SELECT master_id, unit, sec_code, description AS name, [{", ".join(f"'{s}'" for s in SPECIFIED)}][master_id % {len(SPECIFIED)} + 1] AS said FROM catalogue),
works AS (SELECT *, said || ' ' || name AS description, {_NORMALISED} AS normalised, 40 + master_id * 7 % 60 AS confidence FROM said) """


def _works(spark, sf_dir):
    said = F.array(*map(F.lit, SPECIFIED))[(F.col("master_id") % len(SPECIFIED)).cast("int")]
    rows = views.catalogue(spark, sf_dir).select("master_id", "unit", "sec_code", F.col("description").alias("name"), said.alias("said"))
    return rows.selectExpr("*", "said || ' ' || name AS description", f"{_NORMALISED} AS normalised", "40 + master_id * 7 % 60 AS confidence")


CODE_RULES = codes.Rules(
    groups={"bê tông": "CONC", "concrete": "CONC", "thép": "RBAR", "ống": "PIPE", "cáp": "CABL", "gạch": "TILE", "excavation": "SOIL"},
    types={"cốt thép": "STR", "thép": "BAR", "hdpe": "HDP", "cáp điện": "PWR", "lát": "FLR"},
    defaults={"CONC": "STR", "SOIL": "EXC", "PIPE": "SUP"},
    locations={"cột": "COL", "dầm": "BEM", "ring": "RNG", "cold": "CLD"},
    disciplines={"Brand#": "GN", "Brand#1": "CV", "Brand#13": "EL"},
)


def _keyword_sql(column: str, words: dict[str, str]) -> str:
    folded = _FOLD.replace("text", column)
    cases = lambda at, f: "CASE " + " ".join(f"WHEN contains({at}, '{f(w)}') THEN '{words[w]}'" for w in codes.longest_first(words)) + " END"
    return f"coalesce({cases(f'lower({column})', str)}, {cases(folded, text.fold_word)})"


def _reference_sql() -> str:
    r = CODE_RULES
    default = "CASE g " + " ".join(f"WHEN '{g}' THEN '{t}'" for g, t in r.defaults.items()) + " ELSE 'GEN' END"
    discipline = "CASE " + " ".join(f"WHEN starts_with(sec_code, '{p}') THEN '{r.disciplines[p]}'" for p in codes.longest_first(r.disciplines)) + " END"
    return f"""{_WORKS}, grouped AS (SELECT *, coalesce({_keyword_sql("description", r.groups)}, 'GENR') AS g FROM works),
coded AS (SELECT master_id, 'A.' || g || '.' || coalesce({_keyword_sql("description", r.types)}, {default}) AS ref_code, {discipline} AS discipline, {_keyword_sql("description", r.locations)} AS location FROM grouped) """


@query(_reference_sql() + "SELECT * FROM coded")
def reference_codes(spark, sf_dir):
    return codes.reference_codes(_works(spark, sf_dir), CODE_RULES).select("master_id", "ref_code", "discipline", "location")


@query(_reference_sql() + """, used AS (SELECT ref_code, count(*) AS last FROM coded GROUP BY 1),
n AS (SELECT master_id, ref_code, CAST(last + row_number() OVER (PARTITION BY ref_code ORDER BY master_id) AS VARCHAR) AS k FROM coded JOIN used USING (ref_code))
SELECT master_id, ref_code || '-' || CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END AS instance_code FROM n""")
def instance_codes(spark, sf_dir):
    """Numbers go on after codes in use; here every reference code has one whose number is its count of rows."""
    rows = codes.reference_codes(_works(spark, sf_dir), CODE_RULES).select("ref_code", "master_id")
    used = rows.groupBy("ref_code").agg(F.count("*").alias("n")).select(F.concat_ws("-", "ref_code", F.lpad(F.col("n").cast("string"), 6, "0")).alias("work_code"))
    return catalogue.next_codes(rows, "ref_code", "master_id", used, width=3).select("master_id", F.col("work_code").alias("instance_code"))


_MIXED_CODE = "CASE WHEN master_id % 3 = 0 THEN 'A.' || upper(left(unit, 4)) || '.' || upper(left(name, 3)) WHEN master_id % 3 = 1 THEN upper(left(unit, 1)) || '.' || left(name, 3) ELSE unit || '.X' END"
_LEGAL_CODE = "CASE WHEN master_id % 4 = 0 THEN left(unit, 2) || '.' || (1000 + master_id % 9000) || left(name, 1) WHEN master_id % 4 = 1 THEN left(name, 3) || '.' || (100 + master_id % 900) WHEN master_id % 4 = 2 THEN left(unit, 2) || '.1234+' ELSE unit || '.12' END"
_CLASS_CODE = "CASE WHEN master_id % 5 = 0 THEN 'Pr' WHEN master_id % 5 = 1 THEN 'Pr_' || left(unit, 2) WHEN master_id % 5 = 2 THEN 'Pr_21_' || left(name, 2) WHEN master_id % 5 = 3 THEN 'Pr_21_31_' || (master_id % 90) ELSE 'Pr_1_2_3_4' END"


@query(_WORKS + f""", c AS (SELECT master_id, {_MIXED_CODE} AS code FROM works), p AS (SELECT *, regexp_matches(code, '{codes.REFERENCE}') AS ok FROM c)
SELECT master_id, code, CASE WHEN ok THEN split_part(code, '.', 1) END AS table_type, CASE WHEN ok THEN split_part(code, '.', 2) END AS "group", CASE WHEN ok THEN split_part(code, '.', 3) END AS type FROM p""")
def reference_code_parts(spark, sf_dir):
    return _works(spark, sf_dir).selectExpr("master_id", f"{_MIXED_CODE} AS code").withColumn("p", codes.reference_parts("code")).select("master_id", "code", "p.*")


@query(_WORKS + f""", c AS (SELECT master_id, {_LEGAL_CODE} AS code FROM works)
SELECT master_id, nullif(upper(regexp_extract(code, '{codes.LEGAL}', 1)), '') AS prefix, nullif(regexp_extract(code, '{codes.LEGAL}', 2), '') AS number, nullif(lower(regexp_extract(code, '{codes.LEGAL}', 3)), '') AS suffix FROM c""")
def legal_code_parts(spark, sf_dir):
    return _works(spark, sf_dir).selectExpr("master_id", f"{_LEGAL_CODE} AS code").withColumn("p", codes.legal_parts("code")).select("master_id", "p.*")


@query(_WORKS + f""", c AS (SELECT master_id, {_CLASS_CODE} AS code, string_split({_CLASS_CODE}, '_') AS p FROM works), o AS (SELECT *, len(p) BETWEEN 2 AND 4 AS ok FROM c)
SELECT master_id, CASE WHEN ok THEN p[1] END AS entity, CASE WHEN ok THEN p[2] END AS system, CASE WHEN ok THEN p[3] END AS element, CASE WHEN ok THEN p[4] END AS product, CASE WHEN ok THEN CAST(len(p) AS INTEGER) END AS level,
  CASE WHEN ok THEN concat_ws(' > ', p[1], p[1] || '_' || p[2], p[1] || '_' || p[2] || '_' || p[3], code_of_four) END AS path FROM (SELECT *, CASE WHEN len(p) = 4 THEN code END AS code_of_four FROM o)""")
def class_code_paths(spark, sf_dir):
    return _works(spark, sf_dir).selectExpr("master_id", f"{_CLASS_CODE} AS code").withColumn("p", codes.class_parts("code")).select("master_id", "p.*")


@query(_WORKS + r""", b AS (SELECT master_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(normalised, '\[([^\]]+)\]', '\1', 'g'), '\(([^)]+)\)', '\1', 'g'), '[,;:]{2,}', ',', 'g'), '-{2,}', '-', 'g') AS t FROM works),
p AS (SELECT *, string_split(t, ' - ') AS p FROM b) SELECT master_id, CASE WHEN len(p) > 3 THEN p[1] || ' - ' || array_to_string(p[2:len(p) - 1], ' ') || ' - ' || p[len(p)] ELSE t END AS components FROM p""")
def text_components(spark, sf_dir):
    rows = _works(spark, sf_dir).select("master_id", text.without_brackets("normalised").alias("t"))
    return rows.select("master_id", text.three_components("t").alias("components"))


_LENGTH = "CASE WHEN master_id % 7 = 0 THEN '2,' || (master_id % 10) WHEN master_id % 7 = 1 THEN 'n/a' ELSE CAST(master_id % 1000 AS VARCHAR(20)) END AS v, CASE WHEN master_id % 4 = 0 THEN ' CM' WHEN master_id % 4 = 1 THEN 'mét' WHEN master_id % 4 = 2 THEN 'mm' ELSE 'inch' END AS u"


@query(f""", l AS (SELECT master_id, {_LENGTH} FROM catalogue), n AS (SELECT *, TRY_CAST(replace(v, ',', '.') AS DOUBLE) * MAP {{{", ".join(f"'{u}': {f}" for u, f in text.MILLIMETRES.items())}}}[lower(trim(u))] AS mm FROM l)
SELECT master_id, coalesce(CAST(CAST(trunc(mm) AS BIGINT) AS VARCHAR) || 'mm', v || u) AS length FROM n""")
def lengths_in_millimetres(spark, sf_dir):
    return views.catalogue(spark, sf_dir).selectExpr("master_id", _LENGTH.split(" AS v, ")[0] + " AS v", _LENGTH.split(" AS v, ")[1]).select("master_id", text.millimetres("v", "u").alias("length"))


KEYWORDS = ["bolt", "red bolt", "thép", "cốt thép", "cold", "widget", "cold widget", "ống"]
_KEYWORD_LIST = ", ".join(f"CASE WHEN contains(lower(description), '{w}') THEN '{w}' END" for w in KEYWORDS)


@query(_WORKS + f""", h AS (SELECT master_id, list_filter([{_KEYWORD_LIST}], lambda w: w IS NOT NULL) AS ws FROM works)
SELECT master_id, array_to_string(list_filter(ws, lambda w: len(list_filter(ws, lambda o: o <> w AND contains(' ' || o || ' ', ' ' || w || ' '))) = 0), '|') AS keywords FROM h""")
def keyword_suppression(spark, sf_dir):
    rows = _works(spark, sf_dir).select("master_id", codes.contained("description", KEYWORDS).alias("ws"))
    return rows.select("master_id", F.array_join(codes.undominated(F.col("ws")), "|").alias("keywords"))


@query(_WORKS + r"""SELECT master_id, nullif(lower(regexp_extract(description, '(?i)^\s*(excavation|bê tông|gach lat|painted|gach)\s+', 1)), '') AS lead, regexp_replace(description, '(?i)^\s*(excavation|bê tông|gach lat|painted|gach)\s+', '') AS rest FROM works""")
def leading_words(spark, sf_dir):
    return _works(spark, sf_dir).withColumn("s", codes.strip_leading("description", ["gach", "gach lat", "excavation", "bê tông", "painted"])).select("master_id", "s.*")


SPEC_MENTIONS, MATERIAL_MENTIONS = r"(?:M|CB|PN|DN|D|B)\d+(?:\.\d+)?", "(?:HDPE|PVC|XLPE|CONCRETE|GRANITE)"
_LOST = _WORKS + f""", held AS (SELECT master_id, upper(description) AS o, upper(coalesce(normalised, '')) AS n, coalesce(normalised, '') AS normalised, description, confidence FROM works),
l AS (SELECT *, list_distinct(regexp_extract_all(o, '{SPEC_MENTIONS}')) AS os, list_sort(list_filter(list_distinct(regexp_extract_all(o, '{SPEC_MENTIONS}')), lambda x: NOT list_contains(regexp_extract_all(n, '{SPEC_MENTIONS}'), x))) AS ls,
  list_sort(list_filter(list_distinct(regexp_extract_all(o, '{MATERIAL_MENTIONS}')), lambda x: NOT list_contains(regexp_extract_all(n, '{MATERIAL_MENTIONS}'), x))) AS lm FROM held),
v AS (SELECT master_id, array_to_string(list_concat(ls, lm), '|') AS lost, CASE WHEN length(trim(normalised)) < 3 OR confidence < 50 OR (NOT contains(normalised, ' - ') AND length(normalised) > 15) OR len(ls) > len(os) * 0.5 THEN 'BAD'
  WHEN confidence < 70 OR len(string_split(normalised, ' - ')) > 3 OR len(ls) + len(lm) > 0 THEN 'FIXABLE' ELSE 'GOOD' END AS verdict FROM l) """


def _reviewed(spark, sf_dir):
    return review.verdicts(_works(spark, sf_dir).withColumnRenamed("description", "original"), SPEC_MENTIONS, MATERIAL_MENTIONS)


@query(_LOST + "SELECT * FROM v")
def review_verdicts(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("master_id", F.array_join("lost", "|").alias("lost"), "verdict")


@query(_LOST + "SELECT verdict, count(*) AS n, count(*) FILTER (WHERE lost <> '') AS n_with_loss FROM v GROUP BY 1")
def review_counts(spark, sf_dir):
    return _reviewed(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.size("lost") > 0).alias("n_with_loss"))


DOMAIN_RULES = [
    review.Rule("concrete_grade", "warning", "bê tông|concrete", r"[mb]\d{2,3}"), review.Rule("pipe_diameter", "warning", "ống", r"\bd\d+"), review.Rule("rebar_type", "error", "thép", r"cb\d{3}"),
    review.Rule("brand_text", "info", "", "^.{10,100}$"), review.Rule("bolt_colour", "error", "bolt", "(?:red|blue|cold) bolt"),
]
_BROKEN = ", ".join(f"CASE WHEN regexp_matches(t, '{r.when}') AND NOT regexp_matches(t, '{r.check}') THEN '{r.name}:{r.severity}' END" for r in DOMAIN_RULES)
_ISSUES = _WORKS + f", b AS (SELECT master_id, unit, confidence, list_filter([{_BROKEN}], lambda x: x IS NOT NULL) AS i FROM (SELECT *, lower(coalesce(normalised, '')) AS t FROM works)) "


@query(_ISSUES + "SELECT master_id, array_to_string(i, '|') AS issues, len(list_filter(i, lambda x: x LIKE '%:error')) = 0 AS is_valid FROM b")
def domain_validation(spark, sf_dir):
    rows = review.validate(_works(spark, sf_dir), DOMAIN_RULES, "normalised")
    return rows.select("master_id", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["name"], i["severity"])), "|").alias("issues"), "is_valid")


@query(_ISSUES + """, e AS (SELECT unit, confidence, len(list_filter(i, lambda x: x LIKE '%:error')) AS e, len(list_filter(i, lambda x: x LIKE '%:warning')) AS w FROM b)
SELECT unit, count(*) AS n_items, count(*) FILTER (WHERE e = 0) / count(*) * 100 AS valid_rate, CAST(sum(confidence) AS DOUBLE) / count(confidence) AS avg_confidence, CAST(sum(e) AS BIGINT) AS n_errors, CAST(sum(w) AS BIGINT) AS n_warnings FROM e GROUP BY 1""")
def validation_quality(spark, sf_dir):
    return review.quality_metrics(review.validate(_works(spark, sf_dir), DOMAIN_RULES, "normalised"), ["unit"])


@query(_spec_sql() + """SELECT master_id, CAST(100 - CASE WHEN category IS NULL THEN 30 ELSE 0 END - CASE WHEN material IS NULL THEN 20 ELSE 0 END - 15 - CASE WHEN grade IS NULL AND dimension IS NULL THEN 15 ELSE 0 END AS INTEGER) AS confidence FROM k""")
def parts_confidence(spark, sf_dir):
    """No table names a position, so its points are always lost here."""
    rows = _specified(spark, sf_dir)
    score = review.parts_confidence(F.col("category"), F.col("material"), F.lit(None).cast("string"), F.coalesce("grade", "dimension"))
    return rows.select("master_id", score.cast("int").alias("confidence"))


# Context of files: indicators over the catalogue's words.
CONTEXTS = {"road": context.Indicators(["bolt", "rod"], ["cold"], 2), "building": context.Indicators(["plate", "widget"], ["hot"], 1.5), "mep": context.Indicators(["ring", "gear"], ["blue", "red"], 1)}
TERMS_OF_FILES = ["bolt", "rod", "plate", "widget", "ring", "gear", "gizmo", "cold", "hot", "blue", "red", "small", "large"]


def _context_sql() -> str:
    points = lambda i: " + ".join(f"CASE WHEN contains(d, '{w}') THEN {p} ELSE 0 END" for ws, p in ((i.strong, i.weight), (i.weak, context.WEAK)) for w in ws)
    sums = ", ".join(f"CAST(sum({points(i)}) AS DOUBLE) AS {n}" for n, i in CONTEXTS.items())
    rows = " UNION ALL ".join(f"SELECT file_id, {k} AS ord, '{n}' AS name, CASE WHEN total > 0 THEN {n} / total ELSE 0.0 END AS share FROM t" for k, n in enumerate(CONTEXTS))
    return f""", s AS (SELECT file_id, {sums} FROM (SELECT file_id, lower(description) AS d FROM line_items) GROUP BY 1), t AS (SELECT *, {" + ".join(CONTEXTS)} AS total FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY share DESC, ord) AS k FROM ({rows})), two AS (SELECT file_id, max(name) FILTER (WHERE k = 1) AS name, max(share) FILTER (WHERE k = 1) AS best, max(share) FILTER (WHERE k = 2) AS second FROM r GROUP BY 1) """


@query(_context_sql() + "SELECT file_id, CASE WHEN best < CAST(0.3 AS DOUBLE) OR second > CAST(0.3 AS DOUBLE) THEN 'mixed' ELSE name END AS project_type, best AS share, best - second AS gap FROM two")
def file_project_types(spark, sf_dir):
    return context.project_types(views.line_items(spark, sf_dir), "file_id", CONTEXTS)


@query(f""", w AS (SELECT unit, unnest(list_intersect(string_split_regex(lower(description), '[^a-z0-9]+'), [{", ".join(f"'{t}'" for t in TERMS_OF_FILES)}])) AS term FROM line_items), c AS (SELECT unit, term, count(*) AS n FROM w GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY unit ORDER BY n DESC, term) AS INTEGER) AS place FROM c) WHERE place <= 5""")
def top_terms(spark, sf_dir):
    return context.top_terms(views.line_items(spark, sf_dir), ["unit"], TERMS_OF_FILES, 5)


# Results written back, exports, remaining filters and joins.
@query(_CASCADE + "SELECT m.file_id, m.line_number, m.description, matched_id, c.description AS master_description FROM m LEFT JOIN catalogue c ON matched_id = c.master_id")
def matched_descriptions(spark, sf_dir):
    masters = views.catalogue(spark, sf_dir).select(F.col("master_id").alias("matched_id"), F.col("description").alias("master_description"))
    return _cascaded(spark, sf_dir).join(masters, "matched_id", "left").select("file_id", "line_number", "description", "matched_id", "master_description")


@query(_CASCADE + """, n AS (SELECT file_id, line_number, max(matched_id) AS matched_id FROM m GROUP BY 1, 2)
SELECT f.file_id, f.line_number, coalesce(n.matched_id, f.master_id) AS matched_id FROM facts f LEFT JOIN n USING (file_id, line_number)""")
def match_update(spark, sf_dir):
    items = views.facts(spark, sf_dir).select("file_id", "line_number", F.col("master_id").alias("matched_id"))
    return updates.with_matches(items, _cascaded(spark, sf_dir), ["file_id", "line_number"]).select("file_id", "line_number", "matched_id")


@query(_CASCADE + """, own AS (SELECT file_id, lower(trim(description || ' bespoke')) AS k, max(master_id) AS id FROM line_items GROUP BY 1, 2)
SELECT m.file_id, m.line_number, coalesce(m.matched_id, own.id) AS matched_id FROM m LEFT JOIN own ON m.file_id = own.file_id AND lower(trim(m.description)) = own.k""")
def back_linked_items(spark, sf_dir):
    variants = views.line_items(spark, sf_dir).select("master_id", "file_id", F.concat("description", F.lit(" bespoke")).alias("variant"))
    return updates.back_links(_cascaded(spark, sf_dir), variants).select("file_id", "line_number", "matched_id")


@query(_CASCADE + """, c AS (SELECT lower(trim(description)) AS synonym, matched_id, count(*) AS n FROM m WHERE matched_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY synonym ORDER BY n DESC, matched_id DESC) AS k FROM c) SELECT synonym, matched_id AS master_id, n FROM b WHERE k = 1 AND synonym NOT IN (SELECT k FROM e)""")
def learnt_synonyms(spark, sf_dir):
    return updates.learnt_synonyms(_cascaded(spark, sf_dir), views.catalogue(spark, sf_dir))


@query(_CASCADE + "SELECT count(*) AS n_items, count(*) FILTER (WHERE stage = 'exact') AS n_exact, count(*) FILTER (WHERE stage IN ('synonym', 'token')) AS n_close, count(*) FILTER (WHERE stage = 'new') AS n_new, count(DISTINCT lower(trim(description))) AS n_distinct FROM m")
def process_summary(spark, sf_dir):
    is_ = lambda *s: F.count_if(F.col("stage").isin(*s))
    return _cascaded(spark, sf_dir).agg(F.count("*").alias("n_items"), is_("exact").alias("n_exact"), is_("synonym", "token").alias("n_close"), is_("new").alias("n_new"), F.count_distinct(F.lower(F.trim("description"))).alias("n_distinct"))


@query("SELECT sec_code, 'S' || lpad(CAST(master_id AS VARCHAR), 12, '0') AS work_code, description, unit FROM catalogue")
def catalogue_export(spark, sf_dir):
    """The catalogue as sorted CSV files in the shared folder, read back."""
    rows = views.catalogue(spark, sf_dir).select("sec_code", F.concat(F.lit("S"), F.lpad(F.col("master_id").cast("string"), 12, "0")).alias("work_code"), "description", "unit")
    return sinks.csv_round_trip(rows, ["sec_code", "work_code"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS master_id, description FROM events LEFT JOIN catalogue ON CAST(json_extract_string(props, '$.k') AS BIGINT) = master_id")
def json_path_join(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("master_id"))
    return rows.join(views.catalogue(spark, sf_dir).select("master_id", "description"), "master_id", "left")


@query("""SELECT vec_id, n_id, CASE WHEN s >= 0.9 THEN 'exact' WHEN s >= 0.75 THEN 'fuzzy' ELSE 'new' END AS tier FROM (SELECT a.vec_id, b.vec_id AS n_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, n_id) = 1""")
def semantic_match(spark, sf_dir):
    best, s = hierarchy.vector_topk(table(spark, sf_dir, "embeddings"), 1, in_label=False), F.col("similarity")
    return best.select("vec_id", "n_id", F.when(s >= 0.9, "exact").when(s >= 0.75, "fuzzy").otherwise("new").alias("tier"))


@query("SELECT project_id, project_name, region FROM projects WHERE project_type = 'BUILDING' AND region = 'ASIA' AND project_name ILIKE '%1%'")
def project_filter(spark, sf_dir):
    return views.projects(spark, sf_dir).where((F.col("project_type") == "BUILDING") & (F.col("region") == "ASIA") & F.col("project_name").ilike("%1%")).select("project_id", "project_name", "region")


@query(_TREE + "SELECT code, parent FROM links WHERE parent = 'ASIA'")
def codes_below(spark, sf_dir):
    return views.code_links(spark, sf_dir).where("parent = 'ASIA'")


@query("SELECT file_id, line_number, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_number, master_id, amount) AS INTEGER) AS row_number FROM facts")
def raw_row_numbers(spark, sf_dir):
    return hierarchy.numbered(views.facts(spark, sf_dir), "file_id", ["line_number", "master_id", "amount"]).select("file_id", "line_number", "row_number")


@query("SELECT master_id, count(*) AS occurrences, min(unit_price) AS min_price, max(unit_price) AS max_price, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount FROM facts GROUP BY 1")
def running_prices(spark, sf_dir):
    """The figures of every catalogue row as a stream of line items leaves them."""
    # as a glob, since a stream's plain path has to be a folder and the table may be a single file
    lines = spark.readStream.schema(table(spark, sf_dir, "lineitem").schema).parquet(f"{sf_dir.rstrip('/')}/lineitem.parque[t]")
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    streaming.running_prices(lines.select(F.col("l_partkey").alias("master_id"), F.col("l_extendedprice").alias("amount"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")), folder)
    return streaming.current(spark, folder).withColumn("total_amount", F.col("total_amount").cast("double"))


# Kinds of items, what a text leaves unsaid, headings.
KINDS = {"M": "gach|widget", "L": "painted", "E": "excavation"}
DEFAULTS = [review.Default("bê tông|concrete", r"\bm\d{2,3}\b", "M250"), review.Default("bê tông|concrete", r"\d+x\d+", "1x2"), review.Default("excavation", r"machine|manual", "0.8m3")]
_DEFAULTED = "concat_ws(' - ', description, " + ", ".join(f"CASE WHEN regexp_matches(lower(description), '{d.when}') AND NOT regexp_matches(lower(description), '{d.said}') THEN '{d.text}' END" for d in DEFAULTS) + ")"


@query(_WORKS + ", k AS (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(description), '{p}') THEN '{k}'" for k, p in KINDS.items()) + " ELSE 'A' END AS kind, confidence FROM works) SELECT kind, count(*) AS n, min(confidence) AS lowest FROM k GROUP BY 1")
def item_kinds(spark, sf_dir):
    rows = _works(spark, sf_dir).select(codes.first_kind("description", KINDS, "A").alias("kind"), "confidence")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("confidence").alias("lowest"))


@query(_WORKS + f"SELECT master_id, {_DEFAULTED} AS enhanced FROM works")
def default_specs(spark, sf_dir):
    return _works(spark, sf_dir).select("master_id", review.with_defaults("description", DEFAULTS).alias("enhanced"))


_HEADING = "CASE WHEN master_id % 6 = 0 THEN 'PHẦN 1 ' || name WHEN master_id % 6 = 1 THEN 'IV. ' || name WHEN master_id % 6 = 2 THEN 'A. ' || name WHEN master_id % 6 = 3 THEN '1.2. ' || name WHEN master_id % 6 = 4 THEN upper(name) ELSE name END"


@query(_WORKS + f", h AS (SELECT master_id, {_HEADING} AS t FROM works) SELECT master_id, " + "CAST(CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {k}" for k, p in sections.HEADINGS) + " WHEN t = upper(t) AND contains(t, ' ') AND t <> lower(t) THEN 2 END AS INTEGER) AS level FROM h")
def heading_levels(spark, sf_dir):
    return _works(spark, sf_dir).selectExpr("master_id", f"{_HEADING} AS t").select("master_id", sections.heading_level("t").alias("level"))


@query(_reference_sql() + "SELECT master_id, CAST(least(95, 75 + CASE WHEN ref_code NOT LIKE '%.GENR.%' THEN 10 ELSE 0 END + CASE WHEN location IS NOT NULL THEN 10 ELSE 0 END) AS INTEGER) AS confidence FROM coded")
def code_confidence(spark, sf_dir):
    rows = codes.reference_codes(_works(spark, sf_dir), CODE_RULES)
    return rows.select("master_id", codes.confidence(~F.contains("ref_code", F.lit(".GENR.")), F.col("location").isNotNull()).alias("confidence"))


#: Rules of spans, in the order in which they claim.
SPANS = {"section": "[0-9]+(?:[.,][0-9]+)? *[x×] *[0-9]+(?:[.,][0-9]+)? *mm2", "size": "[0-9]+ *[xX×] *[0-9]+", "diameter": r"\bDN?[0-9]+", "grade": r"\b(?:CB|PN|M|B)[0-9]+(?:\.[0-9])?", "length": r"\b[0-9]+(?:[.,][0-9]+)? *(?:cm|mm|m)\b"}


def _span_sql() -> str:
    steps, said = "", "[" + ", ".join("'" + x + "'" for x in SPECIFIED) + "]"
    for i, (name, p) in enumerate(SPANS.items(), 1):
        steps += f", r{i} AS (SELECT master_id, regexp_replace(t, '{p}', '{specs.CUT}', 'g') AS t, list_concat(s, list_transform(regexp_extract_all(t, '{p}'), lambda v: '{name}=' || v)) AS s FROM r{i - 1})"
    return f", r0 AS (SELECT master_id, {said}[master_id % {len(SPECIFIED)} + 1] || ' ' || description AS t, CAST([] AS VARCHAR[]) AS s FROM catalogue)" + steps


@query(_span_sql() + f"SELECT master_id, array_to_string(s, '; ') AS specs, trim(regexp_replace(t, '[{specs.CUT}\\s]+', ' ', 'g')) AS rest FROM r{len(SPANS)}")
def spec_spans(spark, sf_dir):
    said = F.array(*map(F.lit, SPECIFIED))[(F.col("master_id") % len(SPECIFIED)).cast("int")]
    rows = views.catalogue(spark, sf_dir).select("master_id", F.concat_ws(" ", said, "description").alias("description"))
    found = specs.claim_spans(rows, SPANS)
    return found.select("master_id", F.array_join(F.transform("specs", lambda x: F.concat(x["rule"], F.lit("="), x["value"])), "; ").alias("specs"), "rest")


ABBREVIATIONS = {"anv": "anvil", "sm": "small", "lg": "large", "wdg": "widget", "eco": "economy", "std": "standard", "bl r": "blue ring", "bl": "blue"}
_SHORT = {"anvil": "ANV", "small": "Sm", "large": "lg", "widget": "wdg.", "blue": "bl", "ring": "R"}


@query("""SELECT master_id, expanded FROM (SELECT master_id, array_to_string(list_filter([CASE split_part(description, ' ', 1) WHEN 'small' THEN 'Small' ELSE split_part(description, ' ', 1) END,
  CASE WHEN split_part(description, ' ', 1) = 'blue' AND split_part(description, ' ', 2) = 'ring' THEN NULL ELSE CASE split_part(description, ' ', 2) WHEN 'anvil' THEN 'ANVIL' WHEN 'widget' THEN 'widget.' WHEN 'ring' THEN 'R' ELSE split_part(description, ' ', 2) END END,
  'eco2', CASE unit WHEN 'ECONOMY' THEN 'ECONOMY,' WHEN 'STANDARD' THEN 'STANDARD,' ELSE left(unit, 3) || ',' END], lambda x: x IS NOT NULL), ' ') AS expanded, description FROM catalogue) WHERE description <> 'blue ring'
UNION ALL SELECT master_id, 'blue ring eco2 ' || CASE unit WHEN 'ECONOMY' THEN 'ECONOMY,' WHEN 'STANDARD' THEN 'STANDARD,' ELSE left(unit, 3) || ',' END FROM catalogue WHERE description = 'blue ring'""")
def expand_abbreviations(spark, sf_dir):
    """Catalogue rows written short by a rule, and written out again."""
    short = F.create_map(*(F.lit(x) for pair in _SHORT.items() for x in pair))
    words = F.transform(F.split("description", " "), lambda w: F.coalesce(short[w], w))
    unit = F.when(F.col("unit") == "STANDARD", "STD").otherwise(F.substring("unit", 1, 3))
    rows = views.catalogue(spark, sf_dir).select("master_id", F.concat_ws(" ", F.array_join(words, "  "), F.lit("eco2"), F.concat(unit, F.lit(","))).alias("description"))
    return rows.select("master_id", abbreviations.expand("description", ABBREVIATIONS).alias("expanded"))


def _commands(spark, sf_dir):
    """Events read as commands on the specification of their user."""
    kind, i = F.col("event_type"), F.col("event_id")
    action = F.when(kind.isin("view", "error"), "set").when(kind == "signup", "verify").when(kind.isin("click", "purchase"), "promote")
    value = F.when(kind == "view", F.get_json_object("props", "$.k")).when(kind == "click", "detailed").when(kind == "purchase", "final")
    field = F.array(*map(F.lit, lifecycle.FIELDS))[(i % 4).cast("int")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("ts").alias("at"), i.alias("seq"), action.alias("action"), F.when(action == "set", field).alias("field"), value.alias("value"))


_LIFE = """, c AS (SELECT user_id AS item, ts AS t, event_id AS seq, event_type, CASE WHEN event_type = 'view' THEN props->>'$.k' WHEN event_type = 'error' THEN '' END AS v, event_id % 4 AS f,
  CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS target FROM events),
v AS (SELECT *, (CASE WHEN coalesce(last_value(CASE WHEN f = 0 THEN v END IGNORE NULLS) OVER w, '') <> '' THEN 25 ELSE 0 END + CASE WHEN coalesce(last_value(CASE WHEN f = 1 THEN v END IGNORE NULLS) OVER w, '') <> '' THEN 25 ELSE 0 END
  + CASE WHEN coalesce(last_value(CASE WHEN f = 2 THEN v END IGNORE NULLS) OVER w, '') <> '' THEN 30 ELSE 0 END + CASE WHEN coalesce(last_value(CASE WHEN f = 3 THEN v END IGNORE NULLS) OVER w, '') <> '' THEN 20 ELSE 0 END) AS completeness,
  bool_or(event_type = 'signup') OVER w AS verified FROM c WINDOW w AS (PARTITION BY item ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, coalesce(CASE WHEN target = 1 THEN completeness >= 50 WHEN target = 2 THEN completeness >= 75 AND verified END, false) AS ok FROM v),
n AS (SELECT *, greatest(coalesce(max(CASE WHEN ok THEN target END) OVER u, 0), 0) AS old, greatest(coalesce(max(CASE WHEN ok THEN target END) OVER u2, 0), 0) AS new FROM h
  WINDOW u AS (PARTITION BY item ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u2 AS (PARTITION BY item ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN target <= old THEN 'not higher' WHEN target = 1 AND completeness < 50 OR target = 2 AND completeness < 75 THEN 'incomplete' WHEN target = 2 AND NOT verified THEN 'not verified' END AS reason, ['draft', 'detailed', 'final'] AS s FROM n) """


@query(_LIFE + "SELECT item, seq, completeness, s[old + 1] AS old_status, s[new + 1] AS new_status, reason FROM g")
def lifecycle_history(spark, sf_dir):
    return lifecycle.history(_commands(spark, sf_dir)).select("item", "seq", "completeness", "old_status", "new_status", "reason")


@query(_LIFE + """SELECT item, s[new + 1] AS status, completeness, (SELECT count(*) FROM g o WHERE o.item = g.item AND reason IS NULL) AS n_changes FROM g QUALIFY row_number() OVER (PARTITION BY item ORDER BY t DESC, seq DESC) = 1""")
def lifecycle_states(spark, sf_dir):
    return lifecycle.states(lifecycle.history(_commands(spark, sf_dir))).select("item", "status", "completeness", "n_changes")


@query(_LIFE + "SELECT reason, count(*) AS n_refused, count(DISTINCT item) AS n_items FROM g WHERE reason IS NOT NULL GROUP BY reason")
def lifecycle_refusals(spark, sf_dir):
    log = lifecycle.history(_commands(spark, sf_dir))
    return log.where(~F.col("accepted")).groupBy("reason").agg(F.count("*").alias("n_refused"), F.count_distinct("item").alias("n_items"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(c):
    """How often a text holds each letter."""
    return F.array(*(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in _LETTERS))


def _edit_ratio(a, b):
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)), 9)


@query(_CASCADE + f""", b AS (SELECT k, id, list_transform(string_split('{_LETTERS}', ''), lambda x: CAST(length(k) - length(replace(k, x, '')) AS DOUBLE)) AS v FROM e),
a AS (SELECT DISTINCT description, lower(trim(description)) AS k FROM m WHERE stage = 'new'), av AS (SELECT *, list_transform(string_split('{_LETTERS}', ''), lambda x: CAST(length(k) - length(replace(k, x, '')) AS DOUBLE)) AS v FROM a),
near AS (SELECT av.description, av.k AS q, b.k, b.id FROM av, b WHERE round(list_cosine_similarity(av.v, b.v), 9) >= 0.75 QUALIFY row_number() OVER (PARTITION BY av.description ORDER BY round(list_cosine_similarity(av.v, b.v), 9) DESC, b.id) <= 20),
r AS (SELECT description, id, round(1 - levenshtein(q, k) / greatest(length(q), length(k)), 9) AS score FROM near),
best AS (SELECT * FROM r WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY description ORDER BY score DESC, id) = 1)
SELECT file_id, line_number, CASE WHEN stage = 'new' AND best.id IS NOT NULL THEN 'vector' ELSE stage END AS stage, CASE WHEN stage = 'new' THEN best.id ELSE matched_id END AS matched_id, CASE WHEN stage = 'new' THEN score END AS score
FROM m LEFT JOIN best ON m.description = best.description""")
def cascade_four_tiers(spark, sf_dir):
    known = views.catalogue(spark, sf_dir)
    synonyms = known.select("master_id", F.concat("description", F.lit(" type")).alias("synonym"))
    found = cascade.with_vectors(_altered(spark, sf_dir), known, synonyms, _letters, _edit_ratio)
    return found.select("file_id", "line_number", "stage", "matched_id", "score")


@query("""SELECT a.vec_id AS query, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) <= 10""")
def vector_index_topk(spark, sf_dir):
    """Every row whose id is divisible by 20 against all rows: each vector is shuffled once, into its list."""
    rows = vector_index.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vector_index.search(vector_index.build(rows), rows.where("id % 20 = 0"), 10, -1.0).select("query", "id")


def sequential_masters(spark, sf_dir):
    """Masters that line items, in order of file and line, make and join; no SQL has such a loop, tests compare with a plain one."""
    lines = views.line_items(spark, sf_dir).withColumn("description", _as_altered())
    order = F.col("file_id") * 10_000_000 + F.col("line_number") * 1_000_000 + F.col("master_id") % 1_000_000
    first = lines.withColumn("line", order).groupBy("sec_code", "unit", "description", "line").agg(F.count("*").alias("n_rows"))
    found = masters.sequential(first, "sec_code", "line")
    return found.groupBy("master").agg(F.count("*").alias("n_lines"), F.count_if(F.col("kind") == "fuzzy").alias("n_fuzzy"), F.min("score").alias("least_score"))


QUERIES["sequential_masters"] = sequential_masters


def _built(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "unit", "sec_code", "description"))
    rows = views.catalogue(spark, sf_dir).select("master_id", text.alias("description"), F.lower("unit").alias("category"))
    return build.run(rows, GATE, f"{shared_dir(spark)}/tables/build-{uuid.uuid4().hex}")


_DESTINED = _GATE + """, d AS (SELECT *, CASE status WHEN 'APPROVED' THEN 'master' WHEN 'PENDING_REVIEW' THEN 'pending' WHEN 'SKIPPED' THEN 'skipped' ELSE CASE WHEN reason LIKE 'forbidden%' OR reason = 'too short' THEN 'quarantine' ELSE 'red work item' END END AS destination FROM q) """


@query(_DESTINED + "SELECT master_id, destination, score FROM d")
def master_build(spark, sf_dir):
    return _built(spark, sf_dir)[0].select("master_id", "destination", "score")


@query(_DESTINED + """SELECT x AS step, count(d.master_id) AS n_rows FROM (SELECT unnest(['master', 'pending', 'quarantine', 'red work item', 'skipped']) AS x) LEFT JOIN d ON destination = x GROUP BY x
UNION ALL SELECT 'rows', count(*) FROM d UNION ALL SELECT 'graded', count(default_grade) FROM d""")
def build_step_stats(spark, sf_dir):
    return build.steps(spark, _built(spark, sf_dir)[1])


@query("""SELECT doc_id AS id, w.keyword FROM documents JOIN (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS keyword FROM part UNION SELECT DISTINCT lower(p_name) FROM part UNION SELECT DISTINCT left(lower(p_name), 2) FROM part) w ON contains(lower(text), w.keyword)""")
def contains_rules(spark, sf_dir):
    """Which documents contain which words, names and first letters of the catalogue, as a join with a table of keywords."""
    name = F.lower("description")
    words = views.catalogue(spark, sf_dir).select(F.explode(F.concat(F.split(name, " "), F.array(name, F.left(name, F.lit(2))))).alias("keyword"))
    return rules.containing(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), words)


PROFILED = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "events": "event_id ts user_id event_type value props"}


def _profiles(spark, sf_dir):
    each = [profiles.kinds(table(spark, sf_dir, t).select(*c.split())).withColumn("table_name", F.lit(t)) for t, c in PROFILED.items()]
    return each[0].union(each[1]).union(each[2]).union(each[3])


def _profile_sql() -> str:
    kind = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{k}'" for k, p in profiles.KINDS.items()) + " WHEN v IS NOT NULL THEN 'text' END"
    values = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS name, CAST({c} AS VARCHAR) AS v FROM {t}" for t, own in PROFILED.items() for i, c in enumerate(own.split()))
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(profiles.NAMES)) + " END"
    return f""", k AS (SELECT table_name, position, name, {kind} AS kind, count(*) AS n FROM ({values}) GROUP BY ALL),
c AS (SELECT table_name, position, name, kind, n AS n_kind, CAST(sum(n) OVER (PARTITION BY table_name, position) AS BIGINT) AS n_values FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY table_name, position ORDER BY n DESC, {order}) = 1) """


@query(_profile_sql() + "SELECT * FROM c")
def column_types(spark, sf_dir):
    return _profiles(spark, sf_dir)


@query(_profile_sql() + "SELECT table_name, sha256(string_agg(name || ':' || kind, ',' ORDER BY position)) AS fingerprint, CAST(count(*) AS INTEGER) AS n_columns FROM c GROUP BY table_name")
def table_fingerprints(spark, sf_dir):
    return profiles.fingerprint(_profiles(spark, sf_dir))


def fuzzy_keywords(spark, sf_dir):
    """Words and names of the catalogue that runs of words of documents come near; no SQL, since it lacks the ratio: tests compare with all runs."""
    name = F.col("description")
    words = views.catalogue(spark, sf_dir).select(F.explode(F.concat(F.split(name, " "), F.array(name))).alias("keyword"))
    return nearly.find(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), words)


def fuzzy_keyword_best(spark, sf_dir):
    return nearly.best(fuzzy_keywords(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (fuzzy_keywords, fuzzy_keyword_best)}


@query(""", s AS (SELECT file_id, list(lower(trim(description)) ORDER BY line_number, description, unit) AS names, list(lower(trim(unit)) ORDER BY line_number, description, unit) AS kinds FROM line_items GROUP BY 1),
p AS (SELECT names, kinds, list_distinct(names) AS words, row_number() OVER () AS p FROM (SELECT DISTINCT names, kinds FROM s)),
f AS (SELECT file_id, p FROM s JOIN p USING (names, kinds)), t AS (SELECT file_id AS template_id, p AS q FROM f JOIN files USING (file_id) WHERE status = 'F'),
e AS (SELECT q, min(template_id) AS template_id FROM t GROUP BY 1), w AS (SELECT p, unnest(words) AS word FROM p),
m AS (SELECT w.p, v.p AS q, count(*) AS shared FROM w JOIN w v USING (word) WHERE w.p NOT IN (SELECT q FROM e) AND v.p IN (SELECT q FROM e) GROUP BY ALL),
c AS (SELECT m.p, m.q, round(shared / (len(x.words) + len(y.words) - shared) * 100 * 0.5::DOUBLE + (100 - abs(len(x.names) - len(y.names)) / greatest(len(x.names), len(y.names)) * 100) * 0.25::DOUBLE
  + CASE WHEN x.names = y.names THEN 100 ELSE 0 END * 0.15::DOUBLE
  + len(list_filter(range(1, least(len(x.kinds), len(y.kinds)) + 1), lambda i: x.kinds[i] = y.kinds[i])) / least(len(x.kinds), len(y.kinds)) * 100 * 0.1::DOUBLE, 6) AS similarity
  FROM m JOIN p x ON x.p = m.p JOIN p y ON y.p = m.q WHERE 2 * shared >= len(x.words) + len(y.words) - shared),
r AS (SELECT p, template_id, similarity, row_number() OVER (PARTITION BY p ORDER BY similarity DESC, template_id) AS place FROM c JOIN t USING (q) WHERE similarity >= 75 QUALIFY place <= 6)
SELECT file_id AS id, template_id, similarity, 'fuzzy' AS match, CAST(place AS INTEGER) AS place FROM f JOIN r USING (p)
UNION ALL SELECT file_id, template_id, 100.0::DOUBLE, 'exact', 1 FROM f JOIN e ON p = q""")
def template_match(spark, sf_dir):
    """Every file as a table whose columns are its lines, named by their description, of the kind of their unit; files of status F are the templates."""
    lines = F.array_sort(F.collect_list(F.struct("line_number", "description", "unit")))
    known = views.files(spark, sf_dir).where("status = 'F'").select("file_id", F.lit(True).alias("known")).distinct()
    # files meet their gathered lines where these are, so that no sheet is sent again
    sheets = views.line_items(spark, sf_dir).groupBy("file_id").agg(lines.alias("l")).join(known, "file_id", "left")
    sheets = stage(sheets.select(F.col("file_id").alias("id"), F.col("l.description").alias("names"), F.col("l.unit").alias("kinds"), "known"), "sheets")
    return profiles.match(sheets, sheets.where("known"))


@query(""", codes AS (SELECT unit || '/' || sec_code AS code, min(lower(description)) AS name, list_distinct(list(split_part(lower(description), ' ', 1))) AS keywords FROM catalogue GROUP BY 1),
texts AS (SELECT DISTINCT master_id AS id, lower(description || ' ' || unit || ' ' || sec_code) AS text FROM catalogue),
x AS (SELECT w AS keyword, unnest([w || ' ' || lower(unit), lower(unit) || ' ' || lower(sec_code)]) AS context FROM (SELECT DISTINCT split_part(lower(description), ' ', 1) AS w, unit, sec_code FROM catalogue WHERE sec_code LIKE '%1')),
n AS (SELECT id, text, code, name, len(list_intersect(list_distinct(string_split(name, ' ')), list_distinct(string_split(text, ' ')))) AS shared, len(list_distinct(string_split(name, ' '))) AS words FROM texts, codes),
h AS (SELECT id, code, count(*) AS hits FROM texts JOIN (SELECT code, unnest(keywords) AS keyword FROM codes) k ON contains(text, k.keyword)
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.keyword = k.keyword AND contains(text, x.context)) GROUP BY 1, 2),
s AS (SELECT id, code, round(CASE WHEN contains(text, name) THEN 0.5::DOUBLE ELSE 0.3::DOUBLE * shared / words END + 0.2::DOUBLE * coalesce(hits, 0), 3) AS score FROM n LEFT JOIN h USING (id, code)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS INTEGER) AS place FROM s WHERE score > 0)
SELECT id, code, score, place FROM r WHERE place <= 3""")
def keyword_codes(spark, sf_dir):
    """The three codes (unit and brand) whose name and keywords fit a catalogue row's text best; some keywords don't count in some company."""
    rows = views.catalogue(spark, sf_dir)
    name, first = F.lower("description"), F.split(F.lower("description"), " ")[0]
    groups = rows.groupBy(F.concat_ws("/", "unit", "sec_code").alias("code")).agg(F.min(name).alias("name"), F.collect_set(first).alias("keywords"))
    contexts = F.array(F.concat_ws(" ", first, F.lower("unit")), F.concat_ws(" ", F.lower("unit"), F.lower("sec_code")))
    excluded = rows.where(F.col("sec_code").like("%1")).select(first.alias("keyword"), F.explode(contexts).alias("context"))
    return rules.scored_codes(rows.select(F.col("master_id").alias("id"), F.concat_ws(" ", "description", "unit", "sec_code").alias("text")), groups, 3, excluded)


@query(""", s AS (SELECT sec_code, list_sort(list(unit_price)) AS v, sum(CAST(unit_price AS DECIMAL(20,8))) AS total FROM line_items WHERE unit_price > 0 GROUP BY 1)
SELECT sec_code, len(v) AS n_prices, v[1] AS min_price, v[len(v)] AS max_price, round(CAST(total AS DOUBLE) / len(v), 2) AS mean_price, round((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2, 2) AS median_price,
  CASE WHEN len(v) >= 4 THEN round(v[len(v) // 4 + 1], 2) END AS p25, CASE WHEN len(v) >= 4 THEN round(v[3 * len(v) // 4 + 1], 2) END AS p75 FROM s""")
def price_statistics_by_code(spark, sf_dir):
    return analytics.price_statistics(views.line_items(spark, sf_dir))


@query(_DIFFS + """, e AS (SELECT project_id, version, item, CASE WHEN price_old > 0 THEN (coalesce(price_new, 0) - price_old) / price_old * 100 END AS p, CASE WHEN quantity_old > 0 THEN (coalesce(quantity_new, 0) - quantity_old) / quantity_old * 100 END AS q FROM d WHERE status NOT IN ('added', 'removed'))
SELECT project_id, version, item, CASE WHEN abs(p) > 5 THEN 'price_changed' WHEN abs(q) > 1 THEN 'quantity_changed' ELSE 'unchanged' END AS change, nullif(p, 0) AS price_diff, nullif(q, 0) AS quantity_diff FROM e""")
def version_changes(spark, sf_dir):
    return catalogue.version_changes(version_diff_items(spark, sf_dir))


@query("""SELECT event_type AS action, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(20,8))) AS DOUBLE) / count(value), 3) AS mean_confidence,
  round(CAST(sum(k) FILTER (WHERE k > 50) AS DOUBLE) / count(*) FILTER (WHERE k > 50), 1) AS mean_distance FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""")
def training_log_means(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return analytics.log_means(table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.col("value").alias("confidence"), F.when(k > 50, k).alias("distance")))


@query("SELECT unit AS type, grouping(unit) = 1 AS is_total, count(*) AS n FROM (SELECT DISTINCT description || ' type' AS synonym, unit FROM catalogue) GROUP BY ROLLUP (unit)")
def synonym_counts(spark, sf_dir):
    return analytics.counts_by_type(views.catalogue(spark, sf_dir).select(F.concat("description", F.lit(" type")).alias("synonym"), "unit").distinct(), "unit")


@query("SELECT *, round(100.0::DOUBLE * (n_auto + n_manual) / n_items, 2) AS rate FROM (SELECT count(*) AS n_items, count(*) FILTER (WHERE method = 'A') AS n_auto, count(*) FILTER (WHERE method = 'R') AS n_manual FROM facts)")
def coded_rate(spark, sf_dir):
    return analytics.coded_rate(views.facts(spark, sf_dir))


@query(""", c AS (SELECT master_id, 'S' || lpad(replace(sec_code, 'Brand#', ''), 2, '0') || '-' || upper(split_part(description, ' ', 2)) || CASE master_id % 4 WHEN 0 THEN '-' || unit WHEN 1 THEN '-M' || CAST(100 + master_id % 300 AS VARCHAR) WHEN 2 THEN '' ELSE '-m' END
  || '-' || lpad(CAST(master_id % 10000 AS VARCHAR), 4, '0') AS work_code FROM catalogue),
p AS (SELECT master_id, work_code, string_split(work_code, '-') AS x, regexp_full_match(work_code, 'S[0-9]{2}-[A-Z]+-(([A-Z]+|M[0-9]{2,3})-)?[0-9]{4}') AS valid FROM c)
SELECT master_id, work_code, valid, CASE WHEN valid THEN x[1] END AS section, CASE WHEN valid THEN x[2] END AS category, CASE WHEN valid AND len(x) = 4 AND NOT regexp_matches(x[3], '[0-9]') THEN x[3] END AS part,
  CASE WHEN valid AND len(x) = 4 AND regexp_matches(x[3], '[0-9]') THEN x[3] END AS grade, CASE WHEN valid THEN CAST(x[len(x)] AS INTEGER) END AS sequence FROM p""")
def work_code_parts(spark, sf_dir):
    """Work codes made of a catalogue row's brand, word, unit or grade and number; those with a small letter are none."""
    i = F.col("master_id")
    middle = F.when(i % 4 == 0, F.concat(F.lit("-"), "unit")).when(i % 4 == 1, F.concat(F.lit("-M"), (100 + i % 300).cast("string"))).when(i % 4 == 2, F.lit("")).otherwise(F.lit("-m"))
    head = F.concat(F.lit("S"), F.lpad(F.replace("sec_code", F.lit("Brand#"), F.lit("")), 2, "0"), F.lit("-"), F.upper(F.split("description", " ")[1]))
    rows = views.catalogue(spark, sf_dir).select("master_id", F.concat(head, middle, F.lit("-"), F.lpad((i % 10000).cast("string"), 4, "0")).alias("work_code"))
    return rows.withColumn("parts", codes.work_code_parts("work_code")).select("master_id", "work_code", F.col("parts").isNotNull().alias("valid"), "parts.*")


_SURE = {"pipework": ["pipe", "valve"], "fixings": ["bolt economy", "nut economy"]}
_LIKELY = {"finishing": ["red", "blue", "green"], "fixings": ["bolt", "nut", "screw", "rod"], "plant": ["large", "widget", "gear"]}


@query(", t AS (SELECT master_id, lower(description || ' ' || unit) AS x FROM catalogue), n AS (SELECT master_id, x, "
       + ", ".join(" + ".join(f"CAST(contains(x, '{w}') AS INTEGER)" for w in words) + f" AS {name}" for name, words in _LIKELY.items())
       + " FROM t) SELECT master_id, CASE " + " ".join(f"WHEN {' OR '.join(f"contains(x, '{w}')" for w in words)} THEN '{name}'" for name, words in _SURE.items())
       + " WHEN greatest(finishing, fixings, plant) = 0 THEN 'GENERAL' " + " ".join(f"WHEN {name} = greatest(finishing, fixings, plant) THEN '{name}'" for name in _LIKELY) + " END AS category FROM n")
def work_categories(spark, sf_dir):
    rows = views.catalogue(spark, sf_dir).withColumn("text", F.concat_ws(" ", "description", "unit"))
    return rows.select("master_id", codes.work_category("text", _SURE, _LIKELY).alias("category"))
