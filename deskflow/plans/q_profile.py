"""Source/sink and corpus-profiling queries (#1-#3, #10-#27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stopwords import english_stop_words
from ..operators import profile as PR
from ..session import scratch_path
from ..sources import files as FL
from ..sources import fixtures as FX
from ..sources.tables import read_table, scan_parquet, table_path
from . import sqlgen as G
from .oracle_fixtures import with_fixtures
from .registry import query

_f = G.feature_sql("instruction")
ENG_CTE = "eng AS (SELECT id, instruction, intent, category, " + ", ".join(
    f"{v} AS {k}" for k, v in _f.items()) + " FROM corpus)"
ENG2_CTE = ENG_CTE + f", eng2 AS (SELECT *, {G.priority_from_urgency('urgency_score')} AS predicted_priority FROM eng)"


def _corpus(spark, sf_dir):
    return FX.corpus(spark, sf_dir)


def _eng(spark, sf_dir):
    return PR.with_engineered(_corpus(spark, sf_dir), "instruction")


@query("scan_parquet", "SELECT * FROM documents")
def q_scan_parquet(spark, sf_dir):
    """#1: load a corpus table from parquet."""
    return scan_parquet(spark, table_path(sf_dir, "documents"))


@query("csv_roundtrip_tickets", with_fixtures() + "SELECT * FROM tickets")
def q_csv_roundtrip_tickets(spark, sf_dir):
    """#2 over tickets: trailing white space, empty strings and NULLs survive."""
    t = FX.tickets(spark, sf_dir)
    path = scratch_path(spark, "csv-tickets")
    FL.write_csv(t, path)
    return FL.read_csv(spark, path, t.schema)


@query("csv_roundtrip", "SELECT * FROM documents")
def q_csv_roundtrip(spark, sf_dir):
    """#2: whole documents written as CSV (header, quoting) and read back."""
    d = read_table(spark, sf_dir, "documents")
    path = scratch_path(spark, "csv")
    FL.write_csv(d, path)
    return FL.read_csv(spark, path, d.schema)


_REPORT_FEATURES = ["text_length", "word_count", "avg_word_length", "urgency_score", "negative_word_count",
                    "positive_word_count", "sentiment_score", "predicted_priority", "has_question", "exclamation_count"]


@query("json_report_roundtrip", with_fixtures() + f"""SELECT 'instruction' AS text_column, 'intent' AS intent_column,
  'category' AS category_column, count(*) AS total_rows, count(DISTINCT instruction) AS unique_texts,
  count(DISTINCT category) AS num_categories, count(DISTINCT intent) AS num_intents,
  '{','.join(_REPORT_FEATURES)}' AS engineered_features FROM corpus""")
def q_json_report_roundtrip(spark, sf_dir):
    """#3: the corpus summary as a nested one-document JSON report, read back."""
    s = PR.corpus_summary(_corpus(spark, sf_dir), "instruction", "intent", "category")
    rep = s.select(F.struct("text_column", "intent_column", "category_column").alias("columns"),
                   F.struct("total_rows", "unique_texts", "num_categories", "num_intents").alias("counts"),
                   F.array(*[F.lit(x) for x in _REPORT_FEATURES]).alias("engineered_features"))
    path = scratch_path(spark, "report")
    FL.write_json_report(rep, path)
    back = FL.read_json_report(spark, path, rep.schema)
    return back.select("columns.*", "counts.*", F.array_join("engineered_features", ",").alias("engineered_features"))


@query("profile_overview", """SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name,
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
   WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS data_type,
  (SELECT count(*) FROM documents) AS rows, 5 AS columns FROM (DESCRIBE documents)""")
def q_profile_overview(spark, sf_dir):
    """#10: shape and column types of the documents table."""
    return PR.profile_overview(read_table(spark, sf_dir, "documents"))


_NULL_COLS = ["ticket_id", "description", "customer_name", "channel", "region", "status", "true_category",
              "true_intent", "predicted_category", "predicted_priority", "confidence_score", "risk_level",
              "is_triage", "resolution_notes", "created_at", "updated_at", "resolved_at"]


@query("null_counts", with_fixtures() + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM tickets"
    for c in _NULL_COLS))
def q_null_counts(spark, sf_dir):
    """#11: NULLs per column of the ticket view."""
    return PR.null_counts(FX.tickets(spark, sf_dir))


@query("head_rows", with_fixtures() + "SELECT * FROM corpus ORDER BY id LIMIT 3")
def q_head_rows(spark, sf_dir):
    """#12: first three corpus rows."""
    return PR.head_rows(_corpus(spark, sf_dir), "id", 3)


@query("detect_columns", with_fixtures() + "SELECT 'instruction' AS text_column, 'intent' AS intent_column, "
       "'category' AS category_column, count(instruction) AS texts FROM corpus")
def q_detect_columns(spark, sf_dir):
    """#13: detected text/intent/category columns of the corpus."""
    return PR.detect_columns(_corpus(spark, sf_dir))


@query("detect_columns_fallback", """SELECT CASE WHEN avg(length(coalesce(url, 'None'))) >=
  avg(length(coalesce(html, 'None'))) THEN 'url' ELSE 'html' END AS text_column,
  CAST(NULL AS VARCHAR) AS intent_column, CAST(NULL AS VARCHAR) AS category_column,
  CASE WHEN avg(length(coalesce(url, 'None'))) >= avg(length(coalesce(html, 'None'))) THEN count(url) ELSE count(html) END
  AS texts FROM pages""")
def q_detect_columns_fallback(spark, sf_dir):
    """#13 fallback: no known text column in ``pages``; the longest string column wins."""
    return PR.detect_columns(read_table(spark, sf_dir, "pages"))


@query("uniqueness_ratio", with_fixtures() + """SELECT total_texts, unique_texts, uniqueness_ratio,
  CASE WHEN uniqueness_ratio > 80 THEN 'EXCELLENT' WHEN uniqueness_ratio > 50 THEN 'MODERATE' ELSE 'WARNING' END
  AS verdict FROM (SELECT count(*) AS total_texts, count(DISTINCT instruction) AS unique_texts,
  count(DISTINCT instruction) / count(*) * 100 AS uniqueness_ratio FROM corpus)""")
def q_uniqueness_ratio(spark, sf_dir):
    """#14: text uniqueness of the corpus."""
    return PR.uniqueness_ratio(_corpus(spark, sf_dir), "instruction")


@query("distinct_sample", with_fixtures() + """SELECT min(id) AS first_seen, substr(instruction, 1, 100) AS sample
 FROM corpus GROUP BY instruction ORDER BY first_seen LIMIT 5""")
def q_distinct_sample(spark, sf_dir):
    """#15: first five distinct texts, cut to 100 characters."""
    return PR.distinct_sample(_corpus(spark, sf_dir), "instruction", "id")


@query("value_counts_category", with_fixtures() + "SELECT category, count(*) AS count FROM corpus GROUP BY 1")
def q_value_counts_category(spark, sf_dir):
    """#16: category frequencies."""
    return PR.value_counts(_corpus(spark, sf_dir), "category")


@query("value_counts_intent", with_fixtures() + "SELECT intent, count(*) AS count FROM corpus GROUP BY 1")
def q_value_counts_intent(spark, sf_dir):
    """#16: intent frequencies."""
    return PR.value_counts(_corpus(spark, sf_dir), "intent")


@query("value_counts_priority", with_fixtures(ENG2_CTE)
       + "SELECT predicted_priority, count(*) AS count FROM eng2 GROUP BY 1")
def q_value_counts_priority(spark, sf_dir):
    """#16: engineered priority frequencies."""
    return PR.value_counts(_eng(spark, sf_dir), "predicted_priority")


@query("describe_features", with_fixtures(ENG_CTE) + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, {G.py_round(f'avg(CAST({c} AS DOUBLE))', 6)} AS mean,
     {G.py_round(f'stddev_samp(CAST({c} AS DOUBLE))', 6)} AS std, min(CAST({c} AS DOUBLE)) AS min,
     quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50,
     quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, max(CAST({c} AS DOUBLE)) AS max FROM eng"""
    for c in PR.DESCRIBE_FEATURES))
def q_describe_features(spark, sf_dir):
    """#17: descriptive statistics of four engineered features."""
    return PR.describe_features(_eng(spark, sf_dir))


def _hist_sql(expr_name: str, bins: int) -> str:
    return with_fixtures(ENG_CTE) + f""", s AS (SELECT min({expr_name}) AS mn, max({expr_name}) AS mx,
  avg({expr_name}) AS mean FROM eng),
 c AS (SELECT CAST(CASE WHEN s.mx = s.mn THEN {bins // 2}
   ELSE least({bins - 1}, (CAST({expr_name} AS BIGINT) - s.mn) * {bins} // (s.mx - s.mn)) END AS INTEGER) AS bin,
   count(*) AS count FROM eng, s WHERE {expr_name} IS NOT NULL GROUP BY 1),
 b AS (SELECT CAST(unnest(range(0, {bins})) AS INTEGER) AS bin),
 e AS (SELECT b.bin, CASE WHEN s.mx = s.mn THEN s.mn - 0.5 ELSE CAST(s.mn AS DOUBLE) END AS lo_e,
   CASE WHEN s.mx = s.mn THEN s.mx + 0.5 ELSE CAST(s.mx AS DOUBLE) END AS hi_e, s.mean FROM b, s)
 SELECT e.bin, lo_e + e.bin * ((hi_e - lo_e) / {bins}) AS lo, lo_e + (e.bin + 1) * ((hi_e - lo_e) / {bins}) AS hi,
  coalesce(c.count, 0) AS count, {G.py_round('e.mean', 6)} AS mean FROM e LEFT JOIN c USING (bin)"""


@query("histogram_text_length", _hist_sql("text_length", 50))
def q_histogram_text_length(spark, sf_dir):
    """#18: 50-bin histogram of text length."""
    return PR.histogram(_eng(spark, sf_dir), "text_length", 50)


@query("histogram_word_count", _hist_sql("word_count", 30))
def q_histogram_word_count(spark, sf_dir):
    """#18: 30-bin histogram of word count."""
    return PR.histogram(_eng(spark, sf_dir), "word_count", 30)


@query("histogram_sentiment", with_fixtures(ENG_CTE) + """, c AS (SELECT CAST(sentiment_score AS BIGINT) AS value,
  count(*) AS count FROM eng GROUP BY 1),
 v AS (SELECT unnest(range(CAST(min(sentiment_score) AS BIGINT), CAST(max(sentiment_score) AS BIGINT) + 1)) AS value
  FROM eng)
 SELECT v.value, coalesce(c.count, 0) AS count FROM v LEFT JOIN c USING (value)""")
def q_histogram_sentiment(spark, sf_dir):
    """#19: unit-width sentiment histogram, zero-filled."""
    return PR.histogram_unit(_eng(spark, sf_dir), "sentiment_score")


@query("priority_share", with_fixtures(ENG2_CTE) + f"""SELECT predicted_priority, count,
  {G.percent_1dp('count / total')} AS pct FROM (SELECT predicted_priority, count(*) AS count,
  sum(count(*)) OVER () AS total FROM eng2 GROUP BY 1)""")
def q_priority_share(spark, sf_dir):
    """#20: percent of rows per engineered priority."""
    return PR.share(_eng(spark, sf_dir), "predicted_priority")


@query("boxplot_by_category", with_fixtures(ENG_CTE) + """, q AS (SELECT category,
  quantile_cont(CAST(text_length AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(text_length AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST(text_length AS DOUBLE), 0.75) AS q3 FROM eng GROUP BY 1),
 f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
 SELECT f.category, f.q1, f.median, f.q3,
  min(CAST(e.text_length AS DOUBLE)) FILTER (WHERE e.text_length BETWEEN f.lo_f AND f.hi_f) AS whisker_lo,
  max(CAST(e.text_length AS DOUBLE)) FILTER (WHERE e.text_length BETWEEN f.lo_f AND f.hi_f) AS whisker_hi,
  count(*) FILTER (WHERE NOT (e.text_length BETWEEN f.lo_f AND f.hi_f)) AS outliers, count(*) AS count
 FROM eng e JOIN f USING (category) GROUP BY f.category, f.q1, f.median, f.q3""")
def q_boxplot_by_category(spark, sf_dir):
    """#21: text length box plot per category."""
    return PR.boxplot(_eng(spark, sf_dir), "category", "text_length")


@query("urgency_by_category", with_fixtures(ENG_CTE)
       + f"SELECT category, {G.py_round('avg(urgency_score)', 6)} AS mean_urgency_score FROM eng GROUP BY 1")
def q_urgency_by_category(spark, sf_dir):
    """#22: mean urgency per category."""
    return PR.mean_by(_eng(spark, sf_dir), "category", "urgency_score")


def _corr_sql() -> str:
    feats = list(_f.keys())
    parts = []
    for i, a in enumerate(feats):
        for j, b in enumerate(feats):
            if i > j:
                r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
                parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN {r} IS NULL OR isnan({r}) "
                             f"THEN NULL ELSE {G.py_round(r, 6)} END AS r FROM eng")
    return with_fixtures(ENG_CTE) + " UNION ALL ".join(parts)


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf_dir):
    """#23: Pearson correlations of the nine features (lower triangle)."""
    return PR.correlation_matrix(_eng(spark, sf_dir))


def _word_frequency_sql() -> str:
    stop = ", ".join(G.q(w) for w in english_stop_words())
    return f"""SELECT word, count(*) AS count FROM (
  SELECT unnest(string_split({G.clean('text')}, ' ')) AS word FROM documents)
 WHERE length(word) >= 2 AND word NOT IN ({stop}) GROUP BY word ORDER BY count DESC, word LIMIT 150"""


@query("word_frequency", _word_frequency_sql)
def q_word_frequency(spark, sf_dir):
    """#24: 150 most frequent words over all documents (whole texts)."""
    return PR.word_frequency(read_table(spark, sf_dir, "documents"), "text")


@query("crosstab_priority", with_fixtures(ENG2_CTE) + "SELECT category, " + ", ".join(
    f"count(*) FILTER (WHERE predicted_priority = '{p}') AS {p}" for p in PR.PRIORITIES)
    + " FROM eng2 GROUP BY category")
def q_crosstab_priority(spark, sf_dir):
    """#25: category x engineered priority counts."""
    return PR.crosstab(_eng(spark, sf_dir), "category", "predicted_priority")


@query("corpus_summary", with_fixtures() + """SELECT 'instruction' AS text_column, 'intent' AS intent_column,
  'category' AS category_column, count(*) AS total_rows, count(DISTINCT instruction) AS unique_texts,
  count(DISTINCT category) AS num_categories, count(DISTINCT intent) AS num_intents FROM corpus""")
def q_corpus_summary(spark, sf_dir):
    """#26: one-row corpus summary."""
    return PR.corpus_summary(_corpus(spark, sf_dir), "instruction", "intent", "category")


@query("clean_corpus", """SELECT min(doc_id) AS doc_id, text, arg_min(lang, doc_id) AS lang,
  arg_min(source, doc_id) AS source, arg_min(n_chars, doc_id) AS n_chars FROM documents
 WHERE text IS NOT NULL GROUP BY text""")
def q_clean_corpus(spark, sf_dir):
    """#27: documents without NULL or duplicate texts (lowest id kept)."""
    return PR.clean_corpus(read_table(spark, sf_dir, "documents"), "text", "doc_id")
