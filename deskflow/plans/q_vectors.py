"""Vector, encoding, split and evaluation queries (#76-#82, #88-#95)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import routing as R
from ..functions import text as X
from ..functions.formatting import py_round
from ..functions.stopwords import english_stop_words
from ..operators import evaluate as EV
from ..operators import vectors as V
from ..sources import fixtures as FX
from ..sources.tables import read_table
from . import sqlgen as G
from .oracle_fixtures import with_fixtures
from .registry import query


def _tfidf_sql(source: str, key: str, terms_sql: str, max_features: int, min_df: int, max_df: float,
               sublinear: bool) -> str:
    tfv = "(1 + ln(p.tf))" if sublinear else "CAST(p.tf AS DOUBLE)"
    return f"""terms AS (SELECT {key} AS k, unnest({terms_sql}) AS term FROM {source}),
pairs AS (SELECT k, term, count(*) AS tf FROM terms GROUP BY 1, 2),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {source}),
dft AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM pairs GROUP BY 1),
vocab AS (SELECT term, df FROM dft, nd WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * n
  ORDER BY cf DESC, term LIMIT {max_features}),
wt AS (SELECT p.k, p.term, {tfv} * (ln((1 + n) / (1 + v.df)) + 1) AS w FROM pairs p JOIN vocab v USING (term), nd),
tfidf AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS weight FROM wt)"""


_CLEAN_TOK = f"list_filter(string_split({G.clean('text')}, ' '), lambda w: length(w) >= 2)"
_DOC_TERMS = (f"(SELECT t || CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), "
              f"lambda i: t[i] || ' ' || t[i + 1]) ELSE []::VARCHAR[] END FROM (SELECT {_CLEAN_TOK} AS t))")
TFIDF_DOCS = _tfidf_sql("documents", "doc_id", _DOC_TERMS, 5000, 2, 0.95, True)


def _doc_tfidf(spark, sf_dir):
    return V.tfidf_weights(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@query("tfidf_weights", "WITH " + TFIDF_DOCS + f"\nSELECT k AS doc_id, term, {G.py_round('weight', 6)} AS weight FROM tfidf")
def q_tfidf_weights(spark, sf_dir):
    """#76: exact TF-IDF of whole documents (1-2-grams, 5000 terms)."""
    w = _doc_tfidf(spark, sf_dir)
    return w.select("doc_id", "term", py_round(F.col("weight"), 6).alias("weight"))


@query("tfidf_top_terms", "WITH " + TFIDF_DOCS + f"""
SELECT term, {G.py_round('sum(weight)', 6)} AS score FROM tfidf GROUP BY term ORDER BY sum(weight) DESC, term LIMIT 20""")
def q_tfidf_top_terms(spark, sf_dir):
    """#77: 20 terms with the largest summed TF-IDF weight."""
    return V.top_terms(_doc_tfidf(spark, sf_dir))


def _stopword_sql(source: str, key: str, text: str) -> str:
    stop = ", ".join(G.q(w) for w in english_stop_words())
    terms = (f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]{{2,}}'), "
             f"lambda w: w NOT IN ({stop}))")
    return (with_fixtures(_tfidf_sql(source, key, terms, 300, 1, 1.0, False))
            + f"SELECT k AS {key}, term, {G.py_round('weight', 6)} AS weight FROM tfidf")


@query("tfidf_stopwords_documents", lambda: _stopword_sql("documents", "doc_id", "text"))
def q_tfidf_stopwords_documents(spark, sf_dir):
    """#78 over whole documents (letters of any script)."""
    w = V.tfidf_stopwords(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return w.select("doc_id", "term", py_round(F.col("weight"), 6).alias("weight"))


@query("tfidf_stopwords", lambda: _stopword_sql("tickets", "ticket_id", "description"))
def q_tfidf_stopwords(spark, sf_dir):
    """#78: 300-term unigram TF-IDF without English stop words."""
    w = V.tfidf_stopwords(FX.tickets(spark, sf_dir), "ticket_id", "description")
    return w.select("ticket_id", "term", py_round(F.col("weight"), 6).alias("weight"))


STRUCT_COLS = ["sentiment", "channel", "region", "customer_segment", "customer_gender"]


def _struct_input(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    return t.select("ticket_id", X.sentiment_lexicon("description").alias("sentiment"), "channel", "region",
                    F.concat(F.lit("segment"), (F.col("ticket_id") % 4).cast("string")).alias("customer_segment"),
                    F.lit("Unknown").alias("customer_gender"))


def _struct_sql() -> str:
    base = (f"si AS (SELECT ticket_id, {G.sentiment_lexicon('description')} AS sentiment, channel, region, "
            f"'segment' || CAST(ticket_id % 4 AS VARCHAR) AS customer_segment, 'Unknown' AS customer_gender "
            f"FROM tickets)")
    codes = ", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'Unknown')) - 1 AS INTEGER) AS {c}_code"
                      for c in STRUCT_COLS)
    return with_fixtures(base) + f"SELECT ticket_id, {', '.join(STRUCT_COLS)}, {codes} FROM si"


@query("structured_features", _struct_sql())
def q_structured_features(spark, sf_dir):
    """#79: five categorical columns label-encoded (alphabetical codes)."""
    return V.structured_features(_struct_input(spark, sf_dir), STRUCT_COLS)


@query("structured_features_unseen", with_fixtures("si AS (SELECT ticket_id, channel FROM tickets)") + """SELECT
  CAST(coalesce((SELECT code FROM (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM
   (SELECT DISTINCT coalesce(channel, 'Unknown') AS value FROM si)) WHERE value = 'Unknown'), 0) AS INTEGER)
  AS channel_code""")
def q_structured_features_unseen(spark, sf_dir):
    """#79 serving side: the 'Unknown' channel sent at prediction time is not a
    fitted class, so it takes the first class's code (0)."""
    t = FX.tickets(spark, sf_dir)
    codes = V.fit_label_codes(t, ["channel"])
    req = t.select(F.lit("Unknown").alias("channel")).distinct()
    return req.select(V.encode("channel", codes).alias("channel_code"))


@query("label_encode", with_fixtures() + """SELECT id, category,
  CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS code, category AS decoded FROM corpus""")
def q_label_encode(spark, sf_dir):
    """#81: alphabetical label codes and their inverse."""
    return V.label_encode(FX.corpus(spark, sf_dir), "category").select("id", "category", "code", "decoded")


SPLIT_CTE = """sp AS (SELECT id, category, row_number() OVER (PARTITION BY category
  ORDER BY md5('42-' || CAST(id AS VARCHAR)), id) AS rnk, count(*) OVER (PARTITION BY category) AS cs FROM corpus),
split AS (SELECT id, category, rnk, rnk <= (cs * 20 + 99) // 100 AS is_test FROM sp)"""


@query("stratified_split", with_fixtures(SPLIT_CTE) + "SELECT id, category, is_test FROM split")
def q_stratified_split(spark, sf_dir):
    """#82: seeded 80/20 split inside every category."""
    return EV.stratified_split(FX.corpus(spark, sf_dir).select("id", "category"), "category", "id").select("id", "category", "is_test")


@query("kfold_assign", with_fixtures(SPLIT_CTE) + "SELECT id, category, CAST((rnk - 1) % 5 AS INTEGER) AS fold FROM split")
def q_kfold_assign(spark, sf_dir):
    """#95: five stratified, shuffled, seeded folds."""
    return EV.kfold_assign(FX.corpus(spark, sf_dir).select("id", "category"), "category", "id").select("id", "category", "fold")


PRED_CTE = f"""pr2 AS (SELECT ticket_id, label, p, row_number() OVER (PARTITION BY ticket_id ORDER BY p DESC, label) AS rn
 FROM probabilities),
pa AS (SELECT ticket_id, max(CASE WHEN rn = 1 THEN label END) AS predicted, max(p) AS max_p,
  max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END) AS gap FROM pr2 GROUP BY 1)"""
EVAL_CTE = SPLIT_CTE + ",\n" + PRED_CTE + """,
ev AS (SELECT pa.*, s.category AS actual FROM pa JOIN split s ON s.id = pa.ticket_id WHERE s.is_test)"""


@query("predict_argmax", with_fixtures(PRED_CTE)
       + f"SELECT ticket_id, predicted, {G.py_round('max_p')} AS confidence FROM pa")
def q_predict_argmax(spark, sf_dir):
    """#88: top label and confidence from the class probabilities."""
    return EV.predict_argmax(FX.probabilities(spark, sf_dir)).select("ticket_id", "predicted", "confidence")


def _eval_frame(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    split = EV.stratified_split(FX.corpus(spark, sf_dir, t).select("id", "category"), "category", "id").where("is_test")
    pred = EV.predict_argmax(FX.probabilities(spark, sf_dir, t))
    return pred.join(split.select(F.col("id").alias("ticket_id"), F.col("category").alias("actual")), "ticket_id")


_PC = """cc AS (SELECT actual, predicted, count(*) AS n FROM ev GROUP BY 1, 2),
pc0 AS (SELECT coalesce(a.label, p.label) AS label, coalesce(a.support, 0) AS support, coalesce(a.tp, 0) AS tp,
  coalesce(p.npred, 0) AS npred FROM
  (SELECT actual AS label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n END) AS tp FROM cc GROUP BY 1) a
  FULL JOIN (SELECT predicted AS label, sum(n) AS npred FROM cc GROUP BY 1) p ON a.label = p.label),
pc1 AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM pc1)"""


@query("accuracy_f1", with_fixtures(EVAL_CTE, _PC) + f"""SELECT {G.py_round('sum(tp) / sum(support)', 6)} AS accuracy,
  {G.py_round('sum(f1 * support) / sum(support)', 6)} AS f1_weighted FROM pc""")
def q_accuracy_f1(spark, sf_dir):
    """#89: accuracy and weighted F1 of the argmax labels on the test split."""
    return EV.accuracy_f1(_eval_frame(spark, sf_dir))


_REPORT_SQL = f"""SELECT label, {G.py_round('precision', 6)} AS precision,
  {G.py_round('recall', 6)} AS recall, {G.py_round('f1', 6)} AS f1, CAST(support AS BIGINT) AS support FROM pc
 UNION ALL SELECT 'macro avg', {G.py_round('avg(precision)', 6)}, {G.py_round('avg(recall)', 6)}, {G.py_round('avg(f1)', 6)},
  CAST(sum(support) AS BIGINT) FROM pc
 UNION ALL SELECT 'weighted avg', {G.py_round('sum(precision * support) / sum(support)', 6)},
  {G.py_round('sum(recall * support) / sum(support)', 6)}, {G.py_round('sum(f1 * support) / sum(support)', 6)},
  CAST(sum(support) AS BIGINT) FROM pc"""


@query("classification_report", with_fixtures(EVAL_CTE, _PC) + _REPORT_SQL)
def q_classification_report(spark, sf_dir):
    """#90: per-class precision/recall/F1/support with macro and weighted rows."""
    return EV.classification_report(_eval_frame(spark, sf_dir))


_MATRIX_SQL = """, cc AS (SELECT actual, predicted, count(*) AS n FROM ev GROUP BY 1, 2),
 lab AS (SELECT actual AS l FROM cc UNION SELECT predicted FROM cc)
 SELECT a.l AS actual, b.l AS predicted, coalesce(cc.n, 0) AS count FROM lab a, lab b
 LEFT JOIN cc ON cc.actual = a.l AND cc.predicted = b.l"""


@query("confusion_matrix", with_fixtures(EVAL_CTE) + _MATRIX_SQL)
def q_confusion_matrix(spark, sf_dir):
    """#91: zero-filled confusion matrix on the test split."""
    return EV.confusion_matrix(_eval_frame(spark, sf_dir))


def _histogram_sql(threshold: float) -> str:
    return f""", s AS (SELECT min(max_p) AS mn, max(max_p) AS mx FROM ev),
 c AS (SELECT CAST(CASE WHEN s.mx = s.mn THEN 25 ELSE least(49, floor((max_p - s.mn) / (s.mx - s.mn) * 50)) END
  AS INTEGER) AS bin, count(*) AS count FROM ev, s GROUP BY 1),
 b AS (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin)
 SELECT b.bin, s.mn + b.bin * ((s.mx - s.mn) / 50) AS lo, s.mn + (b.bin + 1) * ((s.mx - s.mn) / 50) AS hi,
  coalesce(c.count, 0) AS count, {threshold}::DOUBLE AS threshold FROM b CROSS JOIN s LEFT JOIN c USING (bin)"""


@query("confidence_histogram", with_fixtures(EVAL_CTE) + _histogram_sql(0.5))
def q_confidence_histogram(spark, sf_dir):
    """#92: 50-bin histogram of the top probability on the test split."""
    return EV.confidence_histogram(_eval_frame(spark, sf_dir))


def _low_sql(threshold: float) -> str:
    return f"""SELECT
  {G.py_round(f'avg(CASE WHEN max_p < {threshold} THEN 1.0 ELSE 0.0 END) * 100', 6)} AS low_confidence_pct,
  {G.py_round('avg(CASE WHEN gap < 0.15 THEN 1.0 ELSE 0.0 END) * 100', 6)} AS ambiguous_pct FROM ev"""


@query("low_confidence_rates", with_fixtures(EVAL_CTE) + _low_sql(0.5))
def q_low_confidence_rates(spark, sf_dir):
    """#93: low-confidence and ambiguous shares on the test split."""
    return EV.low_confidence_rates(_eval_frame(spark, sf_dir))


@query("risk_distribution", with_fixtures(EVAL_CTE) + f""", rk AS (SELECT CASE
  WHEN (1 - max_p) * 0.6::DOUBLE + (1 - least(gap * 2, 1.0::DOUBLE)) * 0.4::DOUBLE > 0.6 THEN 'High'
  WHEN (1 - max_p) * 0.6::DOUBLE + (1 - least(gap * 2, 1.0::DOUBLE)) * 0.4::DOUBLE > 0.35 THEN 'Medium'
  ELSE 'Low' END AS risk_level FROM ev)
 SELECT risk_level, count(*) AS count, {G.py_round('count(*) / sum(count(*)) OVER () * 100', 6)} AS pct
 FROM rk GROUP BY 1""")
def q_risk_distribution(spark, sf_dir):
    """#94: formula risk levels on the test split."""
    return EV.risk_distribution(_eval_frame(spark, sf_dir))


# The intent side of the evaluation: the department probabilities as intent
# probabilities (#41's map), judged by the intent threshold.
def _intent_case() -> str:
    return "CASE label " + " ".join(f"WHEN {G.q(d)} THEN {G.q(i)}" for d, i in L.DEPARTMENT_INTENT) + \
        " ELSE regexp_replace(lower(label), '[^a-z]+', '_', 'g') || '_request' END"


INTENT_CTE = f"""ip AS (SELECT ticket_id, {_intent_case()} AS label, p FROM probabilities),
ip2 AS (SELECT ticket_id, label, p, row_number() OVER (PARTITION BY ticket_id ORDER BY p DESC, label) AS rn FROM ip),
ipa AS (SELECT ticket_id, max(CASE WHEN rn = 1 THEN label END) AS predicted, max(p) AS max_p,
  max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END) AS gap FROM ip2 GROUP BY 1),
ev AS (SELECT ipa.*, c.intent AS actual FROM ipa JOIN split s ON s.id = ipa.ticket_id JOIN corpus c ON c.id = s.id
  WHERE s.is_test)"""


def _intent_frame(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    c = FX.corpus(spark, sf_dir, t)
    test = EV.stratified_split(c.select("id", "category", "intent"), "category", "id").where("is_test")
    probs = FX.probabilities(spark, sf_dir, t).withColumn("label", R.intent_from_department(F.col("label")))
    return EV.predict_argmax(probs).join(test.select(F.col("id").alias("ticket_id"), F.col("intent").alias("actual")), "ticket_id")


@query("classification_report_intent", with_fixtures(SPLIT_CTE, INTENT_CTE, _PC) + _REPORT_SQL)
def q_classification_report_intent(spark, sf_dir):
    """#90 for intents."""
    return EV.classification_report(_intent_frame(spark, sf_dir))


@query("confusion_matrix_intent", with_fixtures(SPLIT_CTE, INTENT_CTE) + _MATRIX_SQL)
def q_confusion_matrix_intent(spark, sf_dir):
    """#91 for intents."""
    return EV.confusion_matrix(_intent_frame(spark, sf_dir))


@query("confidence_histogram_intent", with_fixtures(SPLIT_CTE, INTENT_CTE) + _histogram_sql(0.4))
def q_confidence_histogram_intent(spark, sf_dir):
    """#92 for intents (threshold 0.4)."""
    return EV.confidence_histogram(_intent_frame(spark, sf_dir), threshold=L.INTENT_CONFIDENCE_THRESHOLD)


@query("low_confidence_rates_intent", with_fixtures(SPLIT_CTE, INTENT_CTE) + _low_sql(0.4))
def q_low_confidence_rates_intent(spark, sf_dir):
    """#93 for intents (threshold 0.4)."""
    return EV.low_confidence_rates(_intent_frame(spark, sf_dir), threshold=L.INTENT_CONFIDENCE_THRESHOLD)
