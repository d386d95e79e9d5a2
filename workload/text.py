"""Text search over documents with the benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackside.operators.textsearch import ASCII_WORDS, tfidf, tfidf_match
from trackside.plans.hybrid import hybrid_search
from workload.registry import query, table
from workload.serving import RacingViews, over_views

# A short list of our own, so that the SQL can state it too.
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "it", "that", "for", "on", "with", "as", "was", "at", "by", "an"]
CORPUS = {"stop_words": STOP_WORDS, "token_pattern": ASCII_WORDS}
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens_sql(source: str, keys: str, text: str = "text") -> str:
    return (
        f"SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), "
        f"'{ASCII_WORDS}')) AS term FROM {source}) WHERE term NOT IN ({_STOP_SQL}) GROUP BY ALL"
    )


_WEIGHTS = f"""
    tf AS ({_tokens_sql('documents', 'doc_id')}),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM df),
    w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
    u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
"""


@query(f"WITH {_WEIGHTS} SELECT doc_id, term, round(weight, 8) AS weight FROM u")
def tfidf_weights(spark, sf_dir):
    weights = tfidf(table(spark, sf_dir, "documents"), id="doc_id", text="text", **CORPUS)
    return weights.withColumn("weight", F.round("weight", 8))


@query(
    f"""
    WITH {_WEIGHTS},
    qtf AS ({_tokens_sql('benchmark', 'item_id')}),
    qw AS (SELECT item_id, term, tf * idf AS w FROM qtf JOIN idf USING (term)),
    qu AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM qw),
    s AS (SELECT item_id, doc_id, round(sum(qu.weight * u.weight), 12) AS score FROM qu JOIN u USING (term) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s)
    SELECT q.item_id, coalesce(b.doc_id, (SELECT min(doc_id) FROM documents)) AS doc_id,
           round(coalesce(b.score, 0.0), 8) AS score, coalesce(b.score, 0.0) >= 0.02 AS matched
    FROM benchmark q LEFT JOIN b ON b.item_id = q.item_id AND b.rn = 1
    """
)
def tfidf_top_match(spark, sf_dir):
    found = tfidf_match(
        table(spark, sf_dir, "benchmark"),
        table(spark, sf_dir, "documents"),
        q_id="item_id",
        q_text="text",
        id="doc_id",
        text="text",
        order=["doc_id"],
        **CORPUS,
    )
    return found.select("item_id", "doc_id", F.round("score", 8).alias("score"), "matched")


_HYBRID_HOURS = 6


@query(
    over_views("").rstrip()
    + f""",
    docs AS (SELECT session_key, message, md5(message) AS id, count(*) AS copies, min(date) AS date
             FROM fact_race_control WHERE message IS NOT NULL GROUP BY session_key, message),
    detail AS (SELECT d.*, r.driver_number, r.category, r.flag FROM docs d
               JOIN fact_race_control r ON r.session_key = d.session_key AND r.message = d.message AND r.date = d.date),
    tf AS ({_tokens_sql('detail', 'session_key, id, copies', 'message')}),
    size AS (SELECT session_key, sum(copies) AS n FROM docs GROUP BY session_key),
    idf AS (SELECT session_key, term, ln((1 + n) / (1 + sum(copies))) + 1 AS idf
            FROM tf JOIN size USING (session_key) GROUP BY session_key, term, n),
    w AS (SELECT session_key, id, term, tf * idf AS w FROM tf JOIN idf USING (session_key, term)),
    u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY session_key, id)) AS weight FROM w),
    q AS (SELECT item_id, session_key, text AS question FROM benchmark CROSS JOIN dim_sessions),
    qtf AS ({_tokens_sql('q', 'session_key, item_id', 'question')}),
    qw AS (SELECT session_key, item_id, term, tf * idf AS w FROM qtf JOIN idf USING (session_key, term)),
    qu AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY session_key, item_id)) AS weight FROM qw),
    s AS (SELECT session_key, item_id, id, round(sum(qu.weight * u.weight), 12) AS score
          FROM qu JOIN u USING (session_key, term) GROUP BY session_key, item_id, id),
    b AS (SELECT s.*, row_number() OVER (PARTITION BY s.session_key, item_id ORDER BY score DESC, d.date, s.id) AS rn
          FROM s JOIN docs d USING (session_key, id)),
    opening AS (SELECT session_key, arg_min(id, (date, id)) AS id FROM docs GROUP BY session_key),
    h AS (SELECT q.item_id, q.session_key, coalesce(b.score, 0.0) AS score, coalesce(b.score, 0.0) >= 0.02 AS matched,
                 d.* EXCLUDE (session_key)
          FROM q LEFT JOIN b ON b.session_key = q.session_key AND b.item_id = q.item_id AND b.rn = 1
          LEFT JOIN opening o ON o.session_key = q.session_key
          LEFT JOIN detail d ON d.session_key = q.session_key AND d.id = coalesce(b.id, o.id)),
    near AS (SELECT h.item_id, h.session_key, t.* EXCLUDE (session_key, driver_number), t.driver_number = h.driver_number AS own
             FROM h JOIN fact_car_telemetry t ON t.session_key = h.session_key AND h.matched
              AND t.date BETWEEN h.date AND h.date + INTERVAL {_HYBRID_HOURS} HOURS
              AND (coalesce(h.driver_number, 0) = 0 OR t.driver_number = h.driver_number)),
    seen AS (SELECT item_id, session_key, avg(speed) AS avg_speed, max(rpm) AS max_rpm, min(n_gear) AS min_gear, min(speed) AS min_speed
             FROM near GROUP BY ALL),
    r AS (SELECT h.*, d.full_name || ' (' || d.team_name || ')' AS named, coalesce(h.driver_number, 0) = 0 AS all_cars,
                 round(avg_speed, 1) AS speed, max_rpm, min_gear, round(min_speed, 1) AS slowest
          FROM h LEFT JOIN dim_drivers d ON d.driver_number = h.driver_number
          LEFT JOIN seen ON seen.item_id = h.item_id AND seen.session_key = h.session_key)
    SELECT item_id, session_key, round(score, 8) AS relevance,
      CASE WHEN id IS NULL THEN 'No messages were recorded for this session.'
        WHEN NOT matched THEN 'No relevant message was found. Closest (' || printf('%.2f', score * 100) || '%): ' || message
        ELSE 'Message: ' || message || chr(10) || 'Time: ' || strftime(date, '%Y-%m-%dT%H:%M:%S.%f') || chr(10)
          || 'Category: ' || coalesce(category, 'N/A') || ' | Flag: ' || coalesce(flag, 'N/A') || chr(10)
          || 'About: ' || CASE WHEN all_cars THEN 'all cars' ELSE coalesce(named, 'N/A') END || chr(10)
          || 'Relevance: ' || printf('%.2f', score * 100) || '%' || chr(10) || 'Telemetry: '
          || CASE WHEN speed IS NULL THEN 'no telemetry in the window'
               WHEN all_cars THEN printf('field average speed %.1f km/h, lowest %.1f km/h', speed, slowest::DOUBLE)
               ELSE printf('average speed %.1f km/h, top rpm %d, lowest gear %d', speed, max_rpm, min_gear) END END AS answer,
      CASE WHEN matched THEN message END AS message, CASE WHEN matched THEN strftime(date, '%Y-%m-%dT%H:%M:%S.%f') END AS date,
      CASE WHEN matched THEN category END AS category, CASE WHEN matched THEN flag END AS flag,
      CASE WHEN matched THEN driver_number END AS driver_number,
      CASE WHEN matched THEN CASE WHEN all_cars THEN 'N/A' ELSE coalesce(named, 'N/A') END END AS driver_name, speed AS avg_speed,
      CASE WHEN NOT all_cars THEN max_rpm END AS max_rpm, CASE WHEN NOT all_cars THEN min_gear END AS min_gear,
      CASE WHEN all_cars THEN slowest END AS min_speed
    FROM r
    """
)
def hybrid_answers(spark, sf_dir):
    """Each benchmark item asked about every session, answered with the six hours after the match."""
    v = RacingViews(spark, sf_dir)
    sessions = v["dim_sessions"].agg(F.collect_set("session_key").alias("sessions")).scalar()  # one number a session
    questions = table(spark, sf_dir, "benchmark").select(
        "item_id", F.explode(sessions).alias("session_key"), F.col("text").alias("question")
    )
    found = hybrid_search(
        questions,
        v["fact_race_control"],
        v["dim_drivers"],
        v["fact_car_telemetry"],
        question_id="item_id",
        after_seconds=_HYBRID_HOURS * 3600,
        pruned=True,
        **CORPUS,
    )
    return found.drop("question").withColumn("relevance", F.round("relevance", 8))
