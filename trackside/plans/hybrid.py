"""Find the message that answers a question, then summarise what the cars did right after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside import constants as K
from trackside.functions.scalars import iso_micros, percent_text
from trackside.operators.interval import Measure, interval_aggregate
from trackside.operators.textsearch import tfidf_match
from trackside.session import materialise

_DETAIL = ["date", "driver_number", "category", "flag"]


def hybrid_search(
    questions: DataFrame,
    messages: DataFrame,
    drivers: DataFrame,
    telemetry: DataFrame,
    *,
    question_id: str = "question_id",
    after_seconds: float = K.EVENT_WINDOW_SECONDS,
    min_score: float = K.MIN_RELEVANCE,
    **corpus,
) -> DataFrame:
    """Answers for any number of (``question_id``, session_key, question) rows in one plan.

    Equal messages of a session are one document that counts as often as it occurs; the
    earliest of them is the one reported. The distinct messages and the hits are written to
    the shared folder, because several branches read them.
    """
    order = [part for c in _DETAIL for part in (F.col(c).isNull(), F.col(c))]
    texts = (
        messages.where(F.col("message").isNotNull())
        .groupBy("session_key", "message")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min_by(F.struct(*_DETAIL), F.struct(*order)).alias("_detail"),
        )
        .select("session_key", "message", F.md5("message").alias("message_id"), "copies", "_detail.*")
    )
    texts = materialise(texts, "messages")
    found = tfidf_match(
        questions,
        texts,
        q_id=question_id,
        q_text="question",
        id="message_id",
        text="message",
        order=["date"],
        by=["session_key"],
        min_score=min_score,
        copies="copies",
        unique=True,
        **corpus,
    )
    found = materialise(found, "found")
    place = ["session_key", "message_id"]
    # One message for each question is looked up: the others are left where they are.
    answering = texts.drop("copies").join(found.select(*place).distinct(), place, "left_semi")
    detailed = found.join(answering, place, "left")
    names = drivers.select(
        "driver_number", F.format_string("%s (%s)", "full_name", "team_name").alias("_named")
    )
    hits = detailed.join(names, "driver_number", "left").withColumn(
        "_driver", F.when(F.col("matched") & (F.col("driver_number") != 0), F.col("driver_number"))
    )
    # One row per question from here on: kept, so that the search is not run once per branch.
    hits = materialise(hits, "hits")
    clock = {
        "event_ts": "date",
        "series_ts": "date",
        "after_seconds": after_seconds,
        "few_events": True,
    }
    own = interval_aggregate(
        hits.where(F.col("_driver").isNotNull()),
        telemetry,
        by=["session_key", "driver_number"],
        measures=[Measure("avg_speed", "avg", "speed"), Measure("max_rpm", "max", "rpm"), Measure("min_gear", "min", "n_gear")],
        **clock,
    )
    field = interval_aggregate(
        hits.where(F.col("_driver").isNull() & F.col("matched")),
        telemetry,
        by=["session_key"],
        measures=[Measure("avg_speed", "avg", "speed"), Measure("min_speed", "min", "speed")],
        **clock,
    )
    rest = hits.where(~F.col("matched"))
    rows = own.unionByName(field, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)
    return _answers(rows, question_id)


def _answers(rows: DataFrame, question_id: str) -> DataFrame:
    hit = F.col("matched")
    about = F.when(F.col("_driver").isNull(), F.lit("all cars")).otherwise(F.coalesce("_named", F.lit("N/A")))
    summary = F.when(
        F.col("avg_speed").isNull(), F.lit("no telemetry in the window")
    ).when(
        F.col("_driver").isNotNull(),
        F.format_string(
            "average speed %.1f km/h, top rpm %d, lowest gear %d",
            F.round("avg_speed", 1),
            F.col("max_rpm").cast("bigint"),
            F.col("min_gear").cast("bigint"),
        ),
    ).otherwise(
        F.format_string(
            "field average speed %.1f km/h, lowest %.1f km/h",
            F.round("avg_speed", 1),
            F.round(F.col("min_speed").cast("double"), 1),
        )
    )
    answer = (
        F.when(F.col("message_id").isNull(), F.lit("No messages were recorded for this session."))
        .when(
            ~hit,
            F.concat(
                F.lit("No relevant message was found. Closest ("),
                percent_text(F.col("score")),
                F.lit("): "),
                F.col("message"),
            ),
        )
        .otherwise(
            F.concat_ws(
                "\n",
                F.concat(F.lit("Message: "), F.col("message")),
                F.concat(F.lit("Time: "), iso_micros(F.col("date"))),
                F.concat(
                    F.lit("Category: "), F.coalesce("category", F.lit("N/A")), F.lit(" | Flag: "), F.coalesce("flag", F.lit("N/A"))
                ),
                F.concat(F.lit("About: "), about),
                F.concat(F.lit("Relevance: "), percent_text(F.col("score"))),
                F.concat(F.lit("Telemetry: "), summary),
            )
        )
    )

    def shown(column):
        return F.when(hit, column)

    return rows.select(
        "session_key",
        question_id,
        "question",
        F.coalesce("score", F.lit(0.0)).alias("relevance"),
        answer.alias("answer"),
        shown(F.col("message")).alias("message"),
        shown(iso_micros(F.col("date"))).alias("date"),
        shown(F.col("category")).alias("category"),
        shown(F.col("flag")).alias("flag"),
        shown(F.col("driver_number")).alias("driver_number"),
        shown(F.when(F.col("_driver").isNotNull(), F.coalesce("_named", F.lit("N/A"))).otherwise("N/A")).alias(
            "driver_name"
        ),
        F.round("avg_speed", 1).alias("avg_speed"),
        "max_rpm",
        "min_gear",
        F.round("min_speed", 1).alias("min_speed"),
    )
