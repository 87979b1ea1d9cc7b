"""Queries that fit models, which no SQL states, or run streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics, ml, split
from ..sources.shared import materialised, shared_dir
from ..sources.tables import table
from ..streaming import jobs
from .registry import query


def _labelled(spark, d):
    """Labelled texts with their split, which is dealt by the ids; texts are joined once."""
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    dealt = split.stratified_split(table(spark, d, "documents").select("doc_id").distinct().join(labels, "doc_id"), "label", "doc_id", [("train", 0.8), ("test", 0.2)])
    return materialised(table(spark, d, "documents").select("doc_id", "text").join(dealt, "doc_id"))


def _fitted(spark, d, kind):
    rows = _labelled(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    features = ml.TextFeatures().fit(train, "text")
    test = materialised(features.transform(test).select("doc_id", "label", "features"))
    return features, ml.select_model(kind, materialised(features.transform(train).select("doc_id", "label", "features"))), test


def _metrics(kind):
    def run(spark, d):
        _, model, test = _fitted(spark, d, kind)
        best = max(range(len(model.avgMetrics)), key=lambda i: model.avgMetrics[i])
        return ml.report(ml.decision(model.bestModel, test)).withColumns({"cv_f1": F.round(F.lit(model.avgMetrics[best]), 6), "cv_f1_std": F.round(F.lit(float(model.stdMetrics[best])), 6)})

    query(None, f"{kind}_metrics")(run)


for _kind in ("svc", "logreg", "rf", "gbt"):
    _metrics(_kind)


@query()
def top_features(spark, d):
    """Heaviest terms of the linear model on both sides."""
    features, model, _ = _fitted(spark, d, "logreg")
    return ml.top_features(features, model.bestModel.stages[-1].coefficients.toArray(), spark)


@query()
def kmeans_eval(spark, d):
    """Purity and agreement of k-means clusters for three k."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    out = None
    for k in (2, 3, 5):
        c = ml.kmeans(e, k)
        row = metrics.purity(c, "cluster", "label").crossJoin(metrics.agreement(c, "cluster", "label")).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


def _folder(spark, name):
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


@query("SELECT DISTINCT concat_ws('|', user_id, event_type, CAST(ts AS DATE)) AS key, user_id, event_type FROM events")
def stream_dedup(spark, d):
    """First event of each user, type and day of the event stream."""
    s = jobs.events_stream(spark, d).withColumn("key", F.concat_ws("|", "user_id", "event_type", F.to_date("ts")))
    return jobs.run_once(jobs.first_of_key(s, "key", "2 days"), _folder(spark, "dedup")).select("key", "user_id", "event_type")


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_tumbling(spark, d):
    """Daily counts and sums by event type, as the stream closes its days."""
    return jobs.run_once(jobs.tumbling(jobs.events_stream(spark, d)), _folder(spark, "tumbling")).select("start", "event_type", "n", F.round("total", 6).alias("total"))
