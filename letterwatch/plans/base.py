"""The shared stages that the catalogue queries start from."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.frames import materialize
from ..operators.anomaly import sender_anomalies
from ..operators.bau import bau_scope
from ..operators.content import detect_keywords
from ..operators.domains import classify_domains
from ..operators.normalize import mail_normalize
from ..operators.risk import risk_attach_filtered, risk_level, risk_score
from ..operators.whitelist import whitelist_filter, whitelist_hits
from ..sources.mail_log import dirty_mail_log, whitelist
from ..vocab import LEVELS_SHORT


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return mail_normalize(dirty_mail_log(spark, sf))


def classified(spark, sf) -> DataFrame:
    return classify_domains(normalized(spark, sf))


def scanned(spark, sf) -> DataFrame:
    return detect_keywords(classified(spark, sf))


def scored(spark, sf) -> DataFrame:
    """All mails with score and level."""
    return risk_score(scanned(spark, sf)).withColumn("risk_level", risk_level("risk_score", LEVELS_SHORT))


def page(spark, sf) -> DataFrame:
    """What the report pages see: scored mails without the whitelisted ones."""
    return risk_attach_filtered(scanned(spark, sf), whitelist(spark))


def unscored(spark, sf) -> DataFrame:
    """The same mails as ``page`` for reports that use no score: nothing is counted per sender and no text is scanned."""
    return whitelist_filter(classified(spark, sf), whitelist(spark))


def low_risk(spark, sf) -> DataFrame:
    return bau_scope(page(spark, sf))


def kept(spark, sf) -> DataFrame:
    return whitelist_filter(normalized(spark, sf), whitelist(spark))


def hits(spark, sf) -> DataFrame:
    return whitelist_hits(normalized(spark, sf), whitelist(spark))


RULE_INPUTS = ("mail_id", "sender", "time", "recipient_count", "has_attachments")


def ruled(spark, sf, *columns: str) -> DataFrame:
    """The page frame with the per-sender rules as anomaly flag; the score is minus the rules broken.

    A report that names its ``columns`` gets these and the rules' own inputs; the mails are then written once, for all passes.
    """
    mails = page(spark, sf)
    rules = sender_anomalies(materialize(mails.select(*dict.fromkeys(RULE_INPUTS + columns))) if columns else mails)
    score = -(F.col("time_anomaly").cast("int") + F.col("volume_anomaly").cast("int") + F.col("content_anomaly").cast("int"))
    return rules.withColumns({"is_anomaly": F.col("is_behavioral_anomaly"), "anomaly_score": score.cast("double")})
