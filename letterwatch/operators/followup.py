"""Follow-up queue: selection, rendering, links, status."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from ..functions.frames import share
from ..functions.text import blank_if_null, compact_labels
from ..templates import FALLBACK_KIND, TEMPLATES
from .anomaly import one_decimal
from .normalize import format_mail_date, name_from_address


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def followup_select(df: DataFrame, levels=("High", "Medium"), departments=None, anomalous: bool = False) -> DataFrame:
    rows = df.where(F.col("risk_level").isin(list(levels))) if levels else df
    rows = rows.where(F.col("department").isin(list(departments))) if departments else rows
    rows = rows.where("is_anomaly") if anomalous and "is_anomaly" in df.columns else rows
    wanted = ["mail_id", "sender", "time", "subject", "recipients", "email_domain", "risk_level", "risk_score", "department",
              "attachments", "ip_keywords_detected", "is_after_hours", "is_leaver", "has_attachments", "recipient_count",
              "email_domain_type", "has_new_domain", "has_burst_pattern"]
    return rows.select(*[c for c in wanted if c in df.columns])


def followup_queue(selection: DataFrame, selected_at, queue: DataFrame | None = None) -> DataFrame:
    """Append a selection to the queue; the id is derived from mail and selection time, so a rerun gives the same id."""
    at = selected_at if isinstance(selected_at, Column) else F.lit(selected_at)
    fresh = selection.withColumn("selected_at", at.cast("timestamp")).withColumn(
        "selection_id", F.concat(F.lit("evt_"), F.hex(F.xxhash64("mail_id", "selected_at"))))
    return fresh if queue is None else queue.unionByName(fresh, allowMissingColumns=True)


def followup_reasons(df: DataFrame, domain_type_col: str = "email_domain_type") -> Column:
    kind = F.col(domain_type_col) if domain_type_col in df.columns else F.lit("")
    score = F.coalesce(F.col("risk_score"), F.lit(0))
    found = F.array_join(compact_labels(
        (_flag(df, "is_after_hours"), "Email sent outside business hours"),
        (_flag(df, "is_leaver"), "Sent within 7 days of employee's last working day"),
        (_flag(df, "has_attachments"), "Contains attachments"),
        (_flag(df, "has_new_domain"), "Sent to new external domain"),
        (_flag(df, "has_burst_pattern"), "Part of high-volume email burst"),
        (kind == "free", "Sent to free email provider"), (kind == "public", "Sent to external domain"),
        (score >= V.HIGH_CUT, "High risk score calculated"),
        ((score >= V.MEDIUM_CUT) & (score < V.HIGH_CUT), "Medium risk score calculated"),
        (F.col("recipient_count") > 10,
         F.concat(F.lit("Large number of recipients ("), F.col("recipient_count").cast("string"), F.lit(")")))), "; ")
    return F.when(found == "", "General security review").otherwise(found)


def _fill(template: Column, values) -> Column:
    return reduce(lambda text, kv: F.replace(text, F.lit(kv[0]), kv[1]), values, template)


def followup_render(df: DataFrame, kind: Column | str = FALLBACK_KIND, generated_at=None) -> DataFrame:
    """One rendered mail per row; an unknown kind falls back to the security inquiry."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    known = F.when(kind.isin(list(TEMPLATES)), kind).otherwise(FALLBACK_KIND)
    def text(i):
        out = None
        for name, parts in TEMPLATES.items():
            out = F.when(known == name, parts[i]) if out is None else out.when(known == name, parts[i])
        return out
    facts = [("[SENDER_NAME]", name_from_address("sender")), ("[EMAIL_DATE]", format_mail_date("time"))]
    score = one_decimal(F.coalesce(F.col("risk_score"), F.lit(0)))
    level = F.coalesce(F.col("risk_level"), F.lit("Unknown"))
    recipients, subject = F.col("recipients"), F.col("subject")
    subject_values = facts + [("[EMAIL_SUBJECT]", blank_if_null(subject)), ("[RISK_SCORE]", score), ("[RISK_LEVEL]", level)]
    body_values = facts + [("[RECIPIENTS]", blank_if_null(recipients)), ("[EMAIL_SUBJECT]", blank_if_null(subject)),
                           ("[RISK_SCORE]", score), ("[RISK_LEVEL]", level), ("[RISK_FACTORS]", followup_reasons(df))]
    return df.select(
        "mail_id", F.col("sender").alias("recipient"), _fill(text(0), subject_values).alias("subject"),
        _fill(text(1), body_values).alias("body"), kind.alias("template_type"),
        (F.lit(generated_at) if not isinstance(generated_at, Column) else generated_at).cast("timestamp").alias("generated_at"),
        format_mail_date("time").alias("original_date"), F.col("subject").alias("original_subject"),
        "risk_score", "risk_level", F.lit("Draft").alias("status"), F.lit(False).alias("has_error"))


def percent_encode(c) -> Column:
    """URL quoting that keeps the slash."""
    out = F.url_encode(blank_if_null(c))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def followup_mailto(recipient="recipient", subject="subject", body="body") -> Column:
    return F.concat(F.lit("mailto:"), percent_encode(recipient), F.lit("?subject="), percent_encode(subject),
                    F.lit("&body="), percent_encode(body))


def followup_summary(mails: DataFrame) -> DataFrame:
    """Long table: totals, errors, success share, mails per level."""
    head = mails.agg(F.count(F.lit(1)).alias("n"), F.count_if("has_error").alias("e")).select(F.inline(F.array(
        *[F.struct(F.lit("total").alias("section"), F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in (
            ("mails", F.col("n")), ("successful", F.col("n") - F.col("e")), ("errors", F.col("e")),
            ("success_pct", share(F.col("n") - F.col("e"), F.col("n"))))])))
    levels = mails.where("NOT has_error").groupBy(F.coalesce("risk_level", F.lit("Unknown")).alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("level").alias("section"), "key", "value")
    return head.unionByName(levels)


def followup_export(mails: DataFrame) -> DataFrame:
    return mails.select("recipient", "subject", "body", "generated_at", "has_error", "original_date", "original_subject",
                        "risk_score", "risk_level")


def template_check(templates: DataFrame) -> DataFrame:
    """Check a table of templates (``subject``, ``body``) for required and unknown placeholders."""
    text = F.concat(blank_if_null("subject"), F.lit(" "), blank_if_null("body"))
    known = V.REQUIRED_PLACEHOLDERS + V.OPTIONAL_PLACEHOLDERS
    found = F.filter(F.array(*[F.lit(p) for p in known]), lambda p: F.contains(text, p))
    missing = F.filter(F.array(*[F.lit(p) for p in V.REQUIRED_PLACEHOLDERS]), lambda p: ~F.contains(text, p))
    names = F.regexp_extract_all(text, F.lit(r"\[([A-Z_]+)\]"), F.lit(1))
    unknown = F.filter(names, lambda n: ~n.isin([p[1:-1] for p in known]))
    return templates.withColumns({
        "valid": F.size(missing) == 0,
        "errors": F.transform(missing, lambda p: F.concat(F.lit("Required placeholder missing: "), p)),
        "warnings": F.transform(unknown, lambda n: F.concat(F.lit("Unknown placeholder: ["), n, F.lit("]"))),
        "placeholders_found": found})


def followup_status(mails: DataFrame) -> DataFrame:
    return mails.groupBy("status").agg(F.count(F.lit(1)).alias("mails"))


def mark_all_sent(mails: DataFrame, sent_at) -> DataFrame:
    return mails.withColumns({"status": F.lit("Sent"), "sent_at": F.lit(sent_at).cast("timestamp")})
