"""Checking SQL per catalogue key.  Keys without an entry cannot be stated in SQL."""
from __future__ import annotations

from .. import vocab as V
from ..templates import TEMPLATES
from .oracle_base import (ATT, ATT_SCORE, FREE, RAW_TIME, R_ATTACHMENT, R_CONTENT,
                          R_DOMAIN, R_LEAVER, R_RECIPIENTS, R_VOLUME, TEXT, TIER, any_in, cleaned, d_business, d_category,
                          d_external_risk, d_industry, d_infra, d_internal, d_reasons, d_root, d_same, d_sender_type,
                          d_strict, d_suspicious, d_valid, denan, found_in, hits_of, inlist, joined, k_category, keyword_list,
                          level, lst, q, sql, stamp, trimmed)

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
WORDY = "word_list_match NOT IN ('', '0')"
OUTSIDE = "sender_domain_category <> 'Internal'"
O: dict[str, str] = {}


def pct(a, b):
    return f"round({a} * 100.0 / {b}, 4)"


def group(stage, columns, **extra):
    """Count of rows per combination of (name, expression) pairs."""
    names = ", ".join(f"{e} AS {n}" for n, e in columns)
    return sql(stage, f"SELECT {', '.join(n for n, _ in columns)}, count(*) AS mails FROM (SELECT {names} FROM "
                      f"{extra.pop('source', stage.split()[0])}) GROUP BY ALL", **extra)


# ---- sources ----
O["src_mail_csv"] = group("raw", [("department", "department"), ("bunit", "bunit"), ("subject", "coalesce(subject, '')"),
                                  ("attachments", "coalesce(attachments, '')"), ("has_time", "time IS NOT NULL")])
O["src_mail_any"] = sql("raw", """SELECT 'mail' AS kind, department, bunit, coalesce(subject, '') AS subject, count(*) AS mails FROM raw GROUP BY ALL
 UNION ALL SELECT 'broken', '', '', 'other number of cells', count(*) FROM raw WHERE mail_id % 31 = 0 AND mail_id % 2 = 1 HAVING count(*) > 0
 UNION ALL SELECT 'broken', '', '', 'no header', count(*) FROM raw WHERE mail_id % 37 = 0 HAVING count(*) > 0""")
O["validate_required"] = sql("mail_log", """SELECT 'events' AS source, 25 AS missing, (SELECT count(*) FROM events) AS table_rows
 UNION ALL SELECT 'documents', 25, (SELECT count(*) FROM documents)
 UNION ALL SELECT 'conversations', 25, (SELECT count(*) FROM conversations)
 UNION ALL SELECT 'mail_log', 0, (SELECT count(*) FROM mail_log)""")
DERIVED_WL = """SELECT DISTINCT sender AS email_address, CAST(NULL AS VARCHAR) AS domain FROM mail_log
 WHERE sender_domain = 'eu.corp.example' UNION ALL SELECT DISTINCT NULL, recipient_domain FROM mail_log
 WHERE recipient_domain LIKE '%.org'"""
O["src_whitelist_csv"] = sql("mail_log", "SELECT * FROM w", w=DERIVED_WL)
O["whitelist_append"] = sql("mail_log wl", "SELECT * FROM w UNION SELECT * FROM wl", w=DERIVED_WL)
O["sink_csv"] = sql("hit", f"SELECT mail_id, {stamp('time')} AS time, sender, recipients, coalesce(subject, '') AS subject, "
                           "department, business_unit, whitelist_reason, coalesce(attachments, '') AS attachments, "
                           "coalesce(word_list_match, '') AS word_list_match FROM hit")
O["preview_head"] = sql("mail_log", "SELECT mail_id, sender, recipients, subject FROM mail_log ORDER BY mail_id LIMIT 10")

# ---- normalisation ----
CLEAN = f"""SELECT mail_id, {RAW_TIME} AS time, last_working_day, {denan(trimmed("lower(coalesce(sender, ''))"))} AS sender,
 {denan(trimmed("lower(coalesce(recipients, ''))"))} AS recipients, {denan(trimmed("coalesce(subject, '')"))} AS subject,
 {denan(trimmed("coalesce(word_list_match, '')"))} AS word_list_match, {denan("coalesce(attachments, '')")} AS attachments,
 attachments AS raw_files, recipient_domain FROM raw"""
DAYS = "floor((epoch_us(time) - epoch_us(last_working_day)) / 86400000000.0)"
O["mail_normalize"] = sql("raw", f"""SELECT mail_id, {stamp('time')} AS time, sender, recipients, subject, word_list_match,
 attachments, coalesce(hour(time)::VARCHAR, '-') AS hour, coalesce((isodow(time) - 1)::VARCHAR, '-') AS day_of_week,
 coalesce(hour(time) < 8 OR hour(time) >= 18 OR isodow(time) >= 6, false) AS is_after_hours,
 coalesce(CAST(CAST({DAYS} AS INT) AS VARCHAR), '-') AS days_from_last_working, coalesce({DAYS} BETWEEN -7 AND 7, false) AS is_leaver,
 coalesce(raw_files <> '', false) AS has_attachments,
 {joined("list_sort(list_distinct(regexp_extract_all(coalesce(raw_files, ''), '\\.([a-zA-Z0-9]+)', 1)))")} AS attachment_types,
 len(list_filter(regexp_split_to_array(recipients, '[;,\\s]+'), lambda r: contains(r, '@'))) AS recipient_count,
 recipient_domain AS recipient_domains FROM c""", c=CLEAN)
O["parse_time"] = sql("raw", f"SELECT mail_id, {stamp(RAW_TIME)} AS time, {stamp('last_working_day')} AS last_working_day FROM raw")
MIXED = """SELECT mail_id, ['us', 'eu', 'iso', 'words', 'unclear'][mail_id % 5 + 1] AS file, strftime(last_working_day, '%d/%m/%Y') AS last_working_day,
 CASE WHEN mail_id % 61 = 0 THEN 'no time ' || (mail_id % 3) WHEN mail_id % 67 = 0 THEN ' ' ELSE CASE mail_id % 5
   WHEN 0 THEN [strftime(time, '%-m/%-d/%Y %-H:%M:%S'), strftime(time, '%-m/%-d/%Y %-I:%M %p')][(mail_id // 5) % 2 + 1]
   WHEN 1 THEN [strftime(time, '%d/%m/%Y %H:%M'), strftime(time, '%-d.%-m.%Y %-H:%M:%S')][(mail_id // 5) % 2 + 1]
   WHEN 2 THEN [strftime(time, '%Y-%m-%d %H:%M:%S'), strftime(time, '%Y/%-m/%-d %-H:%M'), strftime(time, '%Y-%m-%dT%H:%M:%S')][(mail_id // 5) % 3 + 1]
   WHEN 3 THEN [strftime(time, '%-d-%b-%Y %H:%M'), strftime(time, '%b %-d, %Y %-I:%M %p'), strftime(time, '%a, %-d %b %Y %H:%M:%S')][(mail_id // 5) % 3 + 1]
   ELSE CASE WHEN day(time) <= 12 THEN strftime(time, '%d-%m-%Y') END END END AS time FROM mail_log"""
# (name of the format, formats with the month in front, formats with the day in front)
DATE_FORMATS = [("ISO", ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"], None), ("yyyy/M/d[ H:mm[:ss]]", ["%Y/%m/%d %H:%M"], None),
                ("M/d/yyyy[ H:mm[:ss]]", ["%m/%d/%Y", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S"], ["%d/%m/%Y", "%d/%m/%Y %H:%M", "%d/%m/%Y %H:%M:%S"]),
                ("M/d/yyyy h:mm[:ss] a", ["%m/%d/%Y %I:%M %p"], ["%d/%m/%Y %I:%M %p"]), ("M-d-yyyy[ H:mm[:ss]]", ["%m-%d-%Y"], ["%d-%m-%Y"]),
                ("M.d.yyyy[ H:mm[:ss]]", ["%m.%d.%Y %H:%M:%S"], ["%d.%m.%Y %H:%M:%S"]), ("d-MMM-yyyy[ H:mm[:ss]]", ["%d-%b-%Y %H:%M"], None),
                ("MMM d, yyyy h:mm[:ss] a", ["%b %d, %Y %I:%M %p"], None), ("d MMM yyyy[ H:mm[:ss]]", ["%a, %d %b %Y %H:%M:%S"], None)]


def _read(which):
    return "coalesce(" + ", ".join(f"try_strptime(text, {q(f)})" for _, m, d in DATE_FORMATS for f in ((d or m) if which else m)) + ")"


NAMED = "CASE " + " ".join("WHEN " + " OR ".join(f"try_strptime(text, {q(f)}) IS NOT NULL" for f in m + (d or [])) + f" THEN {q(n)}" for n, m, d in DATE_FORMATS) + " END"
CELLS = """SELECT mail_id, file, 'time' AS "column", trim(time) AS text FROM mixed WHERE trim(time) <> ''
 UNION ALL SELECT mail_id, file, 'last_working_day', trim(last_working_day) FROM mixed WHERE trim(last_working_day) <> ''"""
CELL_READ = f"SELECT *, {_read(0)} AS m, {_read(1)} AS d, {NAMED} AS format FROM cells"
VOTES = """SELECT file, "column", count(*) AS cells, count(*) FILTER (m IS NULL AND d IS NULL) AS failed, count(*) FILTER (m IS NULL AND d IS NOT NULL) AS day_votes,
 count(*) FILTER (d IS NULL AND m IS NOT NULL) AS month_votes, count(*) FILTER (m <> d) AS either, mode_of AS main_format, count(DISTINCT format) AS formats,
 day_votes > month_votes AS day_first, least(day_votes, month_votes) AS outvoted
 FROM seen JOIN (SELECT file, "column", format AS mode_of FROM seen WHERE format IS NOT NULL GROUP BY file, "column", format QUALIFY row_number() OVER (PARTITION BY file, "column"
   ORDER BY count(*) DESC, format DESC) = 1) USING (file, "column") GROUP BY file, "column", mode_of"""
DATES = {"mixed": MIXED, "cells": CELLS, "seen": CELL_READ, "votes": VOTES}
O["date_votes"] = sql("mail_log", "SELECT * FROM votes", **DATES)
O["date_failures"] = sql("mail_log", """SELECT file, "column", text, count(*) AS cells FROM seen WHERE m IS NULL AND d IS NULL GROUP BY ALL""", **DATES)
O["parse_time_voted"] = sql("mail_log", f"""SELECT mail_id, {stamp('t')} AS time, {stamp('l')} AS last_working_day FROM (SELECT x.mail_id,
 max(CASE WHEN "column" = 'time' THEN v END) AS t, max(CASE WHEN "column" = 'last_working_day' THEN v END) AS l FROM mixed x LEFT JOIN
 (SELECT mail_id, "column", CASE WHEN day_first THEN coalesce(d, m) ELSE coalesce(m, d) END AS v FROM seen JOIN votes USING (file, "column")) USING (mail_id)
 GROUP BY x.mail_id)""", **DATES)
O["clean_text"] = sql("raw", "SELECT mail_id, sender, recipients, subject, word_list_match, attachments FROM c", c=CLEAN)
O["hour_dow"] = group("norm", [("hour", "coalesce(hour(time)::VARCHAR, '-')"), ("day_of_week", "coalesce((isodow(time) - 1)::VARCHAR, '-')")])
O["after_hours_flag"] = group("raw", [("hour", "coalesce(hour(time)::VARCHAR, '-')"), (
    "day_of_week", "coalesce((isodow(time) - 1)::VARCHAR, '-')"), (
    "is_after_hours", "coalesce(hour(time) < 8 OR hour(time) >= 18 OR isodow(time) >= 6, false)")], c=CLEAN, source="c")
O["leaver_flag"] = group("norm", [("days", f"coalesce(CAST(CAST({DAYS} AS INT) AS VARCHAR), '-')"), ("is_leaver", f"coalesce({DAYS} BETWEEN -7 AND 7, false)")])
O["attachment_flag"] = group("raw", [("attachments", "attachments"), ("has_attachments", "coalesce(attachments <> '', false)")])
O["attachment_types"] = group("norm", [("attachments", "attachments"), ("types", joined("attachment_types"))])
O["recipient_count"] = sql("norm", "SELECT mail_id, recipient_count FROM norm")
O["recipient_domains_simple"] = sql("norm", "SELECT mail_id, " + joined(
    "list_sort(list_distinct(regexp_extract_all(recipients, '[\\w.-]+@([\\w.-]+)', 1)))") + " AS domains FROM norm")
O["recipient_domain_wrap"] = sql("norm", "SELECT mail_id, recipient_domain AS domains FROM norm")
O["word_match_score"] = group("norm", [("word_list_match", "word_list_match"), (
    "score", f"CASE WHEN {any_in('word_list_match', V.WORD_MATCH_GROUPS[0][1])} THEN 3 "
             f"WHEN {any_in('word_list_match', V.WORD_MATCH_GROUPS[1][1])} THEN 2 WHEN word_list_match <> '' THEN 1 ELSE 0 END")])
O["attachment_count_bau"] = group("norm", [("attachments", "attachments"), (
    "files", "len(regexp_extract_all(attachments, '\\.[a-zA-Z]+'))")])
CAP = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
NAME = (CAP.format("string_split(string_split(sender, '@')[1], '.')[1]") + " || ' ' || "
        + CAP.format("string_split(string_split(sender, '@')[1], '.')[2]"))
NAME = f"(CASE WHEN contains(sender, '@') THEN {NAME} ELSE 'Colleague' END)"
O["name_from_address"] = sql("norm", f"SELECT mail_id, {NAME} AS name FROM norm")
DATE = "coalesce(strftime(time, '%B %d, %Y at %I:%M %p'), 'Unknown Date')"
O["format_mail_date"] = sql("raw", f"SELECT mail_id, {DATE} AS mail_date FROM c", c=CLEAN)
O["truncate_ellipsis"] = sql("mail_log", """SELECT mail_id, CASE WHEN length(recipients) > 35 THEN left(recipients, 35) || '...'
 ELSE recipients END AS short_recipients, left(subject, 20) || '...' AS short_subject FROM mail_log""")

# ---- domains ----
O["domain_extract"] = sql("raw", """SELECT mail_id, CASE WHEN contains(sender, '@') THEN
 regexp_replace(string_split(lower(sender), '@')[-1], '[^\\w.-]', '', 'g') ELSE '' END AS domain FROM raw""")
O["first_recipient_domain"] = sql("cls", "SELECT mail_id, coalesce(rds[1], '') AS domain FROM cls")
O["recipient_domains"] = sql("cls", f"SELECT mail_id, {joined('rds')} AS domains FROM cls")
HOSTS = """SELECT unnest([sender_domain, recipient_domain, CASE mail_id % 7 WHEN 0 THEN 'a.b.' || sender_domain
 WHEN 1 THEN recipient_domain || '.local' WHEN 2 THEN '10.' || (mail_id % 3) || '.0.1' WHEN 3 THEN 'localhost'
 WHEN 4 THEN '-' || recipient_domain WHEN 5 THEN 'test' || sender_domain ELSE 'x' END]) AS d FROM mail_log"""
for key, name, expr in (("domain_valid", "valid", d_valid("d")), ("root_domain", "root", d_root("d")),
                        ("internal_infra_domain", "infra", d_infra("d")), ("business_domain", "business", d_business("d")),
                        ("domain_strict_type", "kind", d_strict("d")), ("domain_category", "category", d_category("d")),
                        ("domain_industry", "industry", d_industry("d"))):
    O[key] = group("mail_log", [("d", "d"), (name, expr)], h=HOSTS, source="h")
O["suspicious_domain"] = group("mail_log", [("d", "d"), ("suspicious", d_suspicious("d")), ("reasons", d_reasons("d"))],
                               h=HOSTS, source="h")
PAIRS = "SELECT sender_domain AS s, recipient_domain AS r FROM mail_log"
for key, name, expr in (("same_organization", "same", d_same("s", "r")), ("internal_pair", "internal", d_internal("s", "r")),
                        ("sender_domain_type", "kind", d_sender_type("s", "r")),
                        ("external_risk_level", "risk", d_external_risk("s", "r"))):
    O[key] = group("mail_log", [("s", "s"), ("r", "r"), (name, expr)], p=PAIRS, source="p")
TYPES = joined(f"list_transform(rds, lambda d: CASE WHEN d IN {FREE} THEN 'free' ELSE 'business' END)")
O["recipient_domain_types"] = sql("cls", f"SELECT mail_id, {TYPES} AS types FROM cls")
O["external_recipient_count"] = sql("cls", "SELECT mail_id, external_recipient_count AS external FROM cls")
O["internal_flag"] = sql("cls", "SELECT mail_id, is_internal_communication AS internal FROM cls")
O["classify_domains"] = sql("cls", f"""SELECT mail_id, email_domain_type, email_domain_category, email_domain_industry,
 external_recipient_count, is_internal_communication, sender_domain_category, {joined('rds')} AS recipient_domains,
 {TYPES} AS recipient_domain_types FROM cls""")
O["domain_class_summary"] = sql("cls", "SELECT section, value, count(*) AS mails, "
    + pct("count(*)", "(SELECT count(*) FROM cls)") + """ AS pct FROM (
 SELECT 'email_domain_type' AS section, email_domain_type AS value FROM cls
 UNION ALL SELECT 'email_domain_category', email_domain_category FROM cls
 UNION ALL SELECT 'email_domain_industry', email_domain_industry FROM cls
 UNION ALL SELECT 'internal_communication', 'true' FROM cls WHERE is_internal_communication) GROUP BY 1, 2""")
RC = "SELECT recipient_domain AS domain, count(*) AS mails, (SELECT count(*) FROM mail_log) AS total FROM mail_log GROUP BY 1"
O["anomalous_domains"] = sql("mail_log", f"""SELECT domain, mails, 'high_volume' AS type, 'high' AS risk_level,
 {pct('mails', 'total')} AS pct, '' AS reasons FROM c WHERE mails > total * 0.08
 UNION ALL SELECT domain, mails, 'suspicious_pattern', 'medium', NULL, {d_reasons('domain')} FROM c
 WHERE {d_suspicious('domain')}""", c=RC)
O["domain_report"] = sql("mail_log", f"""SELECT domain, mails, {pct('mails', 'total')} AS pct, {d_category('domain')} AS category,
 {d_industry('domain')} AS industry, domain IN {FREE} AS is_free, {d_suspicious('domain')} AS is_suspicious,
 CASE WHEN {d_suspicious('domain')} THEN {d_reasons('domain')} ELSE '' END AS suspicion_reasons FROM c WHERE domain <> ''""", c=RC)
OWN = "(CASE WHEN sender = '' THEN '' ELSE sender_domain END)"
EX = f"SELECT mail_id, time, subject, {OWN} AS s, unnest(rds) AS r FROM cls"
O["sender_domain_stats"] = sql("cls", f"""SELECT sender_domain AS domain, count(*) AS mails, count(DISTINCT subject) AS subjects,
 CASE WHEN sender_domain IN (SELECT s FROM x WHERE {d_internal('s', 'r')}) THEN 'internal' ELSE {d_strict('sender_domain')} END
 AS classification, {d_category('sender_domain')} AS category, {d_industry('sender_domain')} AS industry,
 {d_business('sender_domain')} AS is_business FROM cls WHERE sender <> '' GROUP BY sender_domain""", x=EX)
O["recipient_domain_stats"] = sql("cls", f"""SELECT r AS domain, mails, sender_domains,
 CASE WHEN {d_internal('f', 'r')} THEN 'internal' ELSE {d_strict('r')} END AS classification, {d_category('r')} AS category,
 {d_industry('r')} AS industry, {d_business('r')} AS is_business FROM (SELECT r, count(*) AS mails,
 count(DISTINCT s) AS sender_domains, first(s ORDER BY time, mail_id) AS f FROM x GROUP BY r)""", x=EX)
O["comm_pairs"] = sql("cls", f"""SELECT mail_id, subject, s AS sender_domain, r AS recipient_domain,
 CASE WHEN {d_internal('s', 'r')} THEN 'internal' ELSE 'external' END AS direction,
 CASE WHEN NOT {d_internal('s', 'r')} THEN {d_external_risk('s', 'r')} END AS risk_level FROM x""", x=EX)
O["industry_breakdown"] = sql("cls", f"""SELECT {d_industry('d')} AS industry, count(*) AS domains FROM
 (SELECT sender_domain AS d FROM cls UNION SELECT r FROM x) GROUP BY 1""", x=EX)
O["domain_risk_summary"] = sql("cls", f"""SELECT (SELECT count(*) FROM x WHERE NOT {d_internal('s', 'r')}) AS external_pairs,
 (SELECT count(*) FROM x WHERE {d_internal('s', 'r')}) AS internal_pairs, (SELECT count(DISTINCT r) FROM x) AS recipient_domains,
 count(DISTINCT sender_domain) AS sender_domains,
 count(DISTINCT CASE WHEN {d_business('sender_domain')} THEN sender_domain END) AS business_domains,
 count(DISTINCT CASE WHEN {d_strict('sender_domain')} = 'free' AND sender_domain NOT IN
   (SELECT s FROM x WHERE {d_internal('s', 'r')}) THEN sender_domain END) AS free_domains FROM cls WHERE sender <> ''""", x=EX)
O["domain_type_volume"] = sql("norm", f"""SELECT CASE {d_strict('sender_domain')} WHEN 'free' THEN 'Free Email' WHEN 'internal'
 THEN 'Internal Domain' WHEN 'business' THEN 'Business Domain' ELSE 'Unknown' END AS domain_class, count(*) AS mails
 FROM norm GROUP BY 1""")

# ---- content ----
O["mail_text"] = sql("norm", f"SELECT mail_id, {TEXT} AS text FROM norm")
O["clean_for_keywords"] = sql("kw2", "SELECT mail_id, clean AS text FROM kw2")
TXT = f"""SELECT 'mail ' || mail_id AS ref, {TEXT} AS text FROM norm
 UNION ALL SELECT concat_ws(' ', 'talk', conv_id, turn), lower(text) FROM conversations"""
TXT2 = f"SELECT ref, {cleaned('text')} AS clean FROM t"
O["keyword_hits"] = sql("norm", f"SELECT ref, {joined(keyword_list('clean'))} AS hits FROM u", t=TXT, u=TXT2)
O["keyword_category"] = sql("norm", f"""SELECT keyword, {k_category('keyword')} AS category, count(*) AS mails FROM
 (SELECT unnest({keyword_list('clean')}) AS keyword FROM u) GROUP BY 1, 2""", t=TXT, u=TXT2)
O["pattern_hits"] = sql("norm", f"SELECT mail_id, {hits_of('text')} FROM (SELECT mail_id, {TEXT} AS text FROM norm)")
# other letters than ASCII must not end a word for the checking engine either
FOLD = "regexp_replace(lower(text), '[^[:ascii:]]', '_', 'g')"
O["pattern_hits_documents"] = f"SELECT doc_id, {hits_of('t')} FROM (SELECT doc_id, {FOLD} AS t FROM documents)"
O["keyword_hits_documents"] = f"""WITH d AS (SELECT doc_id, regexp_replace({cleaned('lower(text)')}, '[^\\p{{L}}\\p{{N}} ]', '  ', 'g') AS clean
 FROM documents) SELECT doc_id, {joined(keyword_list('clean'))} AS hits FROM d"""
O["attachment_content_score"] = sql("norm", f"""SELECT attachments, {ATT_SCORE} AS score, array_to_string(list_concat(list_concat(
 list_transform({found_in(ATT, ['.' + t for t in V.SENSITIVE_FILE_TYPES])}, lambda t: 'sensitive_file_type:' || t[2:]),
 list_transform({found_in(ATT, V.SIZE_WORDS)}, lambda w: 'large_attachment:' || w)), list_concat(
 CASE WHEN length({ATT}) - length(replace({ATT}, '.', '')) > 3 THEN ['multiple_attachments:' ||
   (length({ATT}) - length(replace({ATT}, '.', '')))] ELSE [] END,
 list_transform({found_in(ATT, V.ARCHIVE_WORDS)}, lambda w: 'compressed_file:' || w))), ', ') AS factors, count(*) AS mails
 FROM norm GROUP BY ALL""")
O["sensitivity_score"] = sql("kw", "SELECT mail_id, sensitivity_score FROM kw")
O["detect_keywords"] = sql("kw", """SELECT mail_id, has_ip_keywords, ip_keyword_count, detected_keywords, sensitive_patterns_found,
 sensitivity_score FROM kw""")
KC = "SELECT k AS keyword, count(*) AS n FROM (SELECT unnest(hits) AS k FROM kw) GROUP BY 1"
O["keyword_stats"] = sql("kw", """SELECT section, key, round(CAST(value AS DOUBLE), 4) AS value FROM (
 SELECT 'detection' AS section, 'total' AS key, count(*)::DOUBLE AS value FROM kw
 UNION ALL SELECT 'detection', 'flagged', count(*) FILTER (has_ip_keywords) FROM kw
 UNION ALL SELECT 'detection', 'rate_pct', count(*) FILTER (has_ip_keywords) * 100.0 / count(*) FROM kw
 UNION ALL SELECT 'sensitivity', 'mean', avg(sensitivity_score) FROM kw
 UNION ALL SELECT 'sensitivity', 'median', median(sensitivity_score) FROM kw
 UNION ALL SELECT 'sensitivity', 'max', max(sensitivity_score) FROM kw
 UNION ALL SELECT 'sensitivity', 'high_count', count(*) FILTER (sensitivity_score >= 50) FROM kw
 UNION ALL SELECT 'top_keyword', keyword, n FROM (SELECT * FROM kc ORDER BY n DESC, keyword LIMIT 10))""", kc=KC)
CLEVEL = "CASE WHEN sensitivity_score >= 70 THEN 'Critical' WHEN sensitivity_score >= 50 THEN 'High' {0} END"
O["high_risk_content"] = sql("kw", f"""SELECT mail_id, sensitivity_score, {CLEVEL.format("ELSE 'Medium'")} AS content_risk_level
 FROM kw WHERE sensitivity_score >= 30""")
O["keyword_report"] = sql("kw", f"""SELECT 'high_risk' AS section, 'count' AS key, count(*) FILTER (sensitivity_score >= 30)::DOUBLE
 AS value FROM kw UNION ALL SELECT 'high_risk', 'pct', {pct('count(*) FILTER (sensitivity_score >= 30)', 'count(*)')} FROM kw
 UNION ALL SELECT * FROM (SELECT 'pattern', k, count(*)::DOUBLE AS n FROM (SELECT unnest(string_split(sensitive_patterns_found, ', '))
 AS k FROM kw) WHERE k <> '' GROUP BY k ORDER BY n DESC, k LIMIT 5)""")
O["keyword_export"] = sql("kw", f"""SELECT mail_id, {stamp('time')} AS time, sender, recipients, subject, has_ip_keywords,
 ip_keyword_count, detected_keywords, sensitive_patterns_found, sensitivity_score,
 {CLEVEL.format("WHEN sensitivity_score >= 30 THEN 'Medium' ELSE 'Low'")} AS content_risk_category FROM kw""")
O["keyword_dim_edit"] = sql("mail_log", f"""SELECT keyword, {k_category('keyword')} AS category FROM (
 SELECT unnest({lst(V.SENSITIVE_PHRASES)}) AS keyword UNION SELECT lower(trim(unnest(string_split(word_list_match, ', '))))
 FROM mail_log WHERE {WORDY}) WHERE keyword NOT IN (SELECT lower(trim(unnest(string_split(subject, ' ')))) FROM mail_log)""")
WORDS = f"""SELECT * FROM (SELECT sender, bunit, department, unnest(regexp_split_to_array(lower(word_list_match), '[,;|\\s]+')) AS word
 FROM page WHERE {WORDY}) WHERE length(word) > 2"""
O["word_frequencies"] = sql("page", f"""SELECT word, count(*) AS frequency, count(DISTINCT sender) AS senders,
 count(DISTINCT bunit) AS units, {pct('count(*)', '(SELECT count(*) FROM w)')} AS pct FROM w GROUP BY word
 ORDER BY frequency DESC, word LIMIT 20""", w=WORDS)
O["word_freq_bands"] = sql("page", """SELECT count(*) FILTER (n >= 50) AS high_words, count(*) FILTER (n >= 20 AND n < 50)
 AS medium_words, count(*) FILTER (n < 20) AS low_words FROM (SELECT count(*) AS n FROM w GROUP BY word)""", w=WORDS)
CATS = " UNION ALL ".join(f"SELECT {q(c)} AS category, sum(n) AS occurrences FROM c WHERE {any_in('word', ws)}"
                          for c, ws in V.WORD_GROUPS.items())
O["word_categories"] = sql("mail_log", f"SELECT category, CAST(occurrences AS BIGINT) AS occurrences FROM ({CATS}) WHERE occurrences > 0",
    c="""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(concat_ws(';', word_list_match, subject)),
 '[,;|\\s]+')) AS word FROM mail_log WHERE concat_ws(';', word_list_match, subject) NOT IN ('', '0')) WHERE length(word) > 2 GROUP BY 1""")
O["word_breakdown"] = sql("page", f"""SELECT section, name, n, rank, {pct('n', "(SELECT count(*) FROM w WHERE word = 'confidential')")} AS pct
 FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, name) AS rank FROM (
 SELECT 'bunit' AS section, bunit AS name, count(*) AS n FROM w WHERE word = 'confidential' GROUP BY ALL
 UNION ALL SELECT 'department', department, count(*) FROM w WHERE word = 'confidential' GROUP BY ALL)) WHERE rank <= 5""", w=WORDS)


def subject_words(source, top):
    return (f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(subject), '\\w+')) AS word FROM {source}) "
            f"WHERE word NOT IN {inlist(V.STOP_WORDS)} AND length(word) > 2 GROUP BY 1 ORDER BY n DESC, word LIMIT {top}")


O["common_subject_words"] = sql("norm", subject_words("norm", 50))

# ---- whitelist ----
O["whitelist_filter"] = sql("norm reason", "SELECT mail_id, sender, recipients FROM norm WHERE mail_id NOT IN (SELECT mail_id FROM reason)")
O["whitelist_hits"] = sql("hit", "SELECT mail_id, sender, whitelist_reason FROM hit")
O["whitelist_totals"] = sql("norm reason", """SELECT count(*) AS total, (SELECT count(*) FROM reason) AS whitelisted,
 count(*) - (SELECT count(*) FROM reason) AS remaining, round((SELECT count(*) FROM reason) * 100.0 / count(*), 4) AS whitelisted_pct
 FROM norm""")
O["whitelist_reason_counts"] = sql("hit", """SELECT section, name, mails, round(mails * 100.0 / (SELECT count(*) FROM hit), 4) AS pct
 FROM (SELECT 'reason' AS section, whitelist_reason AS name, count(*) AS mails FROM hit GROUP BY ALL UNION ALL
 (SELECT 'department', department, count(*) AS n FROM hit GROUP BY ALL ORDER BY n DESC, department LIMIT 5))""")
O["whitelist_daily"] = sql("hit", "SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS day, count(*) AS mails FROM hit WHERE time IS NOT NULL GROUP BY 1")
O["whitelist_domain_counts"] = sql("hit", """SELECT kind, domain, mails, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind
 ORDER BY mails DESC, domain) AS rank FROM (SELECT CASE WHEN whitelist_reason LIKE 'Sender domain%' THEN 'sender' ELSE 'recipient' END
 AS kind, string_split(whitelist_reason, '''')[2] AS domain, count(*) AS mails FROM hit
 WHERE whitelist_reason LIKE '%domain ''%' GROUP BY 1, 2)) WHERE rank <= 10""")
O["whitelist_review"] = sql("hit", f"""SELECT type, n AS mails, n || ' whitelisted emails ' || what AS description, action, priority FROM (
 SELECT 'Inactive Domains' AS type, count(*) FILTER (NOT coalesce(time > {AS_OF} - INTERVAL 30 DAY, false)) AS n, 'are older than 30 days' AS what,
 'Review domains with no recent activity for potential removal' AS action, 'Medium' AS priority FROM hit UNION ALL
 SELECT 'Sensitive Content', count(*) FILTER (word_list_match <> ''), 'contain sensitive keywords',
 'Review if these domains should remain whitelisted', 'High' FROM hit UNION ALL
 SELECT 'Attachment Activity', count(*) FILTER (attachments <> ''), 'contain attachments',
 'Verify attachment activity is appropriate for whitelisted domains', 'Medium' FROM hit) WHERE n > 0""")

# ---- risk ----
for key, expr in (("risk_domain", R_DOMAIN), ("risk_content", R_CONTENT), ("risk_attachment", R_ATTACHMENT),
                  ("risk_recipients", R_RECIPIENTS), ("risk_leaver", R_LEAVER), ("risk_volume", R_VOLUME)):
    O[key] = sql("norm", f"SELECT mail_id, {expr} AS points FROM norm")
O["risk_timing"] = sql("mail_log", "SELECT mail_id, CASE WHEN hour(time) >= 12 THEN 10 ELSE 0 END AS points FROM mail_log")
CREDIT = """(CASE WHEN sender IN (SELECT email_address FROM wl WHERE email_address IS NOT NULL) OR string_split(sender, '@')[2] IN
 (SELECT domain FROM wl WHERE domain IS NOT NULL) THEN 30 ELSE 0 END)"""
O["risk_whitelist_credit"] = sql("norm wl", f"SELECT mail_id, {CREDIT} AS points FROM norm")
SUM = " + ".join([R_DOMAIN, R_CONTENT, R_ATTACHMENT, R_RECIPIENTS, R_LEAVER, R_VOLUME])
SC = f"SELECT *, least(100, {SUM}) AS risk_score FROM norm"
O["risk_score"] = sql("norm", "SELECT mail_id, risk_score FROM s", s=SC)
O["risk_score_credited"] = sql("norm wl", f"SELECT mail_id, least(100, greatest(0, {SUM} - {CREDIT})) AS risk_score FROM norm")
O["risk_level"] = sql("norm", f"""SELECT risk_score, {level('risk_score', ('High Risk', 'Medium Risk', 'Low Risk'))} AS engine,
 {level('risk_score', ('High Risk', 'Medium Risk', 'Normal'))} AS daily, {level('risk_score')} AS short, count(*) AS mails
 FROM s GROUP BY ALL""", s=SC)
O["risk_summary"] = sql("norm", """SELECT count(*) AS total, count(*) FILTER (risk_score >= 61) AS high,
 count(*) FILTER (risk_score >= 31 AND risk_score < 61) AS medium, count(*) FILTER (risk_score < 31) AS low,
 round(avg(risk_score), 4) AS mean_score, max(risk_score) AS max_score, min(risk_score) AS min_score FROM s""", s=SC)
O["risk_attach_filtered"] = sql("page", "SELECT mail_id, risk_score, risk_level FROM page")
O["alert_tier"] = sql("norm", f"SELECT mail_id, {TIER} AS tier FROM norm")
O["tier_kpis"] = sql("page", f"""SELECT tier, count(*) AS mails, round(avg(risk_score), 4) AS mean_score,
 {pct('count(*)', '(SELECT count(*) FROM page)')} AS pct FROM (SELECT *, {TIER} AS tier FROM page) GROUP BY tier""")
DAILY = level("risk_score", ("High Risk", "Medium Risk", "Normal"))
O["tier_views"] = sql("page", f"""SELECT mail_id, {TIER} AS tier, last_working_day IS NOT NULL AS is_leaver_first, risk_score,
 {DAILY} AS risk_level, {stamp('time')} AS time FROM page""")
FACTORS = (("Free Email Domains", f"email_domain IN {inlist(V.RISK_FREE_DOMAINS)}"),
           ("Business Email Domains", "email_domain_type = 'business'"), ("Emails with Attachments", "attachments NOT IN ('', '0')"),
           ("Leaver Activity", "last_working_day IS NOT NULL"), ("Sensitive Keywords", "word_list_match <> ''"),
           ("After Hours Activity", "(hour < 9 OR hour > 17)"))
O["risk_factor_means"] = sql("page", " UNION ALL ".join(
    f"SELECT {q(n)} AS factor, count(*) AS mails, round(avg(risk_score), 4) AS mean_score FROM page WHERE {c} HAVING count(*) > 0"
    for n, c in FACTORS))
O["risk_distribution"] = sql("page", f"SELECT {DAILY} AS risk_level, count(*) AS mails FROM page GROUP BY 1")
HF = f"""SELECT mail_id, sender, risk_score, concat_ws(' • ', CASE WHEN {WORDY} THEN 'IP Keywords' END,
 CASE WHEN {any_in('email_domain', ['gmail', 'yahoo', 'hotmail'])} THEN 'Free Email Domain' END,
 CASE WHEN attachments NOT IN ('', '0') THEN 'Has Attachments' END,
 CASE WHEN recipient_count > 5 THEN 'Multiple Recipients' END) AS f FROM page WHERE risk_level = 'High'"""
O["high_risk_list"] = sql("page", """SELECT mail_id, sender, risk_score, CASE WHEN f = '' THEN 'General Risk Indicators' ELSE f END
 AS risk_factors FROM h""", h=HF)
O["high_risk_kpis"] = sql("page", """SELECT count(*) FILTER (risk_score >= 90) AS score_90_plus, count(*) FILTER (contains(f, 'IP Keywords'))
 AS with_words, count(*) FILTER (contains(f, 'Free Email')) AS free_domains, count(*) FILTER (contains(f, 'Has Att')) AS with_attachments
 FROM h""", h=HF)
O["quick_stats"] = sql("scored reason", """SELECT count(*) AS total, count(*) - (SELECT count(*) FROM reason) AS analysed,
 count(*) FILTER (risk_score >= 61) AS high_risk FROM scored""")

# ---- coverage ----
OFF = "('', '0', 'false', 'none', 'null')"
COV = f"""(CASE WHEN lower(tessian) NOT IN {OFF} AND lower(mimecast) NOT IN {OFF} THEN 'Full Coverage' WHEN lower(tessian) NOT IN {OFF}
 THEN 'Missing Mimecast' WHEN lower(mimecast) NOT IN {OFF} THEN 'Missing Tessian' ELSE 'No Coverage' END)"""
OFF2 = "('', '0', 'nan', 'None')"
COV2 = f"""(CASE WHEN tessian_policy NOT IN {OFF2} AND mimecast NOT IN {OFF2} THEN 'Both' WHEN tessian_policy NOT IN {OFF2}
 THEN 'Missing Mimecast' WHEN mimecast NOT IN {OFF2} THEN 'Missing Tessian' ELSE 'No Coverage' END)"""
O["coverage_sources"] = group("norm", [("tessian", "tessian"), ("mimecast", "mimecast"), ("coverage", COV)])
O["coverage_policy"] = group("norm", [("tessian_policy", "tessian_policy"), ("mimecast", "mimecast"), ("coverage", COV2)])
O["coverage_counts"] = sql("norm", f"""SELECT {COV} AS coverage, count(*) AS mails, {pct('count(*)', '(SELECT count(*) FROM norm)')}
 AS pct FROM norm GROUP BY 1""")
O["coverage_domains"] = sql("norm", f"""SELECT coverage, email_domain, mails, rank, {pct('mails', 'total')} AS pct FROM (
 SELECT *, row_number() OVER (PARTITION BY coverage ORDER BY mails DESC, email_domain) AS rank,
 sum(mails) OVER (PARTITION BY coverage) AS total FROM (SELECT {COV} AS coverage, email_domain, count(*) AS mails FROM norm
 GROUP BY 1, 2)) WHERE rank <= 10""")
O["coverage_advice"] = sql("norm", f"""SELECT advice, mails FROM (
 SELECT 'Close the coverage gap' AS advice, count(*) FILTER (c = 'No Coverage') AS mails, count(*) FILTER (c = 'No Coverage') > 0 AS ok FROM v
 UNION ALL SELECT 'Complete partial coverage', count(*) FILTER (c LIKE 'Missing%'), count(*) FILTER (c LIKE 'Missing%') > 0 FROM v
 UNION ALL SELECT 'Coverage is good', count(*) FILTER (c LIKE 'Full%'), count(*) FILTER (c LIKE 'Full%') >= count(*) * 0.8 FROM v)
 WHERE ok""", v=f"SELECT {COV} AS c FROM norm")

# ---- behaviour ----
SD = "SELECT sender, CAST(time AS DATE) AS day, count(*) AS mails FROM norm WHERE time IS NOT NULL GROUP BY 1, 2"
BASE = """SELECT sender, avg(mails) AS a, coalesce(stddev_samp(mails), 0) AS s, median(mails) AS m, max(mails) AS x FROM sd GROUP BY 1"""
O["volume_baseline"] = sql("norm", """SELECT sender, round(a, 4) AS avg_daily, round(s, 4) AS std_daily, round(m, 4) AS median_daily,
 x AS max_daily FROM b""", sd=SD, b=BASE)
Z = "CASE WHEN s > 0 THEN (mails - a) / s ELSE 0 END"
O["volume_spikes"] = sql("norm", f"""SELECT sender, CAST(day AS VARCHAR) AS day, mails, round({Z}, 4) AS volume_zscore, {Z} > 2
 AS is_volume_spike FROM sd JOIN b USING (sender)""", sd=SD, b=BASE)
CUT = "(SELECT max(time) - INTERVAL 10 DAY FROM cls)"
NEWD = f"""SELECT mail_id, sender IN (SELECT sender FROM cls WHERE time < {CUT}) AND len(list_filter(rds, lambda d:
 NOT list_contains(coalesce(seen, []), d))) > 0 AS has_new_domain FROM cls LEFT JOIN (SELECT sender AS s2, list(DISTINCT r) AS seen
 FROM (SELECT sender, unnest(rds) AS r FROM cls WHERE time < {CUT}) GROUP BY 1) ON sender = s2 WHERE time >= {CUT}"""
O["new_domains_lookback"] = sql("cls", "SELECT * FROM n", n=NEWD)
EXS = "SELECT mail_id, sender, time, unnest(rds) AS r FROM cls"
BURST = """SELECT cls.mail_id, coalesce(hit, false) AS has_burst_pattern FROM cls LEFT JOIN (SELECT DISTINCT mail_id, true AS hit FROM
 (SELECT a.mail_id, a.r, count(*) AS n FROM x a JOIN x b ON a.sender = b.sender AND a.r = b.r AND b.time BETWEEN a.time - INTERVAL 1 HOUR
 AND a.time + INTERVAL 1 HOUR GROUP BY 1, 2) WHERE n >= 5) h ON cls.mail_id = h.mail_id"""
O["burst_flag"] = sql("cls", "SELECT * FROM b", x=EXS, b=BURST)
KEPT = "SELECT cls.* FROM cls WHERE mail_id NOT IN (SELECT mail_id FROM reason)"
FC = f"""SELECT sender, new_domain, mail_id, time, department, business_unit, subject, {d_category('new_domain')} AS domain_category,
 CASE WHEN new_domain IN {FREE} THEN 'High' ELSE 'Medium' END AS risk_level, true AS requires_review FROM (
 SELECT sender, r AS new_domain, mail_id, time, department, bunit AS business_unit, subject, row_number() OVER (PARTITION BY sender, r
 ORDER BY time, mail_id) AS rn FROM (SELECT *, unnest(rds) AS r FROM k WHERE sender <> '')) WHERE rn = 1"""


def contacts(select):
    return sql("cls reason", select, k=KEPT, f=FC)


O["first_contact"] = contacts(f"SELECT * REPLACE ({stamp('time')} AS time) FROM f")
O["first_contact_kpis"] = contacts("""SELECT count(DISTINCT sender) AS senders, count(DISTINCT new_domain) AS domains,
 count(*) FILTER (risk_level = 'High') AS high_risk, count(DISTINCT department) AS departments FROM f""")
O["first_contact_filter"] = contacts("""SELECT sender, new_domain, mail_id FROM f WHERE risk_level = 'High' AND department = 'IT'
 AND domain_category = 'Yahoo Email Services'""")
O["first_contact_rollups"] = contacts("""SELECT department, count(*) FILTER (risk_level = 'High') AS high,
 count(*) FILTER (risk_level = 'Medium') AS medium FROM f GROUP BY 1""")
O["first_contact_top_domains"] = contacts(f"""SELECT new_domain, count(*) AS contacts, {d_category('new_domain')} AS category FROM f
 GROUP BY new_domain ORDER BY contacts DESC, new_domain LIMIT 10""")
O["late_sender_domains"] = sql("norm", """SELECT dom AS sender_domain, count(*) AS mails,
 coalesce(string_agg(DISTINCT department, ', ' ORDER BY department), '') AS departments, coalesce(string_agg(DISTINCT bunit, ', ' ORDER BY bunit), '') AS units FROM h
 WHERE dom IS NOT NULL GROUP BY 1 HAVING min(rn) > (SELECT count(*) FROM h) // 2""",
    h="""SELECT *, string_split(sender, '@')[1] || '.' || strftime(time, '%Y%m%d') AS dom, row_number() OVER (ORDER BY time, mail_id) AS rn
 FROM norm""")
DV = "SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS day, count(*) AS mails FROM norm WHERE time IS NOT NULL GROUP BY 1"
O["daily_volume"] = sql("norm", DV)
O["volume_ma7"] = sql("norm", """SELECT day, mails, CASE WHEN count(*) OVER w = 7 THEN round(avg(mails) OVER w, 4) END AS ma7 FROM d
 WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", d=DV)
O["timeline"] = sql("page", "SELECT CAST(CAST(time AS DATE) AS VARCHAR) AS day, risk_level, count(*) AS mails FROM page WHERE time IS NOT NULL GROUP BY 1, 2")
O["hourly_activity"] = sql("norm", """SELECT hour(time) AS hour, count(*) AS mails, hour(time) < 8 OR hour(time) >= 18 AS after_hours
 FROM norm WHERE time IS NOT NULL GROUP BY 1, 3""")
EDGES = """SELECT sender, r AS domain, count(*) AS weight FROM (SELECT sender, unnest(rds[1:3]) AS r FROM cls) WHERE r <> sender GROUP BY 1, 2"""
TOPN = """SELECT node, type, degree, received + coalesce(n, 0) AS mails FROM (SELECT node, max(type) AS type, count(*) AS degree,
 CAST(sum(w) AS BIGINT) AS received FROM (SELECT sender AS node, 'sender' AS type, 0 AS w FROM e UNION ALL SELECT domain, 'domain', weight
 FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 50) LEFT JOIN (SELECT sender, count(*) AS n FROM cls GROUP BY 1) ON node = sender"""
O["mail_graph_edges"] = sql("cls", EDGES)
O["mail_graph_top"] = sql("cls", "SELECT * FROM t", e=EDGES, t=TOPN)
O["mail_graph_top_edges"] = sql("cls", """SELECT sender, domain, weight FROM e WHERE sender IN (SELECT node FROM t) AND domain IN
 (SELECT node FROM t)""", e=EDGES, t=TOPN)

# ---- anomalies ----
O["anomaly_features"] = sql("cls", """SELECT cls.mail_id, coalesce(hour, 0)::BIGINT AS hour, coalesce(day_of_week, 0)::BIGINT AS day_of_week,
 coalesce(day_of_week >= 5, false)::BIGINT AS is_weekend, recipient_count, has_attachments::BIGINT AS has_attachments,
 is_after_hours::BIGINT AS is_after_hours, is_leaver::BIGINT AS is_leaver, coalesce(has_new_domain, false)::BIGINT AS has_new_domain,
 has_burst_pattern::BIGINT AS has_burst_pattern, (email_domain_type = 'business')::BIGINT AS domain_business,
 (email_domain_type = 'free')::BIGINT AS domain_free, (email_domain_type = 'internal')::BIGINT AS domain_internal,
 (email_domain_type = 'unknown')::BIGINT AS domain_unknown, CASE WHEN department IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY department) END AS dept_frequency,
 count(*) OVER (PARTITION BY sender) AS sender_frequency FROM cls JOIN b ON cls.mail_id = b.mail_id LEFT JOIN n ON cls.mail_id = n.mail_id""",
    x=EXS, b=BURST, n=NEWD)
FEATURE_SQL = ["hour", "day_of_week", "(day_of_week >= 5)", "recipient_count", "has_attachments", "is_after_hours", "is_leaver", "0", "0",
               "(email_domain_type = 'business')", "(email_domain_type = 'free')", "(email_domain_type = 'internal')", "(email_domain_type = 'unknown')",
               "CASE WHEN department IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY department) END", "CASE WHEN sender IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY sender) END"]
FEATURE_LIST = "[" + ", ".join(f"coalesce({e}, {'0' if e.startswith(('hour', 'day', 'rec', 'CASE', '0')) else 'false'})::BIGINT" for e in FEATURE_SQL) + "]"


def forest(src, trees=100, size=256, depth=8, seed=42):
    """Steps that rebuild the isolation forest over the mails of ``src`` and score them: nodes level by level, then a recursive walk."""
    n = len(FEATURE_SQL)
    path = lambda d: f"round(({d} + CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1)::DOUBLE / n WHEN n = 2 THEN 1 ELSE 0 END) * 1000000)::BIGINT"
    steps = {"feats": f"SELECT mail_id, {FEATURE_LIST} AS f FROM {src}",
             "l0": f"SELECT tree, 1 AS node, f FROM feats, range({trees}) t(tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY md5('{seed}:sample:' || tree || ':' || mail_id), mail_id) <= {size}"}
    for d in range(depth + 1):
        varied = f"list_filter(range(0, {n}), lambda k: hi[k + 1] > lo[k + 1])"
        steps[f"s{d}"] = (f"SELECT tree, node, count(*) AS n, [{', '.join(f'min(f[{k}])' for k in range(1, n + 1))}] AS lo, "
                          f"[{', '.join(f'max(f[{k}])' for k in range(1, n + 1))}] AS hi FROM l{d} GROUP BY tree, node")
        pick = f"string_split(list_sort(list_transform({varied}, lambda k: md5('{seed}:' || tree || ':' || node || ':' || k) || ':' || k))[1], ':')[2]::INT"
        steps[f"c{d}"] = (f"SELECT tree, node, k, {path(d)} AS path, CASE WHEN k IS NOT NULL THEN lo[k + 1] + (hi[k + 1] - lo[k + 1]) * "
                          f"(('0x' || substr(md5('{seed}:' || tree || ':' || node || ':cut'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE) END AS cut "
                          f"FROM (SELECT *, {pick if d < depth else 'NULL::INT'} AS k FROM s{d})")
        if d < depth:
            steps[f"l{d + 1}"] = f"SELECT tree, 2 * node + (f[k + 1] > cut)::INT AS node, f FROM l{d} JOIN c{d} USING (tree, node) WHERE k IS NOT NULL"
    steps["nodes"] = " UNION ALL ".join(f"SELECT tree, node, k, cut, path FROM c{d}" for d in range(depth + 1))
    steps["walk"] = ("SELECT f, tree, 1 AS node, k, cut, path FROM (SELECT DISTINCT f FROM feats), nodes WHERE node = 1 UNION ALL "
                     "SELECT w.f, w.tree, x.node, x.k, x.cut, x.path FROM walk w JOIN nodes x ON x.tree = w.tree AND x.node = 2 * w.node + (w.f[w.k + 1] > w.cut)::INT WHERE w.k IS NOT NULL")
    c = f"(2 * (ln({size} - 1) + 0.5772156649015329) - 2 * ({size} - 1)::DOUBLE / {size})"
    steps["found"] = f"SELECT f, -pow(2, -(sum(path) / 1000000.0::DOUBLE) / {trees} / {c}) AS score FROM walk WHERE k IS NULL GROUP BY f"
    steps["placed"] = "SELECT mail_id, f, score, row_number() OVER (ORDER BY score) - 1 AS place, 0.1::DOUBLE * (count(*) OVER () - 1) AS spot FROM feats JOIN found USING (f)"
    steps["bounds"] = ("SELECT max(CASE WHEN place = floor(spot) THEN score END) AS low, max(CASE WHEN place = ceil(spot) THEN score END) AS high, max(spot - floor(spot)) AS part FROM placed")
    steps["detected"] = "SELECT mail_id, f, score - (low + (high - low) * part) AS anomaly_score, score - (low + (high - low) * part) < 0 AS is_anomaly FROM placed, bounds"
    return steps


def recursive(text):
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


O["iforest_detect"] = recursive(sql("cls", "SELECT mail_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM detected", **forest("cls")))
O["iforest_score100"] = recursive(sql("cls", """SELECT mail_id, round(CASE WHEN max(anomaly_score) OVER () > min(anomaly_score) OVER ()
 THEN (anomaly_score - min(anomaly_score) OVER ()) / (max(anomaly_score) OVER () - min(anomaly_score) OVER ()) * 100 ELSE 0 END, 4) AS score100 FROM detected""", **forest("cls")))
SCALED = ", ".join(f"coalesce((f[{k}] - avg(f[{k}]) OVER ()) / nullif(stddev_pop(f[{k}]) OVER (), 0), 0)" for k in range(1, len(FEATURE_SQL) + 1))
O["anomaly_clusters"] = recursive(sql("cls", """SELECT m.mail_id, coalesce(cluster, -1)::BIGINT AS cluster FROM refound m JOIN labels USING (f) LEFT JOIN numbered USING (label)""",
    **forest("cls"), flagged="SELECT cls.* FROM cls JOIN detected USING (mail_id) WHERE is_anomaly", refound=f"SELECT mail_id, {FEATURE_LIST} AS f FROM flagged",
    scaled=f"SELECT mail_id, f, [{SCALED}] AS x FROM refound", spots="SELECT f, any_value(x) AS x, min(mail_id) AS id, count(*) AS n FROM scaled GROUP BY f",
    near="SELECT a.id AS a, b.id AS b FROM spots a JOIN spots b ON list_sum(list_transform(range(1, len(a.x) + 1), lambda k: pow(a.x[k] - b.x[k], 2))) <= 0.25 + 1e-12",
    reach="SELECT id AS a, id AS b FROM spots UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a",
    labels="SELECT f, n, min(reach.b) AS label FROM spots JOIN reach ON id = reach.a GROUP BY f, n",
    numbered="SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster FROM labels GROUP BY label HAVING sum(n) > 1"))
RISKY = found_in("array_to_string(list_transform(attachment_types, lambda t: lower(t)), ',')", V.RISKY_FILE_TYPES)
EXT = "coalesce(array_to_string(list_filter(rds, lambda d: d <> sender_domain), ', '), '')"
REASONS = f"""SELECT mail_id, is_anomaly, list_filter([
 CASE WHEN sender <> '' AND recipient_count > m * 2 THEN 'Unusual recipient volume: ' || recipient_count || ' recipients (typical: ' || format('{{:.1f}}', m) || ')' END,
 CASE WHEN hour < 6 OR hour > 22 THEN 'Sent at unusual time: ' || strftime(time, '%H:%M') || ' (outside business hours)' END,
 CASE WHEN len({RISKY}) > 0 THEN 'Contains potentially risky file types: ' || array_to_string({RISKY}, ', ') END,
 CASE WHEN {any_in('email_domain', ['gmail.com', 'yahoo.com', 'hotmail.com'])} THEN 'Uses free email domain for business communication' END,
 CASE WHEN {WORDY} THEN 'Contains sensitive keywords: ' || word_list_match END,
 CASE WHEN risk_score > 70 THEN 'High risk score: ' || format('{{:.1f}}', risk_score::DOUBLE) || '/100' END,
 CASE WHEN {EXT} <> '' THEN 'Communication with external domains: ' || {EXT} END,
 CASE WHEN {any_in(ATT, ['large', 'mb'])} THEN 'Contains large attachments' END], lambda x: x IS NOT NULL) AS r
 FROM (SELECT *, avg(recipient_count) OVER (PARTITION BY sender) AS m FROM ruled)"""
REASON4 = """CASE WHEN len(r) = 0 THEN 'Detected as statistical outlier based on behavioral patterns' ELSE array_to_string(r[1:4], ' | ') END
 AS anomaly_reasons"""
O["anomaly_reasons"] = sql("ruled", f"SELECT mail_id, {REASON4} FROM z", z=REASONS)
O["iforest_reasons"] = recursive(sql("page", f"SELECT mail_id, round(anomaly_score, 6) AS anomaly_score, {REASON4} FROM z JOIN detected USING (mail_id) WHERE z.is_anomaly",
    **forest("page"), flagged="SELECT page.*, is_anomaly FROM page JOIN detected USING (mail_id)", z=REASONS.replace("FROM ruled", "FROM flagged").replace("ruled", "flagged")))
O["anomaly_reason_map"] = sql("ruled", f"SELECT mail_id, {REASON4} FROM z WHERE is_anomaly", z=REASONS)
for key, expr in (("sender_anomalies", "time_anomaly OR volume_anomaly OR content_anomaly"), ("sender_time_anomaly", "time_anomaly"),
                  ("sender_volume_anomaly", "volume_anomaly"), ("sender_content_anomaly", "content_anomaly")):
    O[key] = sql("rules", f"SELECT mail_id, {expr} AS flag FROM rules")
CLASS = "CASE WHEN is_anomaly THEN 'anomalous' ELSE 'normal' END"
O["anomaly_patterns"] = sql("ruled", f"""SELECT section, key, value::DOUBLE AS value FROM (SELECT *, row_number() OVER (PARTITION BY section
 ORDER BY value DESC, o) AS rn FROM (SELECT {CLASS} || '_peak_hours' AS section, hour::VARCHAR AS key, lpad(hour::VARCHAR, 2, '0') AS o,
 count(*)::DOUBLE AS value, 3 AS k FROM ruled WHERE time IS NOT NULL GROUP BY ALL UNION ALL SELECT 'departments', department, department, count(*), 5 FROM ruled
 WHERE is_anomaly AND department IS NOT NULL GROUP BY ALL UNION ALL SELECT 'avg_recipients', {CLASS}, {CLASS}, round(avg(recipient_count), 4), 9 FROM ruled GROUP BY ALL))
 WHERE rn <= k""")
FREELAB = f"CASE WHEN {any_in('email_domain', V.IP_FREE_MAIL)} THEN 'Free Email' ELSE 'Business' END"
TRIAGE = f"""SELECT mail_id, sender, subject, risk_score, anomaly_score,
 CASE WHEN risk_score > 0 THEN {level('risk_score', ('High Risk', 'Medium Risk', 'Low Risk'))} ELSE 'Unknown' END AS risk_indicator,
 CASE WHEN risk_score <= 0 THEN 'Unassessed' ELSE {level('risk_score', ('Critical Alert', 'Monitor', 'Normal'))} END AS risk_category,
 CASE WHEN last_working_day IS NOT NULL THEN 'Leaver' ELSE 'Active' END AS leaver_status, attachments NOT IN ('', '0') AS has_files,
 {WORDY} AS has_words, {FREELAB} AS domain_type, recipient_count FROM ruled WHERE is_anomaly ORDER BY anomaly_score, mail_id LIMIT 20"""
O["anomaly_triage"] = sql("ruled", "SELECT * FROM t", t=TRIAGE)
O["anomaly_kpis"] = sql("ruled", """SELECT count(*) AS listed, count(*) FILTER (risk_category = 'Critical Alert') AS critical,
 count(*) FILTER (risk_category = 'Monitor') AS medium, count(*) FILTER (leaver_status = 'Leaver') AS leavers,
 count(*) FILTER (has_words) AS with_words, count(*) FILTER (has_files) AS with_files,
 coalesce(round(avg(risk_score) FILTER (risk_score > 0), 4), 0) AS mean_risk, coalesce(max(risk_score) FILTER (risk_score > 0), 0) AS max_risk,
 count(DISTINCT sender) AS senders, sum(recipient_count)::BIGINT AS recipients, round(avg(recipient_count), 4) AS mean_recipients,
 count(*) FILTER (domain_type = 'Free Email') AS free_domains FROM t""", t=TRIAGE)
O["anomaly_actions"] = sql("ruled", f"""SELECT mail_id, sender, risk_score, CASE WHEN anomaly_score < -2 THEN 'Extreme' WHEN anomaly_score < -1
 THEN 'High' ELSE 'Moderate' END AS severity, {COV2} AS coverage, {FREELAB} AS domain_type,
 CASE WHEN hour < 6 OR hour > 22 THEN 'After hours' WHEN hour BETWEEN 6 AND 8 OR hour BETWEEN 18 AND 22 THEN 'Early or late'
 WHEN hour IS NOT NULL THEN 'Business hours' ELSE '-' END AS timing, concat_ws('; ',
 CASE WHEN last_working_day IS NOT NULL THEN 'PRIORITY 1: Review all recent emails from this departing employee; PRIORITY 1: Check if emails contain company intellectual property; PRIORITY 1: Verify recipient legitimacy and business justification' END,
 CASE WHEN {WORDY} AND attachments NOT IN ('', '0') THEN 'PRIORITY 2: Scan attachments for sensitive data; PRIORITY 2: Review keyword context in email content' END,
 CASE WHEN risk_score >= 61 THEN 'HIGH RISK: Escalate to security team immediately; HIGH RISK: Consider contacting sender to verify legitimate activity'
  WHEN risk_score >= 31 THEN 'MEDIUM RISK: Monitor sender for pattern changes; MEDIUM RISK: Document for trend analysis' END,
 CASE WHEN {COV2} <> 'Both' THEN 'SECURITY: Ensure complete security tool coverage' END) AS actions FROM ruled WHERE is_anomaly""")

# ---- business as usual ----
O["bau_scope"] = sql("low", "SELECT mail_id, coalesce(hour::VARCHAR, '-') AS hour, coalesce(day_of_week::VARCHAR, '-') AS day_of_week, is_business_hours FROM low")


def described(section, source, column):
    parts = [("count", f"count({column})"), ("mean", f"avg({column})"), ("std", f"stddev_samp({column})"), ("min", f"min({column})"),
             ("p25", f"quantile_cont({column}, 0.25)"), ("p50", f"quantile_cont({column}, 0.5)"),
             ("p75", f"quantile_cont({column}, 0.75)"), ("max", f"max({column})")]
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{k}' AS key, round(({e})::DOUBLE, 4) AS value FROM {source}" for k, e in parts)


LD = "SELECT CAST(time AS DATE) AS day, count(*) AS mails FROM low WHERE time IS NOT NULL GROUP BY 1"
O["bau_temporal"] = sql("low", f"""SELECT 'overview' AS section, 'business_hours_pct' AS key, {pct('count(*) FILTER (is_business_hours)', 'count(*)')}
 AS value FROM low UNION ALL SELECT 'overview', 'peak_hour', (SELECT hour FROM low WHERE hour IS NOT NULL GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1)::DOUBLE
 UNION ALL SELECT 'weekday', day_of_week::VARCHAR, count(*)::DOUBLE FROM low WHERE day_of_week IS NOT NULL GROUP BY day_of_week UNION ALL {described('daily_volume', 'd', 'mails')}""",
    d=LD)
LS = "SELECT sender, count(*) AS n FROM low GROUP BY 1"
O["bau_senders"] = sql("low", f"""SELECT 'overview' AS section, 'senders' AS key, count(*)::DOUBLE AS value FROM s UNION ALL
 SELECT 'overview', 'mails_per_sender', round(avg(n), 4) FROM s UNION ALL SELECT 'overview', 'top_sender_pct',
 {pct('max(n)', '(SELECT count(*) FROM low)')} FROM s UNION ALL SELECT * FROM (SELECT 'regular_sender', sender, n::DOUBLE AS n FROM s
 ORDER BY n DESC, sender LIMIT 10)""", s=LS)
O["bau_subjects"] = sql("low", f"""SELECT 'word' AS section, word AS key, n::DOUBLE AS value FROM w UNION ALL
 {described('subject_length', 'low', 'length(subject)')}""", w=subject_words("low", 20))
LDOM = "SELECT r AS domain, count(*) AS n FROM (SELECT unnest(rds) AS r FROM low) GROUP BY 1"
INT = any_in("domain", V.INTERNAL_SUFFIXES)
O["bau_domains"] = sql("low", f"""SELECT 'overview' AS section, 'domains' AS key, count(*)::DOUBLE AS value FROM d UNION ALL
 SELECT 'overview', 'internal', count(*) FILTER ({INT})::DOUBLE FROM d UNION ALL SELECT 'overview', 'external',
 count(*) FILTER (NOT {INT})::DOUBLE FROM d UNION ALL SELECT * FROM (SELECT 'common_domain', domain, n::DOUBLE AS n FROM d
 ORDER BY n DESC, domain LIMIT 10)""", d=LDOM)
O["bau_volume_days"] = sql("low", """SELECT 'Volume Spike' AS type, CAST(day AS VARCHAR) AS day, mails, 'Medium' AS severity,
 'Unusually high volume of low-risk emails: ' || mails || ' emails' AS description FROM d
 WHERE mails > (SELECT quantile_cont(mails, 0.95) FROM d)""", d=LD)
O["bau_off_hours"] = sql("low", f"""SELECT 'Off-Hours Activity' AS type, n AS mails, {pct('n', 't')} AS pct, 'Low' AS severity,
 n || ' low-risk emails sent outside business hours' AS description FROM (SELECT count(*) FILTER (NOT is_business_hours) AS n, count(*) AS t
 FROM low) WHERE n > t * 0.1""")
LA = "SELECT mail_id, sender, len(regexp_extract_all(attachments, '\\.[a-zA-Z]+')) AS attachment_count FROM low"
O["bau_attachment_outliers"] = sql("low", """SELECT 'High Attachment Count' AS type, mail_id, sender, attachment_count, 'Medium' AS severity,
 'Low-risk email with unusually high attachment count: ' || attachment_count AS description FROM a
 WHERE attachment_count > (SELECT quantile_cont(attachment_count, 0.75) FROM a)""", a=LA)
O["bau_anomalies"] = sql("low", """SELECT type, severity, n AS findings FROM (SELECT 'Volume Spike' AS type, 'Medium' AS severity, count(*) AS n FROM d
 WHERE mails > (SELECT quantile_cont(mails, 0.95) FROM d) UNION ALL SELECT 'Off-Hours Activity', 'Low',
 (count(*) FILTER (NOT is_business_hours) > count(*) * 0.1)::BIGINT FROM low UNION ALL SELECT 'High Attachment Count', 'Medium', count(*) FROM a
 WHERE attachment_count > (SELECT quantile_cont(attachment_count, 0.95) FROM a)) WHERE n > 0""", d=LD, a=LA)
BANK = f"SELECT * FROM low WHERE {any_in('lower(subject)', V.BANKING_WORDS)}"
O["banking_mails"] = sql("low", "SELECT mail_id, subject FROM b", b=BANK)
O["banking_overview"] = sql("low", f"""SELECT section, key, round(value::DOUBLE, 4) AS value FROM (
 SELECT 'overview' AS section, 'mails' AS key, count(*)::DOUBLE AS value FROM b UNION ALL
 SELECT 'overview', 'pct', count(*) * 100.0 / (SELECT count(*) FROM low) FROM b UNION ALL
 SELECT 'overview', 'business_hours_pct', count(*) FILTER (is_business_hours) * 100.0 / count(*) FROM b UNION ALL
 SELECT 'overview', 'peak_hour', (SELECT hour FROM b WHERE hour IS NOT NULL GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1) UNION ALL
 SELECT 'overview', 'weekend_mails', count(*) FILTER (day_of_week >= 5) FROM b UNION ALL
 SELECT 'overview', 'senders', count(DISTINCT sender) FROM b UNION ALL
 SELECT 'word', w, count(*) FROM (SELECT unnest({found_in('lower(subject)', V.BANKING_WORDS)}) AS w FROM b) GROUP BY w UNION ALL
 SELECT * FROM (SELECT 'top_sender', sender, count(*) AS n FROM b GROUP BY sender ORDER BY n DESC, sender LIMIT 5))""", b=BANK)
O["banking_compliance"] = sql("low", f"""SELECT mail_id, 'Compliance content sent externally' AS concern, subject FROM b
 WHERE {any_in('lower(subject)', V.COMPLIANCE_WORDS)} AND contains({joined('rds', ',')}, 'corp')""", b=BANK)
IPR = f"""SELECT *, len(ip) * 2 + (CASE WHEN len(ip) > 0 AND len(bank) > 0 THEN 5 ELSE 0 END) + types + len(named) * 2 + fr AS ip_risk_score FROM (
 SELECT *, {found_in('lower(subject)', V.IP_WORDS)} AS ip, {found_in('lower(subject)', V.BANKING_WORDS)} AS bank,
 len({found_in(ATT, V.IP_FILE_TYPES)}) AS types, {found_in(ATT, V.IP_FILE_WORDS)} AS named,
 CASE WHEN {any_in('lower(subject)', V.BANKING_WORDS)} THEN 2 * len({found_in(joined('rds', ','), V.IP_FREE_MAIL)}) ELSE 0 END AS fr FROM {{src}})"""
O["hidden_ip_risks"] = sql("page", """SELECT mail_id, sender, subject, ip_risk_score, array_to_string(list_filter(list_concat(list_concat([
 CASE WHEN len(ip) > 0 THEN 'IP keywords: ' || array_to_string(ip[1:3], ', ') END,
 CASE WHEN len(ip) > 0 AND len(bank) > 0 THEN 'Banking + Confidential content combination' END],
 list_transform(named, lambda w: 'Sensitive filename pattern: ' || w)),
 [CASE WHEN fr > 0 THEN 'Banking content to external domains' END]), lambda x: x IS NOT NULL), '; ') AS risk_factors,
 array_to_string(bank[1:5], ', ') AS banking_keywords, array_to_string(ip[1:5], ', ') AS ip_keywords FROM i WHERE ip_risk_score > 3""", i=IPR.format(src="page"))
O["bau_recommendations"] = sql("low", """SELECT category, priority, value::DOUBLE AS value, action FROM (
 SELECT 'Operational Security' AS category, 'Medium' AS priority, round(count(*) FILTER (NOT is_business_hours) * 100.0 / count(*), 4) AS value,
 'Review after-hours email policies and monitoring' AS action, 20 AS lim FROM low UNION ALL
 SELECT 'Financial Data Protection', 'High', count(*), 'Implement enhanced monitoring for financial content', 0 FROM b UNION ALL
 SELECT 'Intellectual Property', 'High', count(*), 'Review classification rules and implement content-based risk scoring', 0 FROM i
 WHERE ip_risk_score > 3) WHERE value > lim""", b=BANK, i=IPR.format(src="low"))

# ---- organisation ----
WM = f"count(*) FILTER ({WORDY})"
MR = "round(avg(risk_score), 4)"
O["unit_activity"] = sql("page", f"""SELECT bunit, count(*) AS mails, count(DISTINCT sender) AS senders, count(DISTINCT department) AS departments,
 {WM} AS word_matches, {MR} AS mean_risk, row_number() OVER (ORDER BY count(*) DESC, bunit) AS rank,
 {pct('count(*)', '(SELECT count(*) FROM page)')} AS pct FROM page WHERE bunit IS NOT NULL GROUP BY bunit ORDER BY mails DESC, bunit LIMIT 15""")
O["unit_departments"] = sql("page", f"""SELECT * EXCLUDE (t), {pct('mails', 't')} AS pct FROM (SELECT bunit, department, count(*) AS mails,
 count(DISTINCT sender) AS senders, {WM} AS word_matches, row_number() OVER (PARTITION BY bunit ORDER BY department IS NULL, count(*) DESC, department) AS rank,
 sum(count(*)) OVER (PARTITION BY bunit) AS t FROM page WHERE bunit IS NOT NULL GROUP BY bunit, department QUALIFY department IS NOT NULL) WHERE rank <= 10""")
O["unit_overview"] = sql("page", f"""SELECT bunit, count(*) AS mails, count(DISTINCT department) AS departments, count(DISTINCT sender) AS senders,
 {WM} AS word_matches, {MR} AS mean_risk, {pct('count(*) FILTER (hour BETWEEN 9 AND 17)', 'count(*)')} AS business_hours_pct
 FROM page WHERE bunit IS NOT NULL GROUP BY bunit""")
O["unit_concentration"] = sql("page", """SELECT round(sum(n) FILTER (r <= 5) * 100.0 / max(t), 4) AS top5_pct,
 round(sum(n) FILTER (r <= 3) * 100.0 / max(t), 4) AS top3_pct, round(sum(n) FILTER (r <= 1) * 100.0 / max(t), 4) AS top1_pct FROM (
 SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, bunit) AS r, (SELECT count(*) FROM page) AS t FROM page WHERE bunit IS NOT NULL GROUP BY bunit)""")
O["unit_word_leader"] = sql("page", f"""SELECT (SELECT bunit FROM u ORDER BY n DESC, bunit LIMIT 1) AS bunit, max(n) AS word_matches,
 count(*) AS units FROM u""", u=f"SELECT bunit, count(*) AS n FROM page WHERE {WORDY} AND bunit IS NOT NULL GROUP BY 1")
O["org_kpis"] = sql("ruled", " UNION ALL ".join(f"""SELECT '{k}' AS kind, count(*) AS groups, round(avg(n), 4) AS mails_per_group,
 count(*) FILTER (h) AS high_risk_groups, count(*) FILTER (e) AS external_groups, count(*) FILTER (a) AS anomalous_groups FROM (
 SELECT {k}, count(*) AS n, bool_or(risk_level = 'High') AS h, bool_or({OUTSIDE}) AS e, bool_or(is_anomaly) AS a FROM ruled WHERE {k} IS NOT NULL GROUP BY {k})"""
                                                for k in ("department", "bunit")))
MATRIX = """SELECT {0}, count(*) FILTER (risk_level = 'High') AS high, count(*) FILTER (risk_level = 'Medium') AS medium,
 count(*) FILTER (risk_level = 'Low') AS low FROM page WHERE {0} IS NOT NULL GROUP BY {0}"""
O["dept_risk_matrix"] = sql("page", MATRIX.format("department"))
O["unit_risk_matrix"] = sql("page", MATRIX.format("bunit"))
O["dept_external"] = sql("page", f"""SELECT department, count(*) AS external_mails, sum(len(string_split(recipients, ',')))::BIGINT AS recipients,
 count(*) FILTER (attachments <> '') AS with_attachments FROM page WHERE {OUTSIDE} AND department IS NOT NULL GROUP BY 1""")
O["dept_keywords"] = sql("page", """SELECT department, count(*) AS mails, sum(ip_keywords_detected)::BIGINT AS keywords,
 round(avg(ip_keywords_detected), 2) AS mean_keywords FROM page WHERE ip_keywords_detected > 0 AND department IS NOT NULL GROUP BY 1""")
O["unit_anomalies"] = sql("ruled", """SELECT bunit, count(*) AS anomalies, round(avg(anomaly_score), 4) AS mean_score,
 round(max(anomaly_score), 4) AS max_score, count(DISTINCT sender) AS senders FROM ruled WHERE is_anomaly AND bunit IS NOT NULL GROUP BY 1""")
O["cross_dept_kpis"] = sql("page", """SELECT count(*) AS departments, sum(s)::BIGINT AS department_senders, sum(h)::BIGINT AS high_risk,
 sum(d)::BIGINT AS department_domains FROM (SELECT count(DISTINCT sender) AS s, count(DISTINCT sender_domain) AS d,
 count(*) FILTER (risk_level = 'High') AS h FROM page WHERE department IS NOT NULL GROUP BY department)""")
DEPTS = f"""SELECT department, count(*) AS mails, count(*) FILTER ({OUTSIDE}) AS external, count(DISTINCT sender) AS senders,
 avg(len(string_split(recipients, ','))) AS rec, count(*) FILTER (attachments <> '') AS files,
 count(*) FILTER (ip_keywords_detected > 0) AS keywords, count(*) FILTER (risk_level = 'High') AS high, avg(length(subject)) AS sl,
 count(*) FILTER (hour >= 22 OR hour <= 5) AS night FROM page WHERE department IS NOT NULL GROUP BY department"""
O["dept_volumes"] = sql("page", f"SELECT department, mails, mails - external AS internal, external, {pct('external', 'mails')} AS external_pct FROM d",
                        d=DEPTS)
O["dept_direction"] = sql("page", """SELECT department, mails AS initiated, senders, round(rec, 4) AS mean_recipients,
 CASE WHEN mails > (SELECT avg(mails) FROM d) THEN 'High' ELSE 'Normal' END AS initiation_rate FROM d""", d=DEPTS)
O["dept_content"] = sql("page", f"""SELECT department, files AS with_attachments, {pct('files', 'mails')} AS attachment_pct, keywords AS keyword_mails,
 high AS high_risk, round(sl, 4) AS mean_subject_length FROM d""", d=DEPTS)
DA = """SELECT department, 'High Volume' AS anomaly, mails::DOUBLE AS value, 'Medium' AS severity, 'Volume Spike' AS risk_factor FROM d
  WHERE mails > 2 * (SELECT avg(mails) FROM d)
 UNION ALL SELECT department, 'Low Volume', mails, 'Low', 'Unusual Quietness' FROM d WHERE mails < 0.3 * (SELECT avg(mails) FROM d)
 UNION ALL SELECT department, 'High Attachment Usage', round(files / mails, 4), 'Medium', 'Data Transfer Risk' FROM d
  WHERE files / mails > 3 * (SELECT count(*) FILTER (attachments <> '') / count(*) FROM page)
 UNION ALL SELECT department, 'High External Communication', round(external / mails, 4), 'High', 'External Data Flow' FROM d
  WHERE external / mails > 0.8
 UNION ALL SELECT department, 'After-Hours Activity', round(night / mails, 4), 'Medium', 'Unusual Timing' FROM d WHERE night / mails > 0.3"""
O["dept_anomalies"] = sql("page", DA, d=DEPTS)
O["dept_anomaly_kpis"] = sql("page", """SELECT count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium,
 count(DISTINCT department) AS departments FROM a""", d=DEPTS, a=DA)
O["dept_sizes"] = sql("page", "SELECT department, count(*) AS mails FROM page WHERE department IS NOT NULL GROUP BY 1")
O["dept_hour_matrix"] = sql("page", "SELECT department, " + ", ".join(f"count(*) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))
                            + " FROM page WHERE department IS NOT NULL AND time IS NOT NULL GROUP BY 1")
O["dept_flags"] = sql("page", """SELECT department, 'High External Communication' AS pattern, round(external / mails, 4) AS share,
 CASE WHEN external / mails > 0.8 THEN 'Medium' ELSE 'Low' END AS level FROM d WHERE external / mails > 0.7
 UNION ALL SELECT department, 'High IP Keyword Usage', round(keywords / mails, 4), 'High' FROM d WHERE keywords / mails > 0.3""", d=DEPTS)
O["dept_insights"] = sql("page", """SELECT count(*) AS departments, (SELECT department FROM d ORDER BY mails DESC, department LIMIT 1) AS most_active,
 max(mails) AS most_active_mails, (SELECT department FROM d ORDER BY external DESC, department LIMIT 1) AS most_external,
 max(external) AS most_external_mails FROM d""", d=DEPTS)
O["domain_dept_unit_stats"] = sql("page", """SELECT * FROM (SELECT sender_domain, department, bunit, count(*) AS mails,
 count(*) FILTER (risk_level = 'High') AS high_risk, sum(ip_keywords_detected)::BIGINT AS keywords FROM page WHERE department IS NOT NULL AND bunit IS NOT NULL GROUP BY 1, 2, 3)
 WHERE high_risk > 0 OR keywords > 0""")
O["domain_totals"] = sql("page", "SELECT count(DISTINCT sender_domain) AS sender_domains, " + ", ".join(
    f"count(DISTINCT sender_domain) FILTER (sender_domain_category = '{c}') AS {n}"
    for c, n in (("Internal", "internal"), ("Free Email", "free"), ("Business", "business"))) + " FROM page")
O["policy_recommendations"] = sql("ruled", """SELECT * FROM (SELECT 'Department Monitoring' AS category, 'High' AS priority,
 'Implement enhanced monitoring for ' || department || ' department due to high-risk email activity' AS recommendation,
 count(*) || ' high-risk emails detected' AS rationale FROM ruled WHERE risk_level = 'High' AND department IS NOT NULL GROUP BY department
 ORDER BY count(*) DESC, department LIMIT 1) UNION ALL SELECT * FROM (SELECT 'Business Unit Policy', 'Medium',
 'Review email policies for ' || bunit || ' business unit', count(*) || ' anomalous emails detected' FROM ruled WHERE is_anomaly AND bunit IS NOT NULL GROUP BY bunit
 ORDER BY count(*) DESC, bunit LIMIT 1) UNION ALL SELECT 'Domain Policy', 'Medium',
 'Consider restricting or monitoring free email domain usage for business communications',
 count(*) || ' emails sent from free email domains detected' FROM ruled WHERE sender_domain_category = 'Free Email' HAVING count(*) > 0
 UNION ALL SELECT 'Content Monitoring', 'High', 'Implement automated flagging for emails containing IP-related keywords',
 count(*) || ' emails with IP keywords detected' FROM ruled WHERE ip_keywords_detected > 0 HAVING count(*) > 0""")
O["report_executive"] = sql("page", f"""SELECT count(*) AS total, count(*) FILTER (risk_level = 'High') AS high_risk,
 {pct("count(*) FILTER (risk_level = 'High')", 'count(*)')} AS high_risk_pct FROM page""")
O["report_score_describe"] = sql("page", """SELECT count(risk_score) AS count, round(avg(risk_score), 4) AS mean,
 round(stddev_samp(risk_score), 4) AS std, min(risk_score)::DOUBLE AS min, round(quantile_cont(risk_score, 0.25), 4) AS p25,
 round(quantile_cont(risk_score, 0.5), 4) AS p50, round(quantile_cont(risk_score, 0.75), 4) AS p75, max(risk_score)::DOUBLE AS max FROM page""")
O["report_top_domains"] = sql("page", "SELECT email_domain, count(*) AS mails FROM page GROUP BY 1 ORDER BY mails DESC, email_domain LIMIT 20")
O["report_coverage"] = sql("page", f"SELECT {COV2} AS security_coverage, count(*) AS mails FROM page GROUP BY 1")

# ---- follow-up ----
SEL = """SELECT *, CASE mail_id % 4 WHEN 0 THEN 'Security Inquiry' WHEN 1 THEN 'Data Classification Review' WHEN 2 THEN 'Policy Reminder'
 ELSE 'Something else' END AS kind FROM page WHERE risk_level IN ('High', 'Medium') AND department IN ('IT', 'Sales', 'Engineering')"""
O["followup_select"] = sql("page", "SELECT mail_id, sender, subject, recipients, risk_level, department FROM s", s=SEL)
O["followup_queue"] = sql("page", """SELECT mail_id, risk_level, true AS has_id, '2024-01-31 00:00:00.000000' AS selected_at FROM page
 WHERE risk_level = 'High' OR (risk_level = 'Medium' AND department = 'IT')""")
WHY = """concat_ws('; ', CASE WHEN is_after_hours THEN 'Email sent outside business hours' END,
 CASE WHEN is_leaver THEN 'Sent within 7 days of employee''s last working day' END, CASE WHEN has_attachments THEN 'Contains attachments' END,
 CASE WHEN email_domain_type = 'free' THEN 'Sent to free email provider' END,
 CASE WHEN risk_score >= 61 THEN 'High risk score calculated' WHEN risk_score >= 31 THEN 'Medium risk score calculated' END,
 CASE WHEN recipient_count > 10 THEN 'Large number of recipients (' || recipient_count || ')' END)"""
WHY = f"(CASE WHEN {WHY} = '' THEN 'General security review' ELSE {WHY} END)"
O["followup_reasons"] = sql("page", f"SELECT mail_id, {WHY} AS reasons FROM s", s=SEL)


def filled(i):
    text = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {q(t[i])}" for k, t in TEMPLATES.items()) + f" ELSE {q(TEMPLATES['Security Inquiry'][i])} END"
    values = [("[SENDER_NAME]", NAME), ("[EMAIL_DATE]", DATE)] + ([("[RECIPIENTS]", "recipients")] if i else []) + [
        ("[EMAIL_SUBJECT]", "subject"), ("[RISK_SCORE]", "format('{:.1f}', risk_score::DOUBLE)"), ("[RISK_LEVEL]", "risk_level")] + (
        [("[RISK_FACTORS]", WHY)] if i else [])
    for mark, value in values:
        text = f"replace({text}, {q(mark)}, {value})"
    return text


REN = f"SELECT mail_id, sender AS recipient, {filled(0)} AS subject, {filled(1)} AS body, kind AS template_type FROM s"
O["followup_render"] = sql("page", "SELECT * FROM r", s=SEL, r=REN)
O["followup_mailto"] = sql("page", """SELECT mail_id, 'mailto:' || replace(url_encode(recipient), '%2F', '/') || '?subject=' ||
 replace(url_encode(subject), '%2F', '/') || '&body=' || replace(url_encode(body), '%2F', '/') AS link FROM r""", s=SEL, r=REN)
O["followup_summary"] = sql("page", """SELECT 'total' AS section, 'mails' AS key, count(*)::DOUBLE AS value FROM s UNION ALL
 SELECT 'total', 'successful', count(*) FROM s UNION ALL SELECT 'total', 'errors', 0 UNION ALL SELECT 'total', 'success_pct', 100
 UNION ALL SELECT 'level', risk_level, count(*) FROM s GROUP BY risk_level""", s=SEL)
O["followup_export"] = sql("page", f"""SELECT sender AS recipient, {filled(0)} AS subject, {filled(1)} AS body, '2024-01-31 00:00:00.000000' AS generated_at,
 false AS has_error, {DATE} AS original_date, subject AS original_subject, risk_score, risk_level FROM s""", s=SEL)
KNOWN = lst(V.REQUIRED_PLACEHOLDERS + V.OPTIONAL_PLACEHOLDERS)
O["template_check"] = f"""WITH t AS (SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 'Notice for [SENDER_NAME]' ELSE 'Notice [TICKET_ID]' END) || ' ' ||
 text || (CASE WHEN doc_id % 3 = 0 THEN ' sent [EMAIL_DATE] to [RECIPIENTS]' ELSE '' END) AS x FROM documents)
SELECT doc_id, contains(x, '[SENDER_NAME]') AND contains(x, '[EMAIL_DATE]') AS valid,
 array_to_string(list_transform(list_filter({lst(V.REQUIRED_PLACEHOLDERS)}, lambda p: NOT contains(x, p)),
   lambda p: 'Required placeholder missing: ' || p), '; ') AS errors,
 array_to_string(list_transform(list_filter(regexp_extract_all(x, '\\[[A-Z_]+\\]'), lambda n: NOT list_contains({KNOWN}, n)),
   lambda n: 'Unknown placeholder: ' || n), '; ') AS warnings,
 array_to_string(list_filter({KNOWN}, lambda p: contains(x, p)), ', ') AS placeholders_found FROM t"""
O["followup_status"] = sql("page", """SELECT status, count(*) AS mails, 'mixed' AS stage FROM (SELECT CASE mail_id % 3 WHEN 0 THEN 'Sent' WHEN 1
 THEN 'Responded' ELSE 'Draft' END AS status FROM s) GROUP BY 1 UNION ALL SELECT 'Sent', count(*), 'all sent' FROM s HAVING count(*) > 0""", s=SEL)

ORACLE = O
