"""Shared stages of the checking SQL (DuckDB dialect), written independently of the Spark expressions."""
from __future__ import annotations

from .. import vocab as V
from ..sources.mail_log import MAIL_LOG_SQL, WHITELIST_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def any_in(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def found_in(text: str, words) -> str:
    return f"list_filter({lst(words)}, lambda w: contains({text}, w))"


FREE = inlist(V.FREE_DOMAINS)
SHAPE = q(V.DOMAIN_SHAPE)


def d_valid(d):
    return f"(length({d}) >= 3 AND regexp_matches({d}, {SHAPE}))"


def d_root(d):
    return f"(CASE WHEN contains({d}, '.') THEN array_to_string(string_split({d}, '.')[-2:], '.') ELSE {d} END)"


def d_infra(d):
    return f"regexp_matches({d}, {q(V.INFRA_DOMAIN)})"


def d_business(d):
    return (f"({d} <> '' AND {d} NOT IN {FREE} AND contains({d}, '.') AND NOT {d_infra(d)} "
            f"AND NOT regexp_matches({d}, {q(V.NON_PRODUCTION)}) AND {d_valid(d)})")


def d_same(a, b):
    return f"({a} <> '' AND {b} <> '' AND {d_root(a)} = {d_root(b)} AND {d_root(a)} NOT IN {FREE})"


def d_internal(s, r):
    a, b = f"trim(lower({s}))", f"trim(lower({r}))"
    return f"({s} <> '' AND {r} <> '' AND (({a} = {b} AND {d_business(a)}) OR {d_same(a, b)}))"


def d_strict(d):
    return (f"(CASE WHEN {d} = '' THEN 'unknown' WHEN {d} IN {FREE} THEN 'free' "
            f"WHEN {d_infra(d)} THEN 'internal' ELSE 'business' END)")


def d_sender_type(s, r):
    return (f"(CASE WHEN {s} = '' THEN 'unknown' WHEN {d_internal(s, r)} THEN 'internal' WHEN {s} IN {FREE} THEN 'free' "
            f"WHEN {d_infra(s)} THEN 'internal' ELSE 'business' END)")


def d_category(d):
    whens = " ".join(f"WHEN {d} IN {inlist(m)} THEN {q(label)}" for label, m in V.PROVIDER_GROUPS.items())
    return f"(CASE WHEN {d} = '' THEN 'unknown' {whens} ELSE 'Business Domain' END)"


def _weight(word):
    return 3 if word in ("bank", "finance", "tech", "health", "edu") else 2 if len(word) > 3 else 1


def d_industry(d):
    exact = " ".join(f"WHEN {d} IN {inlist(m)} THEN {q(label)}" for label, m in V.INDUSTRY_DOMAINS.items())
    score = {k: "(" + " + ".join(f"(CASE WHEN contains({d}, {q(w)}) THEN {_weight(w)} ELSE 0 END)" for w in ws) + ")"
             for k, ws in V.INDUSTRY_WORDS.items()}
    names = list(score)
    best = ""
    for i, name in enumerate(names):
        later = [score[n] for n in names[i + 1:]]
        cond = f"{score[name]} > 0" + "".join(f" AND {score[name]} >= {x}" for x in later)
        best += f" WHEN {cond} THEN {q(name)}"
    fallback = ""
    for label, words, suffix in V.INDUSTRY_FALLBACKS:
        cond = any_in(d, words) + (f" OR ends_with({d}, {q(suffix)})" if suffix else "")
        fallback += f" WHEN {cond} THEN {q(label)}"
    return f"(CASE WHEN {d} = '' OR {d} IN {FREE} THEN 'not_business' {exact}{best}{fallback} ELSE 'business_other' END)"


def d_suspicious(d):
    return f"({d} <> '' AND (" + " OR ".join(f"regexp_matches(lower({d}), {q(p)})" for p, _ in V.SUSPICION_RULES) + "))"


def d_reasons(d):
    parts = ", ".join(f"CASE WHEN regexp_matches({d}, {q(p)}) THEN {q(t)} END" for p, t in V.SUSPICION_RULES)
    return f"concat_ws('; ', {parts})"


def d_external_risk(s, r):
    points = (f"((CASE WHEN {r} IN {FREE} THEN 2 ELSE 0 END) + (CASE WHEN {d_suspicious(r)} THEN 3 ELSE 0 END) + "
              f"(CASE WHEN {d_business(s)} AND {r} IN {FREE} THEN 1 ELSE 0 END))")
    return f"(CASE WHEN {points} >= 4 THEN 'high' WHEN {points} >= 2 THEN 'medium' ELSE 'low' END)"


def joined(arr, sep=", "):
    return f"coalesce(array_to_string({arr}, {q(sep)}), '')"


def stamp(t):
    return f"strftime({t}, '%Y-%m-%d %H:%M:%S.%f')"


MAIL = MAIL_LOG_SQL.format(events="events")
RX_ADDRESS = r"\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z|]{2,})\b"
ORDERED = ("list_filter(regexp_extract_all(lower(recipients), '" + RX_ADDRESS + "', 1), lambda d, i: "
           "list_position(regexp_extract_all(lower(recipients), '" + RX_ADDRESS + "', 1), d) = i AND "
           + d_valid("d") + ")")

RAW = """SELECT mail_id, sender_domain, recipient_domain, email_domain, bunit, department,
  CASE mail_id % 5 WHEN 0 THEN strftime(time, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(time, '%m/%d/%Y %H:%M')
    WHEN 2 THEN 'not a time' WHEN 3 THEN strftime(time, '%Y-%m-%dT%H:%M:%S') END AS time,
  last_working_day,
  CASE WHEN mail_id % 89 = 0 THEN NULL WHEN mail_id % 97 = 0 THEN 'nan' WHEN mail_id % 4 = 0
    THEN '  ' || upper(sender) || chr(9) ELSE sender END AS sender,
  CASE WHEN mail_id % 83 = 0 THEN ' NaN ' WHEN mail_id % 3 = 0 THEN upper(recipients) ELSE recipients END AS recipients,
  CASE WHEN mail_id % 79 = 0 THEN NULL WHEN mail_id % 5 = 0 THEN ' ' || subject || '  ' ELSE subject END AS subject,
  CASE WHEN mail_id % 73 = 0 THEN 'nan' ELSE word_list_match END AS word_list_match,
  CASE WHEN mail_id % 71 = 0 THEN NULL WHEN mail_id % 67 = 0 THEN 'nan' ELSE attachments END AS attachments
FROM mail_log"""
RAW_TIME = """coalesce(try_strptime(time, '%Y-%m-%d %H:%M:%S'), try_strptime(time, '%m/%d/%Y %H:%M'),
  try_strptime(time, '%Y-%m-%dT%H:%M:%S'))"""


def denan(expr):
    return f"(CASE WHEN {expr} = 'nan' THEN '' ELSE {expr} END)"


def trimmed(expr):
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(13))"


DIRTY = f"""SELECT * EXCLUDE (raw_files), coalesce(raw_files <> '', false) AS has_attachments,
  list_sort(list_distinct(regexp_extract_all(coalesce(raw_files, ''), '\\.([a-zA-Z0-9]+)', 1))) AS attachment_types
FROM (SELECT * EXCLUDE (time, sender, recipients, subject, word_list_match, attachments, department, bunit, s, r, w, b, f),
  CASE WHEN mail_id % 41 <> 0 THEN time END AS time, {denan(trimmed("lower(coalesce(s, ''))"))} AS sender, {denan(trimmed("lower(coalesce(r, ''))"))} AS recipients,
  {denan(trimmed("coalesce(b, '')"))} AS subject, {denan(trimmed("coalesce(w, '')"))} AS word_list_match, {denan("coalesce(f, '')")} AS attachments,
  f AS raw_files, CASE WHEN mail_id % 53 <> 0 THEN department END AS department, CASE WHEN mail_id % 47 <> 0 THEN bunit END AS bunit
 FROM (SELECT *, CASE WHEN mail_id % 89 = 0 THEN NULL WHEN mail_id % 97 = 0 THEN 'nan' WHEN mail_id % 4 = 0 THEN '  ' || upper(sender) || chr(9) ELSE sender END AS s,
   CASE WHEN mail_id % 83 = 0 THEN ' NaN ' WHEN mail_id % 3 = 0 THEN upper(recipients) ELSE recipients END AS r,
   CASE WHEN mail_id % 73 = 0 THEN 'nan' ELSE word_list_match END AS w,
   CASE WHEN mail_id % 79 = 0 THEN NULL WHEN mail_id % 5 = 0 THEN ' ' || subject || '  ' ELSE subject END AS b,
   CASE WHEN mail_id % 71 = 0 THEN NULL WHEN mail_id % 67 = 0 THEN 'nan' ELSE attachments END AS f FROM mail_log))"""
NORM = f"""SELECT *, hour(time) AS hour, isodow(time) - 1 AS day_of_week,
  coalesce(hour(time) < 8 OR hour(time) >= 18 OR isodow(time) >= 6, false) AS is_after_hours,
  CAST(floor((epoch_us(time) - epoch_us(last_working_day)) / 86400000000.0) AS INT) AS days_from_last_working,
  coalesce(floor((epoch_us(time) - epoch_us(last_working_day)) / 86400000000.0) BETWEEN -7 AND 7, false) AS is_leaver,
  len(list_filter(regexp_split_to_array(recipients, '[;,\\s]+'), lambda r: contains(r, '@'))) AS recipient_count
FROM dirty"""

CLS = f"""SELECT norm.*, {ORDERED} AS rds,
  {d_sender_type('sender_domain', 'recipient_domain')} AS email_domain_type,
  {d_category('sender_domain')} AS email_domain_category, {d_industry('sender_domain')} AS email_domain_industry
FROM norm"""
CLS2 = f"""SELECT *, len(list_filter(rds, lambda d: d <> sender_domain)) AS external_recipient_count,
  list_contains(rds, sender_domain) AND sender_domain NOT IN {FREE} AS is_internal_communication,
  CASE email_domain_type WHEN 'internal' THEN 'Internal' WHEN 'free' THEN 'Free Email' ELSE 'Business' END
    AS sender_domain_category FROM cls1"""

TEXT = """lower(concat_ws(' ', CASE WHEN subject NOT IN ('', 'nan') THEN subject END,
  CASE WHEN word_list_match NOT IN ('', 'nan') THEN word_list_match END,
  CASE WHEN attachments NOT IN ('', 'nan') THEN attachments END))"""
PUNCT = r"[!-/:-@\[-`{-~]"


def cleaned(text):
    return f"regexp_replace(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '{PUNCT}', ' ', 'g')"


def phrase_list(clean):
    return f"list_filter({lst(V.SENSITIVE_PHRASES)}, lambda k: contains(' ' || {clean} || ' ', ' ' || k || ' '))"


def industry_lists(clean):
    return {i: f"list_transform(list_filter({lst(ws)}, lambda w: contains(' ' || {clean} || ' ', ' ' || w || ' ')), "
               f"lambda w: '{i}:' || w)" for i, ws in V.INDUSTRY_PHRASES.items()}


def keyword_list(clean):
    parts = [phrase_list(clean)] + list(industry_lists(clean).values())
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"list_sort({out})"


def k_category(k):
    whens = " ".join(f"WHEN {k} IN {inlist(m)} THEN {q(label)}" for label, m in V.PHRASE_CATEGORIES.items())
    return f"(CASE {whens} WHEN contains({k}, ':') THEN string_split({k}, ':')[1] ELSE 'general' END)"


PATTERNS = {name: pattern.replace(r"\p{Nd}", r"\d") for name, pattern, _ in V.DATA_PATTERNS}


def hits_of(text):
    return ", ".join(f"len(regexp_extract_all({text}, '{p}')) AS {n}" for n, p in PATTERNS.items())


ATT = "lower(attachments)"
ATT_SCORE = (f"(len({found_in(ATT, ['.' + t for t in V.SENSITIVE_FILE_TYPES])}) * 5 + len({found_in(ATT, V.SIZE_WORDS)}) * 3 "
             f"+ (CASE WHEN length({ATT}) - length(replace({ATT}, '.', '')) > 3 THEN 5 ELSE 0 END) "
             f"+ len({found_in(ATT, V.ARCHIVE_WORDS)}) * 8)")

KW1 = f"SELECT cls.*, {TEXT} AS text FROM cls"
KW2 = f"SELECT kw1.*, {cleaned('text')} AS clean, {hits_of('text')} FROM kw1"
KW3 = f"SELECT kw2.*, {keyword_list('clean')} AS hits FROM kw2"
KW = f"""SELECT *, len(hits) > 0 AS has_ip_keywords, len(hits) AS ip_keyword_count, len(hits) AS ip_keywords_detected,
  {joined('hits')} AS detected_keywords,
  concat_ws(', ', {", ".join(f"CASE WHEN {n} > 0 THEN '{n}' END" for n in PATTERNS)}) AS sensitive_patterns_found,
  least(100, len(hits) * 5 + (ssn + credit_card) * 15 + (phone + email + ip_address) * 5 + (api_key + guid) * 10
    + {ATT_SCORE} + 10 * len(list_filter(list_distinct(list_transform(hits, lambda k: {k_category('k')})),
      lambda c: c IN {inlist(V.BONUS_CATEGORIES)}))) AS sensitivity_score
FROM kw3"""

RFREE = inlist(V.RISK_FREE_DOMAINS)
R_DOMAIN = (f"((CASE WHEN string_split(sender, '@')[2] IN {RFREE} THEN 25 ELSE 0 END) + (CASE WHEN len(list_filter("
            f"string_split(recipients, ','), lambda r: trim(string_split(r, '@')[2]) IN {RFREE})) > 0 THEN 15 ELSE 0 END))")
R_CONTENT = (f"((CASE WHEN {any_in('lower(subject)', V.RISK_SUBJECT_WORDS)} THEN 10 ELSE 0 END) + "
             "(CASE WHEN word_list_match <> '' THEN 20 ELSE 0 END))")
R_ATTACHMENT = (f"(CASE WHEN attachments IN ('', '0') THEN 0 WHEN {any_in(ATT, V.RISK_EXTENSIONS)} THEN 25 ELSE 15 END)")
R_RECIPIENTS = ("(CASE WHEN recipients = '' THEN 0 WHEN len(string_split(recipients, ',')) > 5 THEN 15 "
                "WHEN len(string_split(recipients, ',')) > 2 THEN 10 ELSE 0 END)")
R_LEAVER = "(CASE WHEN last_working_day IS NOT NULL THEN 30 ELSE 0 END)"
R_VOLUME = "(CASE WHEN sender <> '' AND count(*) OVER (PARTITION BY sender) > 10 THEN 10 ELSE 0 END)"
RISK = f"least(100, {R_DOMAIN} + {R_CONTENT} + {R_ATTACHMENT} + {R_RECIPIENTS} + {R_LEAVER} + {R_VOLUME})"


def level(score, labels=("High", "Medium", "Low")):
    return f"(CASE WHEN {score} >= 61 THEN '{labels[0]}' WHEN {score} >= 31 THEN '{labels[1]}' ELSE '{labels[2]}' END)"


SCORED1 = f"SELECT *, {RISK} AS risk_score FROM kw"
WL = WHITELIST_SQL
CAND = """SELECT mail_id, 1 AS pos, 'Sender email' AS kind, sender AS v FROM norm
UNION ALL SELECT mail_id, 2, 'Sender domain', string_split(sender, '@')[-1] FROM norm
UNION ALL SELECT mail_id, 2 * i + 1, 'Recipient email', r FROM rcp
UNION ALL SELECT mail_id, 2 * i + 2, 'Recipient domain', string_split(r, '@')[-1] FROM rcp"""
RCP = """SELECT mail_id, unnest(generate_series(1, len(string_split(recipients, ',')))) AS i,
  trim(unnest(string_split(recipients, ','))) AS r FROM norm"""
REASON = """SELECT mail_id, arg_min(kind || ' ''' || v || ''' is whitelisted', pos) AS whitelist_reason FROM cand
WHERE (kind LIKE '%email' AND v IN (SELECT email_address FROM wl WHERE email_address IS NOT NULL))
   OR (kind LIKE '%domain' AND v IN (SELECT domain FROM wl WHERE domain IS NOT NULL)) GROUP BY mail_id"""

HIT = """SELECT norm.mail_id, time, sender, recipients, subject, department, bunit AS business_unit, whitelist_reason,
  attachments, word_list_match FROM norm JOIN reason USING (mail_id)"""
TIER = f"""CASE WHEN last_working_day IS NOT NULL AND attachments NOT IN ('', '0') AND word_list_match <> ''
   AND {any_in('lower(email_domain)', V.TIER_FREE_MAIL)} THEN 'Critical'
 WHEN last_working_day IS NOT NULL AND attachments NOT IN ('', '0') THEN 'High'
 WHEN last_working_day IS NULL AND attachments NOT IN ('', '0') AND word_list_match <> ''
   AND NOT {any_in('lower(email_domain)', V.TIER_FREE_MAIL)} THEN 'Medium' ELSE 'Low' END"""

RULES = """SELECT mail_id, n >= 5 AND (hour IS NULL OR coalesce(hour_n, 0) < 2) AS time_anomaly,
   coalesce(time IS NOT NULL AND n >= 5 AND day_count >= 3 AND day_std > 0 AND (day_n - day_mean) / nullif(day_std, 0) > 2, false) AS volume_anomaly,
   coalesce(n >= 5 AND ((rc_std > 0 AND (recipient_count - rc_mean) / nullif(rc_std, 0) > 2)
     OR (file_rate < 0.1 AND has_attachments)), false) AS content_anomaly
 FROM (SELECT r.*, count(*) OVER (PARTITION BY sender) AS n, count(*) OVER (PARTITION BY sender, hour) AS hour_n,
    avg(recipient_count) OVER (PARTITION BY sender) AS rc_mean, stddev_samp(recipient_count) OVER (PARTITION BY sender) AS rc_std,
    avg(CAST(has_attachments AS INT)) OVER (PARTITION BY sender) AS file_rate,
    count(*) OVER (PARTITION BY sender, CAST(time AS DATE)) AS day_n, d.* EXCLUDE (s)
  FROM {src} r LEFT JOIN (SELECT sender AS s, avg(c) AS day_mean, stddev_samp(c) AS day_std, count(*) AS day_count FROM
    (SELECT sender, CAST(time AS DATE), count(*) AS c FROM {src} WHERE time IS NOT NULL GROUP BY 1, 2) GROUP BY 1) d ON r.sender = d.s)"""

STAGES = [
    ("mail_log", MAIL), ("wl", WL), ("raw", RAW), ("dirty", DIRTY), ("norm", NORM), ("cls1", CLS), ("cls", CLS2), ("kw1", KW1), ("kw2", KW2),
    ("kw3", KW3), ("kw", KW), ("scored1", SCORED1), ("rcp", RCP), ("cand", CAND), ("reason", REASON), ("hit", HIT),
    ("scored", f"SELECT *, {level('risk_score')} AS risk_level FROM scored1"),
    ("page", "SELECT scored.* FROM scored WHERE mail_id NOT IN (SELECT mail_id FROM reason)"),
    ("low", "SELECT *, coalesce(hour BETWEEN 9 AND 17 AND day_of_week <= 4, false) AS is_business_hours FROM page "
            "WHERE risk_level = 'Low'"),
    ("rules", RULES.format(src="norm")),
    ("page_rules", RULES.format(src="page")),
    ("ruled", "SELECT page.*, time_anomaly OR volume_anomaly OR content_anomaly AS is_anomaly, "
              "-(CAST(time_anomaly AS INT) + CAST(volume_anomaly AS INT) + CAST(content_anomaly AS INT))::DOUBLE AS anomaly_score "
              "FROM page JOIN page_rules USING (mail_id)"),
]
DEPENDS = {"raw": ["mail_log"], "dirty": ["mail_log"], "norm": ["dirty"], "cls1": ["norm"], "cls": ["cls1"], "kw1": ["cls"], "kw2": ["kw1"],
           "kw3": ["kw2"], "kw": ["kw3"], "scored1": ["kw"], "rcp": ["norm"], "cand": ["norm", "rcp"],
           "reason": ["cand", "wl"], "hit": ["norm", "reason"], "scored": ["scored1"], "page": ["scored", "reason"],
           "low": ["page"], "rules": ["norm"], "page_rules": ["page"], "ruled": ["page", "page_rules"]}


def sql(stage: str, select: str, **extra) -> str:
    """The query with the stages it needs in front; ``extra`` adds further named steps."""
    needed, todo = set(), stage.split()
    while todo:
        s = todo.pop()
        if s not in needed:
            needed.add(s)
            todo += DEPENDS.get(s, [])
    steps = [(n, body) for n, body in STAGES if n in needed] + list(extra.items())
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in steps) + "\n" + select
