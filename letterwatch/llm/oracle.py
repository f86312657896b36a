"""Checking SQL of the operators that SQL can express."""
from __future__ import annotations

from . import mixing, quality_rules, url_filter

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op5() -> str:
    metrics = list(quality_rules.SLACK)
    top = "CASE WHEN bucket < 32 THEN bucket ELSE ((bucket - (bucket - 16) // 16 * 16 + 1) << ((bucket - 16) // 16)) - 1 END"
    inside = " AND ".join(f"{m} BETWEEN {m}_lo AND {m}_hi" for m in metrics)
    fences = ", ".join(f"max(CASE WHEN metric = '{m}' THEN q1 - reach END) {m}_lo, max(CASE WHEN metric = '{m}' THEN q3 + reach END) {m}_hi"
                       for m in metrics)
    slack = " ".join(f"WHEN '{m}' THEN {s}" for m, s in quality_rules.SLACK.items())
    picked = ", ".join(f"CASE WHEN a.docs >= {quality_rules.GROUP_MIN} THEN a.{c} WHEN b.docs >= {quality_rules.GROUP_MIN} THEN b.{c} ELSE c.{c} END {c}"
                       for m in metrics for c in (f"{m}_lo", f"{m}_hi"))
    value = " ".join(f"WHEN '{m}' THEN {m}" for m in metrics)
    return rf"""
WITH split AS (SELECT doc_id, lang, source, coalesce(text, '') t, {WORDS} w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ln FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM split, unnest(range(1, len(w) - 1)) r(i)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) n FROM repeated, range(3) s(k) GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, len(w)::BIGINT n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT n_dup_lines,
    coalesce(n, 0)::BIGINT n_repeat_words, greatest(len(ln), 1) n_lines FROM split LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_SHARE} * n_words base_failed FROM counts),
rated AS (SELECT *, 100 * word_chars // nullif(n_words, 0) word_length, 1000 * n_symbols // nullif(n_words, 0) symbol_rate,
    1000 * n_dup_lines // n_lines dup_line_rate, 1000 * n_repeat_words // nullif(n_words, 0) repeat_rate FROM based),
long AS (SELECT lang, source, metric, CASE metric {value} END v FROM rated, (VALUES {", ".join(f"('{m}')" for m in metrics)}) x(metric)
    WHERE NOT base_failed),
binned AS (SELECT lang, source, metric, CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END bucket, count(*) n
    FROM long GROUP BY ALL),
merged AS (SELECT level, CASE WHEN level < 2 THEN lang END lang, CASE WHEN level < 1 THEN source END source, metric, bucket, sum(n)::BIGINT n
    FROM binned, range(3) x(level) GROUP BY ALL),
ranked AS (SELECT *, {top} AS hi, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) upto,
    sum(n) OVER (PARTITION BY level, lang, source, metric) docs FROM merged),
quartiles AS (SELECT level, lang, source, metric, max(docs) docs, min(CASE WHEN upto * 4 >= docs THEN hi END) q1,
    min(CASE WHEN upto * 4 >= docs * 3 THEN hi END) q3 FROM ranked GROUP BY ALL),
reached AS (SELECT *, {quality_rules.SPAN} * (q3 - q1) + CASE metric {slack} END reach FROM quartiles),
fences AS (SELECT level, lang, source, max(docs) docs, {fences} FROM reached GROUP BY ALL),
picked AS (SELECT a.lang fl, a.source fs, {picked} FROM fences a JOIN fences b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang
    JOIN fences c ON c.level = 2 WHERE a.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce({inside}, false) kept
FROM rated LEFT JOIN picked ON lang IS NOT DISTINCT FROM fl AND source IS NOT DISTINCT FROM fs"""


def op7() -> str:
    weights = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    return f"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
per AS (SELECT source, count(*) n, sum(size)::BIGINT source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ({weights})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] weight,
    {mixing.MOST_COPIES} * source_size cap FROM per),
levels AS (SELECT *, cap / weight stops, row_number() OVER o place,
    ((SELECT sum(source_size) FROM per) - (sum(cap) OVER o - cap))::DOUBLE
        / ((SELECT sum(weight) FROM weighed) - sum(weight) OVER o + weight)::DOUBLE AS level
    FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
settled AS (SELECT min_by(level, place) AS top FROM levels WHERE stops > level),
goals AS (SELECT source AS s, source_size, CASE WHEN top IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, top * weight) END AS target FROM levels, settled),
placed AS (SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS k,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
    FROM sized JOIN goals ON source IS NOT DISTINCT FROM s)
SELECT doc_id, size, source_size, target,
    ((floor((k + 1) * rate + {mixing.offset(mixing.SEED)!r}) - floor(k * rate + {mixing.offset(mixing.SEED)!r})) * size)::BIGINT AS taken FROM placed"""


def op8() -> str:
    def host(u):
        return rf"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}')"

    def path(u):
        return rf"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

    def address(u):
        return rf"({host(u)} || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1))"

    def fits(rule_host, rule_path, h, p):
        return f"(({h} = '{rule_host}' OR {h} LIKE '%.{rule_host}') AND starts_with({p}, '{rule_path}'))"

    def rule(h, p, what):
        ordered = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
        return "CASE " + " ".join(f"WHEN {fits(rh, rp, h, p)} THEN '{rh + rp if what == 'rule' else v}'" for v, rh, rp in ordered) + " END"

    tags = r"""list_concat(
        list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b')),
            lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
        list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')),
            lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))"""
    base = "regexp_extract(url, '(?s)^(.*?)://', 1)"
    folder = f"regexp_extract({path('url')}, '(?s)^(.*/)', 1)"
    return rf"""
WITH RECURSIVE found AS (SELECT url, unnest({tags}) AS link FROM pages WHERE contains(url, '://') AND html IS NOT NULL),
links AS (SELECT DISTINCT url, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN {base} || ':' || link
    WHEN starts_with(link, '/') THEN {base} || '://' || {host('url')} || link
    ELSE {base} || '://' || {host('url')} || (CASE WHEN {folder} = '' THEN '/' ELSE {folder} END) || link END AS target FROM found WHERE link <> ''),
ends AS (SELECT url AS u FROM links UNION SELECT target FROM links),
ruled AS (SELECT {address('u')} AS node, {rule(host('u'), path('u'), 'verdict')} AS v FROM ends),
edges AS (SELECT {address('url')} AS a, {address('target')} AS b FROM links UNION SELECT {address('target')}, {address('url')} FROM links),
reach AS (SELECT node AS a, node AS b FROM ruled UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
aliased AS (SELECT reach.a AS node, min(v) AS v FROM reach JOIN ruled ON reach.b = ruled.node GROUP BY reach.a),
judged AS (SELECT page_id, url, coalesce({host('url')}, '') AS host, coalesce({path('url')}, '') AS path FROM pages)
SELECT page_id, host, path, {rule('host', 'path', 'rule')} AS rule, coalesce({rule('host', 'path', 'verdict')}, aliased.v, 'allow') AS verdict
FROM judged LEFT JOIN aliased ON contains(url, '://') AND {address('url')} = node"""


def op12(k: int = 20) -> str:
    terms = (r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")
    return rf"""
WITH held AS (SELECT d, doc_id, term, count(*) tf FROM (SELECT row_number() OVER () d, doc_id, {terms} term FROM documents) GROUP BY ALL),
sizes AS (SELECT d, sum(tf)::BIGINT n FROM held GROUP BY d),
totals AS (SELECT count(*)::BIGINT docs, sum(n)::BIGINT total FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT w FROM held, totals GROUP BY term, docs),
asked AS (SELECT item, item_id, term, count(*) times FROM (SELECT row_number() OVER () item, item_id, {terms} term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item, item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::BIGINT score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (d), totals GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= {k}"""


def op13() -> str:
    def leaf(n_chars="n_chars"):
        texts = ["doc_id", "source", "lang", n_chars, "text"]
        return "sha256(" + " || ".join(f"coalesce(strlen({t}::VARCHAR) || ':' || {t}::VARCHAR, '-')" for t in texts) + ")"

    # crc32 bit by bit
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), "
           "lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT)")
    return f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, {leaf()} leaf, CASE WHEN {crc} % 7 = 0 THEN {leaf("(n_chars::HUGEINT + 1)")} ELSE {leaf()} END other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) n FROM documents),
tree AS (SELECT 0 AS level, lang, pos, n, leaf AS h FROM leaves UNION ALL
    SELECT level + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY level, lang, pos // 2, n),
subroots AS (SELECT lang, h AS subroot, max(level) OVER (PARTITION BY lang) AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (SELECT 0 AS level, pos, n, subroot AS h FROM subroots UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 2, n),
up AS (SELECT doc_id, lang, leaf, other AS h, '' AS proof, pos, n, 0 AS level FROM leaves UNION ALL
    SELECT up.doc_id, up.lang, up.leaf, sha256(CASE WHEN t.h IS NULL THEN up.h WHEN up.pos % 2 = 0 THEN up.h || t.h ELSE t.h || up.h END),
        proof || coalesce(t.h, ''), up.pos // 2, (up.n + 1) // 2, up.level + 1
    FROM up LEFT JOIN tree t ON t.level = up.level AND t.lang IS NOT DISTINCT FROM up.lang AND t.pos = xor(up.pos, 1) WHERE up.n > 1),
over AS (SELECT up.doc_id, up.leaf, subroot, up.h, proof, s.pos, s.n, 0 AS level FROM up JOIN subroots s ON up.n = 1 AND s.lang IS NOT DISTINCT FROM up.lang
    UNION ALL SELECT o.doc_id, o.leaf, o.subroot, sha256(CASE WHEN t.h IS NULL THEN o.h WHEN o.pos % 2 = 0 THEN o.h || t.h ELSE t.h || o.h END),
        proof || coalesce(t.h, ''), o.pos // 2, (o.n + 1) // 2, o.level + 1
    FROM over o LEFT JOIN crown t ON t.level = o.level AND t.pos = xor(o.pos, 1) WHERE o.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, o.h AS folded_root, o.h = root AS verified
FROM over o, (SELECT h AS root FROM crown WHERE n = 1) WHERE o.n = 1"""


ORACLE = {"op12_lexical": op12(), "op13_merkle": op13(), "op5_quality_rules": op5(), "op7_mixing": op7(), "op8_url_filter": op8()}
