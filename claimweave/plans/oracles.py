"""SQL for the catalogue's queries, written for DuckDB apart from the column expressions that they check."""

#: A written unit, and its dimension, base, currency and scale.
UNIT_ROWS = [
    ("lakhs of rupees", "currency", "INR", "INR", 1e5), ("GBP thousand", "currency", "GBP", "GBP", 1e3), ("€", "currency", "EUR", "EUR", 1.0), ("dollars (bn)", "currency", "USD", "USD", 1e9), ("crores, in INR", "currency", "INR", "INR", 1e7),
    ("percentage of price", "percent", "percent", None, 1.0), ("basis points", "percent", "percent", None, 0.01), ("kilograms", "mass", "tonnes", None, 0.001), ("thousand tons", "mass", "tonnes", None, 1e3),
    ("stores", "count", "items", None, 1.0), ("mln vehicles", "count", "items", None, 1e6), ("hundred", "count", "items", None, 1e2), (" ", None, None, None, None), (None, None, None, None, None), ("furlongs", None, None, None, None), ("9 hrs.", "currency", "INR", "INR", 1.0),
]
SCOPE_NAMES = ["Consolidated", "standalone", "total", "automobile parts", None]
#: A page's ending, a qualifier, and whether the page supports it.
QUALIFIER_ROWS = [("adj. figures", "Adjusted", True), ("plain", "adjusted", False), ("group accounts", "consolidated", True), ("group accounts", "standalone", False), ("group accounts", "standalone and consolidated", True), ("unaudited", "audited", True), ("forecast", "projection", True), ("as stated", "restated", False)]


def _lit(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


UNITS = f"""SELECT p_partkey, dimension, base, currency, p_retailprice * scale AS canonical FROM part
JOIN (VALUES {", ".join(f"({k}, {_lit(d)}, {_lit(b)}, {_lit(c)}, {'NULL' if s is None else f'{s!r}::DOUBLE'})" for k, (_, d, b, c, s) in enumerate(UNIT_ROWS))}) u(k, dimension, base, currency, scale) ON p_partkey % {len(UNIT_ROWS)} = k"""

_ORDERS = "SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderdate::DATE + INTERVAL 9 MONTH)::DATE AS t FROM orders"
_FY = "make_date(year(t)::INT - 1, 4, 1)"
_FQ = "(make_date(year(t)::INT - 1, 4, 1) + to_months((3 * (quarter(t) - 1))::INT))::DATE"
PERIODS = f"""SELECT o_orderkey,
 (CASE o_orderkey % 9 WHEN 0 THEN {_FY} WHEN 1 THEN {_FQ} WHEN 2 THEN date_trunc('quarter', d) WHEN 3 THEN date_trunc('year', d) WHEN 4 THEN d
  WHEN 5 THEN date_trunc('month', d - INTERVAL 2 MONTH) WHEN 6 THEN make_date(year(d)::INT, CASE WHEN month(d) <= 6 THEN 1 ELSE 7 END, 1) WHEN 7 THEN CASE WHEN year(t) = 2000 THEN make_date(1999, 1, 1) ELSE {_FY} END ELSE make_date(year(d)::INT, 4, 1) END)::DATE::VARCHAR AS start,
 (CASE o_orderkey % 9 WHEN 0 THEN {_FY} + INTERVAL 12 MONTH - INTERVAL 1 DAY WHEN 1 THEN {_FQ} + INTERVAL 3 MONTH - INTERVAL 1 DAY WHEN 2 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY
  WHEN 3 THEN make_date(year(d)::INT, 12, 31) WHEN 4 THEN d WHEN 5 THEN d WHEN 6 THEN CASE WHEN month(d) <= 6 THEN make_date(year(d)::INT, 6, 30) ELSE make_date(year(d)::INT, 12, 31) END
  WHEN 7 THEN CASE WHEN year(t) = 2000 THEN make_date(1999, 12, 31) ELSE {_FY} + INTERVAL 12 MONTH - INTERVAL 1 DAY END ELSE last_day(make_date(year(d)::INT + (month(d) < 4)::INT, month(d)::INT, 1)) END)::DATE::VARCHAR AS "end"
FROM ({_ORDERS})"""
RELATES = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'overlaps' ELSE 'contains' END AS rel, CASE WHEN o_orderkey % 2 = 0 THEN 'overlaps' ELSE 'during' END AS reverse FROM ({_ORDERS})"""
SCOPES = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'subsumed_by' WHEN 1 THEN 'unknown' WHEN 2 THEN 'subsumed_by'
  WHEN 3 THEN CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'subsumes' ELSE 'disjoint' END ELSE 'unknown' END AS rel,
 CASE c_custkey % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'subsumed_by' WHEN 2 THEN 'unknown' WHEN 3 THEN 'subsumed_by' ELSE 'unknown' END AS to_group FROM customer"""

#: Claims on revenue: amounts in ten-thousandths are whole numbers, and rounding is half up.
_REVENUE = """
sold AS (SELECT l_suppkey, year(t)::INT AS fy, quarter(t)::INT AS q, sum(n)::HUGEINT AS n4 FROM (
  SELECT l_suppkey, (l_shipdate::DATE + INTERVAL 9 MONTH)::DATE AS t, (l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) * 10000)::HUGEINT AS n FROM lineitem) GROUP BY ALL),
years AS (SELECT l_suppkey, fy, sum(n4)::HUGEINT AS n4 FROM sold GROUP BY ALL),
claims AS (
  SELECT 'A-' || l_suppkey || '-FY' || fy AS id, 'A' AS doc, l_suppkey AS s, fy, 0 AS q, (((n4 + 5000) // 10000)::DOUBLE / 1e6) AS low, 1e6 AS scale FROM years
  UNION ALL SELECT 'B-' || l_suppkey || '-FY' || fy, 'B', l_suppkey, fy, 0, (((n4 + 5000000) // 10000000)::DOUBLE / 1e4), 1e7 FROM years
  UNION ALL SELECT 'C-' || l_suppkey || '-Q' || q || ' FY' || fy, 'C', l_suppkey, fy, q, (((n4 + 5000) // 10000)::DOUBLE / 1e7), 1e7 FROM sold),
known AS (SELECT c.*, low * scale AS v, s_name FROM claims c JOIN supplier ON s = s_suppkey)"""


def _relations(claims: str = "known") -> str:
    return f"""pairs AS (SELECT a.id AS claim_a_id, b.id AS claim_b_id, a.doc AS da, b.doc AS db, a.v AS va, b.v AS vb, a.doc <> b.doc AS cross_doc,
  CASE WHEN a.fy = b.fy AND a.q = b.q THEN 'equals' WHEN a.fy = b.fy AND a.q = 0 THEN 'contains' WHEN a.fy = b.fy AND b.q = 0 THEN 'during' ELSE 'apart' END AS p
  FROM {claims} a JOIN {claims} b ON a.s = b.s AND a.id < b.id),
rel AS (SELECT *, CASE WHEN p = 'apart' THEN 'complementary'
    WHEN p = 'contains' THEN CASE WHEN vb > va AND va > 0 THEN 'contradicts' ELSE 'complementary' END WHEN p = 'during' THEN CASE WHEN va > vb AND vb > 0 THEN 'contradicts' ELSE 'complementary' END
    WHEN abs(va - vb) / greatest(abs(va), abs(vb), 1e-9) <= 0.01 THEN 'corroborates' ELSE 'contradicts' END AS verdict,
  CASE WHEN p = 'apart' THEN 0.9 WHEN p = 'equals' THEN CASE WHEN abs(va - vb) / greatest(abs(va), abs(vb), 1e-9) <= 0.01 THEN 0.9 ELSE 0.85 END
    WHEN (p = 'contains' AND vb > va AND va > 0) OR (p = 'during' AND va > vb AND vb > 0) THEN 0.85 ELSE 0.9 END::DOUBLE AS confidence,
  substr(sha256(claim_a_id || '|' || claim_b_id), 1, 16) AS id FROM pairs)"""


_ORDER = "CASE verdict WHEN 'contradicts' THEN 0 WHEN 'corroborates' THEN 1 WHEN 'supersedes' THEN 2 WHEN 'complementary' THEN 3 ELSE 4 END, cross_doc DESC, confidence DESC, id"
PAIRS = f"WITH {_REVENUE}, {_relations()} SELECT claim_a_id, claim_b_id, verdict, confidence, cross_doc FROM rel"
VERDICTS = f"WITH {_REVENUE}, {_relations()} SELECT verdict, count(*) AS n FROM rel GROUP BY verdict"
VIOLATIONS = f"WITH {_REVENUE}, raised AS (SELECT * REPLACE (CASE WHEN doc = 'C' THEN 3 * v ELSE v END AS v) FROM known), {_relations('raised')} SELECT claim_a_id, claim_b_id, verdict FROM rel WHERE p IN ('contains', 'during') AND verdict = 'contradicts'"
CAPPED = f"WITH {_REVENUE} SELECT id, lower(replace(s_name, '#', ' ')) AS block_subject, 'revenue' AS block_measure FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id) AS k FROM known) WHERE k <= 20"
INCREMENTAL = f"WITH {_REVENUE}, {_relations()} SELECT claim_a_id, claim_b_id, verdict FROM rel WHERE (da = 'C' OR db = 'C') AND NOT (p = 'contains' AND da = 'A' AND claim_b_id LIKE '%-Q1 %')"
REVIEW = f"WITH {_REVENUE}, {_relations()} SELECT id, claim_a_id, claim_b_id, verdict, confidence, cross_doc FROM rel ORDER BY {_ORDER} LIMIT 200"
SUMMARY = f"WITH {_REVENUE}, {_relations()} SELECT (SELECT count(*) FROM known) AS claims, (SELECT count(*) FROM known) AS active, 0::BIGINT AS quarantined, (SELECT count(DISTINCT doc) FROM known) AS documents, count(*) AS relations, count(*) FILTER (cross_doc) AS cross_doc FROM rel"
HIGHLIGHTS = f"""WITH {_REVENUE}, {_relations()},
one AS (SELECT 'corroborated across documents' AS "case", * FROM rel WHERE verdict = 'corroborates' AND cross_doc UNION ALL SELECT 'contradicted', * FROM rel WHERE verdict = 'contradicts'
  UNION ALL SELECT 'part of a period', * FROM rel WHERE verdict = 'complementary' AND p IN ('contains', 'during'))
SELECT "case", claim_a_id, claim_b_id FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY cross_doc DESC, confidence DESC, id) AS k FROM one) WHERE k = 1"""
REFRESHED = f"WITH {_REVENUE} SELECT id, CASE WHEN doc = 'A' AND s_name = 'Supplier#000000001' THEN 'Renamed Works' ELSE s_name || ' Limited' END AS subject_raw, CASE WHEN doc = 'A' AND s_name = 'Supplier#000000001' THEN 'renamed works' ELSE lower(replace(s_name, '#', ' ')) END AS subject_key FROM known"
REBUILT = f"""WITH {_REVENUE} SELECT id, (make_date(fy - 1, 4, 1) + to_months(CASE WHEN q = 0 THEN 0 ELSE 3 * (q - 1) END))::DATE::VARCHAR AS period_start,
  (make_date(fy - 1, 4, 1) + to_months(CASE WHEN q = 0 THEN 12 ELSE 3 * q END) - INTERVAL 1 DAY)::DATE::VARCHAR AS period_end, v AS canonical_low, 'currency' AS dimension, 'INR' AS currency FROM known"""
NEGATIVE = "SELECT DISTINCT 'balance_' || lower(c_mktsegment) AS measure_key FROM customer WHERE c_acctbal < 0 UNION SELECT 'balance_supplier' FROM supplier WHERE s_acctbal < 0"
GENERIC = """SELECT measure_key, count(DISTINCT round(v, 4)) AS "values" FROM (SELECT 'balance_' || lower(c_mktsegment) AS measure_key, c_acctbal AS v FROM customer UNION ALL SELECT 'balance_supplier', s_acctbal FROM supplier) GROUP BY 1 HAVING count(DISTINCT round(v, 4)) > 12"""
MISSING = f"""WITH {_REVENUE}, b AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n), r AS (SELECT count(*) AS n FROM known)
SELECT b.n + r.n AS n, b.n AS no_period_label, b.n AS no_scope, b.n + r.n AS no_basis, b.n + r.n AS no_as_of, 0::BIGINT AS no_unit_raw FROM b, r"""
SUPERSEDES = """WITH last AS (SELECT user_id, ts::DATE AS day, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY ALL),
c AS (SELECT user_id || '-' || day AS id, * FROM last)
SELECT a.id AS claim_a_id, b.id AS claim_b_id, CASE WHEN a.kind = b.kind THEN 'corroborates' ELSE 'supersedes' END AS verdict, CASE WHEN a.kind = b.kind THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence
FROM c a JOIN c b ON a.user_id = b.user_id AND a.id < b.id"""

#: RE2 knows words of ASCII letters only: other letters and digits are written as x, which is in no pattern's place.
_PLAIN = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F₹€£]', 'x', 'g')"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


def _saturated(pattern: str, half: int, weight: float) -> str:
    return f"(CASE WHEN {_count(pattern)} > 0 THEN least(ln(1 + {_count(pattern)}::DOUBLE) / ln(1 + {half * 4}.0), 1.0) ELSE 0.0 END) * {weight}"


# The patterns of signs that score a page.
_UNIT = r"(?i)(₹|\$|€|£|%|\bper\s?cent\b|\bpercent\b|\bcrore\b|\blakh\b|\bmillion\b|\bbillion\b|\btrillion\b|\bmn\b|\bbn\b|\bcr\b|\brs\.?\b|\binr\b|\busd\b|\btons?\b|\btonnes?\b|\bkg\b|\bgw\b|\bbps\b)"
_PERIOD = r"(?i)(\bfy\s?\d{2,4}\b|\bq[1-4]\b|\b(?:19|20)\d{2}\b|\byear ended\b|\bquarter ended\b|\bas (?:at|of)\b|\bhalf[- ]year\b|\bh[12]\b|\bfiscal\b|\bas on\b)"
_ENTITY = r"(?i)(\bdirector\b|\bchairman\b|\bchief \w+ officer\b|\bappointed\b|\bresigned\b|\bceased\b|\bregistered office\b|\bincorporat\w+\b|\bcin\b|\bdin\b|\bsecretary\b)"
_ASSERTION = r"(?i)(\bprojected\b|\bexpected\b|\bestimated?\b|\bforecast\w*\b|\bstood at\b|\bincreased?\b|\bdeclined?\b|\bgrew\b|\brecorded\b|\breported\b|\brose\b|\bwas\b|\bis\b|\bamounted to\b|\bregistering\b|\bcompared (?:to|with)\b|\brevised\b|\brestated\b|\bassessed\b|\bplaced at\b)"
_SCORED = rf"""pages AS (SELECT source AS doc_id, doc_id AS page_no, text, {_PLAIN} AS t FROM documents),
scored AS (SELECT doc_id, page_no, text, CASE WHEN length(coalesce(text, '')) < 120 THEN 0.0 ELSE round({_saturated(r"\d[\d,]*\.?\d*", 25, 2.0)} + {_saturated(_UNIT, 8, 2.0)} + {_saturated(_PERIOD, 5, 2.0)}
  + {_saturated(_ASSERTION, 6, 2.0)} + {_saturated(_ENTITY, 3, 1.5)} + least({_count(r"\S+")} / 250.0, 1.0) * 0.5
  + CASE WHEN regexp_matches(t, '(?im)(table of contents|^\s*contents\s*$|this page (?:has been |is )?intentionally left blank)') THEN -3.0 ELSE 0.0 END, 3) END::DOUBLE AS score FROM pages)"""
SCORES = f"WITH {_SCORED} SELECT page_no, score FROM scored"
TOP_PAGES = f"WITH {_SCORED} SELECT doc_id, page_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_no) AS k FROM scored WHERE score >= 1.5) WHERE k <= 5"
COVERAGE = f"""WITH {_SCORED} SELECT doc_id, count(*) AS pages_total, count(*) FILTER (score >= 1.5) AS pages_selected, greatest(sum(length(coalesce(text, ''))), 1)::BIGINT AS chars_total,
  coalesce(sum(length(coalesce(text, ''))) FILTER (score < 1.5), 0)::BIGINT AS chars_skipped, round(1 - coalesce(sum(length(coalesce(text, ''))) FILTER (score < 1.5), 0)::DOUBLE / greatest(sum(length(coalesce(text, ''))), 1)::DOUBLE, 4) AS char_coverage FROM scored GROUP BY doc_id"""
PRINTED = r"""WITH p AS (SELECT doc_id AS page_no, list_filter(list_transform(string_split(CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || chr(10) || ' ' || (doc_id % 10000)::VARCHAR || ' ' || chr(10) ELSE text END, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS w FROM documents)
SELECT page_no, list_filter(list_concat(w[greatest(len(w) - 1, 1):len(w)], w[1:2]), lambda x: regexp_full_match(x, '\d{1,4}'))[1] AS printed_page FROM p"""
#: White space and letters of words beyond ASCII, which RE2 must be told.
_SPACE, _LETTER = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_QUOTES = rf"""p AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 5 AS k, ((doc_id * 7919) % greatest(length(coalesce(text, '')) - 150, 1) + 1)::INT AS pos FROM documents),
r AS (SELECT *, CASE k WHEN 0 THEN substr(text, pos, 60) WHEN 1 THEN replace(substr(text, pos, 60), ' ', '  ') WHEN 2 THEN substr(text, pos, 5)
  WHEN 3 THEN substr(text, pos, 40) || ' zqxzq ' || substr(text, pos + 60, 40) ELSE 'zq' || md5(doc_id::VARCHAR) || ' zq' || sha1(doc_id::VARCHAR) END AS raw FROM p),
q AS (SELECT *, regexp_replace(raw, '^{_SPACE}|{_SPACE}$', '', 'g') AS quote, list_sum(list_transform(regexp_extract_all(lower(raw), '[{_LETTER}][{_LETTER}.,%/&''-]*'), lambda x: length(x))) AS size FROM r),
g AS (SELECT *, doc_id::VARCHAR AS id, CASE WHEN doc_id % 37 = 0 THEN NULL WHEN length(quote) < 8 THEN 'unverifiable' WHEN contains(text, quote) THEN 'exact' WHEN k = 1 THEN 'fuzzy'
  WHEN k = 3 AND (size - 5) / size >= 0.85 THEN 'gapped' ELSE 'not_found' END AS grounding, strpos(text, quote) - 1 AS place FROM q),
s AS (SELECT *, CASE WHEN grounding IN ('exact', 'fuzzy', 'gapped') THEN 'active' ELSE 'quarantined' END AS status FROM g),
d AS (SELECT *, status = 'active' AND NOT (contains(lower(text), 'group') OR contains(lower(text), 'consolidated') OR contains(lower(text), 'consolidation')) AS d_scope, status = 'active' AND NOT contains(lower(text), 'audited') AS d_basis,
  status = 'active' AND doc_id % 2 = 0 AND NOT (contains(lower(text), 'projection') OR contains(lower(text), 'projected') OR contains(lower(text), 'forecast') OR contains(lower(text), 'expected')) AS d_estimate FROM s)"""
GROUNDING = f"WITH {_QUOTES} SELECT id, grounding, status, CASE WHEN grounding = 'exact' THEN place ELSE -1 END::BIGINT AS char_start FROM d"
#: Every block of the quote from eight characters on that the page holds; the longest, of these the first in the quote.
ANCHORS = f"""WITH {_QUOTES}, c AS (SELECT id, text, raw, unnest(range(1, length(raw) - 6)) AS i FROM d WHERE grounding IN ('fuzzy', 'gapped')),
b AS (SELECT id, text, raw, i, unnest(range(8, length(raw) - i + 2)) AS n FROM c), f AS (SELECT id, i, n, strpos(text, substr(raw, i, n)) - 1 AS place FROM b WHERE contains(text, substr(raw, i, n))),
best AS (SELECT id, place, n FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, i) = 1)
SELECT d.id, d.grounding, CASE WHEN d.grounding = 'exact' THEN d.place ELSE best.place END::BIGINT AS char_start, CASE WHEN d.grounding = 'exact' THEN d.place + length(d.quote) ELSE best.place + n END::BIGINT AS char_end FROM d LEFT JOIN best ON d.id = best.id"""
STATUS = f"WITH {_QUOTES} SELECT status, grounding, count(*) AS n FROM d GROUP BY ALL"
GROUNDING_REPORT = f"""WITH {_QUOTES} SELECT count(*) AS total, count(*) FILTER (grounding = 'exact') AS exact, count(*) FILTER (grounding = 'fuzzy') AS fuzzy, count(*) FILTER (grounding = 'gapped') AS gapped, count(*) FILTER (grounding = 'not_found') AS not_found,
  count(*) FILTER (grounding = 'unverifiable') AS unverifiable, count(*) FILTER (status = 'quarantined') AS quarantined, sum(d_scope::INT + d_basis::INT + d_estimate::INT)::BIGINT AS qualifiers_dropped,
  round((count(*) - count(*) FILTER (grounding IN ('not_found', 'unverifiable')))::DOUBLE / count(*), 4) AS grounding_rate FROM d"""
DROPPED = f"""WITH {_QUOTES}, x AS (SELECT 'scope' AS qualifier, 'Group' AS value, d_scope AS gone FROM d UNION ALL SELECT 'basis', 'audited', d_basis FROM d UNION ALL SELECT 'estimate_type', 'forecast', d_estimate FROM d)
SELECT qualifier, value, count(*) AS n FROM x WHERE gone GROUP BY ALL"""
QUARANTINED = f"""WITH {_QUOTES} SELECT id, CASE WHEN doc_id % 2 = 0 THEN id || '.txt' ELSE id END AS document, grounding,
  CASE WHEN grounding IS NULL THEN 'cited page 2 not in document' WHEN grounding = 'unverifiable' THEN 'evidence too short to verify: ' || chr(39) || substr(quote, 1, 60) || chr(39) ELSE 'quote not found on the page it cites: ' || chr(39) || substr(raw, 1, 120) || chr(39) END AS quarantine_reason
FROM d WHERE status = 'quarantined' ORDER BY id LIMIT 6"""
QUALIFIERS = f"SELECT p_partkey, supported FROM part JOIN (VALUES {', '.join(f'({k}, {str(x[2]).lower()})' for k, x in enumerate(QUALIFIER_ROWS))}) v(k, supported) ON p_partkey % {len(QUALIFIER_ROWS)} = k"
MEASURES = "SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS norm FROM part"
SUBJECTS = "SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS norm FROM customer"
CANDIDATES = """WITH n AS (SELECT DISTINCT lower(p_name) AS n FROM part),
f AS (SELECT n, list_distinct(list_transform(range(1, length(n) + 3), lambda i: substr('  ' || n || '  ', i, 3))) AS g, list_distinct(string_split(n, ' ')) AS w FROM n),
s AS (SELECT a.n AS norm, b.n AS candidate, greatest(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w)))) AS sim FROM f a JOIN f b ON a.n <> b.n)
SELECT norm, candidate, round(sim, 6) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY sim DESC, candidate) AS rank FROM s WHERE sim >= 0.45) WHERE rank <= 2"""
MERGED = """WITH n AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1), two AS (SELECT p_name AS name, p_name AS first FROM n UNION ALL SELECT array_to_string(list_reverse(string_split(p_name, ' ')), ' '), p_name FROM n)
SELECT name, replace(first, ' ', '_') AS key FROM two"""
LISTED = """WITH n AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1), two AS (SELECT p_name AS name, p_name AS first FROM n UNION ALL SELECT array_to_string(list_reverse(string_split(p_name, ' ')), ' '), p_name FROM n)
SELECT replace(first, ' ', '_') AS key, first AS canonical_name, count(DISTINCT name)::INT AS n_forms FROM two GROUP BY ALL"""
SALVAGED = "SELECT conv_id, turn, CASE WHEN conv_id % 4 <> 3 THEN turn::VARCHAR END AS found FROM conversations"

_LABEL = "regexp_extract(claim_{x}_id, '(Q[1-4] )?FY[0-9]+$')"
CONTRADICTIONS = f"""WITH {_REVENUE}, raised AS (SELECT * REPLACE (CASE WHEN doc = 'C' THEN 3 * v ELSE v END AS v) FROM known), {_relations('raised')}
SELECT claim_a_id, claim_b_id, 'Revenue' AS a_measure_raw, da AS a_doc_id, db AS b_doc_id, {_LABEL.format(x="a")} AS a_period_label, {_LABEL.format(x="b")} AS b_period_label, 'consolidated' AS a_scope, 'consolidated' AS b_scope
FROM rel WHERE verdict = 'contradicts' ORDER BY {_ORDER} LIMIT 15"""
PICKED = f"""WITH {_REVENUE}, {_relations()}
SELECT 'part' AS "case", claim_a_id, claim_b_id FROM (SELECT * FROM rel WHERE verdict = 'complementary' AND p IN ('contains', 'during') ORDER BY {_ORDER} LIMIT 1)
UNION ALL SELECT 'same', claim_a_id, claim_b_id FROM (SELECT * FROM rel WHERE verdict = 'corroborates' AND NOT cross_doc ORDER BY {_ORDER} LIMIT 1)
UNION ALL SELECT 'same', claim_a_id, claim_b_id FROM (SELECT * FROM rel WHERE verdict = 'corroborates' AND cross_doc ORDER BY {_ORDER} LIMIT 1)"""
BY_ID = f"WITH {_REVENUE} SELECT id, doc AS doc_id, low FROM known WHERE doc = 'A' AND fy = 1996 AND s IN (SELECT n_nationkey FROM nation)"
RECALL = f"""WITH {_SCORED}, placed AS (SELECT doc_id, text, CASE WHEN score >= 1.5 THEN row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_no) END AS place FROM scored),
needles AS (SELECT DISTINCT source AS doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 5, 24) ELSE 'absent ' || doc_id END AS needle FROM documents WHERE doc_id % 101 = 0 AND length(text) > 40),
hits AS (SELECT n.doc_id, needle, min(place) AS place FROM needles n LEFT JOIN placed p ON p.doc_id = n.doc_id AND contains(p.text, needle) GROUP BY ALL),
c AS (SELECT count(*) FILTER (place <= 5) AS found_5, count(*) FILTER (place <= 20) AS found_20, count(*) FILTER (place IS NOT NULL) AS found_all, count(*) AS known FROM hits)
SELECT *, round(found_5 / known, 4) AS recall_5, round(found_20 / known, 4) AS recall_20, round(found_all / known, 4) AS recall_all FROM c"""
_ANSWERED = """o AS (SELECT o_orderkey AS k, 'D' || (o_custkey % 10) AS doc_id, 'House ' || (o_custkey % 10) AS house, o_orderkey::INT AS page_no, o_totalprice AS price, o_orderdate::DATE AS d, make_date(year(o_orderdate::DATE + INTERVAL 9 MONTH)::INT - 1, 4, 1)::VARCHAR AS fy,
  o_orderkey % 11 <> 0 AND (o_orderkey % 13 = 0 OR o_orderkey % 7 <> 0) AS valid FROM orders)"""
BUILT = f"""WITH {_ANSWERED}
SELECT doc_id, page_no, 'order price' AS measure_raw, 'number' AS value_kind, price AS low, price AS high, 'USD' AS unit_raw, 'currency' AS dimension, CASE WHEN k % 2 = 0 THEN 'Buyer Ltd' ELSE house END AS subject_raw, 'group' AS scope, NULL::VARCHAR AS date_value, fy AS period_start, '2024-05-01' AS as_of, 0.75::DOUBLE AS confidence
FROM o, range(CASE WHEN k % 13 = 0 THEN 20 ELSE 1 END) WHERE valid
UNION ALL SELECT doc_id, page_no, 'discount', 'range', 2.5, 5, 'per cent', 'percent', house, 'total', NULL, '2024-01-01', '2024-05-01', 1 FROM o WHERE valid AND k % 13 <> 0
UNION ALL SELECT doc_id, page_no, 'order date', 'date', NULL, NULL, NULL, NULL, house, 'total', d::VARCHAR, '2024-01-01', '2024-05-01', 0.5 FROM o WHERE valid AND k % 13 <> 0 AND k % 3 <> 0"""
REJECTED = f"WITH {_ANSWERED} SELECT doc_id, page_no FROM o WHERE NOT valid"
#: What decides the pairs of each kind, and how; pairs of unlike subjects give no relation.
RULE_ROWS = [
    (0, "underspecified", 0.4), (1, "underspecified", 0.4), (2, "underspecified", 0.45), (3, "underspecified", 0.45), (4, "underspecified", 0.4), (5, "complementary", 0.9), (6, "complementary", 0.8), (7, "contradicts", 0.85), (8, "complementary", 0.9), (9, "complementary", 0.88),
    (10, "complementary", 0.85), (11, "underspecified", 0.5), (12, "complementary", 0.85), (13, "underspecified", 0.45), (14, "underspecified", 0.5), (15, "corroborates", 0.9), (16, "supersedes", 0.85), (17, "contradicts", 0.85), (18, "complementary", 0.9),
]
RULED = f"SELECT 'a-' || p_partkey AS claim_a_id, 'b-' || p_partkey AS claim_b_id, verdict, confidence::DOUBLE AS confidence FROM part JOIN (VALUES {', '.join(map(str, RULE_ROWS))}) v(k, verdict, confidence) ON p_partkey % 20 = k"
UPSERTED = """SELECT c_custkey::VARCHAR AS doc_id, 'v0-' || c_custkey AS filename, CASE WHEN c_custkey % 5 = 0 THEN 'v2 ' WHEN c_custkey % 3 = 0 THEN 'v1 ' ELSE 'v0 ' END || c_mktsegment AS title FROM customer
UNION ALL SELECT (c_custkey + 1000000)::VARCHAR, 'v2-' || (c_custkey + 1000000), 'v2 ' || c_mktsegment FROM customer WHERE c_custkey % 7 = 0"""
DECIDED = """WITH n AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT p_name AS name, replace(lower(p_name), ' ', '_') AS key FROM n UNION ALL SELECT p_name || ' net', replace(lower(p_name), ' ', '_') || CASE WHEN k % 2 = 0 THEN '' ELSE '_net' END FROM n"""
LOOKED_UP = """WITH c AS (SELECT d.source AS doc_id, d.doc_id + CASE WHEN d.doc_id % 4 = 0 THEN 10000000 ELSE 0 END AS page_no FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT c.doc_id, c.page_no, length(d.text)::BIGINT AS chars FROM c LEFT JOIN documents d ON d.source = c.doc_id AND d.doc_id = c.page_no"""
PROFILES = "SELECT conv_id::VARCHAR AS doc_id, (sum(length(coalesce(text, ''))) + count(*) - 1)::BIGINT AS chars FROM conversations WHERE turn < 3 GROUP BY conv_id"

#: Of an even number, a supplier's figure is a net result, a measure that goes negative in the end.
FOLLOWED = f"""WITH {_REVENUE}, last AS (SELECT * REPLACE (CASE WHEN doc = 'B' AND s % 7 = 0 THEN 1.5 * v WHEN doc = 'C' AND s % 3 < 2 THEN 3 * v ELSE v END AS v) FROM known WHERE NOT (doc = 'C' AND s % 5 = 0)), {_relations('last')},
two AS (SELECT *, p IN ('contains', 'during') AND split_part(claim_a_id, '-', 2)::BIGINT % 2 = 0 AS unchecked FROM rel)
SELECT claim_a_id, claim_b_id, CASE WHEN unchecked THEN 'complementary' ELSE verdict END AS verdict, CASE WHEN unchecked THEN 0.9::DOUBLE ELSE confidence END AS confidence, cross_doc FROM two"""
ASKED = """WITH p AS (SELECT doc_id AS page_no, coalesce(text, '') AS t FROM documents), o AS (SELECT page_no, CASE WHEN t IN (SELECT t FROM p WHERE page_no % 4 = 0) THEN 'cached'
  ELSE CASE length(t) % 5 WHEN 0 THEN 'first' WHEN 1 THEN 'repaired' WHEN 2 THEN 'failed' WHEN 3 THEN 'unanswered' ELSE 'first' END END AS outcome FROM p)
SELECT page_no, outcome, outcome IN ('cached', 'first', 'repaired') AS answered FROM o"""
AUDITED = """WITH c AS (SELECT c_custkey AS k, 'balance_' || lower(c_mktsegment) AS m, round(c_acctbal, 4) AS v, CASE WHEN c_custkey % 7 = 0 THEN 'florins' WHEN c_custkey % 9 = 0 THEN 'guilders' ELSE 'USD' END AS unit,
  CASE WHEN c_custkey % 11 = 0 THEN 'quarantined' ELSE 'active' END AS status, CASE WHEN c_custkey % 11 = 0 THEN 'not_found' WHEN c_custkey % 3 = 0 THEN 'exact' ELSE 'fuzzy' END AS grounding FROM customer),
a AS (SELECT * FROM c WHERE status = 'active')
SELECT 'by_status' AS audit, status AS a, grounding AS b, 'number' AS c, count(*)::BIGINT AS n FROM c GROUP BY ALL
UNION ALL SELECT 'missing_qualifiers', x.a, NULL, NULL, x.n FROM (SELECT unnest([{'a': 'n', 'n': count(*)}, {'a': 'no_period_label', 'n': count(*) FILTER (k % 10 > 1)}, {'a': 'no_scope', 'n': count(*) FILTER (k % 2 <> 0)},
  {'a': 'no_basis', 'n': count(*) FILTER (k % 5 <> 0)}, {'a': 'no_as_of', 'n': count(*) FILTER (k % 4 <> 0)}, {'a': 'no_unit_raw', 'n': 0}]) AS x FROM a)
UNION ALL SELECT 'dropped_qualifiers', 'scope', 'standalone', NULL, count(*) FROM c WHERE k % 13 = 0 HAVING count(*) > 0
UNION ALL SELECT 'unparsed_periods', 'in the time under review', NULL, NULL, count(*) FROM a WHERE k % 10 = 0 HAVING count(*) > 0
UNION ALL SELECT 'unknown_units', unit, NULL, NULL, count(*) FROM a WHERE unit <> 'USD' GROUP BY unit
UNION ALL SELECT 'generic_measures', m, NULL, NULL, count(DISTINCT CASE WHEN unit = 'USD' THEN v::VARCHAR ELSE 'none' END) FROM a WHERE length(m) < 22 GROUP BY m HAVING count(DISTINCT CASE WHEN unit = 'USD' THEN v::VARCHAR ELSE 'none' END) > 12"""
PAGED = f"""WITH {_REVENUE}, {_relations()}, placed AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 - (SELECT count(*) FROM rel) // 2 AS k FROM rel)
SELECT (1 + k // 100)::INT AS page, id, claim_a_id, claim_b_id, verdict, confidence, cross_doc FROM placed WHERE k >= 0 AND k < 200"""
FROM_FILES = """SELECT md5(page) AS text_md5, count(*) AS pages, max(length(page))::BIGINT AS chars FROM (SELECT unnest(string_split(text, chr(12))) AS page FROM documents WHERE text IS NOT NULL) WHERE page <> '' GROUP BY 1"""
