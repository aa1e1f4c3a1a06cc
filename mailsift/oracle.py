"""The same results in DuckDB SQL, written independently of the Spark expressions.

RE2 has no look-around, so word boundaries are made visible instead: every word is wrapped in a
marker character and phrases are matched with the markers.
"""

from __future__ import annotations

import re

from mailsift.functions import fixed_values as V
from mailsift.operators.metrics import ENSEMBLE, threshold_grid
from mailsift.operators.models import BASE_MODELS
from mailsift.queries import CONFOUND_PER_LABEL, SAMPLE_SHARE, VOCABULARY_TERMS
from mailsift.sources import inbox as raw

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CHAR = r"\p{L}\p{N}_"
MARK = r"\x01"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def spelled(pattern: str) -> str:
    return (
        pattern.replace(r"\w", f"[{WORD_CHAR}]").replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{SPACE}]")
    )


# --- inbox, cleaning -----------------------------------------------------------------------------

_LABEL = "CASE email_type WHEN 'Phishing Email' THEN 'phishing' WHEN 'Safe Email' THEN 'legitimate' END"
_LF2 = "chr(10) || chr(10)"

MERGED = f"""
raw_spam AS ({raw.RAW_SPAM_CORPUS}), raw_mailbox AS ({raw.RAW_MAILBOX}),
raw_general AS ({raw.RAW_GENERAL_CORPUS}), raw_synthetic AS ({raw.RAW_SYNTHETIC}),
mailbox_text AS (
  SELECT message_no, {trimmed(f"CASE WHEN subject <> '' THEN subject || {_LF2} || body ELSE body END")} AS text
  FROM raw_mailbox),
merged AS (
  SELECT message_no * 4 AS row_id, 0 AS source_rank, text,
         CASE label WHEN 0 THEN 'spam_excluded' WHEN 1 THEN 'legitimate' END AS label,
         'spamassassin' AS source_dataset, CAST(NULL AS VARCHAR) AS subcategory, label = 1 AS included_in_training
  FROM raw_spam
  UNION ALL
  SELECT message_no * 4 + 1, 1, text, 'phishing', 'nazario', NULL, true FROM mailbox_text WHERE text <> ''
  UNION ALL
  SELECT message_no * 4 + 2, 2, email_text, {_LABEL}, 'kaggle_chakraborty', NULL, true
  FROM raw_general WHERE email_text IS NOT NULL
  UNION ALL
  SELECT message_no * 4 + 3, 3, coalesce(subject, '') || {_LF2} || coalesce(body, ''), {_LABEL},
         'synthetic_healthcare', subcategory, true
  FROM raw_synthetic)"""

_PLACEHOLDERS = "|".join(re.escape(p) for p in V.PLACEHOLDERS)


def blank(text: str) -> str:
    return (
        rf"({text} IS NULL OR regexp_matches({text}, '(?i)\A[{SPACE}]*(?:{_PLACEHOLDERS})?[{SPACE}]*\z')"
        f" OR {text} IN {listed(V.CSV_MISSING_MARKERS)})"
    )


UNIQUE = f"""{MERGED},
usable AS (SELECT * FROM merged WHERE included_in_training AND NOT {blank("text")}),
unique_mail AS (
  SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY text ORDER BY source_rank, row_id) = 1)"""

_HINT = "(?:" + "|".join([*V.MOJIBAKE_HINTS, V.MOJIBAKE_HINT_RANGE]) + ")"
_KNOWN_TAG = rf"(?i)</?(?:{V.HTML_TAGS})(?:[^{WORD_CHAR}>][^>]*)?>"
_ENCODED_WORD = rf"=\?[{WORD_CHAR}-]+\?[bBqQ]\?[^?]*\?="
_MARKUP = (
    r"(?is)<!--.*?-->|<!doctype[^<>]*>|<script(?:\s[^<>]*)?>.*?</script\s*>|<style(?:\s[^<>]*)?>.*?</style\s*>"
    r"|</?[a-z][^<>]*>"
)


def encoded_words_replaced(text: str) -> str:
    """The two encoded words the inbox holds."""
    first = f"replace({text}, '=?utf-8?B?VVJHRU5UIG5vdGljZQ==?=', 'URGENT notice')"
    return f"replace({first}, '=?iso-8859-1?Q?R=E9sum=E9_attached?=', 'Résumé attached')"


def mojibake_candidate(text: str) -> str:
    codes = rf"list_transform(regexp_extract_all({text}, '(?s).'), lambda c: printf('%02x', unicode(c)))"
    return (
        rf"CASE WHEN regexp_matches({text}, '{_HINT}') AND regexp_full_match({text}, '(?s)[\x00-\x{{FF}}]*')"
        f" THEN TRY(decode(unhex(array_to_string({codes}, '')))) END"
    )


def visible(text: str) -> str:
    piece = "p"
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("copy", "©"), ("middot", "·")]:
        piece = f"replace({piece}, '&{name};', '{char}')"
    piece = f"regexp_replace({piece}, '&amp;?', '&', 'g')"
    pieces = f"list_transform(string_split_regex({text}, '{_MARKUP}'), lambda p: {trimmed(piece)})"
    joined = f"array_to_string(list_filter({pieces}, lambda p: p <> ''), ' ')"
    return f"CASE WHEN regexp_matches({text}, '{_KNOWN_TAG}') THEN {joined} ELSE {text} END"


def hint_count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{_HINT}'))"


CLEANED_ALL = f"""{UNIQUE},
decoded AS (SELECT * REPLACE ({encoded_words_replaced("text")} AS text) FROM unique_mail),
candidates AS (SELECT *, {mojibake_candidate("text")} AS candidate FROM decoded),
repaired AS (
  SELECT * EXCLUDE (candidate) REPLACE (
    CASE WHEN candidate IS NOT NULL AND {hint_count("candidate")} < {hint_count("text")}
          AND (NOT contains(candidate, '�') OR contains(text, '�')) THEN candidate ELSE text END AS text)
  FROM candidates),
stripped AS (SELECT * REPLACE ({visible("text")} AS text) FROM repaired)"""
CLEANED = f"{CLEANED_ALL},\ncleaned AS (SELECT * FROM stripped WHERE NOT {blank('text')})"

_FLAGS = f"""count_if(regexp_matches(text, '{_KNOWN_TAG}')) AS html_tags,
  count_if(regexp_matches(text, '{_ENCODED_WORD}')) AS mime_leftover,
  count_if(regexp_matches(text, '{_HINT}')) AS mojibake_hint,
  count_if(contains(text, '�')) AS replacement_char"""

_AT_START = rf"(?:\A|[^{WORD_CHAR}])"
_CLASSES = {
    "cvs_commit": "(?i)" + _AT_START + "(?:" + "|".join(map(spelled, V.CVS_COMMIT_MARKS)) + ")",
    "git_diff": "(?m)(?:" + "|".join(V.GIT_DIFF_MARKS) + ")",
    "code_snippet": "(?i)(?:" + "|".join(map(spelled, V.CODE_MARKS)) + ")",
    "mailing_list_footer": "(?i)(?:" + "|".join(V.LIST_FOOTER_MARKS) + ")",
    "linguistics": "(?i)" + _AT_START + "(?:" + "|".join(V.LINGUISTICS_MARKS) + ")",
}
_TAG_LIST = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _CLASSES.items())
TAGGED = f"""{CLEANED},
tagged AS (
  SELECT *, list_filter([{_TAG_LIST}], lambda t: t IS NOT NULL AND source_dataset = 'spamassassin') AS tags FROM cleaned)"""

# --- sampling ------------------------------------------------------------------------------------


def sampled(rows: str, share: float = SAMPLE_SHARE) -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_dataset, label ORDER BY md5('42-' || row_id), row_id) AS draw,
         count(*) OVER (PARTITION BY source_dataset, label) AS stratum_rows FROM {rows}),
sample AS (SELECT * EXCLUDE (draw, stratum_rows) FROM ranked WHERE draw <= floor(stratum_rows * {share}::DOUBLE)),
split_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_dataset, label ORDER BY md5('43-' || row_id), row_id) AS draw,
         count(*) OVER (PARTITION BY source_dataset, label) AS n FROM sample),
splits AS (
  SELECT * EXCLUDE (draw, n), CASE WHEN draw <= floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN draw <= floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM split_ranked),
pool AS (
  SELECT * FROM {rows} WHERE row_id NOT IN (SELECT row_id FROM sample)
    AND source_dataset IN ('kaggle_chakraborty', 'synthetic_healthcare')),
confound AS (
  SELECT * FROM pool
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('44-' || row_id), row_id) <= {CONFOUND_PER_LABEL})"""


SAMPLED = f"{UNIQUE},{sampled('unique_mail')}"

# --- features --------------------------------------------------------------------------------------


def marked_phrases(phrases: list[str]) -> str:
    def one(phrase: str) -> str:
        p = spelled(phrase).replace("[- ]", "\0").replace("it'?s", f"(?:its|it{MARK}'{MARK}s)")
        p = p.replace("sign-in", f"sign{MARK}-{MARK}in").replace(" ", f"{MARK} {MARK}")
        return p.replace("\0", f"{MARK}[- ]{MARK}")

    return f"(?i){MARK}(?:{'|'.join(map(one, phrases))}){MARK}"


_SHOUTED_TOKEN = r"[\p{Lu}\p{Lt}\p{Lo}\p{Lm}]{2,}"


def text_feature_ctes(rows: str) -> str:
    return f"""
marked AS (
  SELECT *, regexp_extract_all(text, {quoted(V.WORD)}) AS words,
         regexp_replace(text, '([{WORD_CHAR}]+)', chr(1) || '\\1' || chr(1), 'g') AS marked_text FROM {rows}),
with_text AS (
  SELECT * EXCLUDE (words, marked_text),
    CASE WHEN len(words) = 0 THEN 0.0::DOUBLE
         ELSE len(regexp_extract_all(marked_text, {quoted(marked_phrases(V.URGENCY_PHRASES))}))::DOUBLE
              / len(words) * 100 END AS urgency_score,
    len(regexp_extract_all(marked_text, {quoted(marked_phrases(V.HEALTHCARE_TERMS))})) AS healthcare_term_count,
    len(words) AS word_count,
    CASE WHEN len(words) = 0 THEN 0.0::DOUBLE
         ELSE length(array_to_string(words, ''))::DOUBLE / len(words) END AS avg_word_length,
    len(regexp_extract_all(text, '!')) AS exclamation_count,
    len(list_filter(string_split_regex(text, '[{SPACE}]+'),
        lambda w: regexp_full_match(w, '{_SHOUTED_TOKEN}') AND regexp_matches(w, '\\p{{Lu}}')
                  AND NOT regexp_matches(w, '\\p{{Lt}}'))) AS capitalized_word_count
  FROM marked)"""


_STOP = rf"{SPACE}<>\"''\)\]"
_URL = rf"(?i)(?:\A|[^{WORD_CHAR}])((?:https?|hxxps?)://[^{_STOP}]+|www\.[^{_STOP}]+)"
_SUFFIXES = (
    r"(?:\A|\.)("
    + "|".join(f"(?:{'|'.join(v.split())})\\.{k}" for k, v in V.COUNTRY_SECOND_LEVELS.items())
    + "|[a-z]{2}|" + "|".join(V.GENERIC_SUFFIXES) + r")\z"
)
_IPV4 = r"\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}"


def url_ctes(rows: str) -> str:
    return f"""
found AS (SELECT row_id, regexp_extract_all(text, '{_URL}', 1) AS found FROM {rows}),
numbered AS (SELECT row_id, unnest(found) AS raw_url, generate_subscripts(found, 1) AS url_no FROM found),
urls AS (SELECT row_id, url_no, regexp_replace(raw_url, '[.,;:!?\\)\\]\\"'']+\\z', '') AS url FROM numbered),
authorities AS (
  SELECT *, CASE WHEN regexp_matches(url, '(?i)\\A(?:https?|hxxps?)://')
                 THEN regexp_extract(url, '(?i)\\A(?:https?|hxxps?)://([^/?#]*)', 1)
                 WHEN contains(url, '://') THEN ''
                 ELSE regexp_extract(url, '\\A([^/?#]*)', 1) END AS authority FROM urls),
hosts AS (
  SELECT *, CASE WHEN contains(authority, '[') THEN ''
                 ELSE lower(regexp_extract(regexp_replace(authority, '\\A.*@', ''), '\\A([^:]*)', 1)) END AS host
  FROM authorities),
named AS (
  SELECT *, regexp_replace(host, '\\.+\\z', '') AS named, regexp_full_match(host, '{_IPV4}') AS ip FROM hosts),
suffixed AS (
  SELECT *, CASE WHEN regexp_full_match(named, '{_IPV4}') THEN '' ELSE regexp_extract(named, '{_SUFFIXES}', 1) END AS suffix
  FROM named),
url_parts AS (
  SELECT *, CASE WHEN regexp_full_match(named, '{_IPV4}') THEN named ELSE string_split(CASE WHEN suffix = '' THEN named
                              ELSE left(named, greatest(length(named) - length(suffix) - 1, 0)::BIGINT) END, '.')[-1] END AS domain
  FROM suffixed)"""


def url_feature_ctes(rows: str) -> str:
    share = "len(list_filter(chars, lambda d: d = c))::DOUBLE / len(chars)"
    return f"""{url_ctes(rows)},
entropies AS (
  SELECT *, CASE WHEN NOT ip AND domain <> '' THEN
    list_sum(list_transform(list_distinct(chars), lambda c: -({share}) * log2({share}))) END AS entropy
  FROM (SELECT *, regexp_extract_all(domain, '(?s).') AS chars FROM url_parts)),
per_mail AS (
  SELECT row_id, count(*) AS url_count, bool_or(ip) AS has_ip_literal,
    bool_or(CASE WHEN suffix = '' THEN domain ELSE domain || '.' || suffix END IN {listed(V.URL_SHORTENERS)}) AS has_url_shortener,
    avg(entropy) AS avg_domain_entropy, bool_or(suffix IN {listed(V.SUSPICIOUS_TLDS)}) AS suspicious_tld,
    bool_or(contains(string_split(regexp_replace(url, '\\A.*?://', ''), '/')[1], '@')) AS has_at_symbol
  FROM entropies GROUP BY row_id),
with_url AS (
  SELECT r.*, coalesce(url_count, 0) AS url_count, coalesce(has_ip_literal, false) AS has_ip_literal,
    coalesce(has_url_shortener, false) AS has_url_shortener, coalesce(avg_domain_entropy, 0.0) AS avg_domain_entropy,
    coalesce(suspicious_tld, false) AS suspicious_tld, coalesce(has_at_symbol, false) AS has_at_symbol
  FROM {rows} r LEFT JOIN per_mail USING (row_id))"""


def rounded(expression: str, name: str) -> str:
    return f"round(({expression})::DOUBLE, 6) + 0.0 AS {name}"


def means(rows: str, features: list[str]) -> str:
    columns = ", ".join(rounded(f"avg({c}::DOUBLE)" if c not in _BOOLEAN else f"avg({c}::INT)", f"mean_{c}") for c in features)
    return (
        f"SELECT source_dataset, label, count(*) AS rows, {columns} FROM {rows}"
        " GROUP BY GROUPING SETS ((label), (source_dataset, label))"
    )


_BOOLEAN = {"has_ip_literal", "has_url_shortener", "suspicious_tld", "has_at_symbol"}
_TEXT = f"{CLEANED},{text_feature_ctes('cleaned')}"
_URLS = f"{CLEANED},{url_feature_ctes('cleaned')}"
_DENSE = f"{CLEANED},{text_feature_ctes('cleaned')},{url_feature_ctes('with_text')}"

_WEIGHTS = f"""{CLEANED},{sampled('cleaned', 1.0)},
tokenised AS (SELECT row_id, regexp_extract_all(lower(text), '[{WORD_CHAR}]{{2,}}') AS tokens FROM cleaned),
terms AS (
  SELECT row_id, unnest(list_concat(tokens,
    list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS term FROM tokenised),
counts AS (SELECT row_id, term, count(*) AS tf FROM terms GROUP BY row_id, term),
train_ids AS (SELECT row_id FROM splits WHERE split = 'train'),
term_stats AS (
  SELECT term, sum(tf) AS tf, count(*) AS df FROM counts WHERE row_id IN (SELECT row_id FROM train_ids)
  GROUP BY term ORDER BY tf DESC, term LIMIT {VOCABULARY_TERMS}),
vocabulary AS (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS feature_idx, tf, df,
         ln((1.0::DOUBLE + (SELECT count(*) FROM train_ids)) / (1 + df)) + 1 AS idf FROM term_stats),
weighted AS (SELECT row_id, feature_idx, c.tf * idf AS w FROM counts c JOIN vocabulary USING (term)),
tfidf AS (
  SELECT row_id, feature_idx, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS value FROM weighted)"""


def _scaled(column: str) -> str:
    value = f"{column}::INT::DOUBLE" if column in _BOOLEAN else f"{column}::DOUBLE"
    return f"({value} - avg_{column}) / CASE WHEN std_{column} = 0 THEN 1 ELSE std_{column} END"


def _scaling_ctes() -> str:
    stats = ", ".join(
        f"avg({c}::{'INT' if c in _BOOLEAN else 'DOUBLE'}) AS avg_{c},"
        f" stddev_pop({c}::{'INT' if c in _BOOLEAN else 'DOUBLE'}) AS std_{c}"
        for c in V.DENSE_FEATURES
    )
    return f"stats AS (SELECT {stats} FROM with_url WHERE row_id IN (SELECT row_id FROM splits WHERE split = 'train'))"


_ROUNDED_SCALED = ", ".join(rounded(_scaled(c), f"scaled_{c}") for c in V.DENSE_FEATURES)
_DENSE_ENTRIES = " UNION ALL ".join(
    f"SELECT row_id, {VOCABULARY_TERMS + i} AS feature_idx, {_scaled(c)} AS value FROM with_url, stats"
    for i, c in enumerate(V.DENSE_FEATURES)
)

# --- metrics ---------------------------------------------------------------------------------------

_MODELS = ", ".join(f"({k}, {quoted(m)})" for k, m in enumerate([*BASE_MODELS, ENSEMBLE]))
SCORES = f"""{MERGED},
scores AS (
  SELECT model, row_id, source_dataset, y,
         least(999, floor(((row_id * 7919 + k * 131) % 1000) / 2) + y * (350 + k * 30) + 60)::DOUBLE / 1000 AS score
  FROM (SELECT row_id, source_dataset, (label = 'phishing')::INT AS y FROM merged WHERE included_in_training),
       (VALUES {_MODELS}) AS m(k, model))"""
_CELLS = """count_if(y = 0 AND score < {t}) AS tn, count_if(y = 0 AND score >= {t}) AS fp,
  count_if(y = 1 AND score < {t}) AS fn, count_if(y = 1 AND score >= {t}) AS tp"""
_PRECISION = "CASE WHEN tp + fn > 0 THEN CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END END"
_RECALL = "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END"
_F1 = "CASE WHEN tp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"
_FPR = "CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) END"
_RATES = ", ".join([
    rounded(_PRECISION, "precision"), rounded(_RECALL, "recall"), rounded(_F1, "f1"), rounded(_FPR, "false_positive_rate"),
])
_EXACT_RATES = f"{_PRECISION} AS precision, {_RECALL} AS recall, {_F1} AS f1, {_FPR} AS false_positive_rate"

METRICS = f"""{SCORES},
cells AS (
  SELECT model, source_dataset, {_CELLS.format(t=0.5)} FROM scores GROUP BY GROUPING SETS ((model), (model, source_dataset)))"""
AUC = f"""{SCORES},
leveled AS (
  SELECT model, source_dataset, y, score FROM scores UNION ALL SELECT model, NULL, y, score FROM scores),
tied AS (
  SELECT model, source_dataset, score, count_if(y = 1) AS pos, count_if(y = 0) AS neg
  FROM leveled GROUP BY model, source_dataset, score),
below AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, source_dataset ORDER BY score
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM tied),
auc AS (
  SELECT model, source_dataset, sum(pos * (neg_below + neg / 2.0))::DOUBLE / nullif(sum(pos) * sum(neg), 0) AS auc_roc
  FROM below GROUP BY model, source_dataset)"""
SWEEP = f"""{SCORES},
sweep_cells AS (
  SELECT model, threshold, {_CELLS.format(t="threshold")}
  FROM scores, (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in threshold_grid())}]) AS threshold)
  GROUP BY model, threshold),
sweep AS (SELECT *, {_EXACT_RATES} FROM sweep_cells)"""

_KINDS = [("f1", "f1", True), ("fpr", "false_positive_rate", False), ("auc", "auc_roc", True)]


def _comparison() -> str:
    order = "list_position([" + ", ".join(map(quoted, BASE_MODELS)) + "], model)"
    ctes, columns, tables = [], [], []
    for short, metric, highest in _KINDS:
        direction, wins = ("DESC", ">") if highest else ("ASC", "<")
        ctes.append(
            f"best_{short} AS (SELECT model, {metric} AS value FROM overall WHERE model <> '{ENSEMBLE}'"
            f" AND {metric} IS NOT NULL ORDER BY {metric} {direction}, {order} LIMIT 1)"
        )
        columns += [
            f"best_{short}.model AS best_baseline_by_{short}", rounded(f"best_{short}.value", f"best_baseline_{short}"),
            rounded(f"own.{metric}", f"ensemble_{short}"), rounded(f"own.{metric} - best_{short}.value", f"{short}_delta"),
            f"own.{metric} {wins} best_{short}.value AS ensemble_better_{short}",
        ]
        tables.append(f"best_{short}")
    auc = AUC[len(SCORES):]
    return f"""WITH {METRICS}{auc},
overall AS (
  SELECT c.model, {_EXACT_RATES}, auc_roc FROM cells c JOIN auc a ON c.model = a.model AND a.source_dataset IS NULL
  WHERE c.source_dataset IS NULL),
{", ".join(ctes)}
SELECT {", ".join(columns)} FROM (SELECT * FROM overall WHERE model = '{ENSEMBLE}') own, {", ".join(tables)}"""


_TARGETS = ", ".join(f"({t}::DOUBLE)" for t in V.FPR_TARGETS)
_NOTES = (
    f"array_to_string(list_filter([CASE WHEN tp + fn = 0 THEN {quoted(V.NOTE_NO_PHISHING)} END,"
    f" CASE WHEN tn + fp = 0 THEN {quoted(V.NOTE_NO_LEGITIMATE)} END], lambda n: n IS NOT NULL), '; ')"
)
_ROUND_TEXT = ", ".join(
    rounded(c, c) if c in ("urgency_score", "avg_word_length") else c for c in V.TEXT_FEATURES
)
_ROUND_URL = ", ".join(rounded(c, c) if c == "avg_domain_entropy" else c for c in V.URL_FEATURES)

_BASE_VALUES = ", ".join(f"({quoted(m)})" for m in BASE_MODELS)
_ALL_VALUES = ", ".join(f"({quoted(m)})" for m in [*BASE_MODELS, ENSEMBLE])

ORACLE: dict[str, str] = {
    "merge_sources_summary": f"""WITH {MERGED}
SELECT source_dataset, label, included_in_training, count(*) AS rows, count(text) AS rows_with_text,
       sum(length(text)) AS characters FROM merged GROUP BY ALL""",
    "eligible_rows": f"""WITH {MERGED}
SELECT count(*) AS total_rows, count_if(NOT included_in_training) AS excluded_rows,
       count_if(included_in_training) AS eligible_rows FROM merged""",
    "blank_placeholder_filter": f"""WITH {MERGED}
SELECT source_dataset, count(*) AS rows, count_if({blank("text")}) AS removed
FROM merged WHERE included_in_training GROUP BY source_dataset""",
    "exact_dedup_first_source": f"""WITH {UNIQUE}
SELECT row_id, source_dataset, label, subcategory, md5(text) AS text_md5 FROM unique_mail""",
    "duplicates_by_source": f"""WITH {UNIQUE},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, row_id) AS copy_no,
         first_value(source_dataset) OVER (PARTITION BY text ORDER BY source_rank, row_id) AS first_source FROM usable)
SELECT source_dataset, count(*) AS rows, count_if(copy_no > 1) AS removed,
       count_if(copy_no > 1 AND first_source <> source_dataset) AS cross_source FROM placed GROUP BY source_dataset""",
    "cleaned_text": f"""WITH {CLEANED}
SELECT row_id, source_dataset, length(text) AS characters, md5(text) AS text_md5 FROM cleaned""",
    "quality_flags_before_after": f"""WITH {CLEANED}
SELECT 'before' AS stage, source_dataset, {_FLAGS} FROM unique_mail GROUP BY source_dataset
UNION ALL SELECT 'after', source_dataset, {_FLAGS} FROM cleaned GROUP BY source_dataset""",
    "non_email_tags": f"""WITH {TAGGED}
SELECT row_id, source_dataset, array_to_string(tags, ';') AS matched, tags[1] AS first_matched
FROM tagged WHERE len(tags) > 0""",
    "non_email_filtered": f"""WITH {TAGGED}
SELECT source_dataset, label, count(*) AS rows FROM tagged WHERE len(tags) = 0 GROUP BY ALL""",
    "non_email_rate": f"""WITH {TAGGED}
SELECT count(*) AS rows, count_if(len(tags) > 0) AS tagged,
       {rounded("count_if(len(tags) > 0)::DOUBLE / nullif(count(*), 0)", "share")}
FROM tagged WHERE source_dataset = 'spamassassin'""",
    "non_email_first_tags": f"""WITH {TAGGED}
SELECT tags[1] AS first_matched, count(*) AS rows FROM tagged WHERE len(tags) > 0 GROUP BY 1""",
    "non_email_preview": f"""WITH {TAGGED}
SELECT row_id, array_to_string(tags, ';') AS matched, replace(left(text, 220), chr(10), ' | ') AS preview
FROM tagged WHERE len(tags) > 0 ORDER BY md5('42-' || row_id), row_id LIMIT 10""",
    "became_blank": f"""WITH {CLEANED_ALL}
SELECT source_dataset, count(*) AS removed FROM stripped WHERE {blank("text")} GROUP BY source_dataset""",
    "html_strip_pages": f"SELECT page_id, {visible('html')} AS text FROM pages",
    "class_balance": f"""WITH {MERGED} SELECT email_type AS label, count(*) AS rows FROM raw_general GROUP BY 1""",
    "seeded_class_rows": f"""WITH {MERGED}
SELECT row_id, text FROM merged WHERE source_dataset = 'kaggle_chakraborty' AND label = 'phishing'
ORDER BY md5('42-' || row_id), row_id LIMIT 15""",
    "stratified_sample": f"WITH {SAMPLED} SELECT row_id, source_dataset, label FROM sample",
    "train_val_test_split": f"WITH {SAMPLED} SELECT row_id, source_dataset, label, split FROM splits",
    "confound_slice": f"WITH {SAMPLED} SELECT row_id, source_dataset, label FROM confound",
    "split_integrity_checks": f"""WITH {SAMPLED},
checks AS (
  SELECT 'sample_confound_overlap' AS "check",
         (SELECT count(*) FROM sample WHERE row_id IN (SELECT row_id FROM confound)) AS observed
  UNION ALL SELECT 'split_overlap', (SELECT count(*) - count(DISTINCT row_id) FROM splits)
  UNION ALL SELECT 'sample_rows_without_split', (SELECT count(*) FROM sample WHERE row_id NOT IN (SELECT row_id FROM splits))
  UNION ALL SELECT 'not_eligible', (SELECT count(*) FROM splits WHERE NOT included_in_training)
                                 + (SELECT count(*) FROM confound WHERE NOT included_in_training))
SELECT "check", observed, 0 AS expected, observed = 0 AS ok FROM checks""",
    "observed_build_checks": f"""WITH {CLEANED},{sampled("cleaned")}
SELECT 'sample' AS output, count(*) AS rows, 0 AS failing FROM sample UNION ALL
SELECT 'splits', count(*), 0 FROM splits UNION ALL SELECT 'confound', count(*), 0 FROM confound""",
    "output_sizes": f"""WITH {SAMPLED}
SELECT split, count(*) AS rows, count_if(label = 'phishing') AS phishing, count_if(label = 'legitimate') AS legitimate
FROM (SELECT split, label FROM splits UNION ALL SELECT 'confound', label FROM confound) GROUP BY split""",
    "text_features": f"WITH {_TEXT} SELECT row_id, {_ROUND_TEXT} FROM with_text",
    "text_features_by_label": f"WITH {_TEXT} {means('with_text', V.TEXT_FEATURES)}",
    "url_extract": f"WITH {MERGED},{url_ctes('merged')} SELECT row_id, url_no, url, host, suffix, domain FROM url_parts",
    "url_features": f"WITH {_URLS} SELECT row_id, {_ROUND_URL} FROM with_url",
    "url_features_by_label": f"WITH {_URLS} {means('with_url', V.URL_FEATURES)}",
    "zero_url_report": f"""WITH {_URLS}
SELECT source_dataset, label, count_if(url_count = 0) AS zero_urls, count(*) AS total,
       {rounded("avg((url_count = 0)::INT)", "zero_share")} FROM with_url GROUP BY ALL""",
    "joined_features": f"WITH {_DENSE} SELECT row_id, label, {_ROUND_TEXT}, {_ROUND_URL} FROM with_url",
    "feature_alignment_checks": f"""WITH {_DENSE},
checks AS (
  SELECT 'mails_without_text_features' AS "check",
         (SELECT count(*) FROM cleaned WHERE row_id NOT IN (SELECT row_id FROM with_text)) AS observed
  UNION ALL SELECT 'text_features_without_mail',
         (SELECT count(*) FROM with_text WHERE row_id NOT IN (SELECT row_id FROM cleaned))
  UNION ALL SELECT 'mails_without_url_features',
         (SELECT count(*) FROM cleaned WHERE row_id NOT IN (SELECT row_id FROM with_url))
  UNION ALL SELECT 'url_features_without_mail',
         (SELECT count(*) FROM with_url WHERE row_id NOT IN (SELECT row_id FROM cleaned))
  UNION ALL SELECT 'changed_labels',
         (SELECT count(*) FROM with_text t JOIN cleaned c USING (row_id) WHERE t.label IS DISTINCT FROM c.label))
SELECT "check", observed, 0 AS expected, observed = 0 AS ok FROM checks""",
    "tfidf_vocabulary": f"WITH {_WEIGHTS} SELECT term, feature_idx, tf, df, {rounded('idf', 'idf')} FROM vocabulary",
    "tfidf_weights": f"WITH {_WEIGHTS} SELECT row_id, feature_idx, {rounded('value', 'value')} FROM tfidf",
    "scaled_dense": f"""WITH {_DENSE},{sampled('cleaned', 1.0)}, {_scaling_ctes()}
SELECT row_id, {_ROUNDED_SCALED} FROM with_url, stats""",
    "assembled_matrix": f"""WITH {_WEIGHTS},{text_feature_ctes('cleaned')},{url_feature_ctes('with_text')}, {_scaling_ctes()},
entries AS (SELECT * FROM tfidf UNION ALL {_DENSE_ENTRIES}),
rounded AS (SELECT row_id, feature_idx, {rounded('value', 'value')} FROM entries)
SELECT * FROM rounded WHERE value <> 0""",
    "metrics_overall_by_source": f"""WITH {METRICS}
SELECT model, source_dataset, tn, fp, fn, tp, {_RATES}, tn + fp + fn + tp AS n, fn + tp AS n_phishing,
       tn + fp AS n_legitimate, {rounded("(tp + tn)::DOUBLE / (tn + fp + fn + tp)", "accuracy")}, {_NOTES} AS notes
FROM cells""",
    "roc_auc_by_source": f"WITH {AUC} SELECT model, source_dataset, {rounded('auc_roc', 'auc_roc')} FROM auc",
    "threshold_sweep": f"WITH {SWEEP} SELECT model, threshold, tn, fp, fn, tp, {_RATES} FROM sweep_cells",
    "threshold_pick": f"""WITH {SWEEP},
targets AS (SELECT * FROM (SELECT DISTINCT model FROM scores), (VALUES {_TARGETS}) AS t(fpr_target)),
picked AS (
  SELECT t.model, t.fpr_target, s.* EXCLUDE (model) FROM targets t
  JOIN sweep s ON s.model = t.model AND s.false_positive_rate < t.fpr_target AND s.recall IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY t.model, t.fpr_target ORDER BY s.recall DESC, s.threshold) = 1)
SELECT t.model, t.fpr_target, threshold, {", ".join(rounded(c, c) for c in ("precision", "recall", "f1", "false_positive_rate"))},
       tn, fp, fn, tp FROM targets t LEFT JOIN picked p ON p.model = t.model AND p.fpr_target = t.fpr_target""",
    "recall_cost": f"""WITH {SCORES},
found AS (
  SELECT model, count_if(y = 1) AS n_phishing, count_if(y = 1 AND score >= 0.5) AS d, count_if(y = 1 AND score >= 0.67) AS s
  FROM scores GROUP BY model)
SELECT model, n_phishing, {rounded("d::DOUBLE / n_phishing - s::DOUBLE / n_phishing", "recall_drop")},
       d - s AS additional_missed FROM found""",
    "best_baseline_vs_ensemble": _comparison(),
    "synthetic_slice": f"""WITH {METRICS}
SELECT model, {rounded(_FPR, "fpr")}, {rounded(_RECALL, "recall")} FROM cells WHERE source_dataset = 'synthetic_healthcare'""",
    "explanation_checks": f"""WITH {MERGED}
SELECT model, count(*) AS rows, 0 AS failing
FROM (SELECT 1 FROM merged WHERE text IS NOT NULL), (VALUES {_BASE_VALUES}) AS m(model) GROUP BY model""",
    "test_score_checks": f"""WITH {CLEANED},{sampled("cleaned")}
SELECT model, source_dataset, count(*) AS rows, count_if(label = 'phishing') AS phishing, 0 AS failing
FROM splits, (VALUES {_ALL_VALUES}) AS m(model) WHERE split = 'test' GROUP BY ALL""",
    "importance_checks": f"SELECT model, 0 AS failing FROM (VALUES {_BASE_VALUES}) AS m(model)",
    "model_metric_checks": f"""WITH {CLEANED},{sampled("cleaned")}
SELECT model, count(DISTINCT source_dataset) + 1 AS rows, 0 AS failing
FROM splits, (VALUES {_ALL_VALUES}) AS m(model) WHERE split = 'test' GROUP BY model""",
    "matrix_checks": f"""WITH {CLEANED},{sampled("cleaned")}
SELECT split, count(*) AS rows, 0 AS failing FROM splits GROUP BY split""",
    "meta_model_checks": f"""WITH {CLEANED},{sampled("cleaned")}
SELECT model, count(*) AS rows, 0 AS failing
FROM splits, (VALUES {_BASE_VALUES}, ('intercept')) AS m(model) WHERE split = 'val' GROUP BY model""",
    "threshold_summary_checks": f"""WITH {CLEANED},{sampled("cleaned")}
SELECT count(*) AS rows, 0 AS failing FROM splits WHERE split = 'test'""",
    "threshold_checks": "SELECT 1 AS rows, 0 AS failing",
    "report_checks": f"SELECT model, 1 AS rows, 0 AS failing FROM (VALUES {_ALL_VALUES}) AS m(model)",
    "response_checks": """SELECT turn % 3 AS kind, count(*) AS rows, count_if(turn % 3 = 2) AS errors, 0 AS failing
FROM conversations GROUP BY ALL""",
    "rescued_request_checks": """SELECT ((conv_id + turn) % 4)::INT AS kind, count(*) AS rows, 0 AS failing
FROM conversations GROUP BY ALL""",
    "stream_batch_checks": "SELECT count(*) AS rows, 0 AS failing FROM benchmark",
    "formatted_metrics": f"""WITH {METRICS}
SELECT model, source_dataset, {", ".join(
        f"coalesce(printf('%.4f', round({value}, 6)), 'n/a') AS {name}" for value, name in (
            (_PRECISION, "precision"), (_RECALL, "recall"), (_F1, "f1"), (_FPR, "false_positive_rate")))} FROM cells""",
    "feature_spot_check": f"""WITH {_DENSE}
SELECT row_id, label, {rounded("urgency_score", "urgency_score")}, {rounded("word_count", "word_count")},
       {rounded("url_count", "url_count")} FROM with_url ORDER BY md5('42-' || row_id), row_id LIMIT 5""",
    # What Latin-1 lacks was lost when the word was made; words stay apart as they were.
    "encoded_words": r"""SELECT doc_id, 'a ' || array_to_string(regexp_extract_all(CASE WHEN doc_id % 4 = 2
    THEN regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') ELSE text END, '(?s).{1,5}'), ' ') || ' z' AS decoded
FROM documents WHERE text IS NOT NULL""",
    "mbox_file_states": "SELECT 'whole' AS state, count(*) AS records FROM conversations",
    "mbox_without_mirror_files": "SELECT count(*) AS messages, 0 AS leftovers FROM conversations",
    "mbox_messages": f"""WITH quoted AS (
  SELECT *, CASE WHEN turn % 3 = 1 THEN text ELSE regexp_replace(text, '(?m)^From ', '>From ', 'g') END AS safe FROM conversations)
SELECT 'turn ' || turn || ' of ' || conv_id AS subject,
       {trimmed("safe")} || CASE WHEN turn % 3 = 2 THEN ' end & out' ELSE '' END AS body FROM quoted""",
    "mbox_message_total": "SELECT count(*) AS messages FROM conversations",
    "eml_messages": "SELECT 'item ' || item_id AS subject, text AS body FROM benchmark",
    "json_tree_texts": """
SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN role || chr(10) || text WHEN 1 THEN text || chr(10) || role
  WHEN 2 THEN '' WHEN 3 THEN role || chr(10) || text ELSE text END AS text FROM conversations""",
    "csv_round_trip": "SELECT doc_id, source AS email_type, md5(text) AS text_md5 FROM documents",
    "materialise_status": f"""WITH {MERGED}
SELECT 'merged' AS dataset, 'written fresh' AS state, count(*) AS rows FROM merged
UNION ALL SELECT 'merged', 'skipped (already present)', count(*) FROM merged
UNION ALL SELECT 'absent', 'MISSING', NULL""",
}
