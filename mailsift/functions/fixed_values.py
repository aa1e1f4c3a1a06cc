"""Word lists, lookup sets, patterns and constants that the results depend on.

They are data, not design. Patterns are written for a generic regex dialect and are
adapted to Java where they are used.
"""

# --- vocabularies of the mail table ---------------------------------------------------

PHISHING = "phishing"
LEGITIMATE = "legitimate"
SPAM_EXCLUDED = "spam_excluded"

SPAM_CORPUS = "spamassassin"
PHISHING_MBOX = "nazario"
GENERAL_CORPUS = "kaggle_chakraborty"
SYNTHETIC_HEALTHCARE = "synthetic_healthcare"

# Concatenation order of the sources; exact copies keep the row of the earliest source.
SOURCE_ORDER = [SPAM_CORPUS, PHISHING_MBOX, GENERAL_CORPUS, SYNTHETIC_HEALTHCARE]

MAIL_COLUMNS = ["text", "label", "source_dataset", "subcategory", "included_in_training"]

EMAIL_TYPE_LABELS = {"Phishing Email": PHISHING, "Safe Email": LEGITIMATE}
SPAM_CODE_LABELS = {0: SPAM_EXCLUDED, 1: LEGITIMATE}
SPAM_CODE_INCLUDED = {0: False, 1: True}

LABEL_COLUMN_CANDIDATES = ["Email Type", "label", "Label", "class", "Class", "type", "Type"]

# --- cleaning ---------------------------------------------------------------------------

PLACEHOLDERS = [
    "empty", "n/a", "na", "null", "none", "nil", "[no content]", "no content",
    "unknown", "undefined", "blank",
]

# Cell texts that a CSV round trip with common defaults turns into missing values.
CSV_MISSING_MARKERS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

ENCODED_WORD = r"=\?[\w-]+\?[bBqQ]\?[^?]*\?="

MOJIBAKE_HINTS = ["Ã¢â‚¬", "Ã©", "Ã¨", "â€™", "â€œ", "â€\u009d", "â€“", "â€”"]
MOJIBAKE_HINT_RANGE = "Â[\u0080-¿]"

REPLACEMENT_CHAR = "�"

HTML_TAGS = (
    "html|head|body|div|span|p|br|a|img|table|tr|td|th|thead|tbody|ul|ol|li"
    "|h[1-6]|b|i|u|strong|em|font|style|script|meta|link|form|input|button"
    "|title|center|blockquote|pre|code|hr|iframe|small|sub|sup|nav|footer"
    "|header|section"
)

CVS_COMMIT_MARKS = [
    "cvs commit", "Modified Files:", "Log Message:", "Index: ", r"Revision \d", "checked in", "CVSROOT",
]
GIT_DIFF_MARKS = ["diff --git", r"^\+\+\+ ", "^--- ", "^@@ "]
CODE_MARKS = [
    r"#include\s", r"def \w+\(", "public class ", "import java", r"<\?php", r"function\s+\w+\s*\(",
]
LIST_FOOTER_MARKS = [
    "to unsubscribe", "mailman/listinfo", "majordomo", "list-unsubscribe",
    "_______________________________________________", "exmh-workers", r"ilug@linux\.ie",
    "spamassassin-(devel|talk|sightings)@",
]
LINGUISTICS_MARKS = [
    "phoneme", "morpholog", "syntax tree", "corpus linguistics", "part-of-speech",
    "noun phrase", "verb phrase",
]

# --- text features ------------------------------------------------------------------------

URGENCY_PHRASES = [
    r"act now",
    r"act immediately",
    r"acting immediately",
    r"immediate action required",
    r"immediate action is required",
    r"requires immediate attention",
    r"verify immediately",
    r"verify your account",
    r"verify your identity",
    r"verify your information",
    r"confirm your identity",
    r"confirm your account",
    r"update your information immediately",
    r"account will be suspended",
    r"account has been suspended",
    r"account will be locked",
    r"account will be closed",
    r"account will be terminated",
    r"account will be deactivated",
    r"avoid suspension",
    r"restore access",
    r"unauthorized access",
    r"unusual (sign-in|login) activity",
    r"suspicious activity",
    r"security alert",
    r"urgent action required",
    r"urgent(ly)?",
    r"final notice",
    r"final warning",
    r"last chance",
    r"limited time",
    r"time[- ]sensitive",
    r"expires? (today|soon|within \d+ hours?)",
    r"before it'?s too late",
    r"failure to (comply|respond|act)",
    r"respond within \d+ hours?",
    r"click here immediately",
    r"click below immediately",
    r"do not ignore this",
    r"this is not a drill",
]

HEALTHCARE_TERMS = [
    r"EHR",
    r"EMR",
    r"electronic health record",
    r"electronic medical record",
    r"patient chart",
    r"patient record",
    r"patient portal",
    r"provider portal",
    r"insurance claim",
    r"prior authorization",
    r"claim number",
    r"HIPAA",
    r"PHI",
    r"protected health information",
    r"lab results?",
    r"laboratory results?",
    r"prescription",
    r"medication",
    r"referral",
    r"transfer of care",
    r"clinical notes?",
    r"diagnosis",
    r"treatment plan",
    r"discharge summary",
    r"biopsy",
    r"telehealth",
    r"appointment confirmation",
    r"health insurance",
    r"medical record",
]

WORD = "[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"

TEXT_FEATURES = [
    "urgency_score", "healthcare_term_count", "word_count",
    "avg_word_length", "exclamation_count", "capitalized_word_count",
]

# --- URL features ---------------------------------------------------------------------------

URL_SHORTENERS = [
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly",
    "adf.ly", "bl.ink", "cutt.ly", "rebrand.ly", "shorte.st", "tiny.cc",
    "s.id", "rb.gy", "v.gd", "soo.gd", "x.co", "po.st", "qr.ae", "tr.im",
    "snip.ly", "lnkd.in", "git.io", "shorturl.at", "clck.ru", "u.to",
]

SUSPICIOUS_TLDS = [
    "tk", "ml", "ga", "cf", "gq",
    "xyz", "top", "club", "work", "click", "country", "men", "loan",
]

URL_FEATURES = [
    "url_count", "has_ip_literal", "has_url_shortener",
    "avg_domain_entropy", "suspicious_tld", "has_at_symbol",
]

DENSE_FEATURES = TEXT_FEATURES + URL_FEATURES

# Public suffixes. Two-letter endings count as country codes by rule; the lists below add the
# generic endings and the second levels under which country registries sell names.
GENERIC_SUFFIXES = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop",
    "museum", "jobs", "mobi", "travel", "tel", "cat", "asia", "post", "arpa", "xyz", "top", "club",
    "work", "click", "country", "men", "loan", "online", "site", "shop", "store", "tech", "app", "dev",
    "blog", "cloud", "space", "live", "life", "world", "website", "email", "link", "icu", "vip", "win",
    "bid", "date", "download", "racing", "review", "stream", "trade", "party", "science", "faith",
    "accountant", "cricket", "webcam", "support", "services", "solutions", "center", "company", "agency",
    "digital", "media", "news", "network", "systems", "today", "group", "global", "guru", "health",
    "care", "clinic", "hospital", "doctor", "dental", "pharmacy", "bank", "finance", "money", "credit",
    "insurance", "law", "ink", "buzz", "fun", "rest", "cyou", "page", "zip", "mov", "monster",
]
COUNTRY_SECOND_LEVELS = {
    "uk": "ac co gov ltd me net nhs org plc police sch",
    "au": "asn com edu gov id net org",
    "nz": "ac co geek gen govt iwi kiwi maori net org school",
    "jp": "ac ad co ed go gr lg ne or",
    "kr": "ac co go ne or pe re",
    "br": "com edu gov net org",
    "cn": "ac com edu gov mil net org",
    "tw": "com edu gov idv net org",
    "hk": "com edu gov idv net org",
    "sg": "com edu gov net org per",
    "my": "com edu gov net org",
    "in": "ac co edu firm gen gov ind net nic org res",
    "za": "ac co gov net org web",
    "mx": "com edu gob net org",
    "ar": "com edu gob gov net org",
    "tr": "bel com edu gov k12 net org web",
    "il": "ac co gov muni net org",
    "th": "ac co go in mi net or",
    "id": "ac co go net or sch web",
    "ph": "com edu gov net org",
    "vn": "ac com edu gov net org",
    "ua": "com edu gov in net org",
    "pl": "com edu gov info net org",
    "ng": "com edu gov net org",
    "ke": "ac co go ne or",
    "pk": "com edu gov net org",
    "eg": "com edu gov net org",
    "sa": "com edu gov med net org",
    "co": "com edu gov net nom org",
    "pe": "com edu gob net org",
}

# --- models and reports -----------------------------------------------------------------------

SEED = 42
MAX_VOCABULARY = 5000
DEFAULT_CUT = 0.5
SERVING_THRESHOLD = 0.67
FPR_TARGETS = [0.005, 0.01, 0.02]
SELECTED_FPR_TARGET = 0.005
TOP_FEATURES = 20
TOP_EXPLANATIONS = 10
# Train rows that a forest's explanations refer to.
BACKGROUND_ROWS = 20

SAMPLE_TARGETS = {
    (GENERAL_CORPUS, PHISHING): 5500,
    (PHISHING_MBOX, PHISHING): 1500,
    (SYNTHETIC_HEALTHCARE, PHISHING): 500,
    (GENERAL_CORPUS, LEGITIMATE): 5500,
    (SPAM_CORPUS, LEGITIMATE): 1500,
    (SYNTHETIC_HEALTHCARE, LEGITIMATE): 500,
}
CONFOUND_SOURCES = [GENERAL_CORPUS, SYNTHETIC_HEALTHCARE]
CONFOUND_PER_LABEL = 500

NOTE_NO_PHISHING = "no phishing rows: precision/recall/F1/AUC-ROC undefined"
NOTE_NO_LEGITIMATE = "no legitimate rows: FPR/specificity undefined; AUC-ROC undefined"
