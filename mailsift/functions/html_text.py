"""Visible text of HTML.

Well-formed markup is cut into text pieces by one regex on the JVM. Texts with anything the
regex does not cover (broken tags, rare entities, CDATA, ...) go to the standard library's
HTML parser in Arrow batches; both give the same text where the regex applies.
"""

from __future__ import annotations

from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from mailsift.functions.fixed_values import HTML_TAGS
from mailsift.functions.patterns import AT_WORD_END, by_runs, matches, trim_space, with_computed

KNOWN_TAG = rf"(?iu)</?(?:{HTML_TAGS}){AT_WORD_END}[^>]*+>"

# Possessive quantifiers keep matching iterative, so long pages cannot exhaust the stack.
_ATTRIBUTE = r"""[ \t\r\n]++[a-z_:@][-a-z0-9_:.]*+(?:[ \t\r\n]*+=[ \t\r\n]*+(?:"[^"<>]*+"|'[^'<>]*+'|[^ \t\r\n"'<>=`/]++(?:/[^ \t\r\n"'<>=`/]++)*+))?+"""
_OPEN_REST = rf"(?:{_ATTRIBUTE})*+[ \t\r\n]*+/?>"
# Elements whose content is hidden or not parsed as markup are left to the parser.
_RAW_TEXT_TAGS = r"script|style|template|rt\b|rp\b|textarea|xmp|iframe|noembed|noframes|plaintext"
PLAIN_MARKUP = (
    r"(?is)(?=<)(?:<!--(?!-?>)(?:(?!--).)*+-->"
    r"|<!doctype[^<>\[\]\"']*+>"
    rf"|<(script|style){_OPEN_REST}.*?</\1[ \t\r\n]*+>"
    rf"|<(?!{_RAW_TEXT_TAGS})[a-z][-a-z0-9:_.]*+{_OPEN_REST}"
    rf"|</(?!{_RAW_TEXT_TAGS})[a-z][-a-z0-9:_.]*+[ \t\r\n]*+>)"
)

# Character references decoded on the JVM: numbers, and all names that end with a semicolon, frequent ones first.
_FREQUENT = ["amp", "nbsp", "lt", "gt", "quot", "apos", "copy", "reg", "middot", "bull", "hellip", "ndash", "mdash",
             "lsquo", "rsquo", "ldquo", "rdquo", "euro", "pound", "trade"]
_RARE = sorted(name[:-1] for name in html5 if name.endswith(";") and name[:-1] not in _FREQUENT)
_NUMBER = "#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6})"
_LEFTOVER = rf"<[a-zA-Z/!?]|&(?!(?:{_NUMBER}|{'|'.join([*_FREQUENT, *_RARE])});)[a-zA-Z#]"
# Numbers from 128 to 159 stand for characters of a code page; it lacks some.
_CODE_PAGE = [bytes([code]).decode("windows-1252", "replace") for code in range(128, 160)]

_VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_HIDDEN_CONTAINERS = frozenset(["script", "style", "template", "rt", "rp"])


def _numbered_character(code: Column) -> Column:
    in_page = F.get(F.array(*map(F.lit, _CODE_PAGE)), (code - 128).cast("int"))
    other = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(128, 159), in_page).when(code <= 0x10FFFF, other).otherwise(F.lit("\ufffd"))


def _decoded_start(piece: Column) -> Column:
    """A piece that begins at an ampersand, with the reference there decoded; nothing is decoded twice."""
    name = F.regexp_extract(piece, rf"\A&({_NUMBER}|[a-zA-Z0-9]+);", 1)
    digits = F.regexp_extract(name, r"\A#([0-9]+)\z", 1)
    hexed = F.regexp_extract(name, r"\A#[xX](.+)\z", 1)
    code = F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("bigint"))
    known = F.when(name == "amp", "&")
    for frequent in _FREQUENT[1:]:
        known = known.when(name == frequent, html5[f"{frequent};"])
    rare = F.create_map(*[F.lit(v) for n in _RARE for v in (n, html5[f"{n};"])])
    known = known.when(F.startswith(name, F.lit("#")), _numbered_character(code)).otherwise(rare[name])
    rest = F.substring(piece, F.length(name) + 3, F.length(piece))
    return F.when(name == "", piece).otherwise(F.coalesce(F.concat(known, rest), piece))


def _decode_entities(piece: Column) -> Column:
    parts = F.split(piece, "(?=&)")
    decoded = F.array_join(F.transform(parts, _decoded_start), "")
    return F.when(F.contains(piece, F.lit("&")), decoded).otherwise(piece)


class _TextCollector(HTMLParser):
    """Collects text nodes; adjacent characters and entities form one node."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes: list[str] = []
        self._run: list[str] = []
        self._open: list[str] = []

    def _flush(self):
        node = "".join(self._run).strip()
        self._run = []
        if node and not _HIDDEN_CONTAINERS.intersection(self._open):
            self.nodes.append(node)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag not in _VOID_TAGS:
            self._open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_endtag(self, tag):
        self._flush()
        if tag in self._open:
            while self._open.pop() != tag:
                pass

    def handle_data(self, data):
        self._run.append(data)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            if 128 <= code < 160:
                self._run.append(bytes([code]).decode("windows-1252"))
            else:
                self._run.append(chr(code))
        except (ValueError, OverflowError, UnicodeDecodeError):
            self._run.append("�")

    def handle_entityref(self, name):
        self._run.append(html5.get(f"{name};", f"&{name}"))

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self) -> str:
        self._flush()
        return " ".join(self.nodes)


def html_to_text(markup: str) -> str:
    collector = _TextCollector()
    try:
        collector.feed(markup)
        collector.close()
    except (AssertionError, ValueError):
        return markup
    return collector.text()


def has_known_tag(text: Column) -> Column:
    return matches(text, KNOWN_TAG)


def markup_pieces(text: Column) -> Column:
    """The text cut at its markup; NULL where no known tag occurs."""
    return F.when(has_known_tag(text), F.split(text, PLAIN_MARKUP, -1))


def need_parser(pieces: Column) -> Column:
    """True where cutting left something that may be markup, or a rare entity."""
    return F.exists(pieces, lambda p: F.rlike(p, F.lit(_LEFTOVER)))


def joined_pieces(pieces: Column) -> Column:
    """Entities decoded, pieces trimmed, the non-empty ones joined by one blank."""
    cleaned = F.transform(pieces, lambda p: trim_space(_decode_entities(p)))
    return F.array_join(F.filter(cleaned, lambda p: p != ""), " ")


_parsed_text = F.arrow_udf(by_runs(html_to_text), StringType())


def with_visible_text(df: DataFrame, text: str) -> DataFrame:
    """Replace a text column by its visible text where a known tag occurs."""
    cut = df.withColumn("_pieces", markup_pieces(F.col(text)))
    # Python sees NULL unless the parser is needed: a UDF inside WHEN would run on every row.
    parsed = _parsed_text(F.when(need_parser(F.col("_pieces")), F.col(text)))
    visible = F.coalesce(parsed, joined_pieces(F.col("_pieces")), F.col(text))
    return with_computed(cut, text, visible).drop("_pieces")


@F.pandas_udf(ArrayType(StringType()))
def _parsed_parts(parts: pd.Series) -> pd.Series:
    return parts.map(lambda texts: None if texts is None else [html_to_text(t) for t in texts])


def with_visible_parts(df: DataFrame, parts: str) -> DataFrame:
    """Replace an array of HTML texts by their visible texts, whether or not they hold a known tag."""
    cut = df.withColumn("_pieces", F.transform(parts, lambda t: F.split(t, PLAIN_MARKUP, -1)))
    parsed = _parsed_parts(F.when(F.exists("_pieces", need_parser), F.col(parts)))
    return with_computed(cut, parts, F.coalesce(parsed, F.transform("_pieces", joined_pieces))).drop("_pieces")
