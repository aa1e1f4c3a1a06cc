import random
import re
from email.errors import HeaderParseError
from email.header import decode_header

import pytest
from pyspark.sql import functions as F

from mailsift.functions import cleaning as C
from mailsift.functions.html_text import has_known_tag, html_to_text
from mailsift.operators import cleaning as O


def one_column(spark, texts, column, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_blank_and_placeholders(spark):
    blank = [None, "", " \t\n 　", "N/A", " null ", "[No Content]", "Undefined\n", "NaN", "#N/A"]
    kept = ["not empty", "n / a", "none of it", "[no content] x", "nans"]
    got = one_column(spark, blank + kept, C.is_blank_or_placeholder(F.col("text")))
    assert got == [True] * len(blank) + [False] * len(kept)


MOJIBAKE = [
    ("cafÃ©", "café"),
    ("café Ã©", "café Ã©"),
    ("x€Ã©", "x€Ã©"),
    ("plain café", "plain café"),
    ("itâ€™s", "itâ€™s"),
    ("Â x Ã¨", " x è"),
    ("bad Ã© \xff", "bad Ã© \xff"),
]


def test_mojibake(spark):
    got = one_column(spark, [t for t, _ in MOJIBAKE], C.fix_mojibake(F.col("text")))
    assert got == [want for _, want in MOJIBAKE]


WORDS = [
    ("=?utf-8?B?VVJHRU5UIG5vdGljZQ==?= now", "URGENT notice now"),
    ("a =?ISO-8859-1?q?R=E9sum=E9_attached?= b", "a Résumé attached b"),
    ("=?no-such-charset?Q?abc?=", "=?no-such-charset?Q?abc?="),
    ("=?utf-8?Q?a?= =?utf-8?Q?b?=", "a b"),
    ("=?utf-8?X?abc?=", "=?utf-8?X?abc?="),
    ("=?utf-8?b?5pel5pys?= =?koi8-r?B?8NLJ18XU?=", "日本 Привет"),
    ("=?utf-8?B?YQ?==?utf-8?Q?=C3=28_=zz?=", "a�( =zz"),
    ("=?utf-8?B?a?= =?base64?Q?abc?= =?utf-8?Q?日?=", "=?utf-8?B?a?= =?base64?Q?abc?= =?utf-8?Q?日?="),
    ("=?utf-8?Q??=|=?ascii?Q?caf=E9?=", "|caf�"),
    (None, None),
]


def test_encoded_words(spark):
    assert one_column(spark, [t for t, _ in WORDS], C.decode_mime_words(F.col("text"))) == [w for _, w in WORDS]


HTML = [
    ("<p>Dear <b>user</b>,<br>hello</p>", "Dear user , hello"),
    ("1 < 2 and <unknown>tag</unknown>", "1 < 2 and <unknown>tag</unknown>"),
    ("<html><script>var a='<p>';</script><style>p{}</style><!-- no -->yes</html>", "yes"),
    ("<p>a &amp; b &lt;c&gt;&nbsp;</p>", "a & b <c>"),
    ("<p>caf&eacute; &#39;x&#39; &#146; &#x41;</p>", "café 'x' ’ A"),
    ("<p>fish &amp chips</p>", "fish & chips"),
    ('<a title="a>b" href=x/y>link</a>', "link"),
    ("<div>\n  <p> one </p>\n\n<p>two\nlines</p></div>", "one two\nlines"),
    ("<p>open <b>only", "open only"),
    ("<template>hidden</template><p>shown</p>", "shown"),
    ("<p></p>", ""),
    ("no tags &amp; kept", "no tags &amp; kept"),
    ("<title>T</title>body", "T body"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HTML)], "i int, text string")
    got = [r.text for r in C.with_clean_text(df).orderBy("i").collect()]
    assert got == [want for _, want in HTML]


def test_parser_survives_odd_input():
    for text in ["<", "<p", "</", "<!", "<![CDATA[", "&", "&#;", "&#99999999999;", "<p><![if x]>y"]:
        assert isinstance(html_to_text(text), str)


def stepwise(text):
    """The chain in plain Python: words by the mail library, then mojibake, then the parser."""
    def word(match):
        try:
            return "".join(t.decode(c or "utf-8", "replace") if isinstance(t, bytes) else t for t, c in decode_header(match[0]))
        except (LookupError, HeaderParseError):
            return match[0]

    text = re.sub(C.V.ENCODED_WORD, word, text)
    hints = lambda t: len(re.findall(C.MOJIBAKE_HINT, t))
    try:
        other = text.encode("latin-1").decode("utf-8")
        if hints(other) < hints(text):
            text = other
    except UnicodeError:
        pass
    return html_to_text(text) if re.search(rf"(?i)</?(?:{C.V.HTML_TAGS})\b[^>]*>", text) else text


def test_jvm_and_python_cleaning_agree(spark):
    """Random markup: whichever path a text takes, the result is the Python chain's."""
    mild = ["&#39;", "&#8217;", "&#x1F600;", "&eacute;", "&NotEqualTilde;", "&#146;", "&#129;", "&#38;lt;", "&amp;lt;", "&apos;",
            "&#1114112;", "<p>", "</p>", "<b>", "</b>", " text ", "word", "&amp;", "&lt;", "&nbsp;", "<br>", "<br/>", "\n", "é", "Ã©",
            '<a href="http://x.y/?a=1">', "</a>", "<a href=foo/bar>", "<!-- c -->", "<!doctype html>", "a < b", "1<2",
            '<script>var a="</p>";</script>', "<style>p{}</style>", '<IMG SRC=x ALT="y">', "<td nowrap width=10%>", "<hr />"]
    odd = ["&#99999999;", "&#x;", "?a=1&b=2", "&amp", "& ", "< b", '<a title="a>b">', "<!-->", "<textarea><b>x</b>", "<?php ?>", "<b", "</ p>",
           "=?utf-8?B?w6k=?=", "<![CDATA[x]]>", "<p class=it's>", "<o:p>", "&unknown;", "<a/b>"]
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(mild + (odd if i % 3 == 0 else []), k=rng.randint(1, 10)))) for i in range(6000)]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r.i: r.text for r in C.with_clean_text(df).collect()}
    wrong = [(t, got[i], stepwise(t)) for i, t in rows if got[i] != stepwise(t)]
    assert not wrong, wrong[:5]
    assert df.filter(has_known_tag(F.col("text"))).count() > 3000


TAGS = [
    ("cvs commit: x", "cvs_commit"),
    ("xcvs commit", ""),
    ("text\n+++ b/file", "git_diff"),
    ("text +++ b/file", ""),
    ("def run(", "code_snippet"),
    ("call FUNCTION  go (x) to unsubscribe", "code_snippet;mailing_list_footer"),
    ("morphological noun phrases; Revision 7", "cvs_commit;linguistics"),
    ("spamassassin-talk@lists", "mailing_list_footer"),
    ("hello", ""),
]


def test_non_email_tags(spark):
    rows = [(i, t, source) for i, (t, _) in enumerate(TAGS) for source in ("spamassassin", "nazario")]
    df = spark.createDataFrame(rows, "row_id int, text string, source_dataset string")
    got = {r.row_id: r for r in O.tagged_rows(df).collect()}
    assert {i: got[i].matched if i in got else "" for i in range(len(TAGS))} == {i: m for i, (_, m) in enumerate(TAGS)}
    assert all(r.first_matched == r.matched.split(";")[0] for r in got.values())
    left = O.without_non_email(df).count()
    assert left == len(rows) - len(got)


def test_first_copies_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        # One text holds a third of all rows.
        text = "hot" if rng.random() < 0.34 else f"t{rng.randint(0, 80)}"
        rank = rng.randint(0, 3)
        rows.append((i, rank, text, f"label{i}", f"s{rank}"))
    df = spark.createDataFrame(rows, "row_id long, source_rank int, text string, label string, source_dataset string")
    want = {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        want.setdefault(row[2], row)
    got = O.first_copies(df)
    assert {tuple(r) for r in got.collect()} == set(want.values())
    assert {tuple(r) for r in O.first_copies(got).collect()} == set(want.values())

    report = {r.source_dataset: r for r in O.duplicate_report(df).collect()}
    for rank in range(4):
        own = [r for r in rows if r[1] == rank]
        removed = [r for r in own if want[r[2]] != r]
        cross = [r for r in removed if want[r[2]][1] != rank]
        r = report[f"s{rank}"]
        assert (r["rows"], r.removed, r.cross_source) == (len(own), len(removed), len(cross))


def test_empty_source_has_no_rate(spark):
    df = spark.createDataFrame([], "row_id long, text string, source_dataset string")
    assert O.tag_rate(df).first().share is None


@pytest.mark.parametrize("value,kept", [(True, 1), (False, 0), (None, 0)])
def test_unknown_eligibility_is_not_eligible(spark, value, kept):
    df = spark.createDataFrame([(value,)], "included_in_training boolean")
    assert O.eligible(df).count() == kept


def test_texts_of_a_batch_are_unpacked_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from mailsift.functions.patterns import by_runs

    texts = pa.array([None, "", *["=?utf-8?b?w6Q=?= " * 6000] * 200, None])
    tracemalloc.start()
    found = by_runs(lambda text: C._ENCODED_WORD_PARTS.sub(C._word_text, text))(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [None, "", *["ä " * 6000] * 200, None] and peak < texts.nbytes / 4
    assert by_runs(str.upper, 1)(pa.array(["a", None, "bc"]).slice(1)).to_pylist() == [None, "BC"]
    assert by_runs(str.upper)(pa.array([], pa.string())).to_pylist() == []


def test_a_few_copies_never_make_texts_travel(spark):
    rows = [(i, 0, f"text {i % 7}") for i in range(40)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = O.first_copies(spark.createDataFrame(rows, "row_id bigint, source_rank int, text string"))
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r.row_id for r in got.collect()) == list(range(7))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_dense_features_are_not_computed_again(spark):
    from mailsift.functions import fixed_values as V
    from mailsift.operators.assemble import with_dense_features

    dense = with_dense_features(spark.createDataFrame([(1, "Act now! http://bit.ly/x")], "row_id bigint, text string"))
    assert {dict(dense.dtypes)[c] for c in V.DENSE_FEATURES} == {"double"}
    marked = dense.withColumn("url_count", F.lit(77.0))
    assert with_dense_features(marked).first().url_count == 77.0


def test_flags_before_and_after_cleaning_come_from_one_pass(spark):
    texts = ["<p>Hello</p>", "plain", "<p> &nbsp; </p>", "cafÃ© =?utf-8?b?w6Q=?=", "� <b>x</b>"]
    rows = [(i, 0, f"s{i % 2}", t) for i, t in enumerate(texts)] + [(9, 1, "blank", "<p> </p>")]
    df = spark.createDataFrame(rows, "row_id bigint, source_rank int, source_dataset string, text string")
    got, want = O.cleaning_report(df), O.quality_report(df, O.clean(df))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ("before", "blank", 1, 0, 0, 0) in {tuple(r) for r in got.collect()} and not got.filter("stage = 'after' and source_dataset = 'blank'").count()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
