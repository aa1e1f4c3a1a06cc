import base64
import gzip
import json
import random


import pytest
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.operators import sampling
from mailsift.sources import files, merge, mime
from mailsift.sources.json_tree import json_tree_text

MBOX = (
    b"text before the first separator is ignored\n"
    b"From a@x Thu Jan  1 00:00:00 2015\nSubject: Plain\nContent-Type: text/plain; charset=utf-8\n\nHello caf\xc3\xa9\n\n"
    b"From b@x Thu Jan  1 00:00:00 2015\nSubject: Multi\nMIME-Version: 1.0\n"
    b'Content-Type: multipart/alternative; boundary="q"\n\n--q\nContent-Type: text/html\n\n<p>Only <b>HTML</b></p>\n--q--\n\n'
    b"From c@x Thu Jan  1 00:00:00 2015\nSubject: Both\nMIME-Version: 1.0\n"
    b'Content-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/plain\n\nfirst\n--q\n'
    b"Content-Type: text/html\n\n<p>html</p>\n--q\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\n"
    + base64.b64encode(b"second") + b"\n--q\nContent-Type: image/png\n\nxx\n--q--\n\n"
    b"From d@x\xe9 Thu Jan  1 00:00:00 2015\nSubject: Skipped\n\nnon-ASCII separator line\n\n"
    b"From e@x Thu Jan  1 00:00:00 2015\nSubject: Unknown charset\nContent-Type: text/plain; charset=no-such\n\nna\xc3\xafve \xff\n\n"
    b"From f@x Thu Jan  1 00:00:00 2015\nContent-Type: text/html; charset=iso-8859-1\n\n<p>caf\xe9 &amp; co</p>\n\n"
    b"From g@x Thu Jan  1 00:00:00 2015\nSubject: \n\n \n"
)


def test_mbox(spark, tmp_path):
    folder = tmp_path / "mail" / "deep"
    folder.mkdir(parents=True)
    (folder / "one.mbox").write_bytes(MBOX)
    (tmp_path / "mail" / "two").write_bytes(b"From x@y Thu Jan  1 00:00:00 2015\r\nSubject: CRLF\r\n\r\nbody\r\n")
    (tmp_path / "mail" / "index.html?C=N;O=D").write_bytes(b"From x\nSubject: no\n\nno\n")
    (tmp_path / "mail" / "robots.txt").write_bytes(b"From x\nSubject: no\n\nno\n")
    messages = mime.read_mbox(spark, str(tmp_path / "mail"))
    got = [(r.subject, r.body.strip()) for r in messages.orderBy("message_no").collect()]
    assert got == [
        ("Plain", "Hello café"), ("Multi", "Only HTML"), ("Both", "first\nsecond"), ("Unknown charset", "naïve �"),
        ("", "café & co"), ("", ""), ("CRLF", "body"),
    ]
    assert messages.select("message_no").distinct().count() == 7
    counts = {r.source_file and r.source_file.rsplit("/", 1)[1]: r.messages for r in mime.message_counts(messages).collect()}
    assert counts == {"one.mbox": 6, "two": 1, None: 7}
    texts = [r.text for r in merge.conform_mailbox(messages).orderBy("message_no").collect()]
    assert texts[0] == "Plain\n\nHello café" and texts[4] == "café & co" and len(texts) == 6


def test_mbox_split_over_blocks(spark, tmp_path):
    """Small blocks must not lose, double or reorder messages."""
    body = "".join(f"From s@x Thu Jan  1 00:00:00 2015\nSubject: m{i}\n\n{'x' * (i % 97)}\n\n" for i in range(400))
    (tmp_path / "big.mbox").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        messages = mime.read_mbox(spark, str(tmp_path))
        assert messages.rdd.getNumPartitions() > 4
        assert [r.subject for r in messages.orderBy("message_no").collect()] == [f"m{i}" for i in range(400)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_eml(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(
        b"Subject: URGENT notice\nContent-Type: text/plain; charset=\"utf-8\"\nContent-Transfer-Encoding: quoted-printable\n\n"
        b"Verify =\nnow: hxxp://x.example/a=3Db\n")
    (tmp_path / "b.txt").write_bytes(b"Subject: no\n\nno\n")
    rows = mime.read_eml(spark, str(tmp_path)).collect()
    assert [(r.subject, r.body) for r in rows] == [("URGENT notice", "Verify now: hxxp://x.example/a=b\n")]


JSON = [
    (json.dumps(["a", ["b", "…", ["", "c\nd"]]]), "a\nb\nc\nd"),
    (json.dumps("only"), "only"),
    (json.dumps({"k": "hidden"}), ""),
    (json.dumps(["x", {"k": "hidden"}, 5, None, ["y"]]), "x\ny"),
    ('["broken', '["broken'),
    ("plain text, not [json]", "plain text, not [json]"),
    ("17", ""),
    (json.dumps(["quote \" and \\ and é"]), 'quote " and \\ and é'),
    (json.dumps(["brace { in text"]), "brace { in text"),
    (json.dumps(["\n" * 5000 + "end"]), "\n" * 5000 + "end"),
    ("[]", ""),
    (None, None),
]


def test_json_trees(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(JSON)], "i int, text string")
    got = [r.t for r in df.select("i", json_tree_text(F.col("text")).alias("t")).orderBy("i").collect()]
    assert got == [w for _, w in JSON]


def test_csv_folder_and_merge(spark, tmp_path):
    (tmp_path / "batch1.csv").write_text(
        'email_type,subcategory,subject,body,source\nPhishing Email,login,"Hi, you","two\nlines ""quoted""",s\n'
        "Safe Email,memo,,only body,s\nOther,memo,x,y,s\n")
    (tmp_path / "batch2.csv").write_text("email_type,subcategory,subject,body,source\nSafe Email,memo,last,,s\n")
    rows = files.read_csv_folder(spark, f"{tmp_path}/batch*.csv", files.SYNTHETIC_SCHEMA)
    merged = merge.merge_sources(merge.conform_synthetic(rows))
    got = [(r.text, r.label, r.subcategory) for r in merged.orderBy("row_id").collect()]
    assert got == [
        ('Hi, you\n\ntwo\nlines "quoted"', "phishing", "login"), ("\n\nonly body", "legitimate", "memo"),
        ("x\n\ny", None, "memo"), ("last\n\n", "legitimate", "memo"),
    ]
    nothing = files.read_csv_folder(spark, f"{tmp_path}/none*.csv", files.SYNTHETIC_SCHEMA)
    assert nothing.count() == 0 and "subject" in nothing.columns


def test_all_sources_from_files(spark, tmp_path):
    (tmp_path / "spam.csv").write_text('text,label,group\n"[""a"", [""b""]]",1,ham\nspam text,0,spam\n')
    (tmp_path / "general.csv").write_text(',Email Text,Email Type\n0,hello,Safe Email\n1,,Phishing Email\n2,pay,Phishing Email\n')
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "m.mbox").write_bytes(b"From a Thu\nSubject: S\n\nB\n")
    spam = files.read_csv(spark, str(tmp_path / "spam.csv"), files.SPAM_CORPUS_SCHEMA)
    general = files.read_csv(spark, str(tmp_path / "general.csv"), files.GENERAL_CORPUS_SCHEMA, enforceSchema=True)
    merged = merge.merge_sources(
        merge.conform_spam_corpus(spam), merge.conform_mailbox(mime.read_mbox(spark, str(tmp_path / "box"))),
        merge.conform_general_corpus(general),
    )
    got = [(r.text, r.label, r.source_dataset, r.included_in_training) for r in merged.orderBy("row_id").collect()]
    assert got == [
        ("a\nb", V.LEGITIMATE, V.SPAM_CORPUS, True), ("spam text", V.SPAM_EXCLUDED, V.SPAM_CORPUS, False),
        ("S\n\nB", V.PHISHING, V.PHISHING_MBOX, True), ("hello", V.LEGITIMATE, V.GENERAL_CORPUS, True),
        ("pay", V.PHISHING, V.GENERAL_CORPUS, True),
    ]
    assert merged.columns == ["row_id", "source_rank", *V.MAIL_COLUMNS]


def test_label_column(spark):
    df = spark.createDataFrame([("a", 1)], "Class string, type int")
    assert files.label_column(df) == "Class"
    assert [tuple(r) for r in files.class_balance(df).collect()] == [("a", 1)]
    assert files.class_balance(df.select(F.lit(1).alias("other"))).count() == 0


def test_materialise_once(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "table")
    assert tuple(files.materialise_once(df, path, "t").first()) == ("t", "written fresh", 5)
    assert tuple(files.materialise_once(spark.range(9), path, "t").first()) == ("t", "skipped (already present)", 5)
    assert tuple(files.status(spark, path + "x", "u", "").first()) == ("u", "MISSING", None)


def test_report_round_trip(spark, tmp_path):
    report = spark.createDataFrame([("m", None, [1, 2])], "model string, auc double, cells array<int>")
    files.write_report(report, str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r"), report.schema).collect() == report.collect()


def with_split_size(spark, size, work):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if size < 10_000 else "4194304")
    try:
        return work()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ids_and_splits_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    """Ids of mbox messages and CSV rows are places in files, so draws repeat under other read settings."""
    (tmp_path / "box").mkdir()
    for name in "ab":
        (tmp_path / "box" / name).write_text("".join(
            f"From s@x Thu Jan  1 00:00:00 2015\nSubject: m{i}\n\nbody {name} {i} {'x' * (i % 97)}\n\n" for i in range(300)))
    for k in range(5):
        (tmp_path / f"batch{k}.csv").write_text("email_type,subcategory,subject,body,source\n" + "".join(
            f'Safe Email,memo,s{i},"b{k}\n{i}",x\n' for i in range(30)))

    def read():
        merged = merge.merge_sources(
            merge.conform_mailbox(mime.read_mbox(spark, str(tmp_path / "box"))),
            merge.conform_synthetic(files.read_csv_folder(spark, f"{tmp_path}/batch*.csv", files.SYNTHETIC_SCHEMA)))
        splits = sampling.train_val_test(merged)
        return {(r.row_id, r.text, r.split) for r in splits.collect()}

    seen = [with_split_size(spark, size, read) for size in (3000, 4096, 128 << 20)]
    assert len(seen[0]) == 750 and seen[0] == seen[1] == seen[2]
    assert len({row_id for row_id, _, _ in seen[0]}) == 750


def test_unreadable_mail_files_are_named(spark, tmp_path):
    (tmp_path / "good").write_bytes(MBOX)
    packed = gzip.compress(b"".join(b"From a Thu\nSubject: %d\n\n%s\n\n" % (i, random.Random(i).randbytes(200).hex().encode())
                                    for i in range(2000)))
    (tmp_path / "whole.gz").write_bytes(packed)
    (tmp_path / "cut.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "no.gz").write_bytes(b"this is no archive")
    states = {r.source_file.rsplit("/", 1)[1]: r for r in mime.file_states(spark, str(tmp_path)).collect()}
    assert {name: r.state for name, r in states.items()} == {
        "good": "whole", "whole.gz": "whole", "cut.gz": "cut", "no.gz": "unreadable"}
    assert states["good"].bytes_read == len(MBOX)


def test_csv_ranges_cut_at_every_byte(spark, tmp_path):
    cells = [("a", 'say ""hi"", then\ngo'), ("b", ""), ("c", "line one\r\nline two\n\nline four"), ("", "x,y"), ("ünï", 'ends in quote""'),
             ("d", "plain"), ("e", '""')]
    for end in ("\n", "\r\n"):
        folder = tmp_path / str(len(end))
        folder.mkdir()
        for name, rows in (("one.csv", cells), ("two.csv", cells[::-1])):
            lines = ["k,v", *[f'{k},"{v}"' if i % 3 else f"{k},{v}" if v.isalpha() else f'{k},"{v}"' for i, (k, v) in enumerate(rows)]]
            (folder / name).write_bytes((end.join(lines) + end).encode())
        size = max(f.stat().st_size for f in folder.iterdir())
        schema = "k string, v string"
        key = lambda r: tuple((c is None, c) for c in r)
        whole = files.read_csv(spark, str(folder), schema, split_files=False).select("k", "v").collect()
        # The one-task reader keeps CRLF within cells or not, as the first line end of the file has it.
        whole = [(r.k, r.v and r.v.replace("\r\n", "\n")) for r in whole]
        assert len(whole) == 2 * len(cells)
        names = None
        for cut in [*range(1, size + 2, 13), size // 2, 10_000]:
            spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            try:
                rows = files.read_csv(spark, str(folder), schema).collect()
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")
            assert sorted([(r.k, r.v) for r in rows], key=key) == sorted(whole, key=key), cut
            found = sorted(r.message_no for r in rows)
            assert len(set(found)) == len(found) and names in (None, found)
            names = found


def test_csv_header_of_other_columns_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,w\n1,2\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path), "k string, v string").collect()
    assert files.read_csv(spark, str(tmp_path), "k string, v string", enforceSchema=True).count() == 1


def test_stored_features_are_joined_without_a_shuffle(spark):
    from mailsift.operators.assemble import join_features, stored_features

    left = spark.createDataFrame([(i, i * 2) for i in range(500)], "row_id bigint, a int")
    right = spark.createDataFrame([(i, i * 3) for i in range(0, 500, 2)], "row_id bigint, b int")
    joined = join_features(*stored_features(left, right))
    rows = joined.collect()
    assert sorted(map(tuple, rows)) == [(i, i * 2, i * 3) for i in range(0, 500, 2)]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_rows_that_break_a_rule_end_the_write(spark, tmp_path):
    from mailsift.workspace import materialise_checked

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "row_id int, label string")
    table, seen = materialise_checked(rows, str(tmp_path / "a"), {"no_id": F.col("row_id").isNull()})
    assert seen == {"rows": 3, "no_id": 0} and table.count() == 3
    with pytest.raises(ValueError, match="no_label.*1"):
        materialise_checked(rows, str(tmp_path / "b"), {"no_label": F.col("label").isNull()})
    assert materialise_checked(rows.limit(0), str(tmp_path / "c"), {"no_id": F.col("row_id").isNull()})[1]["rows"] == 0
