"""Line dedup on small texts: which lines go, and the edge cases."""

from facadelake.llm.line_dedup import dedup_lines


def result(spark, rows, schema="doc_id long, text string"):
    return {(r.doc_id, r.n_lines_removed): r.text for r in dedup_lines(spark.createDataFrame(rows, schema)).collect()}


def test_windows_merge(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\n b\nc \n\nd\ny\nz"), (3, "b\nc\nq"), (4, "p\np\np\np\np"), (5, "a\nb\nc\nd\ne")]
    assert result(spark, rows) == {
        (1, 0): "a\nb\nc\nd\ne",
        (2, 4): "x\ny\nz",  # the blank line inside goes, too
        (3, 0): "b\nc\nq",
        (4, 4): "p",  # later windows at lines 1 and 2 cover the last four
        (5, 5): "",
    }


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 0), (3, "\n\n\n", 3), (None, "a\nb\nc", 5), (9, "a\nb\nc", 5), (9, "a\nb\nc", 5), (10, "a\nb\n" + "c\n" * 50_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 AS key", "2 AS gone")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_chars", "key", "gone", "n_lines_removed"]
    got = sorted((r.doc_id or 0, r.text if r.text is None else r.text[:9], r.n_lines_removed, r.n_chars) for r in out.collect())
    # Of the null id, 9 and 10 the null id comes first; equal rows of 9 are one later occurrence each.
    assert got[0] == (0, "a\nb\nc", 0, 5)
    assert got[1:] == [(1, None, 0, 5), (2, "", 0, 0), (3, "\n\n\n", 0, 3), (9, "", 3, 0), (9, "", 3, 0), (10, "", 50_002, 0)]
    assert dedup_lines(df.limit(0)).count() == 0
