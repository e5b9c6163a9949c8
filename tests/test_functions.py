import pytest
from pyspark.sql import functions as F

from inkstream.functions import detect, persian, rx, slugs
from inkstream.operators import blocks, quality


def value(spark, column, *texts):
    names = [f"c{i}" for i in range(len(texts))]
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
    return df.select(column(*map(F.col, names)).alias("v")).first()["v"]


Z = "‌"


@pytest.mark.parametrize(
    ("column", "text", "expected"),
    [
        (persian.zwnj_count, f"می{Z}رود و کتاب{Z}ها", 2),
        (persian.zwnj_count, "", 0),
        (persian.zwnj_count, None, None),
        (persian.zwnj_positions, f"ab{Z}c{Z}", [2, 4]),
        (persian.fix_letters, "علي كتاب", "علی کتاب"),
        (persian.persian_digits, "a1٢۳", "a۱۲۳"),
        (persian.latin_digits, "۱۲", "12"),
        (persian.guillemets, "\"a\" 'b'", "«a» «b»"),
        (persian.spacing, "a :b", "a: b"),
        (persian.insert_zwnj, "می رود کتاب ها", f"می{Z}رود کتاب{Z}ها"),
        (persian.direction, "", "rtl"),
        (persian.direction, "abc", "ltr"),
        (persian.direction, "سلام abc", "rtl"),
        (persian.direction, "سل abcdef", "mixed"),
        (persian.converter_language, "abc", "en"),
        (persian.normalise, '`"1"` "2"', '`"1"` «۲»'),
        (lambda c: slugs.persian_slug(c, F.lit("x")), "سلام دنیا", "slam-dnya"),
        (lambda c: slugs.persian_slug(c, F.lit("x")), "فصل ۲", "fsl-2"),
        (lambda c: slugs.persian_slug(c, F.lit("x")), "De Morgan's ﬁne Ｌａｗｓ", "de-morgan-s-fine-laws"),
        (lambda c: slugs.persian_slug(c, F.lit("x")), "منطق گزاره\u200cای", "mntgh-gzarh-ay"),
        (lambda c: slugs.ascii_slug(c, F.lit("x")), "A  b!", "a-b"),
        (lambda c: slugs.ascii_slug(c, F.lit("x")), "Größe Caféx résumé", "gre-cafx-rsum"),
        (lambda c: slugs.ascii_slug(c, F.lit("x")), "سلام", "x"),
        (lambda c: slugs.truncate(c, 10), "one two three", "one two..."),
        (lambda c: slugs.iso_date(c, "1970-01-01"), "in 2020-02-03", "2020-02-03"),
        (lambda c: slugs.iso_date(c, "1970-01-01"), "1999", "1999-01-01"),
        (slugs.camel, "stroke-line-cap", "strokeLineCap"),
        (slugs.width_percent, r"0.5\textwidth", "50%"),
        (slugs.label_kind, "fig:x", "شکل"),
        (slugs.unescape, "&lt;&amp;&gt;", "<&>"),
        (detect.content_format, r"\documentclass{book}\begin{document}", "latex"),
        (detect.content_format, "plain", "unknown"),
        (detect.archive_kind, "a.tar.gz", "tar.gz"),
        (detect.unsafe_path, "a/../b", True),
        (detect.is_book, r"\chapter{a}\chapter{b}", True),
        (blocks.braces_balanced, r"{a\{}{b}", True),
        (blocks.braces_balanced, "}{", False),
        (blocks.environments_match, r"\begin{a}\begin{b}\end{b}\end{a}", True),
        (blocks.to_mdx_math, r"\(x\) \[y\]", "$x$ $$y$$"),
        (blocks.to_mdx_links, r"\href{u}{t} \url{v}", "[t](u) [v](v)"),
        (blocks.html_to_jsx, '<p class="a"><br></p>', '<p className="a"><br /></p>'),
        (lambda c: quality.readiness(quality.issues(c, F.lit("latex"))), "", 84),
    ],
)
def test_function(spark, column, text, expected):
    assert value(spark, column, text) == expected


def test_splice_keeps_matches(spark):
    up = lambda c: rx.splice(c, r"\$[^$]*\$", fix_gap=F.upper)
    assert value(spark, up, "a $x$ b $y$") == "A $x$ B $y$"


def test_preserved(spark):
    score = lambda a, b: quality.content_score(quality.counters(a), quality.counters(b))
    assert value(spark, score, "# a\n# b", "# a") == 12.5
    assert value(spark, score, "x", "y") == 25.0
