import pytest
from pyspark.sql import functions as F
from test_functions import value

from inkstream.functions import latex_text as L
from inkstream.functions import rx, slugs
from inkstream.operators import convert


@pytest.mark.parametrize(
    ("column", "text", "expected"),
    [
        (L.clean, "a % note\n\\label{x}b \\vspace*{1em} c \\quad d\\newpage\n\n\n\nd \\% e \\smallcaps", "a\n\\label{x}b c &emsp; d\n\n\nd \\% e \\smallcaps".replace("d\n\n\nd", "d\n\n---\n\n\nd")),
        (lambda c: L.clean(c, ("xx",), {"yy": "z"}), "\\xx{1}a\\yy b", "az b"),
        (L.clean, None, None),
        (L.title, r"\textbf{A}~B $x$ {C}", "A B x C"),
        (L.direction_spans, r"\lr{ab} \begin{latin} x \end{latin}", '<span dir="ltr">ab</span> <div dir="ltr">\n\nx\n\n</div>'),
        (L.footnotes, r"a\footnote{x} b\footnote{y {z}}", "a[^1] b[^2]\n\n---\n\n[^1]: x\n[^2]: y {z}"),
        (L.footnotes, "none", "none"),
        (L.with_direction, "text", "---\ndir: rtl\nlang: fa\n---\n\ntext"),
        (L.with_direction, "---\ntitle: t\ndir: ltr\n---\nx", "---\ndir: rtl\nlang: fa\ntitle: t\n---\nx"),
        (L.wrap_blocks, "a $$x$$", 'a <div dir="ltr">\n\n$$x$$\n\n</div>'),
        (L.style_object, "font-size: 1px; color:red;", "{{fontSize: '1px', color: 'red'}}"),
        (slugs.metadata_slug, "a" * 50 + " " + "b" * 50, "a" * 50),
        (slugs.metadata_slug, "", "document"), (slugs.metadata_slug, "قضیه فصل ۲", "ghaziyah-fasl-2"), (slugs.metadata_slug, "قلم_A. ß", "qlam-a-ß"), (slugs.metadata_slug, "هم\u200cارز", "ham-arz"),
        (lambda c: rx.every(c, L.DIRECTIVE, 1), ".. note:: x\n\n.. tip:: y", ["note", "tip"]),
        (lambda c: rx.every(c, L.TCOLORBOX, 1), r"\begin{tcolorbox}[title=T]b\end{tcolorbox}", ["title=T"]),
        (lambda c: rx.every(c, L.MACRO, 1), r"\newcommand{\ab}[2]{x {y}}\renewcommand{\cd}{z}", ["ab", "cd"]),
        (lambda c: rx.let(c, lambda x: F.concat(x, x)), "ab", "abab"),
        (lambda c: convert.frontmatter(c)["title"], "---\ntitle: a: b\nslug: s\n---\nx", "a: b"),
    ],
)
def test_text(spark, column, text, expected):
    assert value(spark, column, text) == expected


def test_overlaps(spark):
    spans = [(1, 0, 5), (2, 3, 8), (2, 5, 7), (3, 20, 21), (3, 6, 9)]
    df = spark.createDataFrame([(spans,), ([],)], "s array<struct<prio:int,start:int,end:int>>")
    out = [[tuple(x) for x in r[0]] for r in df.select(L.without_overlaps(F.col("s"))).collect()]
    assert out == [[(1, 0, 5), (2, 5, 7), (3, 20, 21)], []]
