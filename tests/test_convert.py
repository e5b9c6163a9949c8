import io
import tarfile
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstream import engine
from inkstream.functions import persian
from inkstream.operators import bibtex, boxes, convert, corpus, figures, html, latex
from inkstream.plans import corpus as plans
from inkstream.sources import files, sinks


def test_latex_tree():
    root = latex.parse(r"\section{A}Text \textbf{b} $x$ \begin{itemize}\item one\item two\end{itemize} \[y\] % note")
    rows = latex.rows_of(root)
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    assert {r[4] for r in rows} == {"command", "text", "math", "environment", "comment"}
    items = [r for r in rows if r[5] == "item"]
    assert len(items) == 2 and len({r[1] for r in items}) == 1


def test_latex_never_fails():
    assert latex.to_mdx(None) is None
    assert latex.render(latex.parse("")) == ""
    assert latex.render(latex.parse(r"\end{x} \begin{y} $ \textbf{")) != ""
    deep = r"\begin{minipage}{1}" * 30_000 + "x" + r"\end{minipage}" * 30_000
    assert latex.render(latex.parse(deep)) == "x"
    boxes = latex.render(latex.parse(r"\begin{center}" * 3000 + "x" + r"\end{center}" * 3000))
    assert boxes.count("<div") == boxes.count("</div>") == 3000
    assert "x" in latex.render(latex.parse(r"\textbf{" * 500 + "x" + "}" * 500))
    assert latex.render(latex.parse(r"\emph{" * 50_000)).startswith("**")


@given(st.text("{}[]\\\\a", max_size=30))
def test_ends_of_groups(text):
    pairs = latex._Pairs(text)
    starts, i = [], 0
    while i < len(text):
        starts += [i] if text[i] in "{[" else []
        i += 2 if text[i] == "\\" else 1
    assert all(pairs.end(i, o, c) == latex._group(text, i, o, c) for i in starts for o, c in ("{}", "[]") if text[i] == o)


def test_latex_to_mdx():
    mdx = latex.to_mdx(r"\title{T}\begin{document}\section{S}\emph{e}\footnote{n}\begin{theorem}[N]b\end{theorem}\begin{minted}{py}x=1\end{minted}\begin{align}a&=b\end{align}\end{document}")
    for part in ("title: T", "## S", "*e*", "[^1]: n", '<Theorem title="N">', "```py\nx=1\n```", "\\begin{aligned}"):
        assert part in mdx


@pytest.mark.parametrize(
    ("source", "mdx"),
    [
        (r"\begin{enumerate}\item one\item two\begin{itemize}\item x\item y\end{itemize}\item three\end{enumerate}", "1. one\n2. two\n  - x\n  - y\n3. three"),
        (r"\textbf{a \emph{b}} \underline{c}", "**a *b*** <u>c</u>"), (r"\ref{eq:a_b} \eqref{eq:1}", '<CrossRef target="eq-a-b" /> <CrossRef target="eq-1" type="equation" />'), (r"\cite{a,b}", '<Citation keys="a,b" />'),
        (r"\begin{figure}\centering\includegraphics[width=0.5\textwidth]{a.png}\caption{C \emph{x}}\label{fig:a_b}\end{figure}", '<Figure src="a.png" caption="C *x*" id="fig-a-b" />'),
        (r"\begin{wrapfigure}{l}{0.4\textwidth}\includegraphics{a}\end{wrapfigure}", '<Figure float="left" width="40%" src="a" />'),
        (r"\begin{figure}\includegraphics{a}\includegraphics{b}\caption{c}\end{figure}", '<FigureGrid caption="c">\n<Image src="a" />\n<Image src="b" />\n</FigureGrid>'),
        (r"\begin{table}\caption{T}\begin{tabular}{|l|c|r|}\hline a & b & c \\ \hline 1 & \textbf{2} & 3 \\[1ex]\end{tabular}\end{table}", "**T**\n\n| a | b | c |\n| --- | :---: | ---: |\n| 1 | **2** | 3 |"),
        (r"\begin{tabular}{ll}\multicolumn{2}{c}{H}\\a & b\end{tabular}", '<table dir="rtl">\n  <thead>\n    <tr>\n      <th colspan="2">H</th>\n    </tr>\n  </thead>\n  <tbody>\n    <tr>\n      <td>a</td>\n      <td>b</td>\n    </tr>\n  </tbody>\n</table>'),
        (r"\begin{tcolorbox}[title={Hi},colback=red]b\end{tcolorbox}", '<Admonition type="warning" title="Hi">\n\nb\n\n</Admonition>'), (r"\begin{abstract}a\end{abstract}", '<Admonition type="abstract" title="چکیده">\n\na\n\n</Admonition>'),
        (r"\begin{theorem}[N]\label{thm:x}b\end{theorem}", '<Theorem id="thm-x" title="N">\n\nb\n\n</Theorem>'), ("\\begin{quote}a\nb\\end{quote}", "> a\n> b"), (r"\begin{align}a&=b\end{align}", "$$\n\\begin{aligned}\na&=b\n\\end{aligned}\n$$"),
        (r"\begin{tikzpicture}\draw;\end{tikzpicture}", "<TikZDiagram>\n\\draw;\n</TikZDiagram>"), (r"\input{no}x", r"\input{no}x"), (r"\textcolor{red}{t}\footnote{\emph{n}}", '<span style={{color: "red"}}>t</span>[^1]\n\n[^1]: *n*'),
    ],
)
def test_latex_rules(source, mdx):
    assert latex.render(latex.parse(source)) == mdx


def test_macros():
    text = r"\newcommand{\R}{\mathbb{R}}\newcommand{\p}[2][x]{(#1,#2)}\def\q{\R\R}\DeclareMathOperator{\rk}{rank}$\R^n$ \p{a} \p[b]{c} \q{} \rk A \begin{verbatim}\R\end{verbatim}\Rest"
    without, macros = latex.take_macros(text)
    assert set(macros) == {"R", "p", "q", "rk"}
    assert latex.expand(without, macros) == r"$\mathbb{R}^n$ (x,a) (b,c) \mathbb{R}\mathbb{R} \operatorname{rank} A \begin{verbatim}\R\end{verbatim}\Rest"
    assert len(latex.expand(r"\a", {"a": (0, None, r"\a\a")})) < 10 * latex.EXPANSIONS
    assert latex.preamble(r"\documentclass[a]{book}\usepackage{x, y}\newtheorem{satz}{Satz}\title{A \emph{B}}") == latex.Preamble("book", ["x", "y"], {}, {"satz": "Theorem"}, r"A \emph{B}")
    assert latex.to_mdx(r"\title{A: \emph{B}~c}\author{X \and Y}\begin{document}\newcommand{\z}{zz}\z.\end{document}") == "---\ntitle: 'A: B c'\nauthor: X Y\n---\n\nzz.\n"


@pytest.mark.parametrize(("value", "scalar"), [("a b", "a b"), ("a: b", "'a: b'"), ("it's #1", "'it''s #1'"), ("yes", "'yes'"), ("12", "'12'"), ("", "''"), ("-x", "-x"), ("سلام", "سلام")])
def test_yaml_scalar(value, scalar):
    assert latex.yaml_scalar(value) == scalar


@pytest.mark.parametrize(
    ("source", "mdx"),
    [
        ("<html lang=fa><title>T: x</title><meta content=d name=description><h2 id=a>H</h2>", "---\ntitle: 'T: x'\ndescription: d\nlang: fa\n---\n\n## H {#a}\n"), ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c\n"), ("<dl><dt>t<dd>d</dl>", "**t**\n: d\n"),
        ("<figure><img src=i alt=x><figcaption>C</figcaption></figure>", '<Figure src="i" alt="x" caption="C" />\n'), ("<details><summary>S</summary>b <b>q</b></details>", '<Details title="S">\n\nb **q**\n\n</Details>\n'),
        ("<form action=/x method=post><input name=n type=text></form>", "{/* Form[action=/x, method=POST, fields=n(text)] */}\n"), ('<math display=block><annotation encoding="application/x-tex">x^2</annotation></math>', "$$\nx^2\n$$\n"),
        ("<span class=katex data-latex=y>z</span> <span data-tex=w></span> <script type='math/tex'>s</script><script>no</script>", "$y$ $w$ $s$\n"), ("<math><mi>a</mi> <mo>+</mo></math>", "$a+$\n"),
        ("<table><caption>C</caption><tr><th>x<td>y|z<tr><td>1</table>", "**C**\n\n| x | y\\|z |\n| --- | ---- |\n| 1 |  |\n"), ("<table><tr><td colspan=2>m</table>", "<table>\n  <tr>\n    <td colSpan={2}>m</td>\n  </tr>\n</table>\n"),
        ('<pre><code class="language-py">a\nb</code></pre>', "```py\na\nb\n```\n"), ("<video src=v controls></video><iframe src=f></iframe>", '<Video src="v" controls={true} />\n\n<Embed src="f" title="Embedded content" />\n'),
        ("<blockquote>q1<p>q2</blockquote>", "> q1\n>\n> q2\n"), ("<div dir=rtl>w</div><!-- c -->", '<div dir="rtl">\n\nw\n\n</div>\n\n{/* c */}\n'), ("a<br>b <a href=u title=t>v</a><a href=w></a> <kbd>k</kbd>", 'a\\\nb [v](u "t")w <kbd>k</kbd>\n'), ("</p></div>", "\n"),
    ],
)
def test_html_rules(source, mdx):
    assert html.to_mdx(source) == mdx


def test_html_of_any_depth():
    assert html.to_mdx("<div>" * 50_000 + "x") == "x\n" and html.to_mdx(None) is None and html.to_mdx("<b") is not None
    names = list(html.pictures(html.read("<svg><path d=a /></svg><p><svg><path d=a /></svg>")))
    assert len(names) == 1 and names[0].startswith("svg-")


def test_boxes(spark):
    text = "\\begin{theorem}[N]\\label{a}b\\end{theorem} \\begin{tcolorbox}[title=T,colback=red!5]x\\end{tcolorbox}\n> [!WARNING] W\n> l1\n> l2\n\n<div class=\"my-tip\">h</div><details><summary>S</summary>b</details>\n.. hint:: X\n\n   i1\n   i2\n\nend"
    rows = boxes.boxes(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert {tuple(r)[:8] for r in rows} == {
        (1, "latex", 0, "theorem", "N", "b", "a", "Theorem"), (1, "tcolorbox", 0, "warning", "T", "x", None, "Admonition"), (1, "callout", 0, "warning", "W", "l1\nl2", None, "Admonition"), (1, "html", 0, "tip", None, "h", None, "Admonition"),
        (1, "details", 0, "", "S", "b", None, "Details"), (1, "directive", 0, "tip", "X", "i1\ni2", None, "Admonition"),
    }
    assert next(r["mdx"] for r in rows if r["source"] == "latex") == '<Theorem type="theorem" title="N" id="a">\n\nb\n\n</Theorem>'


def test_figures(spark):
    text = r"\begin{figure}[ht]\includegraphics[width=1cm]{a}\caption{C}\label{f:a}\end{figure}\begin{wrapfigure}{r}{2cm}\includegraphics{b}\end{wrapfigure}\begin{figure}\begin{subfigure}{1cm}\includegraphics{c}\caption{P}\end{subfigure}\caption{G}\end{figure}"
    rows = figures.figures(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t", {"b": "new/b.png"}).collect()
    got = {(r["kind"], r["pos"]): r for r in rows}
    assert len(rows) == 3 and got["figure", 0]["mdx"] == '<Figure id="f:a">\n  <Image src="a" alt="C" />\n  <figcaption>C</figcaption>\n</Figure>'
    assert got["wrapfigure", 0]["mdx"] == '<Figure float="right">\n  <Image src="new/b.png" alt="" />\n</Figure>' and got["wrapfigure", 0]["width"] == "2cm"
    assert got["figure", 1]["mdx"] == '<FigureGrid>\n  <Figure>\n  <Image src="c" alt="P" />\n  <figcaption>P</figcaption>\n</Figure>\n  <figcaption>G</figcaption>\n</FigureGrid>'
    tikz = spark.createDataFrame([(1, r"\begin{tikzpicture} x \end{tikzpicture}\caption{T}\begin{tikzpicture}y\end{tikzpicture}"), (2, None)], "k int, t string")
    assert [tuple(r) for r in figures.drawings(tikz, "k", "t").collect()] == [(1, 0, "x", "T"), (1, 1, "y", "")]
    mdx = spark.createDataFrame([("a<TikZDiagram>x</TikZDiagram>b<TikZDiagram>y</TikZDiagram>", ["p.svg"])], "m string, p array<string>")
    assert mdx.select(figures.with_drawings(F.col("m"), F.col("p"))).collect()[0][0] == 'a<Image src="p.svg" alt="" />b<TikZDiagram>y</TikZDiagram>'


def test_half_spaces(spark):
    z = persian.ZWNJ
    df = spark.createDataFrame([(f"a{z}b{z}",), (None,), ("",), (z,)], "t string")
    assert [r[0] for r in df.select(persian.zwnj_positions(F.col("t"))).collect()] == [[1, 3], None, [], [0]]
    one = df.limit(1)
    report = one.select(persian.zwnj_report_exact(F.col("t"), F.lit("ab")).alias("r")).collect()[0]["r"]
    assert tuple(report) == (2, 0, False, [0, 1])
    assert one.select(persian.protected_zwnj(F.col("t"), lambda t: F.regexp_replace(t, f"[{z}]", ""))).collect()[0][0] == f"a{z}b{z}"
    words = spark.createDataFrame([("میرود",), (f"می{z}رود",), ("کتابها",), ("می",)], "t string")
    assert [r[0] for r in words.select(persian.ensure_zwnj(F.col("t"), "می", "ها")).collect()] == [f"می{z}رود", f"می{z}رود", f"کتاب{z}ها", "می"]
    assert spark.createDataFrame([('ۀ ي "x" 1',)], "t string").select(persian.normalise_with(F.col("t"), numerals="keep")).collect()[0][0] == "ۀ ی «x» 1"


def test_bibtex(spark):
    text = '@Article{k1,\n  author = {A, B and C},\n  title = {{The X}},\n  year = "2001",\n  volume = 3\n}\n@book{k2,\n  title = {کتاب}\n}\n@x{open'
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    rows = bibtex.entries(df, "k", "t").collect()
    assert [(r["entry_id"], r["entry_type"], r["author"], r["title"], r["year"], r["volume"], r["language"]) for r in rows] == [("k1", "article", "A, B and C", "The X", "2001", "", "en"), ("k2", "book", "", "کتاب", "", "", "fa")]
    section = bibtex.sections(bibtex.entries(df, "k", "t"), "k", "pos").collect()
    assert section[0]["mdx"] == '## کتاب‌نامه\n\n### منابع فارسی\n\n<span id="ref-k2"></span> *کتاب*.\n\n### منابع انگلیسی\n\n<span id="ref-k1"></span> A, B and C (2001). *The X*.\n'
    cites = bibtex.cited(spark.createDataFrame([(1, r"\cite{k1, no} \citep[p. 2]{k1} \citet{k2}")], "k int, t string"), "k", "t")
    got = {r["pos"]: r["mdx"] for r in bibtex.rendered_citations(cites, bibtex.entries(df, "k", "t"), "k").collect()}
    assert got == {0: "[A, 2001](#ref-k1); [no](#ref-no)", 1: "([A, 2001, p. 2](#ref-k1))", 2: "? [(n.d.)](#ref-k2)"}


def test_converters_and_errors(spark):
    rows = [(1, "# a\n![x](y.png)", "markdown"), (2, r"\textbf{b}", "latex"), (3, "<p>c", "html"), (4, None, None), (5, "", "latex")]
    out = {r["id"]: r for r in convert.to_mdx(spark.createDataFrame(rows, "id bigint, t string, f string"), "id", "t", "f").collect()}
    assert out[1]["mdx"] == '# a\n<Image src="y.png" alt="x" />' and "**b**" in out[2]["mdx"] and out[4]["mdx"] == ""
    assert all(r["status"] == "success" for r in out.values())


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), (None, "x")], "src string, dst string")
    found = {(r["src"], r["dst"]): r["depth"] for r in corpus.reachable(edges, 5).collect()}
    assert found == {(a, b): d for a, bs in {"a": "bca", "b": "cab", "c": "abc"}.items() for d, b in enumerate(bs, 1)}


def test_closure_of_a_long_chain(spark, tmp_path):
    """Pairs of every depth come out, beyond any fixed number of steps."""
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "src string, dst string")
    found = {(r["src"], r["dst"]): r["depth"] for r in corpus.reachable(edges).collect()}
    assert found == {(f"n{i}", f"n{j}"): j - i for i in range(13) for j in range(i + 1, 13)}
    nodes = spark.createDataFrame([(1, i - 1 if i else None, i) for i in range(8)], "doc_id bigint, parent_id bigint, node_id bigint")
    nodes.write.parquet(str(tmp_path / "nodes.parquet"))
    assert {tuple(r) for r in plans.include_closure(spark, str(tmp_path)).collect()} == {(d, 8 - d) for d in range(1, 8)}


def test_inlined(spark):
    rows = [("a/main.tex", r"x \input{one} \include{sub/two.tex} \input{no} y"), ("a/one.tex", r"1\input{sub/two}"), ("a/sub/two.tex", "2"), ("a/self.tex", r"s\input{self}"), ("b/c.md", r"\input{c}"), ("b/n.tex", None)]
    out = dict(corpus.inlined(spark.createDataFrame(rows, "path string, t string"), "path", "t", F.col("path").endswith(".tex")).collect())
    assert out["a/main.tex"] == r"x 12 2 \input{no} y" and out["a/one.tex"] == "12" and out["b/c.md"] == r"\input{c}" and out["b/n.tex"] is None
    assert out["a/self.tex"].startswith("ss") and len(out) == 6
    assert corpus.inlined(spark.createDataFrame(rows[2:3], "path string, t string"), "path", "t").collect()[0]["t"] == "2"


def test_numbered(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(40)], "name string, n bigint")
    got = {(r["name"], r["n"]): r["at"] for r in corpus.numbered(df, ["name"], "n", "at", width=7).collect()}
    assert got == {(k, n): i for k in "ab" for i, n in enumerate(x for x in range(40) if ("a" if x % 3 else "b") == k)}
    names = corpus.collision_names(spark.createDataFrame([("x.png", 2), ("x.png", 1), ("y", 3)], "f string, n bigint"), "f", "n").collect()
    assert {r["n"]: r["target"] for r in names} == {1: "x.png", 2: "x_1.png", 3: "y"}


def test_cross_references(spark):
    rows = [(1, 1, "one", r'\label{eq:a} <CrossRef target="eq-a" /> <CrossRef target="fig-b" type="equation" /> <CrossRef target="no" />'), (1, 2, "two", '<Figure id="fig:b" />'), (2, 1, "other", '<CrossRef target="eq-a" />'), (1, 3, "three", None)]
    out = {r["slug"]: r["t"] for r in corpus.cross_references(spark.createDataFrame(rows, "d int, c int, slug string, t string"), "d", "c", "slug", "t").collect()}
    assert out["one"] == r'\label{eq:a} <CrossRef target="eq-a" /> [fig-b](../two#fig-b) <CrossRef target="no" />' and out["other"] == '<CrossRef target="eq-a" />' and out["three"] is None


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None)], "k bigint, v string, t bigint")
    assert {(r["k"], r["v"]) for r in corpus.latest(df, "k", "t").collect() if r["k"]} >= {(1, "b")}


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# x")
    (tmp_path / "b.tex").write_text(r"\documentclass{article}\begin{document}سلام\end{document}")
    (tmp_path / "c.txt").write_bytes("سلام دنيا".encode("windows-1256"))
    (tmp_path / "i.png").write_bytes(b"x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "d.md").write_text("no")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m/a.md", "one")
        z.writestr("../evil.md", "two")
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as t:
        info = tarfile.TarInfo("t.md")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "t.tar.gz").write_bytes(data.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04broken")
    scanned = {r["path"].rsplit("/", 1)[1]: r for r in engine.scan(spark, str(tmp_path)).collect()}
    assert set(scanned) == {"a.md", "b.tex", "c.txt"}
    assert scanned["a.md"]["encoding"] == "utf-8-sig" and scanned["a.md"]["has_bom"] and scanned["a.md"]["text"] == "# x"
    assert scanned["c.txt"]["encoding"] == "windows-1256" and scanned["c.txt"]["detected"] == "fa"
    members = {r["member"]: r for r in files.expand(files.scan(spark, str(tmp_path)).where("kind = 'archive'")).collect()}
    assert bytes(members["m/a.md"]["content"]) == b"one" and members["../evil.md"]["error"] == "unsafe path"
    assert bytes(members["t.md"]["content"]) == b"abc" and members[None]["error"]
    out = {r["target"]: r for r in engine.run(spark, str(tmp_path)).collect()}
    assert all(r["status"] == "success" for r in out.values()) and len(out) == 3


def test_pages_are_written(spark, tmp_path):
    df = spark.createDataFrame([("x/index.mdx", "سلام"), ("../out.mdx", "no"), (None, "no")], "p string, t string")
    rows = {r["path"]: r["status"] for r in sinks.write_pages(df, str(tmp_path / "site"), "p", "t").collect()}
    assert rows == {"x/index.mdx": "written", "../out.mdx": "unsafe", None: "unsafe"}
    assert (tmp_path / "site/x/index.mdx").read_bytes().startswith(b"\xef\xbb\xbf") and not (tmp_path / "out.mdx").exists()


def test_streams(spark, sf_dir, tmp_path):
    from inkstream.streaming import flows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    query = flows.once(stream).writeStream.format("memory").queryName("once").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == events.count()
    query = flows.hourly(stream, "3650 days").writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hourly").agg({"n": "sum"}).first()[0] == events.count()
