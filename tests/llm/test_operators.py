"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; brute force on small inputs."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstream.llm import format_copies, garbling, languages, lookalikes, markup, mixing, names, packing, queries, shared_spans, tokens

Z = "‌"


def test_format_copies(spark):
    rows = [
        (1, "A  b-c", "X, Y", "2001", None), (2, "a B C", "x y", "(2001)", ""), (3, "abd", "x y", "2001", None), (4, None, "", None, None), (5, "", None, "--", " "),
        (2, "a B C", "x y", "(2001)", ""), (None, "abc", "xy", "2001", None), (6, "Straße", "z", None, None), (7, "STRASSE", "Z", None, None), (8, "x" * 100_000, "", "", ""), (9, "X" * 100_000, "", "", ""),
    ]
    df = spark.createDataFrame(rows, "bib_id bigint, title string, author string, year string, doi string").selectExpr("*", "1 as first_bib_id", "2 as tuple")
    assert {tuple(r) for r in format_copies.later_copies(df, "bib_id").collect()} == {(1, 2), (4, 5), (6, 7), (8, 9)}
    assert {tuple(r) for r in format_copies.copies(df, "bib_id").collect()} == {(1, 2), (3, 1), (4, 2), (6, 2), (8, 2)}
    assert format_copies.later_copies(df.limit(0), "bib_id").count() == 0


@pytest.mark.parametrize(
    ("text", "name", "expected"),
    [
        (None, False, False), ("", False, False), ("plain text – “quoted” m² ½ naïve", False, False), (f"می{Z}رود", False, False), (f"می{Z}{Z}رود", False, True), (f"ab{Z}c", False, True),
        ("soft\u00adhyphen", False, True), ("a\u00a0b", False, True), ("ｗｉｄｅ", False, True), ("ﬁne", False, True), ("cafe\u0301", False, True), ("p\u0430per", False, True), ("слово", False, False), ("α and Ω", False, False),
        ("ﻛتاب", False, True), ("این كتاب است", False, True), ("هذا كتاب في البيت", False, False), ("المساحة ١٤ م", False, False), ("در ١٤ نمونه است", False, True), ("۱٢۳", False, True), ("علي كاظمي", True, True), ("line\nbreak", False, False), ("دوزبانہ", False, True),
    ],
)
def test_lookalikes(text, name, expected):
    assert lookalikes.is_variant(text, name) is expected
    form = lookalikes.one_form(text, name)
    assert not lookalikes.is_variant(form, name) and lookalikes.one_form(form, name) == form


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Ꭺpple", "Apple"), ("Ꮪtop", "Stop"), ("սser", "user"), ("ɡood", "good"), ("ⅰv", "iv"), ("ⲟk", "ok"), ("ꓮll", "All"), ("слoво", "слово"), ("Ωmega", "Ωmega"), ("μm and αβ-test", "μm and αβ-test"),
        ("ab۱2", "ab12"), ("а test", "a test"), ("а слово", "а слово"), ("πρoς", "προς"),
    ],
)
def test_look_alike_letters(text, form):
    assert lookalikes.one_form(text) == form and lookalikes.is_variant(text) is (text != form)


LETTERS = "".join(c for _, _, t in lookalikes.SCRIPTS for c in t) + "лжΩδեᎣⲱ"


@given(st.lists(st.text(alphabet=LETTERS, max_size=4) | st.text(alphabet="abcgoOIl ", max_size=4) | st.sampled_from(["ɡ", "ⅰ", "۱", "٢", "3", "می", "كتاب", "\u200c", "\u00ad", "\u0301", "ﬁ", "ｗ"]), max_size=8).map("".join))
@settings(max_examples=600, deadline=None)
def test_one_form_is_no_variant(text):
    form = lookalikes.one_form(text)
    assert not lookalikes.is_variant(form) and lookalikes.one_form(form) == form


@given(st.text(alphabet="abc éä\u0301\u00adآكي\u200cکگ١۲2\u0430ﬁ", max_size=12))
@settings(max_examples=300, deadline=None)
def test_one_form_is_a_fixed_point(text):
    form = lookalikes.one_form(text)
    assert lookalikes.one_form(form) == form


def test_lookalikes_frame(spark):
    df = spark.createDataFrame([(1, "a\u00a0b", "x"), (1, "a\u00a0b", "x"), (2, None, "x"), (3, "ab", "x"), (4, "b" * 200_000 + "\u200b", "x")], "id bigint, t string, row_id string")
    assert {tuple(r) for r in lookalikes.variants(df, "id", "t", "f").collect()} == {("f", 1), ("f", 4)}
    assert lookalikes.variants(df.limit(0), "id", "t", "f").count() == 0
    assert lookalikes.normalised(df, "id", "t", "f").count() == 5


CORPUS = ["Die Lösungen der Gleichungen über den Wörtern sind schön.", "Les équations décrivent les éléments après les modèles.", "این فرمول که رأس‌ها را تولید می‌کند با فرمول تودرتو تفاوت دارد.", "The author’s “layout” — a matrix — still validates the schema."] * 50


@pytest.fixture(scope="module")
def model(spark):
    return garbling.PairModel.fit(spark.createDataFrame([(t,) for t in [*CORPUS, None, ""]], "t string"), "t")


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1256", "mac_roman", "cp437", "cp1251"])
@pytest.mark.parametrize("text", CORPUS[:4])
def test_garbling_round_trip(model, codec, text):
    """UTF-8 read as another encoding is found, and restored where no byte was lost."""
    back = garbling._codecs()[codec][1]
    broken = "".join(back[b] for b in text.encode("utf-8"))
    found, restored = garbling.Restorer(model).restore(broken)
    assert found
    assert restored == text
    assert not garbling.Restorer(model).restore(text)[0]


def test_garbling_partly_and_twice(model):
    r = garbling.Restorer(model)
    twice = "équations".encode().decode("cp1252").encode().decode("cp1252")
    assert r.restore(f"Les {twice} décrivent") == (True, "Les équations décrivent")
    assert r.restore("Die W�rter")[0] and not r.restore("Use α and Ω, m² or ½")[0]


def test_garbling_of_the_tables(spark, sf_dir):
    """Text nodes that are in order, read in a wrong encoding: nearly all are found, and most come back letter by letter."""
    r = garbling.Restorer(queries._pair_model(spark, sf_dir))
    nodes = spark.read.parquet(f"{sf_dir}/nodes.parquet").where("kind = 'text' and length(content) > 40")
    texts = sorted({t for (t,) in nodes.select("content").collect() if any(c > "\x7f" for c in t) and not (r.suspects([t])[0] and r.restore(t)[0])})
    assert len(texts) > 100
    for codec in garbling.READ_UTF8_AS:
        chars = garbling._codecs()[codec][1]
        broken = ["".join(chars[b] for b in t.encode()) for t in texts]
        results = [r.restore(t) if s else (False, t) for t, s in zip(broken, r.suspects(broken), strict=True)]
        assert sum(f for f, _ in results) >= 0.97 * len(texts) and sum(t == new for t, (_, new) in zip(texts, results, strict=True)) >= 0.94 * len(texts)
    assert r.suspects(["plain \ufffd text", "plain \x85 text", "plain text"]).tolist() == [True, True, False]


def test_garbling_frame(spark, model):
    df = spark.createDataFrame([(1, "Les Ã©quations aprÃ¨s"), (1, "Les Ã©quations aprÃ¨s"), (2, None), (3, ""), (4, "plain " * 50_000)], "id bigint, original string")
    out = garbling.garbled(df, "id", "original", model).collect()
    assert {(r["id"], r["restored"]) for r in out} == {(1, "Les équations après")} and garbling.garbled(df.limit(0), "id", "original", model).count() == 0


@given(st.lists(st.integers(-5, 5), max_size=40))
@settings(max_examples=200, deadline=None)
def test_segments(scores):
    found = garbling.segments(np.array(scores, float))
    assert all(sum(scores[a:b]) > 0 for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    best = max([sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)], default=0)
    assert max([sum(scores[a:b]) for a, b in found], default=0) == max(best, 0)


GIVEN = [("Robert", "Rob", None), ("Margaret", "Peggy", None), ("Katherine", "Kate", None), ("فاطمه", "فاطی", "Fatemeh"), ("ابراهیم", "ابرام", "Ebrahim"), ("Maximilian", "Max", None)]


def test_names(spark):
    same = {
        "r": ["Robert Holanimo", "Holanimo, Robert", "HOLANIMO, Rob", "Dr. Robert M. Holanimo", "R. Holanimo", "Robert Holaniom", "Holanmo, Robert", "Rbert Holanimo"],
        "f": ["فاطمه نامیپوفیچا", "دکتر فاطی نامیپوفیچا", "نامیپوفیچا، فاطمه", "Fatemeh Namipuficha"],
        "m": ["Margaret Holanimo", "Peggy Holanimo", "M. Holanimo"],
        "o": ["Demekudico Centre for Printing Science", "Ctr. for Print. Sci. at Demekudico", "The Demekudico Centre of Printing Science", "Demekduico Centre for Printing Science"],
        "x": ["Katherine Zulobepi"],
    }
    rows = [(f"{k}{i}", n, None, "t") for k, v in same.items() for i, n in enumerate(v)]
    rows += [("e1", "K. Qolobemi", "q7", "t"), ("e2", "Katherine Qolobemi", "q7", "t"), ("z", None, None, "t"), ("z2", "  ", None, "t"), ("r0", "Robert Holanimo", None, "t"), ("z3", "?" * 10_000, None, "t")]
    df = spark.createDataFrame(rows, "mention string, name string, contact string, entity string")
    got = {r["mention"]: r["entity"] for r in names.linked(df, names.GivenNames(GIVEN)).collect()}
    groups = {k: {got[f"{k}{i}"] for i in range(len(v))} for k, v in same.items()}
    assert all(len(g) == 1 for g in groups.values()), groups
    assert len(set.union(*groups.values())) == len(groups) and got["e1"] == got["e2"] and not {"z", "z2", "z3"} & set(got)
    pairs = {tuple(r) for r in names.pairs(names.linked(df, names.GivenNames(GIVEN))).collect()}
    assert ("m0", "m1") in pairs and ("m0", "r0") not in pairs and all(a < b for a, b in pairs)
    assert names.linked(df.limit(0), names.GivenNames(GIVEN)).count() == 0


@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
@settings(max_examples=400, deadline=None)
def test_one_slip(a, b):
    near = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abcd"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abcd"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    assert names.one_slip(a, b) == (b in near)


def test_blocks_lose_no_slip(spark, monkeypatch):
    """Suffix blocks, refined or not, find every pair one slip apart."""
    rng = random.Random(4)
    words = {"".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(40)}
    words |= {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in list(words)[:20] for i in (0, 4, 8)} | {w[:i] + w[i + 1 :] for w in list(words)[:20] for i in (0, 5, 9)}
    words = {w for w in words if len(w) > 7}
    want = {(a, b) for a in words for b in words if a < b and names.one_slip(a, b) and names.common_ratio(a, b) >= names.LEAST_RATIO}
    alike = {(a, b) for a in words for b in words if a < b and names.alike(a, b)}
    df = spark.createDataFrame([(i, "p", w, "g") for i, w in enumerate(sorted(words))], "id bigint, kind string, family string, given string")
    got = {(r["family"], r["other"]) for r in names.near_families(df).collect()}
    assert want <= got <= alike
    monkeypatch.setattr(names, "MOST_IN_BLOCK", 1)
    assert {(r["family"], r["other"]) for r in names.near_families(df).collect()} == got
    between = names.near_families(df.where("family < 'm'"), df.where("family >= 'm'"))
    assert {(r["family"], r["other"]) for r in between.collect()} == {(a, b) for a, b in got if a < "m" <= b}


@pytest.mark.parametrize("most", [200, 1])
def test_blocks_lose_no_slip_in_short_words(spark, monkeypatch, most):
    """Words of every length, with the slip anywhere."""
    monkeypatch.setattr(names, "MOST_IN_BLOCK", most)
    rng = random.Random(8)
    words = {"".join(rng.choice("bdfgklmnprstaeiou") for _ in range(n)) for n in range(2, 13) for _ in range(4)} | {"ahmadi", "ahamdi"}
    for w in sorted(words):
        for i in range(len(w)):
            words |= {w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]}
    words.discard("")
    want = {(a, b) for a in words for b in words if a < b and names.one_slip(a, b) and names.common_ratio(a, b) >= names.LEAST_RATIO}
    alike = {(a, b) for a in words for b in words if a < b and names.alike(a, b)}
    df = spark.createDataFrame([(i, "p", w, "g") for i, w in enumerate(sorted(words))], "id bigint, kind string, family string, given string")
    assert ("ahamdi", "ahmadi") in want and want <= {(r["family"], r["other"]) for r in names.near_families(df).collect()} <= alike


@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
@settings(max_examples=300, deadline=None)
def test_common_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert names.common_length(a, b) == best[-1][-1]
    assert not (names.one_slip(a, b) and names.common_ratio(a, b) >= names.LEAST_RATIO) or names.alike(a, b)
    assert not names.alike(a, b) or names.shortened(a) & names.shortened(b)


def test_organisations(spark):
    """Without a listed word and in any order of words."""
    rows = [("a", "World Health Organization"), ("b", "World Organization Health"), ("c", "Max Planck Society"), ("d", "Planck Max Society"), ("e", "Deep Ocean Watchers"), ("f", "Ocean Watchers Deep"), ("g", "Max Planck")]
    got = dict(names.linked(spark.createDataFrame([(*r, None) for r in rows], "mention string, name string, contact string"), names.GivenNames(GIVEN)).collect())
    assert got["a"] == got["b"] and got["c"] == got["d"] and got["e"] == got["f"] and len(set(got.values())) == 4


def test_table_of_given_names_is_bounded(monkeypatch):
    monkeypatch.setattr(names, "GIVEN_ROWS", 2)
    with pytest.raises(ValueError, match="more than 2 rows"):
        names.GivenNames([("a", None, None)] * 3)


def test_all_links_of_the_tables(spark, sf_dir):
    """Recall and precision of the blocks on the given tables against a comparison of all keys of one kind and given name."""
    from inkstream.llm import queries

    mentions, givens = queries._mentions(spark, sf_dir)
    keys = {k for r in mentions.select("name").distinct().collect() for k in names.keys_of(r[0], givens) if k[2] is not None and k[0] != "w"}
    groups: dict = {}
    for kind, family, given, _ in keys:
        groups.setdefault((kind, given), []).append(family)
    want = {(a, b, *g) for g, families in groups.items() for a in families for b in families if a < b and names.alike(a, b)}
    df = spark.createDataFrame([(i, *k[:3]) for i, k in enumerate(sorted(keys))], "id bigint, kind string, family string, given string")
    keys = sorted(keys)
    got = {(*sorted((r["family"], r["other"])), keys[r["id"]][0], keys[r["id"]][2]) for r in names.near_families(df).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (51, 50), (60, 60)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in names.components(edges).collect()}
    assert {got[i] for i in range(21)} == {0} and got[50] == got[51] == 50


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (None, ""), ("", ""), ("a < b, c > d (snake_case_name) 2 ** 8 (#117) (~3) x[0] (f(x) = {1, 2}) C:\\temp\\new (7$ / 9$) 1.) 2.)) (5 * 3 * 2 = 30)", ""), ("$\\frac{a}{b}$ and $$x_1$$", ""),
        ("<Callout type='x'>\na\n</Callout>\nimport { A } from 'b'", ""), ("<UL><LI>a</UL>", "html"), ("a &amp; b", "html"), ("<!-- c -->", "html"), ("# Head", "markdown"), ("Head\n=====\ntext", "markdown"),
        ("```sh\n<b>x</b> \\textbf{y} [[z]]\n```", "markdown"), ("- a\n- b", "markdown"), ("[a](b) ![c](d)", "markdown"), ("| a |\n|---|\n| b |", "markdown"), ("x[^1]", "markdown"), ("~~x~~", "markdown"),
        ("== H ==\ntext", "wiki"), ("[[a|b]]", "wiki"), ("{{cite|a|b}}", "wiki"), ("'''b'''", "wiki"), ("{| class=x\n|-\n| a || b\n|}", "wiki"), ("[https://a.b c]", "wiki"),
        ("\\section{a}", "latex"), ("a \\\\ b", "latex"), ("\\begin{verbatim}<b># x</b>\\end{verbatim}", "latex"), ("<pre><code># x [[y]]</code></pre>", "html"), ("<b>x</b> \\emph{y} [[z]] **w**", "html latex markdown wiki"),
    ],
)
def test_markup_kinds(text, kinds):
    assert " ".join(sorted(markup.kinds_of(text))) == kinds


def test_clean_text(spark):
    text = "---\ntitle: T\n---\n<h2>A &amp; B</h2><ul><li>x<li>y</ul>\\section{S}\\begin{itemize}\\item i\\end{itemize} [[p|q]] {{t}} **b** $x_1$ ```\n\n```py\n# c\n```\n"
    out = markup.clean(text)
    for part in ("# T", "## A & B", "- x\n- y", "## S", "- i", "q", "b", "$x_1$", "```\n# c\n```"):
        assert part in out
    assert "[[" not in out and "\\" not in out and "<" not in out and "{{" not in out
    assert markup.clean(None) is None and markup.clean("plain text") == "plain text"
    df = spark.createDataFrame([(1, "<b>x</b>"), (1, "<b>x</b>"), (2, None), (3, "a " * 100_000)], "id bigint, markup string")
    assert {tuple(r) for r in markup.markup_kinds(df, "id", "markup", "f").collect()} == {("f", 1, "html")}
    assert markup.cleaned(df, "id", "markup", "f").count() == 4 and markup.markup_kinds(df.limit(0), "id", "markup", "f").count() == 0


def test_languages(spark, sf_dir):
    """Accuracy on samples that the classifier hasn't seen, and defined results on the edges."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/lang_samples.parquet").select("text", "lang").collect()]
    random.Random(1).shuffle(rows)
    model = languages.Classifier.fit([t for t, _ in rows[:150]], [lang for _, lang in rows[:150]])
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows[150:])], "id int, text string, lang string")
    got = languages.document_languages(df, "id", "text", model).join(df, "id")
    assert got.where("detected = lang").count() >= 0.95 * df.count()
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 $$ --"), (4, "qzx wvk jjq xqz")], "id int, detected string")
    assert {r["id"]: r["detected"] for r in languages.document_languages(edge, "id", "detected", model).collect()} == {1: None, 2: None, 3: None, 4: None}
    en, fr = (next(t for t, lang in rows if lang == x and t.endswith(".")) for x in ("en", "fr"))
    mixed = spark.createDataFrame([(1, f"{en} {fr}"), (2, en), (3, None)], "id int, t string")
    assert {(r["id"], r["lang"]) for r in languages.mixed_segments(mixed, "id", "t", model).collect()} == {(1, "en"), (1, "fr")}
    labels = spark.createDataFrame([("EN-us",), ("per",), ("und",), (None,), (" ",), ("es",), ("fr_FR",)], "l string")
    assert [r[0] for r in labels.select(languages.label(labels["l"])).collect()] == ["en", "fa", None, None, None, "es", "fr"]


@given(st.text(alphabet="ab $<>`&;\\.!\n{}", max_size=40))
@settings(max_examples=400, deadline=None)
def test_sentence_spans(text):
    """Each segment stands where its span says, but for the markup inside."""
    spans, segments = languages.sentence_spans(text), languages.sentences(text)
    assert len(spans) == len(segments) and all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    for (a, b), s in zip(spans, segments, strict=True):
        assert b <= len(text) and "".join(languages._MARKUP.sub("", text[a:b]).split()) == "".join(s.split()) or languages._MARKUP.search(text)


def test_language_of_every_entry_and_segment(spark, sf_dir):
    got = queries.p7_languages(spark, sf_dir).collect()
    for field, name, key in (("documents.lang", "documents", "doc_id"), ("bib_entries.language", "bib_entries", "bib_id")):
        assert sorted(r["row_id"] for r in got if r["field"] == field) == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key).collect())
    assert all((r["detected"] is None) == (r["confidence"] == 0) for r in got)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/lang_samples.parquet").select("text", "lang").collect()]
    model = languages.Classifier.fit([t for t, _ in rows], [lang for _, lang in rows])
    en, fr = (next(t for t, lang in rows if lang == x and len(languages.sentences(t)) == 1 and t.endswith(".")) for x in ("en", "fr"))
    df = spark.createDataFrame([(1, f"{en} {fr}\n{en}"), (2, None), (3, "1 + 1")], "id int, t string")
    out = {(r["id"], r["position"]): (r["start"], r["end"], r["lang"]) for r in languages.segment_languages(df, "id", "t", model).collect()}
    n, m = len(en), len(fr)
    assert out == {(1, 0): (0, n, "en"), (1, 1): (n + 1, n + 1 + m, "fr"), (1, 2): (n + m + 2, 2 * n + m + 2, "en"), (3, 0): (0, 5, None)}
    assert queries.p7_segments(spark, sf_dir).groupBy("node_uid", "position").count().where("count > 1").count() == 0


@given(st.lists(st.integers(1, 30), max_size=12), st.integers(30, 40))
@settings(max_examples=150, deadline=None)
def test_packing_and_bound(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    where = packing.best_fit_decreasing(sizes, capacity)
    fill = np.bincount(where, weights=sizes) if len(sizes) else np.array([])
    assert (fill <= capacity).all()
    bound = packing.lower_bound(sizes, capacity)
    assert -(-sizes.sum() // capacity) <= bound <= len(fill) if len(sizes) else bound == 0
    if len(sizes) <= 6:
        assert bound <= _fewest(sorted(sizes.tolist(), reverse=True), capacity)


def _fewest(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                go(i + 1, [b + sizes[i] * (k == j) for k, b in enumerate(bins)])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_pack_frame(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 400)) for i in range(500)] + [(900, 0), (901, None), (902, 5000), (None, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint").selectExpr("*", "'x' as spec_id", "1 as capacity")
    out = packing.pack(df, [(1, 512), (2, 2048)], part_items=60).toPandas()
    for spec, capacity in ((1, 512), (2, 2048)):
        mine = out[out.spec_id == spec]
        assert mine.groupby("container").tokens.sum().max() <= capacity
        assert mine.groupby("doc_id").tokens.sum().to_dict() == {d: t for d, t in rows if t and d is not None}
        assert (mine[mine.piece > 0].doc_id == 902).all()
        assert mine.container.nunique() <= 1.06 * -(-mine.tokens.sum() // capacity) + 1
    assert packing.pack(df.limit(0), [(1, 512)]).count() == 0 and packing.pack(df, []).count() == 0
    specs = [(1, 512), (2, 2048)]
    certificates = packing.certificates(df, specs, 60).toPandas()
    assert (certificates.bound <= certificates.containers).all() and (certificates.certified == (certificates.bound == certificates.containers)).all()
    assert (certificates[certificates.certified].exchanged == 0).all() and certificates["round"].max() > 0
    kept = (certificates.containers - certificates.exchanged).groupby(certificates.spec_id).sum()
    for r in packing.report(packing.pack(df, specs, 60), df, specs).collect():
        # the whole pieces of the text above the capacity have containers of their own
        assert r["containers"] == kept[r["spec_id"]] + 5000 // r["capacity"] and -(-r["tokens"] // r["capacity"]) <= r["least_containers"] <= r["containers"]


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randint(1, 90)) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 9)] + [(1000, "a", None), (1001, None, 5), (1002, "d", 7)]
    targets = [(1, "a", 0.5, 2), (1, "b", 0.3, 3), (1, "c", 0.2, 4), (2, "a", 0.5, 1), (2, "none", 0.5, 1), (3, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    out = mixing.mix(df, targets).toPandas()
    assert set(out.mix_id) == {1, 2} and set(out[out.mix_id == 2].source) == {"a"}
    whole, out = out, out[out.mix_id == 1]
    assert sorted(out.position) == list(range(len(out)))
    share, got, total, block = {"a": 0.5, "b": 0.3, "c": 0.2}, dict.fromkeys("abc", 0), 0, out.tokens.max()
    for r in out.sort_values("position").itertuples():
        got[r.source] += r.tokens
        total += r.tokens
        assert all(abs(got[s] - share[s] * total) <= 2 * block for s in share)
    assert all(abs(got[s] / total - share[s]) < 0.01 for s in share)
    most = whole.groupby(["mix_id", "source", "doc_id"]).size().groupby(["mix_id", "source"]).max().to_dict()
    assert most[1, "a"] <= 2 and most[1, "b"] <= 3 and most[1, "c"] <= 4 and most[2, "a"] == 1
    assert not out.duplicated(["doc_id", "pass"]).any()
    report = {(r["mix_id"], r["source"]): r for r in mixing.shares(mixing.mix(df, targets), targets).collect()}
    assert report[2, "none"]["tokens"] == 0 and abs(report[1, "a"]["actual_share"] - 0.5) < 0.01
    assert mixing.mix(df.limit(0), targets).count() == 0


@pytest.mark.parametrize("rows_of_stretch", [mixing.STRETCH_ROWS, 50])
def test_mix_of_short_and_long_documents(spark, monkeypatch, rows_of_stretch):
    """Every source is within one block of its share at every time, however long the documents of others are and wherever it is cut."""
    monkeypatch.setattr(mixing, "CUTS", 10)
    rng = random.Random(9)
    rows = [(i, "a", 1) for i in range(500)] + [(1000 + i, s, 100) for i, s in enumerate("bcdef")]
    rows += [(2000 + i, "g", 1) for i in range(2000)] + [(5000 + i, s, rng.randint(1, 300)) for s in "hijklm" for i in range(1000 * "hijklm".index(s), 1000 * "hijklm".index(s) + 8)]
    targets = [(1, "a", 0.5, 1)] + [(1, s, 0.1, 1) for s in "bcdef"] + [(2, "g", 0.4, 3)] + [(2, s, 0.1, 3) for s in "hijklm"]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint"), targets, rows_of_stretch).toPandas()
    assert not out.duplicated(["mix_id", "doc_id", "pass"]).any()
    for mix in (1, 2):
        share = {s: w for m, s, w, _ in targets if m == mix}
        mine = out[out.mix_id == mix].sort_values("position")
        assert list(mine.position) == list(range(len(mine))) and set(mine.source) == set(share)
        got, total, block = dict.fromkeys(share, 0), 0, mine.tokens.max()
        for r in mine.itertuples():
            got[r.source] += r.tokens
            total += r.tokens
            assert all(abs(got[s] - share[s] * total) <= block for s in share)


def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (1, "hello world", "s"), (2, None, "s"), (3, "", "s"), (4, "سلام دنیا " * 5000, "s"), (None, "x", "s")], "doc_id bigint, tokens string, source string")
    out = {r["doc_id"]: r["tokens"] for r in tokens.sizes(df, "doc_id", "tokens", also=("source",)).collect()}
    assert out[1] == 2 and out[2] == out[3] == 0 and out[4] > 10_000 and set(out) == {1, 2, 3, 4}


def _brute(texts):
    found = {}
    for d, t in texts.items():
        for i in range(len(t or "") - shared_spans.SPAN + 1):
            found.setdefault(t[i : i + shared_spans.SPAN], set()).add(d)
    return {(a, b) for s in found.values() for a in s for b in s if a < b}


@pytest.mark.parametrize(("most_in_task", "bits"), [(2048, 1 << 28), (1, 1 << 28), (2048, 1)])
def test_shared_spans(spark, monkeypatch, most_in_task, bits):
    """All pairs, classes and amounts of a brute-force comparison, by the common and by the distributed ways."""
    monkeypatch.setattr(shared_spans, "FILTER_BITS", (1 << 20, bits))
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcdefgh آبپ\n") for _ in range(n))
    exact, below, long = fresh(200), fresh(199), fresh(900)
    texts = {1: fresh(300) + exact + fresh(50), 2: exact + fresh(400), 3: fresh(100) + below + fresh(10), 4: below + fresh(90), 5: long, 6: long, 7: fresh(20) + long[:450] + fresh(300), 8: long[440:], 9: None, 10: "", 11: "-" * 700, 12: "-" * 250, 13: exact[1:] + "x" + exact[:199]}
    texts |= {20 + i: exact + fresh(60) for i in range(8)}
    rows = [*texts.items(), (5, long)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in shared_spans.linked_pairs(df, most_in_task).collect()} == _brute(texts)
    amounts = {r["doc_id"]: r["shared_chars"] for r in shared_spans.shared_amounts(df, most_in_task).collect()}
    assert amounts[1] == amounts[2] == 200 and amounts[5] == 900 and amounts[7] == 450 and amounts[12] == 250 and 3 not in amounts
    assert shared_spans.linked_pairs(df.limit(0)).count() == 0
    pairs = _brute(texts)
    classes = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in shared_spans.linked_classes(df, most_in_task).collect()}
    assert {d: n for d, (_, n) in classes.items()} == dict(collections.Counter(d for p in pairs for d in p))
    assert {d: c for d, (c, _) in classes.items()} == {1: 1, 2: 1, 5: 5, 6: 5, 7: 5, 8: 5, 11: 11, 12: 11} | {20 + i: 1 for i in range(8)}


def test_a_block_repeated_in_few_documents(spark):
    """One block stands 100,000 times in two documents that share nothing longer but one passage."""
    rng = random.Random(7)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = fresh(185), fresh(300)
    texts = {1: "".join(f"{line}{i * 7919 % 499:04d}" for i in range(75_000)) + passage, 2: passage + "".join(f"{line}{chr(65 + i % 19)}{chr(65 + i % 23)}x " for i in range(75_000)), 3: line + "-"}
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    index = {r["block"]: r["n"] for r in shared_spans.block_index(df).collect()}
    assert max(index.values()) >= 100_000
    assert {tuple(r) for r in shared_spans.linked_pairs(df).collect()} == {(1, 2)}
    assert {r["doc_id"]: r["shared_chars"] for r in shared_spans.shared_amounts(df).collect()} == {1: 300, 2: 300}


@pytest.mark.parametrize("most_in_task", [2048, 1])
def test_shared_amounts_of_repeated_passages(spark, most_in_task):
    """Every copy of a passage counts, however often a document repeats it."""
    rng = random.Random(6)
    fresh = lambda n: "".join(rng.choice("abcdefgh آبپ\n") for _ in range(n))
    passage, short = fresh(1000), fresh(150)
    texts = {1: fresh(80) + passage + fresh(300) + passage + fresh(250) + passage + fresh(40), 2: fresh(30) + passage, 3: short * 8 + fresh(100), 4: fresh(90) + short * 3, 5: "-" * 900 + passage + "-" * 500, 6: "-" * 300}
    windows: dict[str, set[int]] = {}
    for d, t in texts.items():
        for i in range(len(t) - shared_spans.SPAN + 1):
            windows.setdefault(t[i : i + shared_spans.SPAN], set()).add(d)
    want = {}
    for d, t in texts.items():
        mask = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - shared_spans.SPAN + 1):
            if len(windows[t[i : i + shared_spans.SPAN]]) > 1:
                mask[i : i + shared_spans.SPAN] = True
        want[d] = (int(mask.sum()), int((np.diff(mask.astype(int)) == -1).sum()))
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    got = shared_spans.shared_amounts(df, most_in_task).collect()
    assert {r["doc_id"]: r["shared_chars"] for r in got} == {d: n for d, (n, _) in want.items()}
    assert {r["doc_id"]: r["n_spans"] for r in got if r["doc_id"] < 3} == {d: s for d, (_, s) in want.items() if d < 3}


@given(st.text("ab", min_size=200, max_size=420), st.integers(0, 100))
@settings(max_examples=60, deadline=None)
def test_every_span_holds_the_same_block(text, cut):
    """A block of any 200 characters is chosen alike wherever they occur."""
    span = text[:200]
    a = {text[p : p + shared_spans.BLOCK] for p in shared_spans.places(shared_spans.points(text)).tolist() if p + shared_spans.BLOCK <= 200}
    b = {span[p : p + shared_spans.BLOCK] for p in shared_spans.places(shared_spans.points(span)).tolist()}
    assert b and b <= a


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("1. one\n2. two\n* x\n** b\n*** c", "1. one\n2. two\n- x\n  - b\n    - c"), ("<ol><li>a<li>b<ul><li>c</ul></ol>", "1. a\n2. b\n\n  - c"),
        ("\\begin{enumerate}\\item a\n\\item b\\begin{itemize}\\item c\\end{itemize}\\end{enumerate}", "1. a\n\n2. b\n\n  - c"), ("\\textbf{x {y {z {w {q}}}}} end", "x y z w q end"),
        ("\\section{A \\emph{b {c}}} see~\\cite{x} \\href{http://u}{la\\textbf{bel}} \\newcommand{\\R}[1]{x} ok \\{set\\}", "## A b c\n\n see label ok {set}"),
        ("\\textbf{" * 50_000 + "x" + "}" * 50_000, "x"), ("a } \\emph{b", "a } {b"),
    ],
)
def test_clean_keeps_lists_and_opens_groups(text, plain):
    assert markup.clean(text) == plain


def test_clean_keeps_code_and_formulas(spark, sf_dir):
    """Bodies of code and formula environments come out as they are, fenced or between dollar signs."""
    assert markup.clean_body("lstlisting", "  <b>x</b>\n# y\n") == "```\n  <b>x</b>\n# y\n```" and markup.clean_body("minted", "```\na") == "````\n```\na\n````"
    assert markup.clean_body("align", " a &= b \\\\ c ") == "$$a &= b \\\\ c$$" and markup.clean_body("quote", "<b>x</b>") == "x" and markup.clean_body("verbatim", None) is None
    nodes = spark.read.parquet(f"{sf_dir}/nodes.parquet").where("kind = 'environment' and body is not null")
    got = queries.p6_clean(spark, sf_dir).where("field = 'nodes.body' and text is not null")
    assert got.count() == nodes.count()
    code = nodes.where("name in ('verbatim', 'lstlisting', 'minted')").select("node_uid").distinct()
    out = got.join(code, got["row_id"] == code["node_uid"]).collect()
    assert out and all(r["text"].startswith("```\n") and r["text"].endswith("\n```") for r in out)
