"""Markup residue in text documents (problem 6).

A value is scanned once for what must stay as it is (code blocks, code spans,
formulas, component tags); the rest is matched against the syntax of HTML,
Markdown, wiki and LaTeX. Clean text keeps headings, lists, code blocks and
formulas in one plain notation.

The method named for this problem (differencing pages with near paths) deletes
lines that neighbouring pages share; measured on these tables, they are fences,
formula marks and document heads, which have to stay, and no kind of markup is
told by them. So this scanner does the work. The figures are in the README.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
#: Environments whose bodies are code or formulas, not markup.
OPAQUE_ENVIRONMENTS = ("verbatim", "lstlisting", "minted", "equation", "align")
#: HTML elements.
HTML_TAGS = frozenset(
    "a abbr address article aside audio b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure "
    "font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol optgroup option p param picture pre q "
    "ruby s samp script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form header hr main nav ol p section summary table tbody tfoot thead tr ul".split())

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_PRE = re.compile(r"<pre\b[^>]*>(.*?)</pre\s*>", re.S | re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted|equation|align)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
_SPAN = re.compile(r"(?<!`)`(?!`)([^`\n]+)`(?!`)")
_FORMULA = re.compile(r"(?<!\\)\$\$(?!\$).+?\$\$|(?<![\\$])\$(?![\s$])[^$\n]*?(?<![\s\\])\$(?!\d)", re.S)
_LATEX_FORMULA = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_COMPONENT = re.compile(r"</?[A-Z](?![A-Z]*[\s>/])[\w.]*(?:\s[^<>]*)?/?>|^(?:import|export)\s[^\n]*$", re.M)
_PATH = re.compile(r"\b[A-Za-z]:(?:\\[\w.\-]+)+\\?|\\\\[\w.\-]+(?:\\[\w.\-]+)+")

_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>", re.S | re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*|/)?)>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_COMMAND = re.compile(r"\\(?:([A-Za-z]+)\*?|[\\/,;:!%&#_{}$~^\"'`=.\-@ ])")

_MARKDOWN = re.compile(
    r"^[ ]{0,3}#{1,6}[ \t]+\S"  # heading
    r"|^(?=.*\w)(?!\s*[|>\-*+#]).+\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$"  # underlined heading
    r"|^[ \t]*[-*+][ \t]+(?:\[[ xX]\][ \t]+)?\S"  # list
    r"|^[ \t]*\d{1,3}[.)][ \t]+\S"
    r"|^[ ]{0,3}>[ \t]*\S"  # quotation
    r"|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*(?:\|?:?-*:?)*[ \t]*$"  # table rule
    r"|^(?:-{3,}|\*{3,}|_{3,})[ \t]*$"  # rule
    r"|!?\[[^\[\]\n]*\]\((?!\()[^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)"  # link, image
    r"|!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^\[[^\[\]\n]+\]:[ \t]*\S"
    r"|\[\^[^\[\]\s]+\]"  # footnote
    r"|(?<![\w*\\])\*\*(?=[^\s*])[^\n]*?(?<=[^\s*])\*\*(?![\w*])|(?<![\w*\\])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])"
    r"|(?<![\w\\])__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?!\w)|(?<![\w\\])_(?=[^\s_])[^_\n]*(?<=[^\s_])_(?!\w)"
    r"|~~(?=\S)[^~\n]+(?<=\S)~~"
    r"|<https?://[^\s<>]+>",
    re.M,
)
_WIKI = re.compile(
    r"^={2,6}[ \t]*[^=\s][^=\n]*?[ \t]*={2,6}[ \t]*$"  # heading
    r"|\[\[[^\[\]\n]+\]\]|\[https?://[^\s\[\]]+(?:[ \t][^\[\]\n]*)?\](?!\()"  # link
    r"|\{\{[^{}\n]+\}\}"  # template
    r"|^\{\|.*$|^\|-(?:[ \t]+[^|\n]*)?$|^\|\}"  # table
    r"|(?<!')'{2,5}(?=[^\s'])[^'`\n]*(?<=[^\s'])'{2,5}(?!')"  # emphasis
    r"|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|^#REDIRECT\b",
    re.M,
)


def _is_html(tag: str) -> bool:
    return tag.lower() in HTML_TAGS and (tag.islower() or tag.isupper() or len(tag) == 1 or (tag[1:].isdigit()))


def _mask(text: str) -> tuple[str, set[str]]:
    """``text`` without what must not be looked into, and the kinds that its removal shows."""
    kinds: set[str] = set()
    if "```" in text or "~~~" in text:
        text, n = _FENCE.subn("\n", text)
        if n:
            kinds.add("markdown")
    if "\\begin{" in text:
        text, n = _VERBATIM.subn(" ", text)
        if n:
            kinds.add("latex")
    if "<" in text:
        text, n = _PRE.subn(" ", text)
        if n:
            kinds.add("html")
    if "`" in text:
        text, n = _SPAN.subn(" x ", text)
        if n:
            kinds.add("markdown")
    if "$" in text:
        text = _FORMULA.sub(" x ", text)
    if "\\" in text:
        text = _PATH.sub(" x ", text)
        text, n = _LATEX_FORMULA.subn(" x ", text)
        if n:
            kinds.add("latex")
    if "<" in text or "import " in text or "export " in text:
        text = _COMPONENT.sub("", text)
    return text, kinds


def kinds_of(text: str | None) -> set[str]:
    """The kinds of markup in ``text``. Null, empty and blank texts have none."""
    if not text or not text.strip():
        return set()
    text, kinds = _mask(text)
    if "<" in text and (_COMMENT.search(text) or any(_is_html(m.group(2)) for m in _TAG.finditer(text))):
        kinds.add("html")
    if "&" in text and any(html.unescape(m.group()) != m.group() for m in _ENTITY.finditer(text)):
        kinds.add("html")
    if "\\" in text and _COMMAND.search(text):
        kinds.add("latex")
    if _WIKI.search(text):
        kinds.add("wiki")
        text = _WIKI.sub(" x ", text)
    if "<" in text:
        text = _TAG.sub(" ", _COMMENT.sub(" ", text))
    if "markdown" not in kinds and _MARKDOWN.search(text):
        kinds.add("markdown")
    return kinds


def clean(text: str | None) -> str | None:
    """``text`` as plain text: headings as "# ", items as "- " or "1. ", code blocks fenced, formulas between dollar signs.

    Null stays null; a text without markup is only trimmed.
    """
    if text is None:
        return None
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x02{len(kept) - 1}\x03"

    text = text.replace("\x02", "").replace("\x03", "").replace("\r\n", "\n")
    text = re.sub(r"\A---\n(.*?)\n---[ \t]*(?:\n|\Z)", lambda m: _front(m.group(1)), text, flags=re.S)
    text = _FENCE.sub(lambda m: "\n" + keep(f"```\n{m.group(2).rstrip()}\n```") + "\n", text)
    text = _VERBATIM.sub(lambda m: "\n" + keep(f"$${m.group(3).strip()}$$" if m.group(1) in ("equation", "align") else f"```\n{m.group(3).strip()}\n```") + "\n", text)
    text = _PRE.sub(lambda m: "\n" + keep(f"```\n{html.unescape(_TAG.sub('', m.group(1))).strip()}\n```") + "\n", text)
    text = _SPAN.sub(lambda m: keep(m.group(1)), text)
    text = _FORMULA.sub(lambda m: keep(m.group()), text)
    text = _PATH.sub(lambda m: keep(m.group()), text)
    text = _LATEX_FORMULA.sub(lambda m: keep(f"$${(m.group(1) or m.group(2)).strip()}$$" if m.group(1) else f"${m.group(2).strip()}$"), text)
    text = _COMPONENT.sub("", text)
    text = _from_html(text)
    text = _from_latex(text) if "\\" in text else text
    text = _from_wiki(text)
    text = _from_markdown(text)
    text = re.sub(r"\x02(\d+)\x03", lambda m: kept[int(m.group(1))], text)
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def clean_body(name: str | None, body: str | None) -> str | None:
    """The clean text of an environment's body: code as a fenced block, a formula as a display formula, the rest by :func:`clean`."""
    bare = (name or "").removesuffix("*")
    if body is None or bare not in OPAQUE_ENVIRONMENTS:
        return clean(body)
    if bare in ("equation", "align"):
        return f"$${body.strip()}$$"
    # the fence is longer than any in the code
    fence = "`" * max([3, *(len(m) + 1 for m in re.findall(r"`{3,}", body))])
    return f"{fence}\n{body.strip(chr(10)).rstrip()}\n{fence}"


def _front(block: str) -> str:
    title = re.search(r"^title:[ \t]*(.+)$", block, re.M)
    return f"# {title.group(1).strip()}\n\n" if title else ""


def _bullet(lists: list[list]) -> str:
    """The mark of the next item of the innermost of ``lists`` (ordered, number of the last item), indented by depth."""
    if not lists:
        return "- "
    lists[-1][1] += 1
    return "  " * (len(lists) - 1) + (f"{lists[-1][1]}. " if lists[-1][0] else "- ")


def _from_html(text: str) -> str:
    if "<" in text:
        text = _COMMENT.sub("", text)
        lists: list[list] = []

        def tag(m: re.Match) -> str:
            name = m.group(2)
            if not _is_html(name):
                return m.group()
            name = name.lower()
            if name in ("ul", "ol"):
                if not m.group(1):
                    lists.append([name == "ol", 0])
                elif lists:
                    lists.pop()
                return "\n"
            if name == "br":
                return "\n"
            if name[0] == "h" and name[1:].isdigit():
                return "\n\n" if m.group(1) else "\n\n" + "#" * int(name[1]) + " "
            if name == "li":
                return "" if m.group(1) else "\n" + _bullet(lists)
            if name in ("td", "th"):
                return " | " if m.group(1) else ""
            if name == "img":
                alt = re.search(r"alt\s*=\s*[\"']([^\"']*)", m.group(3))
                return alt.group(1) if alt else ""
            return "\n" if name in BLOCK_TAGS else ""

        text = _TAG.sub(tag, text)
    return _ENTITY.sub(lambda m: html.unescape(m.group()), text) if "&" in text else text


#: LaTeX headings and their depths, and commands that leave nothing.
_DEPTHS = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_DROPPED = frozenset("label ref eqref pageref documentclass usepackage includegraphics input include bibliography bibliographystyle newcommand renewcommand vspace hspace pagestyle color".split())
_LISTS = re.compile(r"\\begin\{(enumerate|itemize|description)\}(?:\[[^\]\n]*\])?|\\end\{(enumerate|itemize|description)\}|\\item(?![A-Za-z])(?:\[([^\]\n]*)\])?\s*")
_GROUP = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])*(?=\{)|\\[^A-Za-z]|[{}]", re.S)
_BETWEEN = re.compile(r"(?:\[[^\]\n]*\])*(?=\{)")


def _list_marks(text: str) -> str:
    lists: list[list] = []

    def mark(m: re.Match) -> str:
        if m.group(1):
            lists.append([m.group(1) == "enumerate", 0])
        elif m.group(2):
            del lists[-1:]
        else:
            return "\n" + _bullet(lists) + (m.group(3) + " " if m.group(3) else "")
        return "\n"

    return _LISTS.sub(mark, text)


def _open_groups(text: str) -> str:
    """Commands replaced by their arguments and groups by what is in them, however deep, in one scan with a stack."""
    out: list[str] = []
    frames: list[tuple[str, int]] = []  # command, place of its opening in ``out``
    waiting, at = ("", "{"), 0
    while m := _GROUP.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m.group(1):
            waiting = (m.group(1), m.group() + "{")
        elif m.group() == "{":
            frames.append((waiting[0], len(out)))
            out.append(waiting[1])  # stays if the group is never closed
            waiting = ("", "{")
        elif m.group() != "}" or not frames:
            out.append(m.group())
        else:
            name, start = frames.pop()
            out[start] = ""
            if name in _DROPPED or name.startswith("cite"):
                del out[start:]
                if out and out[-1].endswith("~"):
                    out[-1] = out[-1][:-1]
                if more := _BETWEEN.match(text, at):
                    waiting, at = (name, "{"), more.end()
            elif name == "href" and text[at : at + 1] == "{":
                del out[start:]
            elif name in _DEPTHS:
                out[start] = f"\n\n{'#' * _DEPTHS[name]} "
                out.append("\n\n")
    out.append(text[at:])
    return "".join(out)


def _from_latex(text: str) -> str:
    text = _list_marks(text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*", "\n", text)
    text = _open_groups(text)
    text = re.sub(r"[ \t]*&[ \t]*", " | ", re.sub(r"\\\\(?:\[[^\]\n]*\])?", "\n", text)) if "\\\\" in text else text
    text = re.sub(r"\\([%&#_{}$])", r"\1", text)
    text = re.sub(r"\\ldots|\\dots", "…", text)
    text = re.sub(r"\\[A-Za-z]+\*?[ \t]?|\\[/,;:!~^\"'`=.\-@]", "", text)
    return text.replace("``", "“").replace("~", " ")


def _from_wiki(text: str) -> str:
    if "[[" in text:
        text = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|رده|تصنيف):[^\[\]]*\]\]", "", text)
        text = re.sub(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]+)\]\]", r"\1", text)
    text = re.sub(r"\[https?://[^\s\[\]]+(?:[ \t]([^\[\]\n]*))?\](?!\()", lambda m: m.group(1) or "", text)
    text = re.sub(r"\{\{[^{}\n]+\}\}", "", text)
    text = re.sub(r"^(={2,6})[ \t]*([^=\s][^=\n]*?)[ \t]*={2,6}[ \t]*$", lambda m: f"{'#' * len(m.group(1))} {m.group(2)}", text, flags=re.M)
    # items of depth two and more; what begins bold text has no space behind its stars
    text = re.sub(r"^(\*{2,6})[ \t]+(?=\S)", lambda m: "  " * (len(m.group(1)) - 1) + "- ", text, flags=re.M)
    if "{|" in text:
        text = re.sub(r"^\{\|.*$|^\|-(?:[ \t]+[^|\n]*)?$|^\|\}.*$", "", text, flags=re.M)
        text = re.sub(r"^[|!][ \t]*(.*)$", lambda m: re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", " | ", m.group(1)), text, flags=re.M)
    return re.sub(r"(?<!')'{2,5}(?=[^\s'])([^'`\n]*)(?<=[^\s'])'{2,5}(?!')", r"\1", text)


def _from_markdown(text: str) -> str:
    text = re.sub(r"^(?=.*\w)(?!\s*[|>\-*+#])(.+)\n[ ]{0,3}(={3,}|-{3,})[ \t]*$", lambda m: f"{'#' if m.group(2)[0] == '=' else '##'} {m.group(1)}", text, flags=re.M)
    text = re.sub(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*\n?", "", text, flags=re.M)
    text = re.sub(r"^[ \t]*\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", text, flags=re.M)
    text = re.sub(r"^[ ]{0,3}>[ \t]?", "", text, flags=re.M)
    text = re.sub(r"^([ \t]*)(?:[*+-]|(\d{1,3})[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", lambda m: m.group(1) + (f"{m.group(2)}. " if m.group(2) else "- "), text, flags=re.M)
    text = re.sub(r"!?\[([^\[\]\n]*)\]\((?!\()[^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"^\[\^[^\[\]\s]+\]:[ \t]*", "", text, flags=re.M)
    text = re.sub(r"\[\^[^\[\]\s]+\]", "", text)
    for mark in (r"\*\*", r"\*", "__", "_", "~~"):
        c = mark[-1]
        text = re.sub(rf"(?<![\w{re.escape(c)}\\]){mark}(?=[^\s{re.escape(c)}])([^\n]*?)(?<=[^\s{re.escape(c)}]){mark}(?![\w{re.escape(c)}])", r"\1", text)
    return text


def markup_kinds(df: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """(field, row_id, markup): the kinds of markup in each row's ``text``. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds = [], []
            for i, value in enumerate(batch.column(1)):
                for kind in sorted(kinds_of(value.as_py())):
                    rows.append(i)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string())], names=["row_id", "markup"])

    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, "row_id bigint, markup string").distinct().select(F.lit(field).alias("field"), "row_id", "markup")


def cleaned(df: DataFrame, key: str, text: str, field: str, environment: str | None = None) -> DataFrame:
    """(field, row_id, text): each row's clean text. One narrow pass; repeated rows stay repeated.

    ``environment`` is the column with the name of the environment that the text is the body of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean_body(n.as_py(), v.as_py()) for v, n in zip(batch.column(1), batch.column(2), strict=True)], pa.string())], names=["row_id", "text"])

    name = F.col(environment).cast("string") if environment else F.lit(None).cast("string")
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).cast("string").alias("__text"), name.alias("__name"))
    return rows.mapInArrow(run, "row_id bigint, text string").select(F.lit(field).alias("field"), "row_id", "text")
