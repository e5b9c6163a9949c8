"""HTML as MDX (V12-V16): a tolerant reader over the standard parser, and rules by element.

Elements open beyond DEEPEST levels are read as siblings, as browsers do, so
depth is bounded whatever the input.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from inkstream.operators.latex import yaml_scalar

#: Levels of elements that are kept.
DEEPEST = 200
#: Elements by what becomes of them.
DROPPED = frozenset("script style noscript template head input select textarea button option".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~", "cite": "*", "var": "`", "samp": "`"}
KEPT = frozenset("ins mark kbd sup sub address".split())
BLOCKS = frozenset("section article main aside header footer nav fieldset".split())
VOID = frozenset("br hr img input meta link source track wbr area base col embed".split())
#: Opening tags and the open elements that they close.
SIBLINGS = {"li": ("li",), "p": ("p",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: Attributes that hold the source of a formula, and classes of what shows one.
SOURCES = ("data-latex", "data-tex", "data-math", "data-content")
_MATH_CLASS = re.compile(r"katex|mathjax|math", re.I)


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if isinstance(c, str) or c.tag != "!")

    def all(self, *tags: str) -> list[Element]:
        """The elements of ``tags`` below this one, in document order."""
        out = []
        for c in self.children:
            if isinstance(c, Element):
                out += ([c] if c.tag in tags else []) + c.all(*tags)
        return out

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name) or default


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while len(self.open) > 1 and self.open[-1].tag in SIBLINGS.get(tag, ()):
            self.open.pop()
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def handle_comment(self, data: str) -> None:
        if data.strip():
            self.open[-1].children.append(Element("!", {}, [data.strip()]))


def read(text: str) -> Element:
    """The tree of ``text``; broken markup never fails."""
    reader = _Reader()
    reader.feed(text)
    reader.close()
    return reader.root


def _display(e: Element, tex: str) -> bool:
    return bool(re.search(r"display|block", e.get("class") + e.get("display"), re.I)) or e.tag in ("div", "p") or "\n" in tex or len(tex) > 80


def formula(e: Element) -> str:
    """The formula that an element shows, from its annotation, its attributes or its text."""
    note = next((a for a in e.all("annotation") if "tex" in a.get("encoding").lower()), None)
    if e.tag == "script":
        tex = e.text().strip()
        display = "display" in e.get("type").lower() or "\n" in tex or len(tex) > 80
    elif e.tag == "math":
        tex = (note.text() if note else "".join(e.text().split())).strip()
        display = e.get("display") == "block"
    else:
        tex = note.text().strip() if note else next((e.get(a) for a in SOURCES if e.get(a)), e.get("aria-label") or e.text().strip())
        display = _display(e, tex)
    if not tex:
        return ""
    return f"\n\n$$\n{tex}\n$$\n\n" if display else f"${tex}$"


def _props(e: Element, sizes: tuple[str, ...], texts: tuple[str, ...], flags: tuple[tuple[str, str], ...]) -> str:
    out = "".join(f" {n}={{{e.get(n)}}}" for n in sizes if e.get(n))
    out += "".join(f' {n}="{e.get(n)}"' for n in texts if e.get(n))
    return out + "".join(f" {to}={{true}}" for n, to in flags if n in e.attrs)


def media(e: Element) -> str:
    """Images, video, audio and embedded pages as components."""
    source = e.get("src") or next((s.get("src") for s in e.all("source") if s.get("src")), "")
    if e.tag == "img":
        return f'<Image src="{source}" alt="{e.get("alt")}"{_props(e, ("width", "height"), ("title",), ())} />'
    if e.tag == "video":
        return f'\n\n<Video src="{source}"{_props(e, ("width", "height"), ("poster",), (("controls", "controls"), ("autoplay", "autoPlay"), ("loop", "loop"), ("muted", "muted")))} />\n\n'
    if e.tag == "audio":
        return f'\n\n<Audio src="{source}"{_props(e, (), (), (("controls", "controls"), ("loop", "loop"), ("muted", "muted"), ("autoplay", "autoPlay")))} />\n\n'
    return f'\n\n<Embed src="{source}" title="{e.get("title", "Embedded content")}"{_props(e, ("width", "height"), ("allow",), ())} />\n\n'


class _Writer:
    def inner(self, e: Element) -> str:
        return "".join(self.node(c) for c in e.children)

    def node(self, e: Element | str) -> str:
        if isinstance(e, str):
            return re.sub(r"[ \t\r]*\n[ \t\r]*", "\n", re.sub(r"[ \t]+", " ", e)) if e.strip() or "\n" not in e else "\n"
        rule = getattr(self, f"_{e.tag}", None)
        if e.tag == "!":
            return f"\n{{/* {e.text()} */}}\n"
        if e.tag == "script" and re.search("math|latex", e.get("type").lower()):
            return formula(e)
        if e.tag in DROPPED:
            return ""
        if rule:
            return rule(e)
        if re.fullmatch("h[1-6]", e.tag):
            return f"\n\n{'#' * int(e.tag[1])} {' '.join(self.inner(e).split())}{f' {{#{e.get("id")}}}' if e.get('id') else ''}\n\n"
        if e.tag in MARKS:
            body = self.inner(e).strip()
            return f"{MARKS[e.tag]}{body}{MARKS[e.tag]}" if body else ""
        if e.tag in KEPT:
            return f"<{e.tag}>{self.inner(e)}</{e.tag}>"
        if e.tag in BLOCKS:
            return f"\n\n{self.inner(e).strip()}\n\n"
        if e.tag in ("img", "video", "audio", "iframe"):
            return media(e)
        if e.tag in ("progress", "meter"):
            least = "" if e.tag == "progress" else f" min={{{e.get('min', '0')}}}"
            return f"<{e.tag} value={{{e.get('value', '0')}}}{least} max={{{e.get('max', '100')}}}>{e.text().strip() or e.get('value')}</{e.tag}>"
        return self.inner(e)

    def _p(self, e: Element) -> str:
        body = self.inner(e).strip()
        return f"\n\n{body}\n\n" if body else ""

    def _br(self, e: Element) -> str:
        return "\\\n"

    def _title(self, e: Element) -> str:
        return ""

    def _hr(self, e: Element) -> str:
        return "\n\n---\n\n"

    def _a(self, e: Element) -> str:
        body, href = self.inner(e), e.get("href")
        if not body.strip():
            return href
        return f'[{body}]({href} "{e.get("title")}")' if e.get("title") else f"[{body}]({href})"

    def _q(self, e: Element) -> str:
        return f'"{self.inner(e)}"'

    def _abbr(self, e: Element) -> str:
        return f'<abbr title="{e.get("title")}">{self.inner(e)}</abbr>' if e.get("title") else f"<abbr>{self.inner(e)}</abbr>"

    def _time(self, e: Element) -> str:
        return f'<time dateTime="{e.get("datetime")}">{self.inner(e)}</time>' if e.get("datetime") else f"<time>{self.inner(e)}</time>"

    def _code(self, e: Element) -> str:
        return f"`{e.text()}`"

    def _pre(self, e: Element) -> str:
        code = next(iter(e.all("code")), e)
        language = re.search(r"(?:language|lang)-([\w+#-]+)", code.get("class") + " " + e.get("class"))
        return f"\n\n```{language.group(1) if language else ''}\n{e.text().strip(chr(10)).rstrip()}\n```\n\n"

    def _list(self, e: Element) -> str:
        lines, n = [], int(e.get("start", "1")) if e.get("start", "1").isdigit() else 1
        for item in (c for c in e.children if isinstance(c, Element) and c.tag not in DROPPED):
            body = re.sub(r"\n{2,}", "\n", self.node(item) if item.tag != "li" else self.inner(item)).strip()
            mark = f"{n}. " if e.tag == "ol" else "- "
            lines.append(mark + body.replace("\n", "\n  "))
            n += 1
        return "\n\n" + "\n".join(lines) + "\n\n" if lines else ""

    _ul = _ol = _list

    def _dl(self, e: Element) -> str:
        lines = []
        for c in (c for c in e.all("dt", "dd")):
            body = self.inner(c).strip()
            lines.append(f"\n**{body}**" if c.tag == "dt" else f": {body}")
        return "\n\n" + "\n".join(lines).strip() + "\n\n"

    def _blockquote(self, e: Element) -> str:
        body = re.sub(r"\n{3,}", "\n\n", self.inner(e).strip())
        return "\n\n" + "\n".join(f"> {line}" if line.strip() else ">" for line in body.split("\n")) + "\n\n"

    def _figure(self, e: Element) -> str:
        caption = next((self.inner(c).strip() for c in e.all("figcaption")), "")
        picture = next(iter(e.all("img")), None)
        if picture is None:
            return f"\n\n{self.inner(e).strip()}\n\n"
        return f'\n\n<Figure src="{picture.get("src")}"{f' alt="{picture.get("alt")}"' if picture.get("alt") else ""}{f' caption="{caption}"' if caption else ""} />\n\n'

    def _details(self, e: Element) -> str:
        title = next((self.inner(s).strip() for s in e.children if isinstance(s, Element) and s.tag == "summary"), "")
        body = "".join(self.node(c) for c in e.children if isinstance(c, str) or c.tag != "summary").strip()
        return f"\n\n<Details{f' title="{title}"' if title else ''}>\n\n{body}\n\n</Details>\n\n"

    def _summary(self, e: Element) -> str:
        return f"**{self.inner(e).strip()}**"

    def _form(self, e: Element) -> str:
        fields = [f"{c.get('name')}({c.get('type', c.tag)})" for c in e.all("input", "select", "textarea") if c.get("name")]
        return f"\n\n{{/* Form[action={e.get('action')}, method={e.get('method', 'get').upper()}, fields={', '.join(fields) or 'no named fields'}] */}}\n\n"

    def _math(self, e: Element) -> str:
        return formula(e)

    def _span(self, e: Element) -> str:
        return formula(e) if _MATH_CLASS.search(e.get("class")) or any(e.get(a) for a in SOURCES[:3]) else self.inner(e)

    def _div(self, e: Element) -> str:
        if e.get("dir") or e.get("lang"):
            attributes = "".join(f' {n}="{e.get(n)}"' for n in ("dir", "lang") if e.get(n))
            return f"\n\n<div{attributes}>\n\n{self.inner(e).strip()}\n\n</div>\n\n"
        if _MATH_CLASS.search(e.get("class")):
            return formula(e)
        if "mermaid" in e.get("class").lower():
            return f"\n\n```mermaid\n{e.text().strip()}\n```\n\n"
        body = self.inner(e).strip()
        return f"\n\n{body}\n\n" if body else ""

    def _svg(self, e: Element) -> str:
        # named by its content: the same picture has the same name everywhere
        return f'<Image src="svg-{hashlib.md5(markup(e).encode()).hexdigest()[:8]}.svg" alt="{next((t.text().strip() for t in e.all("title")), "")}" />'

    def _table(self, e: Element) -> str:
        rows = [[c for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for r in e.all("tr")]
        rows = [r for r in rows if r]
        caption = next((self.inner(c).strip() for c in e.all("caption")), "")
        if not rows:
            return ""
        cell = lambda c: " ".join(self.inner(c).split())
        if any(c.get("colspan", "1") != "1" or c.get("rowspan", "1") != "1" or c.all("table") for r in rows for c in r):
            return self._spanned(rows, caption)
        width = max(map(len, rows))
        lines = [[cell(c).replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
        if not any(c.tag == "th" for c in rows[0]):
            lines.insert(0, [""] * width)
        text = ["| " + " | ".join(r) + " |" for r in lines]
        text.insert(1, "| " + " | ".join("-" * max(len(h), 3) for h in lines[0]) + " |")
        return "\n\n" + (f"**{caption}**\n\n" if caption else "") + "\n".join(text) + "\n\n"

    def _spanned(self, rows: list[list[Element]], caption: str) -> str:
        out = ["<table>"] + ([f"  <caption>{caption}</caption>"] if caption else [])
        for row in rows:
            out.append("  <tr>")
            for c in row:
                spans = "".join(f" {jsx}={{{c.get(n)}}}" for n, jsx in (("colspan", "colSpan"), ("rowspan", "rowSpan")) if c.get(n, "1") != "1")
                out.append(f"    <{c.tag}{spans}>{' '.join(self.inner(c).split())}</{c.tag}>")
            out.append("  </tr>")
        return "\n\n" + "\n".join([*out, "</table>"]) + "\n\n"


def markup(e: Element) -> str:
    """An element as it is written, attributes in their order."""
    inside = "".join(c if isinstance(c, str) else markup(c) for c in e.children)
    return f"<{e.tag}{''.join(f' {k}="{v}"' for k, v in e.attrs.items())}>{inside}</{e.tag}>"


def pictures(root: Element) -> dict[str, str]:
    """File name and markup of each inline picture."""
    return {f"svg-{hashlib.md5(m.encode()).hexdigest()[:8]}.svg": m for m in map(markup, root.all("svg"))}


def metadata(root: Element) -> dict[str, str]:
    """Title, description, author, date and language of a page; what it doesn't have is left out."""
    named = {(m.get("name") or m.get("property")).lower(): m.get("content").strip() for m in root.all("meta") if m.get("content")}
    title = next((" ".join(t.text().split()) for tag in ("title", "h1") for t in root.all(tag) if t.text().strip()), "") or named.get("og:title", "")
    date = re.match(r"\d{4}-\d{2}-\d{2}", named.get("date", "") or named.get("article:published_time", ""))
    found = {
        "title": named["og:title"] if "og:title" in named and not title else title, "description": named.get("description") or named.get("og:description", ""), "author": named.get("author", ""),
        "date": date.group() if date else "", "lang": next((h.get("lang") for h in root.all("html") if h.get("lang")), ""),
    }
    return {k: v for k, v in found.items() if v}


def to_mdx(text: str | None) -> str | None:
    """HTML as MDX with frontmatter from the page's metadata; null stays null, broken markup never fails."""
    if text is None:
        return None
    root = read(text)
    body = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", _Writer().inner(root))).strip()
    head = "".join(f"{k}: {yaml_scalar(v)}\n" for k, v in metadata(root).items())
    return (f"---\n{head}---\n\n" if head else "") + body + "\n"
