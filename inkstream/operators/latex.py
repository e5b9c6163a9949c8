"""LaTeX as a tree of nodes, and the tree as MDX.

One scanner walks a text once with an explicit stack, so nesting of environments
of any depth neither recurses nor fails: what is open at the end is closed
there, and a closing command that matches nothing is text. Arguments are
converted by the same rules up to DEEPEST levels; below, their text stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.operators import latex_tables

#: Levels of commands inside arguments that are converted, expansions of macros in one text, and levels of macros inside macros.
DEEPEST = 40
EXPANSIONS = 100_000
MACRO_DEPTH = 20

#: Environments whose body isn't parsed.
RAW = frozenset({"verbatim", "lstlisting", "minted", "equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "eqnarray", "tikzpicture", "pgfpicture", "tabular", "tabularx", "longtable", "algorithm", "algorithm2e", "filecontents", "filecontents*"})
MATH = frozenset({"equation", "align", "gather", "multline", "eqnarray"})
CODE = frozenset({"verbatim", "lstlisting", "minted", "algorithm", "algorithm2e"})
#: Arguments that well-known commands and environments take; other commands take every group that follows at once.
ARITY = {"item": 0, "centering": 0, "noindent": 0, "quad": 0, "qquad": 0, "ldots": 0, "dots": 0, "newpage": 0, "clearpage": 0, "maketitle": 0, "tableofcontents": 0, "par": 0, "bf": 0, "it": 0, "em": 0}
ENVIRONMENT_ARITY = {"minted": 1, "tabular": 0, "tabularx": 0, "longtable": 0, "wrapfigure": 2, "minipage": 1, "subfigure": 1, "multicols": 1}
#: Commands that leave nothing behind.
SILENT = frozenset(
    "maketitle tableofcontents listoffigures listoftables frontmatter mainmatter backmatter clearpage newpage pagebreak thispagestyle pagestyle noindent indent vspace vfill bigskip medskip smallskip hspace hfill "
    "centering raggedleft raggedright selectfont normalsize small footnotesize large Large LARGE huge Huge tiny bfseries itshape rmfamily ttfamily sffamily settextfont setlatintextfont setdigitfont geometry headrulewidth "
    "footrulewidth setcounter addtocounter stepcounter phantom hphantom vphantom definecolor colorlet usetikzlibrary pgfplotsset tikzset graphicspath bibliographystyle fancyhf fancyhead fancyfoot renewcommand newcommand "
    "providecommand newtheorem newtcolorbox newtcbtheorem documentclass usepackage label color title author date setlength bf it em par hline caption bibliography addbibresource".split()
)
SECTIONS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
FORMATS = {
    "textbf": ("**", "**"), "textit": ("*", "*"), "emph": ("*", "*"), "underline": ("<u>", "</u>"), "sout": ("~~", "~~"), "texttt": ("`", "`"), "textsc": ('<span style={{fontVariant: "small-caps"}}>', "</span>"),
    "lr": ('<span dir="ltr">', "</span>"), "rl": ('<span dir="rtl">', "</span>"),
}
BOXES = {"theorem": "Theorem", "lemma": "Theorem", "corollary": "Theorem", "proposition": "Theorem", "conjecture": "Theorem", "claim": "Theorem", "definition": "Definition", "example": "Example", "remark": "Example", "proof": "Proof", "proofbox": "Proof"}
ADMONITIONS = {"abstract": ("abstract", "چکیده"), "warningbox": ("warning", "هشدار"), "notebox": ("note", "نکته")}
LISTS = frozenset({"itemize", "enumerate", "description"})
#: Environments whose converted text is rewritten as a whole.
INNER = frozenset({"quote", "quotation", "verse", "figure", "wrapfigure"})
CITES = frozenset({"cite", "textcite", "parencite", "autocite", "citep", "citet"})

_TOKEN = re.compile(r"\\begin\{([^}]*)\}|\\end\{([^}]*)\}|\\([a-zA-Z@]+)(\*?)|\\\[|\\\(|\\(.)|(?<!\\)%[^\n]*\n?|\$\$|\$", re.S)


@dataclass
class Node:
    kind: str
    name: str | None = None
    star: bool = False
    args: list[str] = field(default_factory=list)
    opts: list[str] = field(default_factory=list)
    text: str = ""
    display: bool | None = None
    children: list[Node] = field(default_factory=list)


def _group(text: str, at: int, opening: str, closing: str) -> int:
    """Position behind the group that opens at ``at``, or -1."""
    depth, i = 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == opening:
            depth += 1
        elif text[i] == closing:
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


class _Pairs:
    """Positions behind the groups of one text, found in one scan for each kind of bracket: what :func:`_group` gives, however many openings are never closed."""

    def __init__(self, text: str):
        self.text = text
        self.ends: dict[str, dict[int, int]] = {}

    def end(self, at: int, opening: str, closing: str) -> int:
        if opening not in self.ends:
            ends, stack = {}, []
            for m in re.finditer(rf"\\.|[{re.escape(opening + closing)}]", self.text, re.S):
                if m.group() == opening:
                    stack.append(m.start())
                elif m.group() == closing and stack:
                    ends[stack.pop()] = m.end()
            self.ends[opening] = ends
        return self.ends[opening].get(at, -1)


def _arguments(text: str, at: int, most: int, pairs: _Pairs) -> tuple[list[str], list[str], int]:
    args, opts = [], []
    while at < len(text):
        if text[at] == "[" and not args:
            end = pairs.end(at, "[", "]")
            if end < 0 or "\n\n" in text[at:end]:
                break
            opts.append(text[at + 1 : end - 1])
        elif text[at] == "{" and len(args) < most:
            end = pairs.end(at, "{", "}")
            if end < 0:
                break
            args.append(text[at + 1 : end - 1])
        else:
            break
        at = end
    return args, opts, at


def parse(text: str | None) -> Node:
    """The tree of ``text``; null and empty texts are a root without children."""
    root = Node("root")
    stack = [root]
    text = text or ""
    at, pairs = 0, _Pairs(text)

    def add_text(value: str) -> None:
        if value:
            stack[-1].children.append(Node("text", text=value))

    while at < len(text):
        m = _TOKEN.search(text, at)
        if not m:
            break
        add_text(text[at : m.start()])
        at = m.end()
        token = m.group()
        if m.group(1) is not None:
            name = m.group(1)
            node = Node("environment", name.rstrip("*"), name.endswith("*"))
            node.args, node.opts, at = _arguments(text, at, ENVIRONMENT_ARITY.get(name, 0), pairs)
            if name.rstrip("*") in BOXES and not node.opts:
                node.args, more, at = _arguments(text, at, 2, pairs)
                node.opts += more
            stack[-1].children.append(node)
            if name in RAW:
                end = text.find(f"\\end{{{name}}}", at)
                node.text = text[at : end if end >= 0 else len(text)]
                at = end + len(name) + 6 if end >= 0 else len(text)
            else:
                stack.append(node)
        elif m.group(2) is not None:
            name = m.group(2).rstrip("*")
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                del stack[depth:]
            else:
                add_text(token)
        elif m.group(3):
            node = Node("command", m.group(3), bool(m.group(4)))
            node.args, node.opts, at = _arguments(text, at, ARITY.get(m.group(3), 9), pairs)
            stack[-1].children.append(node)
        elif token in ("\\[", "\\(", "$$", "$"):
            closing = {"\\[": "\\]", "\\(": "\\)"}.get(token, token)
            end = text.find(closing, at)
            if end < 0:
                add_text(token)
            else:
                stack[-1].children.append(Node("math", text=text[at:end], display=token in ("\\[", "$$")))
                at = end + len(closing)
        elif token[0] == "%":
            stack[-1].children.append(Node("comment", text=token[1:].rstrip("\n")))
        else:
            add_text("\n" if token == "\\\\" else m.group(5) or "")
    add_text(text[at:])
    return root


def label_id(label: str) -> str:
    """an id from a label: everything but letters, digits and hyphens becomes a hyphen."""
    return re.sub(r"[^a-zA-Z0-9-]", "-", label).strip("-")


class _Renderer:
    """The tree as MDX. Work is kept on a stack; what stands in an environment is rewritten when it closes."""

    def __init__(self, boxes: dict[str, str] | None = None):
        self.boxes = BOXES | (boxes or {})
        self.notes: list[str] = []
        self.depth = 0

    def text(self, root: Node) -> str:
        out: list[str] = []
        lists: list[list] = []
        todo: list[Node | str | tuple[Node, int]] = [root]
        item = False  # whether an item has just been opened
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif isinstance(node, tuple):
                node, start = node
                if node.name in LISTS:
                    lists.pop()
                else:
                    inner = "".join(out[start:])
                    del out[start:]
                    out.append(self._figure(node, inner) if node.name in ("figure", "wrapfigure") else "\n\n" + "\n".join(f"> {line}" for line in inner.strip().split("\n")) + "\n\n")
            elif node.kind == "text":
                out.append(node.text.lstrip() if item else node.text)
            elif node.kind == "math":
                out.append(f"\n\n$$\n{node.text.strip()}\n$$\n\n" if node.display else f"${node.text.strip()}$")
            elif node.kind == "command":
                out.append(self._item(node, lists) if node.name == "item" else self._command(node))
            elif node.kind == "root":
                todo += reversed(node.children)
            elif node.kind == "environment":
                if (node.name or "") + "*" * node.star in RAW or node.name in RAW:
                    out.append(self._raw(node))
                    continue
                before, after = self._around(node)
                if node.name in LISTS:
                    before = after = "" if lists else "\n\n"
                    lists.append([node.name == "enumerate", 0])
                out.append(before)
                todo.append(after)
                if node.name in LISTS or node.name in INNER:
                    todo.append((node, len(out)))
                todo += reversed(node.children)
            item = isinstance(node, Node) and node.kind == "command" and node.name == "item"
        return "".join(out)

    def argument(self, text: str) -> str:
        """An argument by the same rules."""
        if self.depth >= DEEPEST or not ("\\" in text or "$" in text or "%" in text):
            return text
        self.depth += 1
        try:
            return self.text(parse(text))
        finally:
            self.depth -= 1

    @staticmethod
    def _item(node: Node, lists: list[list]) -> str:
        mark = "- "
        if lists:
            lists[-1][1] += 1
            mark = f"{lists[-1][1]}. " if lists[-1][0] else "- "
        label = f"**{node.opts[0]}** " if node.opts else ""
        return "\n" + "  " * max(len(lists) - 1, 0) + mark + label

    def _command(self, node: Node) -> str:
        name, first = node.name or "", node.args[0] if node.args else ""
        if name in SECTIONS:
            return f"\n\n{'#' * SECTIONS[name]} {self.argument(first)}\n\n"
        if name in FORMATS:
            before, after = FORMATS[name]
            return before + self.argument(first) + after
        if name == "textcolor":
            return f'<span style={{{{color: "{first}"}}}}>{self.argument(node.args[1]) if len(node.args) > 1 else ""}</span>'
        if name == "href":
            return f"[{self.argument(node.args[1]) if len(node.args) > 1 else first}]({first})"
        if name == "url":
            return f"[{first}]({first})"
        if name in ("ref", "cref", "Cref", "autoref"):
            return f'<CrossRef target="{label_id(first)}" />'
        if name == "eqref":
            return f'<CrossRef target="{label_id(first)}" type="equation" />'
        if name in CITES:
            return f'<Citation keys="{first}" />'
        if name in ("footnote", "LTRfootnote", "endnote"):
            self.notes.append("")
            at = len(self.notes)
            self.notes[at - 1] = self.argument(first)
            return f"[^{at}]"
        if name == "includegraphics":
            return f'<img src="{first}"{_width(node.opts[0] if node.opts else "")} />'
        if name in ("ldots", "dots"):
            return "…"
        if name in ("quad", "qquad"):
            return " "
        if name == "textasciitilde":
            return "~"
        if name == "printbibliography":
            return "\n\n<Bibliography />\n\n"
        if name in ("input", "include"):
            return f"\\{name}{{{first}}}"  # a file that isn't there
        return "" if name in SILENT else self.argument(first)

    def _raw(self, node: Node) -> str:
        name, body = node.name or "", node.text
        if name in MATH:
            inner, within = body.strip(), "aligned" if name in ("align", "eqnarray") else "gathered"
            inner = inner if name == "equation" else f"\\begin{{{within}}}\n{inner}\n\\end{{{within}}}"
            return f"\n\n$$\n{inner}\n$$\n\n"
        if name in CODE:
            language = node.args[0].lower() if name == "minted" and node.args else next((m.group(1).strip().lower() for o in node.opts if (m := re.search(r"language\s*=\s*\{?([^,}]+)", o))), "")
            return f"\n\n```{language}\n{body.strip(chr(10))}\n```\n\n"
        if name in ("tikzpicture", "pgfpicture"):
            return f"\n\n<TikZDiagram>\n{body.strip(chr(10))}\n</TikZDiagram>\n\n"
        if name in latex_tables.ENVIRONMENTS:
            spec, rows = latex_tables.split_spec(body)
            return f"\n\n{latex_tables.render(latex_tables.from_latex(name, spec, rows, body, lambda t: self.argument(t).strip()))}\n\n"
        return ""

    def _around(self, node: Node) -> tuple[str, str]:
        """What stands before and behind the text of an environment."""
        name = node.name or ""
        if name in self.boxes:
            title = node.opts[0] if node.opts else node.args[0] if node.args else ""
            ident = label_id(node.args[1]) if len(node.args) > 1 else _label(node)
            attributes = (f' id="{ident}"' if ident else "") + (f' title="{self.argument(title)}"' if title else "")
            return f"\n\n<{self.boxes[name]}{attributes}>\n\n", f"\n\n</{self.boxes[name]}>\n\n"
        if name in ADMONITIONS or name == "tcolorbox":
            kind, title = _tcolorbox(node.opts[0] if node.opts else "") if name == "tcolorbox" else (ADMONITIONS[name][0], node.opts[0] if node.opts else ADMONITIONS[name][1])
            return f'\n\n<Admonition type="{kind}" title="{title}">\n\n', "\n\n</Admonition>\n\n"
        if name == "table":
            caption = _caption(node)
            return "\n\n" + (f"**{self.argument(caption)}**\n\n" if caption else ""), "\n\n"
        if name == "sidewaystable":
            return '\n\n<div className="landscape-table">\n\n', "\n\n</div>\n\n"
        if name == "center":
            return '\n\n<div style={{textAlign: "center"}}>\n\n', "\n\n</div>\n\n"
        return ('<span dir="ltr">', "</span>") if name == "latin" else ("", "")

    def _figure(self, node: Node, inner: str) -> str:
        source, caption, ident = re.findall(r'<img src="([^"]+)"', inner), _caption(node), _label(node)
        attributes = []
        if node.name == "wrapfigure":
            attributes.append(f'float="{"right" if (node.args or ["r"])[0] in ("r", "R") else "left"}"')
            attributes.append(_width(node.args[1] if len(node.args) > 1 else "").strip())
        attributes += [f'src="{source[0]}"' if source else "", f'caption="{self.argument(caption)}"' if caption else "", f'id="{ident}"' if ident else ""]
        one = "<Figure" + "".join(f" {a}" for a in attributes if a) + " />"
        # the pictures of a grid stay beside each other
        grid = "".join(f'\n<Image src="{s}" />' for s in source) if len(source) > 1 else ""
        return f"\n\n<FigureGrid{''.join(f' {a}' for a in attributes if a and not a.startswith('src='))}>{grid}\n</FigureGrid>\n\n" if grid else f"\n\n{one}\n\n"


def _width(option: str) -> str:
    m = re.search(r"([\d.]+)\s*\\(?:textwidth|linewidth|columnwidth)", option)
    return f' width="{int(float(m.group(1)) * 100)}%"' if m and m.group(1).strip(".") else ""


def _commands(node: Node, name: str) -> Iterator[Node]:
    todo = list(reversed(node.children))
    while todo:
        n = todo.pop()
        if n.kind == "command" and n.name == name:
            yield n
        todo += reversed(n.children)


def _caption(node: Node) -> str:
    return next((n.args[0].strip() for n in _commands(node, "caption") if n.args), "")


def _label(node: Node) -> str:
    return next((label_id(n.args[0]) for n in _commands(node, "label") if n.args), "")


def _tcolorbox(option: str) -> tuple[str, str]:
    """(kind, title) of a box by its options."""
    title = re.search(r"title\s*=\s*\{([^}]+)\}|title\s*=\s*([^,\]]+)", option)
    low = option.lower()
    kind = "warning" if re.search("orange|warning|red", low) else "tip" if "green" in low else "note"
    return kind, (title.group(1) or title.group(2)).strip() if title else "" if "=" in option else option


def render(root: Node, boxes: dict[str, str] | None = None) -> str:
    """The tree as MDX text, footnotes at its end. Depth of environments is no limit."""
    renderer = _Renderer(boxes)
    body = re.sub(r"\n{3,}", "\n\n", renderer.text(root)).strip()
    if renderer.notes:
        body += "\n\n" + "\n".join(f"[^{i}]: {n}" for i, n in enumerate(renderer.notes, 1))
    return body


@dataclass
class Preamble:
    """What stands before a document's text."""

    document_class: str = ""
    packages: list[str] = field(default_factory=list)
    macros: dict[str, tuple[int, str | None, str]] = field(default_factory=dict)
    boxes: dict[str, str] = field(default_factory=dict)
    title: str = ""
    author: str = ""
    date: str = ""


_DEFINITION = re.compile(r"\\(?:re|provide)?newcommand\*?\s*\{?\\([a-zA-Z]+)\}?\s*(?:\[(\d)\])?\s*(?:\[([^\]]*)\])?\s*(?=\{)|\\providecommand\*?\s*\{?\\([a-zA-Z]+)\}?\s*(?=\{)|\\def\s*\\([a-zA-Z]+)\s*(?=\{)|\\DeclareMathOperator(\*?)\s*\{\\([a-zA-Z]+)\}\s*(?=\{)")


#: What holds code, in which no macro is defined or used.
_CODE = re.compile(r"\\begin\{(verbatim|lstlisting|minted|filecontents\*?)\}.*?(?:\\end\{\1\}|\Z)|\\verb\*?([^a-zA-Z\s*]).*?\2", re.S)


def _outside_code(text: str, first: re.Pattern, at: int) -> re.Match | None:
    """The first match of ``first`` from ``at`` on that no code holds."""
    m, code = first.search(text, at), _CODE.search(text, at)
    while m and code and code.start() <= m.start():
        m, code = first.search(text, code.end()) if m.start() < code.end() else m, _CODE.search(text, max(code.end(), code.start() + 1))
    return m


def take_macros(text: str) -> tuple[str, dict[str, tuple[int, str | None, str]]]:
    """``text`` without its macro definitions, and (arguments, default of the first, body) by name; the last definition counts."""
    macros: dict[str, tuple[int, str | None, str]] = {}
    out, at = [], 0
    while m := _outside_code(text, _DEFINITION, at):
        end = _group(text, m.end(), "{", "}")
        if end < 0:
            break
        body = text[m.end() + 1 : end - 1]
        if m.group(7):
            body = f"\\operatorname{m.group(6)}{{{body}}}"
        macros[m.group(1) or m.group(4) or m.group(5) or m.group(7)] = (int(m.group(2) or 0), m.group(3), body)
        out.append(text[at : m.start()])
        at = end
    return "".join(out) + text[at:], macros


def expand(text: str, macros: dict[str, tuple[int, str | None, str]]) -> str:
    """``text`` with every use of a macro replaced by its body, in text and in formulas.

    Bodies may use other macros up to MACRO_DEPTH levels; EXPANSIONS bounds
    what definitions that call themselves can do, and what is left then stays.
    """
    if not macros:
        return text
    use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![a-zA-Z])")
    left = EXPANSIONS
    for _ in range(MACRO_DEPTH):
        out, at = [], 0
        while left and (m := _outside_code(text, use, at)):
            n, default, body = macros[m.group(1)]
            args, end = [], m.end()
            if default is not None:
                close = _group(text, end, "[", "]") if text[end : end + 1] == "[" else -1
                args.append(text[end + 1 : close - 1] if close > 0 else default)
                end = max(close, end)
            while len(args) < n:
                while text[end : end + 1] in (" ", "\n"):
                    end += 1
                close = _group(text, end, "{", "}") if text[end : end + 1] == "{" else -1
                args.append(text[end + 1 : close - 1] if close > 0 else text[end : end + 1])
                end = close if close > 0 else min(end + 1, len(text))
            if not n and text[end : end + 2] == "{}":
                end += 2
            value = re.sub(r"#([1-9])", lambda a, args=args: args[int(a.group(1)) - 1] if int(a.group(1)) <= len(args) else "", body)
            # a command at the end of the body must not grow into the word behind it
            gap = " " if re.search(r"\\[a-zA-Z]+\Z", value) and text[end : end + 1].isalpha() else ""
            out += [text[at : m.start()], value, gap]
            at, left = end, left - 1
        if not out:
            return text
        text = "".join(out) + text[at:]
    return text


def _balanced(text: str, command: str) -> str:
    m = re.search(rf"\\{command}\s*(?:\[[^\]]*\])?\s*(?=\{{)", text)
    end = _group(text, m.end(), "{", "}") if m else -1
    return text[m.end() + 1 : end - 1].strip() if m and end > 0 else ""


def preamble(text: str) -> Preamble:
    """Class, packages, macros, boxes, title, author and date of a document."""
    _, macros = take_macros(text)
    kind = re.search(r"\\documentclass(?:\[[^\]]*\])?\{([^}]+)\}", text)
    packages = [p.strip() for group in re.findall(r"\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}", text) for p in group.split(",") if p.strip()]
    boxes = {}
    for env, shown in re.findall(r"\\newtheorem\*?\{([^}]+)\}(?:\[[^\]]*\])?\{([^}]+)\}", text) + re.findall(r"\\newtcbtheorem(?:\[[^\]]*\])?\{([^}]+)\}\{([^}]+)\}", text):
        boxes[env] = box_of(env, shown)
    for env in re.findall(r"\\newtcolorbox(?:\[[^\]]*\])?\{([^}]+)\}", text):
        boxes.setdefault(env, box_of(env, ""))
    return Preamble(kind.group(1) if kind else "", packages, macros, boxes, *(_balanced(text, c) for c in ("title", "author", "date")))


def preambles(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, document_class, packages, title, author, n_macros) of every document."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [preamble(t.as_py() or "") for t in batch.column(1)]
            columns = [[p.document_class for p in found], [p.packages for p in found], [plain(p.title) for p in found], [plain(p.author) for p in found], [len(p.macros) for p in found]]
            types = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["__key", "document_class", "packages", "title", "author", "n_macros"])

    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__key {key_type}, document_class string, packages array<string>, title string, author string, n_macros int").withColumnRenamed("__key", key)


#: Words in the name or heading of a box that tell its component, in this order.
BOX_WORDS = (("Definition", "defin|تعریف"), ("Example", "exampl|مثال|remark|نکته"), ("Proof", "proof|برهان|اثبات"), ("Admonition", "note|warn|box|هشدار|توجه"), ("Theorem", ""))


def box_of(env: str, shown: str) -> str:
    """the component of a box that a document defines."""
    return next(c for c, words in BOX_WORDS if re.search(words, f"{env} {shown}".lower()))


#: Columns of a node's row.
NODE_SCHEMA = "node_id int, parent_id int, ordinal int, depth int, kind string, name string, star boolean, args array<string>, opts array<string>, content string, display boolean"


def rows_of(root: Node) -> list[tuple]:
    """The tree as rows with parent pointers; the root has none."""
    out, todo, last = [], [(c, None, i, 0) for i, c in reversed(list(enumerate(root.children, 1)))], 0
    while todo:
        node, parent, ordinal, depth = todo.pop()
        last += 1
        own = last
        out.append((own, parent, ordinal, depth, node.kind, node.name, node.star, node.args, node.opts, node.text or None, node.display))
        todo += [(c, own, i, depth + 1) for i, c in reversed(list(enumerate(node.children, 1)))]
    return out


def nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node columns): every node of every text, in document order. One narrow pass."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.bool_()]
        names = [c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                at, rows = [], []
                for i in range(start, min(start + 64, batch.num_rows)):
                    own = rows_of(parse(batch.column(1)[i].as_py()))
                    at += [i] * len(own)
                    rows += own
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["__key", *names])

    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__key {key_type}, {NODE_SCHEMA}").withColumnRenamed("__key", key)


def to_mdx(text: str | None) -> str | None:
    """A whole LaTeX document as MDX with frontmatter, its macros expanded; null stays null."""
    if text is None:
        return None
    head = preamble(text)
    without, macros = take_macros(text)
    body = re.search(r"\\begin\s*\{document\}(.*?)(?:\\end\s*\{document\}|\Z)", without, re.S)
    front = {"title": plain(expand(head.title, macros)), "author": plain(expand(head.author, macros))}
    lines = "".join(f"{k}: {yaml_scalar(v)}\n" for k, v in front.items() if v)
    return (f"---\n{lines}---\n\n" if lines else "") + render(parse(expand(body.group(1) if body else without, macros)), head.boxes) + "\n"


def plain(text: str) -> str:
    """a title without commands, braces, ties and breaks."""
    text = re.sub(r"\\\\(?:\[[^\]]*\])?|\\(?:and|newline)(?![a-zA-Z])", " ", text)
    for _ in range(DEEPEST):
        new = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
        if new == text:
            break
        text = new
    text = re.sub(r"\\([%&#_{}$])", "\\1", re.sub(r"\\[a-zA-Z]+\*?\s?", "", text))
    return " ".join(re.sub(r"[{}]", "", text).replace("~", " ").split())


def yaml_scalar(value: str) -> str:
    """``value`` as a YAML scalar, quoted where a plain one would be read as something else."""
    plain_ok = value and re.match(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`]|-(?=\S)", value) and not re.search(r": |:$| #|\n|[\x00-\x1f]", value) and value == value.strip()
    if plain_ok and not re.fullmatch(r"(?i)true|false|yes|no|on|off|null|~|[-+]?[\d.][\d_.,:eE+\-]*|\d{4}-\d{2}-\d{2}.*", value):
        return value
    return "'" + " ".join(value.split()).replace("'", "''") + "'"
