"""Tables as models and their rendering: LaTeX and HTML in, pipes or HTML out.

A table is simple if it has no merged cells, no colours, no shape of its own
and one header row at most; simple tables become pipes, the others HTML.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Table environments, rules between rows, and the alignment of column letters.
ENVIRONMENTS = ("tabular", "tabularx", "longtable", "sidewaystable")
RULES = re.compile(r"\\(?:hline|toprule|midrule|bottomrule)\b|\\cline\{[^}]*\}")
ALIGNMENT = {"l": "left", "X": "left", "r": "right", "c": "center", "p": "center"}
SEPARATORS = {"center": ":---:", "right": "---:", "left": "---"}

_TABLE = re.compile(r"\\begin\{(tabular|tabularx|longtable|sidewaystable)\}(.*?)\\end\{\1\}", re.S)
_ROWS = re.compile(r"(?<!\\)\\\\(?:\[[^\]]*\])?")
_CELLS = re.compile(r"(?<!\\)&")
_MULTICOLUMN = re.compile(r"\\multicolumn\{(\d+)\}\{[^}]*\}\{((?:[^{}]|\{[^{}]*\})*)\}")
_MULTIROW = re.compile(r"\\multirow\{(\d+)\}\{[^}]*\}\{((?:[^{}]|\{[^{}]*\})*)\}")
_CELLCOLOR = re.compile(r"\\cellcolor(?:\[[^\]]*\])?\{([^}]*)\}")
_CAPTION = re.compile(r"\\caption\{((?:[^{}]|\{[^{}]*\})*)\}")
_LABEL = re.compile(r"\\label\{([^}]+)\}")
_HTML_TABLE = re.compile(r"<table[^>]*>(.*?)</table\s*>", re.S | re.I)
_HTML_ROW = re.compile(r"<tr[^>]*>(.*?)(?=<tr[\s>]|</tr\s*>|</table|\Z)", re.S | re.I)
_HTML_CELL = re.compile(r"<(td|th)\b([^>]*)>(.*?)(?=<t[dh]\b|</t[dh]\s*>|</tr|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*[\"']?([^\"'\s>]+|(?<=\")[^\"]*|(?<=')[^']*)")


@dataclass
class Cell:
    content: str
    colspan: int = 1
    rowspan: int = 1
    color: str | None = None
    header: bool = False


@dataclass
class Table:
    kind: str = "tabular"
    headers: list[list[Cell]] = field(default_factory=list)
    rows: list[list[Cell]] = field(default_factory=list)
    caption: str | None = None
    label: str | None = None
    alignments: list[str] = field(default_factory=list)
    colored: bool = False

    @property
    def merged(self) -> bool:
        return any(c.colspan > 1 or c.rowspan > 1 for row in self.headers + self.rows for c in row)

    @property
    def simple(self) -> bool:
        return not (self.merged or self.colored or self.kind != "tabular" or len(self.headers) > 1)


def _cell(text: str) -> Cell:
    """One LaTeX cell with its spans and colour."""
    cell = Cell(" ".join(text.split()))
    if m := _MULTICOLUMN.search(cell.content):
        cell.colspan, cell.content = int(m.group(1)), m.group(2)
    if m := _MULTIROW.search(cell.content):
        cell.rowspan, cell.content = int(m.group(1)), m.group(2)
    if m := _CELLCOLOR.search(cell.content):
        cell.color, cell.content = m.group(1), _CELLCOLOR.sub("", cell.content)
    cell.content = cell.content.strip()
    return cell


def from_latex(kind: str, spec: str, body: str, around: str = "", fix: Callable[[str], str] = str) -> Table:
    """A table from a column specification and a body; ``around`` holds caption and label, ``fix`` converts cells."""
    caption, label = _CAPTION.search(around), _LABEL.search(around)
    table = Table(kind, caption=fix(caption.group(1)).strip() if caption else None, label=label.group(1).strip() if label else None, colored="\\rowcolors" in around + body)
    table.alignments = [ALIGNMENT[c] for c in re.sub(r"\{[^}]*\}|[@!>]\{[^}]*\}", "", spec) if c in ALIGNMENT]
    body = _LABEL.sub("", _CAPTION.sub("", RULES.sub("", body)))
    for line in _ROWS.split(body):
        if line.strip():
            row = [_cell(c) for c in _CELLS.split(line)]
            for c in row:
                c.content = fix(c.content)
            if any(c.content for c in row):
                table.rows.append(row)
    table.colored = table.colored or any(c.color for row in table.rows for c in row)
    if table.rows:
        table.headers = [table.rows.pop(0)]
        for c in table.headers[0]:
            c.header = True
    return table


def split_spec(inner: str) -> tuple[str, str]:
    """(column specification, body) of what stands in a table environment; widths before the specification are skipped."""
    at = len(inner) - len(inner.lstrip())
    if m := re.match(r"\s*\[[^\]]*\]", inner):
        at = m.end()
    spec = ""
    while m := re.compile(r"\s*\{((?:[^{}]|\{[^{}]*\})*)\}").match(inner, at):
        spec, at = m.group(1), m.end()
        if re.fullmatch(r"[\s|lcrXpm@!>\d.{}\\a-z*]*", spec) and re.search(r"[lcrXp]", re.sub(r"\\[a-z]+", "", spec)):
            break
    return spec, inner[at:]


def latex_tables(text: str | None) -> list[Table]:
    """Every table of ``text`` in order; null and empty texts have none. Caption and label stand inside, or between the table float's begin and end."""
    out = []
    for m in _TABLE.finditer(text or ""):
        spec, body = split_spec(m.group(2))
        opened, closed = text.rfind("\\begin{table", 0, m.start()), text.rfind("\\end{table", 0, m.start())
        around = m.group(2)
        if opened > closed:
            end = text.find("\\end{table", m.end())
            around = text[opened : end if end >= 0 else len(text)]
        out.append(from_latex(m.group(1), spec, body, around))
    return out


def html_tables(text: str | None) -> list[Table]:
    """Every HTML table of ``text``; a row with a th is a header."""
    out = []
    for m in _HTML_TABLE.finditer(text or ""):
        table = Table()
        for tr in _HTML_ROW.findall(m.group(1)):
            row = []
            for tag, attributes, content in _HTML_CELL.findall(tr):
                a = {k.lower(): v for k, v in _ATTRIBUTE.findall(attributes)}
                spans = [int(a[k]) if a.get(k, "").isdigit() else 1 for k in ("colspan", "rowspan")]
                row.append(Cell(content.strip(), *spans, header=tag.lower() == "th"))
                table.colored = table.colored or "background" in a.get("style", "") or "color" in a.get("style", "")
            if row:
                (table.headers if any(c.header for c in row) else table.rows).append(row)
        out.append(table)
    return out


def to_pipes(table: Table, caption_below: bool = True) -> str:
    """A simple table as Markdown with the alignments of its columns."""
    lines = []
    for row in table.headers[:1]:
        lines.append("| " + " | ".join(c.content for c in row) + " |")
        lines.append("| " + " | ".join(SEPARATORS[table.alignments[i] if i < len(table.alignments) else "left"] for i in range(len(row))) + " |")
    lines += ["| " + " | ".join(c.content for c in row) + " |" for row in table.rows]
    caption = [f"**{table.caption}**"] if table.caption else []
    return "\n".join([*lines, "", *caption] if caption and caption_below else ["", *caption, "", *lines] if caption else lines)


def to_html(table: Table, rtl: bool = True) -> str:
    """Any table as HTML, in a division where its shape asks for one."""
    around = {"longtable": '<div style="overflow-x:auto">', "sidewaystable": '<div className="landscape-table">'}.get(table.kind)
    attributes = (f' id="{table.label}"' if table.label else "") + (' dir="rtl"' if rtl else "") + (' style="width:100%"' if table.kind == "tabularx" else "")
    lines = [around] if around else []
    lines.append(f"<table{attributes}>")
    for part, rows in (("thead", table.headers), ("tbody", table.rows)):
        if rows:
            lines.append(f"  <{part}>")
            for row in rows:
                lines.append("    <tr>")
                for c in row:
                    tag = "th" if c.header else "td"
                    spans = (f' colspan="{c.colspan}"' if c.colspan > 1 else "") + (f' rowspan="{c.rowspan}"' if c.rowspan > 1 else "") + (f' style="background-color:{c.color}"' if c.color else "")
                    lines.append(f"      <{tag}{spans}>{c.content}</{tag}>")
                lines.append("    </tr>")
            lines.append(f"  </{part}>")
    if table.caption:
        lines.append(f'  <caption style="caption-side:bottom">{table.caption}</caption>')
    lines.append("</table>")
    return "\n".join([*lines, "</div>"] if around else lines)


def render(table: Table) -> str:
    """Pipes for a simple table, HTML for any other one."""
    return to_pipes(table) if table.simple else to_html(table)


SCHEMA = "source string, table_no int, kind string, caption string, label string, n_columns int, n_rows int, is_simple boolean, cells array<array<string>>, mdx string"


def tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, the columns of SCHEMA): every LaTeX and HTML table of every text. One narrow pass; the header is the first of the cells."""
    key_type = df.schema[key].dataType.simpleString()
    strings = pa.list_(pa.list_(pa.string()))
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), strings, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__key", *(c.split(" ")[0] for c in SCHEMA.split(", "))]
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1)):
                value = value.as_py()
                for source, found in (("latex", latex_tables(value)), ("html", html_tables(value))):
                    for n, t in enumerate(found):
                        grid = t.headers + t.rows
                        at.append(i)
                        rows.append((source, n, t.kind, t.caption, t.label, max(map(len, grid), default=0), len(grid), t.simple, [[c.content for c in r] for r in grid], render(t)))
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=names)

    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__key {key_type}, {SCHEMA}").withColumnRenamed("__key", key)
