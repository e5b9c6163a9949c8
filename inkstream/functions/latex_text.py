"""LaTeX and MDX text as column expressions: cleaning, macros, direction and footnotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions import persian, rx, slugs

#: Commands that are removed with their arguments, and what others become.
REMOVED = (
    "geometry pagestyle thispagestyle fancyhf fancyhead fancyfoot headrulewidth footrulewidth setlength addtolength settextfont setlatintextfont setdigitfont setmathfont setmonofont selectfont usepackage RequirePackage "
    "pgfplotsset usetikzlibrary tikzset graphicspath setcounter addtocounter stepcounter newcounter refstepcounter vspace vfill bigskip medskip smallskip hspace hfill phantom hphantom vphantom definecolor colorlet "
    "bibliographystyle documentclass makeatletter makeatother newcommand renewcommand providecommand newenvironment renewenvironment newtcbtheorem newtcolorbox DeclareTColorBox AtBeginDocument AtEndDocument DeclareOption "
    "ProcessOptions pagenumbering addbibresource nocite normalsize small footnotesize scriptsize tiny large Large LARGE huge Huge bfseries itshape rmfamily ttfamily sffamily mdseries upshape slshape centering raggedleft "
    "raggedright raggedbottom noindent indent frontmatter mainmatter backmatter maketitle tableofcontents listoffigures listoftables"
).split()
CONVERTED = {"clearpage": "\n\n---\n\n", "newpage": "\n\n---\n\n", "pagebreak": "\n\n---\n\n", "quad": "&emsp;", "qquad": "&emsp;&emsp;", "thinspace": "&thinsp;", "enspace": "&ensp;", "linebreak": "  \n"}
COMMENT = r"(?m)(^|[^\\])%.*$"
MACRO = r"\\(?:re)?newcommand\*?\{?\\([a-zA-Z]+)\}?(?:\[([0-9])\])?\{((?:[^{}]|\{[^{}]*\})*)\}"
FOOTNOTE = r"\\footnote\{(?:[^{}]|\{[^{}]*\})*\}"
TCOLORBOX = r"(?s)\\begin\{tcolorbox\}(?:\[([^\]]*)\])?(.*?)\\end\{tcolorbox\}"
DIRECTIVE = r"(?m)^\.\. (note|tip|warning|danger|caution|important|hint|attention|error|seealso)::[ \t]*(.*)$"
DIRECTIVE_KINDS = {"note": "note", "tip": "tip", "warning": "warning", "danger": "danger", "caution": "caution", "important": "important", "hint": "tip", "attention": "warning", "error": "danger", "seealso": "info"}


_ARGUMENTS = r"(?![a-zA-Z@])\*?(?:[ \t\r\n]*\[[^\]]*\])*(?:[ \t\r\n]*\{[^}]*\})*"


def clean(text: Column, removed: tuple[str, ...] = (), converted: dict[str, str] | None = None) -> Column:
    """Comments and layout commands removed with their arguments, page breaks and spaces converted, at most two empty lines, no space at the ends of lines.

    ``removed`` and ``converted`` add commands to the fixed ones. Half-spaces stay.
    """
    text = F.regexp_replace(text, COMMENT, "$1")
    text = F.regexp_replace(text, r"\\(?:" + "|".join((*REMOVED, *removed)) + ")" + _ARGUMENTS + "[ \t]*", "")
    for name, to in (CONVERTED | (converted or {})).items():
        text = F.regexp_replace(text, rf"\\{name}{_ARGUMENTS}", to)
    return F.regexp_replace(F.regexp_replace(text, r"\n{4,}", "\n\n\n"), r"(?m)[ \t]+$", "")


def title(text: Column) -> Column:
    """a title without commands, braces and ties."""
    text = F.regexp_replace(text, r"\\[a-zA-Z]+\*?\{([^{}]*)\}", "$1")
    text = F.regexp_replace(text, r"\\[a-zA-Z]+\*?|[{}]|\$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"~|\\\\", " "), r"[ \t\n]+", " "))


def commands(text: Column) -> Column:
    """Names of all commands of ``text``, with repeats."""
    return rx.every(text, r"\\([a-zA-Z]+)", 1)


def direction_spans(text: Column) -> Column:
    """direction commands and environments as HTML."""
    for names, tag, way in (("lr|textLR|LRE", "span", "ltr"), ("rl|textRL|RLE", "span", "rtl")):
        text = F.regexp_replace(text, rf"\\(?:{names})\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", f'<{tag} dir="{way}">$1</{tag}>')
    for env, way in (("latin", "ltr"), ("persian", "rtl")):
        text = F.regexp_replace(text, rf"(?s)\\begin\{{{env}\}}[ \t\n]*(.*?)[ \t\n]*\\end\{{{env}\}}", f'<div dir="{way}">\n\n$1\n\n</div>')
    return text


def footnotes(text: Column) -> Column:
    """Footnotes as numbered marks, their notes behind a rule at the end."""

    def numbered(t: Column) -> Column:
        hits, parts = rx.every(t, FOOTNOTE), rx.gaps(t, FOOTNOTE)
        marks = F.transform(hits, lambda h, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]")))
        notes = F.transform(hits, lambda h, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: "), F.regexp_replace(h, r"^\\footnote\{|\}$", "")))
        body = F.array_join(F.zip_with(parts, F.concat(marks, F.array(F.lit(""))), lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit("")))), "")
        return F.concat(body, F.lit("\n\n---\n\n"), F.array_join(notes, "\n"))

    return F.when(text.contains("\\footnote{"), numbered(text)).otherwise(text)


def with_direction(text: Column, way: str = "rtl", lang: str = "fa") -> Column:
    """Frontmatter with dir and lang; a block is added where there is none."""
    head = f"dir: {way}\nlang: {lang}\n"
    fixed = F.regexp_replace(F.regexp_replace(text, r"(?m)\A(---\n(?s:.*?))^(?:dir|lang):.*\n", "$1"), r"(?m)\A(---\n(?s:.*?))^(?:dir|lang):.*\n", "$1")
    return F.when(text.rlike(r"\A---\n(?s:.*?)\n---"), F.regexp_replace(fixed, r"\A---\n", f"---\n{head}")).otherwise(F.concat(F.lit(f"---\n{head}---\n\n"), text))


def wrap_blocks(text: Column) -> Column:
    """Code and display formulas in left-to-right divisions."""
    return F.regexp_replace(text, r"(?s)(```.*?```|\$\$.*?\$\$)", '<div dir="ltr">\n\n$1\n\n</div>')


def rtl(text: Column) -> Column:
    """Letters, blocks, left-to-right paragraphs and frontmatter of a right-to-left page."""
    return with_direction(persian.wrap_ltr(wrap_blocks(persian.outside_protected(text, persian.fix_letters))))


def style_object(css: Column) -> Column:
    """CSS declarations as a JSX style object."""
    parts = F.filter(F.transform(F.split(css, ";"), lambda p: F.trim(p)), lambda p: p.contains(":"))
    one = lambda p: F.concat(slugs.camel(F.trim(F.split_part(p, F.lit(":"), F.lit(1)))), F.lit(": '"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")), F.lit("'"))
    return F.concat(F.lit("{{"), F.array_join(F.transform(parts, one), ", "), F.lit("}}"))


def saved(before: Column, after: Column) -> Column:
    """percentage that is saved; 0 if there was nothing."""
    return F.when(before > 0, F.round((before - after) * 100 / F.when(before > 0, before), 1)).otherwise(0.0)


def without_overlaps(spans: Column) -> Column:
    """Spans (priority, start, end), the better ones first, without those that overlap one already taken."""
    free = lambda taken, s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    first = F.slice(spans, 1, 0)
    return F.array_sort(F.aggregate(F.array_sort(spans), first, lambda taken, s: F.when(free(taken, s), F.concat(taken, F.array(s))).otherwise(taken)), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
