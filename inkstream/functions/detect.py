"""Formats, features and roles of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions import rx

#: Formats by extension.
FORMATS = {
    "tex": "latex", "latex": "latex", "ltx": "latex", "sty": "latex", "cls": "latex", "md": "markdown", "mdx": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "xhtml": "html",
    "rst": "rst", "adoc": "asciidoc", "asciidoc": "asciidoc", "txt": "text", "docx": "docx", "doc": "docx", "pdf": "pdf", "epub": "epub", "ipynb": "notebook", "bib": "bibtex",
}
#: Kinds of assets by extension; the first kind that has it counts.
ASSETS = {"image": "png jpg jpeg gif svg webp avif bmp tiff eps", "media": "mp4 webm mp3 wav ogg avi mov", "style": "css scss less sty cls", "metadata": "yaml yml json toml bib", "font": "ttf otf woff woff2 eot"}
#: Signs of each format in the first 8 KiB, in order of precedence on a tie.
SIGNS = {
    "latex": [r"\\documentclass\b", r"\\begin\{document\}", r"\\usepackage\b", r"\\section\{", r"\\chapter\{", r"\\newcommand\b", r"\\input\{", r"\\include\{", r"\\begin\{(equation|align|theorem|proof|tikzpicture)\}"],
    "html": [r"(?i)<html[ >]", r"(?i)<head[ >]", r"(?i)<body[ >]", r"(?i)<div[ >]", r"(?i)<script[ >]", r"(?i)<style[ >]"],
    "markdown": [r"(?m)^#{1,6}[ \t]+", r"(?m)^\*\*.*\*\*", r"(?m)^- \[[ x]\]", r"(?m)^\|.*\|.*\|", r"(?m)^```[a-zA-Z0-9_]*$", r"(?m)^---[ \t]*$"],
    "rst": [r"(?m)^\.\. [a-zA-Z0-9_]+::", r"(?m)^={3,}[ \t]*$", r"(?m)^-{3,}[ \t]*$", r"(?m)^~{3,}[ \t]*$", r":[a-zA-Z0-9_]+:`[^`]+`"],
    "asciidoc": [r"(?m)^={1,5}[ \t]+[^ \t\n]", r"(?m)^:[a-zA-Z0-9_-]+:[ \t]+", r"(?m)^\[source", r"(?m)^----[ \t]*$", r"(?m)^\[NOTE\]"],
}
#: Features that a document has if a pattern occurs.
FEATURES = {
    "has_math": r"\$[^$]+\$|\\\[|\\\(|\\begin\{(equation|align|gather|multline)",
    "has_code": r"```|\\begin\{(lstlisting|minted|verbatim)\}|<pre|<code",
    "has_tables": r"\\begin\{(tabular|longtable|table)|<table|(?m)^\|.*\|",
    "has_bibliography": r"\\bibliography\{|\\begin\{thebibliography\}|\\cite|\\addbibresource",
    "has_tikz": r"\\begin\{tikzpicture\}",
}
#: Compound and simple archive extensions.
ARCHIVES = {"tar.gz": "tar.gz", "tgz": "tar.gz", "tar.bz2": "tar.bz2", "tar.xz": "tar.xz", "zip": "zip", "tar": "tar", "rar": "rar", "7z": "7z"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def format_of(path: Column) -> Column:
    """Format by extension, or unknown."""
    formats = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return F.coalesce(F.element_at(formats, extension(path)), F.lit("unknown"))


def asset_kind(path: Column) -> Column:
    """Kind of asset, null for a document."""
    ext, out = extension(path), None
    for kind, exts in ASSETS.items():
        hit = ext.isin(*exts.split())
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def archive_kind(path: Column) -> Column:
    """Archive type by compound extension, then simple one; null if none."""
    lower, out = F.lower(path), None
    for ext, kind in ARCHIVES.items():
        hit = lower.endswith("." + ext)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def content_scores(text: Column) -> Column:
    """Score of each format as a struct."""
    head = F.substring(text, 1, 8192)
    out = []
    for name, patterns in SIGNS.items():
        score = sum(((rx.has(head, p)).cast("int") * (2 if name == "latex" else 1) for p in patterns), F.lit(0))
        if name == "latex":
            score = score + rx.has(head, r"\\begin\{document\}").cast("int") * 10
        out.append(score.cast("bigint").alias(name))
    return F.struct(*out)


def content_format(text: Column) -> Column:
    """The format with the highest score of 2 or more; the first on a tie."""
    scores = content_scores(text)
    ranked = [F.struct(scores[n].alias("s"), F.lit(-i).alias("p"), F.lit(n).alias("n")) for i, n in enumerate(SIGNS)]
    best = F.array_max(F.array(*ranked))
    return F.when(best["s"] >= 2, best["n"]).otherwise("unknown")


def features(text: Column) -> list[Column]:
    """Feature flags."""
    return [rx.has(text, p).alias(n) for n, p in FEATURES.items()]


def is_book(text: Column) -> Column:
    """A book class, two chapters or more, or inputs with a chapter, in the first 5000 characters."""
    head = F.substring(text, 1, 5000)
    chapters = rx.count(head, r"\\chapter\b")
    return rx.has(head, r"\\documentclass[^{]*\{book\}") | (chapters >= 2) | (rx.has(head, r"\\(input|include)\{") & (chapters >= 1))


def markdown_sniff(text: Column) -> Column:
    """Two of five signs in the first 2000 characters."""
    head = F.substring(text, 1, 2000)
    signs = (r"(?m)^#{1,6} ", r"(?m)^[-*] ", r"\[[^\]]+\]\([^)]+\)", r"```", r"(?m)^---[ \t]*$")
    return sum((rx.has(head, s).cast("int") for s in signs), F.lit(0)) >= 2


def unsafe_path(path: Column) -> Column:
    """A path that leaves its root."""
    return rx.has(path, r"(^|[/\\])\.\.([/\\]|$)") | rx.has(path, r"^[/\\]|^[A-Za-z]:")
