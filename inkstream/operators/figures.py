"""LaTeX figures and drawings as rows, and as components.

Native expressions: one pass over the texts. Null and empty texts have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import rx
from inkstream.operators.blocks import trimmed

#: Patterns. Groups of figures are position, width and body.
WRAPPED = r"(?s)\\begin\{wrapfigure\}\{([^{}]*)\}\{([^{}]*)\}(.*?)\\end\{wrapfigure\}"
FIGURE = r"(?s)\\begin\{figure\*?\}(?:\[([^\]]*)\])?()(.*?)\\end\{figure\*?\}"
PART = r"(?s)\\begin\{subfigure\}(?:\[[^\]]*\])?\{[^{}]*\}(.*?)\\end\{subfigure\}"
GRAPHIC = r"\\includegraphics(?:\[[^\]]*\])?\{([^{}]*)\}"
CAPTION = r"\\caption\{([^{}]*)\}"
LABEL = r"\\label\{([^{}]*)\}"
DRAWING = r"(?s)\\begin\{tikzpicture\}(.*?)\\end\{tikzpicture\}(?=(.{0,500}))"
DRAWN = r"(?s)<TikZDiagram>(.*?)</TikZDiagram>"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(trimmed(F.regexp_extract(text, pattern, 1)), F.lit(""))


def _attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise("")


def _caption(value: Column, indent: str = "  ") -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{indent}<figcaption>"), value, F.lit("</figcaption>\n"))).otherwise("")


def _image(src: Column, alt: Column) -> Column:
    return F.concat(F.lit('<Image src="'), F.coalesce(src, F.lit("")), F.lit('" alt="'), F.coalesce(alt, F.lit("")), F.lit('" />'))


def figures(df: DataFrame, key: str, text: str, assets: dict[str, str] | None = None) -> DataFrame:
    """(key, kind, pos, src, caption, label, position, width, parts, mdx): figures of each text; ``assets`` maps sources to new ones.

    A figure with parts has their sources instead of one of its own; what is
    missing is null.
    """
    moved = F.create_map(*(F.lit(x) for kv in (assets or {"": ""}).items() for x in kv))
    renamed = lambda src: F.coalesce(F.element_at(moved, src), src)

    def found(kind: str, pattern: str) -> Column:
        groups = F.arrays_zip(*(rx.every(F.col(text), pattern, i).alias(n) for i, n in ((1, "a"), (2, "w"), (3, "b"))))
        return F.transform(groups, lambda g, i: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("pos"), g["a"].alias("position"), g["w"].alias("width"), g["b"].alias("body")))

    empty = F.array().cast("array<struct<kind:string,pos:bigint,position:string,width:string,body:string>>")
    out = df.select(key, F.inline(F.concat(*(F.coalesce(found(k, p), empty) for k, p in (("wrapfigure", WRAPPED), ("figure", FIGURE))))))
    part = lambda b: F.struct(renamed(_first(b, GRAPHIC)).alias("src"), _first(b, CAPTION).alias("caption"), _first(b, LABEL).alias("label"))
    out = out.withColumn("parts", F.transform(rx.every(F.col("body"), PART, 1), part)).withColumn("own", F.regexp_replace("body", PART, ""))
    single = F.size("parts") == 0
    out = out.select(key, "kind", "pos", F.when(single, renamed(_first(F.col("body"), GRAPHIC))).alias("src"), _first(F.col("own"), CAPTION).alias("caption"), _first(F.col("own"), LABEL).alias("label"), F.nullif("position", F.lit("")).alias("position"), F.nullif("width", F.lit("")).alias("width"), "parts")
    one = lambda src, caption, label: F.concat(F.lit("<Figure"), _attribute("id", label), F.lit(">\n  "), _image(src, caption), F.lit("\n"), _caption(caption), F.lit("</Figure>"))
    side = F.when(F.col("position").isin("r", "R"), "right").otherwise("left")
    floating = F.concat(F.lit('<Figure float="'), side, F.lit('">\n  '), _image(F.col("src"), F.col("caption")), F.lit("\n"), _caption(F.col("caption")), F.lit("</Figure>"))
    grid = F.concat(F.lit("<FigureGrid"), _attribute("id", F.col("label")), F.lit(">\n"), F.array_join(F.transform("parts", lambda p: F.concat(F.lit("  "), one(p["src"], p["caption"], p["label"]), F.lit("\n"))), ""), _caption(F.col("caption")), F.lit("</FigureGrid>"))
    return out.withColumn("mdx", F.when(F.col("kind") == "wrapfigure", floating).when(single, one(F.col("src"), F.col("caption"), F.col("label"))).otherwise(grid))


def drawings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, code, caption): TikZ drawings of LaTeX texts, with a caption in the 500 characters behind."""
    groups = F.arrays_zip(rx.every(F.col(text), DRAWING, 1).alias("c"), rx.every(F.col(text), DRAWING, 2).alias("n"))
    out = df.select(key, F.posexplode(groups).alias("pos", "g"))
    return out.select(key, F.col("pos").cast("bigint").alias("pos"), trimmed(F.col("g.c")).alias("code"), F.regexp_extract("g.n", r"\\caption\{([^}]+)\}", 1).alias("caption"))


def with_drawings(mdx: Column, pictures: Column) -> Column:
    """Drawings of an MDX text replaced by the pictures at their numbers in the array ``pictures``; those without one stay."""
    hits, parts = rx.every(mdx, DRAWN, 0), rx.gaps(mdx, DRAWN)
    shown = F.transform(hits, lambda h, i: F.coalesce(F.concat(F.lit('<Image src="'), F.get(pictures, i), F.lit('" alt="" />')), h))
    return F.array_join(F.zip_with(parts, F.concat(shown, F.array(F.lit(""))), lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit("")))), "")
