"""BibTeX: entries of a text as rows, and their citation and reference styles.

All native expressions: one narrow pass for parsing and formatting. The section
of references is one aggregation by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import persian, rx

#: An entry, which ends with a brace on a line of its own; a field in braces (one level inside) or quotation marks; and the commands that cite.
ENTRY = r"(?s)@([A-Za-z0-9_]+)[ \t\r\n]*\{[ \t\r\n]*([^, \t\r\n]+)[ \t\r\n]*,[ \t\r\n]*(.*?)\n\}"
FIELD = r"([A-Za-z0-9_]+)[ \t\r\n]*=[ \t\r\n]*(\{(?:[^{}]|\{[^{}]*\})*\}|\"[^\"]*\")"
FIELDS = ("author", "title", "year", "publisher", "journal", "volume", "pages", "url", "doi")
CITE = r"\\(citep|citet|cite)(?![a-z])(?:\[([^\]]*)\])?\{([^}]+)\}"
#: Headings of the section of references.
HEADING, PERSIAN_HEADING, OTHER_HEADING = "## کتاب‌نامه", "### منابع فارسی", "### منابع انگلیسی"


def peeled(value: Column) -> Column:
    """F32: ``value`` without its quotation marks, and without all pairs of braces around it."""
    def once(v: Column) -> Column:
        v = F.regexp_replace(v, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
        return F.when(v.startswith("{") & v.endswith("}") & (F.length(v) > 1), F.substring(v, 2, F.length(v) - 2)).otherwise(v)

    quoted = F.when(value.startswith('"'), F.substring(value, 2, F.length(value) - 2)).otherwise(value)
    # a field has two levels of braces at most
    return rx.let(rx.let(rx.let(quoted, once), once), once)


def language(title: Column, author: Column) -> Column:
    """Fa if more than three tenths of the letters are Persian."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(author, F.lit("")))
    letters, fa = rx.count(text, r"\p{L}"), rx.count(text, persian.PERSIAN)
    return F.when((letters > 0) & (fa / F.when(letters > 0, letters) > 0.3), "fa").otherwise("en")


def entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, entry_id, entry_type, the FIELDS, language, raw_fields): entries of BibTeX texts.

    Fields that an entry lacks are empty; of a repeated field the last counts.
    Unquoted values are left out. Null and empty texts have no entries.
    """
    kinds, names, bodies = (rx.every(F.col(text), ENTRY, i) for i in (1, 2, 3))
    out = df.select(key, F.posexplode(F.arrays_zip(kinds.alias("kind"), names.alias("name"), bodies.alias("body"))).alias("pos", "e"))
    keys = F.transform(rx.every(F.col("e.body"), FIELD, 1), F.lower)
    values = F.transform(rx.every(F.col("e.body"), FIELD, 2), peeled)
    out = out.select(key, F.col("pos").cast("bigint").alias("pos"), F.col("e.name").alias("entry_id"), F.lower("e.kind").alias("entry_type"), F.arrays_zip(keys.alias("k"), values.alias("v")).alias("f"))
    one = lambda name: F.coalesce(F.try_element_at(F.filter("f", lambda x: x["k"] == name), F.lit(-1))["v"], F.lit(""))
    out = out.select(key, "pos", "entry_id", "entry_type", *(one(n).alias(n) for n in FIELDS), F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.transform("f", lambda x: x["k"])), lambda k: F.struct(k, F.element_at(F.filter("f", lambda x: x["k"] == k), -1)["v"])))).alias("raw_fields"))
    return out.withColumn("language", language(F.col("title"), F.col("author")))


def exported(kind: Column, name: Column, fields: dict[str, Column]) -> Column:
    """An entry as BibTeX text; fields that are null or empty are left out."""
    lines = F.array(*(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"  {k} = {{"), v, F.lit("}"))) for k, v in fields.items()))
    return F.concat(F.lit("@"), kind, F.lit("{"), name, F.lit(",\n"), F.array_join(F.filter(lines, lambda x: x.isNotNull()), ",\n"), F.lit("\n}\n"))


def author_short(author: Column) -> Column:
    """the family name of the first author; ? if there is none."""
    first = F.trim(F.element_at(F.split(F.coalesce(author, F.lit("")), " and "), 1))
    family = F.when(first.contains(","), F.trim(F.split_part(first, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(first, r"[ \t\r\n]+"), -1))
    return F.when(F.coalesce(family, F.lit("")) == "", "?").otherwise(family)


def cite_label(author: Column, year: Column) -> Column:
    """family name and year; n.d. without a year."""
    return F.concat(author_short(author), F.lit(", "), F.coalesce(F.nullif(year, F.lit("")), F.lit("n.d.")))


def _joined(*parts: tuple[Column, str, str]) -> Column:
    shown = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(a), v, F.lit(b))) for v, a, b in parts]
    return F.concat_ws(" ", *shown)


def apa(e: dict[str, Column]) -> Column:
    """F34."""
    return _joined((e["author"], "", ""), (e["year"], "(", ")."), (e["title"], "*", "*."), (e["journal"], "", "."), (e["publisher"], "", "."), (e["url"], "", ""))


def ieee(e: dict[str, Column]) -> Column:
    """F34."""
    return _joined((e["author"], "", ","), (e["title"], '"', '",'), (e["journal"], "*", "*,"), (e["volume"], "vol. ", ","), (e["pages"], "pp. ", ","), (e["year"], "", "."), (e["url"], "", ""))


def reference_lines(df: DataFrame, style: str = "apa") -> DataFrame:
    """``df`` (entry_id and the FIELDS) with the column line: an entry with its anchor as the section of references shows it."""
    e = {n: F.col(n).cast("string") for n in FIELDS}
    return df.withColumn("line", F.concat(F.lit('<span id="ref-'), F.col("entry_id"), F.lit('"></span> '), apa(e) if style == "apa" else ieee(e)))


def sections(df: DataFrame, key: str, pos: str, style: str = "apa") -> DataFrame:
    """(key, mdx): the section of references of each document, Persian entries first, both in the order of ``pos``.

    A document's entries are bounded by its own length. Null languages count as others.
    """
    lines = reference_lines(df, style).withColumn("__fa", F.coalesce(F.col("language") == "fa", F.lit(False)))
    sorted_lines = lambda fa: F.transform(F.array_sort(F.collect_list(F.when(F.col("__fa") == fa, F.struct(F.col(pos).alias("p"), "line")))), lambda x: x["line"])
    out = lines.groupBy(key).agg(sorted_lines(True).alias("fa"), sorted_lines(False).alias("other"))
    part = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, "\n\n"), F.lit("\n")))
    both = F.when(F.size("fa") > 0, F.concat(F.lit(f"{PERSIAN_HEADING}\n\n"), F.array_join("fa", "\n\n"), F.lit("\n")))
    rest = F.when(F.size("fa") > 0, part(f"{OTHER_HEADING}\n\n", F.col("other"))).otherwise(part("", F.col("other")))
    return out.select(key, F.concat(F.lit(f"{HEADING}\n\n"), F.concat_ws("\n", both, rest)).alias("mdx"))


def cited(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, command, option, ordinal, cite_key): one row for each cited key of each citing command."""
    groups = F.arrays_zip(*(rx.every(F.col(text), CITE, i).alias(n) for i, n in ((1, "command"), (2, "option"), (3, "keys"))))
    out = df.select(key, F.posexplode(groups).alias("pos", "c"))
    out = out.select(key, "pos", "c.command", F.coalesce("c.option", F.lit("")).alias("option"), F.posexplode(F.filter(F.transform(F.split("c.keys", ","), lambda k: F.trim(k)), lambda k: k != "")).alias("ordinal", "cite_key"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("pos", "ordinal")})


def rendered_citations(cites: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, pos, mdx): every citing command of :func:`cited` as links to its entries (key, entry_id, author, year).

    A key without an entry is shown itself. Of several entries of one id the
    one with the smallest author and year counts.
    """
    known = entries.groupBy(key, F.col("entry_id").alias("cite_key")).agg(F.min(F.struct(F.coalesce("author", F.lit("")).alias("author"), F.coalesce("year", F.lit("")).alias("year"))).alias("e"))
    rows = cites.join(known, [key, "cite_key"], "left")
    link = F.concat(F.lit("](#ref-"), F.col("cite_key"), F.lit(")"))
    label = F.when(F.col("e").isNull(), F.col("cite_key")).otherwise(cite_label(F.col("e.author"), F.col("e.year")))
    label = F.when(F.col("option") != "", F.concat(label, F.lit(", "), F.col("option"))).otherwise(label)
    name = F.when(F.col("e").isNull(), F.col("cite_key")).otherwise(author_short(F.col("e.author")))
    year = F.when(F.col("e").isNull(), "").otherwise(F.coalesce(F.nullif(F.col("e.year"), F.lit("")), F.lit("n.d.")))
    textual = F.concat(name, F.lit(" [("), year, F.lit(")"), link, F.when(F.col("option") != "", F.concat(F.lit(" "), F.col("option"))).otherwise(F.lit("")))
    rows = rows.withColumn("__m", F.when(F.col("command") == "citet", textual).otherwise(F.concat(F.lit("["), label, link)))
    # a command's keys are bounded by its own length
    out = rows.groupBy(key, "pos", "command").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "__m"))), lambda x: x["__m"]), "; ").alias("m"))
    return out.select(key, "pos", F.when(F.col("command") == "citep", F.concat(F.lit("("), F.col("m"), F.lit(")"))).otherwise(F.col("m")).alias("mdx"))
