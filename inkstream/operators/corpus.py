"""Corpus operators: structure, dependencies, chapters, reports and deployment (J, G, W, O, U, K, V10, S23)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstream.functions import rx
from inkstream.sources.staging import written

#: Commands by which a LaTeX file names another one.
DEPENDENCIES = {"input": r"\\input\{([^}]+)\}", "include": r"\\include\{([^}]+)\}", "bib": r"\\(?:bibliography|addbibresource)\{([^}]+)\}", "image": r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}", "package": r"\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}"}


def dependencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, target) edges of every file."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(rx.every(F.col(text), pattern, 1), lambda t: F.struct(F.lit(kind).alias("kind"), F.trim(t).alias("target")))

    pairs = F.concat(*(found(k, p) for k, p in DEPENDENCIES.items()))
    return df.select(key, F.inline(pairs))


def reachable(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(src, dst, depth) of everything that is reached over ``edges`` (src, dst), or in ``rounds`` steps at most.

    Each pair has its least depth; cycles end because a pair that is known
    isn't followed again. Every step's new pairs are written to the shared
    folder; it ends when there are none.
    """
    edges = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = edges.withColumn("depth", F.lit(1))
    frontier = seen
    for depth in count(2) if rounds is None else range(2, rounds + 1):
        step = frontier.select("src", F.col("dst").alias("via")).join(edges.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()
        frontier = written(step.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


#: Levels of files inside files that are inlined.
MOST_INPUTS = 10
_INPUT = r"\\(?:input|include)[ \t]*\{([^}]+)\}"


def inlined(files: DataFrame, path: str, text: str, where: Column | None = None) -> DataFrame:
    """``files`` with every input and include replaced by the file that it names, MOST_INPUTS levels deep.

    Names are relative to the folder of the file that is read; .tex is added
    where it lacks. The command of a missing file stays, as does one of a file
    inside itself beyond the last level. Only files that name others are
    joined, with the texts that they name; it ends when none is left. ``path``
    is unique.
    """
    files = files.withColumn("__in", rx.has(F.col(text), _INPUT) & (where if where is not None else F.lit(True)))
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)

    def target(name: Column, base: Column) -> Column:
        name = F.trim(name)
        return F.concat(base, F.when(name.endswith(".tex"), name).otherwise(F.concat(name, F.lit(".tex"))))

    open_ = written(files.where("__in").select(F.col(path).alias("__p"), folder.alias("__f"), F.col(text).alias("__t")))
    if not open_.take(1):
        return files.drop("__in")
    sources = files.select(F.col(path).alias("__target"), F.col(text).alias("__child"))
    for _ in range(MOST_INPUTS):
        named = open_.select("__p", F.explode(F.array_distinct(F.transform(rx.every(F.col("__t"), _INPUT, 1), lambda n: target(n, F.col("__f"))))).alias("__target"))
        found = named.join(sources, "__target").groupBy("__p").agg(F.map_from_entries(F.collect_list(F.struct("__target", F.coalesce("__child", F.lit("")).alias("c")))).alias("__m"))
        # as many texts as the file names
        spliced = rx.splice(F.col("__t"), _INPUT, fix_match=lambda m: F.coalesce(F.element_at(F.col("__m"), target(F.regexp_extract(m, _INPUT, 1), F.col("__f"))), m))
        new = open_.join(found, "__p", "left").select("__p", "__f", F.when(F.col("__m").isNotNull(), spliced).otherwise(F.col("__t")).alias("__t"), F.col("__m").isNotNull().alias("__more"))
        open_ = written(new)
        if not open_.where("__more").take(1):
            break
    done = open_.select(F.col("__p").alias(path), F.col("__t").alias("__new"))
    # the others don't move
    rest, joined = files.where("not __in"), files.where("__in").join(done, path)
    return rest.drop("__in").unionByName(joined.withColumn(text, F.col("__new")).drop("__in", "__new"))


def cross_references(chapters: DataFrame, doc: str, chapter: str, slug: str, text: str) -> DataFrame:
    """``chapters`` with the references to labels of other chapters of their document as links to those chapters.

    A label belongs to the chapter that defines it (the last one by ``chapter``
    if several do). References in the chapter itself, and to labels that no
    chapter has, stay.
    """
    label = r"\\label\{([^}]+)\}|\{#([^}\s]+)\}|id=[\"']([^\"']+)[\"']"
    defined = chapters.select(doc, chapter, F.col(slug).alias("__slug"), F.explode(F.array_distinct(F.filter(F.flatten(F.array(*(rx.every(F.col(text), label, i) for i in (1, 2, 3)))), lambda x: x != ""))).alias("__label"))
    defined = defined.withColumn("__label", F.regexp_replace("__label", "[^a-zA-Z0-9-]", "-"))
    owner = defined.groupBy(doc, "__label").agg(F.max_by("__slug", chapter).alias("__to"), F.max(chapter).alias("__own"))
    used = r"<CrossRef target=\"([^\"]+)\"(?: type=\"equation\")? />"
    refs = chapters.select(doc, chapter, F.explode(F.array_distinct(rx.every(F.col(text), used, 1))).alias("__label"))
    known = refs.join(owner, [doc, "__label"]).where(F.col(chapter) != F.col("__own"))
    known = known.groupBy(doc, chapter).agg(F.map_from_entries(F.collect_list(F.struct("__label", "__to"))).alias("__links"))  # as many as the chapter has references

    def link(m: Column) -> Column:
        name = F.regexp_extract(m, used, 1)
        return F.when(F.element_at(F.col("__links"), name).isNotNull(), F.concat(F.lit("["), name, F.lit("](../"), F.element_at(F.col("__links"), name), F.lit("#"), name, F.lit(")"))).otherwise(m)

    out = chapters.join(known, [doc, chapter], "left")
    return out.withColumn(text, F.when(F.col("__links").isNotNull(), rx.splice(F.col(text), used, fix_match=link)).otherwise(F.col(text))).drop("__links")


def project_structure(files: DataFrame) -> DataFrame:
    """Structure, main format and main entry of every project of ``files`` (project_id, doc_id, path, source_format, lang, is_book)."""
    by_format = files.groupBy("project_id", "source_format").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("is_book").alias("is_book"))
    p = by_format.groupBy("project_id").agg(
        F.sum("n").alias("n_files"),
        F.count("*").alias("n_formats"),
        F.max_by("source_format", F.struct("n", -F.col("first"))).alias("main_format"),
        F.max("is_book").alias("has_book"),
    )
    main = files.groupBy("project_id").agg(F.min_by("path", F.struct((~F.col("is_book")).cast("int").alias("rank"), "doc_id")).alias("main_entry"))
    structure = F.when(F.col("n_files") <= 1, "single_doc").when(F.col("has_book") & (F.col("main_format") == "latex"), "multi_chapter_book").when(F.col("n_formats") == 1, "independent_articles").otherwise("related_collection")
    return p.join(main, "project_id").select("project_id", "n_files", "n_formats", "main_format", structure.alias("structure"), "main_entry")


def split_chapters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chapter_no, title, n_chars) of a LaTeX text split at its chapters.

    What stands before the first chapter is left out; a text without chapters
    is chapter 0; empty chapters are left out.
    """
    pieces = F.split(F.col(text), r"\\chapter\*?\{", -1)
    parts = df.select(key, F.size(pieces).alias("__n"), F.posexplode(pieces).alias("chapter_no", "__t")).where("__n = 1 or chapter_no > 0")
    title = F.when(F.col("__n") > 1, F.regexp_extract("__t", r"^([^}]*)\}", 1)).otherwise("")
    body = F.when(F.col("__n") > 1, F.regexp_replace("__t", r"^[^}]*\}", "")).otherwise(F.col("__t"))
    out = parts.select(key, F.col("chapter_no").cast("bigint").alias("chapter_no"), title.alias("title"), F.length(F.regexp_replace(body, r"^[ \t\n\r]+|[ \t\n\r]+$", "")).cast("bigint").alias("n_chars"))
    return out.where("n_chars > 0")


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The last delivered row of each key; ties on ``at`` are broken by the whole row.

    By aggregation, not a window: rows are reduced before the shuffle.
    """
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(at), F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))).alias("r")).select("r.*")


def numbered(df: DataFrame, keys: list[str], order: str, name: str, width: int = 100_000) -> DataFrame:
    """``df`` with ``name``: the number, from 0, of each row among those of its ``keys`` in the order of the integer column ``order``, which is unique.

    No task orders a whole key: rows are numbered within stretches of ``width``
    values, and the sizes of stretches, of which there are few, give each one's
    start.
    """
    df = df.withColumn("__stretch", F.floor(F.col(order) / width))
    sizes = df.groupBy(*keys, "__stretch").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*keys).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__stretch", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(W.partitionBy(*keys, "__stretch").orderBy(order)) - 1
    return df.withColumn("__within", within).join(starts, [*keys, "__stretch"]).withColumn(name, F.col("__start") + F.col("__within")).drop("__stretch", "__start", "__within")


def collision_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``df`` with ``target``: the second file of a name gets _1 and so on, in the order of the integer column ``order``."""
    stem, ext = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)
    out = numbered(df, [name], order, "__number")
    return out.withColumn("target", F.when(F.col("__number") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("__number").cast("string"), ext))).drop("__number")


def deploy_path(framework: str, slug: Column) -> Column:
    """Where a framework keeps the page of a slug."""
    base = {"next": "content", "astro": "src/content", "gatsby": "content", "docusaurus": "docs"}[framework]
    return F.concat(F.lit(f"{base}/"), slug, F.lit(".mdx" if framework == "docusaurus" else "/index.mdx"))
