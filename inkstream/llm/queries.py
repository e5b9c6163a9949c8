"""Queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import format_copies, garbling, languages, lookalikes, markup, mixing, names, packing, shared_spans, staging, tokens
from inkstream.sources.tables import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that repeat an earlier one but for formatting, with that one."""
    return format_copies.later_copies(table(spark, sf_dir, "bib_entries"), "bib_id")


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct entry and the number of its copies."""
    return format_copies.copies(table(spark, sf_dir, "bib_entries"), "bib_id")


def _pair_model(spark: SparkSession, sf_dir: str) -> garbling.PairModel:
    """Pair statistics of all documents, whose texts are the corpus."""
    return garbling.PairModel.fit(spread(table(spark, sf_dir, "documents").select("text")), "text")


def _text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "nodes").where("kind = 'text'").select("node_uid", "content", "parsed_at"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes with garbled content."""
    return garbling.garbled(_text_nodes(spark, sf_dir), "node_uid", "content", _pair_model(spark, sf_dir)).select("node_uid").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each garbled text node with its text restored as far as possible, and the encodings its runs declared."""
    nodes = table(spark, sf_dir, "nodes").where("kind = 'text'")
    found = garbling.garbled(_text_nodes(spark, sf_dir), "node_uid", "content", _pair_model(spark, sf_dir))
    found = found.groupBy("node_uid").agg(F.max(F.struct("original", "restored", "complete")).alias("r"))
    declared = table(spark, sf_dir, "proc_contexts").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.lower(F.trim("encoding")))).alias("declared"))
    docs = nodes.select("node_uid", "doc_id").distinct()
    return found.join(docs, "node_uid").join(declared, "doc_id", "left").select("node_uid", "r.original", "r.restored", "r.complete", "declared")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, text nodes and names with characters that look like, or hide behind, the ordinary ones."""
    model = spark.sparkContext.broadcast(_pair_model(spark, sf_dir))
    titles = spread(table(spark, sf_dir, "doc_metadata").select("meta_id", "title"))
    names = spread(table(spark, sf_dir, "author_infos").select("author_id", "name"))
    return (
        lookalikes.variants(titles, "meta_id", "title", "doc_metadata.title")
        .unionByName(lookalikes.variants(_text_nodes(spark, sf_dir), "node_uid", "content", "nodes.content", restorer=model))
        .unionByName(lookalikes.variants(names, "author_id", "name", "author_infos.name", name=True))
    )


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form and the comparison key of every title, text node and name."""
    return (
        lookalikes.normalised(spread(table(spark, sf_dir, "doc_metadata").select("meta_id", "title")), "meta_id", "title", "doc_metadata.title")
        .unionByName(lookalikes.normalised(_text_nodes(spark, sf_dir), "node_uid", "content", "nodes.content"))
        .unionByName(lookalikes.normalised(spread(table(spark, sf_dir, "author_infos").select("author_id", "name")), "author_id", "name", "author_infos.name", name=True))
    )


def _mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, names.GivenNames]:
    """Rows (mention, name, contact): persons and organisations named in author_infos and in entries with one author."""
    people = table(spark, sf_dir, "author_infos").select(F.concat(F.lit("a"), "author_id").alias("mention"), "name", "name_en", F.regexp_extract(F.lower("email"), r"^\s*([^@\s]+)@", 1).alias("contact"))
    people = people.withColumn("contact", F.when(F.col("contact") != "", F.col("contact"))).withColumn("name", F.explode(F.array("name", "name_en"))).drop("name_en")
    people = people.where("name is not null and trim(name) <> ''")
    entries = names.single_authors(spread(table(spark, sf_dir, "bib_entries").select("bib_id", "author")))
    rows = table(spark, sf_dir, "given_names").orderBy("name_id").select("given", "short_form", "latin_form").limit(names.GIVEN_ROWS + 1).collect()  # one row too many is an error
    return people.unionByName(entries.withColumn("contact", F.lit(None).cast("string"))), names.GivenNames([tuple(r) for r in rows])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of mentions of one person or organisation."""
    return names.pairs(names.linked(*_mentions(spark, sf_dir)))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every mention, named by its smallest mention, and its size."""
    return names.entities(names.linked(*_mentions(spark, sf_dir)))


def _marked_up(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, str, str]]:
    """(rows, key, text, field) of every table that holds markup. Bodies have the name of their environment."""
    bodies = table(spark, sf_dir, "nodes").where("kind = 'environment'")
    return [
        (_text_nodes(spark, sf_dir), "node_uid", "content", "nodes.content"),
        (spread(bodies.select("node_uid", "body", "name")), "node_uid", "body", "nodes.body"),
        (spread(table(spark, sf_dir, "chapters").select("chapter_id", "mdx_content")), "chapter_id", "mdx_content", "chapters.mdx_content"),
    ]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of markup in text nodes, environment bodies and chapters."""
    texts, (bodies, *how), chapters = _marked_up(spark, sf_dir)
    bodies = bodies.where(~F.coalesce(F.col("name"), F.lit("")).isin(*markup.OPAQUE_ENVIRONMENTS))
    a, b, c = (markup.markup_kinds(*x) for x in (texts, (bodies, *how), chapters))
    return a.unionByName(b).unionByName(c)


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values, and code and formulas in environments, as clean text."""
    texts, bodies, chapters = _marked_up(spark, sf_dir)
    a, b, c = markup.cleaned(*texts), markup.cleaned(*bodies, environment="name"), markup.cleaned(*chapters)
    return a.unionByName(b).unionByName(c)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing or wrong labels with the right language, and the languages of mixed text nodes."""
    model = languages.fit_on(table(spark, sf_dir, "lang_samples"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    detected = languages.document_languages(spread(docs.select("doc_id", "text")), "doc_id", "text", model)
    # labels of documents and of their metadata are gathered first, so that texts are classified once
    meta = table(spark, sf_dir, "doc_metadata").select("doc_id", F.lit("doc_metadata.lang").alias("field"), F.col("meta_id").alias("row_id"), languages.label(F.col("lang")).alias("named"))
    labels = docs.select("doc_id", F.lit("documents.lang").alias("field"), F.col("doc_id").alias("row_id"), languages.label(F.col("lang")).alias("named")).unionByName(meta)
    by_doc = labels.join(detected.where("detected is not null"), "doc_id").where("named is null or named <> detected").select("field", "row_id", F.col("detected").alias("lang"))
    bib = spread(table(spark, sf_dir, "bib_entries").select("bib_id", "title", "language"))
    titles = languages.short_text_languages(bib.select(F.struct("bib_id", "language").alias("k"), "title"), "k", "title", model)
    named = languages.label(F.col("k.language"))
    by_title = titles.where(F.col("detected").isNotNull() & (named.isNull() | (named != F.col("detected")))).select(F.lit("bib_entries.language").alias("field"), F.col("k.bib_id").alias("row_id"), F.col("detected").alias("lang"))
    nodes = languages.mixed_segments(_text_nodes(spark, sf_dir), "node_uid", "content", model).select(F.lit("nodes.content").alias("field"), F.col("node_uid").alias("row_id"), "lang")
    return by_doc.unionByName(by_title).unionByName(nodes).distinct()


def p7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, detected, confidence): the language of every document, of its metadata and of the title of every entry; null and 0 if there is none.

    Metadata have the language of their document's text; a record that is delivered twice comes out once.
    """
    model = languages.fit_on(table(spark, sf_dir, "lang_samples"))
    docs = languages.document_languages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", model)
    titles = languages.short_text_languages(spread(table(spark, sf_dir, "bib_entries").select("bib_id", "title")), "bib_id", "title", model)
    titles = titles.withColumn("confidence", F.when(F.col("detected").isNull(), 0.0).otherwise(F.col("confidence")))
    meta = table(spark, sf_dir, "doc_metadata").select("doc_id", F.col("meta_id").alias("row_id"), F.lit("doc_metadata.lang").alias("field")).distinct()
    # texts are classified once, for a document and its metadata
    of_docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("row_id"), F.lit("documents.lang").alias("field")).unionByName(meta).join(docs, "doc_id", "left")
    of_docs = of_docs.select("field", "row_id", "detected", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return of_docs.unionByName(titles.select(F.lit("bib_entries.language").alias("field"), F.col("bib_id").alias("row_id"), "detected", "confidence"))


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every text node with its position, place, language and confidence."""
    model = languages.fit_on(table(spark, sf_dir, "lang_samples"))
    return languages.segment_languages(_text_nodes(spark, sf_dir), "node_uid", "content", model).distinct()


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document, written once: the tokenizer runs over each text one time."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return staging.written(tokens.sizes(docs, "doc_id", "text", also=("source",)))


def _specs(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    rows = table(spark, sf_dir, "pack_specs").where("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").collect()
    return sorted((int(a), int(b)) for a, b in rows)


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, float, int]]:
    return [tuple(r) for r in table(spark, sf_dir, "mix_targets").select("mix_id", "source", "target_share", "max_repeats").collect()]


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of its pieces, for each capacity."""
    return packing.pack(_sizes(spark, sf_dir), _specs(spark, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their lower bound and the unused share for each capacity."""
    sizes, specs = _sizes(spark, sf_dir), _specs(spark, sf_dir)
    return packing.report(packing.pack(sizes, specs), sizes, specs)


def p8_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and lower bound of every partition in every round of exchange."""
    return packing.certificates(_sizes(spark, sf_dir), _specs(spark, sf_dir))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents of each mix in reading order."""
    return mixing.mix(_sizes(spark, sf_dir), _targets(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    targets = _targets(spark, sf_dir)
    return mixing.shares(mixing.mix(_sizes(spark, sf_dir), targets), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a string of 200 or more characters in common."""
    return shared_spans.linked_pairs(spread(shared_spans.of_table(spark, table(spark, sf_dir, "documents"))))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared with others."""
    return shared_spans.shared_amounts(spread(shared_spans.of_table(spark, table(spark, sf_dir, "documents"))))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of each document that shares a span."""
    return shared_spans.linked_classes(spread(shared_spans.of_table(spark, table(spark, sf_dir, "documents"))))


QUERIES = {
    "p1_found": p1_found,
    "p1_copies": p1_copies,
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_found": p7_found,
    "p7_languages": p7_languages,
    "p7_segments": p7_segments,
    "p8_packed": p8_packed,
    "p8_report": p8_report,
    "p8_certificates": p8_certificates,
    "p9_mixed": p9_mixed,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_shared": p10_shared,
    "p10_classes": p10_classes,
}

_P1 = """WITH c AS (SELECT bib_id, {canon} FROM bib_entries),
g AS (SELECT DISTINCT bib_id, min(bib_id) OVER (PARTITION BY title, author, year, doi) AS first_bib_id FROM c)
""".format(canon=", ".join(f"regexp_replace(replace(lower(upper(coalesce({c}, ''))), 'ß', 'ss'), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS {c}" for c in ("title", "author", "year", "doi")))

SQL = {
    "p1_found": _P1 + "SELECT first_bib_id, bib_id FROM g WHERE first_bib_id <> bib_id",
    "p1_copies": _P1 + "SELECT first_bib_id, count(DISTINCT bib_id) AS n_copies FROM g GROUP BY first_bib_id",
}
