"""Sinks: MDX pages, reports and exports."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def with_bom(text: Column) -> Column:
    """One byte-order mark at the start."""
    return F.concat(F.lit(BOM), F.regexp_replace(text, f"^{BOM}+", ""))


def page(frontmatter: Column, imports: Column, body: Column) -> Column:
    """Frontmatter, imports if there are any, body, each behind an empty line, and a last line break."""
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.concat(F.concat_ws("\n\n", F.nullif(frontmatter, F.lit("")), F.nullif(imports, F.lit("")), trimmed), F.lit("\n"))


def write_pages(df: DataFrame, root: str, path: str, text: str, dry_run: bool = False) -> DataFrame:
    """Writes each row's ``text`` to ``root``/``path`` from the executors; (path, n_bytes, status).

    ``root`` must be a folder that all executors share. A path that leaves
    ``root`` isn't written. Evaluate the result once: the write happens with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, status = [], []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (t or "").lstrip(BOM).encode("utf-8-sig")
                sizes.append(len(raw))
                target = os.path.normpath(os.path.join(root, p or ""))
                if not p or not target.startswith(os.path.normpath(root) + os.sep):
                    status.append("unsafe")
                elif dry_run:
                    status.append("dry")
                else:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(f"{target}.{os.getpid()}.part", "wb") as out:
                        out.write(raw)
                    os.replace(f"{target}.{os.getpid()}.part", target)  # a repeated task writes the same bytes
                    status.append("written")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(status, pa.string())], names=["path", "n_bytes", "status"])

    return df.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, "path string, n_bytes bigint, status string")


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A table as JSON lines, CSV or Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)
