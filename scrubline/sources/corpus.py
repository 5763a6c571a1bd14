"""The text corpus the registered queries scan: documents, decoded web pages
and the derived customer records, keyed by ``(src, doc_id)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import balance
from .tables import customer_records, documents, pages


def corpus(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = ("documents", "pages", "records"),
           balanced: bool = True) -> DataFrame:
    texts, dfs = [], []
    if "documents" in parts:
        texts.append(documents(spark, sf_dir).select(F.lit("documents").alias("src"), "doc_id", "text"))
    if "pages" in parts:
        texts.append(pages(spark, sf_dir).select(F.lit("pages").alias("src"), "doc_id", "text"))
    if texts:
        stored = reduce(DataFrame.unionByName, texts)
        dfs.append(balance(stored) if balanced else stored)
    if "records" in parts:  # dealt before they are made
        dfs.append(customer_records(spark, sf_dir).select(F.lit("records").alias("src"), "doc_id", "text"))
    return reduce(DataFrame.unionByName, dfs)
