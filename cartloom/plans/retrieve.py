"""Product retrieval by vector, and the document and vector builds behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartloom.operators.vectors import vector_search
from cartloom.sources import documents as store
from cartloom.operators.lookup import build_documents

RETRIEVED = 15


def retrieve(query_vectors: DataFrame, product_vectors: DataFrame, k: int = RETRIEVED) -> DataFrame:
    """Nearest products per query, ``(query_id, rank, product_id, score)``.

    ``query_vectors`` holds ``(query_id, embedding)``, ``product_vectors``
    ``(product_id, embedding)``.
    """
    vectors = product_vectors.select(F.col("product_id").alias("vec_id"), "embedding")
    return vector_search(query_vectors, vectors, k).withColumnRenamed("vec_id", "product_id")


def search_documents(
    query_vectors: DataFrame, product_vectors: DataFrame, documents: DataFrame, k: int = 5
) -> DataFrame:
    """Nearest products per query with the text of their document."""
    return retrieve(query_vectors, product_vectors, k).join(documents, "product_id").select(
        "query_id", "rank", "product_id", "text", "score"
    )


def build_store(
    products: DataFrame, velocity: DataFrame, vectors: DataFrame, docs_path: str, vectors_path: str
) -> DataFrame:
    """Write the documents, then the vector table over them; returns the load report."""
    spark = products.sparkSession
    store.write_documents(build_documents(products, velocity), docs_path)
    return store.rebuild_vectors(store.read_documents(spark, docs_path), vectors, vectors_path)
