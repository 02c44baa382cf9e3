"""The façade: an index of vectors and their graph, and searches by similarity, curvature mix or shortest path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.encoders import Encoder, encode_corpus, load_encoder
from lodestar.operators import graph, knn
from lodestar.sources.tables import cut, in_memory, load_index, save_index, save_report


class GeoIndex:
    """embeddings (vec_id, embedding), their graph, and the corpus (doc_id, text) that they stand for, if given."""

    def __init__(self, embeddings: DataFrame, k_graph: int = 10, metric: str = "cosine", edges: DataFrame | None = None, corpus: DataFrame | None = None):
        self.embeddings, self.corpus = embeddings, corpus
        self.edges = edges if edges is not None else cut(knn.knn_edges(embeddings, k_graph, metric), "edges")[0]
        self._kappa = None

    @classmethod
    def build(cls, encoder: Encoder, corpus: DataFrame, k: int = 10, metric: str = "cosine") -> GeoIndex:
        """Encode corpus (doc_id, text), and link its vectors."""
        return cls(cut(encode_corpus(encoder, corpus), "embeddings")[0], k, metric, corpus=corpus)

    def kappa(self) -> DataFrame:
        if self._kappa is None:
            self._kappa, _ = cut(graph.curvature(self.edges, "forman"), "kappa")
        return self._kappa

    def audit(self, curvature: bool = True) -> DataFrame:
        """src, dst, kappa of every edge; no rows if curvature isn't asked for."""
        return self.kappa() if curvature else self.kappa().limit(0)

    def node_curvature(self) -> DataFrame:
        return graph.node_curvature(self.kappa(), self.embeddings.select(F.col("vec_id").alias("id")))

    def distances(self) -> DataFrame:
        """src, dst, dist: shortest paths between all nodes; for bounded sets."""
        return graph.paths_between(self.edges, self.embeddings.select(F.col("vec_id").alias("id")))

    def search(self, queries: DataFrame, k: int = 10, metric: str = "cosine", alpha: float | None = None, mix_kappa: float = 0.0, search_k: int = 1000, connect_k: int = 10) -> DataFrame:
        """queries (qid, qvec). cosine, curvature and mix rank by (1 - alpha) score + alpha kappa, or, without an alpha,
        by score + mix_kappa kappa; alpha = 1 ranks by kappa alone, alpha = 0 by score. geodesic ranks by shortest
        distance among search_k candidates."""
        metric = metric.lower()
        if k < 0:
            raise ValueError("k must not be negative")
        if alpha is not None and not 0 <= alpha <= 1:
            raise ValueError("alpha must be from 0 to 1")
        if metric == "geodesic":
            return graph.geodesic(cut(knn.topk(self.embeddings, queries, search_k), "candidates")[0], self.edges, k, connect_k)
        if metric not in ("cosine", "curvature", "mix"):
            raise ValueError(f"unknown metric {metric!r}")
        weight = mix_kappa if alpha is None else alpha
        if not weight:
            return knn.topk(self.embeddings, queries, k)
        # Curvature travels with the vectors, so blocks rank by the mixed score and only k of each go on.
        mixed = self.embeddings.join(self.node_curvature().select(F.col("id").alias("vec_id"), (weight * F.col("kappa_avg")).alias("bias")), "vec_id")
        return knn.topk(mixed, queries, k, scale=1.0 if alpha is None else 1 - alpha, bias="bias")

    def _texts(self) -> DataFrame:
        return self.corpus if self.corpus is not None else in_memory(self.embeddings.sparkSession, [])

    def save(self, path: str, corpus: DataFrame | None = None) -> str:
        return save_index(path, corpus if corpus is not None else self._texts(), self.embeddings, self.edges)

    def save_report(self, name: str, folder: str = ".") -> str:
        return save_report(self.embeddings, self._texts(), name, folder)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GeoIndex:
        tables = load_index(spark, path)
        return cls(tables["embeddings"], edges=tables["edges"], corpus=tables["corpus"])


class Retriever:
    """Text in, documents out: an encoder and, once index() has run, a GeoIndex."""

    def __init__(self, spark: SparkSession, encoder: Encoder | str = "hashing"):
        self.spark = spark
        self.encoder = load_encoder(encoder) if isinstance(encoder, str) else encoder
        self.index_: GeoIndex | None = None

    def index(self, corpus: DataFrame | list[str], k_graph: int = 10, metric_graph: str = "cosine") -> Retriever:
        """corpus: doc_id and text, or a list of texts, which are numbered from 0."""
        rows = in_memory(self.spark, corpus) if isinstance(corpus, list) else corpus
        self.index_ = GeoIndex.build(self.encoder, rows, k_graph, metric_graph)
        return self

    @property
    def corpus_embeddings(self) -> DataFrame | None:
        return self.index_ and self.index_.embeddings

    @property
    def corpus_graph(self) -> DataFrame | None:
        return self.index_ and self.index_.edges

    @property
    def distance_matrix(self) -> DataFrame | None:
        return self.index_ and self.index_.distances()

    def search(self, query: str | DataFrame, k: int = 10, **options) -> list[int] | DataFrame:
        """query: one text, for a list of doc_ids, best first; or a table (qid, text) or (qid, qvec), for a table of
        ranks. top_k stands for k; other options are those of GeoIndex.search."""
        if self.index_ is None:
            raise RuntimeError("search comes after index()")
        k = int(options.pop("top_k", k))
        one = isinstance(query, str)
        asked = self.spark.createDataFrame([(0, query)], "qid long, text string") if one else query
        if "qvec" not in asked.columns:
            asked = self.encoder.encode(asked, "text", is_query=True).select("qid", F.col("embedding").alias("qvec"))
        found = self.index_.search(asked, k, **options)
        return [r["vec_id"] for r in found.orderBy("rank").collect()] if one else found  # k rows
