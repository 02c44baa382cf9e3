"""Experiments: a run with its folder, configuration, log and results, and an evaluation in one call."""

from __future__ import annotations

import abc
import dataclasses
import functools
import json
import logging
import os
import random
import time
from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.encoders import load_encoder
from lodestar.operators import graph, metrics, soft
from lodestar.operators.knn import topk
from lodestar.plans.config import EncoderConfig, ExperimentConfig, TrainerConfig
from lodestar.plans.retriever import GeoIndex
from lodestar.sources.tables import cut


class ExperimentRunner(abc.ABC):
    """A run writes to a folder of its own below output_dir, on the driver: config.json, run.log, and what it saves."""

    def __init__(self, name: str, output_dir: str = "runs"):
        self.name, self.output_dir, self.run_dir = name, output_dir, None
        self.config: dict = {}
        self.logger = logging.getLogger(f"lodestar.{name}")

    @abc.abstractmethod
    def run(self) -> None: ...

    def start(self, config) -> str:
        """Make the folder, save config (a dataclass, a mapping, or anything that has a text), and run. An error is
        logged and raised again."""
        self.config = dataclasses.asdict(config) if dataclasses.is_dataclass(config) else dict(config) if isinstance(config, dict) else {"config": str(config)}
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
        self.run_dir = os.path.join(self.output_dir, f"{self.name}_{stamp}")
        os.makedirs(self.run_dir)
        log = logging.FileHandler(os.path.join(self.run_dir, "run.log"))
        self.logger.addHandler(log)
        self.logger.setLevel(logging.INFO)
        self.save_results(self.config, "config.json")
        try:
            self.run()
            self.logger.info("done")
        except Exception:
            self.logger.exception("failed")
            raise
        finally:
            self.logger.removeHandler(log)
            log.close()
        return self.run_dir

    def _path(self, filename: str) -> str:
        if self.run_dir is None:
            raise RuntimeError("saving comes after start()")
        return os.path.join(self.run_dir, filename)

    def save_results(self, results, filename: str) -> str:
        """Small results as JSON."""
        path = self._path(filename)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(results, f, indent=2, default=str)
        return path

    def save_dataframe(self, rows: DataFrame, filename: str) -> str:
        """As a folder of CSV files with a header, written by the executors; arrays as JSON."""
        path = os.path.abspath(self._path(filename))
        flat = rows.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in rows.schema.fields])
        flat.write.mode("overwrite").option("header", True).csv(f"file://{path}")
        return path


def timeit(f: Callable) -> Callable:
    """f, whose last call's seconds are in its attribute ``seconds``."""

    @functools.wraps(f)
    def timed(*args, **options):
        began = time.perf_counter()
        try:
            return f(*args, **options)
        finally:
            timed.seconds = time.perf_counter() - began

    timed.seconds = None
    return timed


def seed_all(seed: int = 42) -> None:
    """Of the driver; columns take their seeds as arguments."""
    random.seed(seed)
    np.random.seed(seed)


def quick_experiment(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, model_name: str = "hashing", k: int = 20, geometric: bool = True, k_eval: int = 10, candidates: int = 100, **options) -> dict:
    """corpus (doc_id, text), queries (qid, text), qrels (qid, doc_id, rel) -> ndcg, map and recall at 100 as measured.
    Vectors are the encoder's; geometric ranks by PageRank on the soft neighbour graph, otherwise by cosine. Nothing is
    trained. options are those of TrainerConfig."""
    trainer = TrainerConfig(k_graph=k, geodesic=geometric, lambda_ricci=0.1 if geometric else 0.0, lambda_forman=0.05 if geometric else 0.0, **options)
    config = ExperimentConfig(encoder=EncoderConfig(model_name=model_name), trainer=trainer)
    encoder = load_encoder(model_name)
    index = GeoIndex.build(encoder, corpus, k) if not geometric else None
    embeddings = index.embeddings if index else cut(encoder.encode(corpus, "text").select(F.col("doc_id").cast("long").alias("vec_id"), "embedding"), "embeddings")[0]
    asked = encoder.encode(queries, "text", is_query=True).select("qid", F.col("embedding").alias("qvec"))
    found, _ = cut(topk(embeddings, asked, candidates), "candidates")
    if geometric:
        adjacency, _ = cut(soft.soft_knn(embeddings, max(2, min(k, 8))).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("a").alias("w")), "adjacency")
        found = graph.pagerank_rerank(found, adjacency, candidates)
    run, _ = cut(found.select("qid", F.col("vec_id").alias("doc_id"), "score"), "run")
    at_k, at_100 = metrics.retrieval_metrics(run, qrels, k_eval).first(), metrics.retrieval_metrics(run, qrels, 100).first()
    return {f"ndcg_{k_eval}": at_k["ndcg"], "map": metrics.mean_average_precision(run, qrels).first()["map"], "recall_100": at_100["recall"], "config": config.to_dict()}
