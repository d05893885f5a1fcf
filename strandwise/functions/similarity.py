"""Similarity of texts, and the two plug points: an embedder and a pair scorer.

A scorer turns a table of pairs into scores.  Those that cost a model call see each distinct pair, or
each distinct text, once; the scores are joined back, which is exact at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.text import tokens


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of the lower-case texts; not symmetric."""
    return F.pandas_udf(_ratio, "double")(a, b)


def lexical(a: Column, b: Column) -> Column:
    """Cosine of the sets of tokens; 0 if either is empty."""
    x, y = tokens(a), tokens(b)
    norm = F.sqrt(F.size(x).cast("double") * F.size(y))
    return F.when(norm > 0, F.size(F.array_intersect(x, y)) / norm).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two vectors of unit length, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


class Scorer:
    """Adds a column of scores of two text columns to a table."""

    def add(self, rows: DataFrame, a: str, b: str, into: str) -> DataFrame:
        raise NotImplementedError


class ColumnScorer(Scorer):
    """Scores by an expression of the two columns."""

    def __init__(self, expression: Callable[[Column, Column], Column]):
        self.expression = expression

    def add(self, rows: DataFrame, a: str, b: str, into: str) -> DataFrame:
        return rows.withColumn(into, self.expression(F.col(a), F.col(b)))


LEXICAL = ColumnScorer(lexical)
#: What reranking falls back to where there is no model.
ZERO = ColumnScorer(lambda a, b: F.lit(0.0))


class PairScorer(Scorer):
    """Scores each distinct pair once by ``model(list of (a, b)) -> list of float``, in Arrow batches.

    ``make_model`` is called once per Python worker.
    """

    def __init__(self, make_model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 32):
        self.make_model, self.batch = make_model, batch

    def add(self, rows: DataFrame, a: str, b: str, into: str) -> DataFrame:
        make, size = self.make_model, self.batch

        @F.pandas_udf("double")
        def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = make()
            for x, y in parts:
                pairs = list(zip(x.fillna(""), y.fillna(""), strict=True))
                yield pd.Series([float(s) for k in range(0, len(pairs), size) for s in model(pairs[k : k + size])], dtype="float64")

        scored = rows.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct().withColumn(into, score("__a", "__b"))
        return rows.join(scored, F.col(a).eqNullSafe(F.col("__a")) & F.col(b).eqNullSafe(F.col("__b"))).drop("__a", "__b")


class EmbeddingScorer(Scorer):
    """Cosine of unit vectors; each distinct text is embedded once by ``model(list of text) -> list of vector``.

    Empty texts score 0.
    """

    def __init__(self, make_model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 256):
        self.make_model, self.batch = make_model, batch

    def embed(self, texts: DataFrame, column: str, into: str = "embedding") -> DataFrame:
        make, size = self.make_model, self.batch

        @F.pandas_udf("array<float>")
        def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = make()
            for x in parts:
                own = list(x.fillna(""))
                yield pd.Series([list(map(float, v)) for k in range(0, len(own), size) for v in model(own[k : k + size])], dtype="object")

        return texts.withColumn(into, vectors(column))

    def add(self, rows: DataFrame, a: str, b: str, into: str) -> DataFrame:
        every = rows.select(F.col(a).alias("__t")).union(rows.select(F.col(b).alias("__t"))).filter("__t is not null and __t <> ''").distinct()
        known = self.embed(every, "__t", "__v")
        left = known.select(F.col("__t").alias("__a"), F.col("__v").alias("__va"))
        right = known.select(F.col("__t").alias("__b"), F.col("__v").alias("__vb"))
        joined = rows.join(left, F.col(a) == F.col("__a"), "left").join(right, F.col(b) == F.col("__b"), "left")
        return joined.withColumn(into, F.coalesce(cosine(F.col("__va"), F.col("__vb")), F.lit(0.0))).drop("__a", "__b", "__va", "__vb")


def sentence_embedder(model_name: str, device: str = "cpu") -> EmbeddingScorer:
    """Embeddings of a sentence-transformers model; the library is loaded on the workers."""

    def make():
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(model_name, device=device)
        return lambda texts: model.encode(texts, normalize_embeddings=True).tolist()

    return EmbeddingScorer(make)


def pooled_embedder(model_name: str, device: str = "cpu") -> EmbeddingScorer:
    """Mean-pooled, normalized embeddings of a transformers model."""

    def make():
        import torch
        from transformers import AutoModel, AutoTokenizer

        tok, model = AutoTokenizer.from_pretrained(model_name), AutoModel.from_pretrained(model_name).eval().to(device)

        def run(texts: list[str]) -> list[list[float]]:
            with torch.no_grad():
                x = tok(texts, padding=True, truncation=True, return_tensors="pt").to(device)
                mask = x["attention_mask"].unsqueeze(-1)
                pooled = (model(**x).last_hidden_state * mask).sum(1) / mask.sum(1).clamp(min=1)
                return torch.nn.functional.normalize(pooled, dim=-1).cpu().tolist()

        return run

    return EmbeddingScorer(make)


def build_embedder(model_name: str | None, device: str = "cpu") -> Scorer:
    """The first that the installed libraries allow; lexical similarity without a model name."""
    from importlib.util import find_spec

    if not model_name:
        return LEXICAL
    if find_spec("sentence_transformers"):
        return sentence_embedder(model_name, device)
    if find_spec("transformers") and find_spec("torch"):
        return pooled_embedder(model_name, device)
    raise RuntimeError("no embedding library is installed")


def build_reranker(model_name: str | None, max_length: int = 128, batch: int = 32, half: bool = True) -> Scorer:
    """Raw logits of a cross-encoder; all 0 where there is no model or no library."""
    from importlib.util import find_spec

    if not model_name or not (find_spec("transformers") and find_spec("torch")):
        return ZERO

    def make():
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        device = "cuda" if torch.cuda.is_available() else "cpu"
        tok, model = AutoTokenizer.from_pretrained(model_name), AutoModelForSequenceClassification.from_pretrained(model_name).eval().to(device)
        if half and device == "cuda":
            model.half()

        def run(pairs: list[tuple[str, str]]) -> list[float]:
            with torch.no_grad():
                x = tok([p[0] for p in pairs], [p[1] for p in pairs], padding=True, truncation=True, max_length=max_length, return_tensors="pt").to(device)
                return model(**x).logits.reshape(len(pairs), -1)[:, 0].float().cpu().tolist()

        return run

    return PairScorer(make, batch)
