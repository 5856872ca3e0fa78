"""Embedding, the vector table and exact nearest documents for many questions at once."""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroclime.functions.numbers import l2_normalized
from agroclime.sources.scratch import as_table, scratch_path

# The scoring code travels with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EMBEDDING_DIM = 384
ENCODE_BATCH = 256
# Fixed value: the index kind the manifest names.
INDEX_TYPE = "IndexFlatIP"
# The last bits of a score depend on the order of its sum. Scores that agree to this many
# decimals are therefore equal, and ties go by id, whatever way a pair was scored.
SCORE_DIGITS = 9
# A matrix product only screens rows, with this slack; pairs that pass are scored one by one.
SCORE_SLACK = 2e-9
# Scores held at once by a task: 32 MB.
SCORE_CELLS = 4 << 20
# Questions up to these bounds are sent to every task; more are answered from a pruned index.
MAX_BROADCAST_QUESTIONS = 4096
MAX_BROADCAST_BYTES = 64 << 20


# ---------------------------------------------------------------- embedding

@dataclass
class HashingEncoder:
    """Text -> unit vector with Spark ML's own stages, all on the JVM.

    Word counts hashed into ``dim`` buckets, weighted by inverse document
    frequency and normalised. It stands in where no language model is at hand.
    """

    stages: object
    dim: int

    @classmethod
    def fit(cls, corpus: DataFrame, text_col: str = "text", dim: int = EMBEDDING_DIM) -> "HashingEncoder":
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

        pipeline = Pipeline(stages=[
            RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="__words", outputCol="__counts", numFeatures=dim),
            IDF(inputCol="__counts", outputCol="__weighted"),
            Normalizer(inputCol="__weighted", outputCol="__unit"),
        ])
        text = corpus.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
        return cls(pipeline.fit(text), dim)

    def __call__(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        coded = self.stages.transform(df.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))))
        return coded.withColumn(out, vector_to_array("__unit", "float32")).drop(
            "__text", "__words", "__counts", "__weighted", "__unit"
        )


def model_encoder(open_model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = ENCODE_BATCH):
    """An encoder around a batch model: ``open_model()`` is called once per Python worker, texts come ``batch`` at a time.

    The model returns a matrix with one row per text; rows are scaled to length 1. A null text is read as empty.
    """
    from pyspark.ml.model_cache import ModelCache

    key = uuid.uuid4()

    def units(model, texts: list[str]) -> np.ndarray:
        coded = np.asarray(model(texts), dtype=np.float64)
        if len(coded) != len(texts):
            raise ValueError(f"the model gave {len(coded)} rows for {len(texts)} texts")
        norms = np.sqrt((coded ** 2).sum(axis=1, keepdims=True))
        return np.divide(coded, norms, out=np.zeros_like(coded), where=norms > 0).astype(np.float32)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = ModelCache.get(key)
        if model is None:
            model = open_model()
            ModelCache.add(key, model)
        for texts in batches:
            parts = [units(model, texts.slice(i, batch).to_pylist()) for i in range(0, len(texts), batch)]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))

    def encode(df: DataFrame, text_col: str, out: str) -> DataFrame:
        return df.withColumn(out, run(F.coalesce(F.col(text_col), F.lit(""))))

    return encode


# Small letters and digits stay, capitals become small, any other byte ends a word.
_WORD_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class HashModel:
    """A batch model in one file: words hashed by MD5 into weighted, signed buckets.

    A word is a run of ASCII letters and digits, small letters for capitals. Eight hex digits of its digest give the
    bucket, the ninth the sign, the file each bucket's weight. All sums are whole numbers, so that any engine with MD5
    finds the same vectors.
    """

    CACHE = 1 << 18  # words kept by a worker

    def __init__(self, content: str):
        said = json.loads(content)
        self.weights, self.known = np.array(said["weights"], np.float64), {}

    @staticmethod
    def content(dim: int = EMBEDDING_DIM) -> str:
        """A model file: bucket b weighs 1 + b % 7."""
        return json.dumps({"weights": [1 + b % 7 for b in range(dim)]})

    def _place(self, word: bytes) -> int:
        """Twice the word's bucket, plus one for a positive sign."""
        place = self.known.get(word)
        if place is None:
            digest = hashlib.md5(word).hexdigest()
            place = 2 * (int(digest[:8], 16) % len(self.weights)) + (digest[8] < "8")
            if len(self.known) < self.CACHE:
                self.known[word] = place
        return place

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [text.encode().translate(_WORD_BYTES).split() for text in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        places = np.fromiter(map(self._place, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        width = 2 * len(self.weights)
        counts = np.bincount(np.repeat(np.arange(len(words)) * width, sizes) + places, minlength=len(words) * width).reshape(len(words), len(self.weights), 2)
        return (counts[:, :, 1] - counts[:, :, 0]).astype(np.float64) * self.weights


def write_model(spark: SparkSession, path: str, content: str) -> str:
    """Stores a model file in the shared folder ``path`` and returns the file's own path."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).inputFiles()[0]


def file_encoder(spark: SparkSession, model_file: str, model=HashModel, batch: int = ENCODE_BATCH):
    """An encoder whose model file Spark ships to every executor; a worker opens it once."""
    spark.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[1]

    def open_model():
        with open(SparkFiles.get(name), encoding="utf-8") as file:
            return model(file.read())

    return model_encoder(open_model, batch)


def embed(df: DataFrame, text_col: str, encoder, out: str = "embedding") -> DataFrame:
    """Adds the unit vector of each text. ``encoder(df, text_col, out)`` does the work."""
    return encoder(df, text_col, out)


def normalize_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn(col, l2_normalized(F.col(col)))


def vector_manifest(vectors: DataFrame, model_name: str, col: str = "embedding") -> DataFrame:
    """Model name, width, number of vectors and index type, as one row."""
    return vectors.agg(
        F.max(F.size(col)).cast("int").alias("embedding_dim"), F.count("*").alias("num_vectors")
    ).select(F.lit(model_name).alias("model_name"), "embedding_dim", "num_vectors", F.lit(INDEX_TYPE).alias("index_type"))


# ------------------------------------------------------------- exact top-k

def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list<float> Arrow column as a float64 matrix, without Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, to SCORE_DIGITS decimals."""
    return np.round(np.ascontiguousarray(a * b).sum(axis=1), SCORE_DIGITS) + 0.0


class _BestPerQuestion:
    """The best k rows seen so far for each question of a block.

    A question's k-th best score is the bar for later batches, so after the first
    few batches almost nothing passes the comparison. State is at most a small
    multiple of k rows per question.
    """

    def __init__(self, matrix: np.ndarray, k: np.ndarray):
        self.matrix, self.k = matrix, k
        self.bar = np.full(len(k), -np.inf)
        self.q = np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)
        self.rows: pa.Table | None = None

    def add(self, rows: pa.Table) -> None:
        """``rows``: columns ``__vec``, ``__id`` and payload; no null vectors."""
        step = max(256, SCORE_CELLS // max(1, len(self.k)))
        for start in range(0, rows.num_rows if len(self.k) else 0, step):
            self._add_slice(rows.slice(start, step))

    def _add_slice(self, rows: pa.Table) -> None:
        # In id order a stable sort on the score alone breaks ties on the id.
        rows = rows.sort_by("__id")
        vectors = _matrix(rows.column("__vec"))
        scores = self.matrix @ vectors.T
        bar = self.bar
        unset = np.flatnonzero(np.isneginf(bar))
        if len(unset):  # no k-th best yet: take this slice's own
            depth = int(min(self.k[unset].max(), rows.num_rows))
            cut = rows.num_rows - depth
            bar = bar.copy()
            bar[unset] = np.partition(scores[unset], cut, axis=1)[:, cut]
        hit = scores >= (bar - SCORE_SLACK)[:, None]
        for i in np.flatnonzero(hit.sum(axis=1) > 2 * self.k):
            cols = np.flatnonzero(hit[i])
            order = np.argsort(-_pair_scores(self.matrix[[i]], vectors[cols]), kind="stable")[: self.k[i]]
            hit[i] = False
            hit[i, cols[order]] = True
        q, pos = np.nonzero(hit)
        if len(q) == 0:
            return
        picked = rows.drop_columns(["__vec"]).take(pa.array(pos))
        self.q = np.concatenate([self.q, q])
        self.score = np.concatenate([self.score, _pair_scores(self.matrix[q], vectors[pos])])
        self.rows = picked if self.rows is None else pa.concat_tables([self.rows, picked])
        if len(unset) or len(self.q) > 4 * int(self.k.sum()):
            self.compact()

    def compact(self) -> None:
        if self.rows is None:
            return
        table = pa.table({
            "q": self.q, "score": self.score, "id": self.rows.column("__id"), "at": np.arange(len(self.q)),
        }).sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        q, score, at = (table.column(c).to_numpy() for c in ("q", "score", "at"))
        starts = np.searchsorted(q, np.arange(len(self.k)))
        place = np.arange(len(q)) - starts[q]
        keep = place < self.k[q]
        last = place == self.k[q] - 1
        self.bar[q[last]] = score[last]
        self.q, self.score = q[keep], score[keep]
        self.rows = self.rows.take(pa.array(at[keep])).combine_chunks()

    def result(self, question_ids: pa.Array) -> pa.Table | None:
        self.compact()
        if self.rows is None or len(self.q) == 0:
            return None
        columns = {
            "question_id": question_ids.take(pa.array(self.q)),
            "top_k": pa.array(self.k[self.q].astype(np.int32)),
            "similarity_score": pa.array(self.score),
            "__id": self.rows.column("__id"),
        }
        for name in self.rows.column_names:
            columns.setdefault(name, self.rows.column(name))
        return pa.table(columns)


def _hits_schema(questions: DataFrame, vectors: DataFrame, question_id: str, id_col: str, payload) -> T.StructType:
    return T.StructType([
        T.StructField("question_id", questions.schema[question_id].dataType),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("__id", vectors.schema[id_col].dataType),
        *[T.StructField(c, vectors.schema[c].dataType) for c in payload],
    ])


def _score_against_all(question_table: pa.Table, vectors: DataFrame, schema: T.StructType) -> DataFrame:
    """Every task scans its vectors once against the broadcast questions."""
    shared = vectors.sparkSession.sparkContext.broadcast(
        (question_table.column("__qid").combine_chunks(), _matrix(question_table.column("__vec")),
         question_table.column("top_k").to_numpy())
    )
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, k = shared.value
        best = _BestPerQuestion(matrix, k)
        for batch in batches:
            best.add(pa.Table.from_batches([batch]))
        found = best.result(ids)
        if found is not None:
            yield from found.select(names).to_batches(max_chunksize=10_000)

    return vectors.mapInArrow(scan, schema)


def similarity_topk(
    questions: DataFrame,
    vectors: DataFrame,
    k: int | None = None,
    *,
    question_id: str = "question_id",
    question_vec: str = "embedding",
    id_col: str = "id",
    vec_col: str = "embedding",
    payload: Sequence[str] = (),
    max_questions: int = MAX_BROADCAST_QUESTIONS,
) -> DataFrame:
    """The exact best ``k`` vectors by inner product for every question.

    Each task reduces its vectors to k rows per question, one shuffle by question
    merges them. Questions beyond ``max_questions`` or MAX_BROADCAST_BYTES are
    answered from a pruned index (``vector_index``), built for this search. ``k``
    may be a number or, if None, the questions' ``top_k`` column. Ties go to the
    lower id; with k above the table size all rows come back. ``payload`` columns
    travel with the winners. Question ids are unique.

    Returns (question_id, rank, id, similarity_score, payload...).
    """
    asked = questions.where(F.col(question_vec).isNotNull()).select(
        F.col(question_id).alias("__qid"),
        (F.lit(k) if k is not None else F.col("top_k")).cast("int").alias("top_k"),
        F.col(question_vec).alias("__vec"),
    ).where("top_k > 0")
    many, size = asked.agg(F.count("*"), F.sum(F.size("__vec") * 8)).first()
    if many > max_questions or (size or 0) > MAX_BROADCAST_BYTES:
        from agroclime.operators.vector_index import pruned_topk, write_index

        index = write_index(vectors, scratch_path(vectors.sparkSession, "index"), id_col, vec_col, payload)
        hits = pruned_topk(questions, index, k, question_id=question_id, question_vec=question_vec)
        return hits.select("question_id", "rank", id_col, "similarity_score", *payload)

    stored = vectors.where(F.col(vec_col).isNotNull()).select(
        F.col(vec_col).alias("__vec"), F.col(id_col).alias("__id"), *payload
    )
    schema = _hits_schema(questions, vectors, question_id, id_col, payload)
    local = _score_against_all(asked.toArrow(), stored, schema) if many else vectors.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("question_id").orderBy(
        F.desc("similarity_score"), "__id", *[c for c in payload if _orderable(vectors.schema[c].dataType)]
    )
    return (
        local.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= (F.lit(k) if k is not None else F.col("top_k")))
        .select("question_id", "rank", F.col("__id").alias(id_col), "similarity_score", *payload)
    )


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def attach_documents(hits: DataFrame, documents: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with their documents, exactly one row each: of documents with one id the first by content is taken.

    Where repeated ids stand for documents of their own, search by a key that tells them apart
    (``vector_store.keyed_documents``) or let the index join its documents (``vector_index``).
    """
    rest = [c for c in documents.columns if c != id_col]
    first = documents.groupBy(id_col).agg(F.min(F.struct(*[F.col(c) for c in rest])).alias("__first"))
    return hits.join(first, id_col).select("*", *[F.col(f"__first.{c}").alias(c) for c in rest]).drop("__first")


def retrieve(questions: DataFrame, vectors: DataFrame, encoder, k: int | None = None, **options) -> DataFrame:
    """Embeds the questions, once and stored, and returns their nearest documents as hits."""
    embedded = as_table(embed(questions, "query", encoder), "embedded")
    return similarity_topk(embedded, vectors, k, payload=("text", "metadata"), **options)
