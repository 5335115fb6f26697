"""Text and category features: vocabulary, TF-IDF (rows or vectors), one-hot, class weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ticketlens.functions.text import TOKEN_PATTERN, terms, word_tokens
from ticketlens.session import settle, small_side

# Fixed value: the category that stands for a missing one.
MISSING_CATEGORY = "(missing)"
# Buckets that terms are counted by, a power of two, and how many of the fullest are looked into for each term wanted.
TERM_BUCKETS, FULLEST = 1 << 20, 4
# Words that a task counts at once.
SLICE_WORDS = 500_000


def term_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document and term with its count; ``key`` is unique.

    Terms are counted inside the row, as runs of the sorted list, so nothing is shuffled.
    """
    listed = df.select(key, F.array_sort(terms(text)).alias("_terms")).filter(F.size("_terms") > 0)
    same = lambda i: F.get("_terms", i) == F.get("_terms", i - 1)
    starts = F.filter(F.sequence(F.lit(0), F.size("_terms") - 1), lambda i: (i == 0) | ~same(i))
    runs = listed.withColumn("_starts", starts)
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_terms"))
    counted = F.transform("_starts", lambda i, k: F.struct(F.get("_terms", i).alias("term"), (end(k) - i).cast("long").alias("tf")))
    return runs.select(key, F.inline(counted))


def vocabulary(df: DataFrame, text: str, max_features: int, min_df: int) -> DataFrame:
    """The most frequent terms in at least ``min_df`` documents, with document count and idf.

    Columns ``term, total, df, idf``; equal totals in term order.  Terms are
    first counted by buckets of their hash, of which there is a bounded number.
    No term is more frequent than its bucket, so only the terms of the fullest
    buckets are counted on their own; if the last term kept is not more
    frequent than every bucket left out, those that may hold a more frequent
    one are counted too.  So no task holds all its terms, and ``df`` is read
    several times and must give the same rows each time.  Spark finds the
    words; terms are counted as numbers, in Arrow batches.
    """
    found, count = df.select(word_tokens(text).alias("_words")), TERM_BUCKETS

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(count, np.int64)
        for words in _slices(batches):
            _, _, hashes, _ = _coded(words)
            sizes += np.bincount(hashes & (count - 1), minlength=count)
        for some in np.array_split(np.flatnonzero(sizes), 16):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sizes[some])], ["_bucket", "_size"])

    sizes = found.mapInArrow(added, "_bucket long, _size long").groupBy("_bucket").agg(F.sum("_size").alias("_size"))
    # At most TERM_BUCKETS rows; a term in so many documents is as frequent at least.
    buckets = settle(sizes.filter(F.col("_size") >= min_df))
    fullest = buckets.orderBy(F.desc("_size")).limit(FULLEST * max_features)
    least = fullest.agg(F.when(F.count(F.lit(1)) == FULLEST * max_features, F.min("_size"))).first()[0] or min_df
    kept = _most_frequent(found, count, buckets.filter(F.col("_size") >= least), max_features, min_df)
    if least > min_df:
        last = kept.agg(F.when(F.count(F.lit(1)) == max_features, F.min("total"))).first()[0] or min_df
        if last < least:
            kept = _most_frequent(found, count, buckets.filter(F.col("_size") >= last), max_features, min_df)
    documents = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return kept.withColumn("idf", F.log((1 + documents) / (1 + F.col("df"))) + 1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The lists of words of a task in slices of bounded numbers of words, but for longer lists."""
    for batch in batches:
        words = batch.column(0)
        upto = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)) // SLICE_WORDS
        edges = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(words)]
        yield from (words.slice(i, j - i) for i, j in zip(edges[:-1], edges[1:], strict=True) if j > i)


def _coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of the terms of lists of words: list, code, hash; and the words. A word's code is its place among these, that of a pair
    comes after all of them: words + first * words + second."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    told = words.flatten().dictionary_encode()
    at, names = told.indices.to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary
    row = np.repeat(np.arange(sizes.size), sizes)
    # Hashes of pandas do not depend on the process.
    own = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object))[at]
    first = np.flatnonzero(row[1:] == row[:-1])
    pair = (own[first] * np.uint64(0x9E3779B97F4A7C15)) ^ own[first + 1]
    pair = (pair ^ (pair >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    code = np.concatenate([at, len(names) + at[first] * len(names) + at[first + 1]])
    hashes = np.concatenate([own, pair ^ (pair >> np.uint64(33))]).view(np.int64)
    return np.concatenate([row, row[first]]), code, hashes, names


def _most_frequent(found: DataFrame, count: int, buckets: DataFrame, max_features: int, min_df: int) -> DataFrame:
    """The most frequent terms of these buckets, of which there are ``count`` at most, settled.

    Tasks count the terms of slices of their documents, so only sums are shuffled and no text is.
    """
    held = np.zeros(count, bool)
    held[buckets.select("_bucket").toArrow().column(0).to_numpy()] = True
    shared = found.sparkSession.sparkContext.broadcast(held)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches):
            row, code, hashes, names = _coded(words)
            kept = shared.value[hashes & (count - 1)]
            each, times = np.unique(code[kept] * len(words) + row[kept], return_counts=True)
            code = each // len(words)
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            if not starts.size:
                continue
            code = code[starts]
            one = code[code < len(names)]
            first, second = np.divmod(code[one.size :] - len(names), len(names))
            pairs = pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " ")
            totals = [np.add.reduceat(times, starts), np.diff(starts, append=each.size)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([names.take(pa.array(one)), pairs]), *map(pa.array, totals)], ["term", "total", "df"])

    counted = found.mapInArrow(counts, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    return settle(counted.filter(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_features))


def tfidf_rows(
    df: DataFrame, key: str, text: str, max_features: int, min_df: int, fit_on: DataFrame | None = None
) -> DataFrame:
    """TF-IDF as rows (key, term, weight) with unit length per document.

    The vocabulary comes from ``fit_on`` (default: the same table).  Each row makes its own vector, with its length, so that
    nothing but the vocabulary's sums is shuffled.  Without a term in ``min_df`` documents there are no rows.
    """
    entries = _entries(df if fit_on is None else fit_on, text, max_features, min_df)
    if not entries:
        return df.select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    vectors = apply_stages(df.select(key, text), _stages_of(entries, text, "_vector")).select(key, F.unwrap_udt("_vector").alias("_cells"))
    cells = vectors.select(key, F.inline(F.arrays_zip(F.col("_cells.indices").alias("position"), F.col("_cells.values").alias("weight"))))
    # At most max_features rows.
    names = df.sparkSession.createDataFrame([(n, e["term"]) for n, e in enumerate(entries)], "position int, term string")
    return cells.join(F.broadcast(names), "position").select(key, "term", "weight")


def _terms_sql(text: str) -> str:
    """The term list as SQL, so that the stage can be saved with its pipeline."""
    # A backslash is written twice inside a SQL string.
    pattern = TOKEN_PATTERN.replace("\\", "\\\\")
    words = f"regexp_extract_all(lower(coalesce({text}, '')), '{pattern}', 0)"
    return (
        f"transform(array({words}), w -> concat(w, zip_with(slice(w, 1, greatest(size(w) - 1, 0)), "
        "slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> concat(a, ' ', b))))[0]"
    )


def text_stages(
    train: DataFrame, text: str, max_features: int, min_df: int, into: str = "text_vector"
) -> list[Transformer]:
    """Fitted stages from a text column to unit-length TF-IDF vectors.

    One pass gives vocabulary and idf together; both are model parameters of
    at most ``max_features`` entries and are therefore read to the driver.
    """
    entries = _entries(train, text, max_features, min_df)
    if not entries:
        raise ValueError(f"no term of {text} is in at least {min_df} documents")
    return _stages_of(entries, text, into)


def _entries(train: DataFrame, text: str, max_features: int, min_df: int) -> list[Row]:
    """The terms of the vocabulary in order, with their idf."""
    fitted = vocabulary(train.withColumn(text, F.coalesce(text, F.lit(""))), text, max_features, min_df)
    return fitted.orderBy(F.desc("total"), "term").limit(max_features).collect()


def _stages_of(entries: list[Row], text: str, into: str) -> list[Transformer]:
    counts = CountVectorizerModel.from_vocabulary([e["term"] for e in entries], "_terms", "_counts")
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([e["idf"] for e in entries]), inputCol="_counts", outputCol="_scaled"
    )
    return [
        SQLTransformer(statement=f"SELECT *, {_terms_sql(text)} AS _terms FROM __THIS__"),
        counts,
        scale,
        Normalizer(p=2.0, inputCol="_scaled", outputCol=into),
    ]


def category_stages(train: DataFrame, columns: Sequence[str]) -> list[Transformer]:
    """Fitted one-hot stages: missing is a category of its own, an unseen one gives zeros."""
    columns = list(columns)
    if not columns:
        return []
    filled = ", ".join(f"coalesce(cast({c} AS string), '{MISSING_CATEGORY}') AS _{c}_filled" for c in columns)
    fill = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    ready = fill.transform(train)
    index = StringIndexer(
        inputCols=[f"_{c}_filled" for c in columns],
        outputCols=[f"_{c}_index" for c in columns],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    ).fit(ready)
    encode = OneHotEncoder(
        inputCols=[f"_{c}_index" for c in columns], outputCols=[f"_{c}_vector" for c in columns], dropLast=True
    ).fit(index.transform(ready.limit(1)))
    return [fill, index, encode]


def _filled(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING_CATEGORY))


def category_dictionary(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The levels of the columns as a table (column, value, slot), slots from 0 in the order of the values.

    The form of ``category_stages`` for columns with very many levels: none
    of them comes to the driver or to one task.  Values are range-partitioned,
    numbered in their partition, and moved by the levels in earlier partitions.
    Missing is a level of its own.
    """
    named = train.select(*[_filled(c).alias(c) for c in columns])
    levels = named.unpivot([], list(columns), "column", "value").distinct()
    # Settled, as the numbers of partitions must stay what they are in both reads.
    ordered = settle(levels.repartitionByRange("column", "value").withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("column", "_part").orderBy("value")
    sizes = ordered.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("column", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = ordered.withColumn("_place", F.row_number().over(within)).join(starts, ["column", "_part"])
    return settle(placed.select("column", "value", (F.col("_start") + F.col("_place") - 1).alias("slot")))


def with_slots(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``<column>_slot``, the one filled place of the column's one-hot vector, and ``<column>_size``, its length.

    A level that the dictionary does not have gives no slot: a vector of zeros.
    Each column is a join of its own, whose hot levels adaptive execution splits.
    """
    out = df
    for c in columns:
        own = dictionary.filter(F.col("column") == c)
        slots = own.select(F.col("value").alias("_level"), F.col("slot").alias(f"{c}_slot"))
        out = out.withColumn("_level", _filled(c)).join(slots, "_level", "left").drop("_level")
    sizes = {
        f"{c}_size": dictionary.filter(F.col("column") == c).agg(F.count(F.lit(1)).cast("int")).scalar() for c in columns
    }
    return out.withColumns(sizes)


def feature_stages(
    train: DataFrame, text: str, categories: Sequence[str], max_features: int, min_df: int
) -> list[Transformer]:
    """Fitted stages from text and categories to one ``features`` vector."""
    categories = [c for c in categories if c in train.columns]
    inputs = ["text_vector", *[f"_{c}_vector" for c in categories]]
    return [
        *text_stages(train, text, max_features, min_df),
        *category_stages(train, categories),
        VectorAssembler(inputCols=inputs, outputCol="features"),
    ]


def feature_names(stages: Sequence[Transformer], categories: Sequence[str]) -> list[str]:
    """Names of the ``features`` positions: terms, then ``column_value`` for each category."""
    terms_model = next(s for s in stages if isinstance(s, CountVectorizerModel))
    names = list(terms_model.vocabulary)
    index = next((s for s in stages if type(s).__name__ == "StringIndexerModel" and s.isSet("inputCols")), None)
    if index is not None:
        for column, labels in zip(categories, index.labelsArray):
            names += [f"{column}_{value}" for value in labels]
    return names


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balancing weight of each class: rows / (classes x rows of the class)."""
    # Settled: the sizes are read for each class and for their sum.
    sizes = settle(df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    whole = sizes.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("w")).scalar()
    return sizes.withColumn("weight", whole["rows"] / (whole["classes"] * F.col("n")))


def with_class_weight(df: DataFrame, label: str, into: str = "class_weight") -> DataFrame:
    """Adds the balancing weight of the row's class."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(into))
    return df.join(small_side(weights), label, "left")


def apply_stages(df: DataFrame, stages: Sequence[Transformer]) -> DataFrame:
    """Runs fitted stages in order."""
    return PipelineModel(list(stages)).transform(df)
