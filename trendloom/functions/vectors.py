"""Vector functions.

Columns against columns use Spark's array functions. Columns against a small fixed matrix (centroids, queries) use one
matrix product per Arrow batch: the matrix travels with the function, the rows never leave their partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 12  # scores this close count as equal, so that ties break by id and not by rounding noise
SCORE_SLACK = 2e-12  # a score that rounding may lift to a bound is no further below it


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for a zero vector or unequal lengths, NULL for a missing vector."""
    a, b = as_doubles(a), as_doubles(b)
    size = norm(a) * norm(b)
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when((F.size(a) != F.size(b)) | (size == 0), 0.0)
        .otherwise(dot(a, b) / size)
    )


def normalised(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    values = as_doubles(vector)
    length = F.when(norm(values) == 0, 1.0).otherwise(norm(values))
    # The outer transform binds the length, which would else be worked out anew for every element.
    return F.get(F.transform(F.array(length), lambda n: F.transform(values, lambda x: x / n)), 0)


def parse_vector(text: Column) -> Column:
    """JSON text to a vector; bad text gives NULL."""
    return F.from_json(text, "array<double>")


def usable(vector: Column, dim: int | None = None) -> Column:
    """Present, of the right length and not all zero."""
    length = (F.size(vector) == dim) if dim else (F.size(vector) > 0)
    return F.coalesce(vector.isNotNull() & length & F.exists(vector, lambda x: x != 0), F.lit(False))


def shown_score(score: Column, digits: int = 6) -> Column:
    """Rounded for output; not-finite becomes NULL."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return F.when(finite, F.round(score, digits))


# --- rows against a small matrix, inside Arrow batches -------------------------------------------------------------


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; zero rows stay zero."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def batch_matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and dense rows of the vectors that have the given length and finite entries."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    positions = np.flatnonzero(lengths == dim)
    dense = vectors.take(pa.array(positions)).flatten().to_numpy(zero_copy_only=False)
    rows = dense.astype(np.float64).reshape(len(positions), dim)
    finite = np.isfinite(rows).all(axis=1)
    return positions[finite], rows[finite]


def scores(rows: np.ndarray, unit_matrix: np.ndarray) -> np.ndarray:
    """Cosine of every row against every row of a unit matrix."""
    return np.round(unit_rows(rows) @ unit_matrix.T, SCORE_DIGITS)


def nearest(rows: np.ndarray, matrix: np.ndarray, measure: str) -> tuple[np.ndarray, np.ndarray]:
    """For every row the position of its nearest matrix row (the first on ties) and the cosine to it."""
    cosines = scores(rows, unit_rows(matrix))
    if measure == "cosine":
        best = cosines.argmax(axis=1)
    else:  # |x - c|^2 of a unit x is smallest where x.c - |c|^2 / 2 is largest
        best = np.round(unit_rows(rows) @ matrix.T - (matrix**2).sum(axis=1) / 2, SCORE_DIGITS).argmax(axis=1)
    return best, cosines[np.arange(len(rows)), best]


def nearest_row(vector: Column, matrix: np.ndarray, measure: str = "cosine") -> Column:
    """struct(row, score): the nearest matrix row and the cosine to it; NULL for a missing or misfit vector.

    ``measure`` is ``cosine``, or ``euclidean`` for the distance of the unit vector.
    """
    matrix = np.asarray(matrix, dtype=np.float64)
    result = pa.struct([("row", pa.int32()), ("score", pa.float64())])

    @F.arrow_udf("struct<row:int,score:double>")
    def find(vectors: pa.Array) -> pa.Array:
        row = np.zeros(len(vectors), dtype=np.int32)
        score = np.zeros(len(vectors))
        missing = np.ones(len(vectors), dtype=bool)
        positions, rows = batch_matrix(vectors, matrix.shape[1])
        if len(positions) and len(matrix):
            row[positions], score[positions] = nearest(rows, matrix, measure)
            missing[positions] = False
        fields = [pa.array(row), pa.array(score)]
        return pa.StructArray.from_arrays(fields, fields=list(result), mask=pa.array(missing))

    return find(vector)
