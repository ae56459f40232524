"""Fill-in-the-middle texts: two cuts, sentinels, and an exchange of blocks by rotation in place.

A document is written once into a bytearray. The sentinels are inserted at the cuts, which gives ``<P>prefix<M>middle
<S>suffix``; one rotation of two neighbouring blocks (reverse each, then both together) gives either form, and the same
rotation with the blocks' new sizes takes it back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import in_slices, whole_text

# The sentinels, the seed, and the percentages of texts that are changed and of those in suffix-first form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
RESULT = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,text:binary>"


def unit_ends(data: np.ndarray) -> np.ndarray:
    """The place after every unit of the bytes: a word with the white space before it, or white space that ends the text."""
    word = ~WHITE[data]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = np.flatnonzero(last) + 1
    return np.append(ends, len(data)) if len(data) and not word[-1] else ends


def code_points(data: np.ndarray) -> int:
    """Characters of UTF-8 bytes: all but the continuation bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def rotate(buffer: bytearray, start: int, middle: int, stop: int) -> None:
    """Exchanges the neighbouring blocks [start, middle) and [middle, stop) in place by three reversals."""
    for a, b in ((start, middle), (middle, stop), (start, stop)):
        buffer[a:b] = buffer[a:b][::-1]


def arranged(text: bytes, first: int, second: int, form: str) -> bytes:
    """The text in ``psm`` or ``spm`` form; prefix and middle end at the two byte places."""
    buffer = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from the end, so that earlier places stay right
        buffer[at:at] = mark
    middle = len(PREFIX) + first
    suffix = middle + len(MIDDLE) + second - first
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer)


def rearranged(output: bytes, form: str) -> bytes:
    """The text that ``arranged`` was given, from its output and form alone."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":
        rotate(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    else:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    # Sentinels start with a letter that they hold nowhere else, so none can arise across the edge of a block.
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def choice(key: str, seed: int = SEED) -> tuple[int, ...]:
    """Four unsigned numbers that the key decides."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transformed(
    text: bytes, key: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix, characters of the middle, output) of one text."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = choice(key, seed)
    if not text or h3 % 100 >= fim_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (int(ends[c - 1]) if c else 0 for c in cuts)
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return n, form, code_points(data[:first]), code_points(data[first:second]), arranged(text, first, second, form)


def fill_middle(text: Column, key: Column, **settings: int) -> Column:
    """struct(n, form, prefix_chars, middle_chars, text as bytes) of every text; ``key`` (text) decides cuts and form."""

    @F.arrow_udf(RESULT)
    def transform(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return in_slices(transform_few, texts, keys)

    def transform_few(texts: pa.Array, keys: pa.Array) -> pa.Array:
        made = [transformed(t, k, **settings) for t, k in zip(texts.to_pylist(), keys.to_pylist(), strict=True)]
        n, form, prefix, middle, out = zip(*made, strict=True) if made else ((),) * 5
        fields = {
            "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()),
            "middle_chars": pa.array(middle, pa.int64()), "text": pa.array(out, pa.binary()),
        }
        return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

    return transform(text.cast("binary"), key)


def restored(output: Column, form: Column) -> Column:
    """The original text of every output."""

    @F.arrow_udf("binary")
    def restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return in_slices(restore_few, outputs, forms)

    def restore_few(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        texts = [rearranged(o, f) for o, f in zip(outputs.to_pylist(), forms.to_pylist(), strict=True)]
        return pa.array(texts, pa.binary())

    return restore(output.cast("binary"), form).cast("string")


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", into: str = "fim", **settings: int) -> DataFrame:
    """All rows and columns, with ``into``: a struct of the number of units, the form, the characters of prefix and
    middle (null in plain form) and the output text.

    A null text counts as empty and stays plain, as does a text that holds a sentinel. A null key counts as empty. Rows
    are handled one by one: rows with equal key and text give equal results, an empty table stays empty. Only a column
    named ``into`` is replaced. Arrow batches are bounded by Spark's bytes per batch, so very long texts come few at a time.
    """
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    made = docs.withColumn(into, fill_middle(whole_text(F.col(f"`{text}`")), name, **settings))
    return made.withColumn(into, F.col(into).withField("text", F.col(f"{into}.text").cast("string")))


def round_trips(docs: DataFrame) -> DataFrame:
    """Per document: units, form, sizes, and digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("text", 256).alias("output_sha256"),
        F.sha2(restored(F.col("text"), F.col("form")), 256).alias("restored_sha256"),
    )
