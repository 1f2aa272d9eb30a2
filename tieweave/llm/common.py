"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tieweave.operators.components import bucketed, only_result, saved, shared_folder

__all__ = ["bucketed", "only_result", "saved", "shared_folder"]

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch for Python workers. Spark's default of 10,000 holds whole texts several times over outside the heap; workers cut batches into slices anyway.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows of a batch to BATCH_ROWS unless they are fewer already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty string."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def with_columns_of_text(
    df: DataFrame,
    fields: T.StructType,
    make: Callable[[], Callable[..., list]],
    inputs: tuple[str, ...] = ("text",),
    slice_chars: int = 4_000_000,
    arrow: bool = False,
) -> DataFrame:
    """df with the columns of fields, computed from whole texts in Arrow batches.

    make() runs once in each task and returns a function from a list of values of each input (the first is the text, None for
    null) to one list or array per field. A column of df with the name of a field is replaced.
    With arrow, the values come as Arrow arrays instead. Batches are cut so that one call sees slice_chars characters or one text.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new]
    read = [c for c in inputs if c not in keep]
    small_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in [*keep, *read]])
    schema = T.StructType([*source.schema.fields[: len(keep)], *fields.fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives back what a batch has used
        work = make()
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            if not arrow:
                values = [v.to_pylist() for v in values]
            for a, b in slices(values[0], slice_chars):
                made = [pa.array(x, k) for x, k in zip(work(*[v[a:b] for v in values]), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(keep)], *made], [*keep, *fields.names])
        batch = values = made = None
        give_back()

    return source.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that this worker has freed goes back to the system, where the C library can do that."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What a worker keeps over its tasks: one thing at a time, so that the operators of a pipeline don't add up.
KEPT: dict = {}


def kept(key: str, build: Callable):
    """What build() gave when this worker last asked for key; anything else that was kept goes."""
    if key not in KEPT:
        KEPT.clear()
        give_back()
        KEPT[key] = build()
    return KEPT[key]


def block_words(texts: list[str | None] | pa.Array, line_end: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words of the texts, the number of each word in order, where each text's words start and the last one's end).

    line_end: what a line end is read as, for callers that need to see it as a word.
    """
    lines = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    lines = pc.fill_null(lines, "")
    if line_end:
        lines = pc.replace_substring(lines, "\n", line_end)
    split = pc.ascii_split_whitespace(lines)
    coded = pc.dictionary_encode(split.flatten())
    words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    starts = split.offsets.to_numpy()
    if "" in words:  # before leading and after trailing white space
        real = which != words.index("")
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        which = which[real]
    return words, which, starts


def slices(texts: list[str | None] | pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many characters (bytes, of an Arrow array), or one text."""
    a = n = 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    for i, size in enumerate(sizes):
        n += size
        if n > most and i > a:
            yield a, i
            a, n = i, size
    if a < len(texts):
        yield a, len(texts)


class WordCache(dict):
    """Values of words: missing() computes those of a list of new words; emptied, with a call of emptied(), before it would hold over `most`."""

    def __init__(self, missing: Callable[[list], list], most: int = 200_000, emptied: Callable[[], None] = lambda: None):
        super().__init__()
        self.missing_values, self.most, self.emptied = missing, most, emptied

    def learn(self, words: set | list) -> None:
        if new := [w for w in words if w not in self]:
            if len(self) + len(new) > self.most:
                self.clear()
                self.emptied()
                new = list(words)
            self.update(zip(new, self.missing_values(new), strict=True))
