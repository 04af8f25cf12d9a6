"""What the corpus operators share: shared folders, batch sizes, word and hash helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import discard, shared_root, spread, work_dir, written  # noqa: F401

#: Rows that a worker turns into Python objects at once. Arrow batches themselves are bounded in bytes by Spark.
BATCH_ROWS = 1000
#: What a 64-bit polynomial over words is multiplied by; odd, so that no step loses bits.
BASE = 0x9E3779B97F4A7C15


def sliced(batches, rows: int = BATCH_ROWS):
    """Arrow batches in slices of at most `rows` rows."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def keyed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): further columns of the input, whatever their names, never meet ours."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(own) if name in ("documents", "pages") else own


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size word hashes: a polynomial, put together from runs of 1, 2, 4 ... words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, run, length, power = None, 0, words, 1, np.uint64(BASE)
        scale = np.uint64(1)
        while True:
            if size & length:
                part = run[done : done + n]
                out = part.copy() if out is None else out + scale * part
                done += length
                scale = scale * power
            if done == size:
                return mixed(out)
            run = run[:-length] + power * run[length:]
            power = power * power
            length *= 2


#: What this worker process keeps between tasks, and what its task asked for.
_kept: dict = {}
_asked: set = set()


def worker_keeps(key, make):
    """What make() gives; the worker keeps it for the next tasks of the same kind. Before another thing is made, and once a task has begun that did not
    ask for it (`begun`), it goes, so that the stages of a pipeline do not add up in the workers that they share."""
    _asked.add(key)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def begun(start):
    """start(), at the beginning of a task."""
    _asked.clear()
    work = start()
    for key in _kept.keys() - _asked:
        del _kept[key]
    return work


def mapped(df: DataFrame, start, read: list[str], keep: list[str], added: str) -> DataFrame:
    """The columns `keep`, passed through as they are, with the columns of the DDL string `added`.

    start() is called once for each task and gives a function from {column: values} of a batch, for the columns
    `read`, to {column: values} for the added ones. If it has close(), that is called before the task ends.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T._parse_datatype_string(added)
    schema = T.StructType([df.schema[c] for c in keep] + new.fields)
    kinds = to_arrow_schema(new)

    def run(batches):
        work = begun(start)
        for b in sliced(batches):
            got = work({c: b.column(c).to_pylist() for c in read})
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(got[f.name], f.type) for f in kinds], names=[*keep, *kinds.names])
        if hasattr(work, "close"):
            work.close()

    return df.mapInArrow(run, schema)


def kept_where(df: DataFrame, start, column: str) -> DataFrame:
    """The rows of df, with all columns as they are, for which the function that start() gives answers true to `column`."""
    import pyarrow as pa

    def run(batches):
        good = begun(start)
        for b in sliced(batches):
            yield b.filter(pa.array([good(x) for x in b.column(column).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


# --- hashes of all words of a text at once ---

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and a fixed odd multiplier with its inverse mod 2^64.
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0xD1342543DE82EF95
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for k, x in (("up", STEP), ("down", pow(STEP, -1, 1 << 64))):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes without ASCII white space), in order, for the whole text at once.

    Prefix sums of byte values times powers of STEP give the polynomial of any stretch; dividing by the power at a word's
    start makes it independent of place.
    """
    if not raw:
        return np.empty(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    return span_hashes(data, starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each stretch of bytes, the same at any place."""
    up, down = _powers_for(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])
