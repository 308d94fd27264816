"""Model calls whose answers are kept: a call that was answered is not made again.

An answer is stored under the digest of its request (provider, model, system text, messages, limit) as soon as the
few calls made at a time have returned. A task that starts again, or a job that is started again, reads the
digests that are stored for its requests and leaves those out; equal requests are one call. What an
interruption can repeat is no more than the ``concurrency`` calls that were under way in each task. Two attempts
of one task at a time would both call, so speculation must be off, which is Spark's default.

The store is a folder of small parquet files below one folder for each of :data:`SHELVES` shares of the digests. Files
appear whole, by a rename. It is reached through ``pyarrow.fs`` from tasks, as in ``sources.frames``.
"""

from __future__ import annotations

import posixpath
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators.inference import ModelCall
from promptloom.sources.frames import _store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Folders of a store, by the leading characters of the digest.
SHELVES = 256
_ANSWER = pa.schema(
    [("digest", pa.string()), ("text", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("error", pa.string()), ("tries", pa.int32())]
)
_STORED = "digest string, text string, input_tokens bigint, output_tokens bigint, error string, tries int"


def request_digest(requests: DataFrame, max_tokens: int | str) -> DataFrame:
    """Requests with their ``limit`` and ``digest``; null and empty texts differ."""
    limit = F.col(max_tokens) if isinstance(max_tokens, str) else F.lit(max_tokens)
    with_limit = requests.withColumn("limit", limit.cast("int"))
    fields = F.to_json(F.struct("provider", "model", "system", "messages", "limit"), {"ignoreNullFields": "false"})
    return with_limit.withColumn("digest", F.sha2(fields, 256))


def answered_digests(store: str, shelf: str) -> set[str]:
    """Digests on a shelf that have an answer; calls that failed are not among them."""
    files, root = _store(store)
    found = files.get_file_info(fs.FileSelector(posixpath.join(root, shelf), allow_not_found=True))
    out: set[str] = set()
    for f in found:
        if f.is_file and f.base_name.startswith("ok-") and f.base_name.endswith(".parquet"):
            out.update(pq.read_table(f.path, filesystem=files, columns=["digest"]).column("digest").to_pylist())
    return out


def _keep(store: str, shelf: str, rows: list[tuple]) -> None:
    """Answers, and failed calls apart from them, as files that appear whole."""
    files, root = _store(store)
    folder = posixpath.join(root, shelf)
    files.create_dir(folder, recursive=True)
    for start, some in (("ok-", [r for r in rows if r[4] is None]), ("failed-", [r for r in rows if r[4] is not None])):
        if some:
            name = posixpath.join(folder, f"{start}{uuid.uuid4().hex}.parquet")
            table = pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), _ANSWER, strict=True)], schema=_ANSWER)
            pq.write_table(table, name + ".tmp", filesystem=files)
            files.move(name + ".tmp", name)


def call_once(
    requests: Iterator[tuple], calls: dict[str, ModelCall], store: str, concurrency: int, tries: int, wait: float,
    sleep: Callable[[float], None] = time.sleep,
) -> Iterator[int]:
    """Make the calls of ``(digest, provider, model, system, messages, limit)`` rows that have no answer; how many, after each few.

    A call that fails is made again after ``wait`` seconds, twice as many the next time, up to ``tries`` times.
    """

    def answer(row: tuple) -> tuple:
        digest, provider, model, system, messages, limit = row
        for n in range(1, tries + 1):
            try:
                return (digest, *calls[provider](system, messages, model, limit), None, n)
            except Exception as e:
                failed = str(e)
                if n < tries:
                    sleep(wait * 2 ** (n - 1))
        return digest, None, 0, 0, failed, tries

    def pending() -> Iterator[tuple]:
        """Rows not yet answered, by shelf; a shelf's digests are read when its first row comes."""
        shelf, known = None, set()
        for row in requests:
            if row[0][:2] != shelf:
                shelf = row[0][:2]
                known = answered_digests(store, shelf)
            if row[0] not in known:
                known.add(row[0])
                yield row

    with ThreadPoolExecutor(concurrency) as pool:
        few: list[tuple] = []
        rows = pending()
        while True:
            row = next(rows, None)
            if few and (row is None or len(few) == concurrency or row[0][:2] != few[0][0][:2]):
                _keep(store, few[0][0][:2], list(pool.map(answer, few)))
                yield len(few)
                few = []
            if row is None:
                return
            few.append(row)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """One row per digest that was ever called: its answer, or else the error of a call that failed."""
    rows = spark.read.schema(_STORED).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(store)
    best = F.max_by(F.struct("text", "input_tokens", "output_tokens", "error"), F.struct(F.col("error").isNull(), "tries", "error", "text"))
    return rows.groupBy("digest").agg(best.alias("a")).select("digest", "a.*")


def infer_once(
    requests: DataFrame,
    calls: dict[str, ModelCall],
    keys: list[str],
    max_tokens: int | str,
    store: str,
    concurrency: int = 1,
    tries: int = 3,
    wait: float = 0.5,
    tasks: int | None = None,
) -> DataFrame:
    """``(keys, text, input_tokens, output_tokens, error)`` of every request, calling only those without a stored answer.

    ``requests`` and ``calls`` are those of ``inference.infer_table``, whose results these are. The calls are made when this
    function is called. A call that failed ``tries`` times gives its error and no usage, and is made again the next time.
    """
    spark = requests.sparkSession
    asked = request_digest(requests, max_tokens)
    files, root = _store(store)
    files.create_dir(root, recursive=True)
    done = stored_answers(spark, store).where("error IS NULL").select("digest")
    columns = ["digest", "provider", "model", "system", "messages", "limit"]
    open_ = asked.select(columns).dropDuplicates(["digest"]).join(done, "digest", "left_anti")
    # one shelf is one task's, so that what a task finds there is all that there is
    shelf = F.substring("digest", 1, 2)
    dealt = open_.repartition(tasks, shelf) if tasks else open_.repartition(shelf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in columns), strict=True))
        for n in call_once(rows, calls, store, concurrency, tries, wait):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    dealt.sortWithinPartitions("digest").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    found = stored_answers(spark, store)
    return asked.select(*keys, "digest").join(found, "digest", "left").select(*keys, "text", "input_tokens", "output_tokens", "error")
