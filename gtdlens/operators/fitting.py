"""Many fits at once: a bounded pool, predictions kept by partition, and a ledger that lets a lost driver go on.

A fit of a small table is a row of short jobs, so several fits share the executors. What a fit leaves behind goes to
the shared folder as it ends: predictions to a partition of their own, scores and models to a ledger of one small file
an entry. A later run on the same folder does only what is missing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Fits at work at a time; each is short of work for a whole cluster now and then.
PARALLEL_FITS = 16
# Rows of all fits at work together. A fit keeps each of its rows binned, and what does not fit the executors' memory is
# written to disk and read again at every level of every tree.
ROWS_AT_WORK = 10_000_000


def fits_at_once(rows: int, parallelism: int = PARALLEL_FITS) -> int:
    """How many fits of so many rows are at work at a time; two at least, so that one works while another waits for the driver."""
    return min(parallelism, max(2, ROWS_AT_WORK // max(rows, 1)))


def run_pool(
    spark: SparkSession,
    first: Iterable[Callable[[], object]],
    then: Callable[[object], Iterable[Callable[[], object]]] = lambda result: (),
    parallelism: int = PARALLEL_FITS,
) -> list[object]:
    """Results of all tasks, in the order they end. ``then`` names the tasks that a result makes possible.

    The first failure stops the tasks that have not begun and is raised.
    """
    results = []
    carried = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=max(parallelism, 1)) as pool:
        open_tasks: set[Future] = {pool.submit(carried(task)) for task in first}
        try:
            while open_tasks:
                done, open_tasks = wait(open_tasks, return_when=FIRST_COMPLETED)
                for future in done:
                    results.append(future.result())
                    open_tasks |= {pool.submit(carried(task)) for task in then(results[-1])}
        except BaseException:
            for future in open_tasks:
                future.cancel()
            raise
    return results


class _Folder:
    """A folder that all executors reach, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.root = self.hadoop.Path(path)
        self.system = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> Iterator[str]:
        if self.system.exists(self.root):
            for status in self.system.listStatus(self.root):
                yield status.getPath().getName()

    def has(self, name: str) -> bool:
        return self.system.exists(self.hadoop.Path(self.root, name))

    def write(self, name: str, text: str) -> None:
        """Under another name first, so that a file with its name is whole."""
        hidden, shown = self.hadoop.Path(self.root, f"_{name}"), self.hadoop.Path(self.root, name)
        stream = self.system.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.system.delete(shown, False)
        if not self.system.rename(hidden, shown):
            raise OSError(f"cannot write {shown}")


class Ledger:
    """What is finished of one search: an entry is a key, and rows that say what came of it."""

    SCHEMA = (
        "entry string, window_id int, trial_id bigint, fold int, score double, train_rows bigint, path string, search string"
    )

    def __init__(self, spark: SparkSession, path: str, search: str):
        """``search`` tells searches apart: a folder with another's entries is refused."""
        self.spark, self.path, self.search = spark, path, search
        self.folder = _Folder(spark, path)
        self.entries: dict[str, list[dict[str, object]]] = {}
        if any(not name.startswith(("_", ".")) for name in self.folder.names()):
            for row in self.table().collect():  # a row a fit and trial
                if row["search"] != search:
                    raise ValueError(f"{path} belongs to another search")
                self.entries.setdefault(row["entry"], []).append(row.asDict())

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def add(self, entry: str, rows: Iterable[Mapping[str, object]]) -> list[dict[str, object]]:
        kept = [{"entry": entry, "search": self.search, **row} for row in rows]
        self.folder.write(f"{entry}.json", "".join(json.dumps(row) + "\n" for row in kept))
        self.entries[entry] = kept
        return kept


def kept_by_partition(
    spark: SparkSession,
    root: str,
    column: str,
    predictions: Mapping[int, Callable[[], DataFrame]],
    parallelism: int = PARALLEL_FITS,
) -> DataFrame:
    """All predictions as one table, each in a partition of its own that is written as soon as it is there.

    A partition that a run before has finished is not made again. Reading takes one scan whatever the number of partitions.
    """

    def task(key: int, make: Callable[[], DataFrame]) -> Callable[[], None]:
        path = f"{root}/{column}={key}"

        def run() -> None:
            if not _Folder(spark, path).has("_SUCCESS"):
                make().write.mode("overwrite").parquet(path)

        return run

    run_pool(spark, [task(*item) for item in predictions.items()], parallelism=parallelism)
    return spark.read.option("basePath", root).parquet(*[f"{root}/{column}={key}" for key in predictions])
