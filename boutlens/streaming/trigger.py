"""Count-triggered training over a stream of bouts.

Arriving bouts are written to one folder per micro-batch.  A list of the folders that no training has used is kept beside them,
one small file per micro-batch, of which only the newest two stay.  When the folders on it hold at least ``size`` rows, the training
callback gets them all and the list becomes empty.  So a micro-batch reads its own folder, the newest list and, when it trains,
the folders on the list: as many files after a year as on the first day.  The buffer is a table, not keyed state, so it
is never held by one task, and a replayed micro-batch overwrites its own folder and list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from boutlens import constants as K


class CountTrigger:
    """Buffer with the states empty, buffered and trained."""

    def __init__(self, spark: SparkSession, path: str, train: Callable[[DataFrame, int], None], schema: str,
                 size: int = K.BATCH_TRAIN_SIZE, training: bool = True):
        self.spark, self.path, self.train, self.schema, self.size, self.training = spark, path.rstrip("/"), train, schema, size, training

    def _fs(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _lists(self) -> list[int]:
        """Micro-batches whose list is still there, in order."""
        fs, path = self._fs("open")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removeprefix("upto=")) for n in names if n.startswith("upto="))

    def _open(self, before: int | None = None) -> tuple[int, list[tuple[int, int]]]:
        """The newest list (of a micro-batch below ``before``): its number, and (batch_id, rows) of the folders on it.

        They are fewer than ``size``, since an empty micro-batch is not listed.
        """
        upto = max((k for k in self._lists() if before is None or k < before), default=-1)
        if upto < 0:
            return -1, []
        rows = self.spark.read.schema("batch_id long, rows long").parquet(f"{self.path}/open/upto={upto}").collect()
        return upto, sorted((r["batch_id"], r["rows"]) for r in rows)

    def _keep(self, upto: int, folders: list[tuple[int, int]]) -> None:
        """Write the list of a micro-batch; lists older than the one before it are deleted."""
        self.spark.createDataFrame(folders, "batch_id long, rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/open/upto={upto}")
        for old in self._lists()[:-2]:
            fs, path = self._fs(f"open/upto={old}")
            fs.delete(path, True)

    def _rows(self, folders: list[tuple[int, int]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], f"{self.schema}, batch_id long")
        paths = [f"{self.path}/pending/batch_id={k}" for k, _ in folders]
        return self.spark.read.schema(f"{self.schema}, batch_id long").option("basePath", f"{self.path}/pending").parquet(*paths)

    def pending(self) -> DataFrame:
        """Rows of micro-batches that no training has used."""
        return self._rows(self._open()[1])

    def status(self) -> dict:
        n = sum(rows for _, rows in self._open()[1])
        return {"buffer_size": n, "batch_size": self.size, "is_training": self.training, "fights_remaining": self.size - n}

    def on_batch(self, rows: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function.  Outside training mode rows are only predicted, never buffered."""
        if not self.training:
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/pending/batch_id={batch_id}")
        n = self._rows([(batch_id, 0)]).count()
        _, folders = self._open(batch_id)
        self._settle(batch_id, [*folders, (batch_id, n)] if n else folders)

    def flush(self) -> str:
        """Train on everything pending if that is at least ``size`` rows."""
        upto, folders = self._open()
        return self._settle(upto, folders) if folders else "empty"

    def _settle(self, upto: int, folders: list[tuple[int, int]]) -> str:
        full = sum(n for _, n in folders) >= self.size
        if full:
            self.train(self._rows(folders), max(k for k, _ in folders))
        self._keep(upto, [] if full else folders)
        return "trained" if full else "buffered"

    def set_training(self, enabled: bool) -> str:
        """Switch the mode; a full buffer is trained before it is switched off."""
        done = "mode_changed" if enabled else self.flush()
        self.training = enabled
        return done

    def start(self, bouts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (bouts.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
