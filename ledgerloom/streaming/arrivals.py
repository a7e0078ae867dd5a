"""Statement text arriving as files: the batch pipeline, run on every batch of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.proving import Proved, prove
from ledgerloom.sources.lines import split_pages
from ledgerloom.sources.rules import Rules
from ledgerloom.storage import Workspace, materialize, remove_path
from ledgerloom.streaming.accounts import AccountState

TABLES = ("statements", "transactions", "checks", "unparsed", "problems")


def arriving_pages(spark: SparkSession, folder: str, page_break: str = "\f", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream of pages, one document per file."""
    files = (spark.readStream.option("maxFilesPerTrigger", files_per_batch).schema("value string")
             .text(folder, wholetext=True))
    return split_pages(files.select(F.col("_metadata.file_path").alias("stmt_id"), "value"), page_break)


def append_batch(root: str, state: AccountState | None = None) -> Callable[[Proved, int], None]:
    """A sink that writes a batch under its own number, so a repeated batch replaces itself.

    A batch with a failed check, an unparsed line or a problem goes under ``held`` instead, for review; whichever of the two
    places a former run of the batch used, the other is cleared.  With ``state`` a batch also has to join up with what
    earlier published batches left of each account, and only a published batch moves the state on.
    """
    def write(proved: Proved, batch: int) -> None:
        spark = proved.transactions.sparkSession
        with Workspace(spark, "arrival"):
            problems = proved.problems
            if state is not None:
                problems = materialize(problems.unionByName(state.problems(batch, proved.statements)), "problems")
            clean = proved.totals().first()["can_generate"] and problems.isEmpty()
            to, other = (root, f"{root}/held") if clean else (f"{root}/held", root)
            frames = {"problems": problems, "transactions": proved.transactions.drop("txn_id")}
            for name in TABLES:
                frames.get(name, getattr(proved, name)).write.mode("overwrite").parquet(f"{to}/{name}/batch={batch}")
            for name in TABLES:
                remove_path(spark, f"{other}/{name}/batch={batch}")
            if state is not None:
                if clean:
                    state.publish(batch, proved.statements)
                else:
                    remove_path(spark, f"{state.root}/batch={batch}")

    return write


def ingest(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[Proved, int], None],
           rules: Rules | None = None) -> StreamingQuery:
    """Prove each batch of arriving files and hand it to ``sink``; runs over what is there, then stops."""
    def on_batch(pages: DataFrame, batch: int) -> None:
        proved = prove(pages, rules=rules)
        try:
            sink(proved, batch)
        finally:
            proved.close()

    return (arriving_pages(spark, folder).writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
