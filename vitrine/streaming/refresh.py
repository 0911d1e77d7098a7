"""Adopting new price books as they arrive, each decision a commit of its own.

Below a state folder lie the books (``books/<number>``), what adopting one made
(``made/<number>``) and the commits (``commits/<number>``), one small file per book
that was considered. A commit appears by one rename, after everything it names is
written, so a reader sees a book with its results or neither; the current book is
the one that the last commit names. The number is the micro-batch's and the book's
place in it: a batch that is run again finds its commits and changes nothing, and
what a crash left without a commit is written anew under the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.book import judged, manifest
from vitrine.streaming.commits import Commits

COMMIT = "number string, as_of string, checked_on string, status string, reason string, updated string, live string"


def consider_book(
    new: DataFrame, state_path: str, number: str, checked_at, forced: bool = False, min_cards: int = 1000, keep: float = 0.9,
    on_adopt: Callable[[DataFrame, str], None] | None = None,
) -> dict:
    """Decide on one book, adopt it if it stands, and commit the decision under ``number``.

    Due once a day or when forced; a book of the current date is skipped; one
    that fails the consumer's check leaves the current book in place.
    ``on_adopt(book, path)`` writes what follows from a new book below ``path``,
    before the commit. A number that is committed already is not decided again.
    A book's cards are counted once; the commit keeps the count of the current book.
    """
    spark = new.sparkSession
    commits = Commits(spark, f"{state_path}/commits")
    done = commits.read(number)
    if done is not None:
        return done
    state = commits.before(number) or {}
    day, live = str(checked_at)[:10], state.get("live")
    head = manifest(new).first()
    row = {"as_of": head["updated"], "checked_on": day, "updated": state.get("updated"), "live": live, "cards": state.get("cards"), "reason": None}
    if not forced and state.get("checked_on") == day:
        row["status"] = "not due"
    elif live is not None and head["updated"] == state["updated"]:
        row["status"] = "current"
    else:
        if live is not None and row["cards"] is None:
            row["cards"] = manifest(spark.read.parquet(live)).first()["cards"]  # a commit made before counts were kept
        gate = judged(spark.range(1).select(
            F.lit(head["updated"]).alias("updated"), F.lit(head["cards"]).alias("cards"), F.lit(row["cards"] or 0).alias("previous")), keep, min_cards).first()
        row |= {"status": "updated" if gate["accepted"] else "refused", "reason": gate["reason"]}
        if gate["accepted"]:
            path = f"{state_path}/books/{number}"
            new.write.mode("overwrite").parquet(path)
            if on_adopt is not None:
                on_adopt(spark.read.parquet(path), f"{state_path}/made/{number}")
            row |= {"updated": head["updated"], "live": path, "cards": head["cards"]}
    if row["live"] is None:
        row["checked_on"] = None  # nothing stands yet: the next book is due at once
    return commits.write(number, row)


def price_refresh_stream(books: DataFrame, state_path: str, **options):
    """A stream writer that considers every arriving book, oldest first.

    ``books``: price rows with ``as_of`` and ``checked_at``. A batch is written once,
    one folder per book, however many books it holds.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{state_path}/staged/batch={batch_id}"
        keyed = batch.withColumns({"book_as_of": F.col("as_of"), "book_checked": F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")})
        keyed.write.mode("overwrite").partitionBy("book_checked", "book_as_of").parquet(staged)
        rows = spark.read.option("basePath", staged).schema(
            f"{', '.join(f'`{n}` {t}' for n, t in batch.dtypes)}, book_checked string, book_as_of string").parquet(staged)
        # One row per book in this batch; books are daily. Only folder names are read.
        seen = rows.select("book_checked", "book_as_of").distinct().orderBy("book_checked", "book_as_of").collect()
        for i, b in enumerate(seen):
            own = rows.filter(F.col("book_checked").eqNullSafe(b["book_checked"]) & F.col("book_as_of").eqNullSafe(b["book_as_of"]))
            consider_book(own.drop("book_checked", "book_as_of", "checked_at"), state_path, f"{batch_id:012d}-{i:06d}", b["book_checked"], **options)

    return books.writeStream.foreachBatch(each)


def verdicts(spark: SparkSession, state_path: str) -> DataFrame:
    """Every decision in order: one small row per book."""
    commits = Commits(spark, f"{state_path}/commits")
    rows = [commits.read(n) for n in commits.numbers()]
    names = [f.split()[0] for f in COMMIT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COMMIT)


def current_book(spark: SparkSession, state_path: str) -> DataFrame | None:
    """The book that the last commit names; ``None`` before the first adoption."""
    commits = Commits(spark, f"{state_path}/commits")
    numbers = commits.numbers()
    live = commits.read(numbers[-1])["live"] if numbers else None
    return None if live is None else spark.read.parquet(live)
