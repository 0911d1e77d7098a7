"""Live recognition in two streams: frames become reads, reads become hits.

Whether a frame is searched depends on the results before it: a frame that
looks like the last one inherits its result, and what is searched is a vote
over the frames that were read. The search itself is distributed and knows no
device. Both meet in rounds: a small machine per device runs over the frames of
a micro-batch, and where a result is missing it asks for it, in both
orientations, and goes on from every state the result could leave: accepted or
refused, turned or not. States that agree in all that later frames depend on are
one, so they stay few: what sets them apart is forgotten within a ring of votes.
All that was asked for is searched at once, against references in blocks; then
the devices that had to guess run again from their first guess. That is two
rounds, however many frames a batch has, unless a device's states outgrow
``GUESSES``; every round settles at least one frame of every open device, so
they end.

References are never on the driver nor in a task as a whole, and their number
has no bound. Rows stream through the machines; only one device's small state
is held. Reads and states are versions: a batch that is run again finds its
commit, or writes the same once more.

Frames without a device or a number are dropped, repeated frames of a device
count once, and frames later than the watermark are dropped and counted.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import hamming as H
from vitrine.operators import rank as R
from vitrine.operators.blocks import block_count
from vitrine.session import settle
from vitrine.streaming.commits import Commits
from vitrine.streaming.confirm import IDLE, confirm_hits, drop_late
from vitrine.streaming.folds import NEAR, VOTE_DRIFT, Dumpable, Vote, reuse_marks, views_alike

PARTS, BUCKETS = 4, 16
GUESSES = 64  # states of a device followed at once; what lies behind others is asked for in a later round
FRAMES = {
    "device": "bigint", "frame_no": "bigint", "ts": "timestamp", "detected": "boolean", "area": "double", "signature": "array<double>",
    "desc": "array<bigint>", "strip": "array<bigint>", "turned_desc": "array<bigint>", "turned_strip": "array<bigint>",
}
_READ = (
    "device bigint, frame_no bigint, ts timestamp, detected boolean, accepted boolean, best_id bigint, best_distance double, runner_id bigint, "
    "margin bigint, reused boolean, origin bigint, orientation string")
_STATE = "device bigint, state string, last_ts timestamp, number string, bucket int"
_RESULT = {"request_id": "string", "reach": "bigint", "item": "bigint", "distance": "bigint", "rival": "bigint", "margin": "bigint", "accepted": "boolean"}
_PASS = pa.schema([
    ("kind", pa.string()), ("device", pa.int64()), ("frame_no", pa.int64()), ("at", pa.int64()), ("detected", pa.bool_()), ("accepted", pa.bool_()),
    ("best_id", pa.int64()), ("best_distance", pa.float64()), ("runner_id", pa.int64()), ("margin", pa.int64()), ("reused", pa.bool_()), ("origin", pa.int64()),
    ("orientation", pa.string()), ("request_id", pa.string()), ("words", pa.list_(pa.int64())), ("strip", pa.list_(pa.int64())), ("state", pa.string())])
_PASS_SQL = (
    "kind string, device bigint, frame_no bigint, at bigint, detected boolean, accepted boolean, best_id bigint, best_distance double, runner_id bigint, "
    "margin bigint, reused boolean, origin bigint, orientation string, request_id string, words array<bigint>, strip array<bigint>, state string")


@dataclass
class Device(Dumpable):
    """What a device remembers from frame to frame.

    ``result`` is what the last read found (item, distance, rival, margin),
    ``origin`` the frame it was found on, ``turned`` the orientation that worked last.
    """

    view: list | None = None
    good: bool = False
    run: int = 0
    result: list | None = None
    origin: int | None = None
    turned: bool = False
    vote: dict = field(default_factory=dict)

    def decides(self) -> tuple:
        """What later steps depend on and states behind one frame may differ in; a run of inherited reads counts behind a good one only."""
        vote = self.vote or {"ring": [], "blanks": 0}
        return self.good, self.good and self.run, self.turned, vote["blanks"], tuple(map(tuple, vote["ring"]))

    def branches(self, frame: dict, known: dict, gate: int, drift: int) -> tuple[list, list[tuple]]:
        """Every state this one may leave for, as far as results are known, and the searches lacking."""
        after = copy.copy(self)
        _, lacks = after.step(frame, known, gate, drift)
        if not lacks:
            return [after], lacks
        out = [after]
        if any(turned == after.turned for turned, _, _ in lacks):
            out.append(replace(after, good=False, run=self.run))
        if frame["desc" if after.turned else "turned_desc"] is not None:
            turned = replace(after, good=True, run=0, turned=not after.turned, vote=after.vote | {"ring": []})
            out += [turned, replace(turned, good=False, run=self.run)]
        return out, lacks

    def step(self, frame: dict, known: dict, gate: int, drift: int) -> tuple[dict, list[tuple]]:
        """The read of one frame, and the searches ``(turned, words, strip)`` it lacks.

        ``known`` maps ``(turned, words)`` to a finished search. Where its own
        result is lacking, a read passes for accepted; where the other
        orientation's is, its own passes for the better one.
        """
        vote = Vote(**({"drift": drift} | self.vote))
        read = {"detected": False, "accepted": False, "reused": False}
        if not frame["detected"]:
            vote.blank()
            self.vote = vars(vote)
            return read, []
        lacks, accepted, now = [], None, (frame["area"], frame["signature"] or ())
        (alike,) = views_alike(*zip(self.view or (0, ()), now))
        (reused,), _, _ = reuse_marks([alike], [False], self.good, self.run)
        if not reused:
            sides = {False: (frame["desc"], frame["strip"]), True: (frame["turned_desc"], frame["turned_strip"])}
            if sides[self.turned][0] is None:
                self.turned = not self.turned
            words, strip = sides[self.turned]
            found, other = None, sides[not self.turned]
            if words is not None:
                words, _depth = vote.add(words)
                found = known.get((self.turned, tuple(words)))
                if found is None:
                    lacks.append((self.turned, words, strip))
                    if other[0] is not None and (not self.turned, tuple(other[0])) not in known:
                        lacks.append((not self.turned, *other))
                elif other[0] is not None and (found["reach"] is None or found["reach"] > gate):
                    second = known.get((not self.turned, tuple(other[0])))
                    if second is None:
                        lacks.append((not self.turned, *other))
                    elif second["reach"] is not None and (found["reach"] is None or second["reach"] < found["reach"]):
                        # The ring holds the other orientation, which has no vote on this one.
                        found, self.turned, vote.ring = second, not self.turned, []
            accepted = bool(found and found["accepted"])
            if lacks and found is None:
                accepted = True
            found = found or {}
            self.result, self.origin = [found.get(x) for x in ("item", "distance", "rival", "margin")], frame["frame_no"]
            read["request_id"] = found.get("request_id")
        accepted = reused or accepted
        _, self.good, self.run = reuse_marks([alike], [accepted], self.good, self.run)
        self.view, self.vote = list(now), vars(vote)
        item, distance, rival, margin = self.result
        return read | {
            "detected": True, "accepted": accepted, "reused": reused, "best_id": item, "best_distance": distance, "runner_id": rival, "margin": margin,
            "origin": self.origin, "orientation": "flipped" if self.turned else "upright"}, lacks


def request_id(device: int, frame: int, turned: bool, words: list) -> str:
    return f"{device}:{frame}:{int(turned)}:" + ".".join(map(str, words))


def _run(frames: DataFrame, states: DataFrame, results: DataFrame, gate: int, drift: int) -> DataFrame:
    """All devices over their frames as far as their results go.

    Rows of four kinds leave: ``read`` and ``ask``, ``done`` with the state
    behind the last frame, or ``open`` with the state before the first frame
    that could not be settled, and that frame's number.
    """
    rows = (
        states.select("device", F.lit(0).alias("side"), "state")
        .unionByName(results.withColumn("side", F.lit(1)), allowMissingColumns=True)
        .unionByName(frames.withColumn("side", F.lit(2)), allowMissingColumns=True))
    rows = rows.repartition("device").sortWithinPartitions("device", F.col("side") > 0, "frame_no", "side")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        device, first, at, exact, may, known, out = None, None, None, Device(), [], {}, []

        def end():
            if device is not None and at is not None:
                out.append({"kind": "done" if first is None else "open", "device": device, "frame_no": first, "at": at, "state": exact.dump()})

        for batch in batches:
            for row in batch.to_pylist():
                if row["device"] != device:
                    end()
                    device, first, at, exact, may, known = row["device"], None, None, Device(), [], {}
                if row["side"] == 0:
                    exact = Device.load(row["state"])
                    continue
                if row["side"] == 1:
                    known[row["frame_no"], row["turned"], tuple(row["words"])] = row
                    continue
                frame = row["frame_no"]
                here = {k[1:]: v for k, v in known.items() if k[0] == frame}
                known, lacks = {}, []
                if first is None:
                    before = exact.dump()
                    read, lacks = exact.step(row, here, gate, drift)
                    if not lacks:
                        at = row["at"]
                        out.append(read | {"kind": "read", "device": device, "frame_no": frame, "at": at})
                    else:
                        first, at, exact = frame, row["at"], Device.load(before)
                        may = [Device.load(before)]
                if first is not None:
                    asked, after = set(), {}
                    for one in may:
                        leaves, lacks = one.branches(row, here, gate, drift)
                        for machine in leaves:
                            if len(after) < GUESSES:
                                after.setdefault(machine.decides(), machine)
                        for turned, words, strip in lacks:
                            name = request_id(device, frame, turned, words)
                            if name not in asked:
                                asked.add(name)
                                out.append({"kind": "ask", "device": device, "frame_no": frame, "request_id": name, "words": words, "strip": strip,
                                            "orientation": "flipped" if turned else "upright"})
                    may = list(after.values())
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, _PASS)
                    out.clear()
        end()
        if out:
            yield pa.RecordBatch.from_pylist(out, _PASS)

    columns = ["device", "side", "frame_no", "at", "detected", "area", "signature", "desc", "strip", "turned_desc", "turned_strip",
               "turned", "words", *_RESULT, "state"]
    return rows.select(*columns).mapInArrow(over, _PASS_SQL)


def search(asks: DataFrame, refs: DataFrame, n_words: int, bits: int, blocks: int, max_distance: int, min_name_margin: int, hit: dict) -> DataFrame:
    """Judge what was asked for: nearest references, acceptance, footer, runners-up, ambiguity.

    One row per ``request_id``; ``item`` is the winner after the footer, ``rival``
    the nearest other reference, ``reach`` the distance of the very nearest.
    """
    carry = [x for x in refs.columns if x not in ("ref_id", "desc")]
    queries = asks.select("request_id", "device", "frame_no", "orientation", F.col("words").alias("desc"), F.col("words").alias("asked"), "strip")
    near = H.hamming_nearest(
        queries, refs, R.NAME_MARGIN_K, n_words, query_id="request_id", keep=["device", "frame_no", "orientation", "asked", "strip"], carry=carry,
        blocks=blocks)
    near = near.withColumn("best_distance", F.get("nearest", F.lit(0))["distance"]).withColumn("name_margin", R.name_margin(F.col("nearest")))
    strips = sum(x.startswith("ref_strip_") for x in carry)
    judged = R.build_hits(R.accept_reads(near, max_distance, min_name_margin), bits, has_strip=strips > 0, strip_words=strips, **hit)
    other = F.get(F.filter("nearest", lambda r: r["ref_id"] != F.col("winner")), F.lit(0))
    return judged.select(
        "request_id", "device", "frame_no", (F.col("orientation") == "flipped").alias("turned"), F.col("asked").alias("words"),
        F.col("best_distance").cast("bigint").alias("reach"), F.col("winner").cast("bigint").alias("item"), F.col("distance").cast("bigint").alias("distance"),
        other["ref_id"].cast("bigint").alias("rival"), "margin", "accepted", "price", "confidence", "resolved", "ambiguous", "runners_up", "alternatives")


_FOUND = ["price", "confidence", "resolved", "ambiguous", "runners_up", "alternatives"]


def _newest(spark: SparkSession, path: str, parts: list) -> DataFrame:
    rows = [spark.read.schema(_STATE).parquet(f"{path}/states/{number}") for number, _ in parts]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    newest = out.groupBy("bucket", "device").agg(F.max_by(F.struct("state", "last_ts", "number"), "number").alias("v"))
    return newest.select("bucket", "device", "v.*")


def _write_states(rows: DataFrame, path: str, number: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/states/{number}")


def read_batch(frames: DataFrame, refs: DataFrame, path: str, number: str, n_words: int, bits: int, blocks: int, max_distance: int = R.MAX_DISTANCE,
               min_name_margin: int = R.MIN_NAME_MARGIN, max_drift: int = VOTE_DRIFT, flip_gate: int = R.FLIP_LIVE, idle: str = IDLE, hit: dict | None = None) -> int:
    """Read the frames of one batch and commit reads and states under ``number``; returns the rounds it took.

    Only states of the batch's devices are read, and only those are written;
    parts of states are merged like digits are carried. A device that was silent
    for ``idle`` of event time starts anew, and leaves the tables when its part is merged.
    """
    spark = frames.sparkSession
    commits = Commits(spark, f"{path}/commits")
    if commits.read(number) is not None:
        return 0
    before = commits.before(number) or {"parts": [], "latest": None}
    parts = list(before["parts"])
    bucket = F.pmod(F.xxhash64("device"), F.lit(BUCKETS)).cast("int")
    frames = settle(frames.withColumn("at", F.unix_micros("ts")).withColumn("detected", F.coalesce("detected", F.lit(False))))
    newest = frames.agg(F.max("at")).first()[0]
    latest = max((x for x in (newest, before["latest"]) if x is not None), default=None)
    alive = F.lit(True)
    if latest is not None:
        oldest = latest - pd.Timedelta(idle) // pd.Timedelta(microseconds=1)
        alive = F.coalesce(F.unix_micros("last_ts") >= oldest, F.lit(True))
    states = spark.createDataFrame([], "device bigint, state string")
    if parts:
        here = frames.select("device").distinct().withColumn("bucket", bucket)
        states = _newest(spark, path, parts).filter(alive).join(here, ["bucket", "device"], "left_semi").select("device", "state")
    results = spark.createDataFrame(
        [], "device bigint, frame_no bigint, turned boolean, words array<bigint>, " + ", ".join(f"{n} {t}" for n, t in _RESULT.items()))
    found, passes, left = [], [], frames
    while True:
        passes.append(settle(_run(left, states, results, flip_gate, max_drift)))
        asks = passes[-1].filter("kind = 'ask'")
        if asks.isEmpty():
            break
        found.append(settle(search(asks, refs, n_words, bits, blocks, max_distance, min_name_margin, hit or {})))
        results = found[0]
        for more in found[1:]:
            results = results.unionByName(more)
        results = results.select("device", "frame_no", "turned", "words", *_RESULT)
        still = passes[-1].filter("kind = 'open'").select("device", F.col("frame_no").alias("first"), "state")
        states = still.select("device", "state")
        ahead = lambda df: df.join(still.select("device", "first"), "device").filter(F.col("frame_no") >= F.col("first")).drop("first")  # noqa: E731, B023
        left, results = ahead(frames), ahead(results)
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)
    reads = rows.filter("kind = 'read'").withColumn("ts", F.timestamp_micros("at"))
    names = [x.strip().split()[0] for x in _READ.split(",")]
    judged = search(rows.filter("false"), refs, n_words, bits, blocks, max_distance, min_name_margin, hit or {}) if not found else found[0]
    for more in found[1:]:
        judged = judged.unionByName(more)
    reads = reads.select(*names, "request_id").join(judged.select("request_id", *_FOUND), "request_id", "left").drop("request_id")
    # A device's reads of a batch are in one file, in order.
    reads.repartition("device").sortWithinPartitions("device", "frame_no").write.mode("overwrite").parquet(f"{path}/made/{number}")
    done = rows.filter("kind = 'done'").select(
        "device", "state", F.timestamp_micros("at").alias("last_ts"), F.lit(number).alias("number"), bucket.alias("bucket"))
    _write_states(done, path, number)
    parts.append([number, 0])
    while len(parts) >= PARTS and len({level for _, level in parts[-PARTS:]}) == 1:
        level = parts[-1][1] + 1
        _write_states(_newest(spark, path, parts[-PARTS:]).filter(alive), path, f"{number}-{level}")
        parts = [*parts[:-PARTS], [f"{number}-{level}", level]]
    commits.publish(f"{path}/made/{number}", f"{path}/reads/{number}")
    commits.write(number, {"parts": parts, "latest": latest, "rounds": len(passes)})
    named = {name for name, _ in parts + before["parts"]}
    for folder in commits.folders(f"{path}/states"):
        if folder not in named:
            commits.remove(f"{path}/states/{folder}")
    return len(passes)


def live_reads(stream: DataFrame, refs: DataFrame, path: str, n_words: int, bits: int, delay: str = "1 hour", **options):
    """A stream writer that turns frames into reads below ``path``; see :func:`reads_stream`.

    ``stream``: ``device, frame_no, ts, detected, area, signature, desc`` and,
    where there are any, ``strip`` (footer), ``turned_desc`` and ``turned_strip``
    (the frame upside down; it is searched where the orientation that worked last
    fails the gate). ``refs``: ``ref_id, desc, name`` and optionally ``price`` and
    ``ref_strip_<w>``. Further columns are left out.
    """
    for name, kind in FRAMES.items():
        stream = stream.withColumn(name, (F.col(name) if name in stream.columns else F.lit(None)).cast(kind))
    frames = stream.select(*FRAMES).filter(F.col("device").isNotNull() & F.col("frame_no").isNotNull())
    frames = frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["device", "frame_no"])
    if "price" not in refs.columns:
        refs = refs.withColumn("price", F.lit(None).cast("double"))
    keep = [x for x in refs.columns if x in ("ref_id", "desc", "name", "price") or x.startswith("ref_strip_")]
    refs = settle(refs.select(*keep))
    blocks = block_count(refs)

    def each(batch: DataFrame, batch_id: int) -> None:
        read_batch(batch, refs, path, f"{batch_id:012d}", n_words, bits, blocks, **options)

    return frames.writeStream.foreachBatch(each)


def stored_reads(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """The reads below ``path``, with what the search says of each that was not inherited."""
    return spark.read.schema(reads_schema(refs)).parquet(f"{path}/reads/*")


def reads_schema(refs: DataFrame) -> str:
    kinds = dict(refs.dtypes)
    strips = ", ".join(f"{x}: bigint" for x in refs.columns if x.startswith("ref_strip_"))
    row = f"struct<distance: bigint, ref_id: {kinds['ref_id']}, name: string, price: {kinds.get('price', 'double')}{', ' + strips if strips else ''}>"
    return _READ + f", price {kinds.get('price', 'double')}, confidence double, resolved boolean, ambiguous boolean, runners_up array<{row}>, alternatives array<{row}>"


def reads_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The committed reads below ``path`` as a stream, oldest batch first, for :func:`confirm_hits`."""
    return spark.readStream.schema(_READ).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/reads/*")


def live_hits(spark: SparkSession, path: str, delay: str = "1 hour", near: int = NEAR, **config) -> DataFrame:
    """Confirmed hits of the reads below ``path``, as a stream."""
    return confirm_hits(drop_late(reads_stream(spark, path), delay), near=near, **config)


def hits_with_rivals(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """Price, confidence, runners-up and costly rivals of hits, from the search their sharpest read rests on."""
    rests = reads.select("device", F.col("frame_no").alias("sharpest_frame"), "origin", "orientation")
    found = reads.select("device", F.col("frame_no").alias("origin"), *_FOUND)
    return hits.join(rests, ["device", "sharpest_frame"], "left").join(found, ["device", "origin"], "left")
