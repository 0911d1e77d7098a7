"""Sources, sinks, gates, audits and images on small literal inputs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import audit as A
from vitrine.operators import book as P
from vitrine.operators import catalogue as C
from vitrine.operators import images as I
from vitrine.sources import fingerprints as SF
from vitrine.sources import images as SI
from vitrine.streaming import refresh as RF


def file_bytes(version=2, rows=3, row_bytes=96, strip=15, cut=0):
    head = b"PKSC" + struct.pack("<HHHI", version, 742, row_bytes, rows) + (struct.pack("<HH", 116, strip) if version == 2 else b"")
    body = b"".join(bytes([i]) * row_bytes for i in range(rows))
    strips = b"".join(bytes([100 + i]) * strip for i in range(rows)) if version == 2 else b""
    data = head + body + strips
    return data[: len(data) - cut]


def test_fingerprint_files(spark, tmp_path):
    for v in (1, 2):
        (tmp_path / f"v{v}.bin").write_bytes(file_bytes(v))
    two = SF.read_fingerprint_file(spark, str(tmp_path / "v2.bin")).orderBy("row_id").collect()
    assert [(r.row_id, bytes(r.desc), bytes(r.strip)) for r in two] == [(i, bytes([i]) * 96, bytes([100 + i]) * 15) for i in range(3)]
    one = SF.read_fingerprint_file(spark, str(tmp_path / "v1.bin")).collect()
    assert len(one) == 3 and all(r.strip is None for r in one)


@pytest.mark.parametrize("data, reason", [
    (b"NOPE" + file_bytes()[4:], "bad magic"), (file_bytes(row_bytes=95), "aligned"), (file_bytes(row_bytes=92), "row width"),
    (file_bytes(cut=1), "truncated"), (file_bytes()[:4] + struct.pack("<H", 9) + file_bytes()[6:], "version"), (file_bytes(strip=14), "footer")])
def test_bad_fingerprint_files(spark, data, reason):
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    with pytest.raises(Exception, match=reason):
        SF.parse_fingerprints(df).collect()


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def by_hand(bgr):
    """Descriptor bits with plain loops."""
    grey = [[int(np.floor(0.299 * int(p[2]) + 0.587 * int(p[1]) + 0.114 * int(p[0]))) for p in row] for row in bgr]

    def cells(plane, y0, y1, x0, x1, gx, gy):
        ch, cw = (y1 - y0) // gy, (x1 - x0) // gx
        return [[sum(plane[y][x] for y in range(y0 + j * ch, y0 + (j + 1) * ch) for x in range(x0 + i * cw, x0 + (i + 1) * cw)) for i in range(gx)] for j in range(gy)]

    across = lambda g: [int(r[i + 1] > r[i]) for r in g for i in range(len(r) - 1)]
    full = cells(grey, 0, 336, 0, 240, 16, 16)
    bits = across(full) + [int(full[j + 1][i] > full[j][i]) for j in range(15) for i in range(16)] + across(cells(grey, 42, 168, 30, 210, 12, 14))
    for ch in range(3):
        flat = [v for r in cells([[int(p[ch]) for p in row] for row in bgr], 0, 336, 0, 240, 6, 6) for v in r]
        mid = sorted(flat)
        bits += [int(v > (mid[17] + mid[18]) / 2) for v in flat]
    return bits, across(cells(grey, 300, 336, 0, 240, 30, 4))


def test_images_to_fingerprints(spark, tmp_path):
    rng = np.random.default_rng(1)
    pictures = {f"c{i}": rng.integers(0, 256, (336, 240, 3), dtype=np.uint8) for i in range(2)}
    for name, rgb in pictures.items():
        (tmp_path / f"{name}.png").write_bytes(png(rgb))
    (tmp_path / "broken.png").write_bytes(b"no image")
    wanted = spark.createDataFrame([("c0",), ("c1",), ("gone",)], "image_id string")
    good, bad = SI.read_images(spark, str(tmp_path), wanted)
    assert {(r.image_id, r.reason) for r in bad.collect()} == {("broken", "unreadable"), ("gone", "missing")}
    catalogue = spark.createDataFrame([("c1", 0), ("gone", 1), ("c0", 2)], "card_id string, position bigint")
    index, missing = I.build_index(catalogue, good)
    rows = {r.card_id: r for r in index.collect()}
    assert [rows[c].row_id for c in ("c1", "c0")] == [0, 1] and [r.card_id for r in missing.collect()] == ["gone"]
    for name, rgb in pictures.items():
        bits, strip = by_hand(rgb[:, :, ::-1])
        assert len(bits) == 742 and len(strip) == 116
        assert np.unpackbits(np.frombuffer(rows[name].desc, np.uint8))[:742].tolist() == bits
        assert np.unpackbits(np.frombuffer(rows[name].strip, np.uint8))[:116].tolist() == strip


def test_trim_and_resize(spark):
    image = np.full((80, 60, 3), 250, np.uint8)
    image[10:70, 12:50] = 30
    flat = np.full((80, 60, 3), 250, np.uint8)
    df = spark.createDataFrame([("a", 60, 80, bytearray(image.tobytes())), ("b", 60, 80, bytearray(flat.tobytes()))],
                               "image_id string, width int, height int, data binary")
    got = {r.image_id: (r.width, r.height) for r in I.trim_border(df).collect()}
    assert got == {"a": (38, 60), "b": (60, 80)}
    fitted = I.fit_canonical(df).first()
    assert (fitted.width, fitted.height, len(fitted.data)) == (240, 336, 240 * 336 * 3)
    sharp = {r.image_id: r.sharpness for r in I.image_sharpness(df).collect()}
    assert sharp["b"] == 0.0 < sharp["a"]


def test_audit_finds_lines(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    text = "one\ntwo " + key + "\n" + "tok" + "en =\n '" + "x" * 20 + "'\nme@example.org you@example.org\nC:" + "\\Users\\me\n-----BEGIN " + "PRIVATE KEY"
    df = spark.createDataFrame([(1, text, "a.txt"), (2, text, "b.PNG"), (3, "clean", "c.md")], "doc_id int, text string, path string")
    got = sorted((r.line, r.label, r.severity) for r in A.audit_text(df, allowed_emails=["ME@example.org"], path="path").collect())
    assert got == [(2, "AWS access key", "block"), (3, "generic secret assignment", "block"), (5, "email address", "warn"),
                   (6, "Windows absolute path", "warn"), (7, "private key block", "block")]
    assert not A.audit_verdict(A.audit_text(df)).first().passed


def test_gates(spark):
    book = lambda n, day: spark.range(n).select(F.col("id").alias("card_id"), F.lit("N").alias("variant"), F.lit(1.0).alias("market"), F.lit(day).alias("as_of"))
    reason = lambda *a, **k: P.publish_gate(*a, **k).first().reason
    assert reason(book(100, "d"), book(110, "c"), min_cards=10) is None
    assert reason(book(100, "d"), book(120, "c"), min_cards=10) == "lost too many cards"
    assert reason(book(100, "d"), book(0, "c")) == "too few cards"
    assert reason(book(100, None), book(0, "c"), min_cards=1) == "no date"
    newer = P.prefer_newer_book(book(50, "2026-01-01"), book(49, "2026-01-02"), min_cards=10)
    assert newer.count() == 49 and P.prefer_newer_book(book(50, "2026-01-02"), book(50, "2026-01-01"), min_cards=10).first().chosen == "bundled"


def book_of(spark, n, day):
    return spark.range(n).select(F.col("id").alias("card_id"), F.lit("N").alias("variant"), F.lit(1.0).alias("market"), F.lit(day).alias("as_of"))


def test_refresh_verdicts(spark, tmp_path):
    state = str(tmp_path / "state")
    adopted = []
    numbers = iter(range(99))

    def run(n, day, at, **k):
        return RF.consider_book(book_of(spark, n, day), state, f"{next(numbers):03d}", at, min_cards=10, on_adopt=lambda df, path: adopted.append(df.count()), **k)["status"]

    assert RF.current_book(spark, state) is None
    assert run(5, "2026-08-13", "2026-08-13 07:00") == "refused"  # nothing stands yet, so the next is due
    assert run(100, "2026-08-13", "2026-08-13 08:00") == "updated"
    assert run(100, "2026-08-14", "2026-08-13 20:00") == "not due"
    assert run(20, "2026-08-14", "2026-08-14 08:00") == "refused"
    assert run(99, "2026-08-14", "2026-08-14 09:00", forced=True) == "updated"
    assert run(99, "2026-08-14", "2026-08-15 09:00") == "current"
    assert adopted == [100, 99] and RF.current_book(spark, state).count() == 99
    assert [r.status for r in RF.verdicts(spark, state).collect()] == ["refused", "updated", "not due", "refused", "updated", "current"]


@pytest.mark.parametrize("step", ["the book", "what it makes", "the commit", "after the commit"])
def test_an_adoption_that_crashes_repeats_cleanly(spark, tmp_path, monkeypatch, step):
    """Whatever was written without a commit is not seen, and the same batch again gives the result of one run."""
    state = str(tmp_path / "state")
    made = lambda df, path: df.limit(7).write.mode("overwrite").parquet(path)
    consider = lambda n, day, number, on_adopt=made: RF.consider_book(book_of(spark, n, day), state, number, day + " 08:00", min_cards=10, on_adopt=on_adopt)
    consider(50, "2026-08-13", "000")

    def fail(*_):
        raise RuntimeError("killed")

    if step == "after the commit":
        first = consider(60, "2026-08-14", "001")
    else:
        with monkeypatch.context() as patch, pytest.raises(Exception, match="killed"):
            if step == "the commit":
                patch.setattr(RF.Commits, "write", fail)
            if step == "the book":
                patch.setattr("pyspark.sql.DataFrameWriter.parquet", fail)
            consider(60, "2026-08-14", "001", fail if step == "what it makes" else made)
        assert RF.current_book(spark, state).count() == 50 and RF.verdicts(spark, state).count() == 1
        first = None
    again = consider(60, "2026-08-14", "001")
    assert again["status"] == "updated" and first in (None, again)
    assert RF.current_book(spark, state).count() == 60 and RF.verdicts(spark, state).count() == 2
    assert spark.read.parquet(f"{state}/made/001").count() == 7


def test_set_candidates_by_name_and_code(spark):
    sets = spark.createDataFrame([("sm1", "Sun & Moon", "SUM"), ("zz9", "Nothing Like It", None)], "set_id string, name string, code string")
    groups = spark.createDataFrame(
        [(1, "SM Base Set", "SM01"), (2, "Sun and Moon", None), (3, "Other", "SUM"), (4, "XY", "XY")], "group_id bigint, name string, abbreviation string")
    got = {(r.set_id, r.group_id) for r in C.set_candidates(sets, groups, k=1).collect()}
    assert {("sm1", 1), ("sm1", 2), ("sm1", 3)} <= got and len([g for g in got if g[0] == "zz9"]) == 1
    from difflib import SequenceMatcher
    sims = {r.group_id: r.name_sim for r in C.set_candidates(sets, groups).filter("set_id = 'sm1'").collect()}
    assert sims[2] == pytest.approx(SequenceMatcher(None, "sun moon", "sun and moon").ratio())


def test_match_needs_overlap(spark):
    left = spark.createDataFrame([("a", str(i)) for i in range(4)] + [("b", "x")], "set_id string, member string")
    right = spark.createDataFrame([(1, "0"), (1, "1"), (2, "0"), (2, "1"), (2, "2"), (3, "9")], "group_id bigint, member string")
    pairs = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.1), ("a", 3, 1.0), ("b", 3, 0.4)], "set_id string, group_id bigint, name_sim double")
    got = {r.set_id: (r.group_id, r.overlap, r.accepted) for r in C.verified_match(left, right, pairs).collect()}
    assert got == {"a": (1, 0.5, True), "b": (3, 0.0, False)}


def test_lines_of_rows_with_equal_keys_do_not_mix(spark):
    rows = [(1, "a\nb\nx@example.org"), (1, "y@example.org"), (1, "\nz@example.org w@example.org\nv@example.org"), (None, "u@example.org"), (2, None), (3, "")]
    found = A.audit_text(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((str(r.doc_id), r.hit[0], r.line) for r in found) == [("1", "v", 3), ("1", "w", 2), ("1", "x", 3), ("1", "y", 1), ("1", "z", 2), ("None", "u", 1)]


def test_feed_files_follow_the_groups(spark, sf_dir, tmp_path, monkeypatch):
    from vitrine.bindings import files as BF

    monkeypatch.setattr(BF, "shared_path", lambda spark, name: str(tmp_path / name))
    n = BF.QUERIES["s2_read_product_feed"](spark, sf_dir).filter("kind = 'product'").count()
    groups = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    written = [x for x in (tmp_path / "feed").rglob("part-*") if not x.name.endswith(".crc")]
    assert n and len(written) <= groups + n // 500


def test_batches_of_images_are_bounded(spark):
    """A batch that goes to Python holds a few megabytes of images, however many rows there are."""
    image = F.expr(f"cast(repeat('x', {I.CANON_W * I.CANON_H * 3}) AS binary)")
    images = spark.range(120, numPartitions=1).select(
        F.col("id").alias("image_id"), F.lit(I.CANON_W).alias("width"), F.lit(I.CANON_H).alias("height"), F.lit(3).alias("nChannels"), image.alias("data"))
    assert I.image_sharpness(images).count() == 120

    def sizes(batches):
        for batch in batches:
            yield batch.iloc[:1].assign(id=len(batch))[["id"]]

    most = images.withColumnRenamed("image_id", "id").select("id", "data").mapInPandas(sizes, "id bigint").agg(F.max("id")).first()[0]
    assert most <= 80


def test_a_refreshed_book_is_computed_once(spark):
    """The verdict, the publication and the caller read the stored book, not the feed."""
    from vitrine.plans import pipelines as PL

    feed = spark.createDataFrame([(1, "Normal", 2.0, 1.0, 3.0, 5)], "product_id bigint, variant string, market double, low double, high double, feed_pos bigint")
    cards = spark.createDataFrame([(10, 1), (11, 1)], "card_id bigint, product_id bigint")
    fresh, verdict = PL.refresh_prices(feed, cards, cards, "2024-02-01", min_cards=1)
    assert fresh.inputFiles() and sorted(r.card_id for r in fresh.collect()) == [10, 11]
    assert verdict.first()["accepted"]


def test_books_meet_stored_piles_where_they_lie(spark, sf_dir, monkeypatch):
    """Every book is shuffled to the piles; the piles are narrow and stay where they are."""
    from vitrine.bindings import streams as BS

    seen, reprice = [], BS.L.reprice_piles

    def watch(piles, book):
        met = piles.hint("merge").join(book, ["card_id", "variant"], "left")
        seen.append((len(piles.columns), met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return reprice(piles, book)

    monkeypatch.setattr(BS.L, "reprice_piles", watch)
    BS.QUERIES["g9_price_refresh_stream"](spark, sf_dir)
    assert seen and set(seen) == {(3, 1)}


def test_the_current_books_count_is_kept(spark, tmp_path):
    state = str(tmp_path / "state")
    counts = [
        RF.consider_book(book_of(spark, n, day), state, number, day + " 08:00", min_cards=10)["cards"]
        for number, n, day in [("0", 5, "2026-08-12"), ("1", 100, "2026-08-13"), ("2", 20, "2026-08-14"), ("3", 95, "2026-08-15")]]
    assert counts == [None, 100, 100, 95]


def test_parts_arrive_whole_and_in_several_files(spark, tmp_path):
    from vitrine.streaming import sessions as SE

    rows = spark.range(0, 800, numPartitions=4).select("id", F.floor(F.col("id") % 8).alias("day"))
    seen, files = [], []
    look = lambda batch, _: seen.append((sorted(r.day for r in batch.select("day").distinct().collect()), batch.count()))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # small files count as large ones
    try:
        for stream in SE.arrivals(rows, str(tmp_path / "in"), "day"):
            files.append(len(list((tmp_path / "in").glob("part-*"))))
            stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert [d for days, _ in seen for d in days] == list(range(8)) and all(n == 100 * len(days) for days, n in seen)
    assert len(files) == 4 and files[0] > 1 and all(b - a > 1 for a, b in zip(files, files[1:]))


def test_every_image_file_is_decoded_once(spark, sf_dir):
    """Decoded, unreadable and missing ones come from one scan of the images; names alone tell what is missing."""
    from vitrine.bindings import files as BF

    out = BF.QUERIES["s19_read_images"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan image") == 1 and "binaryFile [path" in plan.replace("FileScan ", "")
    assert {r.state for r in out.select("state").distinct().collect()} == {"decoded", "missing"} | (
        {"unreadable"} if out.filter("state = 'unreadable'").count() else set())


def test_prices_go_to_products_of_the_catalogue_only(spark, monkeypatch):
    """Of the listings of a part only those that the catalogue names get its prices; groups of no set are not reduced."""
    from vitrine.plans import pipelines as PL

    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    stored, settle = [], PL.settle
    monkeypatch.setattr(PL, "settle", lambda df: stored.append(settle(df)) or stored[-1])
    out = PL.build_catalogue(
        frame([("s1", "Base Set", "BS")], "set_id string, name string, code string"),
        frame([("c1", "s1", "1/2"), ("c2", "s1", "2/2"), ("c3", "s1", "9/2")], "card_id string, set_id string, number string"),
        frame([(1, "Base Set", "BS"), (2, "Other", "OT")], "group_id bigint, name string, abbreviation string"),
        frame([(1, 11, "a", "1/2", "R", "u"), (1, 12, "b", "2/2", "R", "u"), (1, 13, "bb", "2/2", "R", "u"), (2, 14, "c", "7/2", "R", "u")],
              "group_id bigint, product_id bigint, name string, number string, rarity string, url string"),
        frame([(5, v, m, 1.0, 2.0, i) for i, (v, m) in enumerate([("Normal", 3.0), ("Holofoil", 4.0), ("Normal", 5.0)])],
              "product_id bigint, variant string, market double, low double, high double, feed_pos bigint"),
        frame([(99, "x", "X", "2021/10/08")], "group_id bigint, set_id string, set_name string, released string"),
        sold_as=frame([(p, 5) for p in (11, 12, 13, 14)], "product_id bigint, feed_product bigint"))
    got = {r.card_id: (r.product_id, r.prices and {v: p.market for v, p in r.prices.items()}) for r in out["catalogue"].collect()}
    both = {"Normal": 5.0, "Holofoil": 4.0}
    assert got == {"c1": (11, both), "c2": (12, both), "c3": (None, None)}
    totals = out["coverage"].filter("section = 'totals'").first()
    assert (totals.cards, totals.matched, totals.priced) == (3, 2, 2)
    assert sorted(r.product_id for r in stored[-1].select("product_id").distinct().collect()) == [11, 12]


def test_group_files_are_compressed_wherever_they_are_made(spark, sf_dir, tmp_path, monkeypatch):
    from vitrine.bindings import files as BF

    monkeypatch.setattr(BF, "shared_path", lambda spark, name: str(tmp_path / name))
    rows = BF.QUERIES["s2_read_product_feed"](spark, sf_dir)
    written = [x for x in (tmp_path / "feed").rglob("part-*") if not x.name.endswith(".crc")]
    assert written and all(x.name.endswith(".gz") for x in written)
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct()
    fine = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal >= 0")
    assert rows.filter("kind = 'product'").count() == pairs.join(fine, pairs.l_suppkey == fine.s_suppkey).count()


def test_a_published_book_is_compressed_and_reads_back(spark, tmp_path):
    from vitrine.sources import prices as SP

    book = spark.createDataFrame([(i, v, 1.5 * i, None, 2.0 * i) for i in range(200) for v in ("Normal", "Holofoil")], "card_id bigint, variant string, market double, low double, high double")
    SP.write_price_book(book, str(tmp_path / "a"), "2024-02-01")
    SP.write_price_book(book, str(tmp_path / "b"), "2024-02-01", compression="none")
    size = lambda x: sum(f.stat().st_size for f in (tmp_path / x / "book").rglob("part-*"))
    assert size("a") * 4 < size("b")
    read = [SP.read_price_book(spark, str(tmp_path / x / "book")) for x in ("a", "b")]
    assert sorted(map(tuple, read[0].collect()), key=str) == sorted(map(tuple, read[1].collect()), key=str) and read[0].count() == 400
