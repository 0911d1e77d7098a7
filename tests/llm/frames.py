"""Small tables that hold what corpora hold: NULLs, blanks, copies, long texts, further columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, part int, key double, length string"


def documents(spark, rows):
    """Documents from (doc_id, text[, lang]), with further columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), "x", 1, 0.5, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, vocabulary=400):
    """n drawn words, the same for a seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("w" + "abcdefghij"[x // 7 % 10] + "klmnopqrst"[x // 91 % 10] + str(x // 1001 % vocabulary % 7).translate(str.maketrans("0123456", "uvxyzeo")))
    return " ".join(out)


ODD = [(None, None, None), (None, "text without an id"), (901, ""), (902, " \t\n"), (903, "?! ..."), (904, "one"), (905, "one two"), (906, "ÄÖ İ 東京 \x1c\x85 x")]
