"""Rows that every operator must bear: nulls in any column, empty and long texts, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns with names that operators use themselves
CLASH = ("id string, tie string, node string, key string, n int, size string, shard string, slot string, part string, "
         "head string, tail string, text_hash string, fingerprint string, lang_pred string, score string, n_lines string, "
         "n_dropped string, gone string, mix_tokens string, mix_domain string, _id string, _own string, _order string, "
         "_lang string, _speaks string, n_blocks string")
_EXTRA = tuple("x" if not c.split()[1].startswith("int") else 1 for c in CLASH.split(", "))

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs into the green forest again.", "en", "src1", 1),
    (2, "The quick brown fox jumps over the lazy dog and runs into the green forest again.", "en", "src1", 1),
    (3, None, "en", "src2", None), (4, "", "de", None, 0), (None, "Der Hund und die Katze sind nicht im Haus, aber in dem Garten.", "de", "src3", 5),
    (5, "   \n\t ", None, "src1", 6), (6, "12345 67 .", "fr", "src0", 7), (7, LONG, "en", "src0", len(LONG)),
    (8, "wörter über straßen 漢字 🎉 ñ", None, "x", 3), (9, "one", "es", "src4", 3), (9, "one", "es", "src4", 3),
    (10, "Der Hund und die Katze sind nicht im Haus, aber in dem Garten.", "de", "src3", 5), (None, None, None, None, None),
]


def docs(spark, rows=None, clash=True):
    rows = ROWS if rows is None else rows
    if clash:
        return spark.createDataFrame([r + _EXTRA for r in rows], SCHEMA + ", " + CLASH)
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by(rows, key):
    return sorted(rows, key=lambda r: tuple((r[k] is not None, r[k]) for k in key))
