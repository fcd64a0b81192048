"""Small tables with the awkward cases: NULLs, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, size string, words string, component int, mark int, x double, probability string"
WORDS = "the river runs under an old stone bridge where small boats wait for rain and wind to carry them down to sea".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "", "s", "ed"])) for _ in range(n))


def documents() -> list[tuple[int | None, str | None]]:
    shared = prose(1, 60)
    rows: list[tuple[int | None, str | None]] = [(i, prose(100 + i, 40 + i)) for i in range(30)]
    rows += [(40 + i, f"{prose(200 + i, 20)}\n{shared}\nAll rights reserved.\n{prose(300 + i, 15)}") for i in range(6)]
    rows += [(60 + i, prose(7, 120)) for i in range(5)]  # exact copies
    rows += [(70 + i, prose(7, 120) + f" end{i}") for i in range(4)]  # near copies
    rows += [(90, None), (91, ""), (92, "   \n \t "), (93, "one"), (94, "One Two"), (95, "Ünïcode ÇA Straße Ñ ñ 漢字 🎉 é"), (96, "x" * 30_000), (97, prose(9, 6000))]
    rows += [(None, prose(11, 50)), (None, prose(11, 50)), (None, None), (98, "same id"), (98, "another text"), (99, prose(12, 30)), (99, prose(12, 30))]
    return rows


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    full = [(i, t, "en", f"s{n % 4}" if n % 7 else None, None, 5, "a", "b", 1, 2, 0.5, "p") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)
