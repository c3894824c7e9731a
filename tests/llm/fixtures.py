"""Awkward rows that every operator has to take."""

from pyspark.sql import DataFrame, SparkSession

WORDS = "amber birch cedar delta ember frost grove hazel iris jade kelp linen maple nectar olive pearl quartz raven sable thorn umber velvet willow yarrow zephyr".split()

DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(state >> 33) % len(WORDS)] + str((state >> 40) % 97))
    return " ".join(out)


BASE = prose(1, 120)
#: Ids and texts: copies, near copies, nulls, blanks, one very long text, signs of several scripts.
TEXTS = [
    (1, BASE),
    (2, BASE),
    (3, BASE.upper()),
    (4, BASE + " tail"),
    (5, "head " + BASE),
    (6, None),
    (7, ""),
    (8, " \t\n "),
    (9, "one"),
    (10, "ONE"),
    (11, "one two"),
    (12, prose(2, 120)),
    (13, "MIT License and Apache license; GNU General Public License, mit-license mit  license"),
    (14, "straße 中文字符 \U0001f600 ügly İstanbul é"),
    (15, " ".join(prose(k, 500) for k in range(20, 40))),
    (16, "same same same same same same same same"),
    (17, "12 34 -- !!"),
]


def documents(spark: SparkSession, repeated: bool = True, clash: tuple[str, ...] = ()) -> DataFrame:
    """TEXTS as a table with null languages and sources, a row twice, a row without id, and columns named ``clash``."""
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "web", None if t is None else len(t)) for i, t in TEXTS]
    if repeated:
        rows += [rows[0], (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS_SCHEMA)
    for name in clash:
        frame = frame.selectExpr("*", f"'own' AS `{name}`")
    return frame


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS_SCHEMA)
