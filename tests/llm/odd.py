"""Small tables with everything an operator has to stand."""

import random

LONG = " ".join(f"w{i % 7919}" for i in range(30_000))
DOCS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, extra=()):
    """Documents with null, empty, blank and long texts, copies, repeated rows, null ids, and clashing extra columns."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("er", "th", "on", "qué", "zu") for b in ("a", "tion", "ß", "x1", ".")]
    body = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(25)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, t) for i, t in enumerate(body)]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, LONG), (34, body[3]), (35, body[3]), (35, body[3]), (None, body[4]), (None, None)]
    rows += [(36, f"{body[5]} {shared}"), (37, f"{shared}\n{body[6]}"), (38, shared + " tail"), (39, "A\u00a0b <|endoftext|> c\\d <|im_end|>")]
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, "s", len(t or "")) for i, t in rows], DOCS_SCHEMA)
    for name in ("id", "fp", "word", "key", "rank", "part", "block", "text_lower", "component_id", "length", *extra):
        docs = docs.selectExpr("*", f"'clash' AS `{name}`")
    return docs


def nothing(spark, schema=DOCS_SCHEMA):
    return spark.createDataFrame([], schema)


def pairs(df, id_column="doc_id", text_column="text"):
    return [(r[0], r[1]) for r in df.select(id_column, text_column).collect()]
