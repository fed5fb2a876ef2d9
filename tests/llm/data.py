"""Small frames with everything that may go wrong in a table of documents."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Names that the operators use inside.
CLASHING = ("_range", "_extra", "group", "id", "component", "n", "weight", "place", "first", "anchor", "digest", "p", "u")

WORDS = [a + b for a in ("ba", "cor", "di", "fen", "gu", "hal") for b in ("ta", "mo", "lin", "sa", "ré", "vo", "ne")]


def prose(seed: int, words: int) -> str:
    made = random.Random(seed)
    return " ".join(made.choice(WORDS) for _ in range(words))


def edge_texts() -> list[str | None]:
    base = prose(1, 60)
    long = prose(2, 30_000)
    return [
        None,
        "",
        " \t\n ",
        "one",
        "ONE",
        "two words",
        base,
        base.upper(),
        base.replace("ba", "BA") + " tail",
        base + "\n" + base,
        "x" * 300,
        "x" * 150 + base,
        long,
        long[:1000] + " cut " + long[1100:],
        "ünïcødé 漢字 \U0001f600 " + base[:200],
        "mail a.b7@mail.example.com, card 4952935900253052 on 2024-02-29 or +1 (017) 555-7713",
        "again 4952935900253052; 10.0.0.1 and 31/12/1999",
    ]


def documents(spark: SparkSession, texts: list[str | None], repeat: bool = False) -> DataFrame:
    rows = [(i, t, "en", "s", len(t or ""), *range(len(CLASHING))) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[-1], rows[1]]
    columns = ", ".join(f"{name} int" for name in CLASHING)
    schema = f"doc_id long, text string, lang string, source string, n_chars int, {columns}"
    return spark.createDataFrame(rows, schema).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return documents(spark, []).limit(0)
