"""Small documents with the awkward cases: nulls, empties, repeats, ties, long texts, clashing columns."""

import random


def documents(n: int = 40, seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    words = ["the", "of", "Net", "stop", "línea", "straße", "日本", "x1", "a", "bus", "Zug", "über", "o'clock", "tram,", "42"]
    out = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6)))
        out.append((i, text, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", None]), len(text)))
    base = out[0][1]
    out += [
        (1000, None, "en", "src0", None), (1001, "", "en", "src0", 0), (1002, "   \n\t ", None, None, 6),
        (1003, base, "en", "src0", len(base)), (1004, base, "en", "src1", len(base)), (1004, base, "en", "src1", len(base)),
        (1005, base + " tail", "en", "src1", 0), (None, base, "en", "src1", 0), (None, None, None, None, None),
        (1006, "word " * 5000, "en", "src0", 25000), (1007, "x" * 20000, "en", "src0", 20000),
        (1008, "\r\nLine one \n line ONE\n\nend\n", "en", "src0", 0), (1009, " nb sp \x1c ctl \x00 nul", "en", "src0", 0),
        (-5, "negative id " + base, "en", "src0", 0),
    ]
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows=None, **more):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    return df


def saved(spark, tmp_path, rows=None, **tables) -> str:
    """A folder with documents.parquet and other tables, to run a registered query on."""
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for k, v in tables.items():
        v.write.parquet(f"{tmp_path}/{k}.parquet")
    return str(tmp_path)
