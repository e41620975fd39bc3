"""Writers. Tables go to Parquet; these are the forms that other tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopgrid.functions.score import quantize


def packed(df: DataFrame, scaled: dict[str, tuple[float, int]]) -> DataFrame:
    """Columns as whole numbers: name -> (scale, top)."""
    return df.select(*[quantize(F.col(c), *scaled[c]).alias(c) if c in scaled else F.col(c) for c in df.columns])


def delta_polyline(points: DataFrame, by: str = "id", pos: str = "pos") -> DataFrame:
    """(by, pos, dx, dy) in millionths of a degree, the first point absolute."""
    w = Window.partitionBy(by).orderBy(pos)
    q = points.select(by, pos, F.rint(F.col("lon") * 1e6).cast("long").alias("x"), F.rint(F.col("lat") * 1e6).cast("long").alias("y"))
    return q.select(by, pos, (F.col("x") - F.coalesce(F.lag("x").over(w), F.lit(0))).alias("dx"), (F.col("y") - F.coalesce(F.lag("y").over(w), F.lit(0))).alias("dy"))


def pack(df: DataFrame, path: str, scaled: dict[str, tuple[float, int]], key: str) -> None:
    """Numbers of ``df`` as column files in parts: a JSON header, then each column's values, fixed-point where scaled, from multiples of eight bytes; gzipped.

    Array columns are kept as the lengths of their rows and the values of all.
    A part is a partition; ``unpack`` reads them all back.
    """
    import gzip
    import json
    import struct
    import uuid

    import numpy as np
    import pyarrow.fs as pafs

    rows = packed(df, scaled).sortWithinPartitions(key)

    def write(batches):
        import pandas as pd

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        table = pd.concat(parts, ignore_index=True)
        columns, body = [], b""

        def put(name, values, role):
            nonlocal body
            kind = "<f8" if values.dtype.kind == "f" else "<i8"
            body += b"\0" * (-len(body) % 8)
            columns.append({"name": name, "role": role, "dtype": kind, "at": len(body), "n": len(values), "scale": scaled.get(name, (1.0, 0))[0] if name in scaled else None})
            body += values.astype(kind).tobytes()

        for c in table.columns:
            if len(table) and isinstance(table[c].iloc[0], (list, np.ndarray)):
                put(c, np.array([len(x) for x in table[c]]), "lengths")
                put(c, np.concatenate([np.asarray(x) for x in table[c]]), "values")
            else:
                put(c, table[c].to_numpy(), "column")
        head = json.dumps({"rows": len(table), "columns": columns}).encode()
        head += b" " * (-(len(head) + 8) % 8)
        fs, at = pafs.FileSystem.from_uri(path)
        fs.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.pack.gz"
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            out.write(gzip.compress(struct.pack("<Q", len(head)) + head + body))
        yield pd.DataFrame({"file": [name]})

    # Only the files that the manifest names count, so a task that runs again does no harm.
    rows.mapInPandas(write, "file string").write.mode("overwrite").parquet(f"{path}/manifest")


def unpack(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that ``pack`` wrote, with scaled columns as they were but for their rounding; ``schema`` names its columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches):
        import gzip
        import json

        import numpy as np
        import pandas as pd
        import pyarrow.fs as pafs

        for b in batches:
            for name in b["file"]:
                fs, at = pafs.FileSystem.from_uri(f"{path}/{name}")
                with fs.open_input_stream(at, compression=None) as f:
                    raw = gzip.decompress(f.read())
                n = int.from_bytes(raw[:8], "little")
                head, body = json.loads(raw[8 : 8 + n]), raw[8 + n :]
                got, lengths = {}, {}
                for c in head["columns"]:
                    v = np.frombuffer(body, c["dtype"], c["n"], c["at"])
                    v = v / c["scale"] if c["scale"] else v
                    if c["role"] == "lengths":
                        lengths[c["name"]] = np.frombuffer(body, c["dtype"], c["n"], c["at"])
                    elif c["role"] == "values":
                        got[c["name"]] = [x.tolist() for x in np.split(v, np.cumsum(lengths[c["name"]])[:-1].astype(int))]
                    else:
                        got[c["name"]] = v
                yield pd.DataFrame(got)[names]

    return spark.read.parquet(f"{path}/manifest").mapInPandas(rows, schema)


def export_rows(lines: DataFrame, stops: DataFrame, region: int | None = None) -> DataFrame:
    """Lines, then stops, by score: nationally only grade 3, or all of one region."""
    from stopgrid.operators.ranks import numbered_all

    keep = F.col("grade") == 3 if region is None else F.col("region") == region
    one = lambda df, part: numbered_all(df.where(keep).select("id", "name", "score", "grade"), ["score"], ["id"], "rank").withColumn("rank", F.col("rank") + 1).withColumn("part", F.lit(part))
    return one(lines, 0).unionByName(one(stops, 1)).orderBy("part", "rank")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a byte order mark before the header, all fields in quotes, and line ends of two signs."""
    first, *rest = df.columns
    df.withColumnRenamed(first, f"\ufeff{first}").select(f"\ufeff{first}", *rest).write.option("lineSep", "\r\n").csv(path, header=True, quoteAll=True, mode="overwrite")


def markdown(df: DataFrame) -> str:
    """A report's table of aggregated rows, all of them."""
    rows = df.collect()
    return "\n".join(["| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *[[str(v) for v in x] for x in rows]]])


def report_block(page: str, name: str, body: str) -> str:
    """``page`` with what stands between the markers of ``name`` replaced; a page without them is an error."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    a, b = page.find(start), page.find(end)
    if a < 0 or b < a:
        raise ValueError(f"no markers of {name}")
    return f"{page[: a + len(start)]}\n{body}\n{page[b:]}"


def write_json(df: DataFrame, path: str) -> None:
    """Compact lines of JSON in UTF-8."""
    df.write.mode("overwrite").json(path)


def in_chunks(work: DataFrame, make, path: str, key: str, chunks: int) -> DataFrame:
    """``make`` of ``work`` in chunks by a hash of the key, each written as it is done; chunks that are there already are not made again.

    A run that was broken off goes on where it was, as long as ``path`` names
    the same work: see ``fingerprint``. Returns all chunks together.
    """
    import pyarrow.fs as pafs

    spark = work.sparkSession
    fs, at = pafs.FileSystem.from_uri(path)
    for k in range(chunks):
        done = fs.get_file_info(f"{at}/chunk={k}/_SUCCESS").type != pafs.FileType.NotFound
        if not done:
            make(work.where(F.pmod(F.xxhash64(key), F.lit(chunks)) == k)).write.mode("overwrite").parquet(f"{path}/chunk={k}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/chunk={k}" for k in range(chunks)])


def fingerprint(df: DataFrame, *params) -> str:
    """A name for the content of a table, whatever the order of its rows, and for parameters."""
    import hashlib

    x = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(repr((df.dtypes, x.n, str(x.s), params)).encode()).hexdigest()[:16]
