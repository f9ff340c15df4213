"""Sources (S1-S3): CSV / parquet tables with inferred types, duplicate
header renaming (``c``, ``c.1``, ...) and errors on empty or unparsable input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.exprs import nan_to_null


def dedupe_names(names: list[str]) -> list[str]:
    """S3: repeated names become ``name.1``, ``name.2`` ... (first keeps its name)."""
    seen: dict[str, int] = {}
    out = []
    taken = set(names)
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        seen[n] += 1
        cand = f"{n}.{seen[n]}"
        while cand in taken:
            seen[n] += 1
            cand = f"{n}.{seen[n]}"
        taken.add(cand)
        out.append(cand)
    return out


def read_csv(spark: SparkSession, path: str, infer: bool = True, sep: str = ",") -> DataFrame:
    """Header + type inference; FAILFAST on malformed rows; error when empty.

    The header line is read once on the driver (one line) so duplicate names
    keep the reference's ``x, x.1`` convention instead of Spark's suffixes.
    """
    header_df = spark.read.text(path).limit(1).collect()
    if not header_df:
        raise ValueError(f"{path}: empty file")
    import csv
    names = next(csv.reader([header_df[0][0]], delimiter=sep))
    names = dedupe_names([n.strip() for n in names])
    df = (spark.read.option("header", True).option("inferSchema", infer).option("mode", "FAILFAST")
          .option("sep", sep).option("enforceSchema", False).csv(path))
    if len(df.columns) != len(names):
        raise ValueError(f"{path}: header has {len(names)} names, rows have {len(df.columns)} fields")
    return nan_to_null(df.toDF(*names))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by extension; one path per named dataset/sheet."""
    if path.endswith(".csv"):
        return read_csv(spark, path)
    return nan_to_null(spark.read.parquet(path))


def letters_to_columns(df: DataFrame, spec: str) -> list[str]:
    """Spreadsheet letters ('A-D,F') -> column names by position."""
    def idx(s: str) -> int:
        v = 0
        for ch in s.strip().upper():
            v = v * 26 + (ord(ch) - 64)
        return v - 1
    out: list[str] = []
    for part in spec.split(","):
        part = part.strip()
        if not part:
            continue
        if "-" in part:
            a, b = part.split("-", 1)
            out += df.columns[idx(a): idx(b) + 1]
        else:
            out.append(df.columns[idx(part)])
    return list(dict.fromkeys(out))


def require_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def require_rows(df: DataFrame, n: int, what: str = "rows") -> int:
    got = df.limit(n).count()
    if got < n:
        raise ValueError(f"need at least {n} {what}, found {got}")
    return got
