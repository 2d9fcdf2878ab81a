"""CSV sources: price files, position files, and tickers from file names.

Price files have the columns ``Ticker, Date, Open, High, Low, Close, Volume,
OpenInt`` (only Ticker, Date and Close are used); position files ``portfolioId,
ticker, quantity, assetClass`` with optional ``delta``, ``gamma`` and
``maturityInYears``. Columns are found by name, in each file by its own header:
one scan of the first lines groups the files by header, every group is read with
its own schema, and the groups are united by name. So files of one folder may
order their columns differently or have columns of their own. A file that lacks a
needed column, or names one twice, is an error that names the file. A UTF-8
byte-order mark is ignored; names match whatever their case.

Everything is read as text and cast with ``try_cast``, so a bad number becomes
NULL (and the row a reject) rather than failing the job.
"""

from __future__ import annotations

import csv
import functools
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..plans.joins import may_broadcast
from .tables import clean_prices, label_prices, price_rejects, split_labelled

# The header names are the file format.
PRICE_HEADER = ["Ticker", "Date", "Open", "High", "Low", "Close", "Volume", "OpenInt"]
POSITION_HEADER = ["portfolioId", "ticker", "quantity", "assetClass"]
POSITION_OPTIONAL = ["delta", "gamma", "maturityInYears"]


def ticker_from_path(path) -> Column:
    """Ticker from a file path or URL: the last path segment without query,
    fragment or final extension, URL-decoded and upper-cased
    (``.../brk.b.csv`` -> ``BRK.B``, ``.../my%20co.csv`` -> ``MY CO``)."""
    p = F.col(path) if isinstance(path, str) else path
    last = F.regexp_extract(p, r"([^/?#]*)(?:[?#].*)?$", 1)
    stem = F.regexp_replace(last, r"\.[A-Za-z0-9]+$", "")
    return F.upper(F.try_url_decode(stem))


def _price_path(path: str) -> str:
    return path if path.lower().endswith(".csv") else path.rstrip("/") + "/*.csv"


def file_headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Header line -> the files that start with it.

    A file's first line is the first row of its block at offset 0; the lines are
    reduced per file in the tasks, and one (header, file) pair a file, what a
    file listing holds, reaches the driver. Empty files have no header and no rows.
    """
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row"))
             .where("start = 0"))
    first = lines.groupBy("file").agg(F.min_by("value", "row").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():
        out.setdefault(r.header.removeprefix("\ufeff").rstrip("\r"), []).append(r.file)
    return out


def read_by_header(spark: SparkSession, path: str | list[str], needed: list[str], optional: list[str] = ()) -> DataFrame:
    """Text columns ``needed`` and ``optional`` (NULL where a file has none) plus ``source_file``."""
    known = {n.lower(): n for n in (*needed, *optional)}
    groups = [_read_group(spark, files, _columns(header, files[0], needed, known), known)
              for header, files in file_headers(spark, path).items()]
    return functools.reduce(DataFrame.unionByName, groups) if groups else _no_rows(spark, known)


def _columns(header: str, file: str, needed: list[str], known: dict[str, str]) -> list[str | None]:
    """The known name of each column of a header line (None for others)."""
    found = [known.get(n.strip().lower()) for n in next(csv.reader([header]), [])]
    for n in needed:
        if n not in found:
            raise ValueError(f"{file} lacks column {n!r}")
    if len({n for n in found if n}) < sum(n is not None for n in found):
        raise ValueError(f"{file} names a column twice")
    return found


def _read_group(spark: SparkSession, files: list[str], names: list[str | None], known: dict[str, str]) -> DataFrame:
    """Files of one header. The schema is their own header, so the header rows are only skipped."""
    schema = T.StructType([T.StructField(n or f"_other_{k}", T.StringType()) for k, n in enumerate(names)])
    rows = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(files)
    return rows.select(*[(F.col(n) if n in names else F.lit(None).cast("string")).alias(n) for n in known.values()],
                       F.col("_metadata.file_path").alias("source_file"))


def _no_rows(spark: SparkSession, known: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in (*known.values(), "source_file")]))


def _location(path: str) -> str:
    """A path without scheme, host and percent escapes, to compare a file's name with a requested path."""
    return unquote(urlsplit(path).path if "://" in path or path.startswith("file:") else path).rstrip("/")


def read_sources(spark: SparkSession, paths: dict[str, str], needed: list[str], optional: list[str] = (),
                 folders: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The files of many paths in one table, with the key of their path as ``source_set``.

    ``paths`` maps a key to a file (or, with ``folders``, a folder of CSV files).
    Returns the rows and, for keys whose files cannot be read, what is wrong; those
    have no rows. One scan of first lines serves all paths; the rows are one scan
    per distinct header.
    """
    wrong, wanted = {}, {}
    for key, path in paths.items():
        pattern = _price_path(path) if folders else path
        if _any_file(spark, pattern):
            wanted.setdefault(_location(path), []).append((key, pattern))
        else:
            wrong[key] = f"no file at {path}"
    groups, sets = [], {}
    known = {n.lower(): n for n in (*needed, *optional)}
    for header, files in (file_headers(spark, sorted({p for ks in wanted.values() for _, p in ks})) if wanted else {}).items():
        names = None if _why(header, files[0], needed, known) else _columns(header, files[0], needed, known)
        for f in files:
            place = _location(f)
            for key, _ in wanted.get(place, []) + wanted.get(place.rsplit("/", 1)[0], []):
                if names is None:
                    wrong.setdefault(key, str(_why(header, f, needed, known)))
                else:
                    sets.setdefault(f, []).append(key)
        if names is not None:
            groups.append(_read_group(spark, files, names, known))
    pairs = [(f, k) for f, keys in sets.items() for k in keys if k not in wrong]
    of_file = spark.createDataFrame(pairs, "source_file string, source_set string")
    if not groups:
        return _no_rows(spark, known).withColumn("source_set", F.lit(None).cast("string")), wrong
    rows = functools.reduce(DataFrame.unionByName, groups)
    # One row per file: a file listing.
    return rows.join(F.broadcast(of_file) if may_broadcast(of_file, len(pairs)) else of_file, "source_file"), wrong


def _any_file(spark: SparkSession, pattern: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def _why(header: str, file: str, needed: list[str], known: dict[str, str]) -> ValueError | None:
    try:
        _columns(header, file, needed, known)
    except ValueError as e:
        return e
    return None


def _raw_prices(spark: SparkSession, path: str, ticker_from: str) -> DataFrame:
    by_file = ticker_from == "file"
    raw = read_by_header(spark, _price_path(path), ["Date", "Close"] + ["Ticker"] * (not by_file))
    return raw.withColumn("Ticker", ticker_from_path("source_file")) if by_file else raw


def read_price_csv(spark: SparkSession, path: str, as_of=None, ticker_from: str = "column") -> DataFrame:
    """prices(ticker, date, close) from a price file or a directory of them.

    One scan serves both calibration and spot. ``ticker_from="file"`` takes the
    ticker from the file name instead of the Ticker column.
    """
    return clean_prices(_raw_prices(spark, path, ticker_from), as_of=as_of, ticker="Ticker", date="Date", close="Close")


@dataclass(frozen=True)
class PriceScan:
    """Usable prices and reject rows of one scan (both read from its written copy)."""
    prices: DataFrame
    rejects: DataFrame


def scan_price_csv(spark: SparkSession, path: str, as_of=None, ticker_from: str = "column") -> PriceScan:
    """``read_price_csv`` and its rejects (schemas.PRICE_REJECTS) from one scan of the files: each row is
    labelled with its fault and written, usable rows and rejects apart."""
    raw = _raw_prices(spark, path, ticker_from)
    usable, faulty = split_labelled(label_prices(raw, "Ticker", "Date", "Close", source="source_file"))
    return PriceScan(clean_prices(usable, as_of=as_of), price_rejects(usable, faulty))


def read_position_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """positions (schemas.POSITIONS) from position files; tickers upper-cased,
    missing delta / gamma / maturity default to plain equity spot. Rows without a
    usable quantity or with an unknown asset class are in ``position_rejects``."""
    return _positions(read_by_header(spark, path, POSITION_HEADER, POSITION_OPTIONAL)).filter(F.col("reason").isNull()).drop("reason", "quantity_raw")


def position_rejects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, portfolio_id, ticker, quantity_raw, asset_class, reason) of the rows
    that ``read_position_csv`` leaves out."""
    return _positions(read_by_header(spark, path, POSITION_HEADER, POSITION_OPTIONAL)).filter(F.col("reason").isNotNull()).select(
        "source_file", "portfolio_id", "ticker", "quantity_raw", "asset_class", "reason")


def scan_positions(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Positions of many files with the key of their path as ``source_set``, and what is wrong with unreadable ones."""
    rows, wrong = read_sources(spark, paths, POSITION_HEADER, POSITION_OPTIONAL)
    return _positions(rows, "source_set").filter(F.col("reason").isNull()).drop("reason", "quantity_raw", "source_file"), wrong


def scan_prices(spark: SparkSession, paths: dict[str, str]) -> tuple[PriceScan, dict[str, str]]:
    """Prices and price rejects of many files or folders, keyed like ``scan_positions``; one scan for both.

    Tickers carry their source set in front (``schemas.scoped``), so that equal tickers
    of different sources stay apart.
    """
    rows, wrong = read_sources(spark, paths, ["Ticker", "Date", "Close"], folders=True)
    scoped = rows.withColumn("Ticker", schemas.scoped("source_set", F.upper(F.trim("Ticker"))))
    usable, faulty = split_labelled(label_prices(scoped, "Ticker", "Date", "Close", source="source_file"))
    rejects = price_rejects(usable, faulty).withColumn("ticker", schemas.unscoped("ticker"))
    return PriceScan(clean_prices(usable), rejects), wrong


def _positions(raw: DataFrame, *keep: str) -> DataFrame:
    def num(name, default):
        return F.coalesce(F.col(name).try_cast("double"), F.lit(default)).alias(name)

    return raw.select(
        F.trim("portfolioId").alias("portfolio_id"),
        F.upper(F.trim("ticker")).alias("ticker"),
        F.col("quantity").try_cast("double").alias("quantity"),
        F.coalesce(F.upper(F.trim("assetClass")), F.lit(schemas.DEFAULT_ASSET_CLASS)).alias("asset_class"),
        num("delta", schemas.DEFAULT_DELTA).alias("delta"),
        num("gamma", schemas.DEFAULT_GAMMA).alias("gamma"),
        num("maturityInYears", schemas.DEFAULT_MATURITY).alias("maturity_in_years"),
        "source_file", F.col("quantity").alias("quantity_raw"), *keep,
    ).withColumn("reason", F.when(F.col("quantity").isNull(), "quantity is not a number")
                 .when(~F.col("asset_class").isin(*schemas.ASSET_CLASSES), "unknown asset class"))
