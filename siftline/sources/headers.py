"""Header cards of image files as a Spark data source that reads headers and never images.

    header_cards(spark, folder).filter("key = 'DATE-OBS'")

A header is 80-byte cards in blocks of 2,880 bytes; blocks are read until the one
with END. A condition on key is pushed into the reader, which then keeps those cards
alone. Folders and stores that pyarrow opens can be read; where only Spark's own
readers reach a store, fits_cards() of web.py takes whole files instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

BLOCK, CARD = 2880, 80
#: Files of a partition.
FILES = 64
#: Blocks after which a file without END is taken for no header.
MOST = 1000


def parse_card(card: bytes) -> tuple[str, str] | None:
    """The key and value of a card, None for one without a value; quotes and comments go."""
    text = card.decode("ascii", "ignore")
    key, rest = text[:8].strip(), text[10:]
    if not key or text[8:10] != "= ":
        return None
    if rest.lstrip().startswith("'"):
        return key, rest.split("'", 2)[1].strip() if rest.count("'") > 1 else rest.strip().strip("'").strip()
    return key, rest.split("/", 1)[0].strip()


def read_header(stream) -> tuple[list[tuple[str, str]], int, bool]:
    """(cards, bytes read, whether END was found) of a stream from its beginning."""
    cards, n = [], 0
    for _ in range(MOST):
        block = stream.read(BLOCK)
        n += len(block)
        for lo in range(0, len(block) - CARD + 1, CARD):
            if block[lo : lo + 8].strip() == b"END":
                return cards, n, True
            found = parse_card(block[lo : lo + CARD])
            if found:
                cards.append(found)
        if len(block) < BLOCK:
            break
    return cards, n, False


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.keys = options["path"], None
        self.suffixes = tuple(options.get("suffixes", ".fits,.fit,.fts").lower().split(","))

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = own if self.keys is None else self.keys & own
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._system()
        found = sorted(i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.lower().endswith(self.suffixes))
        return [_Files(found[lo : lo + FILES]) for lo in range(0, len(found), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                cards, n, whole = read_header(stream)
            for at, (key, value) in enumerate(cards):
                if self.keys is None or key in self.keys:
                    yield path, at, key, value, n, whole


class HeaderSource(DataSource):
    """(path, at, key, value, header_bytes, whole) of every card with a value; whole says whether the header had its END. Options: path, suffixes."""

    @classmethod
    def name(cls) -> str:
        return "header_cards"

    def schema(self) -> str:
        return "path string, at int, key string, value string, header_bytes long, whole boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def header_cards(spark: SparkSession, path: str, suffixes: str = ".fits,.fit,.fts") -> DataFrame:
    """The cards of all header files under path; conditions on key reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(HeaderSource)
    return spark.read.format("header_cards").option("suffixes", suffixes).load(path)


def header_date(text: Column) -> Column:
    """A date as ISO, else in the first of five forms that fits; years of two digits are of the twentieth century."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "^'+|'+$", ""))
    ten = F.substring(s, 1, 10)
    short = ten.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$")
    two = lambda d, m: F.try_to_date(F.concat(F.lit("19"), F.lpad(F.split_part(ten, F.lit("/"), F.lit(3)), 2, "0"), F.lit("-"), F.split_part(ten, F.lit("/"), F.lit(m)), F.lit("-"), F.split_part(ten, F.lit("/"), F.lit(d))), "yyyy-M-d")
    iso = F.when(ten.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(ten, "yyyy-MM-dd"))
    return F.coalesce(iso, F.when(short, F.coalesce(two(1, 2), two(2, 1))), F.try_to_date(ten, "d/M/yyyy"), F.try_to_date(ten, "M/d/yyyy"), F.try_to_date(ten, "d-M-yyyy"))


def header_table(cards: DataFrame) -> DataFrame:
    """(path, plate_id, date_obs, exposure, region, telescope, emulsion, filter, problem): a row for each file of cards (path, key, value).

    plate_id is the file's name without what stands before its last underscore and
    the suffix. problem says why a row isn't fit for use (no date, no positive
    exposure, a region that names another plate), and is null where it is; it
    never keeps a row away. Of repeated keys the last one counts where cards have a
    place (at), else the greatest.
    """
    order = F.col("at") if "at" in cards.columns else F.col("value")
    value = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, order))
    wide = cards.groupBy("path").agg(*[value(k).alias(name) for name, k in (("date", "DATE-OBS"), ("exp", "EXPOSURE"), ("region", "REGION"), ("telescope", "TELESCOP"), ("emulsion", "EMULSION"), ("filter", "FILTER"))])
    name = F.regexp_extract("path", r"(?:.*[/_])?([^/_]+?)\.[^./]+$", 1)
    exposure = F.regexp_replace(F.trim("exp"), "[Dd]", "E").try_cast("double")
    rows = wide.select("path", name.alias("plate_id"), header_date(F.col("date")).alias("date_obs"), exposure.alias("exposure"), F.coalesce(F.nullif("region", F.lit("")), name).alias("region"), "telescope", "emulsion", "filter")
    good = (F.col("exposure") > 0) & (F.col("exposure") < F.lit(float("inf"))) & ~F.isnan("exposure")
    problem = F.when(F.col("region") != F.col("plate_id"), "REGION_MISMATCH").when(~F.coalesce(good, F.lit(False)), "NO_EXPOSURE").when(F.col("date_obs").isNull(), "NO_DATE")
    return rows.withColumn("problem", problem)
