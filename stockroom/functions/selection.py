"""Exact selection of rows at given ranks by histogram refinement, without sorting.

The order is (value, id).  Each round counts the rows that can still hold a rank in
``BINS`` equal bins between the smallest and the largest of them, keeps the bin the rank
falls into with its own extremes, and goes on from there; once all its rows have one
value it goes on by id.  A round is a scan of the narrow table and a partial aggregate of a few
thousand rows at most, for all ranks together; no row is shuffled.  When ``ROWS_LEFT``
rows or fewer can hold a rank they are read and the rank is picked among them.

Skewed values only cost further rounds: a bin's extremes are exact, so every round
parts the smallest from the largest.  Strings are refined six bytes at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, NumericType, StringType

BINS = 1024
ROWS_LEFT = 4000
CHUNK = 6  # bytes of a string in one number


@dataclass
class _Search:
    """One rank (from 1 among the ``left`` rows that can still hold it) and the numbers known of its row."""

    name: str
    rank: int
    left: int
    low: object = None
    high: object = None
    known: list = field(default_factory=list)

    def at(self, level) -> Column:
        return level(self.name, len(self.known))

    def active(self, level) -> Column:
        column = F.lit(True)
        for n, number in enumerate(self.known):
            column = column & (level(self.name, n) == F.lit(number))
        return column if self.low is None else column & self.at(level).between(F.lit(self.low), F.lit(self.high))


def select_ranks(df: DataFrame, values: dict[str, Column], id_col: str, ranks: dict[str, list[int]], total: int | None = None) -> dict[tuple[str, int], tuple]:
    """{(name, rank): (value, id)} of the rows at these ranks (from 1) in the order (values[name], id).

    ``df`` is read once a round.  Ids are unique, values are numbers, neither is null; a repeated
    id is an error where it matters.  Ranks outside the table are left out.  ``total`` is its row
    count where the caller knows it.
    """

    kind = df.schema[id_col].dataType
    if not isinstance(kind, NumericType | StringType):
        raise TypeError(f"{id_col} is {kind.simpleString()}; ranks need a number or a string")

    simple = {name: df.select(value).schema[0].dataType for name, value in values.items()}
    scale = max((t.scale for t in simple.values() if isinstance(t, DecimalType)), default=0)

    def number(column: Column) -> Column:
        """Doubles as they are, all others as decimals of one type, whose differences are exact."""

        floating = isinstance(df.select(column).schema[0].dataType, FloatType | DoubleType)
        return column.cast("double" if floating else f"decimal(38,{scale})")

    levels: dict[str, list[Column]] = {name: [number(value)] for name, value in values.items()}

    def level(name: str, n: int) -> Column:
        """The n-th number of a row in this order: the value, then the id, a string in chunks."""

        while len(levels[name]) <= n:
            if isinstance(kind, NumericType):
                levels[name].append(number(F.col(id_col)))
            else:
                octets = F.substring(F.col(id_col).cast("binary"), 1 + (len(levels[name]) - 1) * CHUNK, CHUNK)
                levels[name].append(number(F.conv(F.rpad(F.hex(octets), 2 * CHUNK, "0"), 16, 10).cast("long")))
        return levels[name][n]

    total = df.count() if total is None else total
    searches = {(name, rank): _Search(name, rank, total) for name, some in ranks.items() for rank in some if 1 <= rank <= total}
    if not searches:
        return {}
    _find_ends(df, list(searches.values()), level)
    while open_ := [s for s in searches.values() if s.left > ROWS_LEFT]:
        if tied := [s for s in open_ if s.low == s.high]:  # one number left: on to the next
            for s in tied:
                if s.known and (isinstance(kind, NumericType) or s.low == 0):  # nothing comes after the id
                    raise ValueError(f"{id_col} repeats")
                s.known.append(s.low)
                s.low = s.high = None
            _find_ends(df, tied, level)
            continue
        by_type: dict[str, list[_Search]] = {}
        for s in open_:
            by_type.setdefault(df.select(s.at(level)).schema[0].dataType.simpleString(), []).append(s)
        for group in by_type.values():
            _refine(df, group, level)
    rows = _candidates(df, list(searches.values()), values, id_col, level)
    return {key: some[s.rank - 1] for (key, s), some in zip(searches.items(), rows, strict=True)}


def _find_ends(df: DataFrame, searches: list[_Search], level) -> None:
    ends = [end(F.when(s.active(level), s.at(level))).alias(f"{side}{n}") for n, s in enumerate(searches) for side, end in (("low", F.min), ("high", F.max))]
    row = df.agg(*ends).first()
    for n, s in enumerate(searches):
        s.low, s.high = row[f"low{n}"], row[f"high{n}"]


def _refine(df: DataFrame, searches: list[_Search], level) -> None:
    """Go on to the bin that holds the rank."""

    cells = []
    for n, s in enumerate(searches):
        share = (s.at(level) - F.lit(s.low)).cast("double") / (F.lit(s.high) - F.lit(s.low)).cast("double")
        place = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        cells.append(F.when(s.active(level), F.struct(F.lit(n).alias("search"), place.alias("bin"), s.at(level).alias("at"))))
    held = df.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    bins: dict[int, list] = {}
    for row in held.groupBy("search", "bin").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).collect():  # BINS rows a search at most
        bins.setdefault(row.search, []).append(row)
    for n, s in enumerate(searches):
        for row in sorted(bins[n], key=lambda row: row.bin):
            if s.rank <= row.n:
                s.left, s.low, s.high = row.n, row.low, row.high
                break
            s.rank -= row.n


def _candidates(df: DataFrame, searches: list[_Search], values: dict[str, Column], id_col: str, level) -> list[list[tuple]]:
    """Per search the rows left, in order; ``ROWS_LEFT`` at most each."""

    out: list[list[tuple]] = [[] for _ in searches]
    names = list(values)
    cells = F.array(*(F.when(s.active(level), F.lit(n)) for n, s in enumerate(searches)))
    held = df.select(F.explode(F.filter(cells, lambda n: n.isNotNull())).alias("search"), F.col(id_col).alias("id"), *(values[name].alias(f"v{n}") for n, name in enumerate(names)))
    for row in held.collect():
        out[row.search].append((row[f"v{names.index(searches[row.search].name)}"], row.id))
    return [sorted(rows, key=lambda r: (r[0], r[1].encode() if isinstance(r[1], str) else r[1])) for rows in out]
