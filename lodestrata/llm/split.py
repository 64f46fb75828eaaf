"""Splitting oversized items at natural boundaries.

Byte-range processing. An item is cut into ranges, and every range is a row of its
own, with a halo: whether a line feed stands before it, and the ``max_chars + 1``
code points after it. Giant files are read as byte ranges, each by the worker that
reads it (``file_ranges``), so no worker ever holds a whole file; items that
are cells of a table are cut where they lie, in one pass over the cell
(``item_ranges``), and move no further. A worker lists the lines that begin in
its range: place, length (if the line ends inside the halo, else unknown) and whether
the line is a natural boundary. Running sums over these tables give every range the
offset of its first code point and the number of its first line. The tables,
which hold numbers and no text, are stitched per item in range order: a line longer
than its halo gets its length from the place of the next line. A greedy pass over the
stitched table holds the lines of the open piece and emits pieces by offset.
``piece_texts`` cuts the texts out of the ranges again, by the ranges that a piece touches.

The greedy pass of one item is sequential, as every cut depends on the one before.

The rule of the pieces
    A piece is a run of whole lines joined by a line feed, at most ``max_chars``
    code points. If the rest does not fit, it ends after the last new line that
    fits and is natural (blank, or only ``} ] ) ; ,`` when trimmed), else after
    the last line that fits. The next piece repeats the last ``overlap`` lines,
    unless these and one new line do not fit together. A longer line is cut into
    pieces of ``max_chars`` and a rest, with no overlap on either side.

Defined edge cases
    null content, null limits and limits below 1 give no pieces; content that
    fits gives none (oversized items only); a null start line counts
    from 1; repeated rows count once; one item under several contents, first lines or
    limits is split for each of them; a negative overlap counts as 0. Bytes of a file that are
    no UTF-8 become U+FFFD; empty files give no pieces.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = 1 << 16
CLOSERS = "}]);,"
#: what tells one splitting from another: the item, its content, and how it is to be cut
KEY = ["item", "variant", "first_line", "max_chars", "overlap"]
_KEY = "item string, variant string, first_line int, max_chars int, overlap int"


def is_natural(line: str) -> bool:
    return not line.strip().strip(CLOSERS)


def range_boundaries(own: str, halo: str, opens: bool, last: bool) -> tuple[list[int], list[int], list[bool]]:
    """Lines that begin in the range ``own``, by place in it; ``opens`` says whether its first code point begins a line.

    A length of -1 means that the line's end lies beyond the halo.
    """
    offsets, lengths, natural = [], [], []
    text, size = own + halo, len(own)
    pos = 0 if opens else own.find("\n") + 1
    if pos == 0 and not opens:
        return offsets, lengths, natural
    while pos < size or (last and pos == size):
        end = text.find("\n", pos)
        known = end >= 0 or last
        stop = end if end >= 0 else len(text)
        offsets.append(pos)
        lengths.append(stop - pos if known else -1)
        natural.append(known and is_natural(text[pos:stop]))
        if end < 0:
            break
        pos = end + 1
    return offsets, lengths, natural


#: first and last line, first and last offset
Piece = tuple[int, int, int, int]


class Greedy:
    """Emits pieces from lines fed in order; holds only the lines of the open piece."""

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, max(0, overlap)
        self.lines: list[tuple[int, int, int, bool]] = []  # (number, offset, length, natural)
        self.fresh = 0  # index of the first line that is not repeated
        self.size = -1  # code points of the joined lines; -1 without lines

    def _close(self, end: int) -> Piece:
        first, final = self.lines[0], self.lines[end]
        return first[0], final[0], first[1], final[1] + final[2]

    def _load(self, lines: list) -> None:
        self.lines = lines
        self.size = sum(x[2] + 1 for x in lines) - 1

    def _shed(self, incoming: int) -> Iterator[Piece]:
        """Close pieces until the line of length ``incoming`` fits, or no line is open."""
        while self.lines and self.size + 1 + incoming > self.limit:
            if len(self.lines) == self.fresh:  # nothing new yet: the repeated lines give way
                self._load([])
                self.fresh = 0
                return
            ends = [i for i in range(self.fresh, len(self.lines)) if self.lines[i][3]]
            end = ends[-1] if ends else len(self.lines) - 1
            yield self._close(end)
            rest = self.lines[end + 1 :]
            repeated = self.lines[max(0, end + 1 - self.overlap) : end + 1] if self.overlap else []
            following = rest[0][2] if rest else incoming
            if repeated and sum(x[2] + 1 for x in repeated) + following > self.limit:
                repeated = []
            self.fresh = len(repeated)
            self._load(repeated + rest)
            # the rest was shorter than the piece before, so only the overlap can make it too long
            yield from self._refill()

    def _refill(self) -> Iterator[Piece]:
        """If overlap and rest exceed the limit, replay the rest line by line."""
        if self.size <= self.limit:
            return
        rest = self.lines[self.fresh :]
        self._load(self.lines[: self.fresh])
        for line in rest:
            yield from self.feed(*line)

    def feed(self, number: int, offset: int, length: int, natural: bool) -> Iterator[Piece]:
        if length > self.limit:
            yield from self._flush_before_long()
            for start in range(0, length, self.limit):
                yield number, number, offset + start, offset + min(length, start + self.limit)
            return
        yield from self._shed(length)
        self.size += length + 1
        self.lines.append((number, offset, length, natural))

    def _flush_before_long(self) -> Iterator[Piece]:
        yield from self._shed(self.limit + 1)
        self._load([])
        self.fresh = 0

    def finish(self) -> Iterator[Piece]:
        if len(self.lines) > self.fresh:
            yield self._close(len(self.lines) - 1)
        self._load([])


def _boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [range_boundaries(*x) for x in zip(pdf.own, pdf.halo, pdf.opens, pdf["last"])]
        yield pdf[[*KEY, "part", "last"]].assign(chars=[len(x) for x in pdf.own], lines=[len(f[0]) for f in found], offsets=[f[0] for f in found], lengths=[f[1] for f in found], natural=[f[2] for f in found])


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy pass over range tables that arrive sorted by key and range."""
    key, pieces, greedy, wait = None, 0, None, None
    ats: list[int] = []  # offsets of the ranges that an open piece may touch, the first of which is range ``low``
    low = 0
    out: list[tuple] = []

    ahead: list[Piece] = []  # pieces that reach over the halo into ranges that have not come yet

    def put(found: Iterator[Piece]) -> None:
        ahead.extend(found)

    def place(end: int) -> None:
        nonlocal pieces, ahead
        ready = bisect_right(ahead, end, key=lambda p: p[3])
        for a, b, x, y in ahead[:ready]:
            pieces += 1
            i, j = bisect_right(ats, x) - 1, bisect_right(ats, max(x, y - 1))
            out.append((*key, pieces, key[2] + a, key[2] + b, x, y, low + i, ats[i:j]))
        ahead = ahead[ready:]

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if (this := tuple(row[: len(KEY)])) != key:
                key, pieces, greedy, wait, ats, low = this, 0, Greedy(row.max_chars, row.overlap), None, [], row.part
            ats.append(row.chars_before)
            for i, (offset, length, nat) in enumerate(zip(row.offsets.tolist(), row.lengths.tolist(), row.natural.tolist())):
                at = row.chars_before + offset
                if wait is not None:
                    put(greedy.feed(*wait, at - 1 - wait[1], False))
                    wait = None
                if length < 0:
                    wait = row.lines_before + i, at
                else:
                    put(greedy.feed(row.lines_before + i, at, length, nat))
            if row.last:
                if wait is not None:
                    put(greedy.feed(*wait, row.chars_before + row.chars - wait[1], False))
                    wait = None
                put(greedy.finish())
                if row.chars_before + row.chars <= row.max_chars:
                    ahead = []  # a file that fits
            place(row.chars_before + row.chars)
            needed = ahead[0][2] if ahead else greedy.lines[0][1] if greedy.lines else wait[1] if wait is not None else row.chars_before
            drop = max(0, bisect_right(ats, needed) - 1)
            ats, low = ats[drop:], low + drop
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=_PIECES)
                out = []
    if out:
        yield pd.DataFrame(out, columns=_PIECES)


_PIECES = [*KEY, "piece_no", "start_line", "end_line", "start_offset", "end_offset", "part", "ats"]


def item_ranges(items: DataFrame, range_chars: int = RANGE) -> DataFrame:
    """Ranges of the oversized items of a table, cut in one pass over each cell.

    ``items`` has ``item STRING, content STRING, first_line INT, max_chars INT, overlap INT``.
    """
    n = range_chars
    big = items.where((F.col("max_chars") > 0) & (F.length("content") > F.col("max_chars"))).select(
        "item", F.sha2("content", 256).alias("variant"), F.coalesce("first_line", F.lit(1)).alias("first_line"), "max_chars", F.greatest(F.coalesce("overlap", F.lit(0)), F.lit(0)).alias("overlap"),
        F.regexp_extract_all("content", F.lit(rf"(?s).{{1,{n}}}"), F.lit(0)).alias("ranges"),
    )
    after = F.ceil((F.col("max_chars") + 1) / n).cast("int")  # ranges that the halo reaches into
    own = F.col("ranges")[F.col("part")]
    before = F.when(F.col("part") > 0, F.col("ranges")[F.col("part") - 1])
    halo = F.substring(F.array_join(F.slice("ranges", F.col("part") + 2, after), ""), F.lit(1), F.col("max_chars") + 1)
    return big.withColumn("part", F.explode(F.sequence(F.lit(0), F.size("ranges") - 1))).select(
        *KEY, "part", own.alias("own"), F.coalesce(F.endswith(before, F.lit("\n")), F.lit(True)).alias("opens"), halo.alias("halo"), (F.col("part") == F.size("ranges") - 1).alias("last")
    )


def _read_ranges(range_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                system, path = fs.FileSystem.from_uri(row.item) if ":" in row.item else (fs.LocalFileSystem(), row.item)
                lo = row.part * range_bytes
                with system.open_input_file(path) as f:
                    f.seek(max(0, lo - 1))
                    # a code point has at most 4 bytes; one more lets a code point that begins in the range end
                    data = f.read(range_bytes + 4 * (row.max_chars + 2) + 1)
                before, data = (b"\n", data) if lo == 0 else (data[:1], data[1:])
                first = next((i for i, b in enumerate(data[:4]) if b & 0xC0 != 0x80), 0) if lo else 0
                end = min(range_bytes, len(data))
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                own = data[first:end].decode("utf-8", "replace")
                halo = data[end:].decode("utf-8", "ignore")[: row.max_chars + 1]
                yield pd.DataFrame([(*row[:6], own, first == 0 and before == b"\n", halo, lo + range_bytes >= row.length)], columns=[*KEY, "part", "own", "opens", "halo", "last"])

    return run


def file_ranges(spark: SparkSession, paths: str | list[str], max_chars: int, overlap: int = 0, range_bytes: int = RANGE) -> DataFrame:
    """Byte ranges of files in a folder that all workers reach; every range is read by itself. The item is the file's path."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("item"), "length").where("length > 0")  # the content column is pruned
    rows = files.select(
        "item", F.lit("").alias("variant"), F.lit(1).alias("first_line"), F.lit(max_chars).alias("max_chars"), F.lit(max(0, overlap)).alias("overlap"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / range_bytes).cast("int"))).alias("part"), "length",
    )
    # one file may be most of the input: its ranges are spread before they are read
    return rows.repartition("item", "part").mapInPandas(_read_ranges(range_bytes), f"{_KEY}, part int, own string, opens boolean, halo string, last boolean")


def split_ranges(ranges: DataFrame) -> DataFrame:
    """Pieces of the items whose ranges these are: the key, ``piece_no, start_line, end_line, start_offset, end_offset`` (code points, from 0), the range ``part`` in which the piece begins, and ``ats``, the offsets of the ranges that it touches."""
    tables = ranges.mapInPandas(_boundaries, f"{_KEY}, part int, last boolean, chars int, lines int, offsets array<int>, lengths array<int>, natural array<boolean>")
    before = Window.partitionBy(*KEY).orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    # of repeated rows, one counts in the running sums
    copies = Window.partitionBy(*KEY, "part").orderBy(F.lit(0))
    sums = {f"{c}_before": F.coalesce(F.sum(F.when(F.col("copy") == 1, F.col(c)).otherwise(0)).over(before), F.lit(0)).cast("long") for c in ("chars", "lines")}
    placed = tables.repartition(*KEY).withColumn("copy", F.row_number().over(copies)).withColumns(sums).where("copy = 1").drop("copy").sortWithinPartitions(*KEY, "part")
    return placed.mapInPandas(_emit, f"{_KEY}, piece_no int, start_line int, end_line int, start_offset long, end_offset long, part int, ats array<bigint>")


def split_oversized(items: DataFrame, range_chars: int = RANGE) -> DataFrame:
    """Pieces of every distinct oversized item: ``item, piece_no, start_line, end_line, start_offset, end_offset``."""
    return split_ranges(item_ranges(items, range_chars)).select("item", "piece_no", "start_line", "end_line", "start_offset", "end_offset")


def piece_texts(ranges: DataFrame) -> DataFrame:
    """Pieces with their ``text``, cut out of the ranges that they touch and joined."""
    touched = split_ranges(ranges).select(*KEY, "piece_no", "start_line", "end_line", "start_offset", "end_offset", "part", F.posexplode("ats").alias("nth", "at"))
    wanted = touched.withColumn("part", F.col("part") + F.col("nth"))
    texts = ranges.select(*KEY, "part", "own").dropDuplicates([*KEY, "part"])
    lo = F.greatest(F.col("start_offset") - F.col("at"), F.lit(0)).cast("int")
    cut = F.substring("own", lo + 1, (F.col("end_offset") - F.col("at")).cast("int") - lo)
    parts = wanted.join(texts, [*KEY, "part"]).select(*KEY, "piece_no", "start_line", "end_line", "part", cut.alias("cut"))
    # the ranges of one piece are bounded by its limit
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "cut"))), lambda x: x["cut"]), "")
    return parts.groupBy(*KEY, "piece_no").agg(F.first("start_line").alias("start_line"), F.first("end_line").alias("end_line"), joined.alias("text"))


def chunk_items(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks with the limit of their type; the row ``default`` serves null and unlisted types."""
    # the limits are configuration, one row per chunk type, and travel as one value
    entry = F.struct("chunk_type", F.struct("max_chars", "overlap_lines"))
    by_type = limits.where(F.col("chunk_type").isNotNull()).dropDuplicates(["chunk_type"]).agg(F.map_from_entries(F.collect_list(entry))).scalar()
    rows = chunks.select(F.col("id").alias("item"), "content", F.col("start_line").alias("first_line"), F.col("metadata.chunk_type").alias("chunk_type"), by_type.alias("limits"))
    limit = F.coalesce(F.try_element_at("limits", F.coalesce("chunk_type", F.lit("default"))), F.try_element_at("limits", F.lit("default")))
    return rows.select("item", "content", "first_line", limit["max_chars"].alias("max_chars"), limit["overlap_lines"].alias("overlap"))
