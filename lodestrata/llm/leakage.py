"""Evaluation texts that leak into training text.

Generalised suffix automata are built over the words of the test items, each over a
block of at most about ``BLOCK_WORDS`` words, in the tasks that use them. Documents stream
through them: the state is the longest suffix of the
words read that occurs in an item, its length the matching length. Wherever that
length reaches ``min_words``, the items that contain the last ``min_words`` words are
leaks; runs of such positions are the leaked spans, which can be removed.

The documents are read once, however many items there are: hashes of their windows of
``min_words`` words are looked up in a bit table of the items' windows (at most
``MOST_BITS``, so what is broadcast has a fixed bound; a fuller table only lets more
documents through). Documents with a hit are joined with the items' windows to
find the blocks that they need, and only these documents meet those automata, in
tasks bounded by text length, also where one item has leaked into a third of all documents.

Words are maximal runs of Unicode letters and digits in lower case; whatever
stands between them does not matter.

Defined edge cases
    null and empty texts and items have no words and no matches; items shorter
    than ``min_words`` never match; repeated rows and equal items each report
    (pairs are distinct); ties do not arise, as all items of a match are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import salted
from lodestrata.session import cut

MIN_WORDS = 12
BLOCK_WORDS = 200_000
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
BITS_A_WINDOW, PLACES = 64, 4  # of the bit table, as far as MOST_BITS allows
SEGMENT = 1 << 16  # bits of the table that one task packs
BATCH = 256  # texts whose windows are looked up at once
TASK_CHARS = 1 << 25  # characters of documents that one task streams through one automaton
_word = regex.compile(r"[\p{L}\p{Nd}]+")


_plain = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return (_plain if low.isascii() else _word).findall(low)


class SuffixAutomaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.len: list[int] = [0]
        self.ends: list[set] = [set()]
        self.found: list[tuple] = []

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.len.append(length)
        self.ends.append(set())
        return len(self.len) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        cur, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return cur

    def add(self, item: int, text: str | None) -> None:
        last = 0
        for word in words(text):
            last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
            if self.len[last] >= self.min_words:
                self.ends[last].add(item)

    def close(self) -> "SuffixAutomaton":
        """Give each state that stands for ``min_words`` words the items in which these occur."""
        order = sorted(range(1, len(self.len)), key=lambda v: -self.len[v])
        for v in order:
            if self.len[self.link[v]] >= self.min_words:  # shorter states are never read
                self.ends[self.link[v]] |= self.ends[v]
        # `found` of a state: the items of its ancestor whose lengths include min_words
        self.found = [()] * len(self.len)
        for v in reversed(order):
            if self.len[v] >= self.min_words:
                above = self.link[v]
                self.found[v] = tuple(sorted(self.ends[v])) if self.len[above] < self.min_words else self.found[above]
        self.ends = []
        return self

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        """Maximal runs ``(item, first, last)``: the words first..last of the text, each of whose windows of ``min_words`` words stands in the item."""
        ids, arcs, link, length, found, k = self.ids, self.next, self.link, self.len, self.found, self.min_words
        sequence = [ids.get(w, -1) for w in words(text)]
        open_runs: dict[int, list[int]] = {}
        runs: list[tuple[int, int, int]] = []
        state, matched = 0, 0
        for at, c in enumerate(sequence):
            if c < 0:
                state, matched = 0, 0
                continue
            while state and c not in arcs[state]:
                state = link[state]
                matched = length[state]
            step = arcs[state].get(c)
            if step is None:
                matched = 0
                continue
            state, matched = step, matched + 1
            if matched >= k:
                # the state of the last `matched` words; its ancestor holds the last k
                for item in found[state]:
                    run = open_runs.get(item)
                    if run and run[1] == at - 1:
                        run[1] = at
                    else:
                        if run:
                            runs.append((item, *run))
                        open_runs[item] = [at - k + 1, at]
        runs += [(item, *run) for item, run in open_runs.items()]
        return runs


_hashes: dict[str, int] = {}


def window_hashes(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every window of ``k`` words of each text, and the number of the window's text."""
    if len(_hashes) > 1 << 18:
        _hashes.clear()
    get, one, sizes = _hashes.get, [], []
    for text in texts:
        found = words(text)
        sizes.append(len(found))
        for w in found:
            h = get(w)
            if h is None:
                h = _hashes[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            one.append(h)
    n = len(one) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    h, of = np.array(one, dtype=np.uint64), np.repeat(np.arange(len(texts)), sizes)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * _FACTOR + h[j : j + n]
    whole = of[:n] == of[k - 1 :]  # windows over the end of a text are none
    total, of = total[whole], of[:n][whole]
    return (total ^ (total >> np.uint64(29))) * _FACTOR, of


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def bits_of(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """``PLACES`` places of each hash in a table of ``bits`` bits, a power of two."""
    mask = np.uint64(bits - 1)
    for _ in range(PLACES):
        yield hashes & mask
        hashes = (hashes ^ (hashes >> np.uint64(31))) * _FACTOR


def hits(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the hashes all of whose places are set; the later places are looked up for those that are left."""
    left = np.arange(len(hashes))
    mask = np.uint64(bits - 1)
    h = hashes
    for _ in range(PLACES):
        at = h & mask
        kept = (table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
        left, h = left[kept], h[kept]
        if not len(h):
            break
        h = (h ^ (h >> np.uint64(31))) * _FACTOR
    return left


def _windows(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, text in zip(pdf.block, pdf.text):
                h = np.unique(window_hashes([text], k)[0]).astype(np.int64)
                if len(h):
                    yield pd.DataFrame({"h": h, "block": block})

    return run


def bit_table(windows: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the column ``h``, packed by segments; ``bits`` bound what reaches the driver."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(np.concatenate(list(bits_of(pdf.h.to_numpy().astype(np.int64).view(np.uint64), bits)))).astype(np.int64)
            yield pd.DataFrame({"segment": at // SEGMENT, "at": (at % SEGMENT).astype(np.int32)})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(SEGMENT, dtype=bool)
        table[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"segment": pdf.segment.iloc[:1], "packed": [np.packbits(table).tobytes()]})

    packed = windows.select("h").mapInPandas(split, "segment long, at int").distinct().groupBy("segment").applyInPandas(pack, "segment long, packed binary")
    out = np.zeros(max(1, bits // SEGMENT) * SEGMENT // 8, dtype=np.uint8)
    for row in packed.collect():  # at most ``bits`` bits in all, in one job
        out[row.segment * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(row.packed, dtype=np.uint8)
    return out


def leaked_spans(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, most_bits: int = MOST_BITS
) -> DataFrame:
    """``doc_id, item_id, first_word, last_word, n_words``: leaked runs, words counted from 0."""
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    tests = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    # a word has a letter at least and something after it, so half the characters bound the words
    held = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-held // (2 * block_words)))
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)).cast("int"))
    windows = cut(tests.select("block", "text").mapInPandas(_windows(min_words), "h long, block int").distinct())
    n = windows.count()
    bits = min(most_bits, max(LEAST_BITS, 1 << (BITS_A_WINDOW * n - 1).bit_length() if n else 0))
    shared = spark.sparkContext.broadcast(bit_table(windows, bits))

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for pdf in batches:
            rows, docs, texts = [], pdf.doc.tolist(), pdf.text.tolist()
            for lo in range(0, len(docs), BATCH):
                h, of = window_hashes(texts[lo : lo + BATCH], min_words)
                found = hits(table, h, bits)
                h, of = h[found], of[found]
                for i in np.unique(of).tolist():
                    rows.append((docs[lo + i], texts[lo + i], np.unique(h[of == i]).astype(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "text", "hs"])

    passed = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("text is not null").mapInPandas(screen, f"doc {kind[0]}, text string, hs array<long>")
    if n_blocks == 1:
        asked = passed.select("doc", "text", F.lit(0).alias("block"), F.monotonically_increasing_id().alias("row"))
    else:
        passed = cut(passed.withColumn("row", F.monotonically_increasing_id()))
        left, right = salted(passed.select("row", F.explode("hs").alias("h")), windows, "h", "row")
        need = left.join(right, ["h", "salt"]).select("row", "block").distinct()
        asked = passed.drop("hs").join(need, "row")
    asked = cut(asked)
    # a block's documents are spread over tasks by their length
    tasks = asked.groupBy("block").agg(F.ceil(F.sum(F.length("text")) / TASK_CHARS).cast("int").alias("tasks"))
    to_scan = asked.join(tasks, "block").select("block", F.pmod(F.xxhash64("row"), "tasks").cast("int").alias("task"), "doc", "text")
    automata = tests.join(tasks, "block").select(F.col("block").alias("block"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("item").alias("item"), F.col("text").alias("text"))

    def scan(docs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or held.empty:
            return pd.DataFrame()
        automaton = SuffixAutomaton(min_words)
        for item, body in zip(held["item"], held.text):
            automaton.add(item, body)
        find = automaton.close().scan
        rows = [(d, *hit) for d, t in zip(docs.doc, docs.text) for hit in find(t)]
        found = pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "last_word"])
        return found.assign(n_words=found.last_word - found.first_word + 1) if rows else pd.DataFrame()

    return to_scan.groupBy("block", "task").cogroup(automata.groupBy("block", "task")).applyInPandas(scan, f"doc_id {kind[0]}, item_id {kind[1]}, first_word int, last_word int, n_words int")


def leaks(documents: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Distinct ``(doc_id, item_id)``."""
    return leaked_spans(documents, items, **kw).select("doc_id", "item_id").distinct()


def remove_leaks(documents: DataFrame, items: DataFrame, *, max_coverage: float = 0.5, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``doc_id, text, coverage``: texts without their leaked spans.

    A text whose leaked words exceed ``max_coverage`` of its words comes out null. Texts without leaks are unchanged.
    """
    spans = leaked_spans(documents, items, min_words=min_words, doc_id=doc_id, text=text, **kw).select("doc_id", "first_word", "last_word").distinct()
    # the spans of one document are bounded by its own words
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "last_word")).alias("spans"))
    kind = dict(documents.dtypes)[doc_id]
    hit = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(by_doc, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, shares = [], []
            for body, found in zip(pdf.text, pdf.spans):
                if found is None or len(found) == 0:
                    texts.append(body)
                    shares.append(0.0)
                    continue
                # lower case can change a text's length, so words are found in the text itself
                places = [m.span() for m in _word.finditer(body)]
                gone = {i for s in found for i in range(s["first_word"], s["last_word"] + 1)}
                share = len(gone) / max(1, len(places))
                kept, at = [], 0
                for i in sorted(gone):
                    if i < len(places):
                        lo = places[i][0] if i - 1 not in gone else at
                        kept.append(body[at:lo])
                        at = places[i][1]
                texts.append(None if share > max_coverage else "".join(kept) + body[at:])
                shares.append(share)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text": texts, "coverage": shares})

    return hit.mapInPandas(run, f"doc_id {kind}, text string, coverage double")
