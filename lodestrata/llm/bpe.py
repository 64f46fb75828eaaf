"""Corpus encoding with a public byte-level BPE vocabulary, by automaton.

Compilation
    The automaton reads tokens; its states are the token read last, and it
    accepts exactly the token sequences that BPE produces. It starts with the 256
    byte tokens, where every arc is allowed, and one gadget per merge
    ``(a, b) -> c``, in rank order: ``c`` inherits the arcs that enter ``a`` and those
    that leave ``b``, as they stand, and the arc ``a -> b`` is removed. Tables of
    50,000 x 50,000 arcs are not written out: a gadget is stored as its two
    parents (inheritance) and its removed arc, and an arc's presence is read off
    them once (``Automaton.arc``) and kept in a table of at most ``KEPT_ARCS`` entries.
    The labels are compiled into a byte transition table (node, byte) -> node, whose size the vocabulary fixes.

Encoding
    Pre-split words are read left to right. Every prefix of a word has exactly one
    accepted token sequence, so each position holds one state; the state of a
    position is the longest token that ends there and whose arc from the state at
    its start exists. From every position the byte table is followed as far as labels
    go, and each label end without a state takes one; earlier starts come first, so
    the longest token does. Words repeat, so encoded words are kept per worker.

Decoding emits the arcs' labels: the bytes of the tokens.

Defined edge cases
    null and empty texts have an empty list of ids; special-token strings are
    ordinary text; text is taken as it is (no normalisation); unpaired halves of surrogates,
    which UTF-8 cannot hold, do not reach this code from Spark.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

#: fixed value: the pre-splitting pattern of the vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_DIR = "/opt/tokenizers"
KEPT_WORDS = 1 << 18
KEPT_ARCS = 1 << 20


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", DEFAULT_DIR), name)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a file of ``base64 id`` lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


class Automaton:
    """Token automaton of a byte-level BPE vocabulary whose ids are merge ranks."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        n = len(tokens)
        self.left, self.right = list(range(n)), list(range(n))
        self.removed: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        for c, label in enumerate(tokens):
            if len(label) > 1:
                self._gadget(c, label)
        self.step: dict[int, int] = {}  # node * 256 + byte -> node
        self.label = [-1]  # the token whose label ends at a node
        for c, label in enumerate(tokens):
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(self.label)
                    self.label.append(-1)
            self.label[node] = c

    def _gadget(self, c: int, label: bytes) -> None:
        """Add token ``c``: its parents are the two tokens that its label is made of just before it exists."""
        a, b = self._pair(label, c)
        self.left[c], self.right[c] = a, b
        self.removed[a, b] = c

    def _pair(self, label: bytes, c: int) -> tuple[int, int]:
        """The label's two-token sequence in the automaton of the ranks below ``c``."""
        for cut in range(1, len(label)):
            a, b = self.ids.get(label[:cut], c), self.ids.get(label[cut:], c)
            if a < c and b < c and self._exists(a, b):
                return a, b
        raise ValueError(f"token {c} is not made by a merge of earlier tokens")

    def _exists(self, x: int, y: int) -> bool:
        """Whether the arc from state ``x`` that reads ``y`` exists, among the gadgets built so far.

        The newer of both tokens inherited the arc from its parent as it stood
        when its gadget was added, so only arcs removed before that count.
        """
        before = len(self.tokens)
        while True:
            gone = self.removed.get((x, y))
            if gone is not None and gone < before:
                return False
            if x > y:
                before, parent = x, self.right[x]
                if parent != x:
                    x = parent
                    continue
                before, parent = y + 1, self.left[y]
                if parent == y:
                    return True
                y = parent
            else:
                before, parent = y + 1, self.left[y]
                if parent != y:
                    y = parent
                    continue
                before, parent = x, self.right[x]
                if parent == x:
                    return True
                x = parent

    def arc(self, x: int, y: int) -> bool:
        """Transition table entry, filled on first use."""
        found = self.table.get((x, y))
        if found is None:
            if len(self.table) >= KEPT_ARCS:
                self.table.clear()
            found = self.table[x, y] = self._exists(x, y)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        step, label, n = self.step, self.label, len(word)
        states, starts = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            node, before = 0, states[start]
            for end in range(start, n):
                node = step.get(node << 8 | word[end], 0)
                if not node:
                    break
                token = label[node]
                if token >= 0 and states[end + 1] < 0 and (start == 0 or self.arc(before, token)):
                    states[end + 1], starts[end + 1] = token, start
        out, at = [], len(word)
        while at:
            out.append(states[at])
            at = starts[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


_loaded: dict[str, tuple[Automaton, dict[str, list[int]]]] = {}


def send(spark: SparkSession, path: str):
    """The vocabulary as a broadcast, whose size the file fixes, and its digest; executors need no file."""
    tokens = read_ranks(path)
    return hashlib.sha256(b"\0".join(tokens)).hexdigest(), spark.sparkContext.broadcast(tokens)


def load(digest: str, shared) -> tuple[Automaton, dict[str, list[int]]]:
    """The automaton, compiled once per worker and vocabulary, and the worker's kept words."""
    if digest not in _loaded:
        _loaded[digest] = Automaton(shared.value), {}
    return _loaded[digest]


_split = regex.compile(PATTERN)


def encode_text(text: str | None, automaton: Automaton, kept: dict[str, list[int]]) -> list[int]:
    out: list[int] = []
    for match in _split.finditer(text or ""):
        word = match.group()
        ids = kept.get(word)
        if ids is None:
            ids = automaton.encode_word(word.encode("utf-8"))
            if len(kept) < KEPT_WORDS and len(word) <= 64:
                kept[word] = ids
        out += ids
    return out


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids ARRAY<INT>`` of every row, null and empty texts included."""
    sent = send(documents.sparkSession, path)
    schema = documents.select(id_col, text_col).schema
    out = pa.schema([(id_col, to_arrow_type(schema[0].dataType)), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, kept = load(*sent)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            ids = pa.array([encode_text(t, automaton, kept) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([keys.cast(out.field(0).type), ids], schema=out)

    kind = schema[0].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``text``, the labels of its ids; bytes that are no UTF-8 become U+FFFD."""
    sent = send(encoded.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, _ = load(*sent)
        for pdf in batches:
            yield pdf.assign(text=[automaton.decode(list(x)).decode("utf-8", "replace") for x in pdf[ids_col]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInPandas(run, f"{fields}, text string")
