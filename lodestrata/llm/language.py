"""Languages of documents and of the segments of mixed ones.

Script ranges narrow the candidates of a word; Viterbi over per-word scores with
a switching penalty (dearer inside a sentence than between sentences) labels
spans. Word scores come from word and character counts of the clean samples,
extended once by the sentences of at most ``FIT_ROWS`` labelled documents (a
parameter) on which the first model and the label agree. The model is a small
table of fixed kind; documents are labelled where they lie. Word scores of a batch are
looked up and summed by sentence as arrays; a sentence in which no change of language can pay is one
unit, and a text all of whose sentences agree needs no path. Segments carry their places in the text.

A sentence speaks for its language if the language leads by ``SURE`` nats, however many
words it has. Confidences are calibrated: a rising curve over the lead, fitted (isotonic regression) on
windows of samples that the model of the other samples has not seen.

Defined edge cases
    null, empty and blank texts, and texts without prose (only code, identifiers,
    numbers, ids), have no language: no segments, and a null language with
    confidence 0. A word whose script no sample has says nothing; a text of such words goes to the first language, with no sentence sure. At
    equal scores the language that comes first in the alphabet wins. Repeated
    rows and copies are labelled alike.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 4000
#: log-odds that a change of language costs inside a sentence and between sentences
INSIDE, BETWEEN = 14.0, 5.0
FLOOR = 6.0  # what one word can say at most, in nats
SURE = 8.0  # lead in nats from which a sentence speaks for its language
KEPT = 1 << 17  # words and runs whose reading a worker keeps

#: fixed values: codes and names of the languages
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語",
}
#: scripts by name; languages get theirs from the samples
SCRIPTS = {
    "latin": r"\p{Latin}", "cyrillic": r"\p{Cyrillic}", "cjk": r"[\p{Hiragana}\p{Katakana}\p{Han}ー]", "greek": r"\p{Greek}", "arabic": r"\p{Arabic}", "hebrew": r"\p{Hebrew}", "hangul": r"\p{Hangul}",
    "devanagari": r"\p{Devanagari}", "thai": r"\p{Thai}",
}
SHARE = 0.1  # of its samples' letters, from which a script belongs to a language

_fence = regex.compile(r"^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*$|\Z)", regex.S | regex.M)
#: inline code, tags, addresses, mail addresses, each looked for only where its mark is
_inline = {mark: regex.compile(p) for mark, p in {"`": r"`[^`\n]*`", "<": r"<[^<>\n]*>", "://": r"\b[a-z][a-z0-9+.-]*://\S+", "@": r"(?<!\S)\S+@\S+"}.items()}
_identifier = regex.compile(r"[\d_/\\=<>{}\[\]#@$%^*+|~]|\p{Ll}\p{Lu}|\p{L}\.\p{L}|\(\)")
_word = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_cjk = regex.compile(SCRIPTS["cjk"] + "+")
_scripts = {name: regex.compile(letters) for name, letters in SCRIPTS.items()}
_stop = regex.compile(r"[.!?…。！？]+[\"'”»)\]]*$")
_item = regex.compile(r"^[ \t>]*(?:[-*+]|\d+[.)]|#{1,6}|--+|//+)[ \t]+", regex.M)


def language_of_label(label: Column) -> Column:
    """The two-letter code that a label names, or null."""
    head = F.regexp_replace(F.lower(F.trim(label)), r"^([\p{L}]{2,3})[-_][\p{L}\d_-]+$", "$1")
    names = F.create_map(*(F.lit(x) for code, words in NAMES.items() for w in words.split() for x in (w, code)))
    return F.try_element_at(names, head)


def _blank(m) -> str:
    return " " * (m.end() - m.start())


def prose(text: str | None) -> str:
    """The text with fenced and inline code, tags and addresses blanked; every place keeps its offset."""
    if not text:
        return ""
    if "\r" in text:
        text = text.replace("\r\n", " \n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _fence.sub(lambda m: "\n\n".ljust(m.end() - m.start()), text)
    for mark, pattern in _inline.items():
        if mark in text:
            text = pattern.sub(_blank, text)
    return text


_chunks: dict[str, tuple[tuple[str, ...], bool]] = {}


def read_chunk(chunk: str) -> tuple[tuple[str, ...], bool]:
    """Prose words of a run without blanks, and whether it closes a sentence; kept per worker, as runs repeat."""
    found = _chunks.get(chunk)
    if found is None:
        one = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        if _cjk.search(one):
            words = _cjk.findall(one)
        elif _identifier.search(one):
            words = []
        else:
            words = [w.lower() for w in _word.findall(one)]
        found = tuple(words), bool(_stop.search(one))
        if len(_chunks) < KEPT and len(chunk) <= 64:
            _chunks[chunk] = found
    return found


_block = regex.compile(r"\n[ \t]*\n|\n(?=[ \t>]*(?:[-*+]|\d+[.)]|#{1,6})[ \t])")
_ideographic = regex.compile(r"(?<=[。！？])")


def sentences(text: str | None) -> list[tuple[list[str], bool]]:
    """Prose as ``(words, ended)``; ``ended`` says whether a mark closes the sentence."""
    out: list[tuple[list[str], bool]] = []
    for part in _block.split(prose(text)):
        words: list[str] = []
        for raw in _item.sub("", part).split():
            for chunk in _ideographic.split(raw) if "。" in raw or "！" in raw or "？" in raw else (raw,):
                found, ends = read_chunk(chunk)
                words += found
                if ends:
                    if words:
                        out.append((words, True))
                    words = []
        if words:
            out.append((words, False))
    return out


def word_places(text: str | None) -> list[tuple[int, int]]:
    """First and last offset (exclusive) of every word of ``sentences``, in the text as given; several words of a run without blanks have the run's place if letters are decomposed."""
    out: list[tuple[int, int]] = []
    body = prose(text)
    at = 0
    for end in [m.span() for m in _block.finditer(body)] + [(len(body), len(body))]:
        part = _item.sub(_blank, body[at : end[0]])
        for m in _run.finditer(part):
            raw, lo = m.group(), at + m.start()
            for chunk in _ideographic.split(raw) if "。" in raw or "！" in raw or "？" in raw else (raw,):
                n = len(read_chunk(chunk)[0])
                spans = [x.span() for x in (_cjk if _cjk.search(chunk) else _word).finditer(chunk)] if n else []
                out += [(lo + a, lo + b) for a, b in spans] if len(spans) == n else [(lo, lo + len(chunk))] * n
                lo += len(chunk)
        at = end[1]
    return out


_run = regex.compile(r"\S+")


def bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@dataclass
class Model:
    """Counts of words and letter triples by language."""

    langs: list[str]
    words: dict[str, Counter] = field(default_factory=lambda: defaultdict(Counter))
    grams: dict[str, Counter] = field(default_factory=lambda: defaultdict(Counter))
    contexts: dict[str, Counter] = field(default_factory=lambda: defaultdict(Counter))

    def add(self, lang: str, words: Counter) -> None:
        for word, weight in words.items():
            for form in {word, bare(word)}:
                share = weight if form == word else weight / 2
                self.words[lang][form] += share
                padded = f"^{form}$"
                for i in range(1, len(padded)):
                    for n in (1, 2, 3):
                        if i >= n:
                            self.grams[lang][padded[i - n : i + 1]] += share
                            self.contexts[lang][padded[i - n : i]] += share

    def freeze(self, scripts: dict[str, set] | None = None, curve: tuple[list[float], list[float]] = ((0.0, 20.0), (0.5, 1.0))) -> "Frozen":
        return Frozen(self.langs, {k: dict(v) for k, v in self.words.items()}, {k: dict(v) for k, v in self.grams.items()}, {k: dict(v) for k, v in self.contexts.items()}, scripts or {}, curve)


@dataclass
class Frozen:
    langs: list[str]
    words: dict
    grams: dict
    contexts: dict

    scripts: dict[str, set] = field(default_factory=dict)
    #: leads and the share of right answers at them
    curve: tuple[list[float], list[float]] = ((0.0, 20.0), (0.5, 1.0))

    def __post_init__(self):
        self.totals = {lang: sum(self.words.get(lang, {}).values()) + 1 for lang in self.langs}
        self._forget()

    def _forget(self):
        self.rows: dict[str, int] = {}
        self.table = np.empty((1024, len(self.langs)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _letters(self, lang: str, word: str) -> float:
        grams, contexts = self.grams.get(lang, {}), self.contexts.get(lang, {})
        padded, total = f"^{word}$", 0.0
        for i in range(1, len(padded)):
            p = 1 / 60
            for n in (1, 2, 3):
                if i >= n:
                    context = padded[i - n : i]
                    seen = contexts.get(context, 0)
                    p = (grams.get(context + padded[i], 0) + 2 * p) / (seen + 2)
            total += math.log(p)
        return total

    def score(self, word: str) -> np.ndarray:
        """Log score by language, 0 for the best and at least ``-FLOOR``; other scripts are out of the question."""
        script = next((name for name, letters in _scripts.items() if letters.search(word)), None)
        can = [i for i, lang in enumerate(self.langs) if script in self.scripts.get(lang, ("latin",))]
        s = np.full(len(self.langs), -4 * FLOOR)
        if not can:
            return np.zeros(len(s))
        if len(can) == 1:
            s[can] = 0.0
            return s
        for i in can:
            seen = self.words.get(self.langs[i], {}).get(word, 0) / self.totals[self.langs[i]]
            s[i] = np.logaddexp(math.log(0.6 * seen) if seen else -np.inf, math.log(0.4) + self._letters(self.langs[i], word))
        s[can] = np.maximum(s[can] - s[can].max(), -FLOOR)
        return s

    def scores(self, words: list[str]) -> np.ndarray:
        """Rows of ``score``, from a table that a worker fills."""
        rows = self.rows
        if len(rows) + len(words) > KEPT:
            self._forget()
            rows = self.rows
        at = []
        for word in words:
            i = rows.get(word)
            if i is None:
                i = rows[word] = len(rows)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[i] = self.score(word)
            at.append(i)
        return self.table[at]

    def label(self, text: str | None) -> list[tuple[int, int, bool, float]]:
        """Spans of sentences or parts: ``(language, words, whole sentence, lead)`` in order."""
        return self.label_all([text])[0]

    def label_all(self, texts: list[str | None]) -> list[list[tuple[int, int, bool, float]]]:
        """``label`` of every text, word scores summed for all of them at once."""
        parts = [sentences(t) for t in texts]
        counts = np.array([len(p) for p in parts])
        sizes = np.array([len(words) for p in parts for words, _ in p], dtype=np.int64)
        if not len(sizes):
            return [[] for _ in texts]
        table = self.scores([w for p in parts for words, _ in p for w in words])
        starts = np.cumsum(sizes) - sizes
        whole = np.add.reduceat(table, starts, axis=0)
        lost = np.add.reduceat(table.max(axis=1), starts) - whole.max(axis=1)
        first = np.cumsum(counts) - counts
        inner = np.ones(len(sizes), dtype=np.int64) * 2
        some = counts > 0
        inner[first[some]] -= 1
        inner[first[some] + counts[some] - 1] -= 1
        # a change inside may spare the changes to both neighbours
        unit = lost <= INSIDE - BETWEEN * inner
        best = whole.argmax(axis=1)
        top = np.partition(whole, -2, axis=1)[:, -2:] if len(self.langs) > 1 else np.c_[np.zeros(len(whole)), whole[:, 0]]
        lead = top[:, 1] - top[:, 0]
        out = []
        for p, at, n in zip(parts, first.tolist(), counts.tolist()):
            if n and unit[at : at + n].all() and (best[at : at + n] == best[at]).all():
                lang = int(best[at])
                out.append([(lang, len(words), ended, x) for (words, ended), x in zip(p, lead[at : at + n].tolist())])
            else:
                rows = table[starts[at] : starts[at] + sizes[at : at + n].sum()] if n else table[:0]
                out.append(self._path(p, whole[at : at + n], unit[at : at + n].tolist(), rows) if n else [])
        return out

    def _path(self, parts: list, whole: np.ndarray, unit: list[bool], rows: np.ndarray) -> list[tuple[int, int, bool, float]]:
        n = len(self.langs)
        units: list[tuple[np.ndarray, int, int]] = []  # (scores, words, sentence)
        word = 0
        for k, (words, _) in enumerate(parts):
            units += [(whole[k], len(words), k)] if unit[k] else [(row, 1, k) for row in rows[word : word + len(words)]]
            word += len(words)
        best = units[0][0].copy()
        back = np.zeros((len(units), n), dtype=np.int64)
        stay = np.arange(n)
        for i in range(1, len(units)):
            penalty = INSIDE if units[i][2] == units[i - 1][2] else BETWEEN
            top = int(best.argmax())
            floor = best[top] - penalty
            back[i] = np.where(floor > best, top, stay)
            best = np.maximum(best, floor) + units[i][0]
        path = [int(best.argmax())]
        for i in range(len(units) - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        path.reverse()
        out: list[tuple[int, int, bool, float]] = []
        i = 0
        while i < len(units):
            j, lang, k = i, path[i], units[i][2]
            total, count = np.zeros(n), 0
            while j < len(units) and units[j][2] == k and path[j] == lang:
                total, count, j = total + units[j][0], count + units[j][1], j + 1
            rest = np.delete(total, lang)
            out.append((lang, count, count == len(parts[k][0]) and parts[k][1], float(total[lang] - rest.max()) if n > 1 else 0.0))
            i = j
        return out

    def confidence(self, lead: float) -> float:
        return round(float(np.interp(lead, *self.curve)), 6)


WINDOWS = (1, 2, 3, 5, 8, 13)


def calibrate(model: Frozen, texts: list[tuple[str, str]], bins: int = 24) -> tuple[list[float], list[float]]:
    """Share of right answers by lead, rising, on windows of ``WINDOWS`` words of texts ``(language, text)``."""
    leads, right = [], []
    for code, body in texts:
        if code not in model.langs:
            continue
        words = [w for ws, _ in sentences(body) for w in ws]
        rows = model.scores(words)
        for size in WINDOWS:
            for lo in range(0, len(words) - size + 1, size):
                total = rows[lo : lo + size].sum(axis=0)
                a, b = np.sort(total)[-2:] if len(total) > 1 else (0.0, total[0])
                leads.append(b - a)
                right.append(model.langs[int(total.argmax())] == code)
    if not leads or len(model.langs) < 2:
        return [0.0], [1.0]
    order = np.argsort(leads, kind="stable")
    # pools of (lead, right, windows); neighbours that fall are merged, and one right and one wrong window are added to each
    pools: list[list[float]] = []
    for rows in np.array_split(order, min(bins, len(order))):
        pools.append([float(np.sum(np.array(leads)[rows])), float(np.sum(np.array(right)[rows])) + 0.5, len(rows) + 1.0, len(rows)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return [p[0] / p[3] for p in pools], [p[1] / p[2] for p in pools]


def scripts_of(texts: list[tuple[str, str]]) -> dict[str, set]:
    """Scripts of each language: those with at least ``SHARE`` of its samples' letters."""
    letters: dict[str, Counter] = defaultdict(Counter)
    for code, body in texts:
        for name, found in _scripts.items():
            letters[code][name] += len(found.findall(body))
    return {code: {name for name, n in count.items() if n >= SHARE * max(1, sum(count.values()))} for code, count in letters.items()}


def fit(samples: DataFrame, labelled: DataFrame | None = None, *, lang: str = "lang", text: str = "text", rows: int = FIT_ROWS, id_col: str = "doc_id") -> Frozen:
    """Model of the samples (a fixed table), extended by at most ``rows`` labelled documents."""
    clean = sorted(tuple(r) for r in samples.select(lang, text).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).distinct().toLocalIterator())
    langs, scripts = sorted({code for code, _ in clean}), scripts_of(clean)

    def read(texts: list[tuple[str, str]]) -> Model:
        counts: dict[str, Counter] = defaultdict(Counter)
        for code, body in texts:
            for words, _ in sentences(body):
                for word in words:
                    counts[code][word] += 3
        model = Model(langs)
        for code in sorted(counts):
            model.add(code, counts[code])
        return model

    model = read(clean)
    first = model.freeze(scripts, calibrate(read(clean[::2]).freeze(scripts), clean[1::2]))
    if labelled is None or not rows:
        return first
    counts = defaultdict(Counter)
    named = labelled.select(language_of_label(F.col(lang)).alias("code"), F.col(text).alias("text"), F.col(id_col).alias("id")).where("code is not null and text is not null")
    for code, body in named.orderBy(F.xxhash64("id"), "id").limit(rows).select("code", "text").toLocalIterator():
        if code not in model.langs:
            continue
        at = model.langs.index(code)
        for words, _ in sentences(body):
            total = first.scores(words).sum(axis=0)
            if total[at] > np.delete(total, at).max():
                counts[code].update(words)
    for code in sorted(counts):
        model.add(code, counts[code])
    return model.freeze(scripts, first.curve)


BATCH = 256  # texts whose word scores are looked up at once


def segments(documents: DataFrame, model: Frozen, *, doc_id: str = "doc_id", text: str = "text", places: bool = True) -> DataFrame:
    """``doc_id, segment_no, lang, n_words, n_sentences, confidence, start_offset, end_offset``: runs of one language in order.

    Offsets are code points of the text as given, from 0, the last one exclusive; a segment reaches from its first
    word to its last. Without ``places`` they are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)[doc_id]
    columns = ["doc_id", "segment_no", "lang", "n_words", "n_sentences", "confidence"] + ["start_offset", "end_offset"] * places

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            ids, texts = pdf[doc_id].tolist(), pdf[text].tolist()
            rows = []
            for lo in range(0, len(ids), BATCH):
                for doc, body, spans in zip(ids[lo : lo + BATCH], texts[lo : lo + BATCH], m.label_all(texts[lo : lo + BATCH])):
                    runs: list[list] = []
                    for lang, n, whole, lead in spans:
                        sentence = whole and lead >= SURE
                        if runs and runs[-1][0] == lang:
                            runs[-1] = [lang, runs[-1][1] + n, runs[-1][2] + sentence, runs[-1][3] + lead]
                        else:
                            runs.append([lang, n, int(sentence), lead])
                    at = word_places(body) if places and runs else []
                    word = 0
                    for k, (lang, n, whole, lead) in enumerate(runs, 1):
                        where = (at[word][0], at[word + n - 1][1]) if places else ()
                        rows.append((doc, k, m.langs[lang], n, whole, m.confidence(lead), *where))
                        word += n
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    fields = f"doc_id {kind}, segment_no int, lang string, n_words int, n_sentences int, confidence double" + ", start_offset int, end_offset int" * places
    return documents.select(doc_id, text).where(F.col(text).isNotNull()).mapInPandas(run, fields)


def document_languages(found: DataFrame) -> DataFrame:
    """``doc_id, lang, n_words, n_sentences, confidence``: each language of each document, from its segments."""
    return found.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n_words"), F.sum("n_sentences").alias("n_sentences"), F.max("confidence").alias("confidence"))


def label_documents(documents: DataFrame, model: Frozen, **kw) -> DataFrame:
    """``doc_id, lang, confidence`` for every document: the language with most words; null and 0 without prose."""
    by = document_languages(segments(documents, model, places=False, **kw))
    main = by.groupBy("doc_id").agg(F.max_by(F.struct("lang", "confidence"), F.struct("n_words", "confidence")).alias("m"))
    return documents.select(F.col(kw.get("doc_id", "doc_id")).alias("doc_id")).join(main, "doc_id", "left").select("doc_id", F.col("m.lang").alias("lang"), F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"))


def mislabelled(documents: DataFrame, model: Frozen, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, lang``: the languages with a whole sentence, of documents whose label is missing or wrong or whose text has several."""
    spoken = document_languages(segments(documents, model, doc_id=doc_id, text=text, places=False)).where("n_sentences > 0")
    per_doc = spoken.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"))  # at most one entry per language of the model
    labels = documents.select(F.col(doc_id).alias("doc_id"), language_of_label(F.col(lang)).alias("named"))
    wrong = F.col("named").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce("named", F.lit("")))
    return labels.join(per_doc, "doc_id").where(wrong).select("doc_id", F.explode("langs").alias("lang")).distinct()
