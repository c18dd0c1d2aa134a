"""Held-out evaluation passages inside a corpus (problem 9).

Method: q-gram lemma filtering in overlapping diagonal bands, then banded alignment.

A passage leaks into a text if the text holds a run of at least ``run_words`` of its words, in
order, of which at most one in ``1 / altered_share`` is altered. By the pigeonhole principle such
a run keeps ``clean_words(run_words, altered_share)`` neighbouring words untouched (six for twelve
words and one in ten). They share (characters - q + 1) q-grams on one diagonal, so a passage whose
shortest such stretch has c characters can only leak where some diagonal band has c - q + 1 common
q-grams. Bands overlap by half; every surviving region is verified by a banded word alignment.

The passages are indexed in blocks of ``block_passages``, each block is broadcast and all texts are
streamed past it: no shuffle, whatever the skew of the texts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import cut_lineage, cut_table, spread

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_NUMBERED = re.compile(r"(?m)^[^\w\n]*\d{1,5}[.:)|\]][ \t]+(?=\S)")
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]+")
_SENTENCE = re.compile(r"[^.?!]*[.?!]?")

SCHEMA = "passage_id bigint, first_word int, words int, altered int"


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, markup, entities and line prefixes; null gives none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(_NUMBERED.sub("", text).casefold())


def clean_words(run_words: int, altered_share: float) -> int:
    """Words that every qualifying run keeps next to each other, by the pigeonhole principle."""
    least = run_words
    for length in range(run_words, 40 * run_words):
        altered = int(length * altered_share + 1e-9)
        least = min(least, -(-(length - altered) // (altered + 1)))
    return least


def _sentences(text: str | None) -> list[tuple[str, str]]:
    """(sentence, its words joined by blanks) of a text."""
    return [(x, " ".join(words_of(x))) for x in _SENTENCE.findall(text or "") if x.strip()]


def strip_stock(texts: DataFrame, id_col: str, text_col: str, shared_by: int = 5) -> DataFrame:
    """``id, text``: the texts without the sentences that at least ``shared_by`` of them have in common.

    Sentences are the same if their words are. A text of which nothing is left, and null and empty
    ones, give no row; repeated ids are one text. The stock sentences are anti-joined, so a sentence
    that all texts share is the hot key of a join that AQE splits.
    """
    kind = texts.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, n, x, words) for key, text in zip(batch[id_col].tolist(), batch[text_col].tolist(), strict=True) for n, (x, words) in enumerate(_sentences(text))]
            yield pd.DataFrame(rows, columns=[id_col, "__n", "__sentence", "__words"])

    parts = cut_lineage(texts.select(id_col, text_col).na.drop().mapInPandas(split, f"{id_col} {kind}, __n int, __sentence string, __words string"))
    stock = parts.select(id_col, "__words").distinct().groupBy("__words").count().filter(F.col("count") >= shared_by).select("__words")
    left = parts.join(stock, "__words", "left_anti").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("__n", "__sentence"))).alias("__s"))
    return left.select(id_col, F.array_join(F.transform("__s", lambda x: x["__sentence"]), " ").alias(text_col))


#: Bytes of text looked at in one piece; bounds what the q-grams of a batch take in a worker.
PIECE = 1 << 20


def _grams(data: bytes) -> np.ndarray:
    """A 64-bit hash of the 12 bytes from each position of ``data``."""
    if len(data) < 12:
        return np.empty(0, np.uint64)
    g = np.frombuffer(data, np.uint8).astype(np.uint64)
    for width in (1, 2, 4):
        g = g[:-width] | (g[width:] << np.uint64(8 * width))
    with np.errstate(over="ignore"):
        return g[:-4] * np.uint64(0x9E3779B97F4A7C15) ^ g[4:] * np.uint64(0xC2B2AE3D27D4EB4F)


Q = 12


class PassageIndex:
    """Sorted q-gram hashes of a block of passages with their positions, and the bound of each."""

    def __init__(self, passages: list[list[str]], clean: int):
        self.words, self.clean = passages, clean
        self.stretches = [{tuple(w[i : i + clean]) for i in range(len(w) - clean + 1)} for w in passages]
        self.starts = [np.cumsum([0] + [len(x.encode()) + 1 for x in w]) for w in passages]
        self.numbers = [{x: n for n, x in enumerate(dict.fromkeys(w))} for w in passages]
        self.coded = [np.array([known[x] for x in w], np.int64) for w, known in zip(passages, self.numbers, strict=True)]
        hashes, owner, position, need = [], [], [], []
        for number, words in enumerate(passages):
            joined = " ".join(words).encode()
            grams = _grams(joined)
            hashes.append(grams)
            owner.append(np.full(len(grams), number, np.int64))
            position.append(np.arange(len(grams), dtype=np.int64))
            sizes = [len(w.encode()) for w in words]
            stretch = [sum(sizes[i : i + clean]) + clean - 1 for i in range(max(1, len(words) - clean + 1))]
            need.append(max(1, min(stretch, default=0) - Q + 1))
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.owner = np.concatenate(owner)[order] if hashes else np.empty(0, np.int64)
        self.position = np.concatenate(position)[order] if hashes else np.empty(0, np.int64)
        self.need = np.array(need, np.int64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def occurrences(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, passage, passage position) of every common q-gram, in the order of the text."""
        found = [self._piece(_grams(data[start : start + PIECE + Q - 1]), start) for start in range(0, max(1, len(data)), PIECE)]
        return tuple(np.concatenate(column) for column in zip(*found, strict=True))

    def _piece(self, grams: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.seen[(grams >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.hash, grams[at], "left")
        count = np.searchsorted(self.hash, grams[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        starts = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else low, count)
        entry = starts + np.arange(len(starts))
        return np.repeat(at, count) + start, self.owner[entry], self.position[entry]


def _regions(index: PassageIndex, number: np.ndarray, at: np.ndarray, passage: np.ndarray, position: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, passage, first and last text position, passage position of the first) of the bands
    that meet their bound, text by text; bands overlap by half."""
    if not len(at):
        return
    diagonal = at - position + int(position.max())
    span = int(diagonal.max()) // width + 2
    found = []
    for shift in (0, width // 2):
        key = (number * len(index.words) + passage) * span + (diagonal + shift) // width
        order = np.argsort(key, kind="stable")  # positions of a band stay in the order of the text
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        size = np.diff(first, append=len(key))
        meets = np.flatnonzero(size >= index.need[passage[order[first]]])
        head, tail = order[first[meets]], order[first[meets] + size[meets] - 1]
        found.append(np.stack([number[head], passage[head], at[head], at[tail], position[head]], 1))
    every = np.concatenate(found)
    yield from map(tuple, every[np.argsort(every[:, 0], kind="stable")].tolist())


def _longest(matched: list[bool], least: int, share: float) -> tuple[int, int] | None:
    """(start, length) of the longest stretch of at least ``least`` steps that begins and ends with a
    match and has at most ``share`` of its steps unmatched; of equal ones the first."""
    excess = [0.0]  # unmatched steps beyond the share
    for m in matched:
        excess.append(excess[-1] + (not m) - share)
    starts: list[int] = []
    for a, m in enumerate(matched):
        if m and (not starts or excess[a] > excess[starts[-1]]):
            starts.append(a)
    found = None
    for b in range(len(matched), 0, -1):
        if not matched[b - 1]:
            continue
        while starts and excess[b] - excess[starts[-1]] <= 1e-9:
            a = starts.pop()
            if b - a >= least and (found is None or b - a >= found[1]):
                found = (a, b - a)
    return found


def banded_run(passage: np.ndarray, text: np.ndarray, offset: int, band: int, run_words: int, altered_share: float) -> tuple[int, int, int] | None:
    """The longest qualifying run in the alignment of two lists of word numbers near one diagonal.

    ``offset`` is text index minus passage index of the diagonal. Returns (first text word, words,
    altered) or None. Local alignment with +2 for equal words and -1 for each altered, missing or
    additional word, one row of the band at a time; on its path the longest stretch with enough
    words and few enough changes wins. A run begins and ends with an unaltered word.
    """
    m, wide = len(passage), 2 * band + 1
    left = offset - band  # text index of the first cell of row 0
    low, high = max(0, left), min(len(text), left + m + wide - 1)
    if m == 0 or high <= low:
        return None
    near = np.full(m + wide - 1, -1, np.int64)
    near[low - left : high - left] = text[low:high]
    windows = np.lib.stride_tricks.sliding_window_view(near, wide)
    equal = windows == passage[:, None]
    step, outside = np.where(equal, 2, -1).astype(np.int32), windows < 0
    score = np.zeros((m, wide), np.int32)
    ramp, previous = np.arange(wide, dtype=np.int32), np.zeros(wide + 1, np.int32)
    for i in range(m):
        row = np.maximum(previous[:-1] + step[i], previous[1:] - 1)
        row[outside[i]] = -wide
        row = np.maximum(np.maximum.accumulate(row + ramp) - ramp, 0)  # words added in the text
        row[outside[i]] = 0
        score[i] = previous[:-1] = row
    best = int(score.max())
    if best <= 0:
        return None
    i, c = divmod(score.size - 1 - int(np.argmax(score[::-1, ::-1])), wide)
    path: list[tuple[int, bool]] = []
    while i >= 0 and 0 <= c < wide and score[i, c] > 0:
        here = score[i, c]
        above, aside = (score[i - 1, c], score[i - 1, c + 1] if c + 1 < wide else 0) if i else (0, 0)
        if here == above + step[i, c]:
            path.append((left + i + c, bool(equal[i, c])))
            i -= 1
        elif here == aside - 1:
            path.append((left + i + c, False))
            i, c = i - 1, c + 1
        else:
            path.append((left + i + c, False))
            c -= 1
    path.reverse()
    matched = [m for _, m in path]
    found = _longest(matched, run_words, altered_share)
    if found is None:
        return None
    a, length = found
    return path[a][0], length, length - sum(matched[a : a + length])


def _slices(words: Iterator[list[str]], most: int = PIECE) -> Iterator[tuple[int, list[list[str]]]]:
    """Consecutive texts (number of the first, their words) of about ``most`` characters together."""
    first, held, size = 0, [], 0
    for n, own in enumerate(words):
        if held and size > most:
            yield first, held
            first, held, size = n, [], 0
        held.append(own)
        size += sum(map(len, own)) + len(own)
    if held:
        yield first, held


def _scan(texts: Iterator[list[str]], index: PassageIndex, run_words: int, altered_share: float, width: int = 64) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
    """(text number, passage, run) of every leak in a batch of texts, given as their words."""
    for base, words in _slices(texts):
        joined = [" ".join(w).encode() for w in words]
        ends = np.cumsum([len(j) + 1 for j in joined])
        at, passage, position = index.occurrences(b"\n".join(joined))
        number = np.searchsorted(ends, at, "right")
        local = at - np.concatenate(([0], ends[:-1]))[number]
        for n, regions in groupby(_regions(index, number, local, passage, position, width), itemgetter(0)):
            for p, run in _leaks(words[n], regions, index, run_words, altered_share):
                yield base + n, p, run


def _leaks(words: list[str], regions: Iterator[tuple[int, int, int, int, int]], index: PassageIndex, run_words: int, altered_share: float) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """(passage, run) of the passages that leak into one text, each once."""
    starts = np.cumsum([0] + [len(w.encode()) + 1 for w in words])
    done: dict[int, tuple[int, int, int]] = {}
    tried: set[tuple[int, int, int, int]] = set()
    for _, p, first, last, at_item in regions:
        if p in done:
            continue
        own = index.words[p]
        left = int(np.searchsorted(starts, first, "right")) - 1
        item_word = int(np.searchsorted(index.starts[p], at_item, "right")) - 1
        low = max(0, left - item_word - 30)
        high = min(len(words), int(np.searchsorted(starts, last, "right")) + len(own) + 30)
        # the band that overlaps this one often holds the same region
        if (p, low, high, left - item_word) in tried:
            continue
        tried.add((p, low, high, left - item_word))
        # the lemma on words: some stretch of neighbours is unaltered in every qualifying run
        if not any(tuple(words[j : j + index.clean]) in index.stretches[p] for j in range(low, high - index.clean + 1)):
            continue
        known = index.numbers[p]
        text = np.array([known.get(w, len(known)) for w in words[low:high]], np.int64)
        run = banded_run(index.coded[p], text, left - item_word - low, 24, run_words, altered_share)
        if run:
            done[p] = (run[0] + low, run[1], run[2])
    yield from done.items()


def leaked_passages(
    texts: DataFrame,
    items: DataFrame,
    id_col: str,
    text_col: str,
    item_col: str = "item_id",
    passage_col: str = "passage",
    run_words: int = 12,
    altered_share: float = 0.1,
    block_passages: int = 20_000,
) -> DataFrame:
    """``id, item_id, passage_id, first_word, words, altered``: one row per text and leaked passage.

    ``items`` holds (item, passage) rows of the held-out set; ``passage_id`` is a hash of the
    passage. Sentences that many passages share must be removed before (``strip_stock``). Null
    items, null or blank texts and passages, and passages of fewer than ``run_words`` words, leak
    nowhere; texts without an id are left out. Repeated texts each report their leaks. Other
    columns of both inputs are ignored, so clashing names do no harm. Passages are counted and
    broadcast in blocks of about ``block_passages``; if there are several, the texts are split into
    words once, written, and streamed past each block.
    """
    spark = texts.sparkSession
    kind = texts.schema[id_col].dataType.simpleString()
    held = cut_lineage(items.select(F.col(item_col).cast("string").alias("item"), F.col(passage_col).cast("string").alias("passage")).na.drop().distinct())
    blocks = max(1, -(-held.count() // block_passages))
    held = held.select("item", "passage", F.xxhash64("passage").alias("id"), F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)).alias("block"))
    clean = clean_words(run_words, altered_share)
    source, read = spread(texts.select(id_col, text_col).filter(F.col(id_col).isNotNull())), words_of
    if blocks > 1:

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({id_col: batch[id_col], text_col: [" ".join(words_of(t)) for t in batch[text_col]]})

        source, read = cut_table(source.mapInPandas(split, f"{id_col} {kind}, {text_col} string"), "words"), lambda t: t.split(" ") if t else []
    out = None
    for block in range(blocks):
        rows = sorted((r.item, r.passage, r.id) for r in held.filter(F.col("block") == block).collect())  # about block_passages
        kept = [(item, number, w) for item, passage, number in rows if len(w := words_of(passage)) >= run_words]
        sent = spark.sparkContext.broadcast((PassageIndex([w for *_, w in kept], clean), [(item, number) for item, number, _ in kept]))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index, names = sent.value
            for batch in batches:
                ids = batch[id_col].tolist()
                found = [(ids[n], *names[p], *run) for n, p, run in _scan(map(read, batch[text_col]), index, run_words, altered_share)]
                yield pd.DataFrame(found, columns=[id_col, "item_id", "passage_id", "first_word", "words", "altered"])

        part = source.mapInPandas(scan, f"{id_col} {kind}, item_id string, {SCHEMA}")
        out = part if out is None else out.unionByName(part)
    return out
