"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary, learned
from counts over all training texts (texts are cut into pieces by the vocabulary's own
library, distinct words once a batch). A word's probability in a language is the sum,
over all ways to cut it into pieces, of the product of the pieces' probabilities; the
forward algorithm gives it in one sweep over the word. A text's score is the sum over
its words; the language with the largest wins, all languages being equally likely at
first.

Texts are normalised (NFKC, small letters) alike for learning and scoring. Words are
runs of letters and the marks on them, of any length, and get the vocabulary's
word-start mark. Characters that no piece covers count ``FLOOR`` in every language.
Sums are rescaled on the way, so no probability is too small for long words or large
corpora. Only the count table (pieces x languages) reaches the driver.

Null texts and texts without a letter (Unicode categories L*; numerals and marks alone
are none) are ``und`` with score 0, as are all texts where nothing could be learned.
Ties go to the first language by name. Repeated rows count as often as they stand and
get a row each; very long texts are read whole, a word in time in proportion to its
length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import narrowed

MARK = "▁"
FLOOR = 1e-7
SMOOTHING = 0.1
#: Distinct words, and their characters, that a task remembers; it forgets all of them beyond that.
MEMO, MEMO_CHARS = 300_000, 4_000_000
#: Words above this length are summed one by one, the others together by length; the sums are the same.
TOGETHER = 32
#: Characters after which sums are rescaled.
RESCALE = 8
#: Characters of text handled at once.
BLOCK = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _class(of: Callable[[str], bool]) -> str:
    """The inside of a regular expression's class of all characters with a property."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        there = c <= sys.maxunicode and of(chr(c))
        if there and first is None:
            first = c
        elif not there and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


# Letters are what \w covers less digits, the low line and the numerals that aren't letters.
_LETTERS = r"[^\W\d_" + _class(lambda c: c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]"
_MARKS = _class(lambda c: unicodedata.category(c)[0] == "M")
_LETTER = re.compile(_LETTERS).search
_WORDS = re.compile(f"{_LETTERS}+(?:[{_MARKS}]+{_LETTERS}*)*").findall


def word_list(text: str) -> list[str]:
    return _WORDS(unicodedata.normalize("NFKC", text).lower())


def vocabulary(model_path: str) -> list[str]:
    """The model's pieces by id; empty for control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def piece_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """lang, piece, n over all rows of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size, np.int64))
        for b in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                words[lang].update(word_list(text or ""))
            for lang, found in words.items():
                listed = list(found)
                for at in range(0, len(listed), 50_000):
                    part = listed[at : at + 50_000]
                    ids = sp.encode(part, num_threads=1)
                    times = np.repeat([found[w] for w in part], [len(x) for x in ids])
                    flat = np.fromiter((i for x in ids for i in x), np.int64, len(times))
                    counts[lang] += np.bincount(flat, weights=times, minlength=size).astype(np.int64)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], names=["lang", "piece", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Segmenter:
    """Log probabilities of words in each language, over all segmentations."""

    def __init__(self, pieces: list[str], langs: list[str], counts: np.ndarray):
        """counts: pieces x languages."""
        self.langs, self.longest = langs, max((len(p) for p in pieces if p), default=1)
        usable = np.array([bool(p) for p in pieces])
        kept = np.where(usable[:, None], counts + SMOOTHING, 0.0)
        self.prob = kept / kept.sum(axis=0)
        # Pieces by hash, and a bitmap that most other stretches of a word miss.
        ids = np.flatnonzero(usable)
        h = np.array([self._hash(pieces[i]) for i in ids], np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], ids[order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[h >> np.uint64(44)] = True
        self.known: dict[str, int] = {}
        self.chars = 0
        self.rows = np.zeros((1024, len(langs)))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_MULTIPLIER) % 2**64
        return h

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, and the pieces."""
        near = np.flatnonzero(self.bitmap[h >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        same = self.hashes[k] == h[near]
        return near[same], self.ids[k[same]]

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)

    def _together(self, words: list[str], m: int) -> np.ndarray:
        """Marked words of m characters each."""
        n = len(words)
        codes = self._codes("".join(words)).reshape(n, m)
        # alpha[j]: probability of the word's first j characters; complete once every start before j is done.
        alpha, logs = np.zeros((m + 1, n, len(self.langs))), np.zeros((n, len(self.langs)))
        alpha[0] = 1.0
        for i in range(m):
            if i and i % RESCALE == 0:
                top = alpha[i : i + self.longest + 1].max(axis=0)
                alpha[i : i + self.longest + 1] /= top
                logs += np.log(top)
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(m, i + self.longest) + 1):
                h = (h + codes[:, j - 1]) * _MULTIPLIER
                near, ids = self._found(h)
                alpha[j, near] += alpha[i, near] * self.prob[ids]
                if j == i + 1:
                    bare = np.ones(n, bool)
                    bare[near] = False
                    alpha[j, bare] += alpha[i, bare] * FLOOR
        return np.log(alpha[m]) + logs

    def _alone(self, word: str) -> np.ndarray:
        """A long marked word, its ends in stretches; each needs the sums of the ``longest`` ends before it only."""
        m, most, n_langs = len(word), self.longest, len(self.langs)
        step = max(most, (1 << 19) // (most * n_langs))
        window, logs = np.zeros((most, n_langs)), np.zeros(n_langs)
        window[-1] = 1.0
        for first in range(0, m, step):
            last = min(m, first + step)
            begin = max(0, first - most + 1)
            codes = self._codes(word[begin:last])
            # share[e, k]: probabilities of the piece that ends after character first + e and is most - k long.
            share = np.zeros((last - first, most, n_langs))
            h = np.zeros(len(codes), np.uint64)
            for size in range(1, min(most, len(codes)) + 1):
                h = (h[: len(codes) - size + 1] + codes[size - 1 :]) * _MULTIPLIER
                at, ids = self._found(h)
                end = at + begin + size - 1 - first
                share[end[end >= 0], most - size] = self.prob[ids[end >= 0]]
                if size == 1:
                    bare = np.ones(last - first, bool)
                    bare[end[end >= 0]] = False
                    share[bare, most - 1] = FLOOR
            alpha = np.concatenate([window, np.zeros((last - first, n_langs))])
            for e in range(last - first):
                np.einsum("ks,ks->s", share[e], alpha[e : e + most], out=alpha[e + most])
                if e % RESCALE == RESCALE - 1:
                    top = alpha[e + 1 : e + most + 1].max(axis=0)
                    alpha[e + 1 : e + most + 1] /= top
                    logs += np.log(top)
            window = alpha[len(alpha) - most :]
        return np.log(window[-1]) + logs

    def log_probs(self, words: list[str]) -> np.ndarray:
        out, by_length = np.zeros((len(words), len(self.langs))), defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w) + 1].append(k)
        for m, at in by_length.items():
            if m > TOGETHER:
                for k in at:
                    out[k] = self._alone(MARK + words[k])
            else:
                out[at] = self._together([MARK + words[k] for k in at], m)
        return out

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """Summed log probability of each text's words, languages as columns."""
        lists = [word_list(t) for t in texts]
        new = [w for w in {w for x in lists for w in x} if w not in self.known]
        if new:
            chars = sum(map(len, new))
            if len(self.known) + len(new) > MEMO or self.chars + chars > MEMO_CHARS:
                self.known.clear()
                new = list({w for x in lists for w in x})
                self.chars, chars = 0, sum(map(len, new))
            self.chars += chars
            at = len(self.known)
            need = at + len(new)
            if need > len(self.rows):
                self.rows = np.vstack([self.rows[:at], np.zeros((max(need, 2 * at) - at, len(self.langs)))])
            for k in range(0, len(new), 20_000):
                self.rows[at + k : at + k + len(new[k : k + 20_000])] = self.log_probs(new[k : k + 20_000])
            self.known.update(zip(new, range(at, need), strict=True))
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((self.known[w] for x in lists for w in x), np.int64, int(sizes.sum()))
        out, some = np.zeros((len(lists), len(self.langs))), np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.rows[flat], np.append(0, np.cumsum(sizes[some]))[:-1], axis=0)
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, model_path: str) -> Segmenter | None:
    """From every row with a language; None if there is none."""
    rows = piece_counts(docs.where(F.col("lang").isNotNull()), model_path).collect()  # pieces x languages at most
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    pieces = vocabulary(model_path)
    counts = np.zeros((len(pieces), len(langs)))
    for r in rows:
        counts[r["piece"], langs.index(r["lang"])] = r["n"]
    return Segmenter(pieces, langs, counts)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def language_id(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that aren't held out."""
    rows = narrowed(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    segmenter = learn(rows.where(~held_out(F.col("doc_id"))), model_path)
    model = docs.sparkSession.sparkContext.broadcast(segmenter)  # a probability for each piece and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            known = [s is not None and bool(_LETTER(t)) for t in texts]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            block: list[int] = []
            size = 0
            for i, t in enumerate([*texts, None]):
                if t is not None and known[i]:
                    block.append(i)
                    size += len(t)
                if block and (t is None or size >= BLOCK):
                    p = s.of_texts([texts[k] for k in block])
                    p = np.exp(p - p.max(axis=1, keepdims=True))
                    for k, best, share in zip(block, p.argmax(axis=1), p.max(axis=1) / p.sum(axis=1), strict=True):
                        langs[k], scores[k] = s.langs[best], share
                    block, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)
