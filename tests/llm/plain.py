"""Plain versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter

import numpy as np

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def license_row(text: str | None, phrases: dict[str, str]) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    found = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pii_row(text: str | None) -> tuple:
    t, spans = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        spans.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, m.end(), "phone"))
    spans.sort()
    n = Counter(s[3] for s in spans)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest()


def quality_row(text: str | None) -> tuple:
    t = text or ""
    words = WHITE.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WHITE.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def shingles(text: str | None) -> frozenset:
    words = WHITE.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def groups(rows: list[tuple[int | None, str | None]]) -> list[int | None]:
    """Smallest id of each row's group."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append(min(ids, default=None) if sets[i] else rows[i][0])
    return out


def best_edits(pattern: bytes, text: bytes) -> int:
    """Fewest edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for k, y in enumerate(text):
            new.append(min(row[k] + (c != y), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row)


# Quality verdicts


def bare(word: str) -> str:
    return word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()


def common_words(rows: list[tuple], n: int, least: int, share: float = 0.2, count: int = 3) -> dict[str, list[str]]:
    """The n words in most documents, in a share of them at least, of each language whose texts have ``least`` characters; rows: (doc_id, text, lang)."""
    size, df, docs = Counter(), {}, Counter()
    for _, t, lang in rows:
        if lang is not None:
            size[lang] += len(t or "")
            docs[lang] += 1
            df.setdefault(lang, Counter()).update({x for w in WHITE.findall(t or "") if (x := bare(w))})
    return {k: [w for w, x in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:n] if x >= max(count, share * docs[k])] for k, c in df.items() if size[k] >= least}


def classes_of(text: str) -> list[int]:
    out = [0] * 7
    for c in text:
        kind = unicodedata.category(c)
        if kind in ("Ll", "Lo", "Lm"):
            k = 0
        elif c in " \t\n\x0b\f\r":
            k = 1
        elif kind in ("Lu", "Lt"):
            k = 2
        elif c in ".,;:!?'\"()-":
            k = 3
        elif kind == "Nd":
            k = 4
        else:
            k = 5 if kind[0] in "SP" else 6
        out[k] += 1
    return out


def js(p: list[int], q: list[int]) -> float:
    p, q = ([x / max(1, sum(h)) for x in h] for h in (p, q))
    kl = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))


def kept(rows: list[tuple], n: int, least: int, settings: dict) -> list[bool]:
    """Whether each row's text passes the quality rules."""
    lists = common_words(rows, n, least)

    def hist(t: str, lang: str) -> list[int]:
        c = Counter(bare(w) for w in WHITE.findall(t))
        return [*[c[w] for w in lists[lang]], sum(c.values()) - sum(c[w] for w in lists[lang])]

    add = lambda hs: [sum(x) for x in zip(*hs, strict=True)]
    refs = {k: (add([classes_of(t or "") for _, t, g in rows if g == k]), add([hist(t or "", k) for _, t, g in rows if g == k])) for k in lists}
    out = []
    for _, t, lang in rows:
        t, words = t or "", len(WHITE.findall(t or ""))
        asked = sorted(refs) if lang is None else [lang] if lang in refs else []
        near = min(((js(classes_of(t), refs[k][0]), js(hist(t, k), refs[k][1]), k) for k in asked), key=lambda x: x[0] + x[1], default=None)
        far = False
        if near:
            most = js([0] * len(lists[near[2]]) + [1], refs[near[2]][1])
            limit = most * min(settings["MOST_SHARE"], settings["LEAST_SHARE"] + settings["CHANCE"] / math.sqrt(max(words, 1)))
            far = (len(t) >= settings["MIN_CHARS"] and near[0] > settings["MAX_CLASS_DISTANCE"]) or (words >= settings["MIN_WORDS"] and near[1] > limit)
        out.append(not quality_row(t)[5] and not far)
    return out


# Toxicity: features by regular expressions, chi-square over sets, gradient descent


def toxic_features(text: str | None) -> tuple[set[str], list[float]]:
    b = (text or "").encode().decode("latin-1")
    words = {lower(w) for w in re.findall("[0-9A-Za-z\x80-\xff]+", b)}
    words |= {"^" + w[:k] for w in words for k in (4, 5) if len(w) > k}
    share = lambda p: len(re.findall(p, b)) / max(1, len(b))
    return words, [math.log1p(len(words)) / 10, share("[A-Z]"), share("[0-9]"), share(r"[!#$%&()*+\-/<=>?@\[\\\]^_`{|}~]")]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.2) -> np.ndarray:
    """Penalised logistic regression by plain gradient descent; the bias comes last and has almost no penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1] - 1, l2), 1e-6)
    w, step = np.zeros(x.shape[1]), 1.0 / (0.25 * np.linalg.norm(x, 2) ** 2 + l2)
    back, seen = w, 1.0
    for _ in range(20_000):  # accelerated steps
        ahead = (1 + np.sqrt(1 + 4 * seen * seen)) / 2
        at = w + (seen - 1) / ahead * (w - back)
        g = x.T @ (1 / (1 + np.exp(-x @ at)) - y) + penalty * at
        back, w, seen = w, at - step * g, ahead
        if np.abs(g).max() < 1e-7:
            break
    return w


def toxicity_scores(docs: list[tuple], labels: list[tuple], max_features: int = 256, folds: int = 5) -> list[list[float]]:
    """Chain probabilities for docs (doc_id, text); labels: (doc_id, low_quality, toxic), sorted by doc_id."""
    texts = dict(docs)
    rows = [(*toxic_features(texts[i]), ys) for i, *ys in labels]
    best: list[str] = []
    for k in (1, 0):
        share = sum(ys[k] for *_, ys in rows) / len(rows)
        chi = {}
        for w in {w for f, *_ in rows for w in f}:
            a, c = sum(w in f for f, *_ in rows), sum(ys[k] for f, _, ys in rows if w in f)
            if a >= 3:
                chi[w] = (c - a * share) ** 2 / (a * max(share * (1 - share), 1e-9))
        best += [w for w in sorted(chi, key=lambda w: (-chi[w], w.encode("latin-1")))[: max_features // 2] if w not in best]
    row = lambda f, dense: [*[float(w in f) for w in best], *dense]
    x, asked = np.array([row(f, d) for f, d, _ in rows]), np.array([row(*toxic_features(t)) for _, t in docs])
    fold, out = np.arange(len(rows)) % folds, []
    p = lambda w, x: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    for k in (0, 1):
        y = np.array([float(ys[k]) for *_, ys in rows])
        of = np.zeros(len(y))
        for f in range(folds):
            of[fold == f] = p(logistic(x[fold != f], y[fold != f]), x[fold == f])
        out.append(p(logistic(x, y), asked))
        x, asked = np.hstack([x, of[:, None]]), np.hstack([asked, out[-1][:, None]])
    return np.array(out).T.tolist()
