"""Licence scans: licence phrases, and licence templates compiled to token automata.

A template is plain wording with markup: ``<<beginOptional>> .. <<endOptional>>``
around wording that may be missing, and ``<<var;original="..";match="..">>`` for
wording that may be replaced: by the original or one of ``match``'s ``|`` alternatives,
or, where match is ``.+``, by any words, one or more. ``compiled`` turns one into a
nondeterministic automaton over words: a text is accepted where the mandatory words
follow each other exactly. Free wording of any length ends at the nearest place where
the rest of the template follows; trailing optional wording is taken where it stands.
Matches of one template don't overlap.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, so
case, spacing and ASCII punctuation never matter. Null and empty texts have no words
and no labels; repeated rows and doc_ids give a row each; columns besides doc_id and
text are ignored. Rows are scanned where they lie: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import narrowed, text_bytes

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices and licence wordings, as published.
TEMPLATES = {
    "apache-2.0": 'Licensed under the Apache License, Version 2.0<<beginOptional>> (the "License"); you may not use this file except in compliance with the License<<endOptional>>',
    "gpl-2.0": '<<var;original="redistribute it and/or modify it";match="redistribute it and/or modify it|licensed|released|distributed">> under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License<<beginOptional>> as published by the Free Software Foundation;<<endOptional>><<beginOptional>> either<<endOptional>> version 2',
    "gpl-3.0": '<<var;original="redistribute it and/or modify it";match="redistribute it and/or modify it|licensed|released|distributed">> under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License<<beginOptional>> as published by the Free Software Foundation;<<endOptional>><<beginOptional>> either<<endOptional>> version 3',
    "cc-by-4.0": "Licensed under <<beginOptional>>a <<endOptional>><<var;original=\"CC BY\";match=\"CC BY|Creative Commons Attribution\">> 4.0",
    "cc-by-nc-4.0": "Licensed under <<beginOptional>>a <<endOptional>><<var;original=\"CC BY-NC\";match=\"CC BY-NC|Creative Commons Attribution-NonCommercial\">> 4.0",
    "cc-by-sa-4.0": "Licensed under <<beginOptional>>a <<endOptional>><<var;original=\"CC BY-SA\";match=\"CC BY-SA|Creative Commons Attribution-ShareAlike\">> 4.0",
    "mit": '<<var;original="Released";match="Released|Licensed|Distributed">> under the <<beginOptional>>terms of the <<endOptional>>MIT License',
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;original="this software and associated documentation files (the Software)";match=".+">>, to deal
        in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all
        copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """
        Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;original="THE AUTHOR";match=".+">> DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;original="THE AUTHOR";match=".+">> BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
        OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd": """
        Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer.
        <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        <<beginOptional>><<beginOptional>>3. <<endOptional>>Neither the name of <<var;original="the copyright holder";match=".+">> nor the names of <<beginOptional>>its <<endOptional>>
        contributors may be used to endorse or promote products derived from
        this software without specific prior written permission. <<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS"
        AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL <<var;original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
        OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO_WORDS = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if c in _KEPT else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


@dataclass
class Automaton:
    """States are numbers. steps: word to next states; free: the state that any word leads to; skips: moves without a word."""

    steps: list[dict[bytes, list[int]]] = field(default_factory=list)
    free: dict[int, int] = field(default_factory=dict)
    skips: list[list[int]] = field(default_factory=list)
    final: int = 0

    def state(self) -> int:
        self.steps.append({})
        self.skips.append([])
        return len(self.steps) - 1

    def chain(self, at: int, words: list[bytes]) -> int:
        for w in words:
            to = self.state()
            self.steps[at].setdefault(w, []).append(to)
            at = to
        return at

    def any_words(self, at: int) -> int:
        """One or more words of any kind: a state that loops."""
        loop = self.state()
        self.free[at] = self.free[loop] = loop
        return loop

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for y in self.skips[todo.pop()]:
                if y not in states:
                    states.add(y)
                    todo.append(y)
        return states

    def first_words(self) -> set[bytes]:
        return {w for s in self.closed({0}) for w in self.steps[s]}

    def begins_free(self) -> bool:
        """Whether any word may be its first."""
        return any(s in self.free for s in self.closed({0}))

    def accepted(self, words: list[bytes], at: int, dead: dict[int, int] | None = None) -> int:
        """The end of the accepted run of words that begins at word ``at``; -1 without one.

        dead holds looping states with the first word from which an earlier run read on in
        vain to the end; from there on what they lead to is the same for every run, so it
        isn't tried again. A run that is in such a state before that word goes on.
        """
        dead = {} if dead is None else dead
        stepped, looping, entered, end = {0}, set(), {}, -1
        while True:
            states = self.closed(stepped | looping)
            if self.final in states:
                end, looping = at, set()  # the nearest end of free wording counts
                states = self.closed(set(stepped))
            if not states or at >= len(words):
                if end < 0 and at >= len(words):
                    for s in looping:
                        dead[s] = min(entered[s], dead.get(s, at))
                return end
            w = words[at]
            stepped = {y for s in states for y in self.steps[s].get(w, ())}
            looping = {y for s in states if (y := self.free.get(s)) is not None and at < dead.get(y, at + 1)}
            for s in looping:
                entered.setdefault(s, at)
            at += 1


_MARK = re.compile(r'<<(beginOptional|endOptional|var;original="([^"]*)";match="([^"]*)")>>')
_PATTERN_SIGN = re.compile(r"[\\.^$*+?()\[\]{}]")


def compiled(template: str) -> Automaton:
    a = Automaton()
    at, opened, done = a.state(), [], 0
    for m in [*_MARK.finditer(template), None]:
        wording = template[done : m.start() if m else len(template)]
        if "<<" in wording or ">>" in wording:
            raise ValueError(f"unknown markup in {wording!r}")
        at = a.chain(at, words_of(wording.encode()))
        if m is None:
            break
        done = m.end()
        if m[1] == "beginOptional":
            opened.append(at)
            to = a.state()
            a.skips[at].append(to)
            at = to
        elif m[1] == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            to = a.state()
            a.skips[at].append(to)
            a.skips[opened.pop()].append(to)
            at = to
        else:
            to = a.state()
            if m[3] == ".+":
                a.skips[a.any_words(at)].append(to)
            elif _PATTERN_SIGN.search(m[3]):
                raise ValueError(f"match is neither .+ nor a list of wordings: {m[3]!r}")
            else:
                for choice in sorted({m[2], *m[3].split("|")}):
                    a.skips[a.chain(at, words_of(choice.encode()))].append(to)
            at = to
    if opened:
        raise ValueError("beginOptional without endOptional")
    a.final = at
    return a


class Scanner:
    """Finds phrases and templates in the words of one text."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases.items()]
        self.templates = [(label, compiled(t)) for label, t in templates.items()]
        # A template is tried where a word stands that may be its first, found by one search over the joined words; one that may begin with any word, at each.
        self.anywhere = [k for k, (_, a) in enumerate(self.templates) if a.begins_free()]
        starts: dict[bytes, list[int]] = {}
        for k, (_, a) in enumerate(self.templates):
            for w in a.first_words() if k not in self.anywhere else ():
                starts.setdefault(w, []).append(k)
        self.starts = starts
        self.start = re.compile(b" (" + b"|".join(sorted(map(re.escape, starts), reverse=True)) + b")(?= )") if starts else None

    def __call__(self, text: bytes) -> tuple:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        places, base, labels, full = [], set(), set(), 0
        for p, label in self.phrases:
            at = joined.find(p)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = joined.find(p, at + 1)
        matched, first, counted = [], 0, 0
        ends, dead = [0] * len(self.templates), [{} for _ in self.templates]

        def tried(k: int, first: int) -> int:
            label, a = self.templates[k]
            if first < ends[k] or (end := a.accepted(words, first, dead[k])) < 0:
                return 0
            ends[k] = end
            labels.add(label)
            matched.append((first, end))
            return end - first

        for m in self.start.finditer(joined) if self.start else ():
            first += joined.count(b" ", counted, m.start())
            counted = m.start()
            full += sum(tried(k, first) for k in self.starts[m[1]])
        for k in self.anywhere:
            full += sum(tried(k, first) for first in range(len(words)))
        number = lambda at: joined.count(b" ", 0, at)
        return (
            len(words), len(places), number(min(places)) if places else None, number(max(places)) if places else None,
            ",".join(sorted(base)), ",".join(sorted(base | labels)),
            1.0 if matched else 0.5 if base else 0.0, len(matched), ",".join(f"{s}:{e}" for s, e in sorted(set(matched))),
        )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long, template_spans string"


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row per document: counts and word positions of phrases, labels of phrases and matched templates, score.

    score: 1 where a template's mandatory wording matches, 0.5 where only phrases
    stand, else 0. template_spans: first and end word of each match. A null text has
    no words; first_word and last_word are null without a phrase. Very long texts are
    read whole, repeated rows get a row each, other columns are ignored, and an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(phrases, templates)
        for b in batches:
            found = list(zip(*map(scan, text_bytes(b.column("text"))), strict=True)) or [()] * 9
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, k) for x, k in zip(found, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return narrowed(docs.withColumn("doc_id", docs["doc_id"].cast("long")), "doc_id", "text").mapInArrow(run, SCHEMA)
