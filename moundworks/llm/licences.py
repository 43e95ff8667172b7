"""Licence scans: matching statistics against a generalised suffix automaton.

All licence templates go into one suffix automaton over word ids. A file is streamed
through it word by word, which keeps the longest template passage that ends at each
word. Maximal passages of at least MIN_MATCH words are chained, template by template,
into spans that move forward in both; the share of a template's words that its best
chain covers is the evidence for its licence.

Words are found and keyed in numpy for a whole batch. Only runs of at least MIN_MATCH
words that all occur in templates reach the automaton, as no other words can match.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from moundworks.llm.batches import map_batches, text_steps
from moundworks.llm.words import NOT_ALNUM, Split, key_of, split

# --- fixed values: phrases of the base labels ---------------------------------
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# --- fixed values: wording of common licences and notices ---------------------
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
     documentation files the software to deal in the software without restriction including without limitation the rights
     to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
     whom the software is furnished to do so subject to the following conditions the above copyright notice and this
     permission notice shall be included in all copies or substantial portions of the software the software is provided
     as is without warranty of any kind express or implied including but not limited to the warranties of
     merchantability fitness for a particular purpose and noninfringement"""),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance
     with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
     applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
     without warranties or conditions of any kind either express or implied see the license for the specific language
     governing permissions and limitations under the license"""),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general
     public license as published by the free software foundation either version 3 of the license or at your option any
     later version this program is distributed in the hope that it will be useful but without any warranty without even
     the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for
     more details"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that
     the following conditions are met redistributions of source code must retain the above copyright notice this list of
     conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice
     this list of conditions and the following disclaimer in the documentation and or other materials provided with the
     distribution"""),
    ("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was
     not distributed with this file you can obtain one at http mozilla org mpl 2 0"""),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]
# ------------------------------------------------------------------------------

#: Words of a passage that counts; file words between two passages of a chain; share of a template for its label.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 25, 0.6


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences.

    A state's passages occur where those of the states below it in the link tree end, so
    every occurrence is listed once, in the order of a walk over that tree, and a state
    has a range of the list: memory grows with the words of the sequences only.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self._own: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(sequences):
            state = 0
            for i, word in enumerate(sequence):
                state = self._add(state, word)
                self._own[state].append((t, i + 1))
        below: list[list[int]] = [[] for _ in self.link]
        for s, up in enumerate(self.link):
            if up >= 0:
                below[up].append(s)
        self._places: list[tuple[int, int]] = []
        self._range = [(0, 0)] * len(self.link)
        stack = [(0, -1)]
        while stack:
            s, low = stack.pop()
            if low >= 0:  # all below is listed
                self._range[s] = (low, len(self._places))
                continue
            stack.append((s, len(self._places)))
            self._places += self._own[s]
            stack += [(b, -1) for b in below[s]]

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(sequence, position after the last word) of every occurrence of the state's passages, in order."""
        low, high = self._range[state]
        return sorted(self._places[low:high])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self._own.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the passages that p leads to, which are shorter than q's."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, word: int) -> int:
        """State of the sequence so far with one more word."""
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest passage that ends at each word."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(word)) is not None:
                state, length = to, length + 1
            out.append((state, length))
        return out


@dataclass
class Chain:
    """Passages of one template in one file, moving forward in both."""

    first: int
    last: int
    reached: int
    covered: int = 0


@dataclass
class Scanner:
    """Templates, their automaton, and the word keys it knows."""

    labels: list[str]
    automaton: SuffixAutomaton
    sizes: list[int]
    known: np.ndarray
    ids: np.ndarray
    phrases: list[tuple[list[np.uint64], str]] = field(default_factory=list)

    @classmethod
    def of(cls, templates=TEMPLATES, phrases=PHRASES) -> "Scanner":
        sequences = [text.lower().split() for _, text in templates]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        keys = np.array([key_of(w.encode()) for w in vocabulary], dtype=np.uint64)
        order = np.argsort(keys)
        return cls([x for x, _ in templates], SuffixAutomaton([[vocabulary[w] for w in s] for s in sequences]), [len(s) for s in sequences],
                   keys[order], order, [([key_of(w.encode()) for w in p.split()], label) for p, label in phrases])

    def chains(self, runs: list[tuple[int, list[int]]]) -> list[tuple[int, Chain]]:
        """(template, chain) of a file, from its runs (first word, word ids) of known words."""
        open_: dict[int, Chain] = {}
        done: list[tuple[int, Chain]] = []
        for low, words in runs:
            stats = self.automaton.statistics(words)
            for i, (state, length) in enumerate(stats):
                if length < MIN_MATCH or (i + 1 < len(stats) and stats[i + 1][1] == length + 1):
                    continue  # too short, or the next word makes it longer
                begin, end = low + i + 1 - length, low + i + 1
                for t, place in self.automaton.ends(state):
                    chain = open_.get(t)
                    if chain is None or begin - chain.last > MAX_GAP or place <= chain.reached:
                        if chain is not None and place <= chain.reached and length <= chain.covered and begin - chain.last <= MAX_GAP:
                            continue  # another place of a passage that the chain has gone beyond
                        chain = open_[t] = Chain(begin, end, place - length)
                        done.append((t, chain))
                    chain.covered += place - max(chain.reached, place - length)
                    chain.reached, chain.last = place, end
        return done

    def scan(self, found: Split) -> list[tuple]:
        """Per row: words, base places, first, last, base labels, labels, score, spans."""
        keys = found.keys()
        row = found.rows()
        rows = len(found.first) - 1
        base: list[list[tuple[int, str]]] = [[] for _ in range(rows)]
        for words, label in self.phrases:
            n = len(words)
            at = np.flatnonzero(keys[:max(len(keys) - n + 1, 0)] == words[0])
            for k in range(1, n):
                at = at[(keys[at + k] == words[k]) & (row[at + k] == row[at])]
            for i in at:
                base[row[i]].append((int(i - found.first[row[i]]), label))
        place = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        known = self.known[place] == keys
        ids = self.ids[place]
        edge = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (row[1:] != row[:-1]), [True]])) if len(keys) else np.zeros(1, dtype=int)
        low, high = edge[:-1], edge[1:]
        long_ = known[low] & (high - low >= MIN_MATCH) if len(low) else np.zeros(0, dtype=bool)
        runs: dict[int, list] = {}
        for a, b in zip(low[long_], high[long_]):
            runs.setdefault(int(row[a]), []).append((int(a - found.first[row[a]]), ids[a:b].tolist()))
        out = []
        for r in range(rows):
            chains = self.chains(runs[r]) if r in runs else []
            spans = [(self.labels[t], c.first, c.last, c.covered / self.sizes[t]) for t, c in chains]
            spans = sorted(s for s in spans if s[3] >= MIN_COVER)
            starts, names = [i for i, _ in base[r]], {x for _, x in base[r]}
            out.append((
                int(found.counts[r]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)),
                ",".join(sorted(names | {s[0] for s in spans})),
                max((c.covered / self.sizes[t] for t, c in chains), default=0.0),
                [dict(zip(("label", "first", "last", "cover"), s)) for s in spans],
            ))
        return out


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """Licences named or quoted in every whole text.

    Returns ``key``, n_words, n_base (places of the base phrases), first_word and
    last_word (their smallest and largest start; null without any), base_labels,
    labels (those and the ones of templates covered to MIN_COVER at least), score
    (largest share of a template that one chain covers, 0 to 1) and spans (label, first
    word, word after the last, share) of the covered templates.

    A null or empty text has no words: counts and score 0, empty labels. Every row
    comes back, repeated rows and null keys too; an empty table gives no rows. Very long
    texts are scanned whole; of several places of a passage in a template the first
    that moves a chain on counts. Other columns, whatever they are called, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner.of())  # fixed templates: a few hundred states
    span = pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("cover", pa.float64())])
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
             ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]

    def step(batch: pa.RecordBatch):
        for part in text_steps(batch, text):
            found = shared.value.scan(split(part.column(text), NOT_ALNUM, lower=True))
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(key), *columns], names=[key, *(n for n, _ in kinds)])

    id_type = docs.schema[key].dataType.simpleString()
    out = (f"`{key}` {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
           "score double, spans array<struct<label: string, first: int, last: int, cover: double>>")
    return map_batches(docs.select(key, text), step, out)
