"""License scans: patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.llm.common import schema_with_id, slices
from corpusql.llm.licensetexts import NAMES, TEMPLATES

MIN_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")
# Templates of so few words count the words that stand between as well.
SHORT = 12
# Words whose places are voted on at once.
STRETCH = 8192

def rising(places: list[int]) -> list[int]:
    """Numbers of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(places)
    for number, place in enumerate(places):
        pile = bisect_left(tops, place)
        if pile == len(tops):
            tops.append(place)
            top_at.append(number)
        else:
            tops[pile], top_at[pile] = place, number
        if pile:
            back[number] = top_at[pile - 1]
    out = []
    at = top_at[-1] if top_at else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """(text place, template place) of matched words, rising in both.

    Equal words at both ends of a gap match at once. Words that occur once in the text's and once in the
    template's part of the gap are anchors; a longest increasing subsequence of them stays, and the gaps
    between go the same way. A gap without anchors ends.
    """
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        where = {word: i for i, word in enumerate(text[a:b], a) if ours[word] == 1}
        anchors = [(where[word], j) for j, word in enumerate(template[c:d], c) if theirs[word] == 1 and word in where]
        if not anchors:
            continue
        kept = [anchors[k] for k in rising([i for i, _ in anchors])]
        found += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if k > i + 1 and m > j + 1]
    return sorted(found)


def telling(template: list[str]) -> frozenset[int]:
    """Places of a template's words that name its license: names, and the numbers of a version behind them or behind "version"."""
    places: set[int] = set()
    for i, word in enumerate(template):
        # "by" is a name only where it follows "cc".
        name = word in NAMES and (word != "by" or template[i - 1 : i] == ["cc"])
        number = word.isdigit() and i > 0 and (i - 1 in places or template[i - 1] in ("version", "v"))
        if name or number:
            places.add(i)
    return frozenset(places)


class Scanner:
    """Finds templates in texts. ``minimum`` is the least share of a template's words that must match in order."""

    def __init__(self, templates: Mapping[str, str], minimum: float) -> None:
        self.minimum = minimum
        self.templates = {name: WORD.findall(text.lower()) for name, text in templates.items()}
        self.telling = {name: telling(words) for name, words in self.templates.items()}
        signs = set()
        self.where: dict[str, dict[str, list[int]]] = {}
        self.least: dict[str, int] = {}
        for name, words in self.templates.items():
            self.where[name] = {w: [i for i, x in enumerate(words) if x == w] for w in set(words)}
            # Each word of the template that is missed takes at most one different word with it.
            missed = len(words) - self._need(len(words))
            self.least[name] = len(self.where[name]) - missed
            # Words that stand at more places than may stay unmatched: one of them is in every hit.
            places = 0
            for word in sorted(self.where[name], key=lambda w: (-len(w), w)):
                if places > missed:
                    break
                signs.add(word)
                places += len(self.where[name][word])
        self.sign = re.compile("|".join(sorted(map(re.escape, signs), key=len, reverse=True)))

    def _need(self, size: int) -> int:
        """The least number of matched words, without an error of the product's last digit."""
        return -int(-(self.minimum * size - 1e-9) // 1)

    def _starts(self, words: list[str], name: str) -> list[int]:
        """Places where a copy of the template may start, best first: enough of its words agree on one, give or take a few.

        A start gets votes from the words of one template's length behind it, so a long text is voted on in stretches.
        """
        where, size = self.where[name], len(self.templates[name])
        slack, need = max(2, size // 4), self._need(size)
        good: list[tuple[int, int]] = []
        for base in range(-size, len(words), STRETCH):
            low, stop = base - slack, base + STRETCH + slack
            begin = max(0, low)
            places = [at - p for at, w in enumerate(words[begin : stop + size], begin) if w in where for p in where[w]]
            # Starts from low up to stop have all their votes here; those of the stretch itself see all neighbours, too.
            offsets = np.array(places, dtype=np.int64) - low
            votes = np.bincount(offsets[(offsets >= 0) & (offsets < stop - low)], minlength=stop - low)
            sums = np.concatenate([[0], np.cumsum(votes)])
            at = slack + np.flatnonzero(votes[slack : slack + STRETCH])
            reach = sums[np.minimum(at + slack + 1, stop - low)] - sums[at - slack]
            good += [(-int(votes[i]), int(i) + low) for i in at[reach >= need]]
        return [start for _, start in sorted(good)]

    def accepts(self, words: list[str], pairs: list[tuple[int, int]], name: str) -> bool:
        """Whether matched words make a copy: enough of them, all names, no other name between neighbours, little else in short ones."""
        size = len(self.templates[name])
        if len(pairs) < self._need(size) or not self.telling[name] <= {j for _, j in pairs}:
            return False
        if size <= SHORT and len(pairs) < self._need(pairs[-1][0] - pairs[0][0] + 1):
            return False
        return not any(
            NAMES.intersection(words[i + 1 : k]) for (i, j), (k, m) in zip(pairs, pairs[1:]) if m == j + 1 and k > i + 1
        )

    def candidates(self, words: list[str], name: str, starts: list[int]) -> list[tuple[str, int, int, int]]:
        """(template, first word, word behind the last, words matched), non-overlapping, for starts in order of preference."""
        template = self.templates[name]
        slack = max(2, len(template) // 4)
        taken: list[tuple[int, int]] = []
        found = []
        for start in starts:
            low, high = max(0, start - slack), min(len(words), start + len(template) + slack)
            if any(low < b and a < high and min(b, high) - max(a, low) > slack * 2 for a, b in taken):
                continue
            pairs = [(low + i, j) for i, j in align(words[low:high], template)]
            if not pairs or not self.accepts(words, pairs, name):
                continue
            first, last = pairs[0][0], pairs[-1][0]
            if any(first < b and a <= last for a, b in taken):
                continue
            taken.append((first, last + 1))
            found.append((name, first, last + 1, len(pairs)))
        return found

    def best(self, found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
        """Of copies that share words the one with most matched less missed words, then the smallest name and place."""
        free: list[tuple[int, int]] = []
        kept = []
        for hit in sorted(found, key=lambda h: (len(self.templates[h[0]]) - 2 * h[3], h[0], h[1])):
            at = bisect_left(free, (hit[1],))
            if (at and free[at - 1][1] > hit[1]) or (at < len(free) and free[at][0] < hit[2]):
                continue
            free.insert(at, (hit[1], hit[2]))
            kept.append(hit)
        return kept

    def __call__(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(template, first character, character behind the last, words matched, coverage), no two of them overlapping."""
        lower = text.lower()
        if not self.sign.search(lower):
            return []
        spans = [m.span() for m in WORD.finditer(lower)]
        words = [lower[a:b] for a, b in spans]
        held = set(words)
        found = []
        for name, where in self.where.items():
            if sum(w in held for w in where) >= self.least[name]:
                found += self.candidates(words, name, self._starts(words, name))
        kept = self.best(found)
        return sorted(((n, spans[a][0], spans[b - 1][1], m, m / len(self.templates[n])) for n, a, b, m in kept), key=lambda r: (r[1], r[0]))


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] | None = None,
    min_coverage: float = MIN_COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, license, start, stop, matched_words, coverage): every copy of a template in every whole text.

    One pass without a shuffle. Words are letters and digits, in lower case. A
    copy may miss up to ``1 - min_coverage`` of the template's words and hold others in between, up to a quarter of its length.
    Words that name a license and version numbers may not be missed, and no other name may be put in between; in templates of
    up to ``SHORT`` words, words in between count like missed ones. Of copies that overlap the one with most matched less missed words stays.
    Places count in the text in lower case where lowering changes its length.
    Texts without any telling word of a template are left out at once. Null and empty texts give no row; repeated rows
    give repeated rows.
    """
    kinds = [("license", T.StringType()), ("start", T.LongType()), ("stop", T.LongType()), ("matched_words", T.LongType()), ("coverage", T.DoubleType())]
    schema = schema_with_id(docs, id_col, kinds)
    chosen = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, min_coverage)
        for batch in (part for whole in batches for part in slices(whole)):
            number, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = scanner(text) if text else []
                number += [i] * len(hits)
                rows += hits
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number, pa.int64())), *arrays], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
