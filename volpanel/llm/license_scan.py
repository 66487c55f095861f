"""License scan by patience alignment.

A template is aligned with a text on the words that are unique in both: the longest increasing run of these
anchors is kept, and the gaps between neighbours are aligned in the same way; a gap without such words takes the
longest run of words that both share. The share of a template's words that find a partner is its coverage. Anchors
that lie further apart in the text than the template allows start a new place, so stray words elsewhere in a
long text don't stretch a notice; a text is searched again on both sides of every notice found.
Where the best places fail, a text is cut to the stretches that hold enough of the template's words for a notice,
and if that leaves it whole, every place and every common run that could lie in a notice is tried, longest first.

Templates are few and travel with the tasks; every text is scanned whole and alone, without a shuffle. A template is
only aligned with a text that holds enough of its words to reach the coverage at all.

Defined cases: null, empty or wordless text has no notice; words are runs of a-z and 0-9 after lower-casing;
notices that overlap give way to the one that covers more words, ties to the name that sorts first; repeated rows are
scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[a-z0-9]+")
Match = tuple[int, int]


def longest_rising(values: Sequence[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    previous = [-1] * len(values)
    for i, value in enumerate(values):
        at = bisect_left(tails, value)
        previous[i] = ends[at - 1] if at else -1
        tails[at : at + 1] = [value]
        ends[at : at + 1] = [i]
    found, i = [], ends[-1] if ends else -1
    while i >= 0:
        found.append(i)
        i = previous[i]
    return found[::-1]


def unique_anchors(a: Sequence[str], b: Sequence[str], box: tuple[int, int, int, int]) -> list[Match]:
    """Longest increasing run of pairs of words that are unique in both parts."""
    a0, a1, b0, b1 = box
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    where = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
    pairs = [(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in where]
    return [pairs[k] for k in longest_rising([j for _, j in pairs])]


def longest_run(a: Sequence[str], b: Sequence[str], box: tuple[int, int, int, int]) -> list[Match]:
    """Longest run of equal words, the earliest in the text if several are as long."""
    a0, a1, b0, b1 = box
    where: dict[str, list[int]] = {}
    for i in range(a0, a1):
        where.setdefault(a[i], []).append(i)
    lengths: dict[int, int] = {}
    best, end_a, end_b = 0, 0, 0
    for j in range(b0, b1):
        grown = {}
        for i in where.get(b[j], ()):
            grown[i] = n = lengths.get(i - 1, 0) + 1
            if n > best:
                best, end_a, end_b = n, i, j
        lengths = grown
    return [(end_a - k, end_b - k) for k in range(best - 1, -1, -1)]


def common_runs(a: Sequence[str], b: Sequence[str], box: tuple[int, int, int, int]) -> Iterator[tuple[int, int, int]]:
    """All (length, start in ``a``, start in ``b``) of runs of equal words that can't be made longer."""
    a0, a1, b0, b1 = box
    where: dict[str, list[int]] = {}
    for i in range(a0, a1):
        where.setdefault(a[i], []).append(i)
    lengths: dict[int, int] = {}
    for j in range(b0, b1 + 1):
        grown = {i: lengths.get(i - 1, 0) + 1 for i in where.get(b[j], ())} if j < b1 else {}
        for i, n in lengths.items():
            if i + 1 not in grown:
                yield n, i - n + 1, j - n
        lengths = grown


def fill_gap(a: Sequence[str], b: Sequence[str], box: tuple[int, int, int, int]) -> list[Match]:
    """Patience alignment of two parts, recursively."""
    found: list[Match] = []
    boxes = [box]
    while boxes:
        a0, a1, b0, b1 = boxes.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        anchors = unique_anchors(a, b, (a0, a1, b0, b1)) or longest_run(a, b, (a0, a1, b0, b1))
        found += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            boxes += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(found)


class Template:
    """A template's words and the limits for a notice of it."""

    def __init__(self, name: str, text: str, min_coverage: float, short: int):
        self.name, self.words = name, WORDS.findall(text.lower())
        n = len(self.words)
        # Short lines differ in a word or two only, so all of their words are asked for.
        self.need = n if n < short else int(-(-min_coverage * n // 1))
        self.counts = Counter(self.words)

    def slack(self, gap: int) -> int:
        """Words that may stand in a text between words that are ``gap`` apart in the template."""
        return 2 * gap + 8

    def clusters(self, places: Sequence[int], anchors: list[Match]) -> list[list[Match]]:
        """The places along ``anchors``, most anchors first; ``places`` are the words' positions in the text."""
        found: list[list[Match]] = []
        for i, j in anchors:
            if found and places[j] - places[found[-1][-1][1]] <= self.slack(i - found[-1][-1][0]):
                found[-1].append((i, j))
            else:
                found.append([(i, j)])
        return sorted(found, key=len, reverse=True)

    def align(self, words: Sequence[str], places: Sequence[int], low: int, high: int, best: list[Match]) -> list[Match]:
        """The place ``best`` with its gaps filled; nothing if its words can't reach the coverage."""
        (i, j), (k, m) = best[0], best[-1]
        left = max(low, bisect_left(places, places[j] - self.slack(i)))
        right = min(high, bisect_left(places, places[m] + self.slack(len(self.words) - k)))
        edges = [(-1, left - 1), *best, (len(self.words), right)]
        parts = ((0, i, left, j), (i, k + 1, j, m + 1), (k + 1, len(self.words), m + 1, right))
        if sum((Counter(self.words[p:r]) & Counter(words[q:s])).total() for p, r, q, s in parts) < self.need:
            return []
        matched = list(best)
        for (p, q), (r, s) in zip(edges, edges[1:]):
            matched += fill_gap(self.words, words, (p + 1, r, q + 1, s))
        return sorted(matched)

    def core(self, matched: list[Match], places: Sequence[int]) -> list[Match]:
        """``matched`` without ends that cost more text between words than they match, as words of a neighbouring notice do."""
        best, top, start, score = matched, 0, 0, 0
        for at, (i, j) in enumerate(matched):
            if at:
                p, q = matched[at - 1]
                score -= max(0, places[j] - places[q] - (i - p))
            if score < 0:
                start, score = at, 0
            score += 1
            if score > top:
                best, top = matched[start : at + 1], score
        return best if len(best) >= self.need else matched

    def stretches(self, words: Sequence[str], places: Sequence[int], low: int, high: int, density: float) -> list[tuple[int, int]]:
        """Parts of a range outside of which no notice can lie, by a window as long as a notice can be."""
        wide, left, held = int(len(self.words) / density), low, 0
        seen: Counter[str] = Counter()
        found: list[tuple[int, int]] = []
        for j in range(low, high):
            seen[words[j]] += 1
            held += seen[words[j]] <= self.counts[words[j]]
            while places[j] - places[left] >= wide:
                held -= seen[words[left]] <= self.counts[words[left]]
                seen[words[left]] -= 1
                left += 1
            if held >= self.need:
                if found and left <= found[-1][1]:
                    found[-1] = (found[-1][0], j + 1)
                else:
                    found.append((left, j + 1))
        return found

    def candidates(self, words: Sequence[str], places: Sequence[int], low: int, high: int, density: float) -> Iterator[list[Match]]:
        """Every place in a range that a notice could be aligned from, longest first."""
        box = (0, len(self.words), low, high)
        yield from self.clusters(places, unique_anchors(self.words, words, box))
        # A notice of ``need`` words is broken by words left out of it and by words put into it, at most so often.
        breaks = len(self.words) - self.need + int(self.need / density) - self.need
        least = -(-self.need // (breaks + 1))
        runs = [run for run in common_runs(self.words, words, box) if run[0] >= least]
        for n, i, j in sorted(runs, key=lambda run: (-run[0], run[2], run[1])):
            yield from self.clusters(places, [(i + d, j + d) for d in range(n)])

    def notices(self, words: Sequence[str], places: Sequence[int], density: float) -> list[tuple[int, int, int]]:
        """All (start, end, matched words) in a text, of which ``words`` are those that the templates know."""

        def first(tried: Iterable[list[Match]]) -> list[Match]:
            for best in tried:
                matched = self.core(self.align(words, places, low, high, best), places)
                if len(matched) >= self.need and len(matched) >= density * (places[matched[-1][1]] + 1 - places[matched[0][1]]):
                    return matched
            return []

        found, parts = [], [(0, len(words))]
        while parts:
            low, high = parts.pop()
            if high - low < self.need:
                continue
            box = (0, len(self.words), low, high)
            matched = first(
                best for find in (unique_anchors, longest_run) for best in self.clusters(places, find(self.words, words, box))[:1]
            )
            if not matched:
                cut = self.stretches(words, places, low, high, density)
                if cut != [(low, high)]:
                    parts += cut
                    continue
                matched = first(self.candidates(words, places, low, high, density))
            if matched:
                found.append((places[matched[0][1]], places[matched[-1][1]] + 1, len(matched)))
                parts += [(low, matched[0][1]), (matched[-1][1] + 1, high)]
        return found


def scan_text(text: str | None, templates: Sequence[Template], density: float = 0.75) -> list[tuple[int, int, str, float]]:
    """Notices in a text: (first word, word after the last, template, coverage), in text order, without overlaps."""
    words = WORDS.findall((text or "").lower())
    present = set(words)
    found = []
    for template in templates:
        held = sum(n for word, n in template.counts.items() if word in present)
        if held >= template.need:
            known = template.counts
            places = [i for i, word in enumerate(words) if word in known]
            some = [words[i] for i in places]
            found += [(matched, template.name, start, end, len(template.words)) for start, end, matched in template.notices(some, places, density)]
    kept: list[tuple[int, int, str, float]] = []
    for matched, name, start, end, n in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if all(end <= s or start >= e for s, e, _, _ in kept):
            kept.append((start, end, name, matched / n))
    return sorted(kept)


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str],
    doc_id: str = "doc_id",
    text: str = "text",
    min_coverage: float = 0.8,
    short: int = 20,
) -> DataFrame:
    """Per row: doc_id, and the arrays licenses, starts, ends (in words) and coverages of its notices."""
    ready = [Template(name, body, min_coverage, short) for name, body in sorted(templates.items())]

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scan_text(value, ready) for value in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "licenses": [[x[2] for x in row] for row in found],
                    "starts": [[x[0] for x in row] for row in found],
                    "ends": [[x[1] for x in row] for row in found],
                    "coverages": [[x[3] for x in row] for row in found],
                }
            )

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInPandas(
        scanned, f"doc_id {kind}, licenses array<string>, starts array<bigint>, ends array<bigint>, coverages array<double>"
    )
