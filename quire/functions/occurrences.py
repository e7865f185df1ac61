"""Where the words of a text stand: one pass over a text, then counts, capitals and written forms without another."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

_WORD = re.compile(r"\w+")
_PLAIN = re.compile(r"\w+(?: \w+)*")


class Keywords:
    """A trie over words: a keyword of words with single blanks between them is a path; others are looked for as they are."""

    def __init__(self, keywords: Iterable[str]) -> None:
        self.names = list(dict.fromkeys(keywords))
        self.trie: dict = {}
        self.odd: list[int] = []
        for i, k in enumerate(self.names):
            if _PLAIN.fullmatch(k):
                node = self.trie
                for w in k.split(" "):
                    node = node.setdefault(w, {})
                node[""] = i  # the end of a keyword; no word is empty
            elif k:
                self.odd.append(i)


class Occurrences:
    """A text's words by lower case, with their places in order."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.low = self.text.lower()
        self.aligned = len(self.low) == len(self.text)
        self.spans: list[tuple[int, int]] = []
        self.at: dict[str, list[int]] = {}
        for i, m in enumerate(_WORD.finditer(self.text)):
            self.spans.append(m.span())
            self.at.setdefault(m[0].lower(), []).append(i)

    def counts(self, keywords: Keywords) -> dict[int, int]:
        """Number of uses of each keyword that occurs, by its place; uses of one keyword don't overlap, different ones may."""
        out: dict[int, int] = {}
        last: dict[int, int] = {}
        for word in self.at.keys() & keywords.trie.keys():
            node = keywords.trie[word]
            if "" in node:
                out[node[""]] = len(self.at[word])
            if len(node) > ("" in node):
                for first in self.at[word]:
                    self._walk(first, node, out, last)
        for i in keywords.odd:
            n = sum(1 for _ in _uses(self.low, keywords.names[i]))
            if n:
                out[i] = n
        return out

    def _walk(self, first: int, node: dict, out: dict[int, int], last: dict[int, int]) -> None:
        at = first
        while at + 1 < len(self.spans):
            (_, end), (start, stop) = self.spans[at], self.spans[at + 1]
            node = node.get(self.text[start:stop].lower()) if start == end + 1 and self.text[end] == " " else None
            if node is None:
                return
            at += 1
            name = node.get("")
            if name is not None and first > last.get(name, -1):
                out[name] = out.get(name, 0) + 1
                last[name] = at

    def uses(self, keyword: str) -> list[tuple[int, int]]:
        """(start, end) of the uses of a lower-case keyword, case aside, none inside a longer word."""
        words = keyword.split(" ")
        if len(words) == 1 and _WORD.fullmatch(keyword):
            return [self.spans[i] for i in self.at.get(keyword, ())]
        if not _PLAIN.fullmatch(keyword):
            low = self.low if self.aligned else "".join(c.lower() if len(c.lower()) == 1 else c for c in self.text)
            return list(_uses(low, keyword))
        out, free = [], 0
        for i in self.at.get(words[0], ()):
            stop = i + len(words)
            if i >= free and stop <= len(self.spans):
                start, end = self.spans[i][0], self.spans[stop - 1][1]
                if self.text[start:end].lower() == keyword:
                    out.append((start, end))
                    free = stop
        return out

    def capitals(self, keyword: str) -> tuple[int, int]:
        """(uses, those that begin with a capital)."""
        found = self.uses(keyword)
        return len(found), sum(self.text[a].isupper() for a, _ in found)

    def begins_sentence(self, start: int) -> bool:
        """Whether only white space stands between ``start`` and a line's or sentence's end; a text begins without any."""
        if not start:
            return True
        before = start
        while before and self.text[before - 1].isspace():
            before -= 1
        return "\n" in self.text[before:start] or (before < start and before > 0 and self.text[before - 1] in ".!?:")

    def surface(self, keyword: str) -> str | None:
        """How the text writes a keyword; None if it doesn't. Uses inside sentences decide: lower case and capitals before mixed
        case, then the most usual, then the first. If all begin sentences, the most usual form in capitals, else the keyword."""
        uses = self.uses(keyword)
        every = Counter(self.text[a:b] for a, b in uses)  # counters keep the order in which forms are first met
        inside = Counter(self.text[a:b] for a, b in uses if not self.begins_sentence(a))
        ranked = [(x != x.lower() and not x.isupper(), -n, i, x) for i, (x, n) in enumerate(inside.items())]
        if ranked:
            return min(ranked)[3]
        capitals = [(-n, i, x) for i, (x, n) in enumerate(every.items()) if x.isupper()]
        return min(capitals)[2] if capitals else keyword if every else None


def _uses(low: str, keyword: str) -> Iterator[tuple[int, int]]:
    at = low.find(keyword)
    while at >= 0:
        end = at + len(keyword)
        free = (at == 0 or not _WORD.match(low[at - 1])) and (end == len(low) or not _WORD.match(low[end]))
        if free:
            yield at, end
        at = low.find(keyword, end if free else at + 1)


def lexicon_terms(text: str | None, keywords: Keywords, domains: list[list[int]], share: float, seen: Occurrences | None = None) -> list[str]:
    """The keywords present, as the text writes them, of domains (places of keywords) that score ``share`` of the best at least."""
    seen = seen or Occurrences(text)
    n = seen.counts(keywords)
    score = [sum(n.get(i, 0) for i in d) for d in domains]
    top = max(score, default=0)
    good = dict.fromkeys(i for d, s in zip(domains, score, strict=True) if top and s >= share * top for i in d)
    forms = [seen.surface(keywords.names[i]) for i in good]
    return sorted((x for x in forms if x is not None), key=str.lower)


def clean_terms(terms: list[str | None] | None, text: str | None, least: int, most_words: int, stop: frozenset[str], seen: Occurrences | None = None) -> list[str]:
    """One display form of each term, case aside; a single word that is no acronym must be used often and with a capital."""
    forms: dict[str, list[str]] = {}
    for x in terms or ():
        name = " ".join((x or "").split())
        if name:
            forms.setdefault(name.lower(), []).append(name)
    shown = []
    for low, written in forms.items():
        words = low.count(" ") + 1
        if words > most_words or low in stop:
            continue
        acronyms = [x for x in written if x.isupper() and 2 <= len(x) <= 5 and " " not in x]
        if words == 1 and not acronyms and text:
            seen = seen or Occurrences(text)
            uses, capital = seen.capitals(low)
            if uses < least or capital < 0.7 * uses:
                continue
        shown.append((acronyms or [x for x in written if not x.isupper()] or [written[0].title()])[0])
    return sorted(shown, key=str.lower)


def merge_terms(first: list[str], second: list[str]) -> list[str]:
    """Both lists, case aside; the first one's form stays. Sorted by lower case."""
    forms: dict[str, str] = {}
    for x in (*first, *second):
        forms.setdefault(x.lower(), x)
    return [x for _, x in sorted(forms.items())]


def top_concepts(text: str | None, terms: list[str] | None, k: int) -> list[str]:
    """The terms used most, ties by lower case."""
    seen = Occurrences((text or "").lower())
    n = [(-len(seen.uses(x.lower())), x.lower(), i, x) for i, x in enumerate(terms or ())]
    return [x for c, _, _, x in sorted(n)[:k] if c]
