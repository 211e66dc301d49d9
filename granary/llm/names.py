"""Matching a freely typed name with a bounded list of canonical names and aliases.

An Aho-Corasick automaton over the normalised names finds embedded mentions, of which the longest non-overlapping
ones count; a text without a mention is compared by edits with the joined words of each name, then, against names of
several own words, by token-set similarity: tokens match within the allowed edits, in any order, over the union of
tokens. Words that many names share ('foods', 'mills') decide nothing by themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable

import ahocorasick

# Letters of other scripts that look like Latin ones, digits that stand for letters, signs without meaning.
_LOOKALIKE = str.maketrans("аеорсухіԁкмтвнӏѕјαοεινυκρτ", "aeopcyxidkmtbhlsjaoeivukpt")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_SIGNS = re.compile("[\u2122\u00ae\u00a9\u2120\u200b-\u200f\u2060\ufeff\u00ad]")
_GAP = re.compile(r"[^0-9a-z]+")
# Words around a name that aren't part of it.
_AROUND = frozenset("the visit store shop official by brand from private limited pvt ltd llp llc inc co company corp gmbh india online and".split())


def folded(text: str | None) -> str:
    """Lower case, without accents, look-alike letters and signs; runs of anything but letters and digits are one space."""
    if not text:
        return ""
    plain = text.lower()
    if not plain.isascii():
        plain = unicodedata.normalize("NFKD", _SIGNS.sub("", text).lower().translate(_LOOKALIKE))
        plain = "".join(c for c in plain if not unicodedata.combining(c)).translate(_LOOKALIKE)
    return _GAP.sub(" ", plain.replace("'", "").replace("’", "")).strip()


_DIGIT, _MIXED = re.compile(r"\d"), re.compile(r"[a-z]")


def unleeted(text: str) -> str:
    """Digits within words of letters as the letters they stand for; a digit that ends a word stays."""
    if not _DIGIT.search(text):
        return text
    return " ".join(_letters(w) if _DIGIT.search(w) and _MIXED.search(w) else w for w in text.split())


def _letters(word: str) -> str:
    stem, last = word[:-1].translate(_LEET), word[-1]
    return stem + (last if last.isdigit() and word[:-1].isalpha() else last.translate(_LEET))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; ``most`` + 1 if it is more than ``most``."""
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1  # one edit changes at most two letters of the set
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row[j] = cost
        if min(row) > most:
            return most + 1
        older, last = last, row
    return min(last[-1], most + 1)


def allowed_edits(length: int) -> int:
    return 2 if length >= 7 else 1 if length >= 5 else 0


def entry_of(name: str) -> str:
    """A name as it is compared: folded, with letters for digits."""
    return unleeted(folded(name))


def common_words(entries: Iterable[str]) -> set[str]:
    """Words that follow the first in names of three different first words, but for those that one name alone begins with."""
    by_head: dict[str, str] = {e.split()[0]: e for e in sorted(set(entries)) if e}
    shared = Counter(w for e in by_head.values() for w in set(e.split()[1:]))
    return {w for w, n in shared.items() if n >= 3}


def forms_of(entry: str, common: set[str]) -> list[tuple[str, bool]]:
    """The forms under which a name is found, and whether each is the name itself; the others count if no other name has them."""
    words = entry.split()
    own = [w for w in words if w not in common]
    found = [(entry, True)]
    if own and own != words:
        found.append((" ".join(own), False))
    if len(words) > 1 and len(words[0]) >= 5 and words[0] not in common:
        found.append((words[0], False))
    return found


class NameMatcher:
    """Finds the key that a typed name means, among (form, key) pairs and the names of several own words.

    ``of`` makes one from (key, name) pairs, several names per key allowed. ``match`` gives the key meant, or None;
    ``best`` gives it with its rank, so that matchers of several parts of a list can be compared.
    """

    @classmethod
    def of(cls, names: Iterable[tuple[str, str]], memo: int = 200_000) -> NameMatcher:
        entries = sorted({(entry_of(name), key) for key, name in names if folded(name)})
        common = common_words(e for e, _ in entries)
        owners: dict[str, set[str]] = defaultdict(set)
        whole = {e for e, _ in entries}
        for entry, key in entries:
            for form, _ in forms_of(entry, common):
                owners[form].add(key)
        forms = [(form, min(keys)) for form, keys in owners.items() if len(keys) == 1 or form in whole]
        return cls(forms, entries, common, memo)

    def __init__(self, forms: Iterable[tuple[str, str]], entries: Iterable[tuple[str, str]], common: set[str], memo: int = 200_000):
        self.common = common
        self.forms = dict(sorted(forms))
        self.machine = ahocorasick.Automaton()
        for form, key in self.forms.items():
            self.machine.add_word(f" {form} ", (form, key))
        if self.forms:
            self.machine.make_automaton()
        self.squeezed: dict[str, str] = {}
        for form, key in sorted(self.forms.items()):
            self.squeezed.setdefault(form.replace(" ", ""), key)
        self.grams: dict[str, list[str]] = defaultdict(list)
        for form in self.squeezed:
            for gram in self._grams(form):
                self.grams[gram].append(form)
        self.sets = sorted({(tuple(own), key) for e, key in entries if len(own := [w for w in e.split() if w not in self.common]) > 1})
        self.tokens: dict[str, list[int]] = defaultdict(list)
        for i, (own, _) in enumerate(self.sets):
            for w in sorted(set(own)):
                self.tokens[w].append(i)
        self.token_grams: dict[str, list[str]] = defaultdict(list)
        for token in self.tokens:
            for gram in self._grams(token):
                self.token_grams[gram].append(token)
        self.memo: dict[str, str | None] = {}
        self.most = memo

    @staticmethod
    def _grams(form: str) -> set[str]:
        padded = f"^{form}$"
        return {padded[i : i + 2] for i in range(len(padded) - 1)}

    def match(self, text: str | None) -> str | None:
        if text is None:
            return None
        if text not in self.memo:
            if len(self.memo) >= self.most:
                self.memo.clear()
            ranks = self.best(text)
            self.memo[text] = None if not ranks or any(r[:4] == ranks[0][:4] and r[4] != ranks[0][4] for r in ranks[1:]) else ranks[0][4]
        return self.memo[text]

    def best(self, text: str) -> list[tuple[int, float, float, str, str]]:
        """The best (stage, far, spoiled, form, key) of a text; several only for token sets that do equally well."""
        plain = folded(text)
        for stage, form in enumerate(dict.fromkeys((plain, unleeted(plain)))):
            if self.forms and (found := self.mentions(form)):
                start, end, key = max(found, key=lambda m: (m[1] - m[0], -m[0]))
                return [(stage, float(start - end), float(start), "", key)]
        words = [w for w in unleeted(plain).split() if w not in _AROUND]
        own = [w for w in words if w not in self.common and not (len(w) >= 5 and self._near_common(w))]
        whole = ("".join(words), "".join(own))
        best: tuple[int, float, float, str, str] | None = None
        for attempt in dict.fromkeys((*whole, *(w for w in own if len(w) >= 5))):
            for form in self._candidates(attempt):
                # one word of several may be half of a name that was cut in two
                most = min(allowed_edits(max(len(form), len(attempt))), 2 if attempt in whole else 1)
                far = edits(attempt, form, most)
                if far <= most:
                    rank = (2, float(far), float(-len(form)), form, self.squeezed[form])
                    best = rank if best is None else min(best, rank)
        return [best] if best else self._by_tokens(own)

    def _by_tokens(self, own: list[str]) -> list[tuple[int, float, float, str, str]]:
        """The names of several own words that most of the typed words and their own are shared with, in any order: the best, and those as good."""
        if len(own) < 2 or not self.sets:
            return []
        near: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
        for at, word in enumerate(own):
            most = allowed_edits(len(word) + 2)
            grams = self._grams(word)
            shared = Counter(t for g in grams for t in self.token_grams.get(g, ()))
            need = len(grams) - 3 * most
            for token in self.tokens if need <= 0 else [t for t, n in shared.items() if n >= need]:
                allowed = allowed_edits(max(len(word), len(token)))
                if (far := edits(word, token, allowed)) <= allowed:
                    for i in self.tokens[token]:
                        near[i].append((far, at, token))
        ranks = []
        for i, hits in near.items():
            typed: set[int] = set()
            named: set[str] = set()
            spoiled = 0
            for far, at, token in sorted(hits):
                if at not in typed and token not in named:
                    typed.add(at)
                    named.add(token)
                    spoiled += far
            both = len(named)
            if both > 1 and (score := both / (len(set(self.sets[i][0])) + len(own) - both)) > 0.5:
                ranks.append((3, -score, float(spoiled), "", self.sets[i][1]))
        ranks.sort()
        return [r for r in ranks if r[:4] == ranks[0][:4]]

    def mentions(self, form: str) -> list[tuple[int, int, str]]:
        """Longest non-overlapping (start, end, key) of names embedded as whole words in a folded text."""
        padded = f" {form} "
        hits = [(end - len(name) - 1, end, key) for end, (name, key) in self.machine.iter(padded)]
        taken: list[tuple[int, int, str]] = []
        for hit in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            if all(hit[1] <= t[0] + 1 or hit[0] >= t[1] - 1 for t in taken):
                taken.append(hit)
        return taken

    def _near_common(self, word: str) -> bool:
        return any(edits(word, c, 1) <= 1 for c in self.common if c[0] == word[0])

    def _candidates(self, attempt: str) -> list[str]:
        """Every form that can be within the allowed edits: one edit spoils at most three bigrams."""
        most = allowed_edits(len(attempt) + 2) if len(attempt) >= 5 else 0
        if not most:
            return [attempt] if attempt in self.squeezed else []
        grams = self._grams(attempt)
        shared = Counter(f for g in grams for f in self.grams.get(g, ()))
        need = len(grams) - 3 * most
        if need <= 0:
            return [f for f in self.squeezed if abs(len(f) - len(attempt)) <= most]
        return [f for f, n in shared.items() if n >= need and abs(len(f) - len(attempt)) <= most]
