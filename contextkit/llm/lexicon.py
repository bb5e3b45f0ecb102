"""A lexicon trie met by a Levenshtein automaton, and scores of the hits in context.  No Spark here."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

WORD = re.compile(r"\w+")
WINDOW = 48  # characters looked at on either side of a hit
QUOTES = re.compile(r"[\"“”„«»‘’]|\b(?:said|says|quote[sd]?|wrote|called|word|term|dit|sagte|zitat|dijo)\b")
ADDRESS = re.compile(r"\b(?:you|your|youre|du|dich|dein|tu|toi|ton|vous|usted|ustedes)\b")
FEATURES = 7


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """All Levenshtein automata of the terms at once, made deterministic as words walk through it.

    A state is a set of (trie node, edits made).  A term may be met with
    ``edits_for`` it edits; a term that ends in * is met by any word that
    begins with it.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[int, bool] | None] = [None]
        self.slack = [0]  # most edits of any term below the node
        for number, term in enumerate(terms):
            stem, edits = term.rstrip("*"), 0 if term.endswith("*") else edits_for(term)
            node = 0
            self.slack[0] = max(self.slack[0], edits)
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], edits)
            if self.term[node] is None or not term.endswith("*"):
                self.term[node] = number, term.endswith("*")
        self.prefixes = {term[:-1]: n for n, term in enumerate(terms) if term.endswith("*")}
        self.lengths = sorted({len(p) for p in self.prefixes}, reverse=True)
        self.limit = {n: edits_for(t) for n, t in enumerate(terms) if not t.endswith("*")}
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.first = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo, least = list(pairs), {}
        while todo:  # skipping letters of a term
            node, e = todo.pop()
            if e > self.slack[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            out.add((node, e + 1))
            for letter, child in self.children[node].items():
                out.add((child, e if letter == c else e + 1))
        return self._state(out)

    def find(self, word: str) -> tuple[int, int] | None:
        """Number of the term that ``word`` spells, and its edits: fewest edits, then the first term."""
        state = self.first
        for c in word:
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.moves[state][c] = self._move(state, c)
            state = nxt
            if not self.sets[state]:
                break
        else:
            ends = [(e, self.term[node][0]) for node, e in self.sets[state] if self.term[node] and not self.term[node][1] and e <= self.limit[self.term[node][0]]]
            if ends:
                e, term = min(ends)
                return term, e
        for n in self.lengths:
            if len(word) > n and word[:n] in self.prefixes:
                return self.prefixes[word[:n]], 0
        return None


@dataclass
class Scorer:
    """Features of a text from the hits of a lexicon with weights."""

    terms: list[str]
    weights: list[float]

    def __post_init__(self):
        self.automaton = Automaton(self.terms)
        self.seen: dict[str, tuple[int, int] | None] = {}

    def find(self, word: str) -> tuple[int, int] | None:
        if word not in self.seen:
            if len(self.seen) > 1 << 20:
                self.seen.clear()
            self.seen[word] = self.automaton.find(word)
        return self.seen[word]

    def features(self, text: str | None) -> np.ndarray:
        """Sum, rate and greatest of the hits' scores, hits with edits, distinct terms, quoted share, length."""
        text = (text or "").lower()
        words = WORD.findall(text)
        out = np.zeros(FEATURES)
        out[6] = np.log1p(len(words))
        hits = {w for w in set(words) if self.find(w)}
        if not hits:
            return out
        total = most = inexact = quoted = 0.0
        distinct = set()
        n = 0
        for m in WORD.finditer(text):
            if m[0] not in hits:
                continue
            term, edits = self.find(m[0])
            around = text[max(0, m.start() - WINDOW) : m.start()] + " " + text[m.end() : m.end() + WINDOW]
            score = self.weights[term] * (0.6**edits)
            if QUOTES.search(around):
                score *= 0.4
                quoted += 1
            if ADDRESS.search(around):
                score *= 1.2
            n += 1
            total += score
            most = max(most, score)
            inexact += edits > 0
            distinct.add(term)
        out[:6] = np.log1p(total), 100 * total / len(words), most, np.log1p(inexact), np.log1p(len(distinct)), quoted / n
        out[1] = np.log1p(out[1])
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def chosen_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int, most: int = 400, least: int = 5, odds: float = 2.0) -> tuple[list[str], list[float]]:
    """Terms whose log odds between documents labelled toxic and clean reach ``odds``, and these odds.

    ``counts`` has for each term its documents labelled toxic and clean.
    """
    scored = []
    for term, t, c in counts:
        w = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
        if t >= least and w >= odds:
            scored.append((w * np.sqrt(t), term, w))
    scored.sort(reverse=True)
    return [t for _, t, _ in scored[:most]], [w for _, _, w in scored[:most]]
