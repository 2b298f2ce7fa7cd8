"""All segmentations of a word into the pieces of a vocabulary, weighed in log space.

A word is the mark of a word's beginning and its characters. Every piece that stands at a
position is an edge of the lattice; a character that is no piece has one edge made of its
bytes. The forward recursion sums the weights of all paths, so its end is the marginal
log-probability of the word; with the backward recursion it gives the expected uses of each
piece. Many words are walked side by side; words of more than ``LONG`` characters go alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marketlens.llm.text import utf8

MARK = "▁"  # what the vocabulary writes before a word
LONG = 200
_DEEP = 64  # more than the characters of any piece


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces that may stand in a word, the 256 bytes first, and their first probabilities.

    Scores that are log-probabilities are taken as such. Other scores, as of merged pairs,
    are negative ranks; the weight of rank r is 1 / (10 + r).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, scores, bytes_ = [], [], {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            bytes_[int(piece[3:5], 16)] = model.get_score(k)
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            if MARK not in piece[1:] and len(piece) < _DEEP:
                names.append(piece)
                scores.append(model.get_score(k))
    least = min(scores, default=0.0)
    score = np.array([*(bytes_.get(b) or least for b in range(256)), *scores])
    if 0.5 < np.exp(np.minimum(score, 1)).sum() < 2:
        weight = np.exp(score)
    else:
        weight = 1 / (10 + np.minimum(-score, len(score)))
    return [*(f"<{b}>" for b in range(256)), *names], weight / weight.sum()


class Lattice:
    """The trie of a vocabulary, and recursions over the lattices of words."""

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces)
        letters = {c: k + 1 for k, c in enumerate(sorted({c for p in pieces[256:] for c in p}))}
        self.kind = np.zeros(0x110000, np.int64)
        for c, k in letters.items():
            self.kind[ord(c)] = k
        self.mark = letters.get(MARK, 0)
        self.kind[ord(MARK)] = 0  # in a text it is a character like any other
        self.wide = len(letters) + 1
        step: dict[int, int] = {}
        piece = [-1]
        for number, name in enumerate(pieces[256:], 256):
            node = 0
            for c in name:
                key = node * self.wide + letters[c]
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                node = step[key]
            piece[node] = number
        self.keys = np.array(sorted(step), np.int64)
        self.child = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array(piece, np.int64)
        self.bytes: dict[int, list[int]] = {}

    def _step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        key = node * self.wide + kind
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (kind > 0), self.child[at], -1)

    def edges(self, words: pa.Array) -> dict[str, np.ndarray]:
        """Edges of the words' lattices. Node t of word k is ``first[k] + t``."""
        data, _ = utf8(words)
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        n = size + 1  # with the mark
        end = np.cumsum(n)
        total = int(end[-1])
        kind, code = np.full(total, self.mark, np.int64), np.full(total, ord(MARK), np.uint32)
        inner = np.ones(len(kind), bool)
        inner[end - n] = False
        kind[inner], code[inner] = self.kind[codes], codes
        word = np.repeat(np.arange(len(n)), n)
        at, stop = np.arange(len(kind)), end[word]
        node, here, deep = np.zeros(len(kind), np.int64), at, 0
        source, width, piece, single = [], [], [], np.zeros(len(kind), bool)
        while len(here):
            node = self._step(node, kind[here + deep])
            on = node >= 0
            here, node, deep = here[on], node[on], deep + 1
            found = self.piece[node]
            is_piece = found >= 0
            source.append(here[is_piece])
            piece.append(found[is_piece])
            width.append(np.full(len(source[-1]), deep))
            if deep == 1:
                single[source[-1]] = True
            more = here + deep < stop[here]
            here, node = here[more], node[more]
        odd = np.flatnonzero(~single)  # characters that are no pieces, and a mark that is none
        source.append(odd)
        piece.append(-1 - np.arange(len(odd)))
        width.append(np.ones(len(odd), np.int64))
        spelt = np.full((len(odd), 4), -1)
        for c in np.unique(code[odd]).tolist():
            spelling = list(chr(c).encode())
            spelt[code[odd] == c, :len(spelling)] = spelling
        src, wide = np.concatenate(source), np.concatenate(width)
        first = end - n + np.arange(len(n))
        step = src - (end - n)[word[src]] + wide  # the node of the word in which the edge ends
        order = np.lexsort((wide, step))
        src, wide, step = src[order], wide[order], step[order]
        own = src + word[src]
        return {"source": own, "target": own + wide, "step": step, "wide": wide, "word": word[src],
                "piece": np.concatenate(piece)[order], "spelt": spelt, "first": first, "n": n}

    @staticmethod
    def weights(e: dict[str, np.ndarray], log_p: np.ndarray) -> np.ndarray:
        spelt = np.where(e["spelt"] >= 0, log_p[e["spelt"]], 0).sum(1)
        odd = e["piece"] < 0
        out = log_p[np.where(odd, 0, e["piece"])]
        out[odd] = spelt[-1 - e["piece"][odd]]
        return out

    @staticmethod
    def _recur(e: dict[str, np.ndarray], w: np.ndarray, back: bool) -> np.ndarray:
        """Sums over all paths from the first node on, or up to the last."""
        nodes = int(e["n"].sum()) + len(e["n"])
        out = np.full(nodes, -np.inf)
        out[e["first"] + e["n"] if back else e["first"]] = 0
        come, go = (e["target"], e["source"]) if back else (e["source"], e["target"])
        if e["n"].max() > LONG:  # few words: edge by edge
            value, pairs = out.tolist(), list(zip(come.tolist(), go.tolist(), w.tolist(), strict=True))
            for a, b, x in reversed(pairs) if back else pairs:
                x += value[a]
                high, low = (x, value[b]) if x > value[b] else (value[b], x)
                value[b] = high + math.log1p(math.exp(low - high)) if low > -math.inf else high
            return np.array(value)
        turn = np.flatnonzero(np.diff(e["step"] * _DEEP + e["wide"])) + 1
        groups = list(zip(np.append(0, turn).tolist(), np.append(turn, len(w)).tolist(), strict=True))
        for a, b in reversed(groups) if back else groups:  # one edge a word at most
            to = go[a:b]
            out[to] = np.logaddexp(out[to], out[come[a:b]] + w[a:b])
        return out

    def _parts(self, words: pa.Array):
        """The words in two parts, as edges: the short ones side by side, each long one alone."""
        long = pc.utf8_length(words).to_numpy(zero_copy_only=False) >= LONG
        short = np.flatnonzero(~long)
        if len(short):
            yield short, self.edges(words.take(pa.array(short)))
        for k in np.flatnonzero(long):
            yield np.array([k]), self.edges(words.slice(int(k), 1))

    def marginals(self, words: pa.Array, log_p: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability over all its segmentations."""
        out = np.zeros(len(words))
        for rows, e in self._parts(words):
            out[rows] = self._recur(e, self.weights(e, log_p), False)[e["first"] + e["n"]]
        return out

    def expected(self, words: pa.Array, log_p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in all the words."""
        out = np.zeros(self.size)
        for _, e in self._parts(words):
            w = self.weights(e, log_p)
            ahead, back = self._recur(e, w, False), self._recur(e, w, True)
            share = np.exp(ahead[e["source"]] + w + back[e["target"]]
                           - ahead[e["first"] + e["n"]][e["word"]])
            odd = e["piece"] < 0
            out += np.bincount(e["piece"][~odd], share[~odd], self.size)
            spelt = e["spelt"][-1 - e["piece"][odd]]
            for column in spelt.T:
                used = column >= 0
                out += np.bincount(column[used], share[odd][used], self.size)
        return out
