"""Word-piece counts in one pass over each word, without building the pieces.

The vocabulary is a trie with two roots: pieces that begin a word and pieces
that go on with it. Where no child fits, a node's failure link leads to the node
reached after its longest-match pieces are taken off, and a count says how many
those are. Each byte moves on or takes a link, so the work is linear in the text.
A script without breaks is one word to a page; long words are therefore walked
in many parts at once, which costs about as much for a byte as short words.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm import text
from heatloom.llm.tokens import default_tokenizer

START, GO_ON, NONE = 0, 1, -1
#: Words of more than two such parts are cut into parts of this many bytes.
PART = 64
#: So many times all parts are set right at once; those still out of step follow one by one.
ROUNDS = 3
COUNTS = "doc_id long, n_words long, n_pieces long, n_unknown long"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level_pieces(path: str, bare_blank: bool = False) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word (written with a blank in front) and pieces that go on with one.

    With ``bare_blank``, the blank alone is the empty piece of those that begin a word.
    """
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    alphabet = byte_alphabet()
    whole = [bytes(alphabet[c] for c in piece) for piece in vocabulary if all(c in alphabet for c in piece)]
    return [p[1:] for p in whole if p[:1] == b" " and (bare_blank or len(p) > 1)], [p for p in whole if p[:1] != b" "]


class Automaton:
    """Children in a hash table over (node, byte); links and counts by node."""

    def __init__(self, begin: Collection[bytes], go_on: Collection[bytes]):
        children: list[dict[int, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((START, begin), (GO_ON, go_on)):
            for piece in pieces:
                node = root
                for byte in piece:
                    at = children[node].get(byte)
                    if at is None:
                        at = children[node][byte] = len(children)
                        children.append({})
                    node = at
                if piece:
                    ends.add(node)
        link, count = [NONE] * len(children), [0] * len(children)
        if b"" in begin:
            link[START], count[START] = GO_ON, 1
        queue = [START, GO_ON]
        for node in queue:
            for byte, child in children[node].items():
                queue.append(child)
                if child in ends:
                    link[child], count[child] = GO_ON, 1
                    continue
                at, taken = link[node], count[node]
                while at != NONE and byte not in children[at]:
                    at, taken = link[at], taken + count[at]
                if at != NONE:
                    link[child], count[child] = children[at][byte], taken
        self.link, self.count, self.steps = np.array(link), np.array(count), {}
        edges = [(node << 8 | byte, child) for node, own in enumerate(children) for byte, child in own.items()]
        self._file(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))

    def _file(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, int(len(keys) * 3).bit_length())
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1), np.full(size, NONE)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            self.keys[slot[left[free]]] = keys[left[free]]  # of several for one slot, one stays
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (text.mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        go = np.flatnonzero((found != key) & (found != -1))
        while len(go):
            slot[go] = (slot[go] + 1) & self.mask
            found = self.keys[slot[go]]
            hit = found == key[go]
            out[go[hit]] = self.values[slot[go[hit]]]
            go = go[~hit & (found != -1)]
        return out

    def _step(self, at: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes after one more byte, and how many pieces each took off."""
        at, taken = at.copy(), np.zeros(len(at), np.int64)
        to = self.child(at, byte)
        stuck = np.flatnonzero((to == NONE) & (at != NONE))
        while len(stuck):
            taken[stuck] += self.count[at[stuck]]
            at[stuck] = self.link[at[stuck]]
            stuck = stuck[at[stuck] != NONE]
            to[stuck] = self.child(at[stuck], byte[stuck])
            stuck = stuck[to[stuck] == NONE]
        return np.where(at == NONE, NONE, to), taken

    def pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of every word, or -1 where the vocabulary can't spell it. Words are not empty.

        All words go on a byte at a time. A long one is cut into parts that all start at once, as if a
        piece ended at each cut; what came before a part then sets it right, for
        the few bytes until it is in the node where it was without it.
        """
        size = end - start
        parts = np.where(size > 2 * PART, -(-size // PART), 1)
        word = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = start[word] + nth * PART
        length = np.where(parts[word] == 1, size[word], np.minimum(end[word] - begin, PART))
        node, total = np.where(nth == 0, START, GO_ON), np.zeros(len(word), np.int64)
        cut = np.flatnonzero(nth > 0)  # these remember their way
        spot = np.full(len(word), -1)
        spot[cut] = np.arange(len(cut))
        way, sums = np.full((len(cut), PART), NONE), np.zeros((len(cut), PART), np.int64)
        order = np.argsort(-length, kind="stable")  # longest first, so the active ones stay in front
        lengths = -length[order]
        for k in range(int(length.max()) if len(length) else 0):
            row = order[: int(np.searchsorted(lengths, -k, "left"))]  # longer than k
            node[row], taken = self._step(node[row], data[begin[row] + k].astype(np.int64))
            total[row] += taken
            own = row[spot[row] >= 0]
            if len(own):
                way[spot[own], k], sums[spot[own], k] = node[own], total[own]
        lost = np.zeros(len(start), bool)
        for turn in range(ROUNDS):
            came = node[cut - 1]
            if not turn:  # entered as they began
                cut, came = cut[came != GO_ON], came[came != GO_ON]
            lost[word[cut[came == NONE]]] = True
            cut, came = cut[~lost[word[cut]]], came[~lost[word[cut]]]
            cut = self._set_right(data, begin, length, node, total, cut, came, spot, way, sums) + 1
            cut = cut[cut < len(word)]
            cut = cut[nth[cut] > 0]
        self._set_right_in_order(data, begin, length, node, total, cut, word, nth, spot, way, sums, lost)
        last = np.cumsum(parts) - 1
        state, out = node[last] if len(last) else node, np.bincount(word, total, len(start)).astype(np.int64)
        state = np.where(lost, NONE, state)
        rest = np.flatnonzero((state != NONE) & (state != GO_ON))
        while len(rest):
            out[rest] += self.count[state[rest]]
            state[rest] = self.link[state[rest]]
            rest = rest[(state[rest] != NONE) & (state[rest] != GO_ON)]
        return np.where(state == NONE, -1, out)

    def _set_right(self, data, begin, length, node, total, cut, came, spot, way, sums) -> np.ndarray:
        """Walks parts again from the nodes they are really entered in; returns those that end in another node than before."""
        at, taken, open_ = came.copy(), np.zeros(len(cut), np.int64), np.arange(len(cut))
        changed = []
        for k in range(PART):
            over = length[cut[open_]] <= k
            ended = open_[over]
            node[cut[ended]], total[cut[ended]] = at[ended], taken[ended]
            changed.append(cut[ended])
            open_ = open_[~over]
            if not len(open_):
                break
            row = cut[open_]
            at[open_], more = self._step(at[open_], data[begin[row] + k].astype(np.int64))
            taken[open_] += more
            mine = spot[row]
            met = at[open_] == way[mine, k]
            here = open_[met]
            ahead = taken[here] - sums[spot[cut[here]], k]
            total[cut[here]] += ahead
            sums[spot[cut[here]], k:] += ahead[:, None]
            way[mine[~met], k], sums[mine[~met], k] = at[open_[~met]], taken[open_[~met]]
            open_ = open_[~met]
        else:
            node[cut[open_]], total[cut[open_]] = at[open_], taken[open_]
            changed.append(cut[open_])
        return np.sort(np.concatenate(changed)) if changed else cut[:0]


    def _set_right_in_order(self, data, begin, length, node, total, cut, word, nth, spot, way, sums, lost) -> None:
        """The same for parts that stay out of step (one letter a million times, say): part after part, a byte at a time."""
        if len(cut) and not self.steps:
            used = self.keys >= 0
            self.steps = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
        steps, link, count, reached = self.steps, self.link.tolist() if len(cut) else [], self.count.tolist() if len(cut) else [], -1
        for row in cut.tolist():
            while row > reached and row < len(word) and nth[row] and not lost[word[row]]:
                reached, at, taken, met = row, int(node[row - 1]), 0, False
                own = way[spot[row]].tolist()
                for k, byte in enumerate(data[begin[row] : begin[row] + length[row]].tolist()):
                    while at != NONE and (to := steps.get(at << 8 | byte, NONE)) == NONE:
                        taken += count[at]
                        at = link[at]
                    if at == NONE:
                        break
                    at = to
                    if at == own[k]:
                        total[row] += taken - sums[spot[row], k]
                        met = True
                        break
                if at == NONE:
                    lost[word[row]] = True
                if met or at == NONE:
                    break
                node[row], total[row] = at, taken
                row += 1


_built: dict[tuple[str, bool], Automaton] = {}


def automaton(path: str, bare_blank: bool = False) -> Automaton:
    if (path, bare_blank) not in _built:
        _built[path, bare_blank] = Automaton(*byte_level_pieces(path, bare_blank))
    return _built[path, bare_blank]


def _marks(data: np.ndarray) -> np.ndarray:
    """Visible bytes outside words, each a word of its own."""
    return np.flatnonzero((data > 32) & (data < 127) & ~text._IN_WORD[text._LOWER[data]])


def _count(path: str, bare_blank: bool, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton(path, bare_blank)
    for batch in batches:
        data, offsets = text.text_bytes(batch.column(1))
        out = []
        for lo, hi in text.blocks(offsets, block):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            found, mark = text.words(part, at), _marks(part)
            start, end = np.append(found.start, mark), np.append(found.end, mark + 1)
            row = np.append(found.row, np.searchsorted(at, mark, "right") - 1)
            n = machine.pieces(part, start, end)
            sums = [np.bincount(row, minlength=hi - lo), np.bincount(row, np.where(n < 0, 1, n), hi - lo), np.bincount(row, n < 0, hi - lo)]
            out.append(np.array(sums).astype(np.int64))
        total = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, total)], ["doc_id", "n_words", "n_pieces", "n_unknown"])


def piece_counts(docs: DataFrame, vocabulary: str | None = None, block: int = 1 << 19, bare_blank: bool = False) -> DataFrame:
    """Per row: doc_id, words, greedy longest-match pieces and words that the vocabulary can't spell (one piece each).

    Words are runs of ASCII letters, digits and bytes from 0x80 on; any other
    visible character is a word of its own. A null or empty text has none.
    Repeated rows are counted each; an empty table gives no rows. Texts are
    taken in blocks of bytes, so memory follows the block or the longest text.
    With ``bare_blank``, a word that no piece with a blank in front begins is
    spelled with the blank as a piece of its own; a vocabulary of all bytes then
    spells every word.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_count, vocabulary or default_tokenizer(), bare_blank, block), COUNTS)
