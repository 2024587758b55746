"""BPE encoding and decoding by a tokenization automaton.

``Automaton`` compiles the merge list by one gadget after another, in rank
order.  Its states stand for the token read last.  The gadget of a merge
(u, v) -> uv

* takes the arc ``v`` away from the state of ``u`` (u v is never left unmerged),
* gives ``uv`` an arc from every state that has an arc ``u`` at that moment
  (for u = v not from the state of ``u`` itself: runs merge from the left), and
* makes the state of ``uv`` a copy of the state that ``v`` leads to, as it is
  at that moment.

A copy is kept as a link to the state it was copied from plus its own changes
(as failure links in a pattern automaton are), so the table grows with the
number of merges and not with its square; an arc that is asked for is resolved
through the links once and then stands in the transition table.  Exactly one
path of the automaton spells a word, and exactly one spells each prefix, so a
word is encoded by walking its positions from the left and following, from
the state of each earlier position, the one arc that ends there.  The new
words of a batch walk in step: at each position a trie of the labels, read
backwards, names the tokens that end there, and the transition table tells
which of them has an arc.  Words longer than ``STEP_BYTES`` walk alone (only
sizes are tried that some token with the last symbols has).  Decoding emits
the arc labels.

The merge list must be proper: each part of a merge is a base symbol or the
product of an earlier merge, and no token has two merges.  ``Automaton``
refuses any other list.

Null texts count as empty and have no tokens.  Repeated rows are encoded row
by row; only the named text column is read, so further columns do no harm.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyho.llm.common import map_texts, worker_cache

TAIL = 3                # symbols that tell which sizes of tokens are tried
CACHED_TAILS = 200_000  # a worker keeps the sizes of this many tails
_SEPARATORS = regex.compile("[\x1c-\x1f]").search
CACHED_ARCS = 1 << 18   # and the answers for this many arcs
CACHED_BYTES = 32 << 20  # a worker keeps late encoded words and chunks of so many bytes (twice that with labels), and as many of before
ENTRY_BYTES = 130        # of a cached entry, and again of its labels, besides text, ids and labels
STEP_BYTES = 48          # words up to this long are encoded in step
STEP_WORDS = 16_384      # so many at a time
GROUP_CHARS = 1 << 20    # texts of so many characters look for new words together


class Automaton:
    """The compiled merges: ``arc(p, t)`` tells if token t may follow token p."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.void: set[int] = set()             # products of merges that never apply
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}          # rank of the gadget that made a token's arcs
        self.cut: dict[tuple[int, int], int] = {}  # arcs taken away, and by which gadget
        self.table: dict[int, bool] = {}
        self.ends: dict[str, tuple[Endings, Endings]] = {}  # by word-end mark: inside a word, at its end
        ranked = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        products = {t for *_, t in ranked}
        done: set[int] = set()
        self.vocab = vocab
        for rank, (u, v, token) in enumerate(ranked):
            if token in done or any(x in products and x not in done for x in (u, v)):
                raise ValueError(f"merge {rank} is not proper")
            self.gadget(rank, u, v, token)
            done.add(token)
        self.vocab = {s: i for s, i in vocab.items() if i not in self.void}

    def gadget(self, rank: int, u: int, v: int, token: int) -> None:
        """Act on the automaton; a merge whose parts never meet in it leaves no arc."""
        if u in self.void or v in self.void or not self._resolve(u, v):
            self.void.add(token)
            return
        self.cut[u, v] = rank
        self.left[token], self.right[token], self.made[token] = u, v, rank

    def arc(self, state: int, token: int) -> bool:
        """Resolve one arc and enter it in the transition table."""
        key = state << 32 | token
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= CACHED_ARCS:
                self.table.clear()
            known = self.table[key] = self._resolve(state, token)
        return known

    def _resolve(self, p: int, t: int) -> bool:
        before = 1 << 40  # only gadgets of a lower rank have acted
        while True:
            if self.cut.get((p, t), before) < before:
                return False
            made_p, made_t = self.made.get(p, -1), self.made.get(t, -1)
            if made_p == made_t == -1:
                return True
            if p == t:             # the copy of right(p)'s state, asked for left(p)
                before, p, t = made_p, self.right[p], self.left[t]
            elif made_t > made_p:  # t has an arc where its left part had one
                if self.left[t] == self.right[t] == p:
                    return False
                before, t = made_t, self.left[t]
            else:                  # p was copied from the state of its right part
                before, p = made_p, self.right[p]

    def encode(self, symbols: str, end: str) -> list[int]:
        """Token ids of a word; its last symbol carries the mark ``end``."""
        n = len(symbols)
        if not n:
            return []
        if end not in self.ends:
            inner = {s: i for s, i in self.vocab.items() if not (end and s.endswith(end))}
            self.ends[end] = (Endings(inner), Endings(
                {s[:len(s) - len(end)]: i for s, i in self.vocab.items() if s.endswith(end)}) if end else Endings(inner))
        inside, final = self.ends[end]
        known = self.table.get
        last = [-1] * (n + 1)   # token that ends at a position
        start = [0] * (n + 1)
        for stop in range(1, n + 1):
            at = inside if stop < n else final
            find = at.find
            for size in at[symbols[stop - TAIL if stop > TAIL else 0:stop]]:
                begin = stop - size
                if begin < 0:
                    continue
                token = find(symbols[begin:stop])
                if token is None:
                    continue
                if begin:
                    follows = known(last[begin] << 32 | token)
                    if not (self.arc(last[begin], token) if follows is None else follows):
                        continue
                last[stop], start[stop] = token, begin
                break
            else:
                raise ValueError("a symbol is not in the vocabulary")
        out = []
        while stop:
            out.append(last[stop])
            stop = start[stop]
        return out[::-1]


class Endings(dict):
    """Last symbols of what was read (up to ``TAIL``) -> sizes of the tokens
    that can end there, largest first."""

    def __init__(self, tokens: dict[str, int]):
        super().__init__()
        self.find = tokens.get
        self.longer: dict[str, set[int]] = {}
        for s in tokens:
            if len(s) > TAIL:
                self.longer.setdefault(s[-TAIL:], set()).add(len(s))

    def __missing__(self, tail: str) -> tuple[int, ...]:
        if len(self) >= CACHED_TAILS:
            self.clear()
        sizes = {k for k in range(1, len(tail) + 1) if self.find(tail[-k:]) is not None}
        self[tail] = out = tuple(sorted(sizes | self.longer.get(tail, set()), reverse=True))
        return out


def _byte_symbols() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand
    for themselves, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Late:
    """Encoded text, bounded by bytes: what was entered of late, and what was
    before.  ``ids`` (as bytes) and ``labels`` (joined by blanks) have the same
    keys; a codec without labels enters none.  Only ``missing`` forgets, so what a group of texts needs stays while
    it is read."""

    def __init__(self):
        self.ids: dict[str, bytes] = {}
        self.labels: dict[str, str] = {}
        self.before: tuple[dict, dict] = ({}, {})
        self.held = 0

    def missing(self, keys: set[str]) -> list[str]:
        """The ones of ``keys`` with no entry; entries of before come back."""
        if self.held > CACHED_BYTES * (2 if self.labels else 1):
            self.before, self.ids, self.labels, self.held = (self.ids, self.labels), {}, {}, 0
        new = keys.difference(self.ids)
        ids, labels = self.before
        back = [k for k in new if k in ids] if ids else []
        self.enter(back, [ids[k] for k in back], [labels[k] for k in back] if labels else [])
        return list(new.difference(back)) if back else list(new)

    def enter(self, keys: list[str], ids: list[bytes], labels: list[str]) -> None:
        self.ids.update(zip(keys, ids))
        self.labels.update(zip(keys, labels))
        self.held += ENTRY_BYTES * (len(keys) + len(labels)) + sum(sum(map(len, x)) for x in (keys, ids, labels))


class Steps:
    """Encodes many words in step, over flat arrays.

    ``keys`` and ``values`` hold the trie of the labels read from their last
    byte, by ``node << 8 | byte``; ``token`` the token that begins at a node,
    inside a word and at its end.
    """

    def __init__(self, automaton: Automaton, end: str, symbols: list[str]):
        self.automaton = automaton
        byte = {s: b for b, s in enumerate(symbols)}
        child: dict[int, int] = {}
        nodes = 1
        places: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for label, token in automaton.vocab.items():
            last = bool(end) and label.endswith(end)
            spelled = label[:len(label) - len(end)] if last else label
            if not spelled or any(c not in byte for c in spelled):
                continue
            node = 0
            for c in reversed(spelled):
                key = node << 8 | byte[c]
                node = child.get(key, 0)
                if not node:
                    node = child[key] = nodes
                    nodes += 1
            places[last][node] = token
            if not end:
                places[True][node] = token
        self.token = np.full((2, nodes), -1, np.int64)
        for at, tokens in zip(places, self.token):
            tokens[list(at)] = list(at.values())
        self._fill(child)

    def _fill(self, child: dict[int, int]) -> None:
        """The children as an open hash table of arrays."""
        keys = np.fromiter(child, np.int64, len(child))
        values = np.fromiter(child.values(), np.int64, len(child))
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            put, first = np.unique(at[free], return_index=True)
            self.keys[put], self.values[put] = keys[free][first], values[free][first]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def children(self, keys: np.ndarray) -> np.ndarray:
        """Nodes under ``keys``; 0 for none."""
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], 0)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def follows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        known, arc = self.automaton.table.get, self.automaton.arc
        answers = list(map(known, (state << 32 | token).tolist()))
        for i in [i for i, a in enumerate(answers) if a is None]:
            answers[i] = arc(int(state[i]), int(token[i]))
        return np.array(answers, bool)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words (1 to ``STEP_BYTES`` bytes each), and where each word's begin and end."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max(initial=0))
        read = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        read = np.ascontiguousarray(read.T).astype(np.int64)            # position x word
        last = np.full((width + 1, len(words)), -1, np.int64)           # token that ends at a position
        start = np.zeros((width + 1, len(words)), np.int64)
        for stop in range(1, width + 1):
            left = np.flatnonzero(size >= stop)
            at_end = (size[left] == stop).astype(np.int64)
            node = np.zeros(len(left), np.int64)
            for begin in range(stop - 1, -1, -1):
                node = self.children(node << 8 | read[begin][left])
                token = self.token[at_end, node]
                fits = (node > 0) & (token >= 0)
                if begin:
                    asked = np.flatnonzero(fits)
                    fits[asked] = self.follows(last[begin][left[asked]], token[asked])
                last[stop][left[fits]], start[stop][left[fits]] = token[fits], begin
                more = ~fits & (node > 0)
                left, at_end, node = left[more], at_end[more], node[more]
                if not len(left):
                    break
        at, rows, order = size.copy(), np.arange(len(words)), []
        if (last[at, rows] < 0).any():
            raise ValueError("a symbol is not in the vocabulary")
        while len(rows):
            order.append((rows, last[at[rows], rows]))
            at[rows] = start[at[rows], rows]
            rows = rows[at[rows] > 0]
        owner, ids = (np.concatenate(x[::-1]) for x in zip(*order))
        ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


@dataclass
class Spec:
    """What is read of a tokenizer file (JSON with normalizer NFC, white space
    to one blank and lower case, a split pattern, byte-level symbols, and a
    word-end mark)."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    pattern: str
    end: str

    @classmethod
    def read(cls, path: str) -> Spec:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        model = doc["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pattern = doc["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in doc["added_tokens"]},
                   pattern, model["end_of_word_suffix"] or "")


class Codec:
    """Encodes and decodes texts with one automaton."""

    def __init__(self, spec: Spec, labelled: bool = True):
        """``labelled``: keep the labels of encoded words, which only ``_digests`` reads."""
        self.automaton = Automaton(spec.vocab, spec.merges)
        self.labelled = labelled
        self.end, self.special = spec.end, spec.special
        self.label = {i: s for s, i in spec.vocab.items()} | {i: s for s, i in spec.special.items()}
        # white space is the Unicode property, not Python's wider class
        self.split = regex.compile(spec.pattern.replace(r"\s", r"\p{White_Space}")).findall
        # letters alone are one word where the pattern takes runs of letters and no part of a run
        runs = any(x in spec.pattern for x in (r"|[\p{L}]+|", r"|\p{L}+|"))
        self.one_word = regex.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+" if runs else "(?!)").fullmatch
        self.cut = regex.compile("(" + "|".join(map(regex.escape, spec.special)) + ")").split if spec.special else None
        symbols = _byte_symbols()
        self.symbols = [symbols[b] for b in range(256)]
        self.steps = Steps(self.automaton, self.end, self.symbols)
        self.words, self.chunks = _Late(), _Late()

    def word(self, word: str) -> list[int]:
        # printable ASCII stands for itself
        plain = word.isascii() and word.isprintable() and " " not in word
        return self.automaton.encode(word if plain else "".join([self.symbols[b] for b in word.encode()]), self.end)

    def labels(self, ids) -> str:
        return " ".join([self.label[i] for i in ids])

    def learn(self, chunks: set[str]) -> None:
        """Enter the chunks (text between white space) that have no entry."""
        new = self.chunks.missing(chunks)
        split = [[chunk] if self.one_word(chunk) else self.split(chunk) for chunk in new]
        words = self.words.missing({word for parts in split for word in parts})
        spelled = sorted(zip(map(str.encode, words), words), key=lambda w: len(w[0]))
        steps = sum(len(s) <= STEP_BYTES for s, _ in spelled)
        for i in range(0, steps, STEP_WORDS):
            part = spelled[i:min(i + STEP_WORDS, steps)]
            flat, ends = self.steps.encode([s for s, _ in part])
            self.enter([word for _, word in part], flat, ends.tolist())
        for _, word in spelled[steps:]:
            ids = self.word(word)
            self.enter([word], np.array(ids), [0, len(ids)])
        ids, labels = self.words.ids, self.words.labels
        self.chunks.enter(new, [b"".join([ids[w] for w in p]) if len(p) > 1 else ids[p[0]] for p in split],
                          [" ".join([labels[w] for w in p]) if len(p) > 1 else labels[p[0]] for p in split]
                          if self.labelled else [])

    def enter(self, words: list[str], flat: np.ndarray, ends: list[int]) -> None:
        ids, spans = flat.astype("<u4").tobytes(), list(zip(ends, ends[1:]))
        labels = [self.label[i] for i in flat.tolist()] if self.labelled else []
        self.words.enter(words, [ids[4 * a:4 * b] for a, b in spans],
                         [" ".join(labels[a:b]) for a, b in spans] if self.labelled else [])

    def parts(self, text: str) -> list[str]:
        """Chunks of a text in order; special tokens begin with a blank, which no chunk holds."""
        out: list[str] = []
        for part in self.cut(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                out.append(" " + part)
                continue
            part = unicodedata.normalize("NFC", part)
            # each character alone: a final sigma has no form of its own here
            low = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            # words never span white space, so what stands between it is split apart once;
            # only U+001C to U+001F are white space to split() and not to the pattern
            out += self.split(low) if _SEPARATORS(low) else low.split()
        return out

    def pieces(self, texts: list[str | None]):
        """For each text, its chunks in order, all of them entered in ``chunks``."""
        for i, j in _groups([len(text or "") for text in texts]):
            parts = [self.parts(text or "") for text in texts[i:j]]
            needed = set().union(*parts)
            special = [c for c in needed if c[0] == " "]
            self.learn(needed.difference(special))
            self.chunks.enter(special, [np.array([self.special[c[1:]]], "<u4").tobytes() for c in special],
                              [c[1:] for c in special] if self.labelled else [])
            yield from parts

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join([self.chunks.ids[c] for c in own]), "<u4") for own in self.pieces(texts)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The labels of the arcs taken, joined by blanks (the file names no decoder)."""
        return self.labels(ids)


def _groups(sizes: list[int]):
    """Neighbours of ``GROUP_CHARS`` in all, as ranges; a longer text stands alone."""
    i = held = 0
    for j, size in enumerate(sizes):
        if j > i and held + size > GROUP_CHARS:
            yield i, j
            i, held = j, 0
        held += size
    if i < len(sizes):
        yield i, len(sizes)


def _encoded(codec: Codec, batches, text: str, keep: list[str]):
    """The batches with their ids, in parts of ``GROUP_CHARS`` bytes of text: only
    one part's texts and ids are held at a time."""
    for whole in batches:
        for i, j in _groups([size or 0 for size in pc.binary_length(whole.column(text)).to_pylist()]):
            b = whole.slice(i, j - i)
            ids = codec.encode_all(b.column(text).to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [*keep, "ids"])


def _digests(codec: Codec, texts: list[str | None]) -> list[list]:
    out: list[list] = [[], [], []]
    for own in codec.pieces(texts):
        ids = b"".join([codec.chunks.ids[c] for c in own])
        decoded = " ".join([codec.chunks.labels[c] for c in own])
        for column, value in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                       hashlib.sha256(decoded.encode()).hexdigest())):
            column.append(value)
    return out


def shared_spec(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file (a few MB), read by the driver and sent to each executor once."""
    spec = Spec.read(path)
    return spark.sparkContext.broadcast((_name(spec), spec))


def _name(spec: Spec) -> str:
    return "bpe_" + hashlib.sha256(repr((spec.merges, spec.special, spec.pattern, spec.end)).encode()).hexdigest()[:16]


def _codec(shared: Broadcast, labelled: bool = False) -> Codec:
    """The worker's codec; its automaton is compiled once in each worker."""
    name, spec = shared.value
    return worker_cache(f"{name}_{labelled}", lambda: Codec(spec, labelled))


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of any column of that name."""
    keep = [c for c in docs.columns if c.lower() != "ids"]
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))
    shared = shared_spec(docs.sparkSession, path)

    def task(batches):
        yield from _encoded(_codec(shared), batches, text, keep)

    return docs.select(*keep).mapInArrow(task, schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with the text of ``ids`` as ``decoded``; null ids give ''."""
    keep = [c for c in docs.columns if c.lower() != "decoded"]
    schema = docs.select(*keep).schema.add("decoded", "string")
    shared = shared_spec(docs.sparkSession, path)

    def task(batches):
        codec = _codec(shared)
        for b in batches:
            texts = [codec.decode(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*keep, "decoded"])

    return docs.select(*keep).mapInArrow(task, schema)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text.

    Encodes and decodes in one pass, so neither ids nor text is shuffled.
    """
    shared = shared_spec(docs.sparkSession, path)

    def start():
        codec = _codec(shared, labelled=True)
        return lambda texts: _digests(codec, texts)

    return map_texts(docs, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, start)
