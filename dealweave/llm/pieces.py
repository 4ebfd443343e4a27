"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Text is cut wherever no piece of the vocabulary has the two characters side by side, as no merge can
reach across. Each distinct segment is merged by a score-ordered agenda of adjacent symbol
pairs: the best score first, of equal scores the leftmost. Short segments of a batch run their
agendas side by side in numpy, one merge of each segment per round; long segments use a heap.
Every segment that was merged is also encoded by the sentencepiece library and must agree; decoding is
the library's.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read

SPACE = "▁"
NONE = np.iinfo(np.int32).max
CHARS = 1 << 21  # symbols below are pieces, above are characters without a piece
LONG = 48  # symbols; longer segments go to the heap
CACHED = 500_000  # segments remembered by a worker
SLICE = 256  # documents encoded at a time
TABLE = 1024  # characters told apart when cutting, the space mark as number 0


def _row(code):
    return np.where(code == ord(SPACE), 0, np.minimum(code, TABLE - 1))



class AgendaEncoder:
    """Encoder of one model file; raises ValueError for models whose rules it doesn't cover."""

    def __init__(self, model_path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        names = sp.id_to_piece(list(range(n)))
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.bytes = {}
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(names[i][3:5], 16)] = i
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        for probe, want in (("a  b ", f"{SPACE}a{SPACE}{SPACE}b{SPACE}"), ("ﬁ ", f"{SPACE}ﬁ ")):
            got = "".join(sp.id_to_piece(i) if not sp.is_byte(i) else "?" for i in sp.encode(probe))
            if re.sub(r"\?+", ".", got) != "".join(c if c in self.ids or c == SPACE else "." for c in want) and got != want:
                raise ValueError("the model normalises text")
        if any("\n" in p for p in self.ids):
            raise ValueError("pieces reach across lines")
        self.meets = np.zeros((TABLE, TABLE), dtype=bool)
        self.meets[-1] = self.meets[:, -1] = True  # the last row stands for all further characters: no cut
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                self.meets[_row(ord(a)), _row(ord(b))] = True

        # ranks: equal scores share a rank, so that the leftmost pair wins among them
        scores = {i: sp.get_score(i) for i in plain}
        place = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self._symbol(piece[:k]), self._symbol(piece[k:])
                if left is not None and right is not None:
                    pairs[left * (CHARS * 2) + right] = (place[scores[i]], i)
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] + [-1], dtype=np.int32)
        self.cache: dict[str, bytes] = {}
        self.mark = [self.ids[SPACE], self.bytes[10]]

    def _symbol(self, s: str):
        return self.ids.get(s, CHARS + ord(s) if len(s) == 1 else None)

    def _look(self, left, right):
        key = left.astype(np.int64) * (CHARS * 2) + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def _side_by_side(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many short words: each round takes the best pair of every word. All symbols, and how many each word has."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        known, place = np.unique(chars, return_inverse=True)
        sym = np.array([self._symbol(chr(c)) for c in known.tolist()], dtype=np.int64)[place]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        rank, into = self._fresh_at(sym, word, np.arange(len(sym)))
        finished = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NONE, sizes)
            finished.append((word[~live], sym[~live]))
            at = np.flatnonzero((rank == np.repeat(best, sizes)) & live)
            at = at[np.r_[True, word[at][1:] != word[at][:-1]]] if len(at) else at
            sym[at] = into[at]
            live[at + 1] = False
            at = at - np.cumsum(~live)[at]
            sym, word, rank, into = sym[live], word[live], rank[live], into[live]
            for where in (at, at[at > 0] - 1):
                if len(where):
                    rank[where], into[where] = self._fresh_at(sym, word, where)
        word, sym = (np.concatenate(x) for x in zip(*finished)) if finished else (word, sym)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _fresh_at(self, sym, word, where):
        nxt = np.minimum(where + 1, len(sym) - 1)
        r, m = self._look(sym[where], sym[nxt])
        same = (word[where] == word[nxt]) & (nxt > where)
        return np.where(same, r, NONE), m

    def _heap(self, text: str) -> list[int]:
        """The agenda of one long segment."""
        sym = [self._symbol(c) for c in text]
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (hit := self.pairs.get(sym[a] * (CHARS * 2) + sym[b])):
                heapq.heappush(agenda, (hit[0], a, b, sym[a], sym[b]))

        for a in range(n - 1):
            propose(a, a + 1)
        while agenda:
            _, a, b, left, right = heapq.heappop(agenda)
            if sym[a] != left or sym[b] != right or nxt[a] != b:
                continue  # one of the two has been merged since
            sym[a] = self.pairs[left * (CHARS * 2) + right][1]
            sym[b] = -1
            nxt[a] = nxt[b]
            if nxt[b] >= 0:
                prev[nxt[b]] = a
            propose(prev[a], a)
            propose(a, nxt[a])
        return [s for s in sym if s >= 0]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of segments by their agendas, each checked against the library."""
        short, long = [w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]
        words, (sym, size) = short + long, self._side_by_side(short)
        heaps = [self._heap(w) for w in long]
        sym, size = np.concatenate([sym, *heaps]).astype(np.int64), np.concatenate([size, [len(h) for h in heaps]]).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        unknown = sym >= CHARS  # characters without a piece become their bytes
        if unknown.any():
            spelled = [[self.bytes[b] for b in chr(s - CHARS).encode()] for s in sym[unknown].tolist()]
            width = np.ones(len(sym), dtype=np.int64)
            width[unknown] = [len(x) for x in spelled]
            filled = np.repeat(unknown, width)
            sym, word = np.repeat(sym, width), np.repeat(word, width)
            sym[filled] = [i for x in spelled for i in x]
            size = np.bincount(word, minlength=len(words))
        # after a line end the library puts no mark of its own, so any segment can be checked as it is
        check = self.library.encode(["\n" + w.replace(SPACE, " ") for w in words], num_threads=1)
        theirs = np.fromiter(chain.from_iterable(check), np.int64)
        ends = np.cumsum(size + 2)
        given = np.fromiter(map(len, check), np.int64, len(check))
        keep = np.ones(len(theirs), dtype=bool)
        if (given == size + 2).all():
            keep[ends - size - 2] = keep[ends - size - 1] = False
        if not np.array_equal(theirs[keep], sym) or not (theirs[~keep].reshape(-1, 2) == self.mark).all():
            raise ValueError("a segment differs from the library's encoding")
        flat, to = sym.astype(np.int32).tobytes(), (4 * np.cumsum(size)).tolist()
        return {w: flat[a:b] for w, a, b in zip(words, [0, *to], to)}

    def cut(self, text: str) -> list[str]:
        """Segments of a text whose merges don't depend on each other."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        rows = _row(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
        at = (np.flatnonzero(~self.meets[rows[:-1], rows[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        cache = self.cache
        missing = list(set().union(*cut).difference(cache))
        if missing:
            if len(cache) + len(missing) > CACHED:
                cache.clear()
                missing = list(set().union(*cut))
            cache.update(self.learn(missing))
        return [np.frombuffer(b"".join(map(cache.__getitem__, c)), dtype=np.int32) for c in cut]


@lru_cache(maxsize=2)
def _encoder(model_path: str) -> AgendaEncoder:
    return AgendaEncoder(model_path)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: ids of the whole text without begin or end ids, and what they decode to.

    One row per input row, in place, without a shuffle. Null text is empty and has no ids. Null ids and
    repeated rows pass through; other columns are ignored; an empty table gives no rows. A text of
    any length is one row; what a worker holds besides is ``SLICE`` texts and ``CACHED`` segments. The file
    under ``model_path`` must exist on every executor.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = coder.encode(batch.column(1).to_pylist())
                decoded = coder.library.decode([i.tolist() for i in ids], num_threads=1)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


@query("op4_sentencepiece")
def op4(spark, sf_dir):
    return encoded(read(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
