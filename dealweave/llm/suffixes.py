"""Removal of repeated passages through distributed suffix arrays by difference cover.

Equal strings of 50 bytes contain the same 24-byte gram of least hash (their anchor), so the suffix array of the corpus
splits by anchor into blocks that can be sorted apart. First, anchors that occur in one text only are set aside:
no string around them repeats. Around each other anchor the bytes of all its windows are sent to
the anchor's block. A block sorts its suffixes by the difference cover modulo 3: sampled triples get names, the string of names
is ranked by recursion (until names are unique or span 50 bytes), the remaining suffixes are sorted by
their first symbol and the rank behind it and merged in. Adjacent suffixes are compared on their first 50 bytes, and equal neighbours form classes
whose smallest document keeps the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read

SPAN = 50  # bytes of a repeated string
GRAM = 24  # bytes of an anchor
PART = 6 << 20  # bytes of text in a group of documents
CONTEXTS = 1 << 20  # bytes of text that a block sorts, as a rule
HEAVY = 4096  # groups of documents that may share an anchor before its windows are dealt out one by one
SLICE = 1 << 21  # bytes hashed at a time
WORD = 6  # bytes of a symbol
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


# ---- difference cover ----------------------------------------------------------------------------

def names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1, equal for equal keys, and their number."""
    order = np.argsort(keys)
    ordered = keys[order]
    step = np.ones(len(keys), dtype=np.int64)
    step[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out, int(step.sum())


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * (int(b.max(initial=0)) + 1) + b


def _triples(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the triples of symbols at the given places of ``x``, which has three zeros at its end."""
    base = int(x.max(initial=0)) + 1
    if base < 1 << 21:
        return names((x[at] * base + x[at + 1]) * base + x[at + 2])
    return names(_pair(names(x[at] * base + x[at + 1])[0], x[at + 2]))


def suffix_ranks(x: np.ndarray, depth: int) -> np.ndarray:
    """Ranks (from 1) of all suffixes of a string of small positive numbers by their first ``depth`` symbols or more;
    equal ranks mean that those are equal. Suffixes may be told apart by what follows."""
    n = len(x)
    x = np.concatenate([x, np.zeros(6, dtype=np.int64)])
    if depth <= 3:
        return _triples(x, np.arange(n))[0]
    one, two, rest = np.arange(1, n + 3, 3), np.arange(2, n + 3, 3), np.arange(0, n, 3)
    at = np.concatenate([one, two])
    named, count = _triples(x, at)
    if count < len(at):
        gap = np.zeros(1, dtype=np.int64)
        deep = suffix_ranks(np.concatenate([named[:len(one)], gap, named[len(one):]]), -(-depth // 3))
        named = np.delete(deep, len(one))
    rank = np.zeros(n + 6, dtype=np.int64)
    rank[at] = named

    order = at[np.argsort(named)]  # sampled suffixes, sorted
    top = int(rank.max()) + 1
    key0 = x[rest] * top + rank[rest + 1]
    by0 = np.argsort(key0)
    key0, rest = key0[by0], rest[by0]
    first, second = order[order % 3 == 1], order[order % 3 == 2]
    # how many sampled suffixes stand before each remaining one: with those at 1 mod 3 it shares the form (symbol, rank),
    # with those at 2 mod 3 the form (symbol, symbol, rank)
    before1 = np.searchsorted(x[first] * top + rank[first + 1], key0)
    base = int(x.max()) + 1
    pair2 = np.unique(np.concatenate([x[second] * base + x[second + 1], x[rest] * base + x[rest + 1]]), return_inverse=True)[1]
    before2 = np.searchsorted(pair2[:len(second)] * top + rank[second + 2], pair2[len(second):] * top + rank[rest + 2])
    # suffixes that are equal to this depth may stand in any order, which a search must not turn into a step back
    place0 = np.maximum.accumulate(before1) + np.maximum.accumulate(before2) + np.arange(len(rest))
    merged = np.empty(len(order) + len(rest), dtype=np.int64)
    taken = np.zeros(len(merged), dtype=bool)
    taken[place0] = True
    merged[place0] = rest
    merged[~taken] = order
    # neighbours are equal if their own form says so: same kind and key, or compared in the shared form
    same = np.zeros(len(merged), dtype=bool)
    a, b = merged[:-1], merged[1:]
    by1 = (x[a] == x[b]) & (rank[a + 1] == rank[b + 1]) & (rank[a + 1] > 0) & (rank[b + 1] > 0)
    by2 = (x[a] == x[b]) & (x[a + 1] == x[b + 1]) & (rank[a + 2] == rank[b + 2]) & (rank[a + 2] > 0) & (rank[b + 2] > 0)
    sampled = (rank[a] > 0) & (rank[b] > 0)
    same[1:] = np.where(sampled, rank[a] == rank[b], by1 | by2)
    out = np.zeros(n + 6, dtype=np.int64)
    out[merged] = np.cumsum(~same)
    return out[:n]


def window_classes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts``, and the class of each in that order: equal for equal first ``SPAN`` bytes."""
    size = -(-(len(text) + SPAN + 2 * WORD) // WORD) * WORD
    padded = np.zeros(size + WORD, dtype=np.int64)
    padded[:len(text)] = text.astype(np.int64) + 1
    symbol = np.zeros(size, dtype=np.int64)
    for k in range(WORD):
        symbol = symbol * 257 + padded[k:k + size]
    string = names(symbol)[0].reshape(-1, WORD).T.ravel()  # every sixth symbol continues a suffix
    rank = suffix_ranks(string, -(-SPAN // WORD))
    mine = rank[starts % WORD * (size // WORD) + starts // WORD]
    order = np.argsort(mine)
    at = starts[order]
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    equal = np.ones(max(len(at) - 1, 0), dtype=bool)
    for o in (0, 8, 16, 24, 32, 40, SPAN - 8):
        got = np.ascontiguousarray(words[at + o]).view(np.uint64).ravel()
        equal &= got[1:] == got[:-1]
    return order, np.cumsum(np.r_[True, ~equal][:len(at)])


# ---- anchors ---------------------------------------------------------------------------------------

def _mixed(b: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place."""
    n = len(b)
    w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 8)).view(np.uint64).ravel()
    x = w[:n - 23] * M1
    x = ((x ^ (x >> np.uint64(29))) + w[8:n - 15]) * M2
    x = ((x ^ (x >> np.uint64(32))) + w[16:]) * M3
    return x ^ (x >> np.uint64(31))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    n = len(x) - width + 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step:width - step + n])


def window_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of joined texts: bytes, text number and place of each window start, and its anchor. Windows don't cross texts."""
    def joined(part: list[tuple[int, int, bytes]]):
        data = np.frombuffer(b"".join(t for _, _, t in part), dtype=np.uint8)
        sizes = np.array([len(t) for _, _, t in part])
        inside = np.concatenate([np.arange(n) <= n - SPAN for n in sizes]) if len(part) > 1 else np.arange(sizes[0]) <= sizes[0] - SPAN
        start = np.flatnonzero(inside)
        owner = np.repeat(np.arange(len(part)), sizes)[start]
        base = np.cumsum(sizes) - sizes
        number, offset = np.array([n for n, _, _ in part]), np.array([o for _, o, _ in part])
        anchor = _least(_mixed(data), SPAN - GRAM + 1)[start]
        return data, start, number[owner], start - base[owner] + offset[owner], anchor

    part, held = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - SPAN + 1, 0), SLICE):
            piece = text[at:at + SLICE + SPAN - 1]
            part.append((number, at, piece))
            held += len(piece)
            if held >= SLICE:
                yield joined(part)
                part, held = [], 0
    if part:
        yield joined(part)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _numbers(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype=dtype)


def _split(by: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Groups of equal ``by`` with their parts of the other columns."""
    order = np.argsort(by, kind="stable")
    cut = np.flatnonzero(np.r_[True, by[order][1:] != by[order][:-1]]) if len(by) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut.tolist()[1:], len(by)]):
        yield int(by[order[a]]), *[c[order[a:b]] for c in columns]


# ---- the steps, each over one group ----------------------------------------------------------------------

def _texts(docs: pa.Table, own: set | None = None) -> tuple[list[int], list[bytes]]:
    ids, texts = docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist()
    keep = [i for i, d in enumerate(ids) if own is None or d in own]
    return [ids[i] for i in keep], [texts[i] for i in keep]


def anchors_of(docs: pa.Table, other: pa.Table, groups: int) -> pa.Table:
    """Distinct anchors of a group's texts, dealt out by hash; an anchor of several texts of the group is sent twice."""
    if not docs.num_rows:
        return pa.table({"part": pa.array([], pa.int32()), "sieve": pa.array([], pa.int32()), "keys": pa.array([], pa.binary())})
    part = docs["part"][0].as_py()
    _, texts = _texts(docs, set(other["own_id"].to_pylist()))
    found = []
    for _, _, number, _, anchor in window_anchors(texts):
        order = np.lexsort((anchor, number))
        a, n = anchor[order], number[order]
        found.append(a[np.r_[True, (a[1:] != a[:-1]) | (n[1:] != n[:-1])]])
    keys, count = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
    keys = np.repeat(keys, np.minimum(count, 2))
    rows = list(_split((keys >> np.uint64(32)).astype(np.int64) % groups, keys.astype(np.uint32)))
    return pa.table({"part": pa.array([part] * len(rows), pa.int32()), "sieve": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([_blob(r[1]) for r in rows], pa.binary())})


def shared_anchors(table: pa.Table, heavy: int) -> pa.Table:
    """Of one sieve group, the anchors that occur in several texts, sent back to each part that has them; the flag of a row
    says that they occur in more than ``heavy`` parts."""
    parts = table["part"].to_pylist()
    blobs = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    _, inverse, count = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    inside = np.bincount(np.concatenate([np.unique(inverse[s:e]) for s, e in _ranges(map(len, blobs))]), minlength=len(count))
    rows = []
    for part, blob, (s, e) in zip(parts, blobs, _ranges(map(len, blobs))):
        of = inverse[s:e]
        for flag in (False, True):
            got = np.unique(blob[(count[of] > 1) & ((inside[of] > heavy) == flag)])
            if len(got):
                rows.append((part, flag, _blob(got)))
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "sieve": pa.array(table["sieve"].to_pylist()[:1] * len(rows), pa.int32()), "keys": pa.array([r[2] for r in rows], pa.binary()),
                     "heavy": pa.array([r[1] for r in rows], pa.bool_()), "own_id": pa.array([None] * len(rows), pa.int64())})


def _ranges(sizes) -> list[tuple[int, int]]:
    ends = np.cumsum([0, *sizes]).tolist()
    return list(zip(ends, ends[1:]))


def _known(other: pa.Table, heavy: bool) -> np.ndarray:
    """Shared anchors of a part, sorted, sieve group and lower bits in one number; at least one entry."""
    told = other.filter(pa.array([k is not None and h == heavy for k, h in zip(other["keys"].to_pylist(), other["heavy"].to_pylist())], pa.bool_()))
    got = [(np.uint64(s) << np.uint64(32)) | np.frombuffer(k, np.uint32) for s, k in zip(told["sieve"].to_pylist(), told["keys"].to_pylist())]
    return np.sort(np.concatenate([np.full(1, np.iinfo(np.uint64).max), *got]))


SENT = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("bytes", pa.binary()), ("windows", pa.binary()), ("which", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("run", pa.bool_())])


def contexts_of(docs: pa.Table, other: pa.Table, groups: int, blocks: int) -> pa.Table:
    """Bytes around the shared anchors of a group's texts by block, and where its smallest document with them has them.
    In the other documents of the group they are runs to remove already. The windows of heavy anchors are contexts of their own."""
    if not docs.num_rows:
        return SENT.empty_table()
    part = docs["part"][0].as_py()
    light, heavy = _known(other, False), _known(other, True)
    ids, texts = _texts(docs, {d for d in other["own_id"].to_pylist() if d is not None})
    if not ids:
        return SENT.empty_table()
    order = sorted(range(len(ids)), key=ids.__getitem__)  # the smallest document comes first
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    index: dict[bytes, int] = {}
    block_of, owner, places, runs = [], [], [], []

    def meet(context: bytes, key: int, doc: int, place: int) -> None:
        i = index.setdefault(context, len(index))
        if i == len(owner):
            owner.append(doc)
            block_of.append(key % blocks)
        if owner[i] == doc:
            places.append((i, doc, place))
        else:
            runs.append((doc, place, len(context) - SPAN + 1))

    for data, at, number, place, anchor in window_anchors(texts):
        short = ((anchor >> np.uint64(32)) % np.uint64(groups) << np.uint64(32)) | (anchor & np.uint64(0xFFFFFFFF))
        # consecutive windows of a text with the same anchor share one context
        edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1]) | (place[1:] != place[:-1] + 1)])
        size = np.diff(np.append(edge, len(at)))
        one = light[np.searchsorted(light, short[edge]).clip(max=len(light) - 1)] == short[edge]
        many = heavy[np.searchsorted(heavy, short[edge]).clip(max=len(heavy) - 1)] == short[edge]
        raw = data.tobytes()
        use = edge[one | many]
        for n, s, p, d, a, split in zip(size[one | many].tolist(), at[use].tolist(), place[use].tolist(), number[use].tolist(), anchor[use].tolist(), many[one | many].tolist()):
            if split:
                for k in range(n):
                    window = raw[s + k:s + k + SPAN]
                    meet(window, xxhash.xxh64_intdigest(window), ids[d], p + k)
            else:
                meet(raw[s:s + n + SPAN - 1], a, ids[d], p)
    rows = []
    if index:
        contexts = list(index)
        which, doc, start = (np.array(x, dtype=t) for x, t in zip(zip(*places), (np.int64, np.int64, np.int32)))
        local = np.empty(len(contexts), dtype=np.int32)
        where = np.array(block_of)
        met = dict((b, w) for b, w in _split(where[which], np.arange(len(which))))
        for block, pick in _split(where, np.arange(len(where))):
            local[pick] = np.arange(len(pick))
            sizes = np.array([len(contexts[i]) - SPAN + 1 for i in pick.tolist()], dtype=np.int32)
            of = met[block]
            rows.append((block, part, b"".join(contexts[i] for i in pick.tolist()), _blob(sizes), _blob(local[which[of]]), _blob(doc[of]), _blob(start[of]), False))
    if runs:
        doc, start, size = (np.array(x, dtype=t) for x, t in zip(zip(*runs), (np.int64, np.int32, np.int32)))
        rows.append((part % blocks, part, b"", _blob(size), b"", _blob(doc), _blob(start), True))
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SENT)], schema=SENT)


def _joined(text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts end to end and where each begins; windows never reach past their own context."""
    data = np.frombuffer(b"".join(text), dtype=np.uint8)
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    return data, np.cumsum(sizes) - sizes


def _firsts(texts: list[bytes], least: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Smallest document of every window of the given distinct contexts, in order."""
    data, base = _joined(texts)
    owner = np.repeat(np.arange(len(texts)), windows)
    starts = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, classes = window_classes(data, starts)
    doc = least[owner[order]]
    edge = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
    low = np.minimum.reduceat(doc, edge)
    out = np.empty(len(doc), dtype=np.int64)
    out[order] = low[classes - 1]
    return out


def repeats_of(table: pa.Table) -> pa.Table:
    """Of one block: runs of windows that also start in a smaller document, back to the parts of their documents."""
    rows, index, strings, met = [], {}, [], []
    for r in table.to_pylist():
        doc, start, windows = np.frombuffer(r["doc"], np.int64), np.frombuffer(r["start"], np.int32), np.frombuffer(r["windows"], np.int32)
        if r["run"]:
            rows.append((r["part"], r["doc"], r["start"], r["windows"]))
            continue
        got = [index.setdefault(r["bytes"][a:b], len(index)) for a, b in _ranges((windows + SPAN - 1).tolist())]
        met.append((r["part"], np.array(got, dtype=np.int64)[np.frombuffer(r["which"], np.int32)], doc, start))
    if met:
        strings = list(index)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        for _, which, doc, _ in met:
            np.minimum.at(least, which, doc)
        windows = np.fromiter((len(c) - SPAN + 1 for c in strings), np.int64, len(strings))
        low = _firsts(strings, least, windows)
        base = np.cumsum(windows) - windows
        for part, which, doc, start in met:
            n = windows[which]
            owner = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            gone = low[base[which][owner] + within] < doc[owner]
            change = owner[1:] != owner[:-1]
            first = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | change])
            last = np.flatnonzero(gone & np.r_[~gone[1:] | change, True])
            if len(first):
                rows.append((part, _blob(doc[owner[first]]), _blob((start[owner[first]] + within[first]).astype(np.int32)), _blob((last - first + 1).astype(np.int32))))
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "doc": pa.array([r[1] for r in rows], pa.binary()),
                     "start": pa.array([r[2] for r in rows], pa.binary()), "windows": pa.array([r[3] for r in rows], pa.binary()), "copy_id": pa.array([None] * len(rows), pa.int64())})


def cut(docs: pa.Table, other: pa.Table, kind: pa.Schema) -> pa.Table:
    """Texts of a group without the bytes that windows to remove cover."""
    doc, start, count = _numbers(other["doc"], np.int64), _numbers(other["start"], np.int32), _numbers(other["windows"], np.int32)
    runs = {d: (s, n) for d, s, n in _split(doc, start, count)}
    copies = {c for c in other["copy_id"].to_pylist() if c is not None}
    ids, texts = docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist()
    kept, spans = [], []
    for d, text in zip(ids, texts):
        if d in copies and len(text) >= SPAN:
            got = [(0, len(text))]
        elif d in runs:
            s, n = runs[d]
            order = np.argsort(s, kind="stable")
            a, b = s[order].astype(np.int64), (s + n)[order].astype(np.int64) + SPAN - 1
            high = np.maximum.accumulate(b)
            new = np.flatnonzero(np.r_[True, a[1:] > high[:-1]])
            got = list(zip(a[new].tolist(), high[np.append(new[1:], len(a)) - 1].tolist()))
        else:
            got = []
        edges = [0, *[x for g in got for x in g], len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        spans.append([{"start": a, "end": b} for a, b in got])
    return pa.table([docs["doc_id"].combine_chunks(), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind.field("removed").type)], schema=kind)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_bytes, kept, removed``: the bytes (UTF-8) that stay and the maximal removed runs as (start, end).

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id; strings are judged on
    the input. Ids must be whole numbers. Null text is empty. A row with a null id takes no part and keeps all; rows that repeat id
    and text have the same result; rows with one id and different texts are not defined (an id names one text).
    Exact copies of a text are settled by its smallest id. An empty table gives no rows, other columns are ignored.

    Group sizes follow from the total bytes of text, so tasks stay of one size. Texts move once, dealt out by id, and are read
    from there three times. A context that many documents have travels once from each group of documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART))
    sieves = max(1, parts // 8)
    blocks = max(1, total // (2 * CONTEXTS))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    dealt = rows.withColumn("part", part).where("doc_id IS NOT NULL").select("part", "doc_id", "text").repartition(parts, "part")
    digest = rows.where("doc_id IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("_sha"))
    least = digest.groupBy("_sha").agg(F.min("doc_id").alias("_least"))
    marked = digest.join(least, "_sha").select(part.alias("part"), F.col("doc_id").alias("own_id"), (F.col("doc_id") > F.col("_least")).alias("_copy"))
    own = marked.where("NOT _copy").select("part", "own_id").distinct()
    copies = marked.where("_copy").select("part", F.col("own_id").alias("copy_id")).distinct()

    grouped = dealt.groupBy("part")
    sent = grouped.cogroup(own.groupBy("part")).applyInArrow(lambda d, o: anchors_of(d, o, sieves), "part int, sieve int, keys binary")
    shared = sent.groupBy("sieve").applyInArrow(lambda t: shared_anchors(t, heavy), "part int, sieve int, keys binary, heavy boolean, own_id long")
    told = shared.unionByName(own, allowMissingColumns=True)
    contexts = grouped.cogroup(told.groupBy("part")).applyInArrow(
        lambda d, o: contexts_of(d, o, sieves, blocks), "block int, part int, bytes binary, windows binary, which binary, doc binary, start binary, run boolean")
    runs = contexts.groupBy("block").applyInArrow(repeats_of, "part int, doc binary, start binary, windows binary, copy_id long")
    told = runs.unionByName(copies, allowMissingColumns=True)
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    done = grouped.cogroup(told.groupBy("part")).applyInArrow(lambda d, o: cut(d, o, kind), "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>")
    nameless = rows.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("kept"),
                                                   F.array().cast("array<struct<start:long,end:long>>").alias("removed"))
    return done.unionByName(nameless)


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    return without_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
