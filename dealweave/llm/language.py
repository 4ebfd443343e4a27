"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams, followed by a linear softmax over the languages and
one class of letter noise. Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded,
stratified sample: whole texts, excerpts of a few words, and noise made of their letters. As both are
linear, prediction reads one folded table: a row of class scores for each n-gram bucket.

A part of the sample is kept back for calibration. It gives a temperature and, for each class of text length, the score
below which a text is rejected. Wrong scores for that come from noise and from models trained without some of the languages, which
judge texts of the languages that they have never seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.llm.registry import query, read
from dealweave.llm.sampling import stratified

BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (2, 3, 4)
SAMPLE = 400  # documents of each language that the model may learn from
EPOCHS = 6
STEP = 1 << 18  # bytes of a text hashed at a time
EXCERPTS = (3, 10, 30)  # words of the excerpts that a text is learned and calibrated by, besides the whole
FOLDS = 8  # at most, of models that leave languages out
PART = 3  # they learn from every third document
LENGTHS = (24, 64, 160, 512)  # bytes at which a class of text length ends
ENOUGH = 40  # right scores that a class of length needs for a threshold of its own
REJECTED = 0.005  # share of right calibration texts that may fall below the threshold of their length
WRONG = 0.99  # share of wrong calibration texts; the threshold is halfway, in log odds, from where they end to where right ones begin
UNKNOWN = "und"
NOISE = None  # label of noise among training rows


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the whole lower-cased text, with a space at both ends."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8).astype(np.uint32)
    for at in range(0, len(raw), STEP):
        part = raw[at:at + STEP + max(GRAMS) - 1]
        own = min(STEP, len(raw) - at)
        hashed = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(part) < n:
                break
            hashed = hashed[:len(part) - n + 1] * np.uint32(0x01000193) ^ (part[n - 1:] + np.uint32(1))
            if n in GRAMS:
                mixed = (hashed[:own] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                yield (mixed >> np.uint32(32 - 15)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and their shares of all n-grams."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for g in _grams(text):
        counts += np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / counts.sum()).astype(np.float32)


def _excerpts(text: str) -> list[str]:
    """The whole text and a few words from its middle."""
    words = text.split()
    at = len(words) // 3
    return list(dict.fromkeys([text, *[" ".join(words[at:at + n]) for n in EXCERPTS]]))


def _noise(text: str) -> list[str]:
    """Words of shuffled and of random letters, as long as the words of an excerpt of ``text``."""
    seed = zlib.crc32(text.encode())
    rng = np.random.default_rng(seed)
    letters = sorted({c for c in text[:STEP].lower() if c.isalpha()})
    made = _excerpts(text)
    words = made[1 + seed % len(made[1:]) if made[1:] else 0][:STEP].lower().split()
    sizes = np.cumsum([len(w) for w in words])
    drawn = rng.permutation(list("".join(words))), rng.choice(letters, int(sizes[-1]))
    return [" ".join("".join(w) for w in np.split(x, sizes[:-1])) for x in drawn]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Row = tuple[str | None, np.ndarray, np.ndarray, int]  # language or NOISE, buckets, shares, bytes


def _learned(train: list[Row], check: list[Row], languages: list[str], seed: int) -> tuple[np.ndarray, float]:
    """Folded table (languages, then noise) of the rows of ``languages`` and noise, and the temperature that suits ``check``."""
    rng = np.random.default_rng(seed)
    place = {name: i for i, name in enumerate([*languages, NOISE])}
    train, check = ([r for r in rows if r[0] in place] for rows in (train, check))
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(place)), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = 4.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(train)):
            name, at, share, _ = train[i]
            mean = share @ embed[at]
            wrong = _softmax(mean @ out)
            wrong[place[name]] -= 1
            back = out @ wrong
            out -= 0.25 * rate * np.outer(mean, wrong)
            embed[at] -= rate * 4 * share[:, None] * back
    table = embed @ out
    scores = np.stack([share @ table[at] for _, at, share, _ in check])
    truth = np.array([place[r[0]] for r in check])
    grid = np.geomspace(0.02, 10, 55)
    loss = [-np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return table, float(grid[int(np.argmin(loss))])


class LanguageModel:
    """Folded scores by bucket and class (the last is noise), temperature and rejection threshold by class of length."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float, thresholds: list[float]):
        self.languages, self.table, self.temperature, self.thresholds = languages, table, temperature, thresholds

    @classmethod
    def fit(cls, rows: list[tuple[str, list[Row]]], seed: int = 3) -> LanguageModel:
        """From (language, rows of one document) in a fixed order. Every fifth pair of documents is kept back."""
        languages = sorted({name for name, _ in rows})
        check = [r for i, (_, of) in enumerate(rows) for r in of if i // 2 % 5 == 4]
        train = [r for i, (_, of) in enumerate(rows) for r in of if i // 2 % 5 != 4] or check
        part = [r for i, (_, of) in enumerate(rows) for r in of if i // 2 % 5 != 4 and i % PART == 0] or train
        check = check or train
        table, temperature = _learned(train, check, languages, seed)

        def judged(of: list[Row], table: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
            p = _softmax(np.stack([share @ table[at] for _, at, share, _ in of]) / temperature)[:, :-1]
            return p.argmax(axis=1), p.max(axis=1)

        known, noise = [r for r in check if r[0] is not NOISE], [r for r in check if r[0] is NOISE]
        best, sure = judged(known, table, temperature)
        right = np.array([languages[b] == r[0] for b, r in zip(best, known)])
        good = [(r[3], s) for r, s, ok in zip(known, sure, right) if ok]
        bad = [(r[3], s) for r, s in zip(noise, judged(noise, table, temperature)[1])] if noise else []
        folds = min(FOLDS, len(languages)) if len(languages) > 1 else 0
        for fold in range(folds):
            kept = [x for i, x in enumerate(languages) if i % folds != fold]
            other = [r for r in known if r[0] not in kept]
            if other and any(r[0] in kept for r in check):
                bad += [(r[3], s) for r, s in zip(other, judged(other, *_learned(part, check, kept, seed))[1])]
        thresholds: list[float] = []
        for low, high in zip((0, *LENGTHS), (*LENGTHS, np.inf)):
            rights, wrongs = ([s for n, s in found if low <= n < high] for found in (good, bad))
            if len(rights) < ENOUGH:
                thresholds.append(thresholds[-1] if thresholds else 0.0)
            else:
                most = np.quantile(rights, REJECTED)
                enough = min(most, np.quantile(wrongs, WRONG)) if wrongs else most
                odds = [np.log(x / (1 - x)) for x in np.clip([most, enough], 1e-6, 1 - 1e-6)]
                thresholds.append(float(1 / (1 + np.exp(-sum(odds) / 2))))
        return cls(languages, table, temperature, thresholds)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """The likeliest language, its probability and whether that is too low for a text as long as this."""
        total, n = np.zeros(self.table.shape[1]), 0
        for g in _grams(text):
            total += self.table.take(g, axis=0).sum(axis=0, dtype=np.float64)
            n += len(g)
        p = _softmax(total / max(n, 1) / self.temperature)[:-1]
        best = int(p.argmax())
        low = p[best] < self.thresholds[int(np.searchsorted(LENGTHS, len(text.encode()), side="right"))]
        return self.languages[best], float(p[best]), bool(low)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """Model from at most ``sample`` rows of each language that are not held out, have a language and a letter;
    None if there are none. Which rows are taken is a hash of the id; only their n-gram shares reach the driver."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out() & F.col("lang").isNotNull() & has_letter(F.col("text")))
    ids = stratified(rows.select("doc_id", "lang"), "lang", "doc_id", sample)
    picked = rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")  # at most sample ids a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(1).to_pylist()
            got = [(r, real, x, *features(x)) for r, t in enumerate(whole) for real, made in ((True, _excerpts(t)), (False, _noise(t))) for x in made]
            of = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()).take(of), batch.column(2).take(of), pa.array([g[1] for g in got], pa.bool_()), pa.array([len(g[2].encode()) for g in got], pa.int64()),
                 pa.array([g[3] for g in got], pa.list_(pa.int32())), pa.array([g[4] for g in got], pa.list_(pa.float32()))], names=["doc_id", "lang", "real", "bytes", "at", "share"])

    table = picked.mapInArrow(run, "doc_id string, lang string, real boolean, bytes long, at array<int>, share array<float>").toArrow()
    found: dict[tuple[str, str], list[Row]] = {}
    for key, lang, real, size, at, share in zip(*(table[c].to_pylist() for c in ("doc_id", "lang", "real", "bytes")), table["at"], table["share"]):
        found.setdefault((key, lang), []).append((lang if real else NOISE, np.array(at.values), np.array(share.values), size))
    return LanguageModel.fit([(lang, sorted(of, key=lambda r: (r[0] is NOISE, -r[3], r[1].tobytes(), r[2].tobytes()))) for (_, lang), of in sorted(found.items())]) if found else None


def identified(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected``: one row per input row, without a shuffle.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for a text that is null or has no letter (or without a model).
    ``score`` is the calibrated probability of ``lang_pred``; ``rejected`` marks ``und`` and scores
    below the model's threshold for texts of that length, as unlearned languages and letter noise have. Ids pass through as they are, other columns are ignored.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.when(has_letter(F.col(text_col)), F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(UNKNOWN, 0.0, True) if model is None or t is None else model.predict(t) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "rejected"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return identified(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
