"""Language identification by segmentation-marginalised unigrams.

A language is a table of probabilities of the pieces of a fixed public
vocabulary. A word's probability is the sum over all ways to cut it into
pieces of the products of their probabilities, which the forward algorithm
gives letter by letter; as pieces do not cross word starts, a text's is the
product over its words. Letters that are no piece are pieces of their own with
the floor's probability. Long words go through the same sums rescaled, with a
window of the longest piece, so a run of letters of any length is summed over
all its segmentations.

Training estimates the tables by expectation maximisation (forward and
backward sums give each piece's expected count) on a bounded sample: of each
language the SAMPLE labelled documents with the least hash of their text (fewer
if there are more than TOTAL / SAMPLE languages, one at least), with all their
words. Prediction reads every whole text.

Workers remember the scores of words of CACHE letters in all and then start
afresh; a batch that has more distinct words than that is held for its own time
only.

Defined results: ``und`` with score 0 for a text that is null or has no letter;
otherwise the language with the greatest probability (ties to the first by
name) and, as score, its share. Without a labelled document all texts are
``und``. Repeated rows get equal results; an empty table gives an empty result;
extra columns are not read, and ``predict`` keeps them whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, tidy, written

#: Labelled documents of a language that are learnt from, of all languages, rounds of training.
SAMPLE, TOTAL, ROUNDS = 400, 20_000, 3
#: Letters of the words that a worker remembers; texts and bytes it looks at together.
CACHE, TEXTS, BYTES = 2_000_000, 128, 4 << 20
FLOOR = 1e-7
#: Letters up to which a word's probability cannot fall below what a double holds, as no piece's is below FLOOR.
PLAIN = 40
START = "▁"
_letters = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the word start, of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if _letters.fullmatch(p.removeprefix(START)))


def words_of(text: str) -> list[str]:
    return _letters.findall(text.lower())


class Model:
    """Piece probabilities, one column a language."""

    def __init__(self, languages: list[str], table: dict[str, np.ndarray]):
        self.languages, self.table = languages, table
        self.longest = max(map(len, table), default=1)
        self.floor = np.full(len(languages), FLOOR)
        self.rows = {p: i for i, p in enumerate(table)}
        # Rows of the pieces, of a string that is no piece, and of a letter that is none.
        self.matrix = np.array([*table.values(), np.zeros(len(languages)), self.floor]).reshape(len(table) + 2, len(languages))
        self.forget()

    def pieces(self, words: list[str], start: int, end: int) -> list[int]:
        """For marked words, the row of the piece from ``start`` to ``end``."""
        get = self.rows.get
        if end - start == 1:
            floor = len(self.rows) + 1
            return [get(w[start:end], floor) for w in words]
        none = len(self.rows)
        return [get(w[start:end], none) for w in words]

    def forward(self, words: list[str]) -> list[np.ndarray]:
        """Sums over all segmentations of the first 0, 1, ... letters of marked words of one length."""
        sums = [np.ones((len(words), len(self.languages)))]
        for end in range(1, len(words[0]) + 1):
            sums.append(sum(sums[s] * self.matrix[self.pieces(words, s, end)] for s in range(max(0, end - self.longest), end)))
        return sums

    def score_long(self, word: str) -> np.ndarray:
        """Log-probability of a marked word of any length: the same sums, rescaled, in a window of the longest piece."""
        width, none, floor, get = self.longest, len(self.rows), len(self.rows) + 1, self.rows.get
        window = np.zeros((width, len(self.languages)))  # sums before the last ``width`` ends, the newest last
        window[-1] = 1.0
        logs = np.zeros(len(self.languages))
        for end in range(1, len(word) + 1):
            rows = [get(word[s:end], none if end - s > 1 else floor) if s >= 0 else none for s in range(end - width, end)]
            total = (window * self.matrix[rows]).sum(axis=0)
            window = np.concatenate([window[1:], total[None]])
            if not end % 16:
                scale = window.max(axis=0)
                window /= scale
                logs += np.log(scale)
        return logs + np.log(window[-1])

    def score_many(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of words, one row each; words of one length go through the forward sums together."""
        out = np.zeros((len(words), len(self.languages)))
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for n, group in groups.items():
            if n > PLAIN:
                for i in group:
                    out[i] = self.score_long(START + words[i])
                continue
            for at in range(0, len(group), 4096):
                ids = group[at : at + 4096]
                out[ids] = np.log(self.forward([START + words[i] for i in ids])[-1])
        return out

    def forget(self) -> None:
        """Drop remembered words."""
        self.known: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        cut = [words_of(t) if t and self.languages else [] for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if self.letters + sum(map(len, new)) > CACHE:
            self.forget()
            new = list(set().union(*cut))
        if new:
            self.letters += sum(map(len, new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.score_many(new)])
        out = []
        for words in cut:
            if not words:
                out.append(("und", 0.0))
                continue
            total = np.zeros(len(self.languages))
            for at in range(0, len(words), 65_536):
                total += self.scores[list(map(self.known.__getitem__, words[at : at + 65_536]))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.languages[best], float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum())))
        return out


def expectations(model: Model, words: list[str], weight: np.ndarray, expected: np.ndarray) -> None:
    """Adds the expected counts of pieces in marked words of one length, ``weight`` times each, to ``expected``.

    Forward and backward sums are rescaled at every letter, so they hold for words of any length.
    """
    n, width = len(words[0]), model.longest
    ahead = [np.ones((len(words), len(model.languages)))]
    scales = [ahead[0]]  # ahead[e] is the true sum over the product of scales[1..e]
    for e in range(1, n + 1):
        total, under = np.zeros_like(ahead[0]), np.ones_like(ahead[0])
        for s in range(e - 1, max(0, e - width) - 1, -1):
            total += ahead[s] * model.matrix[model.pieces(words, s, e)] / under
            under = under * scales[s] if s else under
        scales.append(total)
        ahead.append(np.ones_like(total))
    back = [None] * n + [np.ones_like(ahead[0])]
    for s in range(n - 1, -1, -1):
        total, under = np.zeros_like(ahead[0]), np.ones_like(ahead[0])
        for e in range(s + 1, min(n, s + width) + 1):
            under = under * scales[e]
            # The share of the word's probability whose segmentations have the piece from s to e.
            rows = model.pieces(words, s, e)
            gain = model.matrix[rows] / under * back[e]
            np.add.at(expected, rows, gain * weight)
            total += gain
        back[s] = total


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """Tables for the languages from their words' counts."""
    languages = sorted(counts)
    model = Model(languages, {p: np.full(len(languages), 1.0 / max(1, len(pieces))) for p in pieces})
    groups: dict[int, list[str]] = {}
    for w in sorted(set().union(*counts.values())) if languages else []:
        groups.setdefault(len(w), []).append(w)
    for _ in range(rounds):
        expected = np.zeros((len(model.rows) + 2, len(languages)))
        for group in groups.values():
            block = max(1, min(4096, 65_536 // len(group[0])))
            for at in range(0, len(group), block):
                some = group[at : at + block]
                weight = np.array([[counts[g][w] for g in languages] for w in some], float)
                expectations(model, [START + w for w in some], weight, expected)
        totals = expected.sum(axis=0)
        model = Model(languages, {p: (expected[i] + FLOOR) / (totals + 1) + FLOOR for p, i in model.rows.items() if expected[i].any()}) if groups else model
    return model


def sample_counts(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, Counter]:
    """Counts of the words of each language's sample, whose documents are bounded whatever the corpus."""
    ship(labelled.sparkSession)
    rows = labelled.where(labelled["lang"].isNotNull() & labelled["text"].isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # Equal texts share a hash: they count once here, or a text that is repeated often would pass or fail as a whole.
    counted = written(hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    sample = max(1, min(sample, TOTAL // max(1, counted.count())))
    # A hash threshold with room to spare thins the rows before the exact cut.
    thinned = hashed.join(counted, "lang").where((F.shiftrightunsigned("h", 1) / F.lit(float(2**63))) <= F.least(F.lit(1.0), (F.lit(2.0 * sample) + 50) / F.col("n")))
    thinned = thinned.select("lang", "h", "text").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = thinned.withColumn("r", rank).where(F.col("r") <= sample).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.setdefault(lang, Counter()).update(words_of(text))
            rows = [(g, w, n) for g, c in out.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    found: dict[str, Counter] = {}
    counted = chosen.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # the words of the bounded sample
        found.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return found


def train(labelled: DataFrame, vocabulary_path: str) -> Model:
    """A model from the labelled rows (text, lang)."""
    return fit(sample_counts(labelled), vocabulary(vocabulary_path))


_models: dict[int, Model] = {}


def predict(docs: DataFrame, model: Model, key: str, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the columns ``lang`` and ``score`` of each row's text. ``key`` is the text's column."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))  # at most the vocabulary and its languages
    number = sent.id if hasattr(sent, "id") else id(sent)
    place = docs.columns.index(key)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _models:
            _models.clear()
            _models[number] = Model(*sent.value)
        own = _models[number]
        yield from predicted(own, batches)
        own.forget()
        tidy()

    def predicted(own: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = min(TEXTS, batch.num_rows - at)
                while size > 1 and batch.slice(at, size).column(place).nbytes > BYTES:
                    size //= 2
                part = batch.slice(at, size)
                at += size
                found = own.predict(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*part.schema.names, lang, score]
                )

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows that are not held out."""
    out = held_out(docs["doc_id"])
    model = train(docs.where(~out).select(docs["text"], docs["lang"]), vocabulary_path)
    rows = docs.select(docs["doc_id"], out.alias("held_out"), docs["text"].cast("string").alias("text"))
    return predict(rows, model, "text").select("doc_id", "held_out", "lang_pred", "score")
