"""Language identification by unigram piece models, summed over all segmentations.

The pieces are those of a fixed public vocabulary; per language a
probability for every piece is learned by EM from labelled texts.  A word's probability in a
language is the sum over all ways to cut it into pieces (forward algorithm); a text's score is
the sum of the logarithms over its words, and the prediction the language with the highest
posterior under equal priors (equal scores: the first in text order).

Training uses at most ``train_docs`` texts per language, chosen by a hash of the document id (a
bounded, documented sample; whole texts).  Words are counted by Spark; one EM step is one job whose
expected counts are summed by (language, piece), so the driver holds languages x pieces
numbers.  Prediction scores each distinct word of a batch once, for all languages together.

Words are lower-cased parts between white space with a word-start mark, of any length: the forward sums are
rescaled as they run, and only as many of them are kept as the longest piece has characters.  A character that is no piece
has one small probability in every language.  The score is the posterior of an average word of the text (the mean of its words'
logarithms), so it doesn't run to 1 with the text's length.  Defined results: null texts and texts without a letter are
``und`` with score 0, and so is everything if no labelled text is given; repeated rows
are predicted each; an empty table gives no rows; lang, source and id are never inputs of a prediction.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.session import checkpointed

RESCALE = 16                # characters between two rescalings of the sums
MARK = "▁"              # start of a word in the vocabulary
UNKNOWN = 1e-7              # probability of a character that is no piece
MEMO = 200_000              # words that a task remembers
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a vocabulary file, lower-cased."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return sorted({model.id_to_piece(i).lower() for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


def words_of(text: str) -> Iterator[str]:
    """Marked, lower-cased words."""
    return (MARK + w for w in text.lower().split())


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(words), -1)


class Pieces:
    """Finds pieces of the vocabulary in words of equal length."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.n, self.hashes, self.ids, self.longest = len(pieces), hashes[order], order, max(map(len, pieces), default=1)
        self.seen, self.begins = np.zeros((2, 1 << 20), bool)       # filters: pieces, and what longer pieces begin with
        self.seen[(self.hashes * _MIX) >> np.uint64(44)] = True
        starts = np.array([self._hash(x) for x in {p[:k] for p in pieces for k in range(1, len(p))}], np.uint64)
        self.begins[(starts * _MIX) >> np.uint64(44)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, places of the words with a piece there, their pieces; n: an unknown character) in order of start."""
        codes = _codes(words) + np.uint64(1)
        size = codes.shape[1]
        every = np.arange(len(words))
        for i in range(size):
            live, h = every, np.zeros(len(words), np.uint64)
            for length in range(1, min(self.longest, size - i) + 1):
                h = h * _BASE + codes[live, i + length - 1]
                bits = (h * _MIX) >> np.uint64(44)
                may = np.flatnonzero(self.seen[bits])
                at = np.minimum(np.searchsorted(self.hashes, h[may]), max(self.n - 1, 0))
                same = self.hashes[at] == h[may] if self.n else np.zeros(0, bool)
                hit, piece = live[may[same]], self.ids[at[same]]
                if length == 1 and len(hit) < len(words):
                    known = np.full(len(words), self.n, np.int64)
                    known[hit] = piece
                    hit, piece = every, known
                if len(hit):
                    yield i, length, hit, piece
                on = self.begins[bits]
                if not on.all():
                    live, h = live[on], h[on]
                if not len(live):
                    break


def forward(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """log P(word) in every language for words of equal length; ``prob`` has a row for unknown characters at its end.

    A ring of sums holds the places that pieces can still reach; all sums of a word and language share one scale."""
    size, ring = len(words[0]), pieces.longest + 1
    alpha = np.zeros((ring, len(words), prob.shape[1]))
    alpha[0] = 1
    scale = np.zeros((len(words), prob.shape[1]))
    here = 0
    for i, length, hit, piece in pieces.spans(words):
        if i != here:
            alpha[here % ring] = 0
            here = i
            if i % RESCALE == 0:
                top = alpha.max(axis=0)
                alpha /= top
                scale += np.log(top)
        if len(hit) == len(words):
            alpha[(i + length) % ring] += alpha[i % ring] * prob[piece]
        else:
            alpha[(i + length) % ring, hit] += alpha[i % ring, hit] * prob[piece]
    return np.log(alpha[size % ring]) + scale


def _sums(spans: list, size: int, n: int, prob: np.ndarray, longest: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all cuts before (or ``back``: after) every place of each word, and the logarithm of the scale that each is kept in."""
    sums, scale = np.zeros((size + 1, n)), np.zeros((size + 1, n))
    sums[size if back else 0] = 1
    here = size if back else 0
    for i, length, hit, piece in reversed(spans) if back else spans:
        # `here` is the place the sums have moved on to; rescale what can still be reached
        if i != here:
            here = i
            if i % RESCALE == 0:
                reach = slice(i + 1, i + longest + 1) if back else slice(i, i + longest)
                top = sums[reach].max(axis=0)
                sums[reach] /= top
                scale[reach] += np.log(top)
                if back:
                    scale[:i + 1] = scale[i + 1]
                else:
                    scale[i:] = scale[i]
        if back:
            sums[i, hit] += prob[piece] * sums[i + length, hit]
        else:
            sums[i + length, hit] += sums[i, hit] * prob[piece]
    return sums, scale


def expected(words: list[str], weight: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of weighted words of equal length (one language)."""
    size, spans = len(words[0]), list(pieces.spans(words))
    alpha, before = _sums(spans, size, len(words), prob, pieces.longest, False)
    beta, behind = _sums(spans, size, len(words), prob, pieces.longest, True)
    total = np.log(alpha[size]) + before[size]
    out = np.zeros(pieces.n + 1)
    for i, length, hit, piece in spans:
        part = alpha[i, hit] * prob[piece] * beta[i + length, hit] * np.exp(before[i, hit] + behind[i + length, hit] - total[hit])
        out += np.bincount(piece, weight[hit] * part, minlength=pieces.n + 1)
    return out[:pieces.n]


def by_length(words) -> Iterator[list[str]]:
    """Words of equal length together, in bounded parts."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for group in groups.values():
        for i in range(0, len(group), 8192):
            yield group[i:i + 8192]


def with_unknown(prob: np.ndarray) -> np.ndarray:
    """A row for unknown characters added."""
    return np.concatenate([prob, np.full((1, prob.shape[1]), UNKNOWN)])


def training_sample(docs: DataFrame, train_docs: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text): at most ``train_docs`` labelled texts of each language, by a hash of id and text; rows repeated whole count once.

    The counts of the languages (one row each) say which hashes can be among the first, so no more than about 2 * train_docs hashes of a
    language are ordered, without texts; the texts are fetched for the chosen ones alone."""
    known = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .withColumn("key", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))))
    often = known.groupBy("lang").agg(F.count("*").alias("n"))
    few = (known.select("lang", "id", "key").join(F.broadcast(often), "lang")
           .where(F.col("key") < F.lit(float(2 * train_docs + 100) * (1 << 40)) / F.col("n")).select("lang", "key", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name")).distinct())
    by_lang = Window.partitionBy("lang").orderBy("key", "name")
    chosen = few.withColumn("place", F.row_number().over(by_lang)).where(F.col("place") <= train_docs).drop("place")      # train_docs a language
    rows = known.withColumn("name", F.coalesce(F.col("id").cast("string"), F.lit("")))
    return rows.join(F.broadcast(chosen), ["lang", "key", "name"]).dropDuplicates(["lang", "key", "name"]).select("lang", "text")


def train(sample: DataFrame, vocabulary: list[str], steps: int = 3) -> tuple[list[str], np.ndarray]:
    """(languages in text order, piece probabilities pieces x languages) from rows (lang, text)."""
    spark, n = sample.sparkSession, len(vocabulary)

    def count(batches):
        for pdf in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(pdf["lang"], pdf["text"]):
                seen.setdefault(lang, Counter()).update(words_of(text))
            yield pd.DataFrame([(lang, w, c) for lang, own in seen.items() for w, c in own.items()], columns=["lang", "word", "n"])

    counted = checkpointed(sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langwords")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    prob = np.full((n, len(langs)), 1 / max(n, 1))
    shared_words = spark.sparkContext.broadcast(vocabulary)
    for _ in range(steps if langs else 0):
        shared = spark.sparkContext.broadcast(with_unknown(prob))

        def step(batches, shared=shared):
            pieces = Pieces(shared_words.value)
            sums: dict[str, np.ndarray] = {}
            for pdf in batches:
                for lang, own in pdf.groupby("lang"):
                    weight = dict(zip(own["word"], own["n"]))
                    p = shared.value[:, langs.index(lang)]
                    for words in by_length(weight):
                        sums[lang] = sums.get(lang, 0) + expected(words, np.array([weight[w] for w in words], float), pieces, p)
            for lang, s in sums.items():
                hit = np.flatnonzero(s)
                yield pd.DataFrame({"lang": lang, "piece": hit, "value": s[hit]})

        found = counted.mapInPandas(step, "lang string, piece int, value double").groupBy("lang", "piece").agg(F.sum("value").alias("value")).toPandas()
        counts = np.full((n, len(langs)), 0.1)
        counts[found["piece"].to_numpy(np.int64), [langs.index(x) for x in found["lang"]]] += found["value"].to_numpy()
        prob = counts / counts.sum(axis=0)
    return langs, prob


def predict_column(text: Column, langs: list[str], prob: np.ndarray, vocabulary: list[str], spark) -> Column:
    """struct<lang_pred, score> of each text."""
    shared = spark.sparkContext.broadcast((vocabulary, with_unknown(prob)))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary, prob = shared.value
        pieces, place, table, used = Pieces(vocabulary), {}, np.zeros((MEMO, max(1, len(langs)))), 0
        for texts in batches:
            out = []
            for at in range(0, len(texts), 256):
                counted = [Counter(words_of(t)) if t and langs and any(map(str.isalpha, t)) else None for t in texts[at:at + 256]]
                new = [w for w in set().union(*(c for c in counted if c)) if w not in place]
                if used + len(new) > len(table):          # forget all, make room for this part
                    place, used = {}, 0
                    new = list(set().union(*(c for c in counted if c)))
                    table = np.zeros((max(MEMO, len(new)), max(1, len(langs))))
                for words in by_length(new):
                    table[used:used + len(words)] = forward(words, pieces, prob)
                    place.update(zip(words, range(used, used + len(words))))
                    used += len(words)
                for c in counted:
                    if c is None:
                        out.append(("und", 0.0))
                        continue
                    total = np.fromiter(c.values(), float, len(c)) @ table[np.fromiter(map(place.__getitem__, c), np.int64, len(c))]
                    best = int(total.argmax())
                    out.append((langs[best], float(1 / np.exp((total - total[best]) / c.total()).sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict(text)
