"""Language identification by unigrams of pieces, summed over all segmentations.

Pieces come from a fixed public vocabulary; each language has a probability for each piece. A word's probability in a language is
the sum, over all ways of writing it as a sequence of pieces, of the product of their probabilities: a forward algorithm over
the word's positions. A text's is the product over its words. Probabilities are estimated by expectation and maximisation over the
distinct words of all training texts: each word adds, as often as it comes, what a forward and a backward pass expect of each piece in it.

Words are found as arrays, one for each word length; pieces by walking their trie, so a place is given up where no piece goes on. Forward
and backward values are scaled as they go, so a word may be of any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.shared import materialise

WORD = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
START = "▁"
#: Every so many positions forward and backward values are scaled; a character outside of all pieces costs about 1e-15 at most.
SCALED = 8
REMEMBERED = 1 << 19
SMOOTHING = 0.05


def vocabulary(path: str) -> list[str]:
    """The letter pieces of a SentencePiece model in lower case, each once, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = dict.fromkeys(model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return [p for p in pieces if LETTERS.fullmatch(p.removeprefix(START))]


def tokens_of(text: str | None) -> list[str]:
    """Runs of letters, and of some numerals that are much like them, lower-cased."""
    return WORD.findall(text.lower()) if text else []


def words_in(token: str) -> list[str]:
    """The runs of letters in a token, each with the mark of a word's start."""
    return [START + x for x in ([token] if token.isalpha() else LETTERS.findall(token))]


class Lattice:
    """Finds the pieces in words. A piece's number is its place in the vocabulary; the last number stands for any other character."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        # the trie: a node for each beginning of a piece; its edges by (node, character), which no two share
        node: dict[str, int] = {"": 0}
        edges: dict[int, int] = {}
        for p in pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in node:
                    node[p[:k]] = len(node)
                    edges[node[p[: k - 1]] << 21 | ord(p[k - 1])] = node[p[:k]]
        self.piece = np.full(len(node), -1, np.int64)
        self.piece[[node[p] for p in pieces]] = np.arange(len(pieces))
        keys, self.child = np.fromiter(edges.keys(), np.uint64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
        rng = np.random.default_rng(7)
        bits = max(14, len(keys).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        while True:  # two tables: what shares a place in the first is put in the second, whose multiplier leaves none sharing
            self.mix = [np.uint64(x | 1) for x in rng.integers(1, 1 << 63, 2).tolist()]
            self.tables = []
            rest = np.arange(len(keys))
            for m in self.mix:
                at = ((keys[rest] * m) >> self.shift).astype(np.int64)
                table = np.full(1 << bits, -1, np.int32)
                _, first = np.unique(at, return_index=True)
                table[at[first]] = rest[first]
                self.tables.append(table)
                rest = np.delete(rest, first)
            if not len(rest):
                break
        self.keys, self.child = np.append(keys, np.uint64(0)), np.append(self.child, -1)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes after a character; -1 where there is none."""
        key = (node.astype(np.uint64) << np.uint64(21)) | char
        one, two = (t[((key * m) >> self.shift).astype(np.int64)] for t, m in zip(self.tables, self.mix))
        return self.child[np.where(self.keys[one] == key, one, np.where(self.keys[two] == key, two, -1))]

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each word length the places of its words in the list, and their characters."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == n)
            for part in np.array_split(rows, max(1, len(rows) * int(n) >> 20)):
                codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
                yield part, codes.reshape(len(part), n).astype(np.uint64)

    def edges(self, codes: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray]]:
        """(until, rows, piece) for the pieces that begin at position i."""
        rows, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for j in range(i, min(codes.shape[1], i + self.longest)):
            node = self.step(node, codes[rows, j])
            piece = np.where(node >= 0, self.piece[node], -1)
            if j == i:
                yield j + 1, slice(None), np.where(piece < 0, self.unknown, piece)
            elif (hit := piece >= 0).any():
                yield j + 1, rows[hit], piece[hit]
            if not (alive := node >= 0).all():
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    return

    def log_likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """(words, languages): the logarithm of the sum over all segmentations. p: (pieces + 1, languages)."""
        out = np.zeros((len(words), p.shape[1]))
        for rows, codes in self.groups(words):
            n = codes.shape[1]
            alpha = np.zeros((n + 1, len(rows), p.shape[1]))
            alpha[0] = 1
            scale = np.zeros((len(rows), p.shape[1]))
            for i in range(n):
                if i and i % SCALED == 0:
                    most = alpha[i].copy()
                    scale += np.log(most)
                    alpha[i : i + self.longest] /= most
                for j, hit, piece in self.edges(codes, i):
                    alpha[j][hit] += alpha[i][hit] * p[piece]
            out[rows] = np.log(alpha[n]) + scale
        return out

    def expected(self, words: list[str], weight: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected number of each piece over the words, each counted `weight` times, and their log-likelihood. p: one probability for each piece."""
        out, total = np.zeros(self.unknown + 1), 0.0
        for rows, codes in self.groups(words):
            n = codes.shape[1]
            found = [list(self.edges(codes, i)) for i in range(n)]
            # alpha[i] and beta[i] are kept with the logarithms that they are to be raised by
            alpha, beta = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
            up, down = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
            alpha[0], beta[n] = 1, 1
            raised = np.zeros(len(rows))
            for i in range(n):
                if i and i % SCALED == 0:
                    most = alpha[i].copy()
                    raised = raised + np.log(most)
                    alpha[i : i + self.longest] /= most
                up[i] = raised
                for j, hit, piece in found[i]:
                    alpha[j][hit] += alpha[i][hit] * p[piece]
            up[n] = raised
            for i in reversed(range(n)):
                # what begins here ends at most `longest` further on; all of it is brought to the scale of the next position
                down[i] = down[i + 1]
                for j, hit, piece in found[i]:
                    beta[i][hit] += beta[j][hit] * np.exp(down[j] - down[i])[hit] * p[piece]
                if i % SCALED == 0:
                    most = beta[i].copy()
                    down[i] += np.log(most)
                    beta[i] = 1
            whole = np.log(alpha[n]) + up[n]
            total += float(weight[rows] @ whole)
            for i in range(n):
                for j, hit, piece in found[i]:
                    share = weight[rows] * alpha[i] * beta[j] * np.exp(up[i] + down[j] - whole)
                    out += np.bincount(piece, share[hit] * p[piece], len(out))
        return out, total


@lru_cache(2)
def lattice_of(pieces: tuple[str, ...]) -> Lattice:
    """The lattice of a vocabulary, built once in each worker."""
    return Lattice(list(pieces))


@dataclass
class Model:
    pieces: list[str]
    languages: list[str]
    p: np.ndarray


@dataclass(frozen=True)
class Training:
    """steps: most steps of expectation and maximisation; they end before if the log-likelihood grows by less than the share `gain`."""

    steps: int = 6
    gain: float = 0.002


def count_words(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over all rows with a language and a text; counts are summed up in each task before they are shuffled."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def settle() -> Iterator[pd.DataFrame]:
            for lang, c in held.items():
                rows = [(w, n) for token, n in c.items() for w in words_in(token)]
                if rows:
                    yield pd.DataFrame({"lang": lang, "word": [r[0] for r in rows], "n": [r[1] for r in rows]}, columns=["lang", "word", "n"])
            held.clear()

        for part in parts:
            for lang, text in zip(part["lang"], part["text"]):
                held.setdefault(lang, Counter()).update(tokens_of(text))
                if sum(map(len, held.values())) > REMEMBERED:
                    yield from settle()
        yield from settle()

    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # a number of tasks that is named: few bytes are much work here
    return counted.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def learn(df: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", plan: Training = Training()) -> Model:
    """Learns from all rows of `df` with a language: of each step only the expected counts, one for each language and piece, reach the driver. Rows with a null
    language or text are left out; without any the model knows no language."""
    pieces = vocabulary(vocabulary_path)
    words = materialise(count_words(df, text_col, lang_col))
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)))
    p = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    before = None
    for _ in range(plan.steps):
        table = {lang: p[:, k] for k, lang in enumerate(languages)}

        def expect(parts: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
            lattice = lattice_of(tuple(pieces))
            total: dict[str, np.ndarray] = {}
            held: list[pd.DataFrame] = []

            def settle() -> None:  # many words at a time: arrays of words of one length are to be long
                for lang, own in pd.concat(held).groupby("lang") if held else ():
                    counts, likelihood = lattice.expected(own["word"].tolist(), own["n"].to_numpy(float), table[lang])
                    total[lang] = total.get(lang, 0) + np.append(counts, likelihood)
                held.clear()

            for part in parts:
                held.append(part)
                if sum(map(len, held)) >= 1 << 17:
                    settle()
            settle()
            for lang, x in total.items():
                some = np.flatnonzero(x)
                yield pd.DataFrame({"lang": lang, "piece": some, "n": x[some]})

        # sums of doubles differ with the order of addition; whole millionths do not
        counts = words.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum(F.round(F.col("n") * 1e6).cast("decimal(38,0)")).alias("n")).toPandas()
        found = np.zeros((len(pieces) + 2, len(languages)))
        found[counts["piece"], [languages.index(x) for x in counts["lang"]]] = counts["n"].astype(float) / 1e6
        likelihood, found = found[-1].sum(), found[:-1] + SMOOTHING
        p = found / found.sum(axis=0)
        if before is not None and likelihood - before < plan.gain * abs(before):
            break
        before = likelihood
    return Model(pieces, languages, p)


def identify(text: Column, model: Model) -> Column:
    """A struct of lang and score, the posterior of that language with all alike before. `und` with score 0 if a text is null or has no letter."""
    pieces, languages, p = model.pieces, model.languages, model.p

    @F.pandas_udf("lang string, score double")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lattice = lattice_of(tuple(pieces))
        # a token's row; the first row is that of tokens without a letter
        place: dict[str, int] = {}
        known = np.zeros((1, len(languages)))
        for texts in batches:
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts), 2500) if languages else ():
                split = [tokens_of(t) for t in texts.iloc[at : at + 2500]]
                if len(place) > REMEMBERED:
                    place, known = {}, known[:1]
                new = list(set().union(*split).difference(place))
                words = [words_in(token) for token in new]
                rows = np.cumsum([len(w) > 0 for w in words]) + len(known) - 1
                place.update((token, int(row) if w else 0) for token, row, w in zip(new, rows, words))
                if flat := [x for w in words for x in w]:
                    firsts = np.cumsum([0, *(len(w) for w in words if w)])[:-1]
                    known = np.concatenate([known, np.add.reduceat(lattice.log_likelihood(flat, p), firsts, axis=0)])
                for i, s in enumerate(split):
                    own = np.fromiter(map(place.__getitem__, s), np.int64, len(s))
                    if own.any():
                        total = known[own].sum(axis=0)
                        best = int(total.argmax())
                        lang[at + i], score[at + i] = languages[best], 1 / np.exp(total - total[best]).sum()
            yield pd.DataFrame({"lang": lang, "score": score})

    return named(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def predict_languages(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of `df`: id, held_out (a null id is not), lang_pred and score. Learned from the rows that are not held out.
    Repeated rows repeat; an empty table gives an empty result; with nothing to learn from, all are `und`. Other columns are not read."""
    model = learn(df.where(~held_out(id_col)), vocabulary_path, text_col, lang_col)
    marked = df.select(F.col(id_col), held_out(id_col).alias("held_out"), identify(F.col(text_col), model).alias("s"))
    return marked.select(id_col, "held_out", F.col("s.lang").alias("lang_pred"), F.col("s.score").alias("score"))
