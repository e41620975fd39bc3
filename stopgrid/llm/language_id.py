"""Language ID by unigrams over a fixed public vocabulary of pieces, all segmentations summed.

For each language every piece has a probability. A word's probability is the
sum over all ways to cut it into pieces, by a forward pass over its letters;
a text's is the product over its words. Pieces with a word-start mark match at
the start of a word only, and no piece crosses words, so words are independent
and each is scored once for a worker's cache of CACHE_WORDS.

The probabilities are fitted by expectation-maximisation (forward and backward
passes give expected piece counts) to the words of about SAMPLE_DOCS documents
a language, chosen by a hash of their id, of each at most SAMPLE_CHARS code
points from a place chosen by that hash: the documented bound of the training
sample. A language whose documents are all long is learned like any other.
Prediction covers every text and all of it. The model holds a number for each
piece and language; more than MAX_LANGS languages are an error, not a cut.

Defined results: a text that is null or has no letter (Unicode category L) is
``und`` with score 0; without any training document all are; ties go to the
first language by name; words beyond MAX_WORD letters are scored in parts; a
text of megabytes is scored whole, a word at a time; repeated rows give repeated
results; an empty table gives an empty table; lang_pred and score replace
columns of their name and all others pass through.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import schema_of, small_batches

SAMPLE_DOCS = 150
SAMPLE_CHARS = 20_000
MAX_LANGS = 2_000
ROUNDS = 3
MAX_WORD = 40
CACHE_WORDS = 300_000
START = "▁"
WORD = regex.compile(r"\p{L}+")
BASE = np.uint64(0x100000001B3)


def words_of(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if words and max(map(len, words)) > MAX_WORD:
        words = [w[i : i + MAX_WORD] for w in words for i in range(0, len(w), MAX_WORD)]
    return words


class Pieces:
    """The vocabulary's pieces of lower-case letters, as a hash table of all their prefixes."""

    def __init__(self, names: list[str]):
        own = sorted({n for n in names if (x := n.removeprefix(START)) == x.lower() and (x.isalpha() or n == START)})
        self.names = [*own, ""]  # the last stands for any letter without a piece
        ids = {n: i for i, n in enumerate(own)}
        prefixes = sorted({n[:k] for n in own for k in range(1, len(n) + 1)})
        self.longest = max(map(len, own), default=1)
        bits = max(8, (4 * len(prefixes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key = np.zeros(1 << bits, np.uint64)
        self.id = np.full(1 << bits, -1, np.int32)
        self.probes = 1
        for p in prefixes:
            h = np.zeros(1, np.uint64)
            for c in p:
                h = h * BASE + np.uint64(ord(c))
            slot, n = int(self._slot(h)[0]), 1
            while self.key[slot]:
                slot, n = (slot + 1) % len(self.key), n + 1
            self.key[slot], self.id[slot] = h[0], ids.get(p, -1)
            self.probes = max(self.probes, n)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a prefix, and the piece it is or -1."""
        slot = self._slot(h)
        ok = self.key[slot] == h
        got = np.where(ok, self.id[slot], -1)
        todo = np.flatnonzero(~ok & (self.key[slot] != 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) % len(self.key)
            k = self.key[slot[todo]]
            hit = k == h[todo]
            ok[todo[hit]] = True
            got[todo[hit]] = self.id[slot[todo[hit]]]
            todo = todo[~hit & (k != 0)]
        return ok, got

    def lattice(self, words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, int]:
        """Arcs (from, to, piece) in groups that may be added at once, in forward order; each word's first node; number of nodes."""
        text = "".join([START + w for w in words])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 1 for w in words])
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(codes)) - begin[word]
        room = size[word] - place
        live, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        start, length, piece = [], [], []
        for k in range(1, self.longest + 1):
            ok = room[live] >= k
            live, h = live[ok], h[ok]
            if not len(live):
                break
            h = h * BASE + codes[live + k - 1]
            is_prefix, got = self._find(h)
            if k == 1:  # every letter has a piece at least
                got = np.where(got < 0, len(self.names) - 1, got)
                is_prefix = is_prefix | True
            some = got >= 0
            start.append(live[some])
            length.append(np.full(int(some.sum()), k))
            piece.append(got[some])
            live, h = live[is_prefix], h[is_prefix]
        start, length, piece = np.concatenate(start), np.concatenate(length), np.concatenate(piece)
        group = place[start] * (self.longest + 1) + length
        order = np.argsort(group, kind="stable")
        start, length, piece, group = start[order], length[order], piece[order], group[order]
        at = start + word[start]  # one node more for each word before
        cuts = np.flatnonzero(np.diff(group)) + 1
        arcs = list(zip(np.split(at, cuts), np.split(at + length, cuts), np.split(piece, cuts), strict=True))
        return arcs, begin + np.arange(len(words)), len(codes) + len(words)

    def word_scores(self, words: list[str], theta: np.ndarray) -> np.ndarray:
        """log P(word) for each word and language, by the forward pass."""
        if not words:
            return np.zeros((0, theta.shape[1]))
        arcs, first, n = self.lattice(words)
        alpha = self._forward(arcs, first, n, theta)
        last = np.concatenate([first[1:] - 1, [n - 1]])
        return np.log(np.maximum(alpha[last], 1e-300))

    @staticmethod
    def _forward(arcs, first, n, theta):
        alpha = np.zeros((n, theta.shape[1]))
        alpha[first] = 1
        for a, b, p in arcs:
            alpha[b] += alpha[a] * theta[p]
        return alpha

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Piece probabilities (piece, language) from word counts (word, language)."""
        k, m = counts.shape[1], len(self.names)
        length = np.array([max(1, len(n)) for n in self.names], float)
        theta = np.repeat((0.05**length / (0.05**length).sum())[:, None], k, axis=1)
        arcs, first, n = self.lattice(words)
        last = np.concatenate([first[1:] - 1, [n - 1]])
        for _ in range(rounds):
            alpha = self._forward(arcs, first, n, theta)
            beta = np.zeros_like(alpha)
            beta[last] = counts / np.maximum(alpha[last], 1e-300)
            total = np.zeros((m, k))
            for a, b, p in reversed(arcs):
                through = theta[p] * beta[b]
                gain = through * alpha[a]
                for j in range(k):
                    total[:, j] += np.bincount(p, gain[:, j], m)
                beta[a] += through
            pooled = total.sum(1, keepdims=True) + 0.01
            total += 20 * pooled / pooled.sum() + 1e-4
            theta = total / total.sum(0)
        return theta


def vocabulary(path: str) -> list[str]:
    """The names of the normal pieces of a piece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training; one without id is neither trained on nor held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_words(train: DataFrame, docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, word, n) of the training sample; ``train`` has doc_id, text, lang."""
    fit = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = fit.groupBy("lang").agg(F.count("*").alias("c"))
    if sizes.limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    share = F.least(F.lit(1.0), F.lit(docs) / F.col("c"))
    chosen = fit.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    beyond = F.greatest(F.lit(0), F.length("text") - SAMPLE_CHARS)
    start = F.pmod(F.xxhash64(F.lit(9), "doc_id"), beyond + 1) + 1
    chosen = chosen.withColumn("text", F.substring("text", start, F.lit(SAMPLE_CHARS)))
    small_batches(train.sparkSession)

    def rows(batches):
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            n = Counter((lang, w) for lang, t in zip(*[c.to_pylist() for c in b.columns], strict=True) for w in words_of(t))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    return chosen.select("lang", "text").mapInArrow(rows, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train_model(train: DataFrame, names: list[str], docs: int = SAMPLE_DOCS) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, piece names, probabilities)."""
    rows = sample_words(train, docs).toArrow().to_pandas()
    pieces = Pieces(names)
    if not len(rows):
        return [], names, np.zeros((len(pieces.names), 0))
    langs, words = sorted(rows["lang"].unique()), sorted(rows["word"].unique())
    counts = np.zeros((len(words), len(langs)))
    of_word, of_lang = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(langs)}
    counts[[of_word[w] for w in rows["word"]], [of_lang[x] for x in rows["lang"]]] = rows["n"]
    return langs, names, pieces.fit(words, counts)


class Scorer:
    """Scores texts in batches, with the words' scores kept."""

    def __init__(self, model):
        self.langs, names, self.theta = model
        self.pieces = Pieces(names)
        self._reset()

    def _reset(self):
        self.place: dict[str, int] = {}
        self.score = np.zeros((0, len(self.langs)), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.place) > CACHE_WORDS:
            self._reset()
        words = [words_of(t or "") for t in texts]
        place = self.place
        new = [w for w in {w for ws in words for w in ws} if w not in place]
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            got = self.pieces.word_scores(some, self.theta).astype(np.float32)
            n = len(self.score)
            self.score = np.concatenate([self.score, got])
            place.update(zip(some, range(n, n + len(some)), strict=True))
        out = []
        for ws in words:
            if not ws or not self.langs:
                out.append(("und", 0.0))
                continue
            s = self.score[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(0, dtype=np.float64)
            p = np.exp(s - s.max())
            out.append((self.langs[int(s.argmax())], float(1 / p.sum())))
        return out


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the posterior of that language under equal priors)."""
    import uuid

    small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    keep = kept.columns

    def rows(batches):
        import pyarrow as pa

        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        for b in batches:
            got = scorer.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

    schema = schema_of(kept, "lang_pred string, score double")
    return kept.mapInArrow(rows, schema)
